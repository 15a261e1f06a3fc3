"""Token ids of texts with a byte-level BPE vocabulary given as a rank file.

Texts are cut into pieces by the vocabulary's pattern with vectorised class
runs, equal pieces are encoded once, and ids are put together per text; the
result is that of the tokenizer's own ``encode_ordinary``.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa

from .common import BASE, BASE_INVERSE, flat, ragged, splitmix

_LETTER, _NUMBER, _SPACE = 1, 2, 3
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pieces that a worker remembers; when full it starts anew.
_MOST_PIECES = 150_000


def default_vocabulary() -> str:
    """The rank file of the installed public vocabulary with 50,256 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode()
    first = np.frombuffer(names, np.uint8)
    classes = np.zeros(0x110000, np.uint8)
    classes[first == ord("L")] = _LETTER
    classes[first == ord("N")] = _NUMBER
    classes[_SPACES] = _SPACE
    codes = splitmix(np.arange(1, 0x110001, dtype=np.uint64))
    return classes, codes, splitmix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def piece_starts(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start, given code points and the rows' offsets; a match never crosses rows."""
    n = len(points)
    classes = _tables()[0]
    kind = classes[points]
    is_row = np.zeros(n + 1, bool)
    is_row[rows] = True
    new = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new |= is_row[:n]
    runs = np.flatnonzero(new)
    ends = np.r_[runs[1:], n]
    space = kind[runs] == _SPACE
    start = np.zeros(n + 1, bool)
    start[runs] = True
    # the last of some spaces before a word is that word's, or a piece of its own
    at = ends[space]
    start[at[~is_row[at]] - 1] = True
    # a plain space joins the run behind it
    words = runs[~space]
    words = words[words > 0]
    words = words[(points[words - 1] == 32) & ~is_row[words]]
    start[words] = False
    # contractions, at an apostrophe that begins a match
    quote = runs[~space]
    quote = quote[(points[quote] == 39) & start[quote] & (quote + 1 < n)]
    quote = quote[~is_row[quote + 1]]
    if len(quote):
        b = points[quote + 1]
        third = np.minimum(quote + 2, n - 1)
        c = np.where((quote + 2 < n) & ~is_row[third], points[third], 0)
        one = np.isin(b, [ord(x) for x in "stmd"])
        two = ((b == ord("r")) & (c == ord("e"))) | ((b == ord("v")) & (c == ord("e"))) | ((b == ord("l")) & (c == ord("l")))
        for found, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[found + 1] = False
            rest = found + size
            rest = rest[(rest < n)]
            start[rest[(kind[rest] == _LETTER) & ~is_row[rest]]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes Arrow text columns to ids of 16 bits, or 32 where the vocabulary needs them; remembers pieces from batch to batch."""

    def __init__(self, path: str) -> None:
        self.encoding = encoding(path)
        self.known: dict[int, tuple[int, bytes]] = {}
        self.kind = np.dtype(np.uint16 if self.encoding.n_vocab <= 1 << 16 else np.uint32)
        self.code = "H" if self.kind.itemsize == 2 else "I"

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each row's; a null has none."""
        data, offsets = flat(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        if (data >= 0x80).any():
            points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            at_byte = np.r_[np.flatnonzero((data & 0xC0) != 0x80), len(data)]
            rows = np.searchsorted(at_byte, offsets)
        else:
            points, rows, at_byte = data, offsets, None
        starts = piece_starts(points, rows)
        n = len(points)
        ends = np.r_[starts[1:], n]
        up, down = _powers(1 << max(16, (n + 1).bit_length()))
        _, codes, others = _tables()

        def hashes(table: np.ndarray) -> np.ndarray:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(table[points] * up[:n], out=sums[1:])
            return (sums[ends] - sums[starts]) * down[starts]

        one, two = hashes(codes), hashes(others)
        unique, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two[first][inverse], two):
            return self.plainly(texts)
        if len(self.known) > _MOST_PIECES:
            self.known.clear()
        known, keys, checks = self.known, unique.tolist(), two[first].tolist()
        raw, encode = data.tobytes(), self.encoding._core_bpe.encode_single_piece
        from_, to = starts[first], ends[first]
        if at_byte is not None:
            from_, to = at_byte[from_], at_byte[to]
        pieces = []
        for key, check, a, b in zip(keys, checks, from_.tolist(), to.tolist()):
            hit = known.get(key)
            if hit is None:
                hit = known[key] = (check, array(self.code, encode(raw[a:b])).tobytes())
            elif hit[0] != check:
                return self.plainly(texts)
            pieces.append(hit[1])
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // self.kind.itemsize
        ids = np.frombuffer(b"".join(pieces), self.kind)
        each = size[inverse]
        sums = np.r_[0, np.cumsum(each)]
        per_row = np.diff(sums[np.searchsorted(starts, rows)])
        return ids[ragged((np.cumsum(size) - size)[inverse], each)], per_row

    def plainly(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same without shared pieces; for the case that two hashes of pieces are equal."""
        ids = [self.encoding.encode_ordinary(t or "") for t in texts.to_pylist()]
        return np.array([x for row in ids for x in row], self.kind), np.array([len(row) for row in ids], np.int64)
