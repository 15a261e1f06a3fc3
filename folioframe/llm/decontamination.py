"""Benchmark decontamination.

The benchmark's n-grams of words, in lower case and without punctuation, are
broadcast as a sorted set of hashes.  Every window of n words of every document
is looked up, hits are verified word by word, and the words that hits cover are
removed from the text; a document that is mostly benchmark goes as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    BASE,
    BYTE_CODES,
    WORD_RE,
    flat,
    id_type,
    in_sorted,
    lowered,
    materialise,
    ragged,
    span_hashes,
    splitmix,
    steps,
    text_key,
    word_hashes,
    word_spans,
)

#: Words in a window; a benchmark text with fewer words is one gram of its own length.
N = 8
#: A benchmark text with fewer words than this is too common to stand for the benchmark inside a text:
#: only a document that has just its words is a hit.
SHORT = 5
#: A document of which at least this share of words is removed is dropped.
DROP_SHARE = 0.5
#: Grams that are broadcast, at about 30 bytes and a word's letters each; beyond this the windows are joined by a shuffle.
BROADCAST_GRAMS = 2_000_000
#: Bits, as a power of two, of the filter that keeps most windows out of that shuffle.
FILTER_BITS = 27

_STEP = np.uint64(BASE)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; runs across rows are for the caller to leave out."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _STEP + words[j : j + m]
    return splitmix(out)


def joined_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in lower case with one space behind each: bytes, starts, ends, hashes, first word of each text."""
    data, offsets = lowered(texts)
    starts, ends, firsts = word_spans(data, offsets)
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    out[ragged(to, size)] = data[ragged(starts, size)]
    return out, to, to + size, word_hashes(data, starts, ends), firsts


def windows_of(firsts: np.ndarray, words: np.ndarray, sizes: list[int], short: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per size the first word of each window inside a text and its hash; below ``short`` only texts of just that size."""
    n_words = np.diff(firsts)
    row = np.repeat(np.arange(len(n_words)), n_words)
    for size in sizes:
        hashes = gram_hashes(words, size)
        at = np.arange(len(hashes))
        inside = at + size <= firsts[row[: len(hashes)] + 1]
        if size < short:
            inside &= n_words[row[: len(hashes)]] == size
        yield size, at[inside], hashes[inside]


class GramSet:
    """The benchmark's grams by length: sorted hashes and, to verify hits, where each stands in one buffer of words."""

    def __init__(self, texts: list[str], n: int, short: int = SHORT) -> None:
        self.short = short
        buffer, starts, ends, words, firsts = joined_words(pa.array(texts, pa.large_string()))
        self.buffer = buffer.tobytes()
        self.hashes: dict[int, np.ndarray] = {}
        self.spans: dict[int, np.ndarray] = {}
        n_words = np.diff(firsts)
        owner = np.repeat(np.minimum(n, n_words), n_words)
        for size in np.unique(np.minimum(n, n_words)).tolist():
            if size:
                _, at, hashes = next(windows_of(firsts, words, [size], 0))
                mine = owner[at] == size
                at, hashes = at[mine], hashes[mine]
                a, b = starts[at], ends[at + size - 1]
                # equal hashes with equal words once; other words are told from them by a second hash
                again = span_hashes(BYTE_CODES[buffer], a, b)
                order = np.lexsort((again, hashes))
                new = np.r_[True, (np.diff(hashes[order]) != 0) | (np.diff(again[order]) != 0)]
                keep = order[new]
                self.hashes[size], self.spans[size] = hashes[keep], np.stack([a[keep], b[keep]], 1)

    def grams(self, size: int) -> set[bytes]:
        return {self.buffer[a:b] for a, b in self.spans.get(size, ())}

    def hits(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int]]:
        """(first word, length) of each verified window, in a buffer that is in lower case."""
        words = word_hashes(data, starts, ends)
        found = []
        for size, at, hashes in windows_of(firsts, words, list(self.hashes), self.short):
            table, spans = self.hashes[size], self.spans[size]
            hit = in_sorted(hashes, table)[0]
            for i, h in zip(at[hit].tolist(), hashes[hit]):
                said = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                low, high = np.searchsorted(table, [h, h], side="left")[0], np.searchsorted(table, h, side="right")
                if any(self.buffer[a:b] == said for a, b in spans[low:high].tolist()):
                    found.append((i, size))
        return found


def _clean(batch_text: pa.Array, covered_of) -> tuple[list, list, list, list]:
    """For the rows with hits: row, text without the covered words, windows, words removed, words."""
    data, offsets = flat(batch_text)
    starts, ends, firsts = word_spans(data, offsets)
    low, low_offsets = lowered(batch_text)
    low_starts, low_ends, low_firsts = word_spans(low, low_offsets) if (data >= 0x80).any() else (starts, ends, firsts)
    if not np.array_equal(firsts, low_firsts):  # lower case has other words than the text: its own are looked up
        low, low_starts, low_ends, low_firsts = data, starts, ends, firsts
    covered = np.zeros(len(starts), bool)
    windows = np.zeros(len(offsets) - 1, np.int64)
    for i, size in covered_of(low, low_starts, low_ends, low_firsts):
        covered[i : i + size] = True
        windows[np.searchsorted(firsts, i, side="right") - 1] += 1
    n_words = np.diff(firsts)
    sums = np.r_[0, np.cumsum(covered)]
    removed = sums[firsts[1:]] - sums[firsts[:-1]]
    texts = {}
    for row in np.flatnonzero(removed).tolist():
        a, b = int(firsts[row]), int(firsts[row + 1])
        edge = np.diff(np.r_[False, covered[a:b], False].astype(np.int8))
        parts, at = [], int(offsets[row])
        for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            parts.append(data[at : starts[a + x]].tobytes())
            at = int(ends[a + y - 1])
        parts.append(data[at : offsets[row + 1]].tobytes())
        texts[row] = b"".join(parts).decode("utf-8", "surrogatepass")
    return texts, windows, removed, n_words


def _verdicts(windows: np.ndarray, removed: np.ndarray, n_words: np.ndarray, drop_share: float) -> tuple[np.ndarray, np.ndarray]:
    hit = removed > 0
    drop = hit & (removed >= drop_share * n_words)
    return hit, drop


def _grams(bench: DataFrame, n: int, short: int) -> GramSet:
    return GramSet([r[0] for r in bench.where("text IS NOT NULL").select(F.col("text").cast("string")).collect()], n, short)


def _size(bench: DataFrame) -> int:
    """An upper bound of the benchmark's grams: a word takes two characters at least."""
    row = bench.agg(F.sum(F.length(F.col("text").cast("string")))).first()
    return int(row[0] or 0) // 2 + 1


def _finder(docs: DataFrame, bench: DataFrame, n: int, short: int, most: int):
    """A function from (data, starts, ends, firsts) to hits, or None if the benchmark is too large to broadcast."""
    if _size(bench) > most:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(_grams(bench, n, short))
    return lambda *x: shared.value.hits(*x)


_WINDOWS = pa.schema([("key", pa.binary()), ("first", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("gram", pa.string())])


def grams_table(texts: DataFrame, n: int, short: int, sizes: list[int] | None, bits=None) -> DataFrame:
    """``key, first, size, hash, gram`` for windows of the texts; for the way by shuffle.

    Without ``sizes`` those of n words, or of all words of a shorter text;
    with them, windows of these sizes, and only those that ``bits`` may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits.value
        for batch in steps(batches, "text"):
            buffer, starts, ends, words, firsts = joined_words(batch.column("text"))
            n_words, raw = np.diff(firsts), buffer.tobytes()
            row = np.repeat(np.arange(len(n_words)), n_words)
            wanted = np.unique(np.minimum(n, n_words)).tolist() if sizes is None else sizes
            for size, at, hashes in windows_of(firsts, words, [x for x in wanted if x], 0 if sizes is None else short):
                if known is None:
                    keep = np.minimum(n, n_words)[row[at]] == size
                else:
                    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    keep = (known[place >> 3] >> (place & 7)) & 1 > 0
                at, hashes = at[keep], hashes[keep]
                of = row[at]
                said = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at + size - 1].tolist())]
                columns = [batch.column("key").take(pa.array(of)), pa.array((at - firsts[of]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(hashes.view(np.int64)), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=_WINDOWS)

    return texts.mapInArrow(run, "key binary, first int, size int, hash bigint, gram string")


def _filter(table: DataFrame) -> np.ndarray:
    """One bit for the upper bits of each gram's hash; made in segments, so that only its fixed size reaches the driver."""
    segment = 15
    place = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = table.select(F.shiftright(place, segment).alias("segment"), place.bitwiseAND((1 << segment) - 1).cast("int").alias("bit"))

    def pack_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for row in batch.column("bits"):
                flags = np.zeros(1 << segment, np.uint8)
                flags[row.values.to_numpy()] = 1
                packed.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), pa.array(packed, pa.binary())], ["segment", "bits"])

    parts = rows.groupBy("segment").agg(F.collect_set("bit").alias("bits")).mapInArrow(pack_bits, "segment bigint, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for number, bits in parts.collect():
        at = number << (segment - 3)
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def _hits_by_shuffle(docs: DataFrame, bench: DataFrame, n: int, short: int) -> DataFrame:
    """``h_key, h_hits``: hits of each distinct text that has any, found by joining the windows that pass a filter."""

    def keyed(texts: DataFrame) -> DataFrame:
        return texts.where("text IS NOT NULL").select(text_key().alias("key"), F.col("text").cast("string").alias("text"))

    table = materialise(grams_table(keyed(bench), n, short, None).select("size", "hash", "gram").distinct())
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # at most n
    bits = docs.sparkSession.sparkContext.broadcast(_filter(table))
    windows = grams_table(keyed(docs).dropDuplicates(["key"]), n, short, sizes, bits)
    hits = windows.join(table, ["size", "hash", "gram"], "left_semi")
    return materialise(hits.groupBy(F.col("key").alias("h_key")).agg(F.collect_list(F.struct("first", "size")).alias("h_hits")))


def _run(docs: DataFrame, bench: DataFrame, n: int, short: int, most: int) -> tuple[DataFrame, bool, object]:
    find = _finder(docs, bench, n, short, most)
    if find:
        return docs, False, find
    hits = _hits_by_shuffle(docs, bench, n, short)
    names = docs.columns
    held = "hits_of_text"
    while held in (c.lower() for c in names):
        held += "_"
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), text_key().alias("key"))
    return keyed.join(hits, F.col("key") == F.col("h_key"), "left").select("row.*", F.col("h_hits").alias(held)), True, None


def _batch_finder(find, batch: pa.RecordBatch):
    if find:
        return find
    rows = batch.column(batch.num_columns - 1).to_pylist()
    return lambda data, starts, ends, firsts: [(int(firsts[r]) + h["first"], h["size"]) for r, hits in enumerate(rows) for h in hits or []]


def decontaminate(docs: DataFrame, bench: DataFrame, n: int = N, drop_share: float = DROP_SHARE, broadcast_grams: int = BROADCAST_GRAMS, short: int = SHORT) -> DataFrame:
    """The verdict on each document: ``doc_id, action, n_windows, n_removed, n_words, text``.

    ``action`` is ``keep``, ``trim`` (covered words removed from the text) or
    ``drop`` (at least ``drop_share`` of the words covered; the text is null).
    A run of covered words goes with what stands between them; what stands
    around the run stays.  ``n_windows`` counts verified windows.  A benchmark
    text of fewer than ``short`` words is a hit only for a document that has
    just its words.

    Every input row gives one output row, repeated rows too.  A null text has no
    words and stays null; an empty text is kept; texts are scanned whole.  An
    empty benchmark, or one of nulls, keeps all; empty ``docs`` give an empty
    result.  Null ids stay null, and ids may have any type.  Columns
    other than ``doc_id`` and ``text`` are not read, and of the benchmark only
    ``text``.  The benchmark's size is checked before it is broadcast; beyond
    ``broadcast_grams`` all windows are joined to its grams by a shuffle, with
    the same result.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows, shuffled, find = _run(slim, bench, n, short, broadcast_grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            text = batch.column("text")
            texts, windows, removed, n_words = _clean(text, _batch_finder(find, batch))
            hit, drop = _verdicts(windows, removed, n_words, drop_share)
            action = np.where(drop, "drop", np.where(hit, "trim", "keep"))
            if hit.any():
                said = text.to_pylist()
                for row, new in texts.items():
                    said[row] = None if drop[row] else new
                text = pa.array(said, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(action.tolist(), pa.string()), pa.array(windows, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_words, pa.int64()), text.cast(pa.string())],
                ["doc_id", "action", "n_windows", "n_removed", "n_words", "text"],
            )

    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, action string, n_windows bigint, n_removed bigint, n_words bigint, text string")


def decontaminate_documents(docs: DataFrame, bench: DataFrame, n: int = N, drop_share: float = DROP_SHARE, broadcast_grams: int = BROADCAST_GRAMS, short: int = SHORT) -> DataFrame:
    """``docs`` without benchmark passages, with the columns of ``docs``; rules as in ``decontaminate``.

    Dropped documents are left out.  ``n_chars``, if it is an integer column,
    is the length of the new text where the text changes.  Other columns pass
    through, whatever they are called.
    """
    schema, names = docs.schema, docs.columns
    rows, shuffled, find = _run(docs, bench, n, short, broadcast_grams)
    counted = "n_chars" in names and isinstance(schema["n_chars"].dataType, (T.LongType, T.IntegerType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            texts, windows, removed, n_words = _clean(batch.column("text"), _batch_finder(find, batch))
            hit, drop = _verdicts(windows, removed, n_words, drop_share)
            columns = {c: batch.column(i) for i, c in enumerate(names)}
            if hit.any():
                said = columns["text"].to_pylist()
                for row, new in texts.items():
                    said[row] = new
                columns["text"] = pa.array(said, columns["text"].type)
                if counted:
                    columns["n_chars"] = pc.if_else(pa.array(hit), pc.utf8_length(columns["text"]).cast(columns["n_chars"].type), columns["n_chars"])
            out = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
            yield out.filter(pa.array(~drop)) if drop.any() else out

    return rows.mapInArrow(run, schema)


def decontaminate_sql(n: int = N, drop_share: float = DROP_SHARE, short: int = SHORT) -> str:
    return rf"""
WITH bench AS (SELECT item_id, list_transform(regexp_extract_all(text, '{WORD_RE}'), lambda x: lower(x)) AS w FROM benchmark WHERE text IS NOT NULL),
bench_grams AS (
  SELECT DISTINCT array_to_string(w[i + 1 : i + least({n}, len(w))], ' ') AS gram, least({n}, len(w)) AS size
  FROM (SELECT w, unnest(range(greatest(len(w) - {n} + 1, 1))) AS i FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bench_grams),
docs AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD_RE}') AS w, regexp_split_to_array(text, '{WORD_RE}') AS seps FROM documents),
low AS (SELECT doc_id, list_transform(w, lambda x: lower(x)) AS w FROM docs),
windows AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM low, sizes WHERE len(w) >= size AND (size >= {short} OR len(w) = size))),
hits AS (SELECT doc_id, i, w.size FROM windows w JOIN bench_grams g ON w.size = g.size AND w.gram = g.gram),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS t FROM hits),
counted AS (SELECT doc_id, count(*) AS n_windows FROM hits GROUP BY 1),
gone AS (SELECT doc_id, count(*) AS n_removed FROM covered GROUP BY 1),
tokens AS (
  SELECT d.doc_id, u.t, d.w[u.t + 1] AS word, d.seps[u.t + 1] AS sep FROM (SELECT * FROM docs SEMI JOIN counted USING (doc_id)) d, unnest(range(len(d.w))) AS u(t)),
flagged AS (SELECT k.*, c.t IS NOT NULL AS cov, lag(c.t IS NOT NULL, 1, FALSE) OVER (PARTITION BY k.doc_id ORDER BY k.t) AS prev FROM tokens k LEFT JOIN covered c ON k.doc_id = c.doc_id AND k.t = c.t),
again AS (
  SELECT doc_id, string_agg(CASE WHEN cov AND prev THEN '' ELSE sep END || CASE WHEN cov THEN '' ELSE word END, '' ORDER BY t) AS body FROM flagged GROUP BY 1),
verdict AS (
  SELECT d.doc_id, coalesce(n_windows, 0) AS n_windows, coalesce(n_removed, 0) AS n_removed, coalesce(len(d.w), 0) AS n_words,
    CASE WHEN n_removed IS NULL THEN d.text ELSE a.body || d.seps[-1] END AS text,
    CASE WHEN n_removed IS NULL THEN 'keep' WHEN n_removed >= {drop_share} * len(d.w) THEN 'drop' ELSE 'trim' END AS action
  FROM docs d LEFT JOIN counted c ON d.doc_id = c.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id LEFT JOIN again a ON d.doc_id = a.doc_id)
SELECT doc_id, action, n_windows, n_removed, n_words, CASE WHEN action <> 'drop' THEN text END AS text FROM verdict"""
