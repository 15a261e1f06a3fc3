"""Helpers shared by the operators: Arrow batches, word folding, shared storage.

Text is processed in whole Arrow batches as flat UTF-8 buffers.  A *word* is a
maximal run of ASCII letters and digits and of code points from U+00C0 up,
without the general punctuation (U+2000-U+206F) and CJK punctuation
(U+3000-U+303F) blocks; words compare in lower case.  ``WORD_RE`` states the
same as a regular expression for SQL.
"""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[0-9A-Za-z\x{00C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]+"

#: Bytes of text that one vectorised step works on; a longer text is one step.
STEP_BYTES = 1 << 20

#: Bytes of an Arrow batch in a session that says nothing else; by its own default 10,000 texts are held at once, on both sides.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_ASCII_WORD[0x80:] = True


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, and the odd base of the rolling sums with its inverse modulo 2^64.
BYTE_CODES = splitmix(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            self.up, self.down = _powers(BASE, m), _powers(BASE_INVERSE, m)
        return self.up, self.down


_POWERS = Powers()


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the slices [start, end) of uint64 codes."""
    up, down = _POWERS.to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``most`` bytes of ``column``; no row is split.

    After the last one the worker gives free memory back, as it waits for other tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = flat(batch.column(column))
        size = np.diff(offsets)
        part = (np.cumsum(size) - size) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return what the allocators hold but don't use to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let texts go to Python in batches of ``BATCH_BYTES``, or one larger row, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the row offsets of a string column; a null is empty."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    n, at = len(strings), strings.offset
    _, offsets, data = strings.buffers()
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[at : at + n + 1].astype(np.int64)
    if strings.null_count:
        size = np.where(strings.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
        if size.sum() != off[-1] - off[0]:  # bytes behind a null
            filled = strings.fill_null("" if pa.types.is_string(strings.type) or pa.types.is_large_string(strings.type) else b"")
            return flat(pa.concat_arrays([filled]))
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def lowered(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like ``flat``, with the text in lower case."""
    data, offsets = flat(strings)
    if not (data >= 0x80).any():
        return data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5), offsets
    rows = [(t or "").lower().encode("utf-8", "surrogatepass") for t in strings.to_pylist()]
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return np.frombuffer(b"".join(rows), np.uint8), offsets


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a flat buffer, and each row's first word (n + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    w = _ASCII_WORD[data]
    wide = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    if len(wide):
        lead, nxt = data[wide], data[np.minimum(wide + 1, len(data) - 1)]
        third = data[np.minimum(wide + 2, len(data) - 1)]
        two = wide[lead == 0xC2]
        three = wide[((lead == 0xE2) & ((nxt == 0x80) | ((nxt == 0x81) & (third < 0xB0)))) | ((lead == 0xE3) & (nxt == 0x80))]
        for at, n in ((two, 2), (three, 3)):
            for k in range(n):
                w[at + k] = False
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = w[0], w[-1]
    np.not_equal(w[1:], w[:-1], out=edge[1:-1])
    at = np.flatnonzero(edge)
    starts, ends = at[::2], at[1::2]
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(data))])
    split = inner[w[inner] & w[inner - 1]]
    if len(split):
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of a buffer that is in lower case."""
    return splitmix(span_hashes(BYTE_CODES[data], starts, ends)) if len(data) else np.zeros(0, np.uint64)


def words_of(text: str) -> list[str]:
    """The words of one text; the plain form of ``word_spans`` for small inputs."""
    data, offsets = lowered(pa.array([text], pa.string()))
    starts, ends, _ = word_spans(data, offsets)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist())]


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes as ``word_hashes`` gives for these words in a text."""
    rows = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
    starts = ends - np.array([len(r) for r in rows], dtype=np.int64)
    return word_hashes(np.frombuffer(b"".join(rows), np.uint8), starts, ends)


def in_sorted(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted table without repeats, and where it would be."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return table[at] == keys, at


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves a master that runs in this
    process; on a cluster it would lose rows silently, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "folioframe-shared")
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor loses nothing.

    An application's tables are in a folder of its own, which may be deleted
    when it has ended; ``discard`` deletes one that is no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialise`` returned."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of the identifier, which passes through as it is."""
    return docs.schema[column].dataType.simpleString()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(column: str = "text"):
    """A 128-bit key of a text; null for null."""
    return F.unhex(F.md5(F.col(column)))


def pack(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, kind)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices first, first+1, ... of each row, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(firsts - (ends - counts), counts)
