"""Token-ID output as sorted-string-table shards.

A shard holds documents in order of their identifier::

    blocks | Bloom filter | block index | footer

A block has about ``BLOCK_BYTES`` of entries; each entry stores how many bytes
its key shares with the one before it, the rest of the key, and the token ids
as little-endian numbers of 16 bits, or 32 where the vocabulary needs them.  The index has the first key and the offset of
each block, and the footer says where filter and index are.  A key is found by
asking the filter, a binary search of the index, and reading one block.

The key of a document is its identifier: a number as 8 big-endian bytes with
the sign bit turned, so that byte order is numeric order, and a string as the
byte 1 and its UTF-8 bytes.  A null identifier is the empty key, which comes
first.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, splitmix, steps
from .tokens import Encoder, default_vocabulary

MAGIC = b"FFSSTAB2"
#: Filter at, its bytes; index at, its bytes; entries, tokens; crc of what is before; bytes of an id, whether keys are strings; magic.
_FOOTER = struct.Struct("<QQQQQQIBB8s")
BLOCK_BYTES = 16 << 10
SHARD_BYTES = 8 << 20
#: Ranges of identifiers that are sorted apart, at most; a range has as many shards as its bytes need.
RANGES = 10_000
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | str | None) -> bytes:
    if doc_id is None:
        return b""
    if isinstance(doc_id, str):
        return b"\x01" + doc_id.encode("utf-8", "surrogatepass")
    return (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes, named: bool = False) -> int | str | None:
    if not key:
        return None
    return key[1:].decode("utf-8", "surrogatepass") if named else int.from_bytes(key, "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    """The bits of each key: ``PROBES`` a row."""
    if not keys:
        return np.zeros((0, PROBES), np.uint64)
    short = (k if len(k) <= 8 else hashlib.blake2b(k, digest_size=8).digest() for k in keys)
    value = np.array([int.from_bytes(k, "big") for k in short], np.uint64)
    length = np.array([len(k) for k in keys], np.uint64)
    a = splitmix(value ^ (length << np.uint64(56)))
    b = splitmix(a) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


def build(entries: Iterable[tuple[bytes, bytes]], block_bytes: int = BLOCK_BYTES, width: int = 2, named: bool = False) -> bytes:
    """A shard of (key, ids as bytes) in order of keys; keys may repeat.  ``width`` is the bytes of an id."""
    out, index, block, keys, tokens = bytearray(), [], bytearray(), [], 0
    last = b""
    for key, value in entries:
        if block and len(block) + len(value) > block_bytes:
            out += block
            block = bytearray()
        if not block:
            index.append((key, len(out)))
            shared = 0
        else:
            most = min(len(key), len(last))
            shared = next((i for i in range(most) if key[i] != last[i]), most)
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        last = key
        keys.append(key)
        tokens += len(value) // width
    out += block
    bits = max(64, (BITS_PER_KEY * len(keys) + 63) // 64 * 64)
    table = np.zeros(bits, np.uint8)
    table[_probes(keys, bits).ravel().astype(np.int64)] = 1
    bloom = np.packbits(table, bitorder="little").tobytes()
    at = len(out)
    out += bloom
    index_at = len(out)
    for key, offset in index:
        out += _varint(len(key)) + key + _varint(offset)
    body = bytes(out)
    return body + _FOOTER.pack(at, len(bloom), index_at, len(body) - index_at, len(keys), tokens, zlib.crc32(body), width, named, MAGIC)


class Shard:
    """Reads a shard by ranges of bytes: footer, filter and index at first, then a block for each key asked for."""

    def __init__(self, data: bytes | memoryview | None = None, check: bool = False, read: Callable[[int, int], bytes] | None = None, size: int = 0) -> None:
        if data is not None:
            view = memoryview(data).cast("B")
            read, size = lambda at, n: view[at : at + n], len(view)
        self.read = read
        footer = self.read(size - _FOOTER.size, _FOOTER.size) if size >= _FOOTER.size else b"".ljust(_FOOTER.size)
        self.bloom_at, bloom_size, at, index_size, self.n_entries, self.n_tokens, crc, self.width, self.named, magic = _FOOTER.unpack(footer)
        if magic != MAGIC or check and zlib.crc32(self.read(0, size - _FOOTER.size)) != crc:
            raise ValueError("not a shard, or damaged")
        # filter and index are next to each other
        both = self.read(self.bloom_at, at + index_size - self.bloom_at)
        self.bloom, index = both[:bloom_size], both[at - self.bloom_at :]
        self.firsts, self.offsets, at = [], [], 0
        while at < index_size:
            n, at = _read_varint(index, at)
            self.firsts.append(bytes(index[at : at + n]))
            offset, at = _read_varint(index, at + n)
            self.offsets.append(offset)
        self.offsets.append(self.bloom_at)

    def may_have(self, key: bytes) -> bool:
        return all(self.bloom[int(b) // 8] >> (int(b) % 8) & 1 for b in _probes([key], len(self.bloom) * 8)[0])

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.read(self.offsets[i], self.offsets[i + 1] - self.offsets[i]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            yield key, np.frombuffer(data[at : at + size], f"<u{self.width}")
            at += size

    def get(self, doc_id: int | str | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier, none if it isn't here."""
        key = key_of(doc_id)
        if not self.firsts or not self.may_have(key):
            return []
        found, i = [], max(0, bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [ids for k, ids in self.block(i) if k == key]
            i += 1
        return found

    def __iter__(self) -> Iterator[tuple[int | str | None, np.ndarray]]:
        for i in range(len(self.firsts)):
            for key, ids in self.block(i):
                yield id_of(key, self.named), ids


class ShardFile(Shard):
    """A shard in a file, local or of any store that pyarrow reaches by its URI; only the ranges that are needed are read."""

    def __init__(self, path: str, check: bool = False) -> None:
        store, inner = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        self.file, self.bytes_read = store.open_input_file(inner), 0
        super().__init__(check=check, read=self._read, size=self.file.size())

    def _read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, at)


def _ranges(docs: DataFrame, shard_bytes: int) -> int:
    """Into how many ranges of identifiers the documents go: a shard's bytes each, and at most ``RANGES``."""
    row = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))), F.count("doc_id")).first()
    # a byte of text is taken for 0.7 bytes of ids
    return 1 + min(RANGES, int((row[0] or 0) * 0.7 // shard_bytes)) if row[1] else 1


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Upper ends of n ranges of numbers, all but the last, with about as many documents each."""
    if n < 2:
        return []
    shares = F.array(*[F.lit(i / n) for i in range(1, n)])
    return sorted(set(docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 20 * n)))).first()[0] or []))


def token_shards(docs: DataFrame, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Shards of all documents: ``shard, first_id, last_id, n_entries, n_tokens, n_bytes, data``.

    ``shard`` numbers them in order of identifiers: shards' ranges don't
    overlap, but for an identifier that repeats over a cut.  A range that turns
    out larger than 1.5 * ``shard_bytes`` is cut there; a single longer document
    is not cut.

    Every row is an entry, repeated rows too, those of one identifier in order
    of their ids.  Identifiers are whole numbers, or else are taken as strings.
    A null identifier has the empty key, before all others.  A null or empty
    text has no tokens.  An empty table gives no shards.  Whole texts are
    encoded, once for numbers; only ids are shuffled, to ranges of the
    identifier found beforehand, and sorted there.  For strings Spark samples
    the ranges itself, which encodes the texts twice.  A vocabulary of more than
    65,536 ids has 32-bit ids.  Columns other than ``doc_id`` and ``text`` are
    not read, whatever they are called.
    """
    path = vocabulary or default_vocabulary()
    named = not isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    kind = "string" if named else "bigint"
    slim = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = _ranges(slim, shard_bytes)
    bounds = np.array([] if named else _bounds(slim, n), np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    width = Encoder(path).kind.itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ends = Encoder(path), shared.value
        for batch in steps(batches, "text", 1 << 19):
            ids, counts = encoder(batch.column("text"))
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts * width, out=offsets[1:])
            values = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids))])
            part = np.zeros(len(counts), np.int32)
            if not named:
                part[:] = np.searchsorted(ends, batch.column("doc_id").fill_null(-(1 << 63)).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("doc_id"), values], ["part", "doc_id", "ids"])

    id_kind = pa.string() if named else pa.int64()
    counted = [(c, pa.int64()) for c in ("n_entries", "n_tokens", "n_bytes")]
    schema = pa.schema([("shard", pa.int64()), ("first_id", id_kind), ("last_id", id_kind), *counted, ("data", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, number = [], 0, None, 0

        def shard() -> pa.RecordBatch:
            data = build(held, block_bytes, width, named)
            row = {"shard": (part << 24) + number, "first_id": id_of(held[0][0], named), "last_id": id_of(held[-1][0], named)}
            row |= {"n_entries": len(held), "n_tokens": sum(len(v) for _, v in held) // width, "n_bytes": len(data), "data": data}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for p, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (p != part or size + len(ids) > 1.5 * shard_bytes):
                    yield shard()
                    held, size, number = [], 0, number + 1 if p == part else 0
                part = p
                held.append((key_of(doc_id), ids))
                size += len(ids) + 12
        if held:
            yield shard()

    encoded = slim.mapInArrow(encode, f"part int, doc_id {kind}, ids binary")
    if named:
        ranged = encoded.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    else:
        ranged = encoded.repartitionById(len(bounds) + 1, F.col("part"))
    ordered = ranged.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    return ordered.mapInArrow(write, f"shard bigint, first_id {kind}, last_id {kind}, n_entries bigint, n_tokens bigint, n_bytes bigint, data binary")


def write_shards(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard to a file of its own in a shared folder: ``shard, first_id, last_id, n_entries, n_bytes, path``.

    Files are written under another name first, so that a task that is run
    again leaves whole files only.  No shards give no files.
    """
    schema = shards.schema
    kept = ["shard", "first_id", "last_id", "n_entries", "n_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(inner)
        for batch in batches:
            paths = []
            for number, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                name = f"shard-{number:016x}.sst"
                part = f"{inner}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data.as_buffer())
                store.move(part, f"{inner}/{name}")
                paths.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(paths, pa.string())], [*kept, "path"])

    columns = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in kept)
    return materialise(shards.mapInArrow(run, f"{columns}, path string"))


def lookup(shards: DataFrame, doc_ids: list) -> DataFrame:
    """Entries of the given identifiers: ``doc_id, ids``, from rows of ``token_shards`` or ``write_shards``.

    Shards whose range has none of the identifiers are not read; of a file only
    footer, filter and index, and the blocks that may have one.  Identifiers
    that aren't there, or none at all, give no rows.
    """
    wanted = sorted(set(doc_ids))
    kind = shards.schema["last_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<bigint>"
    if not wanted:
        return shards.sparkSession.createDataFrame([], schema)
    filed = "path" in shards.columns
    id_kind = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0):
                shard = ShardFile(source.as_py()) if filed else Shard(source.as_buffer())
                found = [(i, ids.tolist()) for i in wanted for ids in shard.get(i)]
                columns = [pa.array([i for i, _ in found], id_kind), pa.array([x for _, x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"])

    given = F.array(*[F.lit(i).cast(kind) for i in wanted])
    hit = F.exists(given, lambda i: (F.col("first_id").isNull() | (i >= F.col("first_id"))) & (i <= F.col("last_id")))
    return shards.where(hit).select("path" if filed else "data").mapInArrow(run, schema)
