"""SimHash near-dedup with an LSH forest.

A text's features are its words and pairs of neighbouring words, each once.
Every feature votes on the bits of a 128-bit SimHash.  The forest has several
tries, each over its own random order of the bits.  Texts that share a trie's
first bits, about log2(n / ``WINDOW``) of n texts, are a bucket, and all pairs
of a bucket are compared, however large it is: one of more than ``BIG`` texts
is cut into blocks, and each pair of blocks is compared in a group of its own.
There are as many tries as make a pair at the largest distance that counts
share a bucket with the target recall; closer pairs do so more often.

So that dense texts need not be expanded into all their pairs, a first pass
compares each text with its ``NEAR`` neighbours in the sorted order of a few
tries and links what it finds into classes.  It decides nothing else: the
buckets are then searched for all pairs between different classes.

Pairs that meet are verified by their whole distance and then by the share of
features in common, estimated from a sketch of each text's smallest feature
hashes; groups are the connected components of verified pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    BASE,
    discard,
    flat,
    id_type,
    lowered,
    materialise,
    splitmix,
    steps,
    word_hashes,
    word_spans,
)

BITS = 128
#: Texts whose SimHashes differ in at most so many bits are near copies.
RADIUS = 24
RECALL = 0.99
#: Smallest feature hashes kept of each text, and the least share of features in common (Jaccard) by them.
SKETCH, LEAST_SHARED = 64, 0.5
#: Texts in a bucket, if they are spread evenly; sets the depth of the tries and bounds nothing.
WINDOW = 2048
#: Texts of a bucket that one group compares; larger buckets are cut into blocks of about so many.
BIG = 1 << 15
#: The first pass: neighbours on each side in a trie's order, and tries.
NEAR, NEAR_TRIES = 256, 6
#: Rows and columns that are compared at once in a bucket.
TILE = 64, 2048
#: A trie is cut into parts of about 2^PART windows, which are sorted apart.
PART = 4
#: Rows of a part that are compared at once.
CHUNK = 1 << 16
SEED = 11


def meet(distance: int, depth: int) -> float:
    """The chance that two texts at a distance share ``depth`` bits of a random order."""
    return math.prod((BITS - distance - i) / (BITS - i) for i in range(depth)) if depth <= BITS - distance else 0.0


def shape(n: int, radius: int = RADIUS, recall: float = RECALL, window: int = WINDOW) -> tuple[int, int]:
    """Depth that a window reaches among n texts, and the tries that give the recall at the radius with it."""
    depth = min(64, max(0, math.ceil(math.log2(max(n, 1) / window))))
    once = meet(radius, depth)
    return depth, 1 if once >= recall else math.ceil(math.log(1 - recall) / math.log1p(-once))


def simhashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Two 64-bit halves for each row, its number of features, and its sketch; zeros without any."""
    data, offsets = lowered(texts)
    starts, ends, firsts = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(firsts))
    pairs = splitmix(words[:-1] * np.uint64(BASE) + words[1:])[row[:-1] == row[1:]] if len(words) else words
    pair_row = row[:-1][row[:-1] == row[1:]]
    # the row in the upper bits, so that one sort finds repeats; 48 bits of the hash are left
    low = np.uint64((1 << 48) - 1)
    feature = np.concatenate([(row << np.uint64(48)) | (words & low), (pair_row << np.uint64(48)) | (pairs & low)])
    feature.sort()
    feature = feature[np.r_[True, feature[1:] != feature[:-1]]] if len(feature) else feature
    of = np.searchsorted(feature, np.arange(n + 1, dtype=np.uint64) << np.uint64(48))
    count = np.diff(of)
    a = splitmix(feature & low)
    halves = np.stack([a, splitmix(a)], 1)
    out = np.zeros((n, 2), np.uint64)
    for i in np.flatnonzero(count).tolist():
        votes = np.zeros(BITS, np.int64)
        for at in range(of[i], of[i + 1], 4096):
            bits = np.unpackbits(halves[at : min(at + 4096, of[i + 1])].view(np.uint8), axis=1)
            votes += bits.sum(0, dtype=np.uint16)
        out[i] = np.packbits(votes * 2 > count[i]).view(np.uint64)
    top = (feature >> np.uint64(16)).astype(np.uint32)
    return out, count, [top[a : min(a + SKETCH, b)].tobytes() for a, b in zip(of[:-1].tolist(), of[1:].tolist())]


def shared_features(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The estimated Jaccard similarity of each pair of sketches: of the smallest features of both, those in both."""
    none = 1 << 32
    both = np.full((len(a), 2 * SKETCH), none, np.int64)
    for sketches, at in ((a, 0), (b, SKETCH)):
        data, offsets = flat(sketches)
        count = np.diff(offsets) // 4
        row = np.repeat(np.arange(len(count)), count)
        both[row, at + np.arange(len(row)) - np.repeat(offsets[:-1] // 4, count)] = data.view(np.uint32)
    both.sort(axis=1)
    known = both < none
    again = np.zeros_like(known)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & known[:, 1:]
    rank = np.cumsum(known & ~again, axis=1)
    shared = (again & (rank <= SKETCH)).sum(1)
    return shared / np.maximum(np.minimum(rank[:, -1], SKETCH), 1)


def permuted(sims: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Each SimHash with its bits in another order, as two halves."""
    bits = np.unpackbits(np.ascontiguousarray(sims).view(np.uint8), axis=1)
    return np.packbits(np.take(bits, order, axis=1), axis=1).view(">u8").astype(np.uint64)


def orders(tries: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(BITS) for _ in range(tries)])


def linked(first: np.ndarray, rest: np.ndarray, group: np.ndarray, fresh: int = 0, radius: int = RADIUS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) within the radius and the window that connect what all such pairs connect, and each one's nearest.

    Rows are in a trie's order: two halves of the SimHash, and the part of the
    trie, over whose ends no pair goes.  Pairs of rows before ``fresh`` are left out.
    """
    n = len(first)
    parent = np.arange(n)
    nearest, mate = np.full(n, BITS + 1, np.int16), np.full(n, -1)
    edges: list[tuple[int, int]] = []
    differ, bits, more = np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, np.uint8)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    for k in range(1, min(window, n - 1) + 1):
        for half, count in ((rest, bits), (first, more)):
            np.bitwise_xor(half[k:], half[:-k], out=differ[: n - k])
            np.bitwise_count(differ[: n - k], out=count[: n - k])
        bits += more
        i = np.flatnonzero(bits[: n - k] <= radius)
        i = i[(i + k >= fresh) & (group[i] == group[i + k])]
        if not len(i):
            continue
        d = bits[i].astype(np.int16)
        for one, other in ((i, i + k), (i + k, i)):
            closer = d < nearest[one]
            nearest[one[closer]], mate[one[closer]] = d[closer], other[closer]
        i = i[parent[i] != parent[i + k]]
        for a in i.tolist():
            x, y = find(a), find(a + k)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, a + k))
        if len(i) > 16:
            while not np.array_equal(up := parent[parent], parent):
                parent = up
    with_mate = np.flatnonzero(mate >= 0)
    found = np.array(edges, np.int64).reshape(-1, 2)
    return np.r_[found[:, 0], with_mate], np.r_[found[:, 1], mate[with_mate]]


def _slim(docs: DataFrame) -> DataFrame:
    """Rows with a text: id, key of the text and its 64-bit hash, SimHash, number of features, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 19):
            for at in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(at, 1 << 15)
                sims, count, sketches = simhashes(part.column("text"))
                made = {"hi": sims[:, 0].view(np.int64), "lo": sims[:, 1].view(np.int64), "n_features": count.astype(np.int32)}
                columns = {c: part.column(c) for c in ("doc_id", "key", "id")} | {c: pa.array(x) for c, x in made.items()}
                columns["sketch"] = pa.array(sketches, pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    text, key = F.col("text").cast("string"), F.unhex(F.md5(F.col("text").cast("string")))
    rows = docs.where(text.isNotNull()).select("doc_id", key.alias("key"), F.xxhash64(key).alias("id"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, key binary, id bigint, hi bigint, lo bigint, n_features int, sketch binary")


def neighbours(nodes: DataFrame, depth: int, order: np.ndarray, radius: int, window: int) -> DataFrame:
    """``a, b``: pairs of ids within the radius that stand within the window in a trie's sorted order, as ``linked`` picks them."""
    tries = len(order)
    part_bits = max(0, depth - PART)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                sims = np.stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()], 1).view(np.uint64)
                for trie in range(tries):
                    keys = permuted(sims, order[trie])
                    top = (keys[:, 0] >> np.uint64(64 - part_bits)) if part_bits else np.zeros(len(keys), np.uint64)
                    part = (top.astype(np.int64) * tries) + trie
                    # signed order is that of the bits when the highest one is turned
                    at_ = (keys[:, 0] ^ np.uint64(1 << 63)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part), pa.array(at_), pa.array(keys[:, 1].copy().view(np.int64)), batch.column("id")],
                        ["part", "at", "rest", "id"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(chunk: np.ndarray, fresh: int) -> pa.RecordBatch:
            first, rest = chunk[1].view(np.uint64) ^ np.uint64(1 << 63), chunk[2].view(np.uint64)
            i, j = linked(first, rest, chunk[0], fresh, radius, window)
            a, b = chunk[3][i], chunk[3][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held, size, carried = [], 0, 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("part", "at", "rest", "id")]))
            size += batch.num_rows
            if size - carried >= CHUNK:
                chunk = np.concatenate(held, axis=1)
                yield edges(chunk, carried)
                held = [chunk[:, -window:].copy()]
                size = carried = held[0].shape[1]
        if size > carried:
            yield edges(np.concatenate(held, axis=1), carried)

    planted = nodes.select("hi", "lo", "id").mapInArrow(plant, "part bigint, at bigint, rest bigint, id bigint")
    ordered = planted.repartition("part").sortWithinPartitions("part", "at", "rest", "id")
    return ordered.mapInArrow(compare, "a bigint, b bigint").distinct()


def apart(sims: np.ndarray, of: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) within the radius whose classes ``of`` differ; where ``side`` isn't 0, those of sides 1 and 2."""
    order = np.lexsort((of, side))
    first, rest, kind = sims[order, 0], sims[order, 1], of[order]
    n, cross = len(order), bool(side[order[-1]])
    split = int(np.searchsorted(side[order], 2)) if cross else n
    # a row's columns start behind its class, or are all of the other side
    begin = np.full(n, split) if cross else np.searchsorted(kind, kind, side="right")
    rows, columns = TILE
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a in range(0, split, rows):
        b = min(a + rows, split)
        for c in range(int(begin[a]), n, columns):
            d = min(c + columns, n)
            if cross and kind[a] == kind[b - 1] == kind[c] == kind[d - 1]:
                continue
            some = np.flatnonzero(np.bitwise_count(first[a:b, None] ^ first[c:d]) <= radius)
            i, j = a + some // (d - c), c + some % (d - c)
            ok = (kind[i] != kind[j]) & (j >= begin[i])
            i, j = i[ok], j[ok]
            near = np.bitwise_count(first[i] ^ first[j]) + np.bitwise_count(rest[i] ^ rest[j]) <= radius
            if near.any():
                found.append((order[i[near]], order[j[near]]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _grouped(batches: Iterator[pa.RecordBatch], columns: list[str], by: int) -> Iterator[np.ndarray]:
    """The rows of each group, as columns of an array; rows of a group, by the first ``by`` columns, follow each other."""
    held: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(c).to_numpy() for c in columns])
        cuts = np.flatnonzero((now[:by, 1:] != now[:by, :-1]).any(0)) + 1
        if held and (held[-1][:by, -1] != now[:by, 0]).any():
            yield np.concatenate(held, axis=1)
            held = []
        for part in np.split(now, cuts, axis=1)[: len(cuts)]:
            yield np.concatenate([*held, part], axis=1)
            held = []
        held.append(now[:, cuts[-1] if len(cuts) else 0 :].copy())
    if held:
        yield np.concatenate(held, axis=1)


def bucket_pairs(nodes: DataFrame, depth: int, order: np.ndarray, radius: int = RADIUS, big: int = BIG) -> DataFrame:
    """``a, b``: all pairs of ids of different ``class`` within the radius that share a bucket; each pair once.

    A pair is given in the first trie in which it shares a bucket.  Of the
    buckets only the large ones are told to the driver, at most a row for each
    ``big`` rows of the tries.
    """
    tries = len(order)
    ahead = order[:, :depth]
    masks = np.zeros((tries, BITS), np.uint8)
    np.put_along_axis(masks, ahead, 1, axis=1)
    masks = np.packbits(masks, axis=1).view(np.uint64)
    weight = np.int64(1) << np.arange(depth, dtype=np.int64)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                sims = np.stack([batch.column("hi").to_numpy(), batch.column("lo").to_numpy()], 1)
                bits = np.unpackbits(sims.view(np.uint8), axis=1)
                for trie in range(tries):
                    yield batch, bits[:, ahead[trie]].astype(np.int64) @ weight * tries + trie

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in buckets(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(part, return_counts=True)], ["part", "n"])

    sizes = nodes.select("hi", "lo").mapInArrow(count, "part bigint, n bigint").groupBy("part").agg(F.sum("n").alias("n"))
    large = sorted(tuple(r) for r in sizes.where(F.col("n") > big).collect())
    cut = np.array([p for p, _ in large], np.int64)
    into = np.array([-(-n // big) for _, n in large] + [1], np.int64)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, part: np.ndarray, cell: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
            made = [pa.array(part), pa.array(cell), pa.array(side)]
            return pa.RecordBatch.from_arrays(made + [batch.column(c) for c in ("hi", "lo", "id", "class")], ["part", "cell", "side", "hi", "lo", "id", "class"])

        for batch, part in buckets(batches):
            none = np.zeros(len(part), np.int64)
            if not len(cut):
                yield rows(batch, part, none, none)
                continue
            at = np.searchsorted(cut, part)
            at[cut[np.minimum(at, len(cut) - 1)] != part] = len(cut)
            n = into[at]
            mine = (splitmix(batch.column("id").to_numpy().view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
            for other in range(int(n.max())):
                take = np.flatnonzero(other < n)
                low, high = np.minimum(mine[take], other), np.maximum(mine[take], other)
                side = np.where(low == high, 0, np.where(mine[take] == low, 1, 2))
                yield rows(batch.take(pa.array(take)), part[take], low * n[take] + high, side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["part", "cell", "side", "hi", "lo", "id", "class"], 2):
            sims = np.ascontiguousarray(group[3:5].T).view(np.uint64)
            i, j = apart(sims, group[6], group[2], radius)
            if not len(i):
                continue
            differ, new = sims[i] ^ sims[j], np.ones(len(i), bool)
            for trie in range(int(group[0, 0] % tries)):
                new &= (differ & masks[trie]).any(1)
            a, b = group[5, i[new]], group[5, j[new]]
            for at in range(0, len(a), 1 << 16):
                x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    planted = nodes.select("hi", "lo", "id", "class").mapInArrow(plant, "part bigint, cell bigint, side bigint, hi bigint, lo bigint, id bigint, class bigint")
    return planted.repartition("part", "cell").sortWithinPartitions("part", "cell").mapInArrow(compare, "a bigint, b bigint")


def near_edges(nodes: DataFrame, n: int, radius: int = RADIUS, recall: float = RECALL, window: int = WINDOW, big: int = BIG) -> DataFrame:
    """``a, b``: pairs of keys that connect all texts that the forest finds within the radius and verifies.

    A row of a trie has the SimHash and a 64-bit hash of the text's key; should
    two texts have the same, both are verified.
    """
    depth, tries = shape(n, radius, recall, window)
    order = orders(tries)
    classes = materialise(components(verified(neighbours(nodes, depth, order[:NEAR_TRIES], radius, min(window, NEAR)), nodes)))
    of = classes.select("key", F.xxhash64("root").alias("class"))
    known = nodes.join(of, "key", "left").select("id", "hi", "lo", F.coalesce("class", "id").alias("class"))
    more = verified(bucket_pairs(materialise(known), depth, order, radius, big), nodes)
    return classes.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").unionByName(more)


def verified(pairs: DataFrame, nodes: DataFrame, least: float = LEAST_SHARED) -> DataFrame:
    """``a, b``: keys of the pairs of ids whose texts share enough features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                keep = shared_features(batch.column("sa"), batch.column("sb")) >= least
                yield batch.filter(pa.array(keep)).select(["a", "b"])

    one, two = (nodes.select(F.col("id").alias(f"{k}_id"), F.col("key").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab")
    both = pairs.withColumnsRenamed({"a": "a_id", "b": "b_id"}).join(one, "a_id").join(two, "b_id").where("a <> b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``key, root``: each key's smallest connected key, for keys with an edge; by alternating large and small stars."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(least, F.col("u") == F.col("w"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct())
        discard(before)
        discard(large)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("root"))
        last = now


def _groups(docs: DataFrame, radius: int, recall: float) -> DataFrame:
    """Distinct (doc_id, key) with ``n`` rows each, their group's root, and ``first`` for the one that stays."""
    slim = materialise(_slim(docs))
    with_words = slim.where("n_features > 0")
    n = with_words.agg(F.approx_count_distinct("id", 0.02)).first()[0]
    # sent by id once: the tries are planted from it, and both sides of the pairs find it in place
    told = [F.first(c).alias(c) for c in ("hi", "lo", "sketch")]
    nodes = with_words.repartition("id").groupBy("id", "key").agg(*told)
    comp = components(near_edges(nodes, n, radius, recall))
    rows = slim.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rooted = materialise(rows.join(comp, "key", "left").withColumn("root", F.coalesce("root", "key")))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    best = rooted.groupBy("root").agg(F.min(place).alias("best"), F.sum("n").alias("group_size"))
    return rooted.join(best, "root").withColumn("first", place == F.col("best"))


def group_documents(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """The group of each document: ``doc_id, group_id, group_size, keep``.

    ``group_id`` is the smallest ``doc_id`` of the group, of whatever type that
    is, and the row that has it is kept; nulls are larger than others, and of
    rows that agree in that the one with the smaller md5 of its text.  Of
    repeated rows (equal ``doc_id`` and text) one is kept.  Equal texts are
    always in one group.  Texts without words are compared for equality only.
    A null text is in no group: its row is kept and stands for itself.  An empty
    table gives an empty result; other columns are not read.  Every distinct
    text is looked for in all tries.
    """
    rows = _groups(docs, radius, recall)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
    first = (F.col("first") & (F.col("copy") == 1)).alias("keep")
    out = copies.select("doc_id", F.col("best.doc_id").alias("group_id"), "group_size", first)
    one = F.lit(1).cast("bigint").alias("group_size")
    alone = docs.where("text IS NULL").select("doc_id", F.col("doc_id").alias("group_id"), one, F.lit(True).alias("keep"))
    return out.unionByName(alone)


def one_of_each(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """One document of each group, with the columns of ``docs`` whatever they are called; rules as in ``group_documents``.

    Of repeated rows that differ in other columns the first in their order
    stays; arrays, maps, structs and binary columns are compared by a hash.
    """
    # no key is null, so that the join and the window below need one exchange of the texts between them
    known = lambda c: [F.coalesce(F.col(c).cast("string"), F.lit("")).alias("id_"), F.col(c).isNull().alias("no_id")]
    keep = materialise(_groups(docs, radius, recall).where("first").select("key", *known("doc_id")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType)

    def place(field: T.StructField):
        column = F.col(f"row.`{field.name}`")
        return column if isinstance(field.dataType, plain) else F.xxhash64(F.to_json(F.struct(column)))

    others = [place(f) for f in docs.schema if f.name not in ("doc_id", "text")]
    key = F.unhex(F.md5(F.col("text").cast("string")))
    keyed = docs.where("text IS NOT NULL").select(whole, key.alias("key"), *known("doc_id"))
    order = Window.partitionBy("key", "id_", "no_id").orderBy(*others, F.lit(0))
    joined = keyed.join(keep, ["key", "id_", "no_id"], "left_semi").withColumn("nth", F.row_number().over(order))
    return joined.where("nth = 1").select("row.*").unionByName(docs.where("text IS NULL"))
