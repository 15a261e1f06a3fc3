"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over them, and the filters' outputs are
max-pooled over overlapping chunks that cover the whole document.  The largest
and the mean value of each filter over the chunks give one probability.  The
network is trained here on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, id_type, steps

#: Labelled rows of each class that the network is trained on, at most; those with the smallest hashes of their ids.
FIT_ROWS = 800
EPOCHS, BATCH, RATE, SEED = 8, 32, 0.01, 7
#: Documents with a lower probability of being good are rejected.
THRESHOLD = 0.5

WIDTH, STRIDE, DIM, FILTERS = 8, 2, 8, 24
#: Filter positions in half a chunk; chunks overlap by half.
HALF = 64
_ALIGN = STRIDE * HALF
_BLOCK = 8192


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIM; byte 0 is padding and stays zero
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1: weights of largest and mean, and the constant

    @classmethod
    def start(cls, rng: np.random.Generator) -> Network:
        embed = rng.normal(0, 0.5, (256, DIM)).astype(np.float32)
        embed[0] = 0
        filters = rng.normal(0, 1 / np.sqrt(WIDTH * DIM * 0.25), (WIDTH * DIM, FILTERS)).astype(np.float32)
        return cls(embed, filters, np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS + 1).astype(np.float32))


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with each row padded to whole half chunks; each row's first half chunk (n + 1 values) and its positions."""
    data, offsets = flat(texts)
    size = np.diff(offsets)
    halves = (size + _ALIGN - 1) // _ALIGN
    first = np.r_[0, np.cumsum(halves)]
    out = np.zeros(int(first[-1]) * _ALIGN + WIDTH, np.uint8)
    out[np.arange(len(data)) + np.repeat(first[:-1] * _ALIGN - offsets[:-1], size)] = data
    return out, first, (size + STRIDE - 1) // STRIDE


def windows(net: Network, data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The embedded bytes below filter positions, a row each."""
    if isinstance(at, slice):
        x = net.embed[data[at.start * STRIDE : at.stop * STRIDE + WIDTH]]
        n = at.stop - at.start
        return np.lib.stride_tricks.as_strided(x, (n, WIDTH * DIM), (STRIDE * DIM * 4, 4)).copy()
    return net.embed[data[(at * STRIDE)[:, None] + np.arange(WIDTH)]].reshape(len(at), -1)


def half_maxima(net: Network, data: np.ndarray, first: np.ndarray, positions: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest output of each filter in each half chunk and, if wanted, its position."""
    n = int(first[-1])
    best = np.empty((n, FILTERS), np.float32)
    at = np.empty((n, FILTERS), np.int64) if where else None
    # positions behind the end of a row don't count
    valid = np.full(n, HALF, np.int64)
    rows = np.flatnonzero(positions)
    valid[first[rows + 1] - 1] = positions[rows] - (first[rows + 1] - 1 - first[rows]) * HALF
    step = _BLOCK // HALF
    for a in range(0, n, step):
        b = min(n, a + step)
        y = (windows(net, data, slice(a * HALF, b * HALF)) @ net.filters).reshape(b - a, HALF, FILTERS)
        for h in np.flatnonzero(valid[a:b] < HALF).tolist():
            y[h, valid[a + h] :] = -np.inf
        if where:
            pick = y.argmax(1)
            at[a:b] = pick + np.arange(a, b)[:, None] * HALF
            best[a:b] = np.take_along_axis(y, pick[:, None], 1)[:, 0]
        else:
            y.max(1, out=best[a:b])
    return np.maximum(best + net.bias, 0), at


def chunk_maxima(best: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Chunk i is half chunks i and i + 1; the last of a row is its last half chunk."""
    out = best.copy()
    if len(best) > 1:
        inner = np.ones(len(best) - 1, bool)
        ends = first[1:-1]
        inner[ends[(ends > 0) & (ends < len(best))] - 1] = False
        np.maximum(out[:-1], np.where(inner[:, None], best[1:], 0), out=out[:-1])
    return out


def features(chunks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest and mean of each filter over a row's chunks; zeros for a row without bytes."""
    n = len(first) - 1
    out = np.zeros((n, 2 * FILTERS + 1), np.float32)
    out[:, -1] = 1
    rows = np.flatnonzero(np.diff(first))
    if len(rows):
        out[rows, :FILTERS] = np.maximum.reduceat(chunks, first[rows], axis=0)
        out[rows, FILTERS:-1] = np.add.reduceat(chunks, first[rows], axis=0) / np.diff(first)[rows, None]
    return out


def probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """The probability that each text is good; 0 for a null or empty one."""
    data, first, positions = padded(texts)
    x = features(chunk_maxima(half_maxima(net, data, first, positions)[0], first), first)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out, -30, 30).astype(np.float64)))
    return np.where(positions > 0, p, 0.0)


def _gradients(net: Network, texts: pa.Array, good: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    data, first, positions = padded(texts)
    half, at = half_maxima(net, data, first, positions, True)
    chunks = chunk_maxima(half, first)
    x = features(chunks, first)
    p = 1 / (1 + np.exp(-np.clip(x @ net.out, -30, 30)))
    loss = -float((weight * np.where(good, np.log(p + 1e-9), np.log(1 - p + 1e-9))).sum())
    d = (weight * (p - good)).astype(np.float32)
    g_out = x.T @ d
    row = np.repeat(np.arange(len(good)), np.diff(first))
    # to each chunk's value: by the mean, and by the maximum where it is the largest
    g = d[row, None] * net.out[FILTERS:-1] / np.diff(first)[row, None]
    top = chunks == x[row, :FILTERS]
    top &= np.cumsum(top, 0) - np.cumsum(top, 0)[first[row]] + top[first[row]] == 1
    g = g + np.where(top, d[row, None] * net.out[:FILTERS], 0)
    # from chunks to the half chunk that holds the largest value
    use_next = np.zeros_like(top)
    use_next[:-1] = (chunks[:-1] > half[:-1])
    to_half = np.where(use_next, 0, g)
    to_half[1:] += np.where(use_next[:-1], g[:-1], 0)
    to_half[half <= 0] = 0
    g_bias = to_half.sum(0)
    h, f = np.nonzero(to_half)
    value, place = to_half[h, f], at[h, f]
    x_at = windows(net, data, place)
    g_filters = np.zeros_like(net.filters)
    order = np.argsort(f, kind="stable")
    cuts = np.searchsorted(f[order], np.arange(FILTERS + 1))
    for k in range(FILTERS):
        i = order[cuts[k] : cuts[k + 1]]
        g_filters[:, k] = value[i] @ x_at[i]
    g_x = (value[:, None] * net.filters.T[f]).reshape(-1, DIM)
    byte = data[(place * STRIDE)[:, None] + np.arange(WIDTH)].ravel()
    g_embed = np.stack([np.bincount(byte, g_x[:, j], 256) for j in range(DIM)], 1).astype(np.float32)
    g_embed[0] = 0
    return loss, [g_embed, g_filters, g_bias.astype(np.float32), g_out]


def train(texts: list[str], good: list[bool], prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted to the texts with Adam; classes are weighted to the share ``prior`` of good ones."""
    rng = np.random.default_rng(seed)
    net = Network.start(rng)
    y = np.array(good, bool)
    weight = np.where(y, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    column = pa.array(texts, pa.large_string())
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.embed, net.filters, net.bias, net.out)]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            _, grads = _gradients(net, column.take(pa.array(pick)), y[pick], weight[pick] / len(pick))
            t += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, (m, v) in zip((net.embed, net.filters, net.bias, net.out), grads, state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Network | None:
    """A network from labelled documents, at most ``rows`` of each class; None if a class has none.

    Of an identifier with several labels the smallest counts, and of several
    texts the smallest.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    share = known.agg(F.avg(F.col("good").cast("double"))).first()[0]
    chosen = [r for good in (True, False) for r in known.where(F.col("good") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]
    if len({r.good for r in chosen}) < 2:
        return None
    small = docs.sparkSession.createDataFrame(chosen, f"doc_id {id_type(labels)}, good boolean")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("length(text) > 0").join(F.broadcast(small), "doc_id")  # at most 2 * rows
    got = sorted(tuple(r) for r in found.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select("doc_id", "text", "good").collect())
    if len({g for _, _, g in got}) < 2:
        return None
    return train([t for _, t, _ in got], [g for _, _, g in got], share)


def classify(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, probability, keep`` for each row.

    A null or empty text has probability 0 and is rejected.  Without a network
    (no labelled rows of both classes) all other texts have probability 1.  A
    probability equal to ``threshold`` is kept.  An empty table gives an empty
    result.  ``doc_id`` may have any type.  Every input row gives one output row and repeated rows repeat; a null
    ``doc_id`` stays null; texts are read whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 19):
            p = _scores(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "probability", "keep"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, probability double, keep boolean")


def _scores(net: Network | None, texts: pa.Array) -> np.ndarray:
    if net is None:
        return pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    return probabilities(net, texts)


def good_documents(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; rules as in ``classify``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", 1 << 19):
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
