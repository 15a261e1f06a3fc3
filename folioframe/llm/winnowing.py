"""Document fingerprints by winnowing.

The text is lower-cased and reduced to letters and digits; every run of ``k``
kept characters is hashed with a rolling polynomial, and in every window of
``w`` consecutive hashes the smallest is a fingerprint, the rightmost one when
several are equal.  Any passage of at least ``w + k - 1`` kept characters that
two documents share therefore gives them a common fingerprint.

Characters kept are ASCII letters and digits and code points from U+00C0 up,
without U+2000-U+206F and U+3000-U+303F.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, Powers, id_type, list_array, steps

_POWERS = Powers()


def kept(codes: np.ndarray) -> np.ndarray:
    """Which code points take part."""
    ascii_ = ((codes >= 48) & (codes <= 57)) | ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90))
    wide = (codes >= 0xC0) & ~((codes >= 0x2000) & (codes <= 0x206F)) & ~((codes >= 0x3000) & (codes <= 0x303F))
    return ascii_ | wide


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k codes: sum of code[i + j] * BASE^j modulo 2^64."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * up[:n], out=sums[1:])
    return (sums[k:] - sums[:-k]) * down[: n - k + 1]


def window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each window of w, each once, in order.

    Fewer than w hashes are one window.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    best, at = hashes, np.arange(n, dtype=np.int32)
    size = 1
    while size < w:
        step = min(size, w - size)
        right = best[step:] <= best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        size += step
    return at[np.r_[True, at[1:] != at[:-1]]].astype(np.int64)


def fingerprints_of(text: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions (code points in the lower-cased text) of one document."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    where = np.flatnonzero(kept(codes))
    hashes = rolling_hashes(codes[where], k)
    at = window_minima(hashes, w)
    return hashes[at], where[at]


def winnow(docs: DataFrame, k: int = 25, w: int = 40) -> DataFrame:
    """Fingerprints of each document: ``doc_id, n_fingerprints, hashes, positions``.

    ``hashes`` are 64-bit values as signed longs and ``positions`` the start of
    each run in the lower-cased text, both in text order.  One row comes out
    for each row that goes in, whole texts are processed, and nothing is
    shuffled.  A null or empty text, or one with fewer than ``k`` kept
    characters, gives empty lists; between ``k`` and ``w + k - 1`` characters
    there is one window.  Repeated rows give repeated results, a null
    ``doc_id`` stays null, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            hashes, positions, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
            for text in batch.column("text").to_pylist():
                h, p = fingerprints_of(text or "", k, w)
                hashes.append(h)
                positions.append(p)
                counts.append(len(h))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n.astype(np.int32)), list_array(np.concatenate(hashes).view(np.int64), n, pa.int64()), list_array(np.concatenate(positions).astype(np.int32), n, pa.int32())],
                ["doc_id", "n_fingerprints", "hashes", "positions"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, n_fingerprints int, hashes array<bigint>, positions array<int>")


def fingerprints(docs: DataFrame, k: int = 25, w: int = 40) -> DataFrame:
    """``winnow`` with a row for each fingerprint: ``doc_id, position, hash``; documents without any have no row.

    Null, empty and short texts have none, nor has an empty table; repeated
    rows repeat theirs; a null ``doc_id`` stays null; long texts are hashed
    whole; other columns are not read, whatever they are called.
    """
    pairs = winnow(docs, k, w).select("doc_id", F.explode(F.arrays_zip("positions", "hashes")).alias("f"))
    return pairs.select("doc_id", F.col("f.positions").alias("position"), F.col("f.hashes").alias("hash"))


def fingerprints_sql(k: int = 25, w: int = 40) -> str:
    """``fingerprints`` in DuckDB: hashes of 2, 4, 8, ... characters are made of two of half the length."""
    word = r"[0-9A-Za-z\x{00C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{10FFFF}]"
    modulus = "18446744073709551616::UHUGEINT"
    steps, size, total, hashed = [], 1, k & 1, "c" if k & 1 else None
    last = "kept"
    while size * 2 <= k:
        half = "c" if size == 1 else f"h{size}"
        power = pow(BASE, size, 1 << 64)
        steps.append(f"s{2 * size} AS (SELECT *, ({half} + lead({half}, {size}) OVER p * {power}::UHUGEINT) % {modulus} AS h{2 * size} FROM {last} WINDOW p AS (PARTITION BY doc_id ORDER BY pos))")
        size, last = size * 2, f"s{2 * size}"
        if k & size:
            if hashed is None:
                hashed, total = f"h{size}", size
            else:
                power = pow(BASE, total, 1 << 64)
                steps.append(f"t{size} AS (SELECT *, ({hashed} + lead(h{size}, {total}) OVER p * {power}::UHUGEINT) % {modulus} AS g{size} FROM {last} WINDOW p AS (PARTITION BY doc_id ORDER BY pos))")
                hashed, total, last = f"g{size}", total + size, f"t{size}"
    place = 1 << 40
    return f"""
WITH chars AS (
  SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, generate_subscripts(string_split(lower(text), ''), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL AND text <> ''),
kept AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, unicode(ch)::UHUGEINT AS c
  FROM chars WHERE regexp_full_match(ch, '{word}')),
{",".join(chr(10) + x for x in steps).lstrip()},
full_grams AS (
  SELECT doc_id, pos, i, {hashed} AS h, count(*) OVER (PARTITION BY doc_id) AS m,
    {hashed} * {place}::UHUGEINT + ({place - 1} - i)::UHUGEINT AS v
  FROM {last} WHERE {hashed} IS NOT NULL),
windows AS (
  SELECT doc_id, i, m, min(v) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) AS least
  FROM full_grams),
chosen AS (SELECT DISTINCT doc_id, least FROM windows WHERE i <= greatest(m - {w - 1}, 1))
SELECT g.doc_id, g.pos::INTEGER AS position,
  CASE WHEN g.h >= 9223372036854775808::UHUGEINT THEN (g.h::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE g.h::BIGINT END AS hash
FROM full_grams g JOIN chosen c ON g.doc_id = c.doc_id AND g.v = c.least"""
