"""Language ID with bit-sliced Bloom filters of n-grams.

One table of machine words serves 64 languages: bit l of a word belongs to the
Bloom filter of language l; more languages have more tables.  An n-gram's words at its hash positions,
and-ed, give a bitmask of all languages that may contain it.  Per document the
bits are counted for each language, corrected for the filter's false positives,
and the language with the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_type, lowered, materialise, splitmix, steps

#: Lengths of the n-grams, in bytes of the folded text.
SIZES = (3, 4, 5)
#: Different labelled texts per language that the filters are made from, at most; those with the smallest hashes.
FIT_ROWS = 600
#: An n-gram counts for a language from this rate on, per million n-grams of its size there.
MIN_RATE = 40.0
#: Words in the table as a power of two, and hash positions of an n-gram.
TABLE_BITS, PROBES = 20, 2
#: Below this corrected share of n-grams a text is in no known language.
MIN_SHARE = 0.2
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20
_FOLD[0x27] = 0x27


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with everything but letters as one space, each row between spaces, and row offsets."""
    data, offsets = lowered(texts)
    n = len(offsets) - 1
    # a space before each row and one at the end
    out = np.insert(_FOLD[data], np.r_[offsets[:-1], len(data)].astype(np.int64), 0x20) if n else np.zeros(0, np.uint8)
    starts = offsets + np.arange(n + 1)
    space = out == 0x20
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    keep[:1] = True
    keep[starts] = True
    at = np.r_[0, np.cumsum(keep)]
    return out[keep], at[starts]


def gram_codes(data: np.ndarray, size: int) -> np.ndarray:
    """Each n-gram of bytes as a number."""
    m = len(data) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = data[:m].astype(np.uint64)
    for j in range(1, size):
        out = (out << np.uint64(8)) | data[j : j + m]
    return out | np.uint64(size << 56)


def positions(codes: np.ndarray, bits: int, probes: int) -> list[np.ndarray]:
    h = splitmix(codes)
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(bits * i)) & mask).astype(np.int64) for i in range(probes)]


@dataclass
class Filters:
    """The tables, each with the languages by bit of 64 at most, and each filter's rate of false positives."""

    languages: list[str]
    tables: list[np.ndarray]
    false_rates: np.ndarray
    bits: int = TABLE_BITS
    probes: int = PROBES
    grams: dict = field(default_factory=dict)

    def masks(self, codes: np.ndarray) -> list[np.ndarray]:
        """The languages that may contain each n-gram, from each table."""
        at = positions(codes, self.bits, self.probes)
        found = []
        for table in self.tables:
            out = table[at[0]]
            for x in at[1:]:
                out = out & table[x]
            found.append(out)
        return found

    def counts(self, texts: pa.Array, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
        """For each row and language the n-grams that its filter has, and each row's n-grams."""
        data, rows = folded(texts)
        n = len(rows) - 1
        found, total = np.zeros((n, len(self.languages)), np.int64), np.zeros(n, np.int64)
        for size in sizes:
            codes = gram_codes(data, size)
            # n-grams that end in the same row
            starts = np.minimum(rows[:-1], len(codes))
            ends = np.minimum(np.maximum(rows[1:] - size + 1, starts), len(codes))
            total += ends - starts
            masks = self.masks(codes)
            sums = np.zeros(len(codes) + 1, np.int64)
            for language in range(len(self.languages)):
                mask, bit = masks[language // 64], language % 64
                np.cumsum((mask >> np.asarray(bit, mask.dtype)) & np.asarray(1, mask.dtype), out=sums[1:])
                found[:, language] += sums[ends] - sums[starts]
        return found, total

    def shares(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each language's share of a row's n-grams, corrected for false positives, and each row's n-grams.

        Of N n-grams with t true members, t + (N - t) * f are found.
        """
        found, total = self.counts(texts)
        n = np.maximum(total, 1)[:, None]
        return np.clip((found - n * self.false_rates) / (n * (1 - self.false_rates)), 0, 1), total


def build_filters(texts: dict[str, list[str]], min_rate: float = MIN_RATE, bits: int = TABLE_BITS, probes: int = PROBES) -> Filters:
    """Filters of the n-grams that are frequent in each language's texts; a table for every 64 languages."""
    languages = sorted(texts)
    tables, fills, grams = [], [], {}
    for at in range(0, len(languages), 64):
        some = languages[at : at + 64]
        kinds = ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64))
        kind = next(k for k, most in kinds if len(some) <= most)
        table = np.zeros(1 << bits, kind)
        for bit, language in enumerate(some):
            data, _ = folded(pa.array(texts[language], pa.string()))
            members = []
            for size in SIZES:
                codes, n = np.unique(gram_codes(data, size), return_counts=True)
                members.append(codes[n >= max(2.0, min_rate * n.sum() / 1e6)])
            grams[language] = np.concatenate(members)
            for place in positions(grams[language], bits, probes):
                table[place] |= np.asarray(1 << bit, kind)
        one = np.asarray(1, kind)
        fills += [((table >> np.asarray(b, kind)) & one).mean() for b in range(len(some))]
        tables.append(table)
    return Filters(languages, tables, np.array(fills) ** probes, bits, probes, grams)


def sample(docs: DataFrame, rows_per_language: int = FIT_ROWS) -> DataFrame:
    """``lang, text``: of each language the different texts with the smallest hashes, exactly so many at most.

    A text counts once however often it repeats.  A cut on the hash at twice
    the wanted share of the different texts comes first, so that only about
    that many hashes are shuffled and ranked, and only the chosen texts read.
    """
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND lang <> ''")
    labelled = labelled.select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.md5(text)).alias("h"))
    share = F.col("h").bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    different = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    cuts = different.select(F.col("lang").alias("of"), (2.0 * rows_per_language / F.col("n")).alias("cut"))
    low = labelled.select("lang", "h").join(cuts, F.col("lang") == F.col("of")).where(share < F.col("cut"))
    ranked = low.select("lang", "h").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(share, "h")))
    chosen = ranked.where(F.col("nth") <= rows_per_language).select(F.col("lang").alias("of"), F.col("h").alias("of_h"))
    same = (F.col("lang") == F.col("of")) & (F.col("h") == F.col("of_h"))
    return labelled.join(materialise(chosen), same).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, rows_per_language: int = FIT_ROWS) -> Filters:
    """Filters from rows with a language label, a bounded number for each language; see ``sample``."""
    texts: dict[str, list[str]] = {}
    for language, text in sample(docs, rows_per_language).collect():
        texts.setdefault(language, []).append(text)
    return build_filters({k: sorted(v) for k, v in texts.items()})


def identify(docs: DataFrame, filters: Filters, min_share: float = MIN_SHARE) -> DataFrame:
    """The language of each document: ``doc_id, language, share, runner_up, runner_up_share, n_grams``.

    ``language`` is the one with the largest corrected share, the first by name
    when shares are equal, or ``und`` when that share is below ``min_share``.  A
    null or empty text, or one without letters, has no n-grams and is ``und``
    with share 0.  Without filters (no labelled rows) every row is ``und``.
    Every input row gives one output row and repeated rows repeat; a null
    ``doc_id`` stays null; an empty table gives an empty result.  ``doc_id``
    may have any type.  Whole texts are counted, and other columns are not
    read.  The tables are broadcast: one of fixed size (``TABLE_BITS``) for
    every 64 languages, of which there may be any number.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = np.array([*filters.languages, UNKNOWN, ""], dtype=object)
        for batch in steps(batches, "text", 1 << 19):
            shares, total = filters.shares(batch.column("text"))
            n = len(total)
            shares = np.hstack([shares, np.zeros((n, 1)), np.zeros((n, 1))])
            shares[total == 0] = 0
            order = np.argsort(-shares[:, : len(filters.languages) or 1], axis=1, kind="stable")
            best = order[:, 0]
            second = order[:, 1] if order.shape[1] > 1 else np.full(n, len(names) - 1)
            rows = np.arange(n)
            share, next_ = shares[rows, best], shares[rows, second]
            language = np.where((share >= min_share) & (total > 0), names[best], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(language.tolist(), pa.string()), pa.array(share), pa.array([x or None for x in names[second].tolist()], pa.string()), pa.array(next_), pa.array(total)],
                ["doc_id", "language", "share", "runner_up", "runner_up_share", "n_grams"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type(docs)}, language string, share double, runner_up string, runner_up_share double, n_grams bigint")


def identify_documents(docs: DataFrame) -> DataFrame:
    """``identify`` with filters fitted on the table's own labels."""
    return identify(docs, fit(docs))
