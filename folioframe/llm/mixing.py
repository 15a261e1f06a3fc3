"""Mixing sources to target weights.

Each source gets a budget of tokens, its share of the total by weight.  Its
documents are put in a hash-random order and taken as long as they fit; a
source smaller than its budget is repeated in whole epochs first.  Tokens are
runs of characters other than space, tab, carriage return and line feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Ranges of the hash key that each source is cut into; prefix sums run inside a range and over the ranges' totals.
RANGES = 4096
_HEX = 13
_TOKEN = "[^ \\\\t\\\\r\\\\n]+"


def _places(docs: DataFrame, seed: str) -> list[Column]:
    """The internal columns of a row: source, tokens and hash key, the first 52 bits of a md5."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.md5(text)))
    return [
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("m_source"),
        F.expr(f"regexp_count(coalesce(cast(text as string), ''), '{_TOKEN}')").cast("bigint").alias("m_tokens"),
        F.conv(F.substring(key, 1, _HEX), 16, 10).cast("bigint").alias("m_key"),
    ]


def cuts(slim: DataFrame, weights: dict[str, float] | None, total_tokens: int | None) -> DataFrame:
    """A row for each source in the mixture: ``m_source, epochs, cut``.

    ``cut`` is the last (key, doc_id) of the partial epoch, null when it is empty.
    """
    parts = slim.groupBy("m_source", "m_part").agg(F.sum("m_tokens").alias("part_tokens"))
    sources = parts.groupBy("m_source").agg(F.sum("part_tokens").alias("source_tokens")).where("source_tokens > 0")
    if weights is None:
        sources = sources.withColumn("weight", F.lit(1.0))
    else:
        named = slim.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "m_source string, weight double")
        sources = sources.join(named, "m_source").where("weight > 0")
    total = sources.agg(F.sum("weight").alias("all_weight"), F.sum("source_tokens").alias("all_tokens"))
    size = F.col("all_tokens") if total_tokens is None else F.lit(int(total_tokens)).cast("bigint")
    budgets = sources.crossJoin(total).select("m_source", "source_tokens", F.floor(size * F.col("weight") / F.col("all_weight")).cast("bigint").alias("budget"))
    budgets = budgets.selectExpr("m_source", "budget div source_tokens AS epochs", "budget % source_tokens AS rest")
    before = F.sum("part_tokens").over(Window.partitionBy("m_source").orderBy("m_part")) - F.col("part_tokens")
    offsets = parts.select("m_source", "m_part", before.alias("before")).join(budgets, "m_source")
    place = F.struct("m_key", "doc_id")
    so_far = F.sum("m_tokens").over(Window.partitionBy("m_source", "m_part").orderBy(place))  # up to and with equal places
    running = slim.withColumn("so_far", so_far).join(offsets, ["m_source", "m_part"])
    fits = F.col("before") + F.col("so_far") <= F.col("rest")
    return running.groupBy("m_source").agg(F.first("epochs").alias("epochs"), F.max(F.when(fits, place)).alias("cut"))


def _taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """``rows`` with ``m_epoch``, one for each time that a row is taken.

    The table of cuts has a row for each source; Spark broadcasts it when its
    size allows and otherwise splits hot sources at the join.
    """
    joined = rows.join(cut.withColumnRenamed("m_source", "c_source"), F.col("m_source") == F.col("c_source"))
    copies = F.col("epochs") + F.when(F.struct("m_key", "doc_id") <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("m_copies", copies).where("m_copies > 0").withColumn("m_epoch", F.explode(F.expr("sequence(0L, m_copies - 1)")))


def _keyed(docs: DataFrame, seed: str, *keep: Column) -> DataFrame:
    return docs.select(*keep, F.col("doc_id"), *_places(docs, seed))


def _slim(docs: DataFrame, seed: str) -> DataFrame:
    width = 16**_HEX // RANGES
    return materialise(_keyed(docs, seed).withColumn("m_part", F.expr(f"m_key div {width}").cast("int")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total_tokens: int | None = None, seed: str = "mix-1") -> DataFrame:
    """The mixture: ``doc_id, source, tokens, epoch``, a row for each time that a document is taken.

    ``weights`` are relative; a source that isn't named isn't taken, and
    without ``weights`` all sources weigh the same.  ``total_tokens`` is the
    size of the mixture, by default the tokens of the sources that are taken.
    The budget of a source is ``floor(total * weight / sum of weights)``.  With
    T tokens in it, ``floor(budget / T)`` whole epochs are taken, and of one
    more the longest prefix in order of (key, doc_id) that fits into the rest.

    Rows with the same key and ``doc_id`` (that is, repeated rows) share a place
    and are taken together; a null ``doc_id`` comes before others.  A null
    source is the source ``''``.  A null or empty text has no tokens and is
    taken when its place is before the cut; a source without any tokens isn't
    taken.  An empty table gives an empty result.  Whole texts are counted,
    only keys and counts are shuffled, and each source is cut into ``RANGES``
    ranges of the key, so that many tasks sort a hot source.
    """
    slim = _slim(docs, seed)
    taken = _taken(slim, cuts(slim, weights, total_tokens))
    return taken.select("doc_id", F.col("m_source").alias("source"), F.col("m_tokens").alias("tokens"), F.col("m_epoch").alias("epoch"))


def mix_documents(docs: DataFrame, weights: dict[str, float] | None = None, total_tokens: int | None = None, seed: str = "mix-1") -> DataFrame:
    """The mixture with the columns of ``docs``, whatever they are called; rules as in ``mix``."""
    cut = materialise(cuts(_slim(docs, seed), weights, total_tokens))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("m_row")
    return _taken(_keyed(docs, seed, whole), cut).select("m_row.*")


def mix_sql(seed: str = "mix-1") -> str:
    """``mix`` with equal weights and the default size, in DuckDB."""
    return rf"""
WITH slim AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+'))::BIGINT AS tokens,
    ('0x' || substr(md5('{seed}|' || doc_id || '|' || md5(coalesce(text, ''))), 1, {_HEX}))::BIGINT AS key
  FROM documents),
sources AS (SELECT source, sum(tokens)::BIGINT AS source_tokens FROM slim GROUP BY source HAVING sum(tokens) > 0),
total AS (SELECT count(*)::DOUBLE AS w, sum(source_tokens)::BIGINT AS t FROM sources),
budgets AS (SELECT source, source_tokens, floor(t * 1.0::DOUBLE / w)::BIGINT AS budget FROM sources, total),
running AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) AS so_far FROM slim),
planned AS (
  SELECT doc_id, source, tokens, budget // source_tokens + CASE WHEN so_far <= budget % source_tokens THEN 1 ELSE 0 END AS copies
  FROM running JOIN budgets USING (source))
SELECT doc_id, source, tokens, unnest(range(copies))::BIGINT AS epoch FROM planned"""
