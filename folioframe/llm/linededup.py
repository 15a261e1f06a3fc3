"""Line dedup by site-relative frequency.

A line that is on more than ``ratio`` of the pages of its host is boilerplate of
that host and is dropped from every page of it.  A line must repeat to be
boilerplate, so one that is on a single page stays, whatever the host's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def boilerplate_lines(docs: DataFrame, host: str = "source", ratio: float = 0.05) -> DataFrame:
    """Lines above the ratio: ``host, line_key, pages_with_line, host_pages``.

    A page counts a line once however often it repeats it.  Only 64-bit keys of
    lines are shuffled, counted before the exchange as well.
    """
    pages = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1), lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\r"))))).alias("keys"))
    # the page itself is counted under a null key, so that one pass gives both counts
    keyed = pages.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), F.filter("keys", lambda k: k != F.xxhash64(F.lit(""))))).alias("line_key"))
    counts = keyed.groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.where("line_key IS NULL").select(F.col("host").alias("total_host"), F.col("n").alias("host_pages"))
    lines = counts.where(F.col("line_key").isNotNull() & (F.col("n") >= 2))
    return (
        lines.join(totals, F.col("host").eqNullSafe(F.col("total_host")))
        .where(F.col("n") > F.lit(ratio) * F.col("host_pages"))
        .select("host", "line_key", F.col("n").alias("pages_with_line"), "host_pages")
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.05) -> DataFrame:
    """Documents without their host's boilerplate lines: ``doc_id, host, text, n_lines, n_dropped``.

    Lines are compared without surrounding spaces, tabs and carriage returns; blank lines are never
    boilerplate.  Every input row gives one output row: repeated rows stay
    repeated and count as pages each.  A null host is a host of its own; a null
    text has no lines and stays null; an empty text is one blank line.  A page
    that loses all its lines has an empty text.  A host of one page repeats
    nothing and loses no line; from two pages on the ratio alone decides.  An empty
    table gives an empty result.  Columns other than ``doc_id``,
    ``text`` and the host are not read.  The kept lines of a host are at most
    its mean number of lines over ``ratio``, so the list that is joined to its
    pages is bounded whatever the host's size; the join is Spark's choice, and
    a hot host is split by adaptive execution.
    """
    lists = boilerplate_lines(docs, host, ratio).groupBy("host").agg(F.collect_set("line_key").alias("drop_keys")).select(F.col("host").alias("drop_host"), "drop_keys")
    lists = materialise(lists)  # with its size known, the planner needs no shuffle of the pages where it is small
    pages = docs.select("doc_id", F.col(host).alias("host"), F.col("text").cast("string").alias("text"))
    lines = F.split("text", "\n", -1)
    joined = pages.join(lists, F.col("host").eqNullSafe(F.col("drop_host")), "left")
    kept = F.when(F.col("drop_keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("drop_keys", F.xxhash64(F.btrim(x, F.lit(" \t\r"))))))
    out = joined.select("doc_id", "host", lines.alias("lines"), kept.alias("kept"))
    return out.select(
        "doc_id",
        "host",
        F.when(F.col("lines").isNotNull(), F.array_join("kept", "\n")).alias("text"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).alias("n_dropped"),
    )


def drop_boilerplate_sql(ratio: float = 0.05) -> str:
    return f"""
WITH lines AS (
  SELECT doc_id, source AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
per_line AS (SELECT host, trim(line, ' ' || chr(9) || chr(13)) AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2),
totals AS (SELECT source AS host, count(*) AS pages FROM documents GROUP BY 1),
bad AS (SELECT p.host, p.line FROM per_line p JOIN totals t ON p.host IS NOT DISTINCT FROM t.host WHERE n >= 2 AND n > {ratio} * pages),
marked AS (SELECT l.*, b.line IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.host IS NOT DISTINCT FROM b.host AND trim(l.line, ' ' || chr(9) || chr(13)) = b.line),
again AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped) AS text, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source AS host, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(a.text, '') END AS text,
  coalesce(a.n_lines, 0)::INTEGER AS n_lines, coalesce(a.n_dropped, 0)::INTEGER AS n_dropped
FROM documents d LEFT JOIN again a ON d.doc_id = a.doc_id"""
