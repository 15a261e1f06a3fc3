"""Reports, profile checks and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_report(warnings: DataFrame) -> DataFrame:
    """Messages (``doc, page_index, message``) counted by kind; failures of a region on the first two pages are notices."""
    text = F.col("message")
    roi, fallback, unmatched = F.contains(text, F.lit("ROI")), F.contains(text, F.lit("fallback")), F.contains(text, F.lit("unmatched"))
    notice = roi & (F.col("page_index") < 2)
    return warnings.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(notice).alias("n_notices"), F.count_if(roi & ~notice).alias("n_roi"), F.count_if(fallback).alias("n_fallbacks"), F.count_if(unmatched).alias("n_unmatched"))


def font_summary(spans: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent fonts and sizes of each document."""
    got = spans.groupBy("doc", "font_name", "font_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc").orderBy(F.col("n").desc(), "font_name", "font_size")
    return got.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def headings_per_page(spans: DataFrame, headings: DataFrame) -> DataFrame:
    """Headings of every page, 0 where there are none."""
    pages = spans.select("doc", "page_index").distinct()
    n = headings.groupBy("doc", "page_index").agg(F.count(F.lit(1)).alias("n"))
    return pages.join(n, ["doc", "page_index"], "left").select("doc", "page_index", F.coalesce("n", F.lit(0)).alias("n_headings"))


def validate_profile(pages: DataFrame, gates: dict[str, float]) -> DataFrame:
    """Shares of pages whose flags hold, per document, against their gates; the confidence is the product of the passed shares."""
    agg = pages.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), *[F.avg(F.col(f).cast("int").cast("double")).alias(f"share_{f}") for f in gates])
    passed = {f"pass_{f}": F.col(f"share_{f}") >= least for f, least in gates.items()}
    out = agg.withColumns(passed)
    every = F.lit(True)
    for name in passed:
        every = every & F.col(name)
    return out.withColumn("passes", every)


def best_profile(scores: DataFrame, least: float = 0.7) -> DataFrame:
    """The profile with the largest confidence of each document, the first by name of equals, if it is enough."""
    w = Window.partitionBy("doc").orderBy(F.col("confidence").desc(), "profile")
    return scores.withColumn("nth", F.row_number().over(w)).where((F.col("nth") == 1) & (F.col("confidence") >= least)).drop("nth")


def ordered_dimension(rows: DataFrame, by: str, step: int = 10) -> DataFrame:
    """A reference table's rows with an order in steps, by their line number."""
    return rows.withColumn("sort_order", F.row_number().over(Window.orderBy(by)) * step)


def slow_documents(timings: DataFrame, most: int = 10) -> DataFrame:
    return timings.orderBy(F.col("millis").desc(), "doc", "page_index").limit(most)


def placed_sections(wanted: DataFrame, footers: DataFrame, headings: DataFrame, hints: DataFrame) -> DataFrame:
    """The page of each wanted section ``doc, section_id``: by footer, also with the prefix ``01 ``; else by heading; else by hint; else invalid."""
    foot = footers.select("doc", "section_id", F.col("first_page").alias("by_footer"))
    alt = footers.select("doc", F.regexp_replace("section_id", F.lit("^01 "), F.lit("")).alias("section_id"), F.col("first_page").alias("by_variant")).groupBy("doc", "section_id").agg(F.min("by_variant").alias("by_variant"))
    out = wanted.join(foot, ["doc", "section_id"], "left").join(alt, ["doc", "section_id"], "left")
    for name, table in (("by_heading", headings), ("by_hint", hints)):
        out = out.join(table.groupBy("doc", "section_id").agg(F.min("page_index").alias(name)), ["doc", "section_id"], "left")
    ways = ["by_footer", "by_variant", "by_heading", "by_hint"]
    return out.select("doc", "section_id", F.coalesce(*ways).alias("page_index"), F.coalesce(*[F.when(F.col(w).isNotNull(), w) for w in ways], F.lit("invalid")).alias("way"))


def hoist_unanchored(nodes: DataFrame, every: int = 8) -> DataFrame:
    """Nodes with an anchor (``node_id, parent_id, anchor``); each one's parent is its nearest ancestor with an anchor.

    A join for each removed node of the longest chain; lineage is cut after
    every few of them.
    """
    spark = nodes.sparkSession
    gone = nodes.where("anchor IS NULL").select(F.col("node_id").alias("gone_id"), F.col("parent_id").alias("gone_parent"))
    # removed nodes with their nearest ancestor that isn't, from the top of each chain down
    front = gone.join(gone.select(F.col("gone_id").alias("above")), F.col("gone_parent") == F.col("above"), "left_anti")
    found, i = front, 0
    while True:
        up = front.select(F.col("gone_id").alias("above"), F.col("gone_parent").alias("higher"))
        front = gone.join(up, F.col("gone_parent") == F.col("above")).select("gone_id", F.col("higher").alias("gone_parent"))
        i += 1
        if spark.conf.get("spark.checkpoint.dir", None) and i % every == 0:
            front, found = front.checkpoint(), found.checkpoint()
        if front.isEmpty():
            break
        found = found.unionByName(front)
    out = nodes.where("anchor IS NOT NULL").join(found, F.col("parent_id") == F.col("gone_id"), "left")
    return out.withColumn("parent_id", F.when(F.col("gone_id").isNotNull(), F.col("gone_parent")).otherwise(F.col("parent_id"))).drop("gone_id", "gone_parent")
