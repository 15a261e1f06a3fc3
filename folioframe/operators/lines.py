"""Lines and paragraphs from positioned spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .geometry import round_half_up

PAGE = ["doc", "page_index"]


def _join(parts, sep: str):
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), sep)


def page_text(spans: DataFrame) -> DataFrame:
    """Each page's texts joined by one space, in input order."""
    return spans.groupBy(*PAGE).agg(_join(F.collect_list(F.struct("span_idx", "text")), " ").alias("page_text"))


def line_buckets(spans: DataFrame, step: int = 5) -> DataFrame:
    """Lines as buckets of the rounded height; texts by x."""
    keyed = spans.withColumn("bucket", round_half_up(F.col("y0") / step) * step)
    return keyed.groupBy(*PAGE, "bucket").agg(F.count(F.lit(1)).alias("n_spans"), _join(F.collect_list(F.struct("x0", "span_idx", "text")), " ").alias("line_text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def running_lines(spans: DataFrame, gap: float = 5.0) -> DataFrame:
    """Lines that end where the height changes by more than ``gap`` from one span to the next, in order of (y, x)."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "span_idx")
    new = F.coalesce((F.abs(F.col("y0") - F.lag("y0").over(w)) > gap).cast("int"), F.lit(0))
    marked = spans.withColumn("is_new", new).withColumn("line_id", F.sum("is_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*PAGE, "line_id").agg(F.count(F.lit(1)).alias("n_spans"), _join(F.collect_list(F.struct("y0", "x0", "span_idx", "text")), " ").alias("line_text"))


def first_fit_lines(spans: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Each span's line: the first line whose first span's height is within the tolerance, in order of (y, x).

    In this order first spans are more than the tolerance apart, so that only
    the last line can fit.  Pages follow one another in sorted partitions and
    pass through one fold, which keeps the last line of one page.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, top, line = None, 0.0, 0
        for batch in batches:
            lines = []
            for at, y in zip(zip(batch["doc"].to_pylist(), batch["page_index"].to_pylist()), batch["y0"].to_pylist()):
                if at != page:
                    page, top, line = at, y, 0
                elif not y - top <= tolerance:
                    top, line = y, line + 1
                lines.append(line)
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["page_index"], batch["span_idx"], pa.array(lines, pa.int32())], ["doc", "page_index", "span_idx", "line_id"])

    # a height that isn't known fits nothing and is last
    known = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("y0", "x0")]
    ordered = spans.select("doc", F.col("page_index").cast("int").alias("page_index"), F.col("span_idx").cast("int").alias("span_idx"), *known).repartition(*PAGE).sortWithinPartitions(*PAGE, "y0", "x0", "span_idx")
    return ordered.mapInArrow(fold, "doc string, page_index int, span_idx int, line_id int")


def visual_text(spans: DataFrame, share: float = 0.15) -> DataFrame:
    """The text of each height bucket as seen: a space only where the gap to the span before exceeds a share of its height; a hyphen before a small letter joins."""
    keyed = spans.withColumn("bucket", round_half_up(F.col("y0") / 5) * 5)
    w = Window.partitionBy(*PAGE, "bucket").orderBy("x0", "span_idx")
    before, gap = F.lag("text").over(w), F.col("x0") - F.lag("x1").over(w)
    hyphen = before.rlike("-$") & F.col("text").rlike("^[a-z]")
    sep = F.when(before.isNull() | hyphen, "").when(gap > share * (F.col("y1") - F.col("y0")), " ").otherwise("")
    piece = keyed.withColumn("text", F.concat(sep, F.col("text")))
    return piece.groupBy(*PAGE, "bucket").agg(_join(F.collect_list(F.struct("x0", "span_idx", "text")), "").alias("line_text"))


def wrap_join(lines: DataFrame) -> DataFrame:
    """How each line joins the one before it: ``first``, ``hyphen``, ``space`` (that ends without ``.!?:`` and this begins small) or ``newline``; and the normal text."""
    w = Window.partitionBy("source", "doc_id").orderBy("line_no")
    before = F.lag("line").over(w)
    how = F.when(before.isNull(), "first").when(before.rlike("[A-Za-z]-$") & F.col("line").rlike("^[a-z]"), "hyphen").when(~before.rlike("[.!?:]$") & F.col("line").rlike("^[a-z]"), "space").otherwise("newline")
    return lines.select("source", "doc_id", "line_no", "line", how.alias("joined_by"))


def normal_paragraphs(lines: DataFrame) -> DataFrame:
    """Texts after ``wrap_join``; a hyphen that joins is taken out."""
    joined = wrap_join(lines)
    nxt = F.lead("joined_by").over(Window.partitionBy("source", "doc_id").orderBy("line_no"))
    bare = F.when(nxt == "hyphen", F.regexp_replace("line", F.lit("-$"), F.lit(""))).otherwise(F.col("line"))
    sep = F.when(F.col("joined_by") == "space", " ").when(F.col("joined_by") == "newline", "\n").otherwise("")
    return joined.withColumn("text", F.concat(sep, bare)).groupBy("source", "doc_id").agg(_join(F.collect_list(F.struct("line_no", "text")), "").alias("normal_text"))


def paragraphs(spans: DataFrame, gap: float = 50.0) -> DataFrame:
    """Paragraphs of each page: a blank line ends one, and so does a larger gap than a line of 20 and 30 more."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "span_idx")
    blank = F.trim("text") == ""
    new = F.coalesce((F.lag(blank).over(w) | blank | (F.col("y0") - F.lag("y0").over(w) > gap)).cast("int"), F.lit(0))
    marked = spans.withColumns({"is_new": new, "blank": blank}).withColumn("paragraph", F.sum("is_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("NOT blank")
    return marked.groupBy(*PAGE, "paragraph").agg(F.count(F.lit(1)).alias("n_lines"), F.min("span_idx").alias("first_span"), _join(F.collect_list(F.struct("y0", "span_idx", "text")), "\n").alias("paragraph_text"))


def repair_hyphens(text):
    return F.regexp_replace(text, F.lit("([A-Za-z])-[ ]*\n[ ]*([a-z])"), F.lit("$1$2"))


def reading_order(items: DataFrame) -> DataFrame:
    """Rank of each span by (line bucket of 0.6 of the page's median height, x)."""
    median = items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.col("y1") - F.col("y0"))).alias("h")).select(*PAGE, (F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")) * 0.6).alias("tol"))
    keyed = items.join(median, PAGE).withColumn("bucket", F.floor(F.col("y0") / F.col("tol")))
    return keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy("bucket", "x0", "span_idx")) - 1).select(*PAGE, "span_idx", "rank")
