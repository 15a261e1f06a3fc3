"""Tables found by geometry, their export, and submittal packets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import round_half_up

PAGE = ["doc", "page_index"]


def column_candidates(spans: DataFrame) -> DataFrame:
    """Centres in steps of 5 that at least two spans, and a tenth of the page's, share."""
    total = spans.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("total"))
    got = spans.groupBy(*PAGE, (round_half_up((F.col("x0") + F.col("x1")) / 2 / 5) * 5).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return got.join(total, PAGE).where(F.col("n") >= F.greatest(F.lit(2.0), 0.1 * F.col("total"))).select(*PAGE, "x", "n")


def merge_columns(candidates: DataFrame, within: float = 10.0) -> DataFrame:
    """Columns of each page: a candidate within 10 of an earlier column moves it halfway; the order matters, so this is a fold.

    A column that one candidate is too far from is too far from all later ones,
    so that only the last column can be near.  Pages follow one another in
    sorted partitions and pass through one fold.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, column, last = None, 0, 0.0
        for batch in batches:
            done = []
            for at, x in zip(zip(batch["doc"].to_pylist(), batch["page_index"].to_pylist()), batch["x"].to_pylist()):
                if at == page and abs(x - last) < within:
                    last = (last + x) / 2
                    continue
                if page is not None:
                    done.append((*page, column, last))
                page, column, last = at, column + 1 if at == page else 0, x
            yield _columns(done)
        if page is not None:
            yield _columns([(*page, column, last)])

    ordered = candidates.select(*PAGE, F.coalesce(F.col("x").cast("double"), F.lit(float("nan"))).alias("x")).repartition(*PAGE).sortWithinPartitions(*PAGE, "x")
    return ordered.mapInArrow(fold, "doc string, page_index int, col_idx int, x double")


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc": pa.string(), "page_index": pa.int32(), "col_idx": pa.int32(), "x": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows) if rows else [[]] * 4, kinds.values())], list(kinds))


def spaced_columns(candidates: DataFrame, within: float = 10.0) -> DataFrame:
    """Set-based columns: runs of candidates less than 10 apart, at their mean."""
    w = Window.partitionBy(*PAGE).orderBy("x")
    new = F.coalesce((F.col("x") - F.lag("x").over(w) >= within).cast("int"), F.lit(0))
    runs = candidates.withColumn("is_new", new).withColumn("col_idx", F.sum("is_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*PAGE, "col_idx").agg(F.avg(F.col("x").cast("double")).alias("x"))


def table_cells(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """``doc, page_index, row, col_idx, cell``: each span in the nearest column of its page, the left one of equals; rows by height in steps of 5."""
    centre = (F.col("x0") + F.col("x1")) / 2
    near = spans.join(columns.select(*PAGE, "col_idx", F.col("x").alias("cx")), PAGE).groupBy(*PAGE, "span_idx").agg(F.min_by("col_idx", F.struct(F.abs(centre - F.col("cx")), "col_idx")).alias("col_idx"))
    rows = spans.select(*PAGE, "span_idx", "x0", "text", (round_half_up(F.col("y0") / 5) * 5).alias("row")).join(near, [*PAGE, "span_idx"])
    return rows.groupBy(*PAGE, "row", "col_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "span_idx", "text"))), lambda p: p["text"]), " ").alias("cell"))


def table_confidence(cells: DataFrame) -> DataFrame:
    """50, and 20 for three columns, 20 for five rows, 10 if four fifths of the rows have about the mean number of cells; in hundredths."""
    per_row = cells.groupBy(*PAGE, "row").agg(F.count(F.lit(1)).alias("n"))
    size = cells.groupBy(*PAGE).agg(F.countDistinct("col_idx").alias("n_cols"))
    mean = per_row.groupBy(*PAGE).agg(F.avg("n").alias("mean"), F.count(F.lit(1)).alias("n_rows"))
    even = per_row.join(mean, PAGE).groupBy(*PAGE, "n_rows").agg(F.count_if(F.abs(F.col("n") - F.col("mean")) <= 2).alias("n_even"))
    score = F.lit(50) + F.when(F.col("n_cols") >= 3, 20).otherwise(0) + F.when(F.col("n_rows") >= 5, 20).otherwise(0) + F.when(F.col("n_even") >= 0.8 * F.col("n_rows"), 10).otherwise(0)
    return even.join(size, PAGE).select(*PAGE, "n_rows", "n_cols", score.alias("confidence_pct"))


def csv_cell(text: Column) -> Column:
    """A cell in quotes where it has a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def table_csv(cells: DataFrame) -> DataFrame:
    """Each page's table as CSV, a cell for each column that the table has."""
    cols = cells.select(*PAGE, "col_idx").distinct()
    grid = cells.select(*PAGE, "row").distinct().join(cols, PAGE).join(cells, [*PAGE, "row", "col_idx"], "left").withColumn("cell", F.coalesce(csv_cell(F.col("cell")), F.lit("")))
    join = lambda parts, key, sep: F.array_join(F.transform(F.sort_array(parts), lambda p: p[key]), sep)
    rows = grid.groupBy(*PAGE, "row").agg(join(F.collect_list(F.struct("col_idx", "cell")), "cell", ",").alias("line"))
    return rows.groupBy(*PAGE).agg(join(F.collect_list(F.struct("row", "line")), "line", "\n").alias("csv"))


def packets(pages: DataFrame) -> DataFrame:
    """Packets of ``doc, page_no, is_cover, is_unit``: a cover begins one; a unit page gives it its type without extending it; other pages do.

    A packet ends before the next cover, else with its last page that is
    neither cover nor unit page.  Pages before the first cover are in none.
    """
    w = Window.partitionBy("doc").orderBy("page_no")
    runs = pages.withColumn("packet", F.sum(F.col("is_cover").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("packet > 0")
    got = runs.groupBy("doc", "packet").agg(F.min("page_no").alias("start_page"), F.max(F.when(~F.col("is_unit") | F.col("is_cover"), F.col("page_no"))).alias("last_plain"), F.max("page_no").alias("last_any"), F.bool_or(F.col("is_unit") & ~F.col("is_cover")).alias("has_unit"))
    is_last = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("packet").desc())) == 1
    return got.withColumn("is_last", is_last).select("doc", "packet", "start_page", F.when(F.col("is_last"), F.col("last_plain")).otherwise(F.col("last_any")).alias("end_page"), F.when(F.col("has_unit"), "unit-report").otherwise("cover").alias("type"))


def packet_fields(spans: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The first match of each field's pattern in a document: ``doc, field, value``."""
    found = [spans.select("doc", "page_index", "span_idx", F.lit(name).alias("field"), F.regexp_extract("text", pattern, 1).alias("value")).where("value <> ''") for name, pattern in patterns.items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.groupBy("doc", "field").agg(F.min_by("value", F.struct("page_index", "span_idx")).alias("value"))
