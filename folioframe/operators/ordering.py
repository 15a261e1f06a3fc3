"""Natural order, comparators, splitting and assembling of page sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import natural_key, section_format, sheet_prefix

ASSEMBLY = ["A", "C", "E", "M", "P", "S"]
#: Characters of the natural key that ids are grouped by before they are ranked: letters, and the number behind them up to its last two digits.
PART = 13
#: Pages of one id and one range of this many page numbers are sorted in one task.
PAGES = 1 << 21


def row_numbers(rows: DataFrame, by: list[str], coarse: list[str], fine: list[str], order: list, name: str, sizes: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: the place from 0 of each row in ``order`` within ``by`` (strings), with no task that sorts all rows of ``by``.

    ``coarse`` and ``fine`` name ranges: columns without nulls that never fall
    along the order.  Rows are sorted below one range, and the rows of the
    ranges before are counted: coarse ranges in one task for each ``by``, fine
    ones in one for each coarse range.  ``sizes`` has these columns and
    the number ``n`` of rows, if that can be had for less than by the ranges.
    """
    # nulls in by are a group of their own, also in the join
    rows = rows.withColumns({b: F.coalesce(b, F.lit("\0")) for b in by})
    keys = [*by, *coarse, *fine]

    def before(sizes: DataFrame, within: list[str], along: list[str], alias: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(*along).rowsBetween(Window.unboundedPreceding, 0)
        return sizes.select(*within, *along, (F.sum("n").over(w) - F.col("n")).alias(alias))

    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    else:
        sizes = sizes.withColumns({b: F.coalesce(b, F.lit("\0")) for b in by}).groupBy(*keys).agg(F.sum("n").alias("n"))
    if fine:
        outer = before(sizes.groupBy(*by, *coarse).agg(F.sum("n").alias("n")), by, coarse, "outer")
        starts = before(sizes, [*by, *coarse], fine, "inner").join(outer, [*by, *coarse]).select(*keys, (F.col("outer") + F.col("inner")).alias("start"))
    else:
        starts = before(sizes, by, coarse, "start")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # a left join is left out where nobody asks for the place
    out = rows.withColumn(name, inside).join(starts, keys, "left").withColumn(name, F.col("start") + F.col(name) - 1)
    return out.drop("start").withColumns({b: F.nullif(b, F.lit("\0")) for b in by})


def natural_rank(ids: DataFrame, column: str = "id") -> DataFrame:
    """Each distinct id's place in natural order, from 0."""
    keyed = ids.select(column).where(F.col(column).isNotNull()).distinct().withColumn("key", natural_key(F.col(column)))
    # ids are ranked below each beginning of the key, so that no single task sorts all of them
    keyed = keyed.withColumn("part", F.substring("key", 1, PART))
    sizes = keyed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key", column))
    return keyed.withColumn("inside", inside).join(before, "part").select(column, (F.col("before") + F.col("inside") - 1).alias("place"))


def drawings_order(rows: DataFrame) -> DataFrame:
    """Place of each sheet within its document: discipline order, natural id, page."""
    key = natural_key(F.coalesce("normalized_id", F.lit("")))
    placed = rows.withColumns({"_order": F.coalesce("sort_order", F.lit(999)), "_page": F.coalesce("page_index", F.lit(0))}).withColumn("_pages", F.expr(f"_page div {PAGES}"))

    def keyed(table: DataFrame) -> DataFrame:
        return table.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, PART))

    # counted by id, which is less than making the key of each row twice
    sizes = keyed(placed.groupBy("doc", "_order", "normalized_id", "_pages").agg(F.count(F.lit(1)).alias("n")))
    out = row_numbers(keyed(placed), ["doc"], ["_order", "_part"], ["_key", "_pages"], ["_page"], "place", sizes)
    return out.select(*rows.columns, (F.col("place") + 1).cast("int").alias("place"))


def specs_order(rows: DataFrame, code: str = "code", key: str = "o_orderkey") -> DataFrame:
    """Place of each section within its division: division order, numbers of the code (without them last), key."""
    modern = section_format(F.col(code)) == "modern-6digit"
    numbers = F.when(modern, F.regexp_replace(code, F.lit(" "), F.lit("")).cast("int"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sort_order").orderBy(numbers.asc_nulls_last(), key)))


def split_drawings(pages: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Groups of pages by prefix, others under ``_OTHER``: size, ids, first and last page in natural order of ids."""
    prefix = F.coalesce(sheet_prefix(F.col("normalized_id")), F.lit("_OTHER"))
    group = F.when(prefix.isin([a.upper() for a in allowed]), prefix).otherwise("_OTHER") if allowed else prefix
    # group and natural key go by the id, so pages are summed up by id first, in hash tables of numbers
    ids = pages.groupBy("doc", "normalized_id").agg(F.count(F.lit(1)).alias("n"), F.min("page_index").alias("first"), F.max("page_index").alias("last"))
    keyed = ids.select("doc", group.alias("group"), "normalized_id", "n", "first", "last", F.col("normalized_id").isNull().alias("no_id"), natural_key(F.col("normalized_id")).alias("key"))
    first, last = (F.struct("no_id", "key", page) for page in ("first", "last"))
    return keyed.groupBy("doc", "group").agg(F.sum("n").alias("page_count"), F.count("normalized_id").alias("n_ids"), F.min_by("first", first).alias("start_page"), F.max_by("last", last).alias("end_page"))


def split_specs(sections: DataFrame, by: str = "section", code: str = "code", key: str = "o_orderkey") -> DataFrame:
    """Groups by section or division; legacy codes go by their first two digits; groups are by key, not by run."""
    group = F.col(code) if by == "section" else F.substring(code, 1, 2)
    return sections.where(section_format(F.col(code)) != "invalid").groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("page_count"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def assemble_order(groups: DataFrame) -> DataFrame:
    """Where each group's pages start when groups are put together: A, C, E, M, P, S, then the others by name, ``_OTHER`` last."""
    rank = F.array_position(F.array(*[F.lit(a) for a in ASSEMBLY]), F.col("group"))
    w = Window.partitionBy("doc").orderBy(F.col("group") == "_OTHER", rank == 0, rank, "group")
    return groups.withColumns({"place": F.row_number().over(w), "first_output_page": F.sum("page_count").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("page_count")}).select("doc", "group", "place", "first_output_page")
