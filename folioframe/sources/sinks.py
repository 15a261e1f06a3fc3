"""Writing plans, outlines, inventories and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_copy_plan(plan: DataFrame) -> DataFrame:
    """Runs of pages to copy: neighbours in the plan that are neighbours in their source are one range."""
    w = Window.partitionBy("set_id").orderBy("pos")
    new = F.coalesce(((F.col("source") != F.lag("source").over(w)) | (F.col("page_index") != F.lag("page_index").over(w) + 1)).cast("int"), F.lit(1))
    runs = plan.where("pos >= 0").withColumn("is_new", new).withColumn("run", F.sum("is_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("set_id", "run", "source").agg(F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"), F.min("pos").alias("output_page"))


def plan_outline(plan: DataFrame, titles: DataFrame) -> DataFrame:
    """An outline entry ``id — title`` for each page of a plan that has an id."""
    joined = plan.where("pos >= 0 AND id IS NOT NULL").join(titles, "id", "left")
    return joined.select("set_id", "pos", F.concat_ws(" — ", "id", "title").alias("title"))


def slowest_pages(timings: DataFrame, n: int = 10) -> DataFrame:
    return timings.orderBy(F.col("millis").desc(), "page_index").limit(n)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv_tables(tables: DataFrame, path: str) -> None:
    """One text file row for each table's CSV, partitioned by document."""
    tables.select("doc", F.col("csv").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_html(html: DataFrame, path: str) -> None:
    html.select("section_id", F.col("html").alias("value")).write.mode("overwrite").partitionBy("section_id").text(path)
