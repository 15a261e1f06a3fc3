"""Runs of pages: gap repair, section runs, audit, scoping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _pages(doc: str = "doc_id", order: str = "page_index"):
    return Window.partitionBy(doc).orderBy(order)


def repair_section_ids(pages: DataFrame, doc: str = "doc_id", order: str = "page_index", value: str = "section_id") -> DataFrame:
    """Adds ``repaired_id`` and ``repair``: a gap takes the section before it; a gap at the start takes the one right behind it.

    Fills cascade forward, so a longer gap is filled from its left; of a longer
    gap at the start only the last page is filled.
    """
    w = _pages(doc, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(value).over(w)
    repair = F.when(F.col(value).isNotNull(), "none").when(before.isNotNull() & (before == after), "both-neighbours").when(before.isNotNull(), "previous").when(after.isNotNull(), "next").otherwise("unresolved")
    return pages.withColumn("repaired_id", F.coalesce(F.col(value), before, after)).withColumn("repair", repair)


def mark_runs(pages: DataFrame, doc: str = "doc_id", order: str = "page_index", value: str = "section_id", page_no: str | None = "page_in_section") -> DataFrame:
    """Adds ``run_no`` and ``run_value``, both null for pages in no run.

    A run starts with a value that differs from that of the run so far, or
    where the page number returns to 1 from a larger one; pages without a value
    belong to the run before them.  Pages before the first value are in no run,
    and a return to 1 without a value ends a run and begins none.
    """
    w = _pages(doc, order)
    back = F.coalesce((F.col(page_no) == 1) & (F.lag(page_no).over(w) > 1), F.lit(False)) if page_no else F.lit(False)
    known = F.col(value).isNotNull()
    event = F.when(known, F.concat(F.lit("="), F.col(value).cast("string"))).when(back, F.lit("end"))
    marked = pages.withColumns({"run_back": back, "run_event": event})
    before = F.last("run_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.last("run_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = known & (F.col("run_back") | ~F.col("run_event").eqNullSafe(before))
    so_far = F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(now != "end", F.lit(False))
    latest = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumns({"run_no": F.when(inside, so_far), "run_value": F.when(inside, latest)}).drop("run_back", "run_event")


def section_runs(pages: DataFrame, doc: str = "doc_id", order: str = "page_index", value: str = "section_id", page_no: str | None = "page_in_section") -> DataFrame:
    """A row for each run: its value, first and last page, and pages."""
    marked = mark_runs(pages, doc, order, value, page_no).where("run_no IS NOT NULL")
    ends = [F.min(order).alias("start_page"), F.max(order).alias("end_page"), F.count(F.lit(1)).alias("page_count")]
    return marked.groupBy(doc, "run_no").agg(F.first("run_value").alias(value), *ends)


def section_audit(pages: DataFrame) -> DataFrame:
    """For each document how many pages were repaired, and how."""
    fixed = repair_section_ids(pages)
    count = lambda x: F.count_if(F.col("repair") == x)
    return fixed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), count("none").alias("n_parsed"), count("both-neighbours").alias("n_both"), count("previous").alias("n_previous"), count("next").alias("n_next"), count("unresolved").alias("n_unresolved")
    )


def page_assignments(pages: DataFrame) -> DataFrame:
    """Each page's section after repair, with its run."""
    runs = mark_runs(repair_section_ids(pages), value="repaired_id")
    return runs.select("doc_id", "page_index", F.col("repaired_id").alias("section_id"), "repair", "run_no")


def scope_sections(starts: DataFrame, last_pages: DataFrame) -> DataFrame:
    """Each section from its start to the page before the next start, at least its own; the last to the end of the document."""
    nxt = F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page", "section_id"))
    return starts.join(last_pages, "doc_id").select("doc_id", "section_id", "start_page", F.greatest("start_page", F.coalesce(nxt - 1, F.col("last_page"))).alias("end_page"))


def footer_index(pages: DataFrame) -> DataFrame:
    """Each section code's first page and pages, from codes parsed per page."""
    once = pages.where("section_id IS NOT NULL").select("doc_id", "page_index", "section_id").distinct()
    return once.groupBy("doc_id", "section_id").agg(F.min("page_index").alias("first_page"), F.count(F.lit(1)).alias("n_pages"), F.array_join(F.sort_array(F.collect_list("page_index")).cast("array<string>"), ",").alias("page_list"))


def boundary_source(pages: DataFrame, least_sections: int = 15, least_coverage: float = 0.8) -> DataFrame:
    """Whether a document's sections are taken from footers or from headings: footers when there are enough and they cover enough pages."""
    got = pages.groupBy("doc_id").agg(F.countDistinct("section_id").alias("n_sections"), F.count("section_id").alias("n_with_id"), F.count(F.lit(1)).alias("n_pages"))
    use = (F.col("n_sections") >= least_sections) & (F.col("n_with_id") >= least_coverage * F.col("n_pages"))
    return got.withColumn("boundary", F.when(use, "footer").otherwise("heading"))


def sample_pages(pages: DataFrame, first: int = 30, order: str = "page_index", doc: str = "doc_id") -> DataFrame:
    """The first pages of each document and about as many evenly spaced ones behind them."""
    total = F.count(F.lit(1)).over(Window.partitionBy(doc))
    step = F.greatest(F.floor((total - first) / F.lit(first)), F.lit(1))
    return pages.withColumn("every", step).where((F.col(order) < first) | ((F.col(order) - first) % F.col("every") == 0)).drop("every")
