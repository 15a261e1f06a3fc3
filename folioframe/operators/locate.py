"""Locating the identifier of each page: sections by text, sheets by position and score, footers by token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import SECTION_PATTERN, SHEET_PATTERN, normalize_section_id, normalize_sheet_id, sheet_prefix

PAGE = ["doc", "page_index"]
ANCHOR_WORDS = ["SHEET", "DWG", "DRAWING", "NO.", "NUMBER", "TITLE", "PAGE", "ID", "REV"]
KNOWN_PREFIXES = ["A", "AD", "C", "E", "ED", "F", "FA", "FP", "G", "I", "L", "M", "MD", "P", "PD", "Q", "R", "S", "SD", "T", "X"]
FALSE_ID = "^(REV|FIG|TBL|VOL|PH|NO)[ .-]*[0-9]"
INLINE = "(?i)(see|refer to|per|as specified in|in accordance with|comply with|under|and)[ ]+$"


def section_candidates(pages: DataFrame, reject_division_01: bool = True) -> DataFrame:
    """Section ids of each page's text (``doc, page_index, text``) with a confidence in hundredths.

    50; 20 more with the word SECTION within 50 characters before the first
    occurrence; 20 more if it occurs twice; 30 less if the page has several ids.
    """
    found = pages.select(*PAGE, "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({SECTION_PATTERN})"), F.lit(1))).alias("pos", "raw"))
    each = found.withColumn("id", normalize_section_id(F.col("raw"))).groupBy(*PAGE, "id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("raw", "text"), "pos").alias("f"))
    if reject_division_01:
        each = each.where(~F.col("id").startswith("01 "))
    at = F.instr("f.text", F.col("f.raw"))
    before = F.substr("f.text", F.greatest(at - 50, F.lit(1)), at - F.greatest(at - 50, F.lit(1)))
    several = F.count(F.lit(1)).over(Window.partitionBy(*PAGE)) > 1
    score = F.lit(50) + F.when(F.contains(F.upper(before), F.lit("SECTION")), 20).otherwise(0) + F.when(F.col("n") >= 2, 20).otherwise(0) - F.when(several, 30).otherwise(0)
    return each.select(*PAGE, "id", "n", F.least(F.lit(100), F.greatest(F.lit(0), score)).alias("confidence_pct"))


def best_section(pages: DataFrame, least_pct: int = 50) -> DataFrame:
    """The surest section of each page, the smallest id of equals, if it is sure enough."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("confidence_pct").desc(), "id")
    ranked = section_candidates(pages).withColumn("nth", F.row_number().over(w))
    return ranked.where((F.col("nth") == 1) & (F.col("confidence_pct") >= least_pct)).drop("nth", "n")


def headed_sections(lines: DataFrame) -> DataFrame:
    """Lines ``doc, page_index, line_no, line`` that are a heading SECTION DD SS SS and not a reference in a sentence."""
    pattern = f"SECTION[ ]+({SECTION_PATTERN})"
    before = F.regexp_extract("line", "^(.*?)SECTION", 1)
    return lines.where(F.col("line").rlike(pattern) & ~before.rlike(INLINE)).select(*PAGE, "line_no", normalize_section_id(F.regexp_extract("line", pattern, 1)).alias("section_id"))


def sheet_candidates(spans: DataFrame) -> DataFrame:
    """Spans that hold a sheet id, with the features that make it likely and a confidence in hundredths.

    50; 30 in the lower right quarter's title block; 30 within 50 points of an
    anchor word; 20 for a known prefix; 40 less if the page has it more than
    three times; 15 more near the corner, 20 less in the upper left; 50 less for
    what only looks like an id.
    """
    text = F.upper("text")
    raw = F.regexp_extract(text, f"({SHEET_PATTERN})", 1)
    found = spans.where(raw != "").withColumn("id", normalize_sheet_id(raw)).select(*PAGE, "span_idx", "text", "id", "x0", "y0", "x1", "y1", "width", "height")
    marks = spans.where(F.exists(F.array(*[F.lit(w) for w in ANCHOR_WORDS]), lambda w: F.contains(text, w))).select(*PAGE, F.col("span_idx").alias("m_idx"), F.col("x0").alias("mx"), F.col("y0").alias("my"))
    near = found.select(*PAGE, "span_idx", "x0", "y0").join(marks, PAGE).where((F.col("span_idx") != F.col("m_idx")) & ((F.col("x0") - F.col("mx")) ** 2 + (F.col("y0") - F.col("my")) ** 2 < 2500)).select(*PAGE, "span_idx").distinct().withColumn("near_anchor", F.lit(True))
    out = found.join(near, [*PAGE, "span_idx"], "left").withColumn("near_anchor", F.col("near_anchor").isNotNull())
    fx, fy = F.col("x0") / F.col("width"), F.col("y0") / F.col("height")
    repeats = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "id"))
    score = (
        F.lit(50) + F.when((fx >= 0.5) & (fy >= 0.5), 30).otherwise(0) + F.when(F.col("near_anchor"), 30).otherwise(0) + F.when(sheet_prefix(F.col("id")).isin(KNOWN_PREFIXES), 20).otherwise(0)
        - F.when(repeats > 3, 40).otherwise(0) + F.when((fx >= 0.8) & (fy >= 0.8), 15).when((fx < 0.5) & (fy < 0.5), -20).otherwise(0) - F.when(text.rlike(FALSE_ID), 50).otherwise(0)
    )
    return out.withColumn("confidence_pct", F.least(F.lit(100), F.greatest(F.lit(0), score.cast("int"))))


def best_sheet(spans: DataFrame, accept_pct: int = 75, warn_pct: int = 60) -> DataFrame:
    """The surest sheet id of each page: ``ok`` from 75, ``warn`` from 60, else none."""
    w = Window.partitionBy(*PAGE).orderBy(F.col("confidence_pct").desc(), "span_idx")
    top = sheet_candidates(spans).withColumn("nth", F.row_number().over(w)).where("nth = 1")
    return top.where(F.col("confidence_pct") >= warn_pct).select(*PAGE, "id", "confidence_pct", F.when(F.col("confidence_pct") >= accept_pct, "ok").otherwise("warn").alias("verdict"))


def neighbours(spans: DataFrame, gap: float = 50.0, same_line: float = 10.0, below: float = 30.0) -> DataFrame:
    """Pairs of spans whose texts may belong together: the next one to the right on the line, or right below."""
    other = spans.select(*PAGE, F.col("span_idx").alias("o_idx"), F.col("text").alias("o_text"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    dx, dy = F.col("ox") - F.col("x1"), F.col("oy") - F.col("y0")
    right = (F.abs(dy) <= same_line) & dx.between(0, gap)
    under = dy.between(0.001, below) & (F.abs(F.col("ox") - F.col("x0")) <= same_line)
    pairs = spans.join(other, PAGE).where((F.col("span_idx") != F.col("o_idx")) & (right | under))
    w = Window.partitionBy(*PAGE, "span_idx").orderBy(F.abs(dy), F.abs(dx), "o_idx")
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth = 1").select(*PAGE, "span_idx", "o_idx", F.concat("text", "o_text").alias("merged"))


def locate_in_rois(spans: DataFrame, rois: DataFrame) -> DataFrame:
    """Each page's sheet id from the first region that has one, in order of ``roi_ord``; spans as from ``spans_in_rois`` joined to it.

    In a region the best score wins: a longer id, a separator, a suffix, an
    anchor word on the page; then the lower and more right one.
    """
    raw = F.regexp_extract(F.upper("text"), f"({SHEET_PATTERN})", 1)
    hits = spans.join(rois.select("roi", "roi_ord"), "roi").where(raw != "").withColumn("id", normalize_sheet_id(raw))
    score = F.length("id") + F.when(F.col("id").rlike("[A-Z]$"), 15).otherwise(0) + F.when(F.col("id").rlike("[-.]"), 5).otherwise(0) - F.when(F.length("id") < 4, 20).otherwise(0)
    w = Window.partitionBy(*PAGE).orderBy("roi_ord", score.desc(), F.col("y0").desc(), F.col("x0").desc(), "span_idx")
    return hits.withColumns({"score": score, "nth": F.row_number().over(w)}).where("nth = 1").select(*PAGE, "id", "roi", "score")


def sheet_titles(ids: DataFrame, spans: DataFrame, reach: float = 200.0, most: int = 5, longest: int = 60) -> DataFrame:
    """A title for each located id (``doc, page_index, span_idx``): the nearest spans within reach, those above first, in reading order."""
    at = ids.select(*PAGE, F.col("span_idx").alias("id_idx"), F.col("x0").alias("ix"), F.col("y0").alias("iy"))
    near = spans.join(at, PAGE).where((F.col("span_idx") != F.col("id_idx")) & (F.trim("text") != "") & ~F.upper("text").rlike(f"^{SHEET_PATTERN}$"))
    d = (F.col("x0") - F.col("ix")) ** 2 + (F.col("y0") - F.col("iy")) ** 2
    w = Window.partitionBy(*PAGE, "id_idx").orderBy((F.col("y0") > F.col("iy")).cast("int"), d, "span_idx")
    top = near.where(d < reach * reach).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "span_idx", "text"))), lambda p: p["text"]), " ")
    got = top.groupBy(*PAGE, "id_idx").agg(joined.alias("title"))
    return got.select(*PAGE, F.col("id_idx").alias("span_idx"), F.when(F.length("title") > longest, F.concat(F.substring("title", 1, longest), F.lit("..."))).otherwise(F.col("title")).alias("title"))


def parse_footers(footers: DataFrame) -> DataFrame:
    """Section, page number and title of each footer text, and how sure that is."""
    t = F.col("footer")
    section = F.regexp_extract(t, "(^|[^0-9])([0-9]{2}[ .-]*[0-9]{2}[ .-]*[0-9]{2})([^0-9]|$)", 2)
    number = F.regexp_extract(t, "(?i)(page[: ]*|p[.][ ]*)([0-9]+)", 2)
    title = F.trim(F.regexp_extract(t, "[0-9][ ]*-[ ]*([A-Za-z][A-Za-z ,&]*?)[ ]*(Page|P[.]|$)", 1))
    sure = F.when((section != "") & (number != ""), "high").when((section != "") | (number != ""), "medium").otherwise("low")
    return footers.select(*PAGE, F.when(section != "", normalize_section_id(section)).alias("section_id"), F.when(number != "", number.cast("int")).alias("page_in_section"), F.nullif(title, F.lit("")).alias("title"), sure.alias("sure"))


def footer_counters(parsed: DataFrame) -> DataFrame:
    """How many footers of each document were read, matched and kept."""
    return parsed.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages"), F.count("section_id").alias("n_sections"), F.count("page_in_section").alias("n_numbers"), *[F.count_if(F.col("sure") == s).alias(f"n_{s}") for s in ("high", "medium", "low")])


def first_of(*plans: DataFrame) -> DataFrame:
    """Each page's row from the first plan that has one; the plans have the columns ``doc, page_index, id``."""
    out = plans[0].select(*PAGE, "id", F.lit(0).alias("plan"))
    for i, plan in enumerate(plans[1:], 1):
        out = out.unionByName(plan.select(*PAGE, "id", F.lit(i).alias("plan")))
    return out.groupBy(*PAGE).agg(F.min_by("id", "plan").alias("id"), F.min("plan").alias("plan"))


def failure_reason(message: Column) -> Column:
    """The kind of a locator's failure by words of its message."""
    low = F.lower(message)
    kinds = [("no text", "empty"), ("density", "too-sparse"), ("prefix", "unknown-prefix"), ("confidence", "low-confidence"), ("pattern", "no-match")]
    out = F.lit("other")
    for word, kind in reversed(kinds):
        out = F.when(F.contains(low, F.lit(word)), kind).otherwise(out)
    return out
