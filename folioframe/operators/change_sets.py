"""Change narratives as a whole: headings, drawing changes with notes, section changes with actions, and issues.

Pages are ``doc_id, page_number, text``; every operator is a set-based pass over
their lines, in which segments between stop lines take the place of a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .narrative import verb

DRAWINGS = r"(?i)REVISIONS?\s+TO\s+DRAWINGS?"
REISSUED = r"(?i)REVISED\s+AND\s+RE\s*[-]\s*ISSUED"
MANUAL = r"(?i)REVISIONS?\s+TO\s+(?:THE\s+)?(?:PROJECT\s+)?MANUAL"
SPECIFICATIONS = r"(?i)REVISIONS?\s+TO\s+SPECIFICATIONS?"
SHEET_ITEM = r"(?i)^\d+\.\s+SHEET\s*[-]\s*([A-Z]{1,3}[\d\s]*[.-][\d\s]+[A-Z]{0,3})\s+(.+)$"
PLAIN_ITEM = r"(?i)^(?:\d+\.\s+)?([A-Z]{1,3}\d{0,2}[-.]\d{1,3}(?:[A-Z]{0,3})?)\s+(.+)$"
NEXT_ITEM = r"(?i)^\d+\.\s+(?:SHEET|[A-Z]{1,3}\d)"
NOTE = r"(?i)^(?:[a-z]\.\s+|Formerly\s+named|Note:)"
SECTION = r"(?i)^SECTION\s+\d"
HEADER = r"(?i)^SECTION\s+(\d{1,2}\s*\d{1,2}\s*\d{1,2}|\d{6})(?:\s*[-:]\s*(.*))?$"
LOOSE_HEADER = r"(?i)^SECTION\s+((?:\d{1,2}\s*){3,6})(?:\s*[-:]\s*(.*))?$"
ISSUED_NEW = r"(?i)ISSUED\s+(?:NEW|FOR\s+THE\s+FIRST\s+TIME)"
LIST_ITEM = r"(?i)^\d+\.\s*(?:SHEET\b|[A-Z]{1,3}\d)"
END = r"(?i)^END\s+OF"
NOISE = (r"(?i)^Page\s+\d+\s+of\s+\d+", r"(?i)^ADDENDUM\s+\d+", r"(?i)Project\s+No\.?")


def is_drawings_start(line: Column) -> Column:
    """A line that begins the drawings part, or an item of its list."""
    return line.rlike(DRAWINGS) | line.rlike(REISSUED) | line.rlike(ISSUED_NEW) | line.rlike(LIST_ITEM)


def is_end_marker(line: Column) -> Column:
    return line.rlike(END)


def is_noise(line: Column, firms: tuple[str, ...] = ()) -> Column:
    """Page and addendum numbers, project numbers, names of ``firms`` and lines under three characters."""
    found = F.length(line) < 3
    for pattern in (*NOISE, *(rf"(?i)\Q{f}\E" for f in firms)):
        found = found | line.rlike(pattern)
    return found


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_no, line``: lines without surrounding space, numbered over the page."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line", F.btrim("line", F.lit(" \t\r")))


def find_headings(pages: DataFrame) -> DataFrame:
    """``doc_id, drawings_page, specs_page``: the first page of each part, null without one.

    The weaker of a part's two headings counts only where a document has no other.
    """

    found = pages.groupBy("doc_id").agg(*[_first_page(p).alias(n) for n, p in HEADINGS.items()])
    return found.select("doc_id", F.coalesce("a", "b").alias("drawings_page"), F.coalesce("c", "d").alias("specs_page"))


HEADINGS = {"a": DRAWINGS, "b": REISSUED, "c": MANUAL, "d": SPECIFICATIONS}


def _first_page(pattern: str) -> Column:
    return F.min(F.when(F.col("text").rlike(pattern), F.col("page_number")))


def _part(pages: DataFrame, start: str) -> DataFrame:
    # pages are looked through beside their document's other pages, so that they are made once for headings and lines
    document = Window.partitionBy("doc_id")
    first, second = (_first_page(HEADINGS[n]).over(document) for n in ("ab" if start == "drawings_page" else "cd"))
    begins = pages.where("doc_id IS NOT NULL").select("doc_id", "page_number", "text", F.coalesce(first, second).alias("start"))
    return page_lines(begins.where(F.col("page_number") >= F.col("start")))


def _sheet_raw(line: Column) -> Column:
    """The sheet of an item of the list, as written."""
    return F.trim(F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (SHEET_ITEM, PLAIN_ITEM)]))


def _sheet_id(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), r"\s", "")


def _is_note(line: Column) -> Column:
    return line.rlike(NOTE) & ~line.rlike(NEXT_ITEM)


def _header_code(line: Column) -> Column:
    """The digits of a section header, null for other lines."""
    digits = F.regexp_replace(F.regexp_extract(line, LOOSE_HEADER, 1), r"\s", "")
    strict = F.regexp_replace(F.regexp_extract(line, HEADER, 1), r"\s", "")
    return F.when(line.rlike(HEADER), strict).when(line.rlike(LOOSE_HEADER) & (F.length(digits) == 6), digits)


def _section_id(code: Column) -> Column:
    return F.when(F.length(code) == 6, F.concat_ws(" ", *[F.substring(code, i, 2) for i in (1, 3, 5)]))


def drawing_changes(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_no, sheet_raw, sheet_id, title, notes, change_type``.

    Items are numbered lines with ``SHEET``, or lines that begin with a sheet
    id.  Notes are lettered lines, and lines that begin with "Formerly named" or
    "Note:", below an item up to any other line that isn't blank.  All items of
    a document are ``revised_reissued`` when a line of the part says so.
    """
    lines = _part(pages, "drawings_page")
    line = F.col("line")
    page = Window.partitionBy("doc_id", "page_number").orderBy("line_no")
    title = F.when(line.rlike(SHEET_ITEM), F.regexp_extract(line, SHEET_ITEM, 2)).otherwise(F.regexp_extract(line, PLAIN_ITEM, 2))
    marked = lines.withColumns({"sheet_raw": _sheet_raw(line), "title": title, "is_note": _is_note(line)})
    marked = marked.withColumn("segment", F.sum(F.when((line == "") | F.col("is_note"), 0).otherwise(1)).over(page))
    told = line.rlike(REISSUED) & ((F.upper(line) == line) | line.rlike("(?i)^REVISED\\s+AND\\s+RE\\s*[-]\\s*ISSUED"))
    # over all lines of the document's part
    marked = marked.withColumn("told", F.max(told).over(Window.partitionBy("doc_id")))
    keys = ["doc_id", "page_number", "segment"]
    notes = marked.where("is_note").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("n"))
    items = marked.where("sheet_raw IS NOT NULL AND NOT is_note").join(notes, keys, "left")
    return items.select(
        "doc_id",
        "page_number",
        "line_no",
        "sheet_raw",
        _sheet_id(F.col("sheet_raw")).alias("sheet_id"),
        F.trim(F.regexp_replace("title", r"^[-–—]\s*", "")).alias("title"),
        F.array_join("n.line", "\n").alias("notes"),
        F.when(F.col("told"), "revised_reissued").otherwise("unknown").alias("change_type"),
    )


def _spec_blocks(pages: DataFrame) -> DataFrame:
    """Lines of the specs part with ``block``, which a section header, a drawings line or an end marker begins."""
    line = F.col("line")
    whole = Window.partitionBy("doc_id").orderBy("page_number", "line_no")
    stop = line.rlike(SECTION) | is_drawings_start(line) | is_end_marker(line)
    strict = line.rlike(HEADER)
    code = _header_code(line)
    header = code.isNotNull()
    title = F.when(strict, F.regexp_extract(line, HEADER, 2)).otherwise(F.regexp_extract(line, LOOSE_HEADER, 2))
    marked = _part(pages, "specs_page").withColumns({"block": F.sum(F.when(stop, 1).otherwise(0)).over(whole), "next_line": F.lead("line").over(whole)})
    return marked.withColumns({"is_header": header, "code": code, "own_title": F.when(header, F.trim(title))})


def spec_changes(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_no, section_id, title``: a row for each section header; an id without six digits is null.

    A title that isn't in the header is the next line, unless that is blank, a
    header, a number or a lettered item.
    """
    below = F.col("next_line")
    usable = (below != "") & ~below.rlike(SECTION) & ~below.rlike(r"^\d+$") & ~below.rlike(r"^[A-Z]\.\s")
    return _spec_blocks(pages).where("is_header").select(
        "doc_id",
        "page_number",
        "line_no",
        _section_id(F.col("code")).alias("section_id"),
        F.coalesce(F.nullif("own_title", F.lit("")), F.when(usable, below)).alias("title"),
    )


def spec_actions(pages: DataFrame, firms: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, section_id, page_number, line_no, verb, target``: the lines below each header, without noise."""
    lines = _spec_blocks(pages)
    block = Window.partitionBy("doc_id", "block")
    lines = lines.withColumn("of", F.max(F.when(F.col("is_header") & (F.length("code") == 6), F.col("code"))).over(block))
    stop = F.col("line").rlike(SECTION) | is_drawings_start(F.col("line")) | is_end_marker(F.col("line"))
    kept = lines.where(F.col("of").isNotNull() & ~stop & ~is_noise(F.col("line"), firms))
    action, target = verb(F.col("line")), F.regexp_extract("line", r":\s*(.+)$", 1)
    section = F.concat_ws(" ", *[F.substring("of", i, 2) for i in (1, 3, 5)])
    return kept.select(
        "doc_id", section.alias("section_id"), "page_number", "line_no", action.alias("verb"), F.when((action != "unknown") & (target != ""), target).alias("target")
    )


def narrative_issues(pages: DataFrame) -> DataFrame:
    """``doc_id, code, subject, n``: parts without items, ids that repeat, and section ids that can't be read.

    One pass over the pages: sheet items, section headers and headings are
    found on all of them, and then those of pages before their part left out.
    """
    # numbers stand for kinds, and a page's first line for its headings, as the sum of their bits
    sheets, sections, unread, headings = 1, 2, 3, 4
    bits = {n: headings << i for i, n in enumerate(HEADINGS)}
    told = sum((F.when(F.col("text").rlike(p), bits[n]).otherwise(0) for n, p in HEADINGS.items()), F.lit(0))
    lines = page_lines(pages.withColumn("doc_id", F.struct("doc_id", told.alias("told")))).select("doc_id.doc_id", "doc_id.told", "page_number", "line_no", "line")
    line = F.col("line")
    # of lines that don't begin like a header none is one
    code = F.when(F.upper(F.substring(line, 1, 7)) == "SECTION", _header_code(line))
    section = _section_id(F.col("header"))

    def item(kind: Column, subject: Column) -> Column:
        return F.struct(kind.alias("kind"), subject.cast("string").alias("subject"))

    found = F.array(
        F.when((F.col("line_no") == 0) & (F.col("told") > 0), item(F.col("told"), F.lit(None))),
        F.when(F.col("sheet").isNotNull(), item(F.lit(sheets), F.col("sheet"))),
        F.when(F.col("header").isNotNull(), item(F.when(section.isNull(), unread).otherwise(sections), section)),
    )
    items = lines.withColumns({"sheet": F.when(~_is_note(line), _sheet_id(_sheet_raw(line))), "header": code})
    items = items.select("doc_id", "page_number", F.explode(F.array_compact(found)).alias("item")).select("doc_id", "page_number", "item.*")
    kind, document = F.col("kind"), Window.partitionBy("doc_id")
    first = {n: F.min(F.when((kind >= headings) & (kind.bitwiseAND(b) > 0), F.col("page_number"))).over(document) for n, b in bits.items()}
    placed = items.withColumns({"drawings_page": F.coalesce(first["a"], first["b"]), "specs_page": F.coalesce(first["c"], first["d"])})
    inside = F.col("page_number") >= F.when(kind == sheets, F.col("drawings_page")).otherwise(F.col("specs_page"))
    kept = placed.where((kind >= headings) | (F.col("doc_id").isNotNull() & inside))
    # headings of a document become one row, which tells its parts: 4 drawings, 8 specifications
    parts = F.when(F.col("drawings_page").isNotNull(), 4).otherwise(0) + F.when(F.col("specs_page").isNotNull(), 8).otherwise(0)
    counted = kept.select("doc_id", F.when(kind >= headings, parts).otherwise(kind).alias("kind"), "subject").groupBy("doc_id", "kind", "subject").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumns({"has_sheet": F.max(kind == sheets).over(document), "has_section": F.max(kind == sections).over(document)})
    codes = F.array(
        F.when((kind >= headings) & (kind.bitwiseAND(4) > 0) & ~F.col("has_sheet"), "NARR_NO_DRAWINGS_PARSED"),
        F.when((kind >= headings) & (kind.bitwiseAND(8) > 0) & ~F.col("has_section"), "NARR_NO_SPECS_PARSED"),
        F.when((kind == sheets) & (F.col("n") > 1), "NARR_DUP_SHEET_ID"),
        F.when((kind == sections) & (F.col("n") > 1), "NARR_DUP_SECTION_ID"),
        F.when(kind == unread, "NARR_BAD_SECTION_ID"),
    )
    return counted.select("doc_id", F.explode(F.array_compact(codes)).alias("code"), "subject", F.when(kind >= headings, 0).otherwise(F.col("n")).cast("bigint").alias("n"))
