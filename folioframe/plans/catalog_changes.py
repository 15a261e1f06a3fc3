"""Queries over whole change narratives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import change_sets as c
from . import views as v


def v_change_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A narrative of two pages for each order: drawings on the first, and specifications on the second of every other one."""
    sheet = F.concat(v._pick(v.PREFIXES, F.col("l_suppkey") % 13), F.col("l_linenumber").cast("string"), F.lit("-"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    number = F.col("l_linenumber").cast("string")
    item = (
        F.when(F.col("l_partkey") % 3 == 0, F.concat(number, F.lit(". SHEET - "), sheet, F.lit(" PLAN\na. Formerly named OLD\n\nNote: see plan\nother line\nb. not a note of it")))
        .when(F.col("l_partkey") % 3 == 1, F.concat(number, F.lit(". "), sheet, F.lit(" - Detail  ")))
        .otherwise(F.concat(F.lit("  "), sheet, F.lit("a View\n")))
    )
    lines = v.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", item.alias("item")).alias("row"))
    items = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    orders = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 50).alias("c"))
    joined = orders.join(items, "doc_id", "left")
    key = F.col("doc_id")
    code = F.concat(F.lpad(F.col("c").cast("string"), 2, "0"), F.lit(" "), F.lpad((key % 100).cast("string"), 2, "0"))
    first = F.concat(F.lit("Revisions to  Drawings\n"), F.when(key % 3 == 0, "REVISED AND RE - ISSUED\n").otherwise("Some sheets are revised and re-issued.\n"), F.coalesce(F.array_join("rows.item", "\n"), F.lit("")))
    second = F.concat(
        F.when(key % 4 == 0, "REVISION TO THE PROJECT MANUAL\n").otherwise("Revisions to Specifications\n"), F.lit("SECTION "), code, F.lit(" 00 - TITLE\n1. Delete paragraph 2.1: A\nPage 1 of 3\n2. Coordinate with others\nEND OF SECTION\nafter it\nSECTION 0031 2 1\nGENERAL\nRevise the table: "), code,
        F.lit("\nSECTION 1 2 3\nAdd it\nsection "), F.when(key % 5 == 0, F.concat(code, F.lit(" 00"))).otherwise(F.lit("260500: Power")), F.lit("\nInsert after 2.1"),
    )
    pages = F.array(F.struct(F.lit(1).alias("page_number"), first.alias("text")), F.struct(F.lit(2).alias("page_number"), F.when(key % 2 == 0, second).otherwise("nothing more").alias("text")))
    return joined.select("doc_id", F.explode(pages).alias("p")).select("doc_id", "p.page_number", "p.text")


_NL = "chr(10)"
PAGES = f"""items AS (
  SELECT l_orderkey AS doc_id, string_agg(CASE l_partkey % 3
    WHEN 0 THEN l_linenumber || '. SHEET - ' || sheet || ' PLAN' || {_NL} || 'a. Formerly named OLD' || {_NL} || {_NL} || 'Note: see plan' || {_NL} || 'other line' || {_NL} || 'b. not a note of it'
    WHEN 1 THEN l_linenumber || '. ' || sheet || ' - Detail  ' ELSE '  ' || sheet || 'a View' || {_NL} END, {_NL} ORDER BY l_linenumber, l_partkey, l_suppkey) AS text
  FROM (SELECT *, {v._sql_pick(v.PREFIXES, 'l_suppkey % 13')} || l_linenumber || '-' || lpad((l_partkey % 100)::VARCHAR, 2, '0') AS sheet FROM lineitem) GROUP BY 1),
codes AS (SELECT o_orderkey AS doc_id, lpad((o_custkey % 50)::VARCHAR, 2, '0') || ' ' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') AS code FROM orders),
pages AS (
  SELECT doc_id, 1 AS page_number, 'Revisions to  Drawings' || {_NL} || CASE WHEN doc_id % 3 = 0 THEN 'REVISED AND RE - ISSUED' ELSE 'Some sheets are revised and re-issued.' END || {_NL} || coalesce(text, '') AS text FROM codes LEFT JOIN items USING (doc_id)
  UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 <> 0 THEN 'nothing more' ELSE CASE WHEN doc_id % 4 = 0 THEN 'REVISION TO THE PROJECT MANUAL' ELSE 'Revisions to Specifications' END || {_NL} || 'SECTION ' || code || ' 00 - TITLE' || {_NL} ||
    '1. Delete paragraph 2.1: A' || {_NL} || 'Page 1 of 3' || {_NL} || '2. Coordinate with others' || {_NL} || 'END OF SECTION' || {_NL} || 'after it' || {_NL} || 'SECTION 0031 2 1' || {_NL} || 'GENERAL' || {_NL} || 'Revise the table: ' || code || {_NL} ||
    'SECTION 1 2 3' || {_NL} || 'Add it' || {_NL} || 'section ' || CASE WHEN doc_id % 5 = 0 THEN code || ' 00' ELSE '260500: Power' END || {_NL} || 'Insert after 2.1' END FROM codes),
heads AS (
  SELECT doc_id, coalesce(min(page_number) FILTER (regexp_matches(text, '{c.DRAWINGS}')), min(page_number) FILTER (regexp_matches(text, '{c.REISSUED}'))) AS drawings_page,
    coalesce(min(page_number) FILTER (regexp_matches(text, '{c.MANUAL}')), min(page_number) FILTER (regexp_matches(text, '{c.SPECIFICATIONS}'))) AS specs_page FROM pages GROUP BY 1),
lines AS (
  SELECT doc_id, page_number, i::INTEGER AS line_no, trim(parts[i + 1], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT *, unnest(range(len(parts))) AS i FROM (SELECT doc_id, page_number, string_split(text, {_NL}) AS parts FROM pages)))"""
DRAWINGS = f"""noted AS (
  SELECT l.*, regexp_matches(line, '{c.NOTE}') AND NOT regexp_matches(line, '{c.NEXT_ITEM}') AS is_note,
    CASE WHEN regexp_matches(line, '{c.SHEET_ITEM}') THEN '{c.SHEET_ITEM}' WHEN regexp_matches(line, '{c.PLAIN_ITEM}') THEN '{c.PLAIN_ITEM}' END AS p,
    max(regexp_matches(line, '{c.REISSUED}') AND (upper(line) = line OR regexp_matches(line, '(?i)^REVISED\\s+AND\\s+RE\\s*[-]\\s*ISSUED'))) OVER (PARTITION BY doc_id) AS told
  FROM lines l JOIN heads USING (doc_id) WHERE page_number >= drawings_page),
segmented AS (SELECT *, sum(CASE WHEN line = '' OR is_note THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_number ORDER BY line_no) AS segment FROM noted),
notes AS (SELECT doc_id, page_number, segment, string_agg(line, {_NL} ORDER BY line_no) AS notes FROM segmented WHERE is_note GROUP BY 1, 2, 3),
found AS (
  SELECT *, trim(CASE WHEN p = '{c.SHEET_ITEM}' THEN regexp_extract(line, '{c.SHEET_ITEM}', 1) ELSE regexp_extract(line, '{c.PLAIN_ITEM}', 1) END) AS sheet_raw,
    CASE WHEN p = '{c.SHEET_ITEM}' THEN regexp_extract(line, '{c.SHEET_ITEM}', 2) ELSE regexp_extract(line, '{c.PLAIN_ITEM}', 2) END AS t
  FROM segmented WHERE p IS NOT NULL AND NOT is_note),
drawings AS (
  SELECT doc_id, page_number, line_no, sheet_raw, regexp_replace(upper(sheet_raw), '\\s', '', 'g') AS sheet_id, trim(regexp_replace(t, '^[-–—]\\s*', '')) AS title, notes, CASE WHEN told THEN 'revised_reissued' ELSE 'unknown' END AS change_type
  FROM found LEFT JOIN notes USING (doc_id, page_number, segment))"""
_STOP = " OR ".join(f"regexp_matches(line, '{p}')" for p in (c.SECTION, c.DRAWINGS, c.REISSUED, c.ISSUED_NEW, c.LIST_ITEM, c.END))
SPECS = f"""headed AS (
  SELECT doc_id, page_number, line_no, line, {_STOP} AS stop, lead(line) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS below, regexp_matches(line, '{c.HEADER}') AS strict,
    regexp_replace(CASE WHEN regexp_matches(line, '{c.HEADER}') THEN regexp_extract(line, '{c.HEADER}', 1) ELSE regexp_extract(line, '{c.LOOSE_HEADER}', 1) END, '\\s', '', 'g') AS code,
    trim(CASE WHEN regexp_matches(line, '{c.HEADER}') THEN regexp_extract(line, '{c.HEADER}', 2) ELSE regexp_extract(line, '{c.LOOSE_HEADER}', 2) END) AS own_title
  FROM lines JOIN heads USING (doc_id) WHERE page_number >= specs_page),
blocks AS (SELECT *, strict OR length(code) = 6 AS is_header, sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS block FROM headed),
specs AS (
  SELECT doc_id, page_number, line_no, CASE WHEN length(code) = 6 THEN code[1:2] || ' ' || code[3:4] || ' ' || code[5:6] END AS section_id,
    CASE WHEN own_title <> '' THEN own_title WHEN below <> '' AND NOT regexp_matches(below, '{c.SECTION}') AND NOT regexp_matches(below, '^\\d+$') AND NOT regexp_matches(below, '^[A-Z]\\.\\s') THEN below END AS title
  FROM blocks WHERE is_header)"""


def queries() -> dict:
    def over(operator):
        return lambda s, d: operator(v_change_pages(s, d))

    return {
        "narr_headings": over(c.find_headings),
        "narr_drawings": over(c.drawing_changes),
        "narr_specs": over(c.spec_changes),
        "narr_spec_actions": over(c.spec_actions),
        "narr_issues": over(c.narrative_issues),
    }


def oracle_sql() -> dict[str, str]:
    word = "(^|[^0-9a-z_]){}([^0-9a-z_]|$)"
    has = lambda w: f"regexp_matches(lower(line), '{word.format(w)}')"
    noise = " OR ".join(f"regexp_matches(line, '{p}')" for p in c.NOISE)
    return {
        "narr_headings": f"{v.with_sql(PAGES)}\nSELECT * FROM heads",
        "narr_drawings": f"{v.with_sql(PAGES, DRAWINGS)}\nSELECT * FROM drawings",
        "narr_specs": f"{v.with_sql(PAGES, SPECS)}\nSELECT * FROM specs",
        "narr_spec_actions": f"""{v.with_sql(PAGES, SPECS)},
owned AS (SELECT *, max(CASE WHEN is_header AND length(code) = 6 THEN code END) OVER (PARTITION BY doc_id, block) AS owner FROM blocks),
told AS (
  SELECT *, CASE WHEN {has('delete')} THEN 'delete' WHEN regexp_matches(lower(line), '^([0-9]+[.][ ]*)?add[ ]+') OR contains(lower(line), 'has been added') THEN 'add' WHEN {has('insert')} THEN 'add' WHEN {has('replace')} THEN 'replace'
    WHEN {has('adjust')} OR {has('revise')} OR {has('revised')} OR {has('re[ ]*-[ ]*issued')} OR {has('reissued')} THEN 'revise' ELSE 'unknown' END AS verb
  FROM owned WHERE owner IS NOT NULL AND NOT stop AND length(line) >= 3 AND NOT ({noise}))
SELECT doc_id, owner[1:2] || ' ' || owner[3:4] || ' ' || owner[5:6] AS section_id, page_number, line_no, verb, CASE WHEN verb <> 'unknown' THEN nullif(regexp_extract(line, ':\\s*(.+)$', 1), '') END AS target FROM told""",
        "narr_issues": f"""{v.with_sql(PAGES, DRAWINGS, SPECS)}
SELECT doc_id, 'NARR_DUP_SHEET_ID' AS code, sheet_id AS subject, count(*) AS n FROM drawings GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT doc_id, 'NARR_DUP_SECTION_ID', section_id, count(*) FROM specs WHERE section_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT doc_id, 'NARR_BAD_SECTION_ID', NULL, count(*) FROM specs WHERE section_id IS NULL GROUP BY 1
UNION ALL SELECT doc_id, 'NARR_NO_DRAWINGS_PARSED', NULL, 0 FROM heads WHERE drawings_page IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM drawings)
UNION ALL SELECT doc_id, 'NARR_NO_SPECS_PARSED', NULL, 0 FROM heads WHERE specs_page IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM specs WHERE section_id IS NOT NULL)""",
    }
