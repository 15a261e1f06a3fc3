"""Queries over locators, reports and workflows, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import geometry, locate, report
from . import views as v
from .catalog_ids import _norm_section
from .catalog_layout import _ROI_VALUES, ROIS
from .workflows import MergeWorkflow, OutlineWorkflow

_RE, _SHEET = ids.SECTION_PATTERN, ids.SHEET_PATTERN


def section_pages(s, d):
    """Page texts with one or two section ids, some in a sentence, some headed."""
    sec, key = v.v_sections(s, d), F.col("o_orderkey")
    text = F.concat(F.when(key % 2 == 0, "SECTION ").otherwise("refer to "), "code", F.lit(" - general requirements and more words here "), F.when(key % 3 == 0, F.col("code")).when(key % 3 == 1, F.lit("23 05 13")).otherwise(""))
    return sec.select(F.lit("d").alias("doc"), key.alias("page_index"), text.alias("text"))


PAGES = (
    v.SECTIONS
    + """, pages0 AS (SELECT 'd' AS doc, o_orderkey AS page_index, CASE WHEN o_orderkey % 2 = 0 THEN 'SECTION ' ELSE 'refer to ' END || code || ' - general requirements and more words here '
  || CASE o_orderkey % 3 WHEN 0 THEN code WHEN 1 THEN '23 05 13' ELSE '' END AS text FROM v_sections)"""
)
_CANDS = f"""found AS (SELECT doc, page_index, text, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT *, regexp_extract_all(text, '{_RE}') AS l FROM pages0)),
each AS (SELECT doc, page_index, {_norm_section('raw')} AS id, count(*) AS n, arg_min(raw, pos) AS raw, any_value(text) AS text FROM found GROUP BY 1, 2, 3),
cands AS (
  SELECT doc, page_index, id, n, least(100, greatest(0, 50 + CASE WHEN contains(upper(substr(text, greatest(instr(text, raw) - 50, 1), instr(text, raw) - greatest(instr(text, raw) - 50, 1))), 'SECTION') THEN 20 ELSE 0 END
    + CASE WHEN n >= 2 THEN 20 ELSE 0 END - CASE WHEN count(*) OVER (PARTITION BY doc, page_index) > 1 THEN 30 ELSE 0 END))::INTEGER AS confidence_pct FROM each WHERE NOT starts_with(id, '01 '))"""


def sheet_spans(s, d):
    """Spans with sheet ids and anchor words in place of some texts."""
    i, p = F.col("span_idx"), F.col("page_index")
    sheet = F.concat(v._pick(v.PREFIXES, (i + p) % 13), F.lit("-"), (i % 90 + 10).cast("string"))
    text = F.when(i % 5 == 0, sheet).when(i % 5 == 1, F.lit("SHEET NO.")).when(i % 15 == 2, F.concat(F.lit("REV-"), (i % 10).cast("string"))).otherwise(F.substring("text", 1, 20))
    x0 = F.when(i % 5 <= 1, F.lit(520.0)).otherwise(F.col("x0"))
    return v.v_spans(s, d).withColumns({"text": F.upper(text), "x0": x0, "x1": x0 + 60})


SHEET_SPANS = (
    v.SPANS
    + f""", ss AS (SELECT * REPLACE (upper(CASE WHEN span_idx % 5 = 0 THEN {v._sql_pick(v.PREFIXES, '(span_idx + page_index) % 13')} || '-' || (span_idx % 90 + 10) WHEN span_idx % 5 = 1 THEN 'SHEET NO.'
  WHEN span_idx % 15 = 2 THEN 'REV-' || (span_idx % 10) ELSE replace(substr(text, 1, 20), 'ß', 'SS') END) AS text, CASE WHEN span_idx % 5 <= 1 THEN 520.0::DOUBLE ELSE x0 END AS x0, CASE WHEN span_idx % 5 <= 1 THEN 580.0::DOUBLE ELSE x0 + 60 END AS x1) FROM v_spans)"""
)
_ID = f"regexp_replace(regexp_extract(text, '{_SHEET}'), '[ \\t\\r\\n\\f]+', '', 'g')"
_SHEETC = f"""found AS (SELECT *, {_ID} AS id FROM ss WHERE regexp_extract(text, '{_SHEET}') <> ''),
marks AS (SELECT doc, page_index, span_idx AS m_idx, x0 AS mx, y0 AS my FROM ss WHERE {' OR '.join(f"contains(text, '{w}')" for w in locate.ANCHOR_WORDS)}),
near AS (SELECT DISTINCT doc, page_index, span_idx FROM found JOIN marks USING (doc, page_index) WHERE span_idx <> m_idx AND (x0 - mx) * (x0 - mx) + (y0 - my) * (y0 - my) < 2500),
cands AS (
  SELECT f.doc, f.page_index, f.span_idx, f.id, f.x0, f.y0, n.doc IS NOT NULL AS near_anchor, least(100, greatest(0, 50 + CASE WHEN f.x0 / width >= 0.5 AND f.y0 / height >= 0.5 THEN 30 ELSE 0 END + CASE WHEN n.doc IS NOT NULL THEN 30 ELSE 0 END
    + CASE WHEN regexp_extract(f.id, '^([A-Z]+)', 1) IN ({', '.join(repr(p) for p in locate.KNOWN_PREFIXES)}) THEN 20 ELSE 0 END - CASE WHEN count(*) OVER (PARTITION BY f.doc, f.page_index, f.id) > 3 THEN 40 ELSE 0 END
    + CASE WHEN f.x0 / width >= 0.8 AND f.y0 / height >= 0.8 THEN 15 WHEN f.x0 / width < 0.5 AND f.y0 / height < 0.5 THEN -20 ELSE 0 END - CASE WHEN regexp_matches(f.text, '{locate.FALSE_ID}') THEN 50 ELSE 0 END))::INTEGER AS confidence_pct
  FROM found f LEFT JOIN near n USING (doc, page_index, span_idx))"""


def footers(s, d):
    f = v.v_footers(s, d)
    text = F.concat_ws(" ", F.col("section_id"), F.lit("- Title Words"), F.when(F.col("page_in_section").isNotNull(), F.concat(F.lit("Page "), F.col("page_in_section").cast("string"))))
    return f.select(F.col("doc_id").cast("string").alias("doc"), "page_index", text.alias("footer"))


def ordered_rois(s):
    return s.createDataFrame([(r[0], i) for i, r in enumerate(ROIS)], "roi string, roi_ord int")


def merge_pages(s, d):
    li = v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    source = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    sheet = F.concat(v._pick(v.PREFIXES, F.col("l_suppkey") % 13), F.lit("-"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    page = F.col("l_orderkey") % 100 * 10 + F.col("l_linenumber")
    return li.select(F.concat(F.expr("l_orderkey div 100").cast("string"), F.lit("/"), source.cast("string")).alias("doc"), F.expr("l_orderkey div 100").cast("long").alias("set_id"), source.alias("source"), (page * 10_000 + F.col("l_partkey") % 10_000).alias("page_index"), F.when(F.col("l_partkey") % 9 != 0, sheet).alias("id"), (F.col("l_partkey") % 100).cast("int").alias("confidence_pct"))


def messages(s, d):
    words = ["ROI empty", "fallback used", "unmatched page", "fine"]
    return v.v_footers(s, d).select(F.col("doc_id").alias("doc"), "page_index", v._pick(words, F.col("page_index") % 4).alias("message"))


def flags(s, d):
    return v.v_footers(s, d).select(F.col("doc_id").alias("doc"), F.col("section_id").isNotNull().alias("has_id"), F.col("page_in_section").isNotNull().alias("has_page"))


def queries():
    def placed(s, d):
        f = v.v_footers(s, d).withColumnRenamed("doc_id", "doc")
        wanted = f.select("doc", F.coalesce("section_id", F.concat(F.lit("99 00 "), F.lpad((F.col("page_index") % 4).cast("string"), 2, "0"))).alias("section_id")).distinct()
        foot = f.where("section_id IS NOT NULL AND page_index % 2 = 0").groupBy("doc", "section_id").agg(F.min("page_index").alias("first_page"))
        head = f.where("section_id IS NOT NULL AND page_index % 3 = 0").select("doc", "section_id", "page_index")
        hint = f.where("section_id IS NULL").select("doc", F.concat(F.lit("99 00 "), F.lpad((F.col("page_index") % 4).cast("string"), 2, "0")).alias("section_id"), "page_index").where("page_index % 4 < 2")
        return report.placed_sections(wanted, foot, head, hint)

    def in_rois(s, d):
        rois = s.createDataFrame(ROIS, "roi string, x double, y double, w double, h double")
        return locate.locate_in_rois(geometry.spans_in_rois(sheet_spans(s, d), rois), ordered_rois(s))

    return {
        "section_id_candidates": lambda s, d: locate.section_candidates(section_pages(s, d)),
        "section_id_best": lambda s, d: locate.best_section(section_pages(s, d)),
        "section_headings": lambda s, d: locate.headed_sections(section_pages(s, d).select("doc", "page_index", F.lit(0).alias("line_no"), F.when(F.col("page_index") % 4 == 0, F.concat(F.lit("see "), "text")).otherwise(F.col("text")).alias("line"))),
        "sheet_id_candidates": lambda s, d: locate.sheet_candidates(sheet_spans(s, d)).select("doc", "page_index", "span_idx", "id", "near_anchor", "confidence_pct"),
        "sheet_id_best": lambda s, d: locate.best_sheet(sheet_spans(s, d)),
        "sheet_id_in_rois": in_rois,
        "sheet_titles": lambda s, d: locate.sheet_titles(locate.sheet_candidates(sheet_spans(s, d)).where("confidence_pct >= 90"), sheet_spans(s, d)),
        "sheet_neighbours": lambda s, d: locate.neighbours(sheet_spans(s, d).where("span_idx < 40")),
        "sheet_id_tiers": lambda s, d: locate.first_of(in_rois(s, d), locate.best_sheet(sheet_spans(s, d))),
        "footer_parse": lambda s, d: locate.parse_footers(footers(s, d)),
        "footer_counters": lambda s, d: locate.footer_counters(locate.parse_footers(footers(s, d))),
        "failure_reasons": lambda s, d: messages(s, d).withColumn("message", F.concat("message", F.when(F.col("page_index") % 3 == 0, F.lit(": no text")).when(F.col("page_index") % 3 == 1, F.lit(": low confidence")).otherwise(F.lit("")))).groupBy(locate.failure_reason(F.col("message")).alias("reason")).agg(F.count(F.lit(1)).alias("n")),
        "merge_report": lambda s, d: report.merge_report(messages(s, d)),
        "font_summary": lambda s, d: report.font_summary(v.v_spans(s, d), 5),
        "headings_per_page": lambda s, d: report.headings_per_page(v.v_spans(s, d), v.v_spans(s, d).where("is_bold AND font_size >= 14")),
        "profile_gates": lambda s, d: report.validate_profile(flags(s, d), {"has_id": 0.8, "has_page": 0.7}),
        "profile_best": lambda s, d: report.best_profile(flags(s, d).groupBy("doc").agg(F.avg(F.col("has_id").cast("double")).alias("a"), F.avg(F.col("has_page").cast("double")).alias("b")).selectExpr("doc", "stack(2, 'ids', a, 'pages', b) AS (profile, confidence)")),
        "section_placement": placed,
        "outline_hoisted": lambda s, d: report.hoist_unanchored(v.v_outline(s, d).withColumn("anchor", F.when((F.col("level") != 1) | (F.col("ord") % 3 != 0), F.col("node_id")))).select("node_id", "parent_id"),
        "dimension_order": lambda s, d: report.ordered_dimension(v.table(s, d, "nation").select("n_name"), "n_name"),
        "workflow_merge": lambda s, d: MergeWorkflow(merge_pages(s, d)).analyze().plan,
        "workflow_merge_copies": lambda s, d: (lambda w: w.execute(w.analyze()))(MergeWorkflow(merge_pages(s, d))),
        "workflow_merge_summary": lambda s, d: MergeWorkflow(merge_pages(s, d)).analyze().summary,
        "workflow_outline": lambda s, d: OutlineWorkflow(v.v_outline(s, d), 30, 2).analyze().select("node_id", "parent_id", "title", "is_valid"),
    }


def oracle_sql():
    pages, spans, foot, sheet = v.with_sql(PAGES, _CANDS), v.with_sql(v.SPANS), v.with_sql(v.FOOTERS), v.with_sql(SHEET_SPANS, _SHEETC)
    left, right, top, bottom = "x * width", "least(1.0, x + w) * width", "greatest(0.0, 1 - y - h) * height", "least(1.0, 1 - y) * height"
    rois = f"""hits AS (
  SELECT s.doc, s.page_index, span_idx, r.roi, o, x0, y0, {_ID} AS id FROM ss s, (SELECT *, row_number() OVER () - 1 AS o FROM (VALUES {_ROI_VALUES}) r(roi, x, y, w, h)) r
  WHERE x0 >= {left} AND x1 <= {right} AND y0 >= {top} AND y1 <= {bottom} AND regexp_extract(text, '{_SHEET}') <> ''),
scored AS (SELECT *, (length(id) + CASE WHEN regexp_matches(id, '[A-Z]$') THEN 15 ELSE 0 END + CASE WHEN regexp_matches(id, '[-.]') THEN 5 ELSE 0 END - CASE WHEN length(id) < 4 THEN 20 ELSE 0 END)::INTEGER AS score FROM hits),
in_rois AS (SELECT doc, page_index, id, roi, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc, page_index ORDER BY o, score DESC, y0 DESC, x0 DESC, span_idx) = 1)"""
    best = "best AS (SELECT doc, page_index, id, confidence_pct, CASE WHEN confidence_pct >= 75 THEN 'ok' ELSE 'warn' END AS verdict FROM (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY doc, page_index ORDER BY confidence_pct DESC, span_idx) = 1) WHERE confidence_pct >= 60)"
    parsed = """parsed AS (
  SELECT doc_id::VARCHAR AS doc, page_index, section_id, page_in_section, CASE WHEN section_id IS NOT NULL THEN 'Title Words' END AS title,
    CASE WHEN section_id IS NOT NULL AND page_in_section IS NOT NULL THEN 'high' WHEN section_id IS NOT NULL OR page_in_section IS NOT NULL THEN 'medium' ELSE 'low' END AS sure FROM v_footers)"""
    msg = "msg AS (SELECT doc_id AS doc, page_index, ['ROI empty', 'fallback used', 'unmatched page', 'fine'][page_index % 4 + 1] AS message FROM v_footers)"
    return {
        "section_id_candidates": f"{pages}\nSELECT * FROM cands",
        "section_id_best": f"{pages}\nSELECT doc, page_index, id, confidence_pct FROM (SELECT * FROM cands QUALIFY row_number() OVER (PARTITION BY doc, page_index ORDER BY confidence_pct DESC, id) = 1) WHERE confidence_pct >= 50",
        "section_headings": f"""{v.with_sql(PAGES)}
SELECT doc, page_index, 0 AS line_no, {_norm_section(f"regexp_extract(text, 'SECTION[ ]+({_RE})', 1)")} AS section_id FROM pages0 WHERE page_index % 4 <> 0 AND regexp_matches(text, 'SECTION[ ]+{_RE}')""",
        "sheet_id_candidates": f"{sheet}\nSELECT doc, page_index, span_idx, id, near_anchor, confidence_pct FROM cands",
        "sheet_id_best": f"{sheet},\n{best}\nSELECT * FROM best",
        "sheet_id_in_rois": f"{v.with_sql(SHEET_SPANS)},\n{rois}\nSELECT * FROM in_rois",
        "sheet_titles": f"""{sheet},
at_ AS (SELECT doc, page_index, span_idx AS id_idx, x0 AS ix, y0 AS iy FROM cands WHERE confidence_pct >= 90),
near2 AS (SELECT s.*, id_idx, ix, iy, (x0 - ix) * (x0 - ix) + (y0 - iy) * (y0 - iy) AS dd FROM ss s JOIN at_ USING (doc, page_index) WHERE span_idx <> id_idx AND trim(text) <> '' AND NOT regexp_full_match(text, '{_SHEET}')),
top AS (SELECT * FROM near2 WHERE dd < 40000 QUALIFY row_number() OVER (PARTITION BY doc, page_index, id_idx ORDER BY (y0 > iy)::INTEGER, dd, span_idx) <= 5),
t AS (SELECT doc, page_index, id_idx AS span_idx, string_agg(text, ' ' ORDER BY y0, x0, span_idx) AS title FROM top GROUP BY doc, page_index, id_idx)
SELECT doc, page_index, span_idx, CASE WHEN length(title) > 60 THEN substr(title, 1, 60) || '...' ELSE title END AS title FROM t""",
        "sheet_neighbours": f"""{v.with_sql(SHEET_SPANS)},
few AS (SELECT * FROM ss WHERE span_idx < 40),
pairs AS (
  SELECT a.doc, a.page_index, a.span_idx, b.span_idx AS o_idx, a.text || b.text AS merged, abs(b.y0 - a.y0) AS dy, abs(b.x0 - a.x1) AS dx FROM few a JOIN few b USING (doc, page_index)
  WHERE a.span_idx <> b.span_idx AND ((abs(b.y0 - a.y0) <= 10 AND b.x0 - a.x1 BETWEEN 0 AND 50) OR (b.y0 - a.y0 BETWEEN 0.001 AND 30 AND abs(b.x0 - a.x0) <= 10)))
SELECT doc, page_index, span_idx, o_idx, merged FROM pairs QUALIFY row_number() OVER (PARTITION BY doc, page_index, span_idx ORDER BY dy, dx, o_idx) = 1""",
        "sheet_id_tiers": f"""{sheet},\n{best},\n{rois}
SELECT doc, page_index, arg_min(id, plan) AS id, min(plan)::INTEGER AS plan FROM (SELECT doc, page_index, id, 0 AS plan FROM in_rois UNION ALL SELECT doc, page_index, id, 1 FROM best) GROUP BY 1, 2""",
        "footer_parse": f"{foot},\n{parsed}\nSELECT * FROM parsed",
        "footer_counters": f"{foot},\n{parsed}\nSELECT doc, count(*) AS n_pages, count(section_id) AS n_sections, count(page_in_section) AS n_numbers, count(*) FILTER (sure = 'high') AS n_high, count(*) FILTER (sure = 'medium') AS n_medium, count(*) FILTER (sure = 'low') AS n_low FROM parsed GROUP BY 1",
        "failure_reasons": f"{foot}\nSELECT ['empty', 'low-confidence', 'other'][page_index % 3 + 1] AS reason, count(*) AS n FROM v_footers GROUP BY 1",
        "merge_report": f"""{foot},\n{msg}
SELECT doc, count(*) AS n, count(*) FILTER (message LIKE '%ROI%' AND page_index < 2) AS n_notices, count(*) FILTER (message LIKE '%ROI%' AND page_index >= 2) AS n_roi, count(*) FILTER (message LIKE '%fallback%') AS n_fallbacks, count(*) FILTER (message LIKE '%unmatched%') AS n_unmatched FROM msg GROUP BY 1""",
        "font_summary": f"""{spans}
SELECT doc, font_name, font_size, n, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, font_name, font_size) AS place FROM (SELECT doc, font_name, font_size, count(*) AS n FROM v_spans GROUP BY 1, 2, 3)) WHERE place <= 5""",
        "headings_per_page": f"{spans}\nSELECT doc, page_index, count(*) FILTER (is_bold AND font_size >= 14) AS n_headings FROM v_spans GROUP BY 1, 2",
        "profile_gates": f"""{foot},
a AS (SELECT doc_id AS doc, count(*) AS n_pages, avg((section_id IS NOT NULL)::INTEGER::DOUBLE) AS share_has_id, avg((page_in_section IS NOT NULL)::INTEGER::DOUBLE) AS share_has_page FROM v_footers GROUP BY 1)
SELECT *, share_has_id >= 0.8 AS pass_has_id, share_has_page >= 0.7 AS pass_has_page, share_has_id >= 0.8 AND share_has_page >= 0.7 AS passes FROM a""",
        "profile_best": f"""{foot},
a AS (SELECT doc_id AS doc, avg((section_id IS NOT NULL)::INTEGER::DOUBLE) AS a, avg((page_in_section IS NOT NULL)::INTEGER::DOUBLE) AS b FROM v_footers GROUP BY 1)
SELECT doc, CASE WHEN a >= b THEN 'ids' ELSE 'pages' END AS profile, greatest(a, b) AS confidence FROM a WHERE greatest(a, b) >= 0.7""",
        "section_placement": f"""{foot},
f AS (SELECT doc_id AS doc, page_index, section_id, '99 00 ' || lpad((page_index % 4)::VARCHAR, 2, '0') AS other FROM v_footers),
wanted AS (SELECT DISTINCT doc, coalesce(section_id, other) AS section_id FROM f),
foot AS (SELECT doc, section_id, min(page_index) AS p FROM f WHERE section_id IS NOT NULL AND page_index % 2 = 0 GROUP BY 1, 2), var AS (SELECT doc, regexp_replace(section_id, '^01 ', '') AS section_id, min(p) AS p FROM foot GROUP BY 1, 2),
head AS (SELECT doc, section_id, min(page_index) AS p FROM f WHERE section_id IS NOT NULL AND page_index % 3 = 0 GROUP BY 1, 2), hint AS (SELECT doc, other AS section_id, min(page_index) AS p FROM f WHERE section_id IS NULL AND page_index % 4 < 2 GROUP BY 1, 2)
SELECT w.doc, w.section_id, coalesce(a.p, b.p, c.p, e.p) AS page_index, CASE WHEN a.p IS NOT NULL THEN 'by_footer' WHEN b.p IS NOT NULL THEN 'by_variant' WHEN c.p IS NOT NULL THEN 'by_heading' WHEN e.p IS NOT NULL THEN 'by_hint' ELSE 'invalid' END AS way
FROM wanted w LEFT JOIN foot a USING (doc, section_id) LEFT JOIN var b USING (doc, section_id) LEFT JOIN head c USING (doc, section_id) LEFT JOIN hint e USING (doc, section_id)""",
        "outline_hoisted": f"""{v.with_sql(v.OUTLINE)},
e AS (SELECT *, level = 1 AND ord % 3 = 0 AS gone FROM v_outline)
SELECT c.node_id, CASE WHEN p.gone THEN p.parent_id ELSE c.parent_id END AS parent_id FROM e c LEFT JOIN e p ON c.parent_id = p.node_id WHERE NOT c.gone""",
        "dimension_order": "SELECT n_name, row_number() OVER (ORDER BY n_name) * 10 AS sort_order FROM nation",
        "workflow_outline": f"""{v.with_sql(v.OUTLINE)},
t AS (SELECT *, trim(regexp_replace(title, '[ ]+', ' ', 'g')) AS t FROM v_outline WHERE level <= 2)
SELECT node_id, parent_id, t AS title, page_index < 30 AS is_valid FROM t QUALIFY row_number() OVER (PARTITION BY parent_id, t ORDER BY ord, node_id) = 1""",
    }
