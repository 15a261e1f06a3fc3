"""Queries over sequences of pages and over span layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, geometry, sequence
from . import views as v

ROIS = [("title", 0.6, 0.0, 0.4, 0.25), ("head", 0.0, 0.85, 1.0, 0.15), ("left", 0.0, 0.0, 0.3, 1.0)]
_ROI_VALUES = ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for n, x, y, w, h in ROIS)

_REPAIRED = """repaired AS (
  SELECT *, coalesce(section_id, before, after) AS repaired_id,
    CASE WHEN section_id IS NOT NULL THEN 'none' WHEN before = after THEN 'both-neighbours' WHEN before IS NOT NULL THEN 'previous' WHEN after IS NOT NULL THEN 'next' ELSE 'unresolved' END AS repair
  FROM (SELECT *, last_value(section_id IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    lead(section_id) OVER (PARTITION BY doc_id ORDER BY page_index) AS after FROM v_footers))"""


def _runs_sql(source: str, doc: str, order: str, value: str, page_no: str | None) -> str:
    back = f"coalesce({page_no} = 1 AND lag({page_no}) OVER w > 1, FALSE)" if page_no else "FALSE"
    w = f"(PARTITION BY {doc} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""events AS (
  SELECT *, CASE WHEN {value} IS NOT NULL THEN '=' || {value} WHEN back THEN 'end' END AS event FROM (SELECT *, {back} AS back FROM {source} WINDOW w AS (PARTITION BY {doc} ORDER BY {order}))),
states AS (
  SELECT *, last_value(event IGNORE NULLS) OVER {w} 1 PRECEDING) AS event_before, last_value(event IGNORE NULLS) OVER {w} CURRENT ROW) AS event_now, last_value({value} IGNORE NULLS) OVER {w} CURRENT ROW) AS latest FROM events),
marked AS (
  SELECT *, CASE WHEN event_now <> 'end' THEN sum(CASE WHEN {value} IS NOT NULL AND (back OR event IS DISTINCT FROM event_before) THEN 1 ELSE 0 END) OVER {w} CURRENT ROW) END::BIGINT AS run_no,
    CASE WHEN event_now <> 'end' THEN latest END AS run_value FROM states)"""


def _run_rows(doc, order, value):
    return f"SELECT {doc}, run_no, run_value AS {value}, min({order}) AS start_page, max({order}) AS end_page, count(*) AS page_count FROM marked WHERE run_no IS NOT NULL GROUP BY {doc}, run_no, run_value"


CANON = (
    v.SPANS
    + """,
turned AS (
  SELECT * REPLACE (
    CASE rotation WHEN 90 THEN height - y1 WHEN 180 THEN width - x1 WHEN 270 THEN y0 ELSE x0 END AS x0, CASE rotation WHEN 90 THEN x0 WHEN 180 THEN height - y1 WHEN 270 THEN width - x1 ELSE y0 END AS y0,
    CASE rotation WHEN 90 THEN height - y0 WHEN 180 THEN width - x0 WHEN 270 THEN y1 ELSE x1 END AS x1, CASE rotation WHEN 90 THEN x1 WHEN 180 THEN height - y0 WHEN 270 THEN width - x0 ELSE y1 END AS y1,
    CASE WHEN rotation IN (90, 270) THEN height ELSE width END AS width, CASE WHEN rotation IN (90, 270) THEN width ELSE height END AS height, 0 AS rotation)
  FROM v_spans),
canon AS (
  SELECT *, 'page' || page_index || '_span' || rank AS span_key FROM (
    SELECT *, row_number() OVER (PARTITION BY doc, page_index ORDER BY y0, x0, span_idx) - 1 AS rank FROM turned))"""
)


def _hash_sql(head: str, line: str, name: str) -> str:
    return f"""{v.with_sql(CANON)},
pages AS (SELECT doc, page_index, sha256(min({head}) || ',' || count(*) || chr(10) || string_agg({line}, chr(10) ORDER BY rank)) AS h FROM canon GROUP BY 1, 2)
SELECT doc, sha256(string_agg(h, chr(10) ORDER BY page_index)) AS {name} FROM pages GROUP BY 1"""


_NUM = " || '|' || ".join(f"{c}::DECIMAL(18,6)" for c in ("x0", "y0", "x1", "y1"))

_PAGES = "n_pages AS (SELECT doc, count(DISTINCT page_index) AS n FROM v_spans GROUP BY 1)"


def _half(x: str) -> str:
    return f"floor({x} + 0.5)"


def _band_pages(kind: str) -> str:
    at, inside = ("y0", "y0 < 0.15 * height") if kind == "header" else ("y1", "y1 > 0.85 * height")
    return f"{kind}_pages AS (SELECT DISTINCT doc, page_index, ({_half(at + ' / 10')} * 10)::BIGINT AS band FROM v_spans WHERE {inside})"


def _recurring(source: str, key: str) -> str:
    return f"""SELECT doc, {key}, count(*) AS n_on, string_agg(page_index::VARCHAR, ',' ORDER BY page_index) AS page_list, least(1.0::DOUBLE, count(*) / any_value(n)::DOUBLE) AS confidence
  FROM {source} JOIN n_pages USING (doc) GROUP BY doc, {key} HAVING count(*) >= 2"""


_BANDS = ",\n".join(f"{_band_pages(k)},\n{k}s AS ({_recurring(k + '_pages', 'band')})" for k in ("header", "footer"))

_CHROME = (
    _BANDS
    + """,
sure_h AS (SELECT DISTINCT doc, page_index FROM header_pages SEMI JOIN (SELECT * FROM headers WHERE confidence >= 0.5) USING (doc, band)),
sure_f AS (SELECT DISTINCT doc, page_index FROM footer_pages SEMI JOIN (SELECT * FROM footers WHERE confidence >= 0.5) USING (doc, band)),
flagged AS (
  SELECT s.*, (h.doc IS NOT NULL AND (y0 + y1) / 2 < 0.15 * height + 20) OR (f.doc IS NOT NULL AND (y0 + y1) / 2 > 0.85 * height - 20) AS in_chrome
  FROM v_spans s LEFT JOIN sure_h h USING (doc, page_index) LEFT JOIN sure_f f USING (doc, page_index))"""
)


def _headings_sql() -> str:
    rejected = "((y0 + y1) / 2 > 0.15 * height + 0.75 * 0.7 * height OR regexp_matches(trim(text), '(?i)(^|[^0-9A-Za-z_])(DIVISION|DIV)[ ]+01([^0-9A-Za-z_]|$)'))"
    cases = []
    for i, (pattern, _, _) in enumerate(detect.HEADINGS):
        p = "(?i)" + pattern.replace("(?i)", "") if "(?i)" in pattern else pattern
        cases.append(f"WHEN regexp_matches(trim(text), '{p}'){' AND NOT ' + rejected if i == 0 else ''} THEN {i + 1}")
    levels, scores = (", ".join(str(h[k]) for h in detect.HEADINGS) for k in (1, 2))
    return f"""{v.with_sql(v.SPANS.replace("v_spans AS", "plain_spans AS") + _HEADED, _PAGES, _CHROME)},
likely AS (SELECT *, CASE {' '.join(cases)} END AS k FROM flagged WHERE (font_size >= 12 OR is_bold) AND NOT in_chrome)
SELECT doc, page_index, span_idx, trim(text) AS heading, [{levels}][k]::INTEGER AS level,
  least(100, [{scores}][k] + CASE WHEN is_bold THEN 10 ELSE 0 END + CASE WHEN font_size >= 14 THEN 10 ELSE 0 END)::INTEGER AS confidence_pct FROM likely WHERE k IS NOT NULL"""


_QUALITY = """ranked AS (
  SELECT doc, page_index, row_number() OVER (PARTITION BY doc, page_index ORDER BY span_idx) - row_number() OVER (PARTITION BY doc, page_index ORDER BY floor(y0 / 5), x0, span_idx) AS d FROM v_spans),
sanity AS (SELECT doc, page_index, count(*) AS n_spans, count(*) FILTER (abs(d) <= 2) AS n_in_place FROM ranked GROUP BY 1, 2),
sums AS (
  SELECT doc, page_index, sum(length(text))::BIGINT AS n_chars, sum(length(text) - length(regexp_replace(text, '[ \\t\\r\\n\\f]', '', 'g')))::BIGINT AS n_white,
    sum(length(text) - length(replace(text, chr(65533), '')))::BIGINT AS n_replaced FROM v_spans GROUP BY 1, 2),
base AS (
  SELECT *, n_chars = 0 OR n_replaced / n_chars::DOUBLE > 0.05 OR n_chars < 50 AS ocr_needed,
    CASE WHEN n_chars = 0 THEN 0.0 WHEN n_spans <= 1 THEN 1.0 ELSE n_in_place / n_spans::DOUBLE END::DOUBLE AS ordering_sanity, CASE WHEN n_chars = 0 THEN 0.0 ELSE n_white / n_chars::DOUBLE END::DOUBLE AS white_ratio
  FROM sums JOIN sanity USING (doc, page_index)),
quality AS (
  SELECT doc, page_index, n_chars, n_white, n_replaced, ocr_needed, ordering_sanity, white_ratio,
    CASE WHEN n_chars = 0 THEN 0.0 ELSE (CASE WHEN ocr_needed THEN 0.5 ELSE 1.0 END * CASE WHEN white_ratio > 0.5 THEN 0.8 ELSE 1.0 END
      * CASE WHEN n_replaced > 0 THEN greatest(0.5, 1 - n_replaced / n_chars::DOUBLE) ELSE 1.0 END * CASE WHEN ordering_sanity < 0.8 THEN 0.9 ELSE 1.0 END) END::DOUBLE AS confidence
  FROM base)"""

_HIST = """hist AS (
  SELECT doc, bin, count(*) AS n_spans FROM (
    SELECT doc, unnest(range(floor(least(1, greatest(0, y0 / h)) * 100)::BIGINT, ceil(least(1, greatest(0, y1 / h)) * 100)::BIGINT)) AS bin
    FROM v_spans JOIN (SELECT doc, arg_min(height, page_index) AS h FROM v_spans GROUP BY 1) USING (doc))
  GROUP BY 1, 2)"""


def headed(spans):
    """Spans with headings put in place of some texts, of which the natural texts have none."""
    i = F.col("span_idx")
    return spans.withColumn("text", F.when(i % 6 == 0, F.lit("SECTION 23 05 13 TITLE")).when(i % 6 == 1, F.concat(F.lit("PART "), i.cast("string"))).when(i % 6 == 2, F.lit("2.4 Title")).when(i % 6 == 3, F.lit("1.2.3 Item")).when(i % 6 == 4, F.lit("GENERAL NOTES 2")).otherwise(F.col("text")))


_HEADED = """, v_spans AS (SELECT * REPLACE (CASE span_idx % 6 WHEN 0 THEN 'SECTION 23 05 13 TITLE' WHEN 1 THEN 'PART ' || span_idx WHEN 2 THEN '2.4 Title' WHEN 3 THEN '1.2.3 Item' WHEN 4 THEN 'GENERAL NOTES 2' ELSE text END AS text) FROM plain_spans)"""


def queries():
    f, sp = v.v_footers, v.v_spans

    def rois(s):
        return s.createDataFrame(ROIS, "roi string, x double, y double, w double, h double")

    return {
        "section_runs": lambda s, d: sequence.section_runs(f(s, d)),
        "section_runs_repaired": lambda s, d: sequence.section_runs(sequence.repair_section_ids(f(s, d)), value="repaired_id"),
        "section_audit": lambda s, d: sequence.section_audit(f(s, d)),
        "page_assignments": lambda s, d: sequence.page_assignments(f(s, d)),
        "event_runs": lambda s, d: sequence.section_runs(v.v_runs(s, d), "user_id", "seq", "event_type", None),
        "footer_code_index": lambda s, d: sequence.footer_index(f(s, d)),
        "section_scopes": lambda s, d: sequence.scope_sections(
            sequence.footer_index(f(s, d)).select("doc_id", "section_id", F.col("first_page").alias("start_page")), f(s, d).groupBy("doc_id").agg(F.max("page_index").alias("last_page"))
        ),
        "boundary_source": lambda s, d: sequence.boundary_source(f(s, d), 3, 0.8),
        "footer_sample": lambda s, d: sequence.sample_pages(f(s, d), 5).select("doc_id", "page_index", "section_id"),
        "span_rotation": lambda s, d: geometry.unrotate(sp(s, d)).select("doc", "page_index", "span_idx", "x0", "y0", "x1", "y1", "width", "height"),
        "span_canonical": lambda s, d: geometry.canonicalize(sp(s, d)).select("doc", "page_index", "span_idx", "rank", "span_key", "x0", "y0", "x1", "y1"),
        "doc_content_hash": lambda s, d: geometry.content_hash(geometry.canonicalize(sp(s, d))),
        "doc_span_hash": lambda s, d: geometry.span_hash(geometry.canonicalize(sp(s, d))),
        "roi_strict": lambda s, d: geometry.spans_in_rois(sp(s, d), rois(s)).select("doc", "page_index", "span_idx", "roi"),
        "roi_overlap": lambda s, d: geometry.spans_in_rois(sp(s, d), rois(s), "overlap").select("doc", "page_index", "span_idx", "roi"),
        "band_flags": lambda s, d: geometry.band_flags(sp(s, d)).select("doc", "page_index", "span_idx", "in_header", "in_heading", "in_body", "in_footer"),
        "sheet_size": lambda s, d: sp(s, d).select("doc", "page_index", "width", "height", "rotation").distinct().select("doc", "page_index", geometry.is_sheet_size(F.col("width") * (1 + F.col("rotation") / 90), F.col("height")).alias("is_sheet")),
        "page_quality": lambda s, d: detect.page_quality(sp(s, d)),
        "doc_quality_gates": lambda s, d: detect.doc_quality(detect.page_quality(sp(s, d))),
        "ordering_sanity": lambda s, d: detect.ordering_sanity(geometry.unrotate(sp(s, d))),
        "header_bands": lambda s, d: detect.detect_bands(sp(s, d), "header"),
        "footer_bands": lambda s, d: detect.detect_bands(sp(s, d), "footer"),
        "column_hints": lambda s, d: detect.column_hints(sp(s, d)),
        "page_columns": lambda s, d: detect.page_columns(sp(s, d)),
        "font_clusters": lambda s, d: detect.font_clusters(sp(s, d)),
        "heading_candidates": lambda s, d: detect.heading_candidates(headed(sp(s, d))),
        "chrome_removed": lambda s, d: geometry.remove_chrome(sp(s, d), detect.band_pages(sp(s, d), "header"), detect.band_pages(sp(s, d), "footer")).select("doc", "page_index", "span_idx"),
        "band_definitions": lambda s, d: detect.band_definitions(sp(s, d)),
        "density_histogram": lambda s, d: detect.density_histogram(sp(s, d)),
        "page_regions": lambda s, d: detect.page_regions(sp(s, d)),
        "title_block": lambda s, d: detect.title_block(sp(s, d), "LICENSE"),
    }


def oracle_sql():
    foot = v.with_sql(v.FOOTERS)
    spans = v.with_sql(v.SPANS)
    first = "(SELECT doc_id, section_id, min(page_index) AS first_page, count(DISTINCT page_index) AS n_pages, string_agg(DISTINCT page_index::VARCHAR, ',' ORDER BY page_index::VARCHAR) AS x FROM v_footers WHERE section_id IS NOT NULL GROUP BY 1, 2)"
    left, right, top, bottom = "x * width", "least(1.0, x + w) * width", "greatest(0.0, 1 - y - h) * height", "least(1.0, 1 - y) * height"
    roi = f"FROM v_spans, (VALUES {_ROI_VALUES}) r(roi, x, y, w, h)"
    shared = f"greatest(0.0, least(x1, {right}) - greatest(x0, {left})) * greatest(0.0, least(y1, {bottom}) - greatest(y0, {top}))"
    sizes = " OR ".join(f"(abs(w - {a}) <= 0.5 AND abs(h - {b}) <= 0.5)" for a, b in geometry.SHEET_SIZES)
    return {
        "section_runs": f"{foot},\n{_runs_sql('v_footers', 'doc_id', 'page_index', 'section_id', 'page_in_section')}\n{_run_rows('doc_id', 'page_index', 'section_id')}",
        "section_runs_repaired": f"{foot},\n{_REPAIRED},\n{_runs_sql('repaired', 'doc_id', 'page_index', 'repaired_id', 'page_in_section')}\n{_run_rows('doc_id', 'page_index', 'repaired_id')}",
        "section_audit": f"""{foot},\n{_REPAIRED}
SELECT doc_id, count(*) AS pages, count(*) FILTER (repair = 'none') AS n_parsed, count(*) FILTER (repair = 'both-neighbours') AS n_both, count(*) FILTER (repair = 'previous') AS n_previous,
  count(*) FILTER (repair = 'next') AS n_next, count(*) FILTER (repair = 'unresolved') AS n_unresolved FROM repaired GROUP BY 1""",
        "page_assignments": f"{foot},\n{_REPAIRED},\n{_runs_sql('repaired', 'doc_id', 'page_index', 'repaired_id', 'page_in_section')}\nSELECT doc_id, page_index, repaired_id AS section_id, repair, run_no FROM marked",
        "event_runs": f"{v.with_sql(v.RUNS)},\n{_runs_sql('v_runs', 'user_id', 'seq', 'event_type', None)}\n{_run_rows('user_id', 'seq', 'event_type')}",
        "footer_code_index": f"{foot}\nSELECT doc_id, section_id, min(page_index) AS first_page, count(*) AS n_pages, string_agg(page_index::VARCHAR, ',' ORDER BY page_index) AS page_list FROM v_footers WHERE section_id IS NOT NULL GROUP BY 1, 2",
        "section_scopes": f"""{foot}
SELECT doc_id, section_id, first_page AS start_page, greatest(first_page, coalesce(lead(first_page) OVER (PARTITION BY doc_id ORDER BY first_page, section_id) - 1, last_page)) AS end_page
FROM {first} JOIN (SELECT doc_id, max(page_index) AS last_page FROM v_footers GROUP BY 1) USING (doc_id)""",
        "boundary_source": f"""{foot}
SELECT doc_id, count(DISTINCT section_id) AS n_sections, count(section_id) AS n_with_id, count(*) AS n_pages,
  CASE WHEN count(DISTINCT section_id) >= 3 AND count(section_id) >= 0.8 * count(*) THEN 'footer' ELSE 'heading' END AS boundary FROM v_footers GROUP BY 1""",
        "footer_sample": f"""{foot}
SELECT doc_id, page_index, section_id FROM (SELECT *, greatest(floor((count(*) OVER (PARTITION BY doc_id) - 5) / 5.0), 1)::BIGINT AS e FROM v_footers) WHERE page_index < 5 OR (page_index - 5) % e = 0""",
        "span_rotation": f"{v.with_sql(CANON)}\nSELECT doc, page_index, span_idx, x0, y0, x1, y1, width, height FROM turned",
        "span_canonical": f"{v.with_sql(CANON)}\nSELECT doc, page_index, span_idx, rank::INTEGER AS rank, span_key, x0, y0, x1, y1 FROM canon",
        "doc_content_hash": _hash_sql("width::DECIMAL(18,6) || ',' || height::DECIMAL(18,6)", f"text || '|' || {_NUM} || '|' || font_name || '|' || font_size::DECIMAL(18,6)", "content_hash"),
        "doc_span_hash": _hash_sql("page_index::VARCHAR", f"span_key || '|' || {_NUM} || '|' || font_name || '|' || font_size::DECIMAL(18,6) || '|' || is_bold::INTEGER || '|' || is_italic::INTEGER || '|' || is_fixed::INTEGER", "span_hash"),
        "roi_strict": f"{spans}\nSELECT doc, page_index, span_idx, roi {roi} WHERE x0 >= {left} AND x1 <= {right} AND y0 >= {top} AND y1 <= {bottom}",
        "roi_overlap": f"""{spans}\nSELECT doc, page_index, span_idx, roi {roi}
WHERE CASE WHEN (x1 - x0) * (y1 - y0) > 0 THEN {shared} >= 0.5 * ((x1 - x0) * (y1 - y0)) ELSE x0 >= {left} AND x0 <= {right} AND y0 >= {top} AND y0 <= {bottom} END""",
        "band_flags": f"{spans}\nSELECT doc, page_index, span_idx, " + ", ".join(f"(y0 + y1) / 2 >= {a} * height AND (y0 + y1) / 2 <= {b} * height AS in_{n}" for n, a, b in geometry.BANDS) + " FROM v_spans",
        "sheet_size": f"""{spans}
SELECT doc, page_index, w > h AND ({sizes} OR (w BETWEEN 8 AND 50 AND h BETWEEN 8 AND 50)) AS is_sheet
FROM (SELECT DISTINCT doc, page_index, width * (1 + rotation / 90) / 72 AS w, height / 72 AS h FROM v_spans)""",
        "page_quality": f"{v.with_sql(v.SPANS, _QUALITY)}\nSELECT * FROM quality",
        "doc_quality_gates": f"""{v.with_sql(v.SPANS, _QUALITY)},
agg AS (
  SELECT doc, count(*) AS n_pages, sum(n_chars)::BIGINT AS n_chars, min(n_chars) >= 50 AS gate_chars, sum(n_replaced) <= 0.05 * sum(n_chars) AS gate_replacement,
    coalesce(avg(ordering_sanity) FILTER (n_chars > 0) >= 0.8, FALSE) AS gate_ordering, coalesce(avg(confidence) FILTER (n_chars > 0) >= 0.85, FALSE) AS gate_confidence,
    sum(n_replaced) > 0.05 * sum(n_chars) OR sum(n_chars) < 50 * count(*) AS ocr_needed FROM quality GROUP BY 1)
SELECT *, gate_chars AND gate_replacement AND gate_ordering AND gate_confidence AS passes,
  array_to_string(list_filter([CASE WHEN NOT gate_chars THEN 'few-characters' END, CASE WHEN NOT gate_replacement THEN 'replacement-characters' END, CASE WHEN NOT gate_ordering THEN 'ordering' END,
    CASE WHEN NOT gate_confidence THEN 'confidence' END, CASE WHEN ocr_needed THEN 'ocr' END], lambda x: x IS NOT NULL), ',') AS issues FROM agg""",
        "ordering_sanity": f"""{v.with_sql(CANON)},
ranked AS (
  SELECT doc, page_index, row_number() OVER (PARTITION BY doc, page_index ORDER BY span_idx) - row_number() OVER (PARTITION BY doc, page_index ORDER BY floor(y0 / 5), x0, span_idx) AS d FROM turned)
SELECT doc, page_index, count(*) AS n_spans, count(*) FILTER (abs(d) <= 2) AS n_in_place FROM ranked GROUP BY 1, 2""",
        "header_bands": f"{v.with_sql(v.SPANS, _PAGES, _band_pages('header'))}\n{_recurring('header_pages', 'band')}",
        "footer_bands": f"{v.with_sql(v.SPANS, _PAGES, _band_pages('footer'))}\n{_recurring('footer_pages', 'band')}",
        "column_hints": f"{v.with_sql(v.SPANS, _PAGES)},\ncols AS (SELECT DISTINCT doc, page_index, ({_half('x0 / 20')} * 20)::BIGINT AS column_x FROM v_spans)\n{_recurring('cols', 'column_x')}",
        "page_columns": f"{spans}\nSELECT doc, page_index, count(DISTINCT {_half('x0 / 20')}) AS n_columns, count(*) AS n_spans FROM v_spans GROUP BY 1, 2",
        "font_clusters": f"{spans}\nSELECT doc, {_half('font_size * 2')} / 2 AS size, count(*) AS n_spans FROM v_spans GROUP BY 1, 2",
        "heading_candidates": _headings_sql(),
        "chrome_removed": f"""{v.with_sql(v.SPANS, _band_pages("header"), _band_pages("footer"))},
t AS (SELECT doc, page_index, max(band) AS a FROM header_pages GROUP BY 1, 2), b AS (SELECT doc, page_index, min(band) AS z FROM footer_pages GROUP BY 1, 2)
SELECT doc, page_index, span_idx FROM v_spans LEFT JOIN t USING (doc, page_index) LEFT JOIN b USING (doc, page_index)
WHERE NOT (a IS NOT NULL AND (y0 + y1) / 2 < greatest(0.15 * height, a + 20)) AND NOT (z IS NOT NULL AND (y0 + y1) / 2 > least(0.85 * height, z - 20))""",
        "band_definitions": f"""{v.with_sql(v.SPANS, _PAGES, _BANDS)}
SELECT doc, coalesce((a + 20)::DOUBLE, 0.15 * h) AS header_end, coalesce((z - 20)::DOUBLE, 0.85 * h) AS footer_start FROM (SELECT doc, max(height) AS h FROM v_spans GROUP BY 1)
LEFT JOIN (SELECT doc, max(band) AS a FROM headers GROUP BY 1) USING (doc) LEFT JOIN (SELECT doc, min(band) AS z FROM footers GROUP BY 1) USING (doc)""",
        "density_histogram": f"{v.with_sql(v.SPANS, _HIST)}\nSELECT * FROM hist",
        "page_regions": f"""{v.with_sql(v.SPANS, _HIST)},
zones AS (SELECT doc, sum(n_spans) FILTER (bin < 12) / 12.0::DOUBLE AS head, sum(n_spans) FILTER (bin >= 88) / 12.0::DOUBLE AS foot FROM hist GROUP BY 1),
edges AS (
  SELECT doc, coalesce(min(bin) FILTER (bin < 12 AND n_spans > head * 0.3), 0) AS a, coalesce(max(bin + 1) FILTER (bin < 12 AND n_spans > head * 0.5), 12) AS b0,
    coalesce(min(bin) FILTER (bin >= 88 AND n_spans > foot * 0.5), 88) AS c, coalesce(max(bin + 1) FILTER (bin >= 88 AND n_spans > foot * 0.3), 100) AS d FROM hist JOIN zones USING (doc) GROUP BY 1),
fixed AS (SELECT *, CASE WHEN b0 > c THEN least(b0, c - 1) ELSE b0 END AS b FROM edges)
SELECT doc, a / 100.0::DOUBLE AS header_top, b / 100.0::DOUBLE AS header_bottom, greatest(b, 12) / 100.0::DOUBLE AS body_top, least(c, 88) / 100.0::DOUBLE AS body_bottom, c / 100.0::DOUBLE AS footer_top, d / 100.0::DOUBLE AS footer_bottom FROM fixed""",
        "title_block": f"""{spans},
marks AS (SELECT doc, page_index, x0 AS mx, y0 AS my FROM v_spans WHERE contains(upper(text), 'LICENSE'))
SELECT doc, page_index, min(x0) - 20 AS x0, min(y0) - 20 AS y0, max(x1) + 20 AS x1, max(y1) + 20 AS y1
FROM v_spans JOIN marks USING (doc, page_index) WHERE (x0 - mx) * (x0 - mx) + (y0 - my) * (y0 - my) <= 90000 GROUP BY 1, 2""",
    }
