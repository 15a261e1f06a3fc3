"""Queries over lines, shapes, trees, tables and packets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import lines, privacy, tables, trees
from . import views as v

FIELDS = {"model": "model[ ]+([a-z]+)", "licence": "under (?:the )?([A-Z]+)", "word": "^([A-Z][a-z]+)[.]"}


def headings(s, d):
    """Line buckets with a section heading in place of some lines."""
    spans = v.v_spans(s, d)
    size = spans.groupBy("doc").agg(F.first("width").alias("width"), F.first("height").alias("height"))
    text = F.when((F.col("page_index") % 3 == 1) & (F.col("bucket") % 7 == 0), F.lit("SECTION 23 05 13")).otherwise(F.col("line_text"))
    return lines.line_buckets(spans).join(size, "doc").withColumn("line_text", text)


def marked_nodes(s, d):
    """List items of each document as nodes with a level by style."""
    items = trees.list_items(with_markers(s, d))
    level = F.when(F.col("style") == "numeric", 0).when(F.col("style") == "alpha-upper", 1).when(F.col("style") == "alpha-lower", 2).otherwise(3)
    return items.select(F.col("doc_id").alias("group_id"), F.col("line_no").cast("bigint").alias("ord"), level.alias("level"), "marker")


def with_markers(s, d):
    """Lines with a list marker or an anchor put before some of them."""
    i = F.col("line_no")
    lead = (
        F.when(i % 7 == 0, F.concat((i % 5 + 1).cast("string"), F.lit(". "))).when(i % 7 == 1, F.concat(F.char(F.lit(65) + i % 4), F.lit(". "))).when(i % 7 == 2, F.concat(F.char(F.lit(97) + i % 26), F.lit(") ")))
        .when(i % 7 == 3, "iv. ").when(i % 7 == 4, F.concat((i % 3).cast("string"), F.lit("."), (i % 2).cast("string"), F.lit(" "))).when(i % 7 == 5, "T.5b.1 ").otherwise("")
    )
    return v.v_lines(s, d).withColumn("line", F.concat(lead, "line"))


_MARKED = """, m_lines AS (SELECT * REPLACE (CASE line_no % 7 WHEN 0 THEN (line_no % 5 + 1) || '. ' WHEN 1 THEN chr(65 + line_no % 4) || '. ' WHEN 2 THEN chr(97 + line_no % 26) || ') ' WHEN 3 THEN 'iv. '
  WHEN 4 THEN (line_no % 3) || '.' || (line_no % 2) || ' ' WHEN 5 THEN 'T.5b.1 ' ELSE '' END || line AS line) FROM v_lines)"""
_STYLE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {{{i}}}" for i, (_, p) in enumerate(trees.MARKERS)) + " END"
_ITEMS = (
    v.LINES
    + _MARKED
    + f""", items AS (SELECT * FROM (SELECT source, doc_id, line_no, {_STYLE.format(*[repr(n) for n, _ in trees.MARKERS])} AS style,
  {_STYLE.format(*[f"regexp_extract(line, '{p}', 1)" for _, p in trees.MARKERS])} AS marker FROM m_lines) WHERE style IS NOT NULL)"""
)
_NEXT = "CASE WHEN style IN ('alpha-lower', 'alpha-upper') THEN CASE WHEN lower(marker) = 'z' THEN CASE WHEN marker = 'z' THEN 'aa' ELSE 'AA' END ELSE chr(ascii(marker) + 1) END WHEN style = 'numeric' THEN (marker::BIGINT + 1)::VARCHAR ELSE marker END"


def _anchor_sql() -> str:
    found = [f"regexp_extract(line, '{p}', 1)" for p in trees.ANCHORS]
    return "CASE " + " ".join(f"WHEN {f} <> '' AND trim(substr(line, instr(line, {f}) + length({f}))) <> '' THEN {f}" for f in found) + " END"


_ANCHORS = v.LINES + _MARKED + f", found AS (SELECT source, doc_id, line_no, {_anchor_sql()} AS anchor FROM m_lines)"

_T = "trim(text)"
CLASS = f"CASE WHEN regexp_matches({_T}, '^[0-9]+$') THEN 'NUMBER' WHEN regexp_matches({_T}, '{shapes.DATE}') THEN 'DATE' WHEN regexp_matches({_T}, '^[A-Za-z]+$') THEN 'TEXT_PATTERN' ELSE 'CONTENT' END"
_N = f"least(length({_T}), 10)::INTEGER"
SHAPE = f"""CASE WHEN regexp_matches({_T}, '^[0-9]+$') THEN repeat('9', {_N}) WHEN regexp_matches({_T}, '{shapes.DATE}') THEN '99/99/9999' WHEN regexp_matches({_T}, '^[A-Z]+$') THEN repeat('A', {_N})
  WHEN regexp_matches({_T}, '^[a-z]+$') THEN repeat('a', {_N}) WHEN regexp_matches({_T}, '^[A-Za-z]+$') THEN CASE WHEN regexp_matches({_T}, '^[A-Z]') THEN 'A' ELSE 'a' END || repeat('a', {_N} - 1)
  WHEN regexp_matches({_T}, '^[A-Za-z0-9]+-[A-Za-z0-9]+') THEN 'AA-99' WHEN regexp_matches({_T}, '^[A-Za-z0-9]+/[A-Za-z0-9]+') THEN 'AA/99' WHEN regexp_matches({_T}, '^[A-Za-z0-9]+[.][A-Za-z0-9]+') THEN 'AA.99' ELSE repeat('X', {_N}) END"""
BUCKET = "CASE WHEN length(text) = 1 THEN '1' WHEN length(text) <= 3 THEN '2-3' WHEN length(text) <= 6 THEN '4-6' WHEN length(text) <= 12 THEN '7-12' ELSE '13+' END"
_FLAG = {n: f"regexp_matches(text, '{p}')" for n, p in shapes.FLAGS.items()}
PLACEHOLDER = f"'PLACEHOLDER_' || substr(sha256({CLASS} || '|' || {SHAPE} || '|' || {BUCKET} || '|' || {' || '.join(f'CASE WHEN {f} THEN chr(49) ELSE chr(48) END' for f in _FLAG.values())}), 1, 12)"


def words(s, d):
    """Single words of documents as spans, so that all shapes occur."""
    w = v.v_lines(s, d).where("line_no < 3").select("source", "doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("pos", "w"))
    n = F.col("pos")
    text = F.when(n % 9 == 0, (n * 37).cast("string")).when(n % 9 == 1, F.concat(F.lit("12/0"), (n % 9 + 1).cast("string"), F.lit("/2020"))).when(n % 9 == 2, F.concat(F.lit("AB-"), n.cast("string"))).when(n % 9 == 3, "X/Y").when(n % 9 == 4, "A.1").otherwise(F.col("w"))
    return w.select(F.col("source").alias("doc"), F.col("doc_id").alias("page_index"), (F.col("line_no") * 100_000 + n).alias("span_idx"), text.alias("text"), ((F.col("line_no") * 100 + n) % 792).cast("double").alias("y0"), ((F.col("line_no") * 100 + n) % 792 + 10).cast("double").alias("y1"), F.lit(792.0).alias("height"))


WORDS = (
    v.LINES
    + """, w0 AS (SELECT source, doc_id, line_no, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) - 1 AS n FROM v_lines WHERE line_no < 3),
words AS (SELECT source AS doc, doc_id AS page_index, line_no * 100000 + n AS span_idx,
  CASE n % 9 WHEN 0 THEN (n * 37)::VARCHAR WHEN 1 THEN '12/0' || (n % 9 + 1) || '/2020' WHEN 2 THEN 'AB-' || n WHEN 3 THEN 'X/Y' WHEN 4 THEN 'A.1' ELSE w END AS text,
  ((line_no * 100 + n) % 792)::DOUBLE AS y0, ((line_no * 100 + n) % 792 + 10)::DOUBLE AS y1, 792.0::DOUBLE AS height FROM w0)"""
)

_BUCKETED = "bucketed AS (SELECT *, (floor(y0 / 5 + 0.5) * 5)::BIGINT AS bucket FROM v_spans)"
_HOW = """how AS (
  SELECT source, doc_id, line_no, line, CASE WHEN before IS NULL THEN 'first' WHEN regexp_matches(before, '[A-Za-z]-$') AND regexp_matches(line, '^[a-z]') THEN 'hyphen'
    WHEN NOT regexp_matches(before, '[.!?:]$') AND regexp_matches(line, '^[a-z]') THEN 'space' ELSE 'newline' END AS joined_by
  FROM (SELECT *, lag(line) OVER (PARTITION BY source, doc_id ORDER BY line_no) AS before FROM broken))"""


def broken(s, d):
    """Lines of 40 characters cut from each line, so that wraps and hyphens occur."""
    cut = v.v_lines(s, d).where("length(line) > 0").select("source", "doc_id", "line_no", F.explode(F.expr("transform(sequence(0, (length(line) - 1) div 40), i -> struct(i AS i, substring(line, i * 40 + 1, 40) AS p))")).alias("x"))
    return cut.select("source", "doc_id", (F.col("line_no") * 10_000 + F.col("x.i")).alias("line_no"), F.when(F.col("x.i") % 3 == 1, F.concat("x.p", F.lit("-"))).otherwise(F.col("x.p")).alias("line"))


BROKEN = (
    v.LINES
    + """, broken AS (
  SELECT source, doc_id, line_no * 10000 + i AS line_no, substr(line, i * 40 + 1, 40) || CASE WHEN i % 3 = 1 THEN '-' ELSE '' END AS line
  FROM (SELECT *, unnest(range((length(line) - 1) // 40 + 1)) AS i FROM v_lines WHERE length(line) > 0))"""
)

_CAND = """total AS (SELECT doc, page_index, count(*) AS total FROM v_spans GROUP BY 1, 2),
cand AS (
  SELECT doc, page_index, x, n FROM (SELECT doc, page_index, (floor((x0 + x1) / 2 / 5 + 0.5) * 5)::BIGINT AS x, count(*) AS n FROM v_spans GROUP BY 1, 2, 3) JOIN total USING (doc, page_index) WHERE n >= greatest(2.0, 0.1 * total)),
cols AS (
  SELECT doc, page_index, col_idx, avg(x::DOUBLE) AS x FROM (
    SELECT *, sum(is_new) OVER (PARTITION BY doc, page_index ORDER BY x)::BIGINT AS col_idx FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc, page_index ORDER BY x) >= 10 THEN 1 ELSE 0 END AS is_new FROM cand)) GROUP BY 1, 2, 3)"""
_CELLS = (
    _CAND
    + """,
near AS (SELECT doc, page_index, span_idx, arg_min(col_idx, (abs((x0 + x1) / 2 - x), col_idx)) AS col_idx FROM v_spans JOIN cols USING (doc, page_index) GROUP BY 1, 2, 3),
cells AS (
  SELECT doc, page_index, (floor(y0 / 5 + 0.5) * 5)::BIGINT AS row, col_idx, string_agg(text, ' ' ORDER BY s.x0, s.span_idx) AS cell
  FROM v_spans s JOIN near USING (doc, page_index, span_idx) GROUP BY ALL)"""
)


def packet_pages(s, d):
    p = F.col("o_orderkey")
    return v.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("doc"), p.alias("page_no"), (p % 5 == 0).alias("is_cover"), (p % 3 == 0).alias("is_unit"))


def outline_changes(nodes):
    return nodes.where("level = 2").select("node_id", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Renamed "), F.col("ord").cast("string"))).alias("new_title"), F.when(F.col("ord") % 3 == 1, F.lit(0)).alias("new_page"), (F.col("ord") % 3 == 2).alias("is_deleted"))


def patch_nodes(s, d):
    return v.v_outline(s, d).where("level <= 1").select(F.row_number().over(trees.Window.orderBy("level", "ord")).cast("double").alias("ord"), F.col("node_id").alias("anchor"), F.col("title").alias("text"))


def patch_tree(s, d):
    """Regions with their nations as list items; a document for each remainder of the page number."""
    tree = v.v_outline(s, d).where("level <= 1")
    item = F.col("level") == 1
    return tree.crossJoin(s.range(3).select(F.concat(F.lit("d"), "id").alias("doc"))).select(
        "doc", F.lit("S").alias("section_id"), "node_id", "parent_id", F.col("ord"), "level", F.when(item, "list-item").otherwise("article").alias("kind"), F.when(item, F.col("ord").cast("string")).alias("marker"), F.col("title").alias("text"), F.col("node_id").alias("anchor"),
    )


PATCH = [
    {"op": "delete", "targets": ["r4"]},
    {"op": "insert", "target": "r1", "text": "Inserted", "kind": "article"},
    {"op": "insert", "target": "r2", "position": "child", "level": 1, "text": "Last", "kind": "list-item", "marker": "z"},
    {"op": "move", "sources": ["r3"], "target": "r0", "position": "before"},
    {"op": "replace", "target": "r2", "text": "Replaced"},
    {"op": "renumber", "target": "n{first}", "new_start": "7", "style": "numeric"},
]


def patch(s, d):
    # renumbering starts at the first nation of region 0
    first = v.table(s, d, "nation").where("n_regionkey = 0").agg(F.min("n_nationkey")).first()[0]
    ops = [op | {"target": op["target"].format(first=first)} if "target" in op else op for op in PATCH]
    return trees.apply_patch(patch_tree(s, d), ops).select("doc", "node_id", "parent_id", "ord", "level", "marker", "text", "anchor")


def patch_ops(s):
    return s.createDataFrame([(0, "delete", "r1", None), (1, "replace", "r2", "A"), (2, "replace", "r2", "zzz"), (3, "delete", "nowhere", None), (4, "move", None, None)], "ord int, op string, target_anchor string, match_text string")


def queries():
    sp, out = v.v_spans, v.v_outline

    def numbered(s, d):
        return v.v_lines(s, d)

    return {
        "page_text": lambda s, d: lines.page_text(sp(s, d)),
        "line_buckets": lambda s, d: lines.line_buckets(sp(s, d)),
        "line_text": lambda s, d: lines.running_lines(sp(s, d)),
        "line_first_fit": lambda s, d: lines.first_fit_lines(sp(s, d)),
        "visual_text": lambda s, d: lines.visual_text(sp(s, d)),
        "reading_order": lambda s, d: lines.reading_order(sp(s, d)),
        "paragraph_islands": lambda s, d: lines.paragraphs(sp(s, d)),
        "wrap_join": lambda s, d: lines.wrap_join(broken(s, d)),
        "normal_paragraphs": lambda s, d: lines.normal_paragraphs(broken(s, d)),
        "hyphen_repair": lambda s, d: v.table(s, d, "documents").select("doc_id", lines.repair_hyphens(F.replace("text", F.lit("th"), F.lit("t-\n h"))).alias("text")),
        "char_flags": lambda s, d: words(s, d).select("doc", "page_index", "span_idx", *[f.alias(n) for n, f in shapes.flags(F.col("text")).items()]),
        "length_bucket": lambda s, d: words(s, d).groupBy(shapes.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")),
        "token_shape": lambda s, d: words(s, d).groupBy(shapes.token_class(F.col("text")).alias("class"), shapes.token_shape(F.col("text")).alias("shape")).agg(F.count(F.lit(1)).alias("n")),
        "placeholder_ids": lambda s, d: privacy.abstract_spans(words(s, d)).select("doc", "page_index", "span_idx", "placeholder_id", "token_class", "length_bucket", "original_length"),
        "vault_first_text": lambda s, d: privacy.vault(words(s, d)),
        "repetition_metrics": lambda s, d: privacy.repetition(words(s, d)),
        "placeholder_audit": lambda s, d: privacy.abstract_spans(words(s, d)).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("placeholder_id").rlike("^PLACEHOLDER_[0-9a-f]{12}$")).alias("n_leaks")),
        "sampled_spans": lambda s, d: privacy.sample_spans(sp(s, d)).select("doc", "page_index", "span_idx"),
        "pseudonyms": lambda s, d: privacy.pseudonymize(v.table(s, d, "documents").select("source").distinct().withColumn("path", F.col("source")), "path", "a key"),
        "list_markers": lambda s, d: trees.list_items(with_markers(s, d)),
        "numbering_breaks": lambda s, d: trees.numbering_breaks(trees.list_items(with_markers(s, d))),
        "anchors": lambda s, d: trees.anchors(with_markers(s, d)),
        "duplicate_anchors": lambda s, d: trees.duplicate_anchors(trees.anchors(with_markers(s, d))),
        "hierarchy": lambda s, d: trees.parents_by_level(marked_nodes(s, d)),
        "outline_depth": lambda s, d: trees.depths(s, out(s, d)),
        "outline_ranges": lambda s, d: trees.ranges(out(s, d), 39),
        "outline_links": lambda s, d: trees.sibling_links(out(s, d)),
        "outline_titles": lambda s, d: out(s, d).select("node_id", trees.normal_title(F.col("title"), 12).alias("title")),
        "outline_duplicates": lambda s, d: trees.duplicate_titles(out(s, d)),
        "outline_dedupe": lambda s, d: trees.dedupe_siblings(out(s, d)).select("node_id", "parent_id", "title"),
        "outline_validate": lambda s, d: trees.validate_destinations(out(s, d), 30).select("node_id", "is_valid", "error"),
        "outline_shape": lambda s, d: trees.shape_outline(out(s, d).withColumn("title", F.when((F.col("level") == 1) & (F.col("ord") % 2 == 0), "").otherwise(F.col("title"))), 2).select("node_id", "parent_id", "title"),
        "outline_corrections": lambda s, d: trees.correct_outline(out(s, d), outline_changes(out(s, d))).select("node_id", "title", "page_index"),
        "outline_html": lambda s, d: trees.section_html(out(s, d).where("parent_id IS NOT NULL").select(F.col("parent_id").alias("section_id"), "ord", "level", F.concat(F.lit("<a & 'b'> "), "title").alias("title"))),
        "articles_in_ranges": lambda s, d: trees.articles_in_ranges(
            v.v_runs(s, d).select(F.col("user_id").alias("doc"), F.col("seq").alias("page_index")), v.v_runs(s, d).where("seq % 3 = 0").select(F.col("user_id").alias("doc"), F.col("seq").alias("section_id"), F.col("seq").alias("start_page"), (F.col("seq") + 2).alias("end_page"))
        ),
        "heading_pages": lambda s, d: trees.heading_pages(headings(s, d), "^SECTION 23 05 13$"),
        "patch_validate": lambda s, d: trees.validate_patch(patch_ops(s), patch_nodes(s, d)),
        "patch_apply": patch,
        "column_candidates": lambda s, d: tables.column_candidates(sp(s, d)),
        "table_columns": lambda s, d: tables.spaced_columns(tables.column_candidates(sp(s, d))),
        "table_columns_merged": lambda s, d: tables.merge_columns(tables.column_candidates(sp(s, d))),
        "table_cells": lambda s, d: tables.table_cells(sp(s, d), tables.spaced_columns(tables.column_candidates(sp(s, d)))),
        "table_confidence": lambda s, d: tables.table_confidence(tables.table_cells(sp(s, d), tables.spaced_columns(tables.column_candidates(sp(s, d))))),
        "table_csv": lambda s, d: tables.table_csv(tables.table_cells(sp(s, d), tables.spaced_columns(tables.column_candidates(sp(s, d))))),
        "packets": lambda s, d: tables.packets(packet_pages(s, d)),
        "packet_fields": lambda s, d: tables.packet_fields(sp(s, d), FIELDS),
    }


def oracle_sql():
    spans, out, wd, ln = v.with_sql(v.SPANS), v.with_sql(v.OUTLINE), v.with_sql(WORDS), v.with_sql(v.LINES)
    title = "trim(regexp_replace(trim(regexp_replace(title, '[ \\t\\r\\n\\f]+', ' ', 'g')), '[ ]*[-—][ ]*$', '', 'g'))"
    cut = lambda n: f"CASE WHEN length({title}) > {n} THEN substr({title}, 1, {n - 1}) || '…' ELSE {title} END"
    levels = "CASE style WHEN 'numeric' THEN 0 WHEN 'alpha-upper' THEN 1 WHEN 'alpha-lower' THEN 2 ELSE 3 END"
    esc = "'<a & ''b''> ' || title"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        esc = f"replace({esc}, '{a}', '{b}')"
    pad = b"a key".ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in pad).hex() for x in (0x36, 0x5C))
    field = " UNION ALL ".join(f"SELECT doc, '{n}' AS field, arg_min(val, (page_index, span_idx)) AS value FROM (SELECT *, regexp_extract(text, '{p}', 1) AS val FROM v_spans) WHERE val <> '' GROUP BY 1" for n, p in FIELDS.items())
    return {
        "page_text": f"{spans}\nSELECT doc, page_index, string_agg(text, ' ' ORDER BY span_idx) AS page_text FROM v_spans GROUP BY 1, 2",
        "line_buckets": f"{v.with_sql(v.SPANS, _BUCKETED)}\nSELECT doc, page_index, bucket, count(*) AS n_spans, string_agg(text, ' ' ORDER BY x0, span_idx) AS line_text, min(x0) AS x0, max(x1) AS x1 FROM bucketed GROUP BY 1, 2, 3",
        "line_text": f"""{spans},
m AS (SELECT *, CASE WHEN abs(y0 - lag(y0) OVER w) > 5 THEN 1 ELSE 0 END AS is_new FROM v_spans WINDOW w AS (PARTITION BY doc, page_index ORDER BY y0, x0, span_idx)),
r AS (SELECT *, sum(is_new) OVER (PARTITION BY doc, page_index ORDER BY y0, x0, span_idx)::BIGINT AS line_id FROM m)
SELECT doc, page_index, line_id, count(*) AS n_spans, string_agg(text, ' ' ORDER BY y0, x0, span_idx) AS line_text FROM r GROUP BY 1, 2, 3""",
        "visual_text": f"""{v.with_sql(v.SPANS, _BUCKETED)},
g AS (SELECT *, lag(text) OVER w AS before, x0 - lag(x1) OVER w AS gap FROM bucketed WINDOW w AS (PARTITION BY doc, page_index, bucket ORDER BY x0, span_idx))
SELECT doc, page_index, bucket, string_agg(CASE WHEN before IS NULL OR (before LIKE '%-' AND regexp_matches(text, '^[a-z]')) THEN '' WHEN gap > 0.15 * (y1 - y0) THEN ' ' ELSE '' END || text, '' ORDER BY x0, span_idx) AS line_text FROM g GROUP BY 1, 2, 3""",
        "reading_order": f"""{spans},
med AS (SELECT doc, page_index, list_sort(list(y1 - y0))[(count(*) // 2) + 1] * 0.6 AS tol FROM v_spans GROUP BY 1, 2)
SELECT doc, page_index, span_idx, (row_number() OVER (PARTITION BY doc, page_index ORDER BY floor(y0 / tol), x0, span_idx) - 1)::INTEGER AS rank FROM v_spans JOIN med USING (doc, page_index)""",
        "paragraph_islands": f"""{spans},
m AS (
  SELECT *, trim(text) = '' AS blank, CASE WHEN coalesce(lag(trim(text) = '') OVER w OR trim(text) = '' OR y0 - lag(y0) OVER w > 50, FALSE) THEN 1 ELSE 0 END AS is_new
  FROM v_spans WINDOW w AS (PARTITION BY doc, page_index ORDER BY y0, span_idx)),
r AS (SELECT *, sum(is_new) OVER (PARTITION BY doc, page_index ORDER BY y0, span_idx)::BIGINT AS paragraph FROM m)
SELECT doc, page_index, paragraph, count(*) AS n_lines, min(span_idx) AS first_span, string_agg(text, chr(10) ORDER BY y0, span_idx) AS paragraph_text FROM r WHERE NOT blank GROUP BY 1, 2, 3""",
        "wrap_join": f"{v.with_sql(BROKEN, _HOW)}\nSELECT * FROM how",
        "normal_paragraphs": f"""{v.with_sql(BROKEN, _HOW)},
n AS (SELECT *, lead(joined_by) OVER (PARTITION BY source, doc_id ORDER BY line_no) AS nxt FROM how)
SELECT source, doc_id, string_agg(CASE joined_by WHEN 'space' THEN ' ' WHEN 'newline' THEN chr(10) ELSE '' END || CASE WHEN nxt = 'hyphen' THEN regexp_replace(line, '-$', '') ELSE line END, '' ORDER BY line_no) AS normal_text FROM n GROUP BY 1, 2""",
        "hyphen_repair": "SELECT doc_id, regexp_replace(replace(text, 'th', 't-' || chr(10) || ' h'), '([A-Za-z])-[ ]*\\n[ ]*([a-z])', '\\1\\2', 'g') AS text FROM documents",
        "char_flags": f"{wd}\nSELECT doc, page_index, span_idx, {', '.join(f'{f} AS {n}' for n, f in _FLAG.items())} FROM words",
        "length_bucket": f"{wd}\nSELECT {BUCKET} AS bucket, count(*) AS n FROM words GROUP BY 1",
        "token_shape": f"{wd}\nSELECT {CLASS} AS class, {SHAPE} AS shape, count(*) AS n FROM words GROUP BY 1, 2",
        "placeholder_ids": f"{wd}\nSELECT doc, page_index, span_idx, {PLACEHOLDER} AS placeholder_id, {CLASS} AS token_class, {BUCKET} AS length_bucket, length(text) AS original_length FROM words",
        "vault_first_text": f"{wd}\nSELECT {PLACEHOLDER} AS placeholder_id, arg_min(text, (doc, page_index, span_idx)) AS first_text, count(*) AS n, count(DISTINCT (doc, page_index)) AS n_pages FROM words GROUP BY 1",
        "repetition_metrics": f"""{wd},
k AS (SELECT *, {PLACEHOLDER} AS placeholder_id, (y0 + y1) / 2 < 0.15 * height AS head, (y0 + y1) / 2 > 0.85 * height AS foot FROM words),
t AS (SELECT doc, count(DISTINCT page_index) AS total FROM words GROUP BY 1)
SELECT doc, placeholder_id, count(*) AS n, count(DISTINCT page_index) AS n_pages, count(DISTINCT page_index) / any_value(total)::DOUBLE AS page_share, count(*) FILTER (head) AS n_header, count(*) FILTER (NOT head AND NOT foot) AS n_body, count(*) FILTER (foot) AS n_footer
FROM k JOIN t USING (doc) GROUP BY 1, 2""",
        "placeholder_audit": f"{wd}\nSELECT count(*) AS n, 0::BIGINT AS n_leaks FROM words",
        "sampled_spans": f"{spans}\nSELECT doc, page_index, span_idx FROM v_spans WHERE page_index % 3 = 0 OR (y0 + y1) / 2 < 0.15 * height OR (y0 + y1) / 2 > 0.85 * height OR is_bold",
        "pseudonyms": f"SELECT DISTINCT source, substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || source::BLOB))), 1, 16) AS path FROM documents",
        "list_markers": f"{v.with_sql(_ITEMS)}\nSELECT * FROM items",
        "numbering_breaks": f"""{v.with_sql(_ITEMS)},
e AS (SELECT source, doc_id, line_no, marker, lag({_NEXT}) OVER (PARTITION BY source, doc_id ORDER BY line_no) AS expected FROM items)
SELECT * FROM e WHERE lower(marker) <> lower(expected)""",
        "anchors": f"{v.with_sql(_ANCHORS)}\nSELECT * FROM found WHERE anchor IS NOT NULL",
        "duplicate_anchors": f"{v.with_sql(_ANCHORS)}\nSELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY source, doc_id, anchor ORDER BY line_no))::INTEGER AS nth FROM found WHERE anchor IS NOT NULL) WHERE nth > 1",
        "hierarchy": f"""{v.with_sql(_ITEMS)},
n AS (SELECT doc_id AS group_id, line_no::BIGINT AS ord, {levels} AS level, marker FROM items)
SELECT n.group_id, n.ord, n.level, n.marker, (SELECT max(p.ord) FROM n p WHERE p.group_id = n.group_id AND p.ord < n.ord AND p.level < n.level) AS parent_ord FROM n""",
        "outline_depth": f"""{out.replace('WITH ', 'WITH RECURSIVE ', 1)},
d AS (SELECT node_id, 0 AS depth, node_id AS root FROM v_outline WHERE parent_id IS NULL UNION ALL SELECT o.node_id, d.depth + 1, d.root FROM v_outline o JOIN d ON o.parent_id = d.node_id)
SELECT * FROM d""",
        "outline_ranges": f"{out}\nSELECT node_id, parent_id, page_index, greatest(page_index, coalesce(lead(page_index) OVER (PARTITION BY parent_id ORDER BY page_index, ord) - 1, 39)) AS end_page FROM v_outline",
        "outline_links": f"""{out},
kids AS (SELECT parent_id AS up, arg_min(node_id, (ord, node_id)) AS first_id, arg_max(node_id, (ord, node_id)) AS last_id, count(*) AS n FROM v_outline WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT node_id, lag(node_id) OVER w AS prev_id, lead(node_id) OVER w AS next_id, first_id, last_id, coalesce(n, 0) AS n_children FROM v_outline LEFT JOIN kids ON node_id = up WINDOW w AS (PARTITION BY parent_id ORDER BY ord, node_id)""",
        "outline_titles": f"{out}\nSELECT node_id, {cut(12)} AS title FROM v_outline",
        "outline_duplicates": f"{out}\nSELECT level, {cut(120)} AS title, count(*) AS n FROM v_outline GROUP BY 1, 2 HAVING count(*) > 1",
        "outline_dedupe": f"{out}\nSELECT node_id, parent_id, title FROM v_outline QUALIFY row_number() OVER (PARTITION BY parent_id, {cut(120)} ORDER BY ord, node_id) = 1",
        "outline_validate": f"{out}\nSELECT node_id, page_index < 30 AS is_valid, CASE WHEN page_index >= 30 THEN 'page ' || page_index || ' is not in 0-29' END AS error FROM v_outline",
        "outline_shape": f"""{out},
e AS (SELECT *, level = 1 AND ord % 2 = 0 AS gone FROM v_outline WHERE level <= 2)
SELECT c.node_id, CASE WHEN p.gone THEN p.parent_id ELSE c.parent_id END AS parent_id, {cut(120).replace('title', 'c.title')} AS title FROM e c LEFT JOIN e p ON c.parent_id = p.node_id WHERE NOT c.gone""",
        "outline_corrections": f"""{out}
SELECT node_id, CASE WHEN level = 2 AND ord % 3 = 0 THEN 'Renamed ' || ord ELSE title END AS title, CASE WHEN level = 2 AND ord % 3 = 1 THEN 0 ELSE page_index END AS page_index FROM v_outline WHERE NOT (level = 2 AND ord % 3 = 2)""",
        "outline_html": f"""{out}
SELECT parent_id AS section_id, '<section data-id="' || parent_id || '">' || string_agg('<div class="level-' || level || '">' || {esc} || '</div>', chr(10) ORDER BY ord, title) || '</section>' AS html FROM v_outline WHERE parent_id IS NOT NULL GROUP BY 1""",
        "articles_in_ranges": f"""{v.with_sql(v.RUNS)}
SELECT a.user_id AS doc, a.seq AS page_index, b.seq AS section_id, b.seq AS start_page, b.seq + 2 AS end_page FROM v_runs a JOIN v_runs b ON a.user_id = b.user_id AND b.seq % 3 = 0 AND a.seq BETWEEN b.seq AND b.seq + 2""",
        "heading_pages": f"""{v.with_sql(v.SPANS, _BUCKETED)},
l AS (SELECT doc, page_index, bucket, string_agg(text, ' ' ORDER BY x0, span_idx) AS t, min(x0) AS x0, max(x1) AS x1 FROM bucketed GROUP BY 1, 2, 3),
h AS (
  SELECT doc, page_index, (1 - bucket / 792.0::DOUBLE) * 1000 + CASE WHEN (x0 + x1) / 2 / 612.0 BETWEEN 0.1 AND 0.9 THEN 500 ELSE 0 END + CASE WHEN x1 - x0 > 61.2 THEN 200 ELSE 0 END AS score
  FROM l WHERE bucket < 0.3 * 792 AND (page_index % 3 = 1 AND bucket % 7 = 0 OR t = 'SECTION 23 05 13'))
SELECT doc, arg_max(page_index, (score, -page_index)) AS page_index, max(score) AS score FROM h GROUP BY 1""",
        "patch_apply": """WITH tree AS (
  SELECT 'r' || r_regionkey AS node_id, NULL AS parent_id, r_regionkey AS r, -1 AS c, 0 AS level, NULL AS marker, CASE r_regionkey WHEN 2 THEN 'Replaced' ELSE r_name END AS text, 'r' || r_regionkey AS anchor FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_regionkey, n_nationkey, 1,
    CASE n_regionkey WHEN 0 THEN 6 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) ELSE n_nationkey END::VARCHAR, n_name, 'n' || n_nationkey FROM nation
  UNION ALL SELECT 'r1-inserted-1', NULL, 1.5, -1, 0, NULL, 'Inserted', NULL
  UNION ALL SELECT 'r2-inserted-2', 'r2', 2, 1000, 1, 'z', 'Last', NULL),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE r WHEN 3 THEN -1 ELSE r END, c) - 1 AS ord FROM tree WHERE r <> 4)
SELECT 'd' || i AS doc, node_id, parent_id, ord, level::INTEGER AS level, marker, text, anchor FROM placed, range(3) t(i)""",
        "patch_validate": """SELECT * FROM (VALUES (0, 'delete', 'r1', 'OK'), (1, 'replace', 'r2', CASE WHEN contains((SELECT r_name FROM region WHERE r_regionkey = 2), 'A') THEN 'OK' ELSE 'MATCH_FAILED' END), (2, 'replace', 'r2', 'MATCH_FAILED'), (3, 'delete', 'nowhere', 'NOT_FOUND'), (4, 'move', NULL, 'MISSING_ANCHOR')) t(ord, op, target_anchor, verdict)""",
        "column_candidates": f"{v.with_sql(v.SPANS, _CAND)}\nSELECT * FROM cand",
        "table_columns": f"{v.with_sql(v.SPANS, _CAND)}\nSELECT * FROM cols",
        "table_cells": f"{v.with_sql(v.SPANS, _CELLS)}\nSELECT * FROM cells",
        "table_confidence": f"""{v.with_sql(v.SPANS, _CELLS)},
pr AS (SELECT doc, page_index, row, count(*) AS n FROM cells GROUP BY 1, 2, 3), mean AS (SELECT doc, page_index, avg(n) AS mean, count(*) AS n_rows FROM pr GROUP BY 1, 2),
ev AS (SELECT doc, page_index, n_rows, count(*) FILTER (abs(n - mean) <= 2) AS n_even FROM pr JOIN mean USING (doc, page_index) GROUP BY 1, 2, 3), sz AS (SELECT doc, page_index, count(DISTINCT col_idx) AS n_cols FROM cells GROUP BY 1, 2)
SELECT doc, page_index, n_rows, n_cols, 50 + CASE WHEN n_cols >= 3 THEN 20 ELSE 0 END + CASE WHEN n_rows >= 5 THEN 20 ELSE 0 END + CASE WHEN n_even >= 0.8 * n_rows THEN 10 ELSE 0 END AS confidence_pct FROM ev JOIN sz USING (doc, page_index)""",
        "table_csv": f"""{v.with_sql(v.SPANS, _CELLS)},
grid AS (
  SELECT r.doc, r.page_index, r.row, c.col_idx, coalesce(CASE WHEN regexp_matches(cell, '[,"\\n]') THEN '"' || replace(cell, '"', '""') || '"' ELSE cell END, '') AS cell
  FROM (SELECT DISTINCT doc, page_index, row FROM cells) r JOIN (SELECT DISTINCT doc, page_index, col_idx FROM cells) c USING (doc, page_index) LEFT JOIN cells x ON x.doc = r.doc AND x.page_index = r.page_index AND x.row = r.row AND x.col_idx = c.col_idx),
ls AS (SELECT doc, page_index, row, string_agg(cell, ',' ORDER BY col_idx) AS line FROM grid GROUP BY 1, 2, 3)
SELECT doc, page_index, string_agg(line, chr(10) ORDER BY row) AS csv FROM ls GROUP BY 1, 2""",
        "packets": """WITH p AS (SELECT o_custkey::VARCHAR AS doc, o_orderkey AS page_no, o_orderkey % 5 = 0 AS is_cover, o_orderkey % 3 = 0 AS is_unit FROM orders),
r AS (SELECT *, sum(is_cover::INTEGER) OVER (PARTITION BY doc ORDER BY page_no)::BIGINT AS packet FROM p),
g AS (SELECT doc, packet, min(page_no) AS start_page, max(page_no) FILTER (NOT is_unit OR is_cover) AS lp, max(page_no) AS la, bool_or(is_unit AND NOT is_cover) AS u FROM r WHERE packet > 0 GROUP BY 1, 2)
SELECT doc, packet, start_page, CASE WHEN row_number() OVER (PARTITION BY doc ORDER BY packet DESC) = 1 THEN lp ELSE la END AS end_page, CASE WHEN u THEN 'unit-report' ELSE 'cover' END AS type FROM g""",
        "packet_fields": f"{spans}\n{field}",
    }
