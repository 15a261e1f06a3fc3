"""Queries over identifiers, reference data, narratives, merging and inventories, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import merge, narrative, ordering, standards
from . import views as v


def _values(rows, names):
    cell = lambda x: "NULL" if x is None else repr(x) if not isinstance(x, str) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(cell(x) for x in r) + ')' for r in rows)}) t({names})"


NORM_SHEET = "regexp_replace(upper(raw), '[ \\t\\r\\n\\f]+', '', 'g')"


def _six(x: str) -> str:
    return f"substr(rpad(regexp_replace({x}, '[^0-9]', '', 'g'), 6, '0'), 1, 6)"


def _norm_section(x: str) -> str:
    return f"substr({_six(x)}, 1, 2) || ' ' || substr({_six(x)}, 3, 2) || ' ' || substr({_six(x)}, 5, 2)"


NORM = v.SHEETS + f",\nn_sheets AS (SELECT doc, page_index, raw, {NORM_SHEET} AS id FROM v_sheets)"
_PREFIX = "nullif(regexp_extract(upper(trim(id)), '^([A-Z]+)', 1), '')"


def normalized(s, d):
    return v.v_sheets(s, d).withColumn("id", ids.normalize_sheet_id(F.col("raw")))


def titled(s, d):
    """Sheets with a title, so that the ambiguous letter can be told apart."""
    return normalized(s, d).select("doc", "page_index", F.col("id").alias("normalized_id"), v._pick(["SITE PLAN", "CONTROL DIAGRAM", "DETAILS"], F.col("page_index") % 3).alias("title"))


def _dims() -> str:
    dim = [(i, e, c, n, int(o)) for i, e, c, n, _, o, _ in standards.rows("disciplines")]
    div = [(i, n, int(o)) for i, _, n, o in standards.rows("divisions")]
    leg = [(*r[:3], r[4], i) for i, r in enumerate(standards.rows("legacy_sections"))]
    return f"""dims AS (SELECT * FROM {_values(dim, 'discipline_id, eid, code, name, sort_order')}),
divs AS (SELECT * FROM {_values(div, 'd_id, d_name, d_order')}),
legs AS (SELECT * FROM {_values(leg, 'legacy_division, range_lo, range_hi, division_id, ord')}),
als AS (SELECT * FROM {_values(standards.ALIASES, 'alias, code, display_name, confidence_pct')})"""


def _contains_any(words):
    return "(" + " OR ".join(f"contains(upper(title), '{w}')" for w in words) + ")"


_CLASSIFIED = f"""titled AS (SELECT doc, page_index, id AS normalized_id, ['SITE PLAN', 'CONTROL DIAGRAM', 'DETAILS'][page_index % 3 + 1] AS title FROM n_sheets),
prefixed AS (SELECT *, CASE WHEN NOT regexp_matches(normalized_id, '^[0-9]{{2}}[ ][0-9]{{2}}[ ][0-9]{{2}}') THEN nullif(regexp_extract(upper(trim(normalized_id)), '^([A-Z]+)', 1), '') END AS prefix FROM titled),
classified AS (
  SELECT doc, page_index, normalized_id, title, prefix,
    CASE WHEN a.alias IS NOT NULL THEN a.code WHEN prefix = 'C' THEN CASE WHEN {_contains_any(standards.CONTROLS_WORDS)} THEN 'MTEC' ELSE 'CIVL' END ELSE coalesce(l.code, 'UNKN') END AS discipline_code,
    CASE WHEN a.alias IS NOT NULL THEN a.display_name WHEN prefix = 'C' THEN CASE WHEN {_contains_any(standards.CONTROLS_WORDS)} THEN 'Mechanical' ELSE 'Civil' END ELSE coalesce(l.name, 'Unknown') END AS discipline,
    CASE WHEN a.alias IS NULL AND l.code IS NOT NULL AND length(prefix) = 2 THEN substr(prefix, 2, 1) END AS modifier,
    coalesce(CASE WHEN a.alias IS NOT NULL THEN ad.sort_order WHEN prefix = 'C' AND {_contains_any(standards.CONTROLS_WORDS)} THEN (SELECT sort_order FROM dims WHERE code = 'MTEC') ELSE l.sort_order END, 999) AS sort_order,
    CASE WHEN a.alias IS NOT NULL THEN a.confidence_pct WHEN prefix = 'C' THEN CASE WHEN {_contains_any(standards.CONTROLS_WORDS)} OR {_contains_any(standards.CIVIL_WORDS)} THEN 85 ELSE 70 END
      WHEN l.code IS NOT NULL THEN CASE WHEN length(prefix) = 1 THEN 95 ELSE 90 END ELSE 0 END AS confidence_pct,
    CASE WHEN a.alias IS NOT NULL THEN 'ALIAS' WHEN prefix = 'C' THEN 'HEURISTIC' WHEN l.code IS NOT NULL THEN 'UDS' ELSE 'UNKNOWN' END AS basis
  FROM prefixed LEFT JOIN als a ON a.alias = prefix LEFT JOIN dims ad ON ad.code = a.code
    LEFT JOIN dims l ON length(prefix) <= 2 AND l.discipline_id = substr(prefix, 1, 1) AND l.eid LIKE '%\\_' ESCAPE '\\')"""

_MODERN, _LEGACY = "regexp_full_match(trim(code), '[0-9]{2}[ ][0-9]{2}[ ][0-9]{2}')", "regexp_full_match(trim(code), '[0-9]{5}')"
_SECTIONED = f"""legacy AS (
  SELECT code, arg_min(division_id, ord) AS legacy_to FROM (SELECT DISTINCT code FROM v_sections WHERE {_LEGACY}) JOIN legs ON substr(code, 1, 2) = legacy_division AND code BETWEEN range_lo AND range_hi GROUP BY code),
wanted AS (SELECT s.*, l.legacy_to, CASE WHEN {_MODERN.replace('code', 's.code')} THEN substr(s.code, 1, 2) ELSE l.legacy_to END AS wanted FROM v_sections s LEFT JOIN legacy l ON s.code = l.code),
sectioned AS (
  SELECT o_orderkey, code, coalesce(wanted, substr(code, 1, 2)) AS division_id, d_name AS division, coalesce(d_order, coalesce(wanted, substr(code, 1, 2))::INTEGER) AS sort_order,
    CASE WHEN {_MODERN} THEN CASE WHEN d_id IS NOT NULL THEN 100 ELSE 70 END WHEN legacy_to IS NOT NULL THEN CASE WHEN d_id IS NOT NULL THEN 95 ELSE 90 END ELSE 60 END AS confidence_pct,
    CASE WHEN {_MODERN} THEN 'MASTERFORMAT' ELSE 'MASTERFORMAT_LEGACY' END AS basis
  FROM wanted LEFT JOIN divs ON wanted = d_id)"""

SETS = """sets AS (SELECT doc, page_index, id FROM n_sheets),
original AS (SELECT * FROM sets WHERE doc = 'A'), addendum AS (SELECT * FROM sets WHERE doc = 'N')"""


def original(s, d):
    return normalized(s, d).where("doc = 'A'").select("doc", "page_index", "id")


def addendum(s, d):
    return normalized(s, d).where("doc = 'N'").select("doc", "page_index", "id")


def inventory(s, d):
    """Sheets with a confidence and some ids missing."""
    rows = normalized(s, d).select("doc", "page_index", F.when(F.col("page_index") % 17 != 0, F.col("id")).alias("id"), (F.col("page_index") * 7 % 101).cast("int").alias("confidence_pct"))
    return merge.inventory_rows(merge.cover_pages(rows))


INVENTORY = """inv0 AS (SELECT doc, page_index, CASE WHEN page_index % 17 <> 0 THEN id END AS id, (page_index * 7 % 101)::INTEGER AS c FROM n_sheets),
inv AS (
  SELECT *, doc || ':' || page_index || ':' || coalesce(id, 'none') AS uid, CASE WHEN id IS NULL THEN 'error' WHEN confidence_pct < 60 THEN 'low-confidence' ELSE 'ok' END AS status
  FROM (SELECT doc, page_index, CASE WHEN page_index = 0 AND (id IS NULL OR c < 70) THEN 'COVER' ELSE id END AS id, CASE WHEN page_index = 0 AND (id IS NULL OR c < 70) THEN 100 ELSE c END AS confidence_pct FROM inv0))"""


def corrections(rows):
    return rows.where("page_index % 50 = 0").select("uid", (F.col("page_index") % 100 == 0).alias("ignored"), F.when(F.col("page_index") % 100 == 50, F.concat(F.lit("X-"), F.col("page_index").cast("string"))).alias("new_id"))


CORRECTED = """ov AS (SELECT uid, page_index % 100 = 0 AS ignored, CASE WHEN page_index % 100 = 50 THEN 'X-' || page_index END AS new_id FROM inv WHERE page_index % 50 = 0),
corrected AS (
  SELECT doc, page_index, confidence_pct, uid, coalesce(new_id, id) AS id, CASE WHEN new_id IS NOT NULL THEN 'ok' ELSE status END AS status, new_id IS NOT NULL AS is_corrected
  FROM inv LEFT JOIN ov USING (uid) WHERE NOT coalesce(ignored, FALSE))"""

_SUMMARY = "SELECT doc, count(*) AS n_rows, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'low-confidence') AS n_low, count(*) FILTER (status = 'error') AS n_error, count(DISTINCT id) AS n_ids FROM {} GROUP BY 1"


def warnings(s, d):
    words = ["No sheet ID found", "confidence below limit", "duplicate id", "page unmatched", "ROI empty: error", "fallback used (info)", "something failed"]
    return normalized(s, d).where("page_index < 500").select("doc", "page_index", F.concat(v._pick(words, F.col("page_index") % 7), F.lit(" on page "), F.col("page_index").cast("string")).alias("message"))


_HAS = lambda w: f"regexp_matches(low, '(^|[^0-9a-z_]){w}([^0-9a-z_]|$)')"
VERB = f"""CASE WHEN {_HAS('delete')} THEN 'delete' WHEN regexp_matches(low, '^([0-9]+[.][ ]*)?add[ ]+') OR contains(low, 'has been added') THEN 'add' WHEN {_HAS('insert')} THEN 'add'
  WHEN {_HAS('replace')} THEN 'replace' WHEN {_HAS('adjust')} OR {_HAS('revise')} OR {_HAS('revised')} OR {_HAS('re[ ]*-[ ]*issued')} OR {_HAS('reissued')} THEN 'revise' ELSE 'unknown' END"""
_SHEET_RE, _SECTION_RE = ids.SHEET_PATTERN, ids.SECTION_PATTERN
_LINE_IDS = f"""line_lists AS (
  SELECT doc_id, line_no, list_transform(regexp_extract_all(upper(line), '{_SHEET_RE}'), lambda x: regexp_replace(x, '[ \\t\\r\\n\\f]+', '', 'g')) || list_transform(regexp_extract_all(upper(line), '{_SECTION_RE}'), lambda x: {_norm_section('x')}) AS l FROM v_narrative),
line_ids AS (SELECT doc_id, line_no, unnest(list_distinct(l)) AS id FROM line_lists)"""


def narrative_ids(s, d):
    return narrative.line_ids(v.v_narrative(s, d))


def sample_ids(s, d):
    return normalized(s, d).where("doc = 'R' AND page_index % 200 = 0").select("id")


def rename_lines(s, d):
    """Narrative lines with ids of two sets: NEW- and OLD- in lines of their own, both in one, ids in neither."""
    n = F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0")
    new, old, both = (F.concat(F.lit(x), n) for x in ("sheet NEW-", "sheet OLD-", "sheet BOTH-"))
    line = F.when(F.col("line_no") == 1, new).when(F.col("line_no") == 2, "no id here").when(F.col("line_no") == 3, old)
    line = line.when(F.col("line_no") == 4, F.concat(old, F.lit(" is now "), new)).when(F.col("line_no") == 5, F.when(F.col("doc_id") % 3 == 0, both).otherwise(new))
    lines = v.v_narrative(s, d).where("line_no BETWEEN 1 AND 6").select("doc_id", "line_no").distinct()
    return lines.withColumn("line", line.otherwise(old))


def renames(s, d):
    def known(*prefixes):
        return s.createDataFrame([(f"{p}-{i:03d}",) for p in prefixes for i in range(0, 100, 2)], "id string")

    return narrative.rename_suggestions(rename_lines(s, d), known("OLD", "BOTH"), known("NEW", "BOTH"))


def merge_sets(s, d):
    """Many small document sets: a set for each hundred orders, cut by return flag."""
    li = v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    raw = F.concat(v._pick(v.PREFIXES, F.col("l_suppkey") % 13), F.lit("-"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    return li.select(F.expr("l_orderkey div 100").cast("long").alias("set_id"), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("page_index"), F.when(F.col("l_partkey") % 9 != 0, raw).alias("id"))


def queries():
    sec = v.v_sections

    def classified(s, d):
        return standards.classify_disciplines(titled(s, d))

    def with_numbers(s, d):
        return standards.classify_sections(sec(s, d))

    return {
        "normalize_sheet_id": lambda s, d: normalized(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("raw").alias("n_raw")),
        "normalize_section_id": lambda s, d: sec(s, d).select("o_orderkey", ids.normalize_section_id(F.col("code")).alias("section_id")),
        "normalize_section_id_strict": lambda s, d: sec(s, d).select("o_orderkey", ids.normalize_section_id_strict(F.col("code")).alias("section_id")),
        "sheet_prefix": lambda s, d: normalized(s, d).groupBy(ids.sheet_prefix(F.col("id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")),
        "section_format": lambda s, d: sec(s, d).groupBy(ids.section_format(F.col("code")).alias("format")).agg(F.count(F.lit(1)).alias("n")),
        "footer_section_ids": lambda s, d: sec(s, d).select("o_orderkey", ids.footer_section_id(F.concat(F.lit("2020 "), F.replace("code", F.lit(" "), F.lit("-")), F.lit(" TITLE"))).alias("section_id")),
        "section_codes": lambda s, d: sec(s, d).select("o_orderkey", F.array_join(ids.section_codes(F.concat_ws(" and ", "code", "code", F.lit("01-02-03"))), ",").alias("codes")),
        "discipline_classify": lambda s, d: classified(s, d).select("doc", "page_index", "normalized_id", "prefix", "discipline_code", "discipline", "modifier", "sort_order", "confidence_pct", "basis"),
        "discipline_rollup_counts": lambda s, d: classified(s, d).groupBy("discipline_code", "basis").agg(F.count(F.lit(1)).alias("n"), F.min("sort_order").alias("sort_order")),
        "resolve_discipline": lambda s, d: standards.resolve_discipline(s.createDataFrame([(x,) for x in ("a", "MT", "mtec", "ddc", "nothing", "E_")], "term string")),
        "masterformat_classify": lambda s, d: with_numbers(s, d).select("o_orderkey", "code", "division_id", "division", "sort_order", "confidence_pct", "basis"),
        "legacy_range_lookup": lambda s, d: standards.find_legacy(sec(s, d).where(ids.section_format(F.col("code")) == "legacy-5digit")).select("code", "legacy_to"),
        "division_counts": lambda s, d: with_numbers(s, d).groupBy("division_id").agg(F.count(F.lit(1)).alias("n"), F.min("sort_order").alias("sort_order")),
        "standards_overlay": lambda s, d: standards.overlay(standards.divisions(s), s.createDataFrame([("03", None, "Own Concrete", None), ("97", "OWN_", "Own", 97)], "division_id string, code string, name string, sort_order int"), "division_id", s.createDataFrame([("49",)], "division_id string")),
        "natural_sort_rank": lambda s, d: ordering.natural_rank(normalized(s, d)),
        "drawings_row_order": lambda s, d: ordering.drawings_order(classified(s, d)).select("doc", "page_index", "normalized_id", "place"),
        "specs_row_order": lambda s, d: ordering.specs_order(with_numbers(s, d)).select("o_orderkey", "code", "sort_order", "place"),
        "split_drawings_groups": lambda s, d: ordering.split_drawings(titled(s, d), ["A", "C", "E", "FP", "M", "S"]),
        "split_specs_section": lambda s, d: ordering.split_specs(sec(s, d)),
        "split_specs_division": lambda s, d: ordering.split_specs(sec(s, d), "division"),
        "assemble_order": lambda s, d: ordering.assemble_order(ordering.split_drawings(titled(s, d), ["A", "C", "E", "FP", "M", "S"])),
        "narr_verbs": lambda s, d: narrative.parse_actions(v.v_narrative(s, d)),
        "narr_sections": lambda s, d: narrative.parse_sections(v.v_narrative(s, d)),
        "narr_line_ids": narrative_ids,
        "narr_duplicates": lambda s, d: narrative.duplicate_ids(v.v_narrative(s, d).select(F.expr("doc_id div 100").alias("doc_id"), (F.col("doc_id") * 10 + F.col("line_no")).alias("line_no"), "line").transform(narrative.line_ids)),
        "validate_exact": lambda s, d: narrative.match_exactly(narrative_ids(s, d).where("doc_id % 10 = 0"), original(s, d)).where("status <> 'NOT_FOUND'"),
        "validate_ambiguous": lambda s, d: narrative.match_exactly(addendum(s, d), original(s, d)).where("status = 'AMBIGUOUS'"),
        "validate_not_found": lambda s, d: narrative.match_exactly(addendum(s, d), original(s, d)).where("status = 'NOT_FOUND'").select("id"),
        "validate_near": lambda s, d: narrative.near_matches(sample_ids(s, d), original(s, d)),
        "validate_not_mentioned": lambda s, d: narrative.not_mentioned(addendum(s, d), original(s, d)),
        "line_rename_suggestions": renames,
        "merge_replace_only": lambda s, d: merge.replace_pages(original(s, d), addendum(s, d)),
        "merge_unmatched": lambda s, d: merge.unmatched_pages(original(s, d), addendum(s, d)),
        "merge_summary": lambda s, d: merge.merge_summary(original(s, d), addendum(s, d)),
        "merge_full": lambda s, d: merge.plan_merge(merge_sets(s, d)),
        "merge_id_map": lambda s, d: merge.id_map(normalized(s, d)),
        "document_sequence": lambda s, d: merge.with_document_sequence(v.table(s, d, "events").select(F.col("user_id").alias("set_id"), F.col("event_id").alias("row_no"), (F.col("event_id") * 31 % 17).alias("page"))),
        "inventory_rows": lambda s, d: inventory(s, d),
        "inventory_summary": lambda s, d: merge.summary(inventory(s, d)),
        "corrected_inventory": lambda s, d: merge.apply_corrections(inventory(s, d), corrections(inventory(s, d))),
        "corrected_summary": lambda s, d: merge.summary(merge.apply_corrections(inventory(s, d), corrections(inventory(s, d)))),
        "issue_codes": lambda s, d: merge.warning_issues(warnings(s, d)),
        "unmatched_issues": lambda s, d: merge.unmatched_issues(merge.unmatched_pages(original(s, d), addendum(s, d).where("page_index % 50 = 0"))),
    }


def oracle_sql():
    norm, sections, narr = v.with_sql(NORM), v.with_sql(v.SECTIONS), v.with_sql(v.NARRATIVE)
    dims = _dims()
    key = ids.natural_key_sql
    split = """groups AS (
  SELECT doc, CASE WHEN prefix IN ('A', 'C', 'E', 'FP', 'M', 'S') THEN prefix ELSE '_OTHER' END AS "group", page_index, id, {k} AS k FROM (SELECT *, {p} AS prefix FROM n_sheets)),
split AS (SELECT doc, "group", count(*) AS page_count, count(DISTINCT id) AS n_ids, arg_min(page_index, (id IS NULL, k, page_index)) AS start_page, arg_max(page_index, (id IS NULL, k, page_index)) AS end_page FROM groups GROUP BY 1, 2)""".format(k=key("id"), p=_PREFIX)
    status = "SELECT n.id, coalesce(c.n, 0) AS n, CASE WHEN c.n IS NULL THEN 'NOT_FOUND' WHEN c.n = 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS status FROM (SELECT DISTINCT id FROM {}) n LEFT JOIN (SELECT id, count(*) AS n FROM original GROUP BY 1) c USING (id)"
    ids_add = "(SELECT DISTINCT id FROM addendum)"
    foot = "regexp_extract('2020 ' || replace(code, ' ', '-') || ' TITLE', '{}')"
    pats = ["23 [0-9]{2} [0-9]{2}", "23-[0-9]{2}-[0-9]{2}", "23[.][0-9]{2}[.][0-9]{2}", "23 - [0-9]{2} - [0-9]{2}"]
    footer = "coalesce(" + ", ".join(f"nullif({foot.format(p)}, '')" for p in pats) + ")"
    head = "regexp_matches(line, '(?i)^SECTION[ ]+[0-9]')"
    resolved = ", ".join(f"(SELECT max(code) FROM {t} WHERE {k} = upper(term)) AS by_{n}" for n, t, k in (("id", "(SELECT * FROM dims WHERE eid LIKE '%\\_' ESCAPE '\\')", "discipline_id"), ("eid", "dims", "eid"), ("code", "dims", "code"), ("alias", "als", "alias")))
    return {
        "normalize_sheet_id": f"{norm}\nSELECT id, count(*) AS n, count(DISTINCT raw) AS n_raw FROM n_sheets GROUP BY 1",
        "normalize_section_id": f"{sections}\nSELECT o_orderkey, {_norm_section('code')} AS section_id FROM v_sections",
        "normalize_section_id_strict": f"{sections}\nSELECT o_orderkey, CASE WHEN length(regexp_replace(code, '[^0-9]', '', 'g')) = 6 THEN {_norm_section('code')} ELSE '' END AS section_id FROM v_sections",
        "sheet_prefix": f"{norm}\nSELECT {_PREFIX} AS prefix, count(*) AS n FROM n_sheets GROUP BY 1",
        "section_format": f"{sections}\nSELECT CASE WHEN {_MODERN} THEN 'modern-6digit' WHEN {_LEGACY} THEN 'legacy-5digit' ELSE 'invalid' END AS format, count(*) AS n FROM v_sections GROUP BY 1",
        "footer_section_ids": f"{sections}\nSELECT o_orderkey, {_norm_section(footer)} AS section_id FROM v_sections",
        "section_codes": f"{sections}\nSELECT o_orderkey, CASE WHEN {_MODERN} AND code <> '01 02 03' THEN code || ',01 02 03' ELSE '01 02 03' END AS codes FROM v_sections",
        "discipline_classify": f"{v.with_sql(NORM, dims, _CLASSIFIED)}\nSELECT doc, page_index, normalized_id, prefix, discipline_code, discipline, modifier, sort_order, confidence_pct, basis FROM classified",
        "discipline_rollup_counts": f"{v.with_sql(NORM, dims, _CLASSIFIED)}\nSELECT discipline_code, basis, count(*) AS n, min(sort_order) AS sort_order FROM classified GROUP BY 1, 2",
        "resolve_discipline": f"""WITH {dims}
SELECT term, coalesce(by_id, by_eid, by_code, by_alias) AS resolved, CASE WHEN by_id IS NOT NULL THEN 'id' WHEN by_eid IS NOT NULL THEN 'eid' WHEN by_code IS NOT NULL THEN 'code' WHEN by_alias IS NOT NULL THEN 'alias' END AS way
FROM (SELECT term, {resolved} FROM {_values([(x,) for x in ('a', 'MT', 'mtec', 'ddc', 'nothing', 'E_')], 'term')})""",
        "masterformat_classify": f"{v.with_sql(v.SECTIONS, dims, _SECTIONED)}\nSELECT * FROM sectioned",
        "legacy_range_lookup": f"{v.with_sql(v.SECTIONS, dims, _SECTIONED)}\nSELECT * FROM legacy",
        "division_counts": f"{v.with_sql(v.SECTIONS, dims, _SECTIONED)}\nSELECT division_id, count(*) AS n, min(sort_order) AS sort_order FROM sectioned GROUP BY 1",
        "standards_overlay": f"""WITH b AS (SELECT * FROM {_values([(i, c, n, int(o)) for i, c, n, o in standards.rows('divisions')], 'division_id, code, name, sort_order')}),
c AS (SELECT * FROM {_values([('03', None, 'Own Concrete', None), ('97', 'OWN_', 'Own', 97)], 'division_id, code, name, sort_order')})
SELECT division_id, coalesce(c.code, b.code) AS code, coalesce(c.name, b.name) AS name, coalesce(c.sort_order, b.sort_order) AS sort_order FROM b FULL JOIN c USING (division_id) WHERE division_id <> '49'""",
        "natural_sort_rank": f"{norm}\nSELECT id, row_number() OVER (ORDER BY {key('id')}, id) - 1 AS place FROM (SELECT DISTINCT id FROM n_sheets)",
        "drawings_row_order": f"{v.with_sql(NORM, dims, _CLASSIFIED)}\nSELECT doc, page_index, normalized_id, row_number() OVER (PARTITION BY doc ORDER BY sort_order, {key('normalized_id')}, page_index) AS place FROM classified",
        "specs_row_order": f"""{v.with_sql(v.SECTIONS, dims, _SECTIONED)}
SELECT o_orderkey, code, sort_order, row_number() OVER (PARTITION BY sort_order ORDER BY CASE WHEN {_MODERN} THEN replace(code, ' ', '')::INTEGER END NULLS LAST, o_orderkey) AS place FROM sectioned""",
        "split_drawings_groups": f"{norm},\n{split}\nSELECT * FROM split",
        "split_specs_section": f"{sections}\nSELECT code AS \"group\", count(*) AS page_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM v_sections GROUP BY 1",
        "split_specs_division": f"{sections}\nSELECT substr(code, 1, 2) AS \"group\", count(*) AS page_count, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM v_sections GROUP BY 1",
        "assemble_order": f"""{norm},\n{split},
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY "group" = '_OTHER', coalesce(list_position(['A', 'C', 'E', 'M', 'P', 'S'], "group"), 0) = 0, coalesce(list_position(['A', 'C', 'E', 'M', 'P', 'S'], "group"), 0), "group") AS place FROM split)
SELECT doc, "group", place, (sum(page_count) OVER (PARTITION BY doc ORDER BY place) - page_count)::BIGINT AS first_output_page FROM ranked""",
        "narr_verbs": f"""{narr}
SELECT doc_id, line_no, verb, CASE WHEN verb <> 'unknown' THEN nullif(regexp_extract(line, ':[ ]*(.+)$', 1), '') END AS target
FROM (SELECT *, {VERB} AS verb FROM (SELECT *, lower(line) AS low FROM v_narrative WHERE NOT {head}))""",
        "narr_sections": f"""{narr},
blocks AS (SELECT *, sum(CASE WHEN {head} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS block FROM v_narrative),
heads AS (SELECT doc_id, block, arg_min(line, line_no) AS header, count(*) - 1 AS n_lines, min(line_no) AS first_line, max(line_no) AS last_line FROM blocks WHERE block > 0 GROUP BY 1, 2)
SELECT doc_id, block, {_norm_section("regexp_extract(header, 'SECTION[ ]+([0-9 .-]+)', 1)")} AS section_id, regexp_extract(header, '-[ ]*(.*)$', 1) AS title, n_lines, first_line, last_line FROM heads""",
        "narr_line_ids": f"{narr},\n{_LINE_IDS}\nSELECT * FROM line_ids",
        "narr_duplicates": f"{narr},\n{_LINE_IDS}\nSELECT doc_id // 100 AS doc_id, id, count(*) AS n, min(doc_id * 10 + line_no) AS first_line FROM line_ids GROUP BY 1, 2 HAVING count(*) > 1",
        "validate_exact": f"{v.with_sql(NORM, SETS, v.NARRATIVE, _LINE_IDS)}\nSELECT * FROM ({status.format('(SELECT * FROM line_ids WHERE doc_id % 10 = 0)')}) WHERE status <> 'NOT_FOUND'",
        "validate_ambiguous": f"{norm},\n{SETS}\nSELECT * FROM ({status.format('addendum')}) WHERE status = 'AMBIGUOUS'",
        "validate_not_found": f"{norm},\n{SETS}\nSELECT id FROM {ids_add} ANTI JOIN original USING (id)",
        "validate_near": f"""{norm},\n{SETS},
scored AS (
  SELECT w.id, i.id AS candidate, 1 - levenshtein(w.id, i.id) / greatest(length(w.id), length(i.id))::DOUBLE AS similarity
  FROM (SELECT DISTINCT id FROM n_sheets WHERE doc = 'R' AND page_index % 200 = 0) w, (SELECT DISTINCT id FROM original) i)
SELECT id, candidate, similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, candidate) AS place FROM scored WHERE similarity >= 0.75) WHERE place <= 3""",
        "validate_not_mentioned": f"{norm},\n{SETS}\nSELECT id FROM {ids_add} ANTI JOIN original USING (id) ORDER BY id LIMIT 50",
        "line_rename_suggestions": """WITH l AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber::INTEGER AS line_no, lpad((l_orderkey % 100)::VARCHAR, 3, '0') AS n FROM lineitem WHERE l_orderkey % 2 = 0)
SELECT doc_id, line_no, 'NEW-' || n AS new_id, 'OLD-' || n AS old_id, 'two_id_match' AS reason FROM l WHERE line_no = 4
UNION ALL SELECT doc_id, line_no, 'NEW-' || n, 'OLD-' || n, 'context_match'
FROM (SELECT *, lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l WHERE line_no IN (1, 3, 4, 5, 6))
WHERE line_no IN (3, 6) AND (before = 1 OR before = 5 AND doc_id % 3 <> 0)""",
        "merge_replace_only": f"""{norm},\n{SETS},
firsts AS (SELECT id, min(page_index) AS old_place FROM original GROUP BY 1),
both_ AS (SELECT doc, page_index, id, page_index AS old_place, 0 AS second, 'kept' AS status FROM original ANTI JOIN addendum USING (id) UNION ALL SELECT doc, page_index, id, old_place, 1, 'replaced' FROM addendum JOIN firsts USING (id))
SELECT row_number() OVER (ORDER BY old_place, second, page_index) - 1 AS pos, doc, page_index, id, status FROM both_""",
        "merge_unmatched": f"{norm},\n{SETS}\nSELECT doc, page_index, id, 'unmatched' AS reason FROM addendum ANTI JOIN original USING (id)",
        "merge_summary": f"""{norm},\n{SETS}
SELECT (SELECT count(*) FROM original ANTI JOIN addendum USING (id)) AS n_kept, (SELECT count(*) FROM original SEMI JOIN addendum USING (id)) AS n_removed,
  (SELECT count(*) FROM addendum SEMI JOIN original USING (id)) AS n_replaced, (SELECT count(*) FROM addendum ANTI JOIN original USING (id)) AS n_unmatched""",
        "merge_id_map": f"{norm}\nSELECT doc, id, count(*) AS n, min(page_index) AS first_page, count(*) > 1 AS is_duplicate FROM n_sheets GROUP BY 1, 2",
        "document_sequence": """SELECT set_id, row_no, page, sum(is_new) OVER (PARTITION BY set_id ORDER BY row_no)::BIGINT AS doc_no
FROM (SELECT *, CASE WHEN page < lag(page) OVER (PARTITION BY set_id ORDER BY row_no) THEN 1 ELSE 0 END AS is_new FROM (SELECT user_id AS set_id, event_id AS row_no, event_id * 31 % 17 AS page FROM events))""",
        "inventory_rows": f"{norm},\n{INVENTORY}\nSELECT * FROM inv",
        "inventory_summary": f"{norm},\n{INVENTORY}\n{_SUMMARY.format('inv')}",
        "corrected_inventory": f"{norm},\n{INVENTORY},\n{CORRECTED}\nSELECT * FROM corrected",
        "corrected_summary": f"{norm},\n{INVENTORY},\n{CORRECTED}\n{_SUMMARY.format('corrected')}",
        "issue_codes": f"""{norm},
w AS (SELECT doc, page_index, ['No sheet ID found', 'confidence below limit', 'duplicate id', 'page unmatched', 'ROI empty: error', 'fallback used (info)', 'something failed'][page_index % 7 + 1] || ' on page ' || page_index AS message FROM n_sheets WHERE page_index < 500)
SELECT *, ['warning', 'warning', 'warning', 'warning', 'error', 'info', 'error'][page_index % 7 + 1] AS severity, ['NO_ID', 'LOW_CONFIDENCE', 'DUPLICATE', 'UNMATCHED', 'ROI_DETECTION_FAILURE', 'LEGACY_FALLBACK', 'UNKNOWN'][page_index % 7 + 1] AS code FROM w""",
        "unmatched_issues": f"""{norm},\n{SETS}
SELECT doc, 'unmatched' AS reason, 'UNMATCHED' AS code, 'warning' AS severity, count(*) AS n_pages, string_agg('page-' || page_index, ', ' ORDER BY page_index) AS page_list
FROM addendum ANTI JOIN original USING (id) WHERE page_index % 50 = 0 GROUP BY 1""",
    }
