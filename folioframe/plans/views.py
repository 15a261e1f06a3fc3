"""Deterministic layout views over the driver's tables, in Spark and as DuckDB common table expressions.

All arithmetic is on integers, so that both engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers

#: Order keys in a range of which the sheets of a document are numbered in one task.
KEYS = 4096
PREFIXES = ["A", "AD", "C", "E", "FA", "FP", "M", "P", "S", "DDC", "G", "Q", "ZZZ"]
SEPARATORS = ["-", ".", " - "]
SUFFIXES = ["", "A", "ES"]
VERBS = ["Delete paragraph", "Add the following", "Insert after 2.1", "Replace table", "Adjust height", "Coordinate with"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("source", "doc_id", F.split("text", "\n", -1).alias("parts")).select("source", "doc_id", F.size("parts").alias("n_lines"), F.posexplode("parts").alias("line_no", "line"))


LINES = """v_lines AS (
  SELECT source, doc_id, len(parts) AS n_lines, unnest(range(len(parts)))::INTEGER AS line_no, unnest(parts) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))"""


def v_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each line; a document is a page of its source."""
    pages = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id")
    pages = pages.select("source", "doc_id", (F.dense_rank().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("page_index"))
    lines = v_lines(spark, sf_dir).withColumn("n", F.length("line")).join(pages, ["source", "doc_id"])
    y0 = F.expr("36 + (720 * line_no) div n_lines")
    x0 = F.expr("72 + 18 * (n % 4)")
    bold = (F.col("line_no") == 0) | (F.col("n") % 7 == 0)
    return lines.select(
        F.col("source").alias("doc"), "page_index", F.col("line_no").alias("span_idx"), F.col("line").alias("text"),
        x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + 6 * F.least("n", F.lit(80))).cast("double").alias("x1"), (y0 + 10 + F.expr("n % 5")).cast("double").alias("y1"),
        F.when(bold, "Sans-Bold").otherwise("Sans").alias("font_name"), (F.col("n") % 8 + 9).cast("double").alias("font_size"), bold.alias("is_bold"),
        (F.col("n") % 11 == 0).alias("is_italic"), (F.col("n") % 13 == 0).alias("is_fixed"),
        (F.col("doc_id") % 4 * 90).cast("int").alias("rotation"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
    )


SPANS = (
    LINES
    + """,
v_spans AS (
  SELECT source AS doc, (dense_rank() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INTEGER AS page_index, line_no AS span_idx, line AS text,
    x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + 6 * least(n, 80))::DOUBLE AS x1, (y0 + 10 + n % 5)::DOUBLE AS y1,
    CASE WHEN line_no = 0 OR n % 7 = 0 THEN 'Sans-Bold' ELSE 'Sans' END AS font_name, (n % 8 + 9)::DOUBLE AS font_size,
    (line_no = 0 OR n % 7 = 0) AS is_bold, n % 11 = 0 AS is_italic, n % 13 = 0 AS is_fixed,
    (doc_id % 4 * 90)::INTEGER AS rotation, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height
  FROM (SELECT *, length(line) AS n, 72 + 18 * (length(line) % 4) AS x0, 36 + (720 * line_no) // n_lines AS y0 FROM v_lines))"""
)


def _pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))


def _sql_pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) + 1]"


def v_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheet ids as written: a document set for each return flag, ``A`` the original."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", *order)
    # rows without an order key come first
    li = li.withColumn("keys", F.coalesce(F.expr(f"l_orderkey div {KEYS}"), F.lit(-(1 << 62))))
    li = row_numbers(li, ["l_returnflag"], ["keys"], [], order, "page_index")
    raw = F.concat(_pick(PREFIXES, F.col("l_suppkey") % 13), F.col("l_linenumber").cast("string"), _pick(SEPARATORS, F.col("l_orderkey") % 3), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), _pick(SUFFIXES, F.col("l_partkey") % 3))
    return li.select(F.col("l_returnflag").alias("doc"), F.col("page_index").cast("int").alias("page_index"), raw.alias("raw"))


SHEETS = f"""v_sheets AS (
  SELECT l_returnflag AS doc, (row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS page_index,
    {_sql_pick(PREFIXES, 'l_suppkey % 13')} || l_linenumber || {_sql_pick(SEPARATORS, 'l_orderkey % 3')} || lpad((l_partkey % 100)::VARCHAR, 2, '0') || {_sql_pick(SUFFIXES, 'l_partkey % 3')} AS raw
  FROM lineitem)"""


def v_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    legacy = F.lpad((cust % 50 * 1000 + key % 1000).cast("string"), 5, "0")
    modern = F.concat(two(cust % 50), F.lit(" "), two(key % 100), F.lit(" "), two(F.expr("(o_orderkey div 100) % 100")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 4 == 0, legacy).otherwise(modern).alias("code"))


SECTIONS = """v_sections AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN lpad((o_custkey % 50 * 1000 + o_orderkey % 1000)::VARCHAR, 5, '0')
    ELSE lpad((o_custkey % 50)::VARCHAR, 2, '0') || ' ' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' ' || lpad(((o_orderkey // 100) % 100)::VARCHAR, 2, '0') END AS code
  FROM orders)"""


def v_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed page footers of each customer's document, with gaps."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    base = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", i.alias("i"))
    code = F.concat(F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0"), F.lit(" "), F.lpad(F.expr("(i div 3) % 100").cast("string"), 2, "0"), F.lit(" 00"))
    return base.select(
        F.col("o_custkey").alias("doc_id"), F.col("i").alias("page_index"), F.when(F.col("o_orderkey") % 7 != 0, code).alias("section_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("i") % 3 + 1).alias("page_in_section")
    )


FOOTERS = """v_footers AS (
  SELECT o_custkey AS doc_id, i AS page_index,
    CASE WHEN o_orderkey % 7 <> 0 THEN lpad((o_custkey % 50)::VARCHAR, 2, '0') || ' ' || lpad(((i // 3) % 100)::VARCHAR, 2, '0') || ' 00' END AS section_id,
    CASE WHEN o_orderkey % 11 <> 0 THEN i % 3 + 1 END AS page_in_section
  FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS i FROM orders))"""


def v_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), "event_type")


RUNS = "v_runs AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS seq, event_type FROM events)"


def v_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A four-level outline: region, nation, customer, order."""

    def level(name, key, parent, letter, above, depth, title):
        parent_id = F.concat(F.lit(above), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")
        return table(spark, sf_dir, name).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("node_id"), parent_id.alias("parent_id"), F.lit(depth).alias("level"), F.col(key).cast("bigint").alias("ord"), title.alias("title"), (F.col(key) % 40).cast("int").alias("page_index")
        )

    out = level("region", "r_regionkey", None, "r", "", 0, F.col("r_name"))
    out = out.unionByName(level("nation", "n_nationkey", "n_regionkey", "n", "r", 1, F.col("n_name")))
    out = out.unionByName(level("customer", "c_custkey", "c_nationkey", "c", "n", 2, F.col("c_name")))
    number = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("."), (F.col("o_orderkey") % 5).cast("string"), F.lit("  Order  "), (F.col("o_orderkey") % 97).cast("string"))
    return out.unionByName(level("orders", "o_orderkey", "o_custkey", "o", "c", 3, number))


OUTLINE = """v_outline AS (
  SELECT 'r' || r_regionkey AS node_id, NULL::VARCHAR AS parent_id, 0 AS level, r_regionkey::BIGINT AS ord, r_name AS title, (r_regionkey % 40)::INTEGER AS page_index FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, n_nationkey, n_name, n_nationkey % 40 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 2, c_custkey, c_name, c_custkey % 40 FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 3, o_orderkey, (o_orderkey % 9 + 1) || '.' || (o_orderkey % 5) || '  Order  ' || (o_orderkey % 97), o_orderkey % 40 FROM orders)"""


def v_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change narratives: a document for each order, a section header and a line for each item."""
    header = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("line_no"), F.concat(F.lit("SECTION "), F.lpad((F.col("o_custkey") % 50).cast("string"), 2, "0"), F.lit(" "), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(" 00 - TITLE")).alias("line"))
    sheet = F.concat(_pick(PREFIXES, F.col("l_suppkey") % 13), F.col("l_linenumber").cast("string"), F.lit("-"), F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), _pick(VERBS, F.col("l_linenumber") % 6), F.lit(" of sheet "), sheet, F.lit(": item "), (F.col("l_partkey") % 7).cast("string"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("line_no"), line.alias("line"))
    return header.unionByName(items)


NARRATIVE = f"""v_narrative AS (
  SELECT o_orderkey AS doc_id, 0 AS line_no, 'SECTION ' || lpad((o_custkey % 50)::VARCHAR, 2, '0') || ' ' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || ' 00 - TITLE' AS line FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber || '. ' || {_sql_pick(VERBS, 'l_linenumber % 6')} || ' of sheet ' ||
    {_sql_pick(PREFIXES, 'l_suppkey % 13')} || l_linenumber || '-' || lpad((l_partkey % 100)::VARCHAR, 2, '0') || ': item ' || (l_partkey % 7) FROM lineitem)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)
