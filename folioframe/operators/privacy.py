"""Abstraction of texts to placeholders, and how often they repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes

KEYWORDS = ["SECTION", "PART", "DIVISION", "SHEET", "DRAWING", "SCHEDULE", "DETAIL", "NOTE", "NOTES"]


def _shaped(spans: DataFrame) -> DataFrame:
    """Spans with the features of their texts and the placeholder made of them, each computed once."""
    text = F.col("text")
    out = spans.withColumns({"token_class": shapes.token_class(text), "token_shape": shapes.token_shape(text), "length_bucket": shapes.length_bucket(text), "flag_bits": shapes.flag_bits(text)})
    return out.withColumn("placeholder_id", shapes.placeholder(*[F.col(c) for c in ("token_class", "token_shape", "length_bucket", "flag_bits")])).drop("flag_bits")


def abstract_spans(spans: DataFrame, mode: str = "strict") -> DataFrame:
    """Spans with placeholder, class, shape and bucket in place of the text.

    In mode ``whitelist`` texts that are, or begin with, a keyword keep it as
    their shape and have the class KEYWORD.
    """
    text = F.col("text")
    out = _shaped(spans)
    if mode == "whitelist":
        first = F.regexp_extract(F.upper(F.trim(text)), "^([^ ]*)", 1)
        listed = F.upper(F.trim(text)).isin(KEYWORDS) | first.isin(KEYWORDS)
        out = out.withColumns({"token_class": F.when(listed, "KEYWORD").otherwise(F.col("token_class")), "token_shape": F.when(listed, text).otherwise(F.col("token_shape"))})
    return out.withColumn("original_length", F.length(text)).drop("text")


def vault(spans: DataFrame) -> DataFrame:
    """Each placeholder's first text, how often it stands for one, and on how many pages."""
    keyed = _shaped(spans)
    place = F.struct("doc", "page_index", "span_idx")
    return keyed.groupBy("placeholder_id").agg(F.min_by("text", place).alias("first_text"), F.count(F.lit(1)).alias("n"), F.countDistinct("doc", "page_index").alias("n_pages"))


def repetition(spans: DataFrame) -> DataFrame:
    """For each placeholder of a document: spans, pages, share of pages, and spans in header, body and footer."""
    keyed = _shaped(spans)
    total = spans.groupBy("doc").agg(F.countDistinct("page_index").alias("total"))
    centre = (F.col("y0") + F.col("y1")) / 2
    head, foot = centre < 0.15 * F.col("height"), centre > 0.85 * F.col("height")
    got = keyed.groupBy("doc", "placeholder_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_index").alias("n_pages"), F.count_if(head).alias("n_header"), F.count_if(foot).alias("n_footer"), F.count_if(~head & ~foot).alias("n_body"))
    return got.join(total, "doc").select("doc", "placeholder_id", "n", "n_pages", (F.col("n_pages") / F.col("total").cast("double")).alias("page_share"), "n_header", "n_body", "n_footer")


def leaks(abstract: DataFrame) -> DataFrame:
    """Rows whose placeholder isn't in the form that placeholders have."""
    return abstract.where(~F.col("placeholder_id").rlike("^PLACEHOLDER_[0-9a-f]{12}$"))


def sample_spans(spans: DataFrame, every: int = 3) -> DataFrame:
    """All spans of each ``every``-th page, and of the others those in header, footer or bold."""
    centre = (F.col("y0") + F.col("y1")) / 2
    return spans.where((F.col("page_index") % every == 0) | (centre < 0.15 * F.col("height")) | (centre > 0.85 * F.col("height")) | F.col("is_bold"))


def pseudonymize(rows: DataFrame, column: str, key: str) -> DataFrame:
    return rows.withColumn(column, F.substring(shapes.hmac_sha256(key, F.col(column)), 1, 16))
