"""Quality scores and structure detectors over canonical spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import round_half_up

HEADINGS = [
    ("^(?i)SECTION[ ]+[0-9]{2}[ ]+[0-9]{2}[ ]+[0-9]{2}([^0-9A-Za-z_]|$)", 1, 90),
    ("^(?i)PART[ ]+[0-9]+", 1, 90),
    ("^[0-9]+[.][0-9]+[ ]+[A-Z]", 2, 80),
    ("^[0-9]+[.][0-9]+[.][0-9]+[ ]+[A-Z]", 3, 70),
    ("^[A-Z][A-Z0-9 ]{2,}$", 2, 60),
]


def ordering_sanity(spans: DataFrame) -> DataFrame:
    """``doc, page_index, n_spans, n_in_place``: spans whose place in input order is at most 2 from that by (y in steps of 5, x)."""
    page = Window.partitionBy("doc", "page_index")
    ranked = spans.select("doc", "page_index", (F.row_number().over(page.orderBy("span_idx")) - F.row_number().over(page.orderBy(F.floor(F.col("y0") / 5), "x0", "span_idx"))).alias("d"))
    return ranked.groupBy("doc", "page_index").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.abs("d") <= 2).alias("n_in_place"))


def page_quality(spans: DataFrame) -> DataFrame:
    """Counts and confidence of each page; pages without characters have confidence 0."""
    bare = F.regexp_replace("text", F.lit("[ \\t\\r\\n\\f]"), F.lit(""))
    sums = spans.groupBy("doc", "page_index").agg(
        F.sum(F.length("text")).alias("n_chars"), F.sum(F.length("text") - F.length(bare)).alias("n_white"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("n_replaced")
    )
    q = sums.join(ordering_sanity(spans), ["doc", "page_index"])
    n = F.col("n_chars").cast("double")
    ocr = (F.col("n_chars") == 0) | (F.col("n_replaced") / n > 0.05) | (F.col("n_chars") < 50)
    sanity = F.when(F.col("n_chars") == 0, 0.0).when(F.col("n_spans") <= 1, 1.0).otherwise(F.col("n_in_place") / F.col("n_spans").cast("double"))
    q = q.withColumns({"ocr_needed": F.coalesce(ocr, F.lit(True)), "ordering_sanity": sanity, "white_ratio": F.when(F.col("n_chars") == 0, 0.0).otherwise(F.col("n_white") / n)})
    lost = F.col("n_replaced") / n
    confidence = (
        F.when(F.col("ocr_needed"), 0.5).otherwise(1.0) * F.when(F.col("white_ratio") > 0.5, 0.8).otherwise(1.0)
        * F.when(F.col("n_replaced") > 0, F.greatest(F.lit(0.5), 1 - lost)).otherwise(1.0) * F.when(F.col("ordering_sanity") < 0.8, 0.9).otherwise(1.0)
    )
    return q.withColumn("confidence", F.when(F.col("n_chars") == 0, 0.0).otherwise(confidence)).drop("n_spans", "n_in_place")


def doc_quality(pages: DataFrame) -> DataFrame:
    """Gates of each document over ``page_quality``: means are over pages with text."""
    some = F.col("n_chars") > 0
    agg = pages.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_chars").alias("n_chars"), F.sum("n_replaced").alias("n_replaced"), F.avg(F.when(some, F.col("ordering_sanity"))).alias("sanity"),
        F.avg(F.when(some, F.col("confidence"))).alias("conf"), F.min("n_chars").alias("least_chars"),
    )
    gates = {
        "gate_chars": F.col("least_chars") >= 50,
        "gate_replacement": F.col("n_replaced") <= 0.05 * F.col("n_chars"),
        "gate_ordering": F.coalesce(F.col("sanity") >= 0.8, F.lit(False)),
        "gate_confidence": F.coalesce(F.col("conf") >= 0.85, F.lit(False)),
        "ocr_needed": (F.col("n_replaced") > 0.05 * F.col("n_chars")) | (F.col("n_chars") < 50 * F.col("n_pages")),
    }
    out = agg.withColumns(gates)
    issues = F.array_compact(
        F.array(
            F.when(~F.col("gate_chars"), "few-characters"), F.when(~F.col("gate_replacement"), "replacement-characters"), F.when(~F.col("gate_ordering"), "ordering"), F.when(~F.col("gate_confidence"), "confidence"), F.when(F.col("ocr_needed"), "ocr")
        )
    )
    passes = F.col("gate_chars") & F.col("gate_replacement") & F.col("gate_ordering") & F.col("gate_confidence")
    return out.select("doc", "n_pages", "n_chars", "gate_chars", "gate_replacement", "gate_ordering", "gate_confidence", "ocr_needed", passes.alias("passes"), F.array_join(issues, ",").alias("issues"))


def _page_count(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc").agg(F.countDistinct("page_index").alias("n_pages"))


def band_pages(spans: DataFrame, kind: str) -> DataFrame:
    """``doc, band, page_index``: pages with a span in the upper (``header``) or lower 15 %, by height in steps of 10."""
    at = F.col("y0") if kind == "header" else F.col("y1")
    inside = at < 0.15 * F.col("height") if kind == "header" else at > 0.85 * F.col("height")
    return spans.where(inside).select("doc", "page_index", (round_half_up(at / 10) * 10).alias("band")).distinct()


def _recurring(pages: DataFrame, key: str, total: DataFrame) -> DataFrame:
    found = pages.groupBy("doc", key).agg(F.count(F.lit(1)).alias("n_on"), F.array_join(F.sort_array(F.collect_list("page_index")).cast("array<string>"), ",").alias("page_list")).where("n_on >= 2")
    return found.join(total, "doc").select("doc", key, "n_on", "page_list", F.least(F.lit(1.0), F.col("n_on") / F.col("n_pages").cast("double")).alias("confidence"))


def detect_bands(spans: DataFrame, kind: str) -> DataFrame:
    """Bands that two pages or more of a document share."""
    return _recurring(band_pages(spans, kind), "band", _page_count(spans))


def column_hints(spans: DataFrame) -> DataFrame:
    """Left edges, in steps of 20, that two pages or more share."""
    pages = spans.select("doc", "page_index", (round_half_up(F.col("x0") / 20) * 20).alias("column_x")).distinct()
    return _recurring(pages, "column_x", _page_count(spans))


def page_columns(spans: DataFrame) -> DataFrame:
    """Left edges in steps of 20 on each single page."""
    return spans.groupBy("doc", "page_index").agg(F.countDistinct(round_half_up(F.col("x0") / 20)).alias("n_columns"), F.count(F.lit(1)).alias("n_spans"))


def font_clusters(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc", (round_half_up(F.col("font_size") * 2) / 2).alias("size")).agg(F.count(F.lit(1)).alias("n_spans"))


def chrome_flags(spans: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Adds ``in_chrome``: the page has a sure header or footer band and the span's centre is in that 15 % of it, or within 20."""
    flagged = spans
    for kind in ("header", "footer"):
        sure = detect_bands(spans, kind).where(F.col("confidence") >= least_confidence).select("doc", "band")
        pages = band_pages(spans, kind).join(sure, ["doc", "band"], "left_semi").select("doc", "page_index").distinct().withColumn(f"has_{kind}", F.lit(True))
        flagged = flagged.join(pages, ["doc", "page_index"], "left")
    centre, h = (F.col("y0") + F.col("y1")) / 2, F.col("height")
    inside = (F.col("has_header").isNotNull() & (centre < 0.15 * h + 20)) | (F.col("has_footer").isNotNull() & (centre > 0.85 * h - 20))
    return flagged.withColumn("in_chrome", inside).drop("has_header", "has_footer")


def heading_candidates(spans: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Large or bold spans outside of chrome that look like a heading; level and confidence in hundredths of the first pattern that fits."""
    text = F.trim("text")
    centre, h = (F.col("y0") + F.col("y1")) / 2, F.col("height")
    rejected = (centre > 0.15 * h + 0.75 * 0.7 * h) | text.rlike("(?i)(^|[^0-9A-Za-z_])(DIVISION|DIV)[ ]+01([^0-9A-Za-z_]|$)")
    level, score = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (pattern, lv, sc) in reversed(list(enumerate(HEADINGS))):
        hit = text.rlike(pattern) & (~rejected if i == 0 else F.lit(True))
        level, score = F.when(hit, lv).otherwise(level), F.when(hit, sc).otherwise(score)
    likely = chrome_flags(spans, least_confidence).where(((F.col("font_size") >= 12) | F.col("is_bold")) & ~F.col("in_chrome"))
    found = likely.withColumn("level", level).where("level IS NOT NULL")
    total = score + F.when(F.col("is_bold"), 10).otherwise(0) + F.when(F.col("font_size") >= 14, 10).otherwise(0)
    return found.select("doc", "page_index", "span_idx", text.alias("heading"), "level", F.least(F.lit(100), total).alias("confidence_pct"))


def line_tables(lines: DataFrame) -> DataFrame:
    """Pages with more than 10 vector lines, more than half a line to 100 x 100 points, and the lines' box."""
    xs, ys = [F.col("x_start"), F.col("x_end")], [F.col("y_start"), F.col("y_end")]
    found = lines.groupBy("doc", "page_index", "width", "height").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min(F.least(*xs)).alias("x0"), F.min(F.least(*ys)).alias("y0"), F.max(F.greatest(*xs)).alias("x1"), F.max(F.greatest(*ys)).alias("y1")
    )
    density = F.col("n_lines") / (F.col("width") * F.col("height") / 10_000)
    return found.withColumn("density", density).where("n_lines > 10 AND density > 0.5")


def density_histogram(spans: DataFrame, bins: int = 100) -> DataFrame:
    """How many spans of a document are in each of the equal bins of its first page's height; a span's end is exclusive."""
    height = spans.groupBy("doc").agg(F.min_by("height", "page_index").alias("page_height"))
    inside = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c) / F.col("page_height")))
    placed = spans.join(height, "doc").select("doc", F.floor(inside("y0") * bins).alias("first"), F.ceil(inside("y1") * bins).alias("end"))
    covered = placed.where(F.col("first") < F.col("end")).select("doc", F.explode(F.sequence("first", F.col("end") - 1)).alias("bin"))
    return covered.groupBy("doc", "bin").agg(F.count(F.lit(1)).alias("n_spans"))


def page_regions(spans: DataFrame, bins: int = 100, top: int = 12, bottom: int = 88) -> DataFrame:
    """Header, body and footer of each document, as shares of the page height.

    Of the bins above ``top`` those with more than 0.3 of their mean begin the
    header and those with more than 0.5 end it; of the bins from ``bottom`` on
    those with more than 0.5 begin the footer and those with more than 0.3 end
    it.  Without such bins the zone's own ends count.  A header that reaches
    into the footer ends above it, and the body lies between, inside
    ``top`` and ``bottom``.
    """
    hist = density_histogram(spans, bins)
    zones = hist.groupBy("doc").agg(
        (F.sum(F.when(F.col("bin") < top, F.col("n_spans"))) / float(top)).alias("head"), (F.sum(F.when(F.col("bin") >= bottom, F.col("n_spans"))) / float(bins - bottom)).alias("foot")
    )
    joined = hist.join(zones, "doc")
    in_head = lambda share: (F.col("bin") < top) & (F.col("n_spans") > F.col("head") * share)
    in_foot = lambda share: (F.col("bin") >= bottom) & (F.col("n_spans") > F.col("foot") * share)
    edges = joined.groupBy("doc").agg(
        F.coalesce(F.min(F.when(in_head(0.3), F.col("bin"))), F.lit(0)).alias("a"),
        F.coalesce(F.max(F.when(in_head(0.5), F.col("bin") + 1)), F.lit(top)).alias("b"),
        F.coalesce(F.min(F.when(in_foot(0.5), F.col("bin"))), F.lit(bottom)).alias("c"),
        F.coalesce(F.max(F.when(in_foot(0.3), F.col("bin") + 1)), F.lit(bins)).alias("d"),
    )
    edges = edges.withColumn("b", F.when(F.col("b") > F.col("c"), F.least(F.col("b"), F.col("c") - 1)).otherwise(F.col("b")))
    share = lambda x, name: (x / F.lit(float(bins))).alias(name)
    return edges.select(
        "doc", share(F.col("a"), "header_top"), share(F.col("b"), "header_bottom"), share(F.greatest("b", F.lit(top)), "body_top"), share(F.least("c", F.lit(bottom)), "body_bottom"), share(F.col("c"), "footer_top"), share(F.col("d"), "footer_bottom"),
    )


def title_block(spans: DataFrame, word: str = "SHEET", reach: float = 300.0, pad: float = 20.0) -> DataFrame:
    """The box around all spans whose corner is within ``reach`` of a span that has the word, on each page."""
    page = ["doc", "page_index"]
    marks = spans.where(F.contains(F.upper("text"), F.lit(word))).select(*page, F.col("x0").alias("mx"), F.col("y0").alias("my"))
    near = spans.join(marks, page).where((F.col("x0") - F.col("mx")) ** 2 + (F.col("y0") - F.col("my")) ** 2 <= reach * reach)
    return near.groupBy(*page).agg((F.min("x0") - pad).alias("x0"), (F.min("y0") - pad).alias("y0"), (F.max("x1") + pad).alias("x1"), (F.max("y1") + pad).alias("y1"))


def band_definitions(spans: DataFrame) -> DataFrame:
    """Where each document's header ends and footer begins: its bands and 20 more, else 15 % and 85 % of the page."""
    size = spans.groupBy("doc").agg(F.max("height").alias("h"))
    top = detect_bands(spans, "header").groupBy("doc").agg(F.max("band").alias("top"))
    bottom = detect_bands(spans, "footer").groupBy("doc").agg(F.min("band").alias("bottom"))
    joined = size.join(top, "doc", "left").join(bottom, "doc", "left")
    return joined.select("doc", F.coalesce((F.col("top") + 20).cast("double"), 0.15 * F.col("h")).alias("header_end"), F.coalesce((F.col("bottom") - 20).cast("double"), 0.85 * F.col("h")).alias("footer_start"))


def title_block_filter(x0: Column, y0: Column, x1: Column, y1: Column, box: tuple[float, float, float, float]) -> Column:
    a, b, c, d = box
    return (x0 >= a) & (y0 >= b) & (x1 <= c) & (y1 <= d)
