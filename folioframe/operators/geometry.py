"""Canonical geometry of spans: rotation, corners, order, hashes, regions and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: name, first and last share of the page height; bands overlap
BANDS = [("header", 0.0, 0.12), ("heading", 0.0, 0.3), ("body", 0.12, 0.88), ("footer", 0.88, 1.0)]
#: ANSI and ARCH sheets in inches, long side first
SHEET_SIZES = [(11.0, 8.5), (17.0, 11.0), (22.0, 17.0), (34.0, 22.0), (44.0, 34.0), (12.0, 9.0), (18.0, 12.0), (24.0, 18.0), (36.0, 24.0), (42.0, 30.0), (48.0, 36.0)]


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def unrotate(spans: DataFrame) -> DataFrame:
    """Boxes as seen on the upright page; width and height change places at 90 and 270 degrees."""
    r, w, h = F.col("rotation"), F.col("width"), F.col("height")
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def turned(at90, at180, at270, same):
        return F.when(r == 90, at90).when(r == 180, at180).when(r == 270, at270).otherwise(same)

    return spans.withColumns(
        {
            "x0": turned(h - y1, w - x1, y0, x0), "y0": turned(x0, h - y1, w - x1, y0), "x1": turned(h - y0, w - x0, y1, x1), "y1": turned(x1, h - y0, w - x0, y1),
            "width": F.when(r.isin(90, 270), h).otherwise(w), "height": F.when(r.isin(90, 270), w).otherwise(h), "rotation": F.lit(0),
        }
    )


def order_corners(spans: DataFrame) -> DataFrame:
    return spans.withColumns({"x0": F.least("x0", "x1"), "y0": F.least("y0", "y1"), "x1": F.greatest("x0", "x1"), "y1": F.greatest("y0", "y1")})


def rank_spans(spans: DataFrame) -> DataFrame:
    """Reading order by exact (y, x, input order), and the span's key made from it."""
    w = Window.partitionBy("doc", "page_index").orderBy("y0", "x0", "span_idx")
    ranked = spans.withColumn("rank", F.row_number().over(w) - 1)
    return ranked.withColumn("span_key", F.concat(F.lit("page"), F.col("page_index").cast("string"), F.lit("_span"), F.col("rank").cast("string")))


def canonicalize(spans: DataFrame) -> DataFrame:
    return rank_spans(order_corners(unrotate(spans)))


def _number(c: str) -> Column:
    """Six decimals, so that fractions count and equal numbers look alike."""
    return F.col(c).cast("decimal(18,6)").cast("string")


def _hash(spans: DataFrame, head: list[Column], line: Column, name: str) -> DataFrame:
    """A hash of each page's head, number of spans and lines, and one of these in order for each document."""
    lines = F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("lines")
    pages = spans.select("doc", "page_index", "rank", line.alias("line"), F.concat_ws(",", *head).alias("head"))
    pages = pages.groupBy("doc", "page_index").agg(lines, F.min("head").alias("head"))
    whole = F.concat(F.col("head"), F.lit(","), F.size("lines").cast("string"), F.lit("\n"), F.array_join(F.col("lines.line"), "\n"))
    per_page = pages.select("doc", "page_index", F.sha2(whole, 256).alias("page_hash"))
    docs = per_page.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page_index", "page_hash"))).alias("pages"))
    return docs.select("doc", F.sha2(F.array_join(F.col("pages.page_hash"), "\n"), 256).alias(name))


def content_hash(spans: DataFrame) -> DataFrame:
    """A hash of each document's page sizes, texts, boxes and fonts: pages are hashed, then the pages' hashes in order."""
    line = F.concat_ws("|", "text", *[_number(c) for c in ("x0", "y0", "x1", "y1")], "font_name", _number("font_size"))
    return _hash(spans, [_number("width"), _number("height")], line, "content_hash")


def span_hash(spans: DataFrame) -> DataFrame:
    """A hash of each document's layout without its texts."""
    flags = [F.col(c).cast("int").cast("string") for c in ("is_bold", "is_italic", "is_fixed")]
    line = F.concat_ws("|", "span_key", *[_number(c) for c in ("x0", "y0", "x1", "y1")], "font_name", _number("font_size"), *flags)
    return _hash(spans, [F.col("page_index").cast("string")], line, "span_hash")


def to_top_left(spans: DataFrame) -> DataFrame:
    """Boxes with a bottom-left origin are flipped: those with y0 in the upper fifth and y1 in the lower one, or y0 > y1."""
    h = F.col("height")
    inverted = ((F.col("y0") > 0.8 * h) & (F.col("y1") < 0.2 * h)) | (F.col("y0") > F.col("y1"))
    return spans.withColumns({"flipped": inverted, "y0": F.when(inverted, h - F.col("y0")).otherwise(F.col("y0")), "y1": F.when(inverted, h - F.col("y1")).otherwise(F.col("y1"))})


def spans_in_rois(spans: DataFrame, rois: DataFrame, mode: str = "strict", threshold: float = 0.5, pad: float = 0.0) -> DataFrame:
    """Spans inside regions of interest (``roi, x, y, w, h`` in shares, bottom-left origin).

    ``strict``: the whole box; ``overlap``: at least ``threshold`` of its area,
    and a box without area by its corner.  The regions are a handful of rows
    that a caller writes, hence the broadcast.
    """
    r = F.broadcast(rois.select("roi", *[F.col(c).alias(f"r_{c}") for c in ("x", "y", "w", "h")]))
    w, h = F.col("width"), F.col("height")
    left, right = F.greatest(F.lit(0.0), F.col("r_x") - pad) * w, F.least(F.lit(1.0), F.col("r_x") + F.col("r_w") + pad) * w
    top, bottom = F.greatest(F.lit(0.0), 1 - F.col("r_y") - F.col("r_h") - pad) * h, F.least(F.lit(1.0), 1 - F.col("r_y") + pad) * h
    joined = spans.crossJoin(r)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    if mode == "strict":
        return joined.where((x0 >= left) & (x1 <= right) & (y0 >= top) & (y1 <= bottom)).drop("r_x", "r_y", "r_w", "r_h")
    area = (x1 - x0) * (y1 - y0)
    shared = F.greatest(F.lit(0.0), F.least(x1, right) - F.greatest(x0, left)) * F.greatest(F.lit(0.0), F.least(y1, bottom) - F.greatest(y0, top))
    point = (x0 >= left) & (x0 <= right) & (y0 >= top) & (y0 <= bottom)
    return joined.where(F.when(area > 0, shared >= threshold * area).otherwise(point)).drop("r_x", "r_y", "r_w", "r_h")


def band_flags(spans: DataFrame) -> DataFrame:
    """Which of the overlapping standard bands hold a span's centre."""
    centre = (F.col("y0") + F.col("y1")) / 2
    return spans.withColumns({f"in_{name}": (centre >= a * F.col("height")) & (centre <= b * F.col("height")) for name, a, b in BANDS})


def remove_chrome(spans: DataFrame, header: DataFrame, footer: DataFrame) -> DataFrame:
    """Spans between a page's header and footer; bands as from ``detect_bands`` with one row per page."""
    top = header.groupBy("doc", "page_index").agg(F.max("band").alias("top_band"))
    bottom = footer.groupBy("doc", "page_index").agg(F.min("band").alias("bottom_band"))
    joined = spans.join(top, ["doc", "page_index"], "left").join(bottom, ["doc", "page_index"], "left")
    centre = (F.col("y0") + F.col("y1")) / 2
    above = F.col("top_band").isNotNull() & (centre < F.greatest(0.15 * F.col("height"), F.col("top_band") + 20))
    below = F.col("bottom_band").isNotNull() & (centre > F.least(0.85 * F.col("height"), F.col("bottom_band") - 20))
    return joined.where(~above & ~below).drop("top_band", "bottom_band")


def is_sheet_size(width: Column, height: Column) -> Column:
    """Landscape and within half an inch of a standard sheet, or with sides of 8 to 50 inches."""
    w, h = width / 72, height / 72
    near = [(F.abs(w - a) <= 0.5) & (F.abs(h - b) <= 0.5) for a, b in SHEET_SIZES]
    standard = near[0]
    for n in near[1:]:
        standard = standard | n
    return (w > h) & (standard | (w.between(8, 50) & h.between(8, 50)))
