"""Reading layouts, profiles and outlines; fonts, regions and vector lines."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "doc string, page_index int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, is_bold boolean, is_italic boolean, is_fixed boolean, color string, width double, height double, rotation int"
_LAYOUT = (
    "filePath string, extractionEngine string, extractionDate string, metadata struct<totalPages:int,hasTrueTextLayer:boolean>, pages array<struct<pageIndex:int,width:double,height:double,rotation:int,"
    "spans:array<struct<text:string,bbox:array<double>,fontName:string,fontSize:double,flags:struct<isBold:boolean,isItalic:boolean,isFixedPitch:boolean>,color:string>>,"
    "lines:array<struct<start:array<double>,end:array<double>,width:double>>>>"
)


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout JSON files, one document each, as rows of documents with nested pages."""
    return spark.read.schema(_LAYOUT).option("multiLine", True).json(path)


def spans_of(layouts: DataFrame) -> DataFrame:
    """A row for each span."""
    pages = layouts.select(F.col("filePath").alias("doc"), F.explode("pages").alias("p"))
    spans = pages.select("doc", "p", F.posexplode("p.spans").alias("span_idx", "s"))
    flag = lambda name: F.coalesce(F.col(f"s.flags.{name}"), F.lit(False))
    return spans.select(
        "doc", F.col("p.pageIndex").alias("page_index"), "span_idx", F.col("s.text").alias("text"), *[F.get("s.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.col("s.fontName").alias("font_name"), F.col("s.fontSize").alias("font_size"),
        flag("isBold").alias("is_bold"), flag("isItalic").alias("is_italic"), flag("isFixedPitch").alias("is_fixed"), F.col("s.color").alias("color"), F.col("p.width").alias("width"), F.col("p.height").alias("height"), F.col("p.rotation").alias("rotation"),
    )


def vector_lines(layouts: DataFrame, least: float = 10.0, slack: float = 2.0) -> DataFrame:
    """Vector lines longer than ``least``, with their direction: horizontal or vertical within ``slack``, else other."""
    lines = layouts.select(F.col("filePath").alias("doc"), F.explode("pages").alias("p")).select("doc", "p", F.posexplode("p.lines").alias("line_idx", "l"))
    flat = lines.select("doc", F.col("p.pageIndex").alias("page_index"), "line_idx", *[F.get(f"l.{a}", F.lit(i)).alias(n) for n, a, i in (("x_start", "start", 0), ("y_start", "start", 1), ("x_end", "end", 0), ("y_end", "end", 1))], F.col("p.width").alias("width"), F.col("p.height").alias("height"))
    dx, dy = F.abs(F.col("x_end") - F.col("x_start")), F.abs(F.col("y_end") - F.col("y_start"))
    return flat.where(F.sqrt(dx * dx + dy * dy) > least).withColumn("direction", F.when(dy <= slack, "horizontal").when(dx <= slack, "vertical").otherwise("other"))


def font_flags(font: Column) -> dict[str, Column]:
    """Bold, italic and fixed by the font's name."""
    low = F.lower(font)
    any_of = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return {"is_bold": any_of("bold", "black", "heavy"), "is_italic": any_of("italic", "oblique"), "is_fixed": any_of("mono", "courier", "consol", "fixed")}


def flag_bits(flags: Column) -> dict[str, Column]:
    """Bold (16), italic (1) and fixed (4) of a bit field."""
    return {"is_bold": flags.bitwiseAND(16) != 0, "is_italic": flags.bitwiseAND(1) != 0, "is_fixed": flags.bitwiseAND(4) != 0}


#: Parsers by engine: bytes of a file and its path to span rows (dicts of ``SPAN``).
PARSERS: dict[str, Callable[[bytes, str], Iterable[dict]]] = {}


def parse_layout_json(content: bytes, path: str) -> Iterable[dict]:
    """The parser of layout JSON, and a model for others."""
    layout = json.loads(content)
    for page in layout["pages"]:
        for i, s in enumerate(page["spans"]):
            flags = s.get("flags") or {}
            x0, y0, x1, y1 = s["bbox"]
            yield {
                "doc": layout.get("filePath") or path, "page_index": page["pageIndex"], "span_idx": i, "text": s["text"], "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "font_name": s.get("fontName"), "font_size": float(s.get("fontSize") or 0),
                "is_bold": bool(flags.get("isBold")), "is_italic": bool(flags.get("isItalic")), "is_fixed": bool(flags.get("isFixedPitch")), "color": s.get("color"), "width": float(page["width"]), "height": float(page["height"]), "rotation": int(page.get("rotation") or 0),
            }


PARSERS["json"] = parse_layout_json


def engines() -> dict[str, bool]:
    """Which engines are there."""
    import importlib.util

    return {"json": True, "pymupdf": importlib.util.find_spec("fitz") is not None} | {name: True for name in PARSERS}


def read_binary(spark: SparkSession, path: str, prefer: tuple[str, ...] = ("json",), pages: list[int] | None = None) -> DataFrame:
    """Files parsed by the first engine of ``prefer`` that is there; a broken file gives no spans."""
    name = next((e for e in prefer if e in PARSERS), None)
    if name is None:
        raise ValueError(f"no engine of {prefer} is there; known are {sorted(PARSERS)}")
    parse = PARSERS[name]
    wanted = set(pages) if pages is not None else None
    columns = [c.split(" ")[0] for c in SPAN.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path_, content in zip(frame.path, frame.content):
                try:
                    rows = [r for r in parse(bytes(content), path_) if wanted is None or r["page_index"] in wanted]
                except (ValueError, KeyError, TypeError):
                    rows = []
                yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SPAN)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


_ROI = "struct<x:double,y:double,width:double,height:double>"
_PROFILE = f"name string, version string, sheetId struct<rois:array<{_ROI}>,regex:string,anchorKeywords:array<string>>, sheetTitle struct<rois:array<{_ROI}>,maxLength:int>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Layout profiles (JSON) as rows ``profile, kind, roi_ord, x, y, w, h, problems``."""
    raw = spark.read.schema(_PROFILE).option("multiLine", True).json(path)
    kinds = [raw.select(F.col("name").alias("profile"), F.lit(k).alias("kind"), F.posexplode(f"{k}.rois").alias("roi_ord", "r")) for k in ("sheetId", "sheetTitle")]
    rois = kinds[0].unionByName(kinds[1]).select("profile", "kind", "roi_ord", F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.width").alias("w"), F.col("r.height").alias("h"))
    return rois.withColumn("problems", roi_problems(*[F.col(c) for c in "xywh"]))


def write_profiles(profiles: DataFrame, path: str) -> None:
    profiles.write.mode("append").json(path)


def roi_problems(x: Column, y: Column, w: Column, h: Column) -> Column:
    """What is wrong with a region in shares of the page; empty if nothing is."""
    checks = [(~x.between(0, 1), "x"), (~y.between(0, 1), "y"), (~((w > 0) & (w <= 1)), "width"), (~((h > 0) & (h <= 1)), "height"), (x + w > 1, "right"), (y + h > 1, "top")]
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks]))


def parse_roi(text: Column) -> Column:
    """``x,y,w,h`` as a struct; null where it isn't four numbers."""
    parts = F.split(text, ",")
    numbers = [F.try_element_at(parts, F.lit(i + 1)).try_cast("double") for i in range(4)]
    return F.when(F.size(parts) == 4, F.struct(*[n.alias(c) for n, c in zip(numbers, "xywh")]))


def roi_to_absolute(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """A region in points with a top-left origin."""
    return {"x0": x * width, "y0": height * (1 - y - h), "x1": (x + w) * width, "y1": height * (1 - y)}


def flatten_outline(spark: SparkSession, tree: list[dict]) -> DataFrame:
    """A nested outline (``title, page, children``) as rows in reading order; a child without page has its parent's."""
    rows: list[tuple] = []

    def walk(nodes: list[dict], parent: int | None, level: int, page: int | None) -> None:
        for node in nodes:
            at = node.get("page", page)
            rows.append((len(rows), parent, level, node.get("title"), at))
            walk(node.get("children") or [], len(rows) - 1, level + 1, at)

    walk(tree, None, 0, None)
    return spark.createDataFrame(rows, "ord int, parent_ord int, level int, title string, page_index int")
