"""Readers, sinks and the streaming extension."""

import hashlib
import hmac
import json

import pytest
from folioframe.functions import shapes
from folioframe.operators import detect, geometry, lines, merge, tables
from folioframe.sources import layout, sinks
from folioframe.streaming import runs
from pyspark.sql import functions as F

LAYOUT = {
    "filePath": "a.pdf", "extractionEngine": "test", "extractionDate": "2024-01-01", "metadata": {"totalPages": 2, "hasTrueTextLayer": True},
    "pages": [
        {"pageIndex": 0, "width": 612, "height": 792, "rotation": 90, "spans": [{"text": "One", "bbox": [10, 20, 40, 30], "fontName": "Sans", "fontSize": 10, "flags": {"isBold": True}}], "lines": [{"start": [0, 0], "end": [100, 1]}, {"start": [0, 0], "end": [3, 3]}, {"start": [5, 0], "end": [5, 40]}]},
        {"pageIndex": 1, "width": 612, "height": 792, "rotation": 0, "spans": [{"text": "Two", "bbox": [1, 2, 3, 4], "fontName": "Sans", "fontSize": 10}]},
    ],
}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(LAYOUT))
    return str(tmp_path)


def test_layout(spark, folder):
    layouts = layout.read_layouts(spark, folder)
    rows = layout.spans_of(layouts).orderBy("page_index").collect()
    assert [(r.text, r.is_bold, r.rotation, r.x1) for r in rows] == [("One", True, 90, 40.0), ("Two", False, 0, 3.0)]
    assert {(r.line_idx, r.direction) for r in layout.vector_lines(layouts).collect()} == {(0, "horizontal"), (2, "vertical")}
    same = layout.read_binary(spark, folder).orderBy("page_index").collect()
    assert [r.asDict() for r in same] == [r.asDict() for r in rows]
    assert layout.read_binary(spark, folder, pages=[1]).count() == 1
    assert layout.engines()["json"] and layout.file_hashes(spark, folder).first().sha256 == hashlib.sha256(json.dumps(LAYOUT).encode()).hexdigest()
    with pytest.raises(ValueError):
        layout.read_binary(spark, folder, prefer=("none",))


def test_broken_file(spark, tmp_path):
    (tmp_path / "b.json").write_text("{")
    assert layout.read_binary(spark, str(tmp_path)).count() == 0


def test_profiles(spark, tmp_path):
    rois = [{"x": 0.8, "y": 0.0, "width": 0.2, "height": 0.1}, {"x": 0.9, "y": -1.0, "width": 0.2, "height": 0.0}]
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "version": "1", "sheetId": {"rois": rois}, "sheetTitle": {"rois": rois[:1]}}))
    got = {(r.kind, r.roi_ord): r.problems for r in layout.read_profiles(spark, str(tmp_path)).collect()}
    assert got == {("sheetId", 0): [], ("sheetId", 1): ["y", "height", "right"], ("sheetTitle", 0): []}
    t = spark.createDataFrame([("0.1,0.2,0.3,0.4",), ("1,2",), ("a,b,c,d",)], "t string").select(layout.parse_roi(F.col("t")).alias("r")).collect()
    assert t[0].r.h == 0.4 and t[1].r is None and t[2].r.x is None


def test_outline(spark):
    tree = [{"title": "A", "page": 3, "children": [{"title": "B"}, {"title": "C", "page": 5, "children": [{"title": "D"}]}]}]
    rows = layout.flatten_outline(spark, tree).orderBy("ord").collect()
    assert [(r.title, r.parent_ord, r.level, r.page_index) for r in rows] == [("A", None, 0, 3), ("B", 0, 1, 3), ("C", 0, 1, 5), ("D", 2, 2, 5)]


def test_fonts_and_hmac(spark):
    row = spark.range(1).select(*[c.alias(n) for n, c in layout.font_flags(F.lit("CourierNew-BoldItalic")).items()], shapes.hmac_sha256("key", F.lit("text")).alias("h"), *[c.alias(f"b_{n}") for n, c in layout.flag_bits(F.lit(17)).items()]).first()
    assert row.is_bold and row.is_italic and row.is_fixed and row.b_is_bold and row.b_is_italic and not row.b_is_fixed
    assert row.h == hmac.new(b"key", b"text", hashlib.sha256).hexdigest()


def test_streaming_runs(spark, tmp_path):
    data = [(1, i, f"2024-01-01 00:00:{i:02d}", k) for i, k in enumerate("aabbbcab")]
    events = spark.createDataFrame(data, "user_id long, event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    for n, part in enumerate((events.where("event_id < 4"), events.where("event_id >= 4"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = runs.streaming_runs(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.run_no, r.event_type, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "a", 2), (2, "b", 3), (3, "c", 1), (4, "a", 1)]


def test_canonical_twice_is_once(spark):
    spans = spark.createDataFrame([("d", 0, i, f"t{i}", float(9 - i), float(i % 3), 20.0, 5.0, "S", 10.0, False, False, False, 90 * (i % 4), 612.0, 792.0) for i in range(8)], "doc string, page_index int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, is_bold boolean, is_italic boolean, is_fixed boolean, rotation int, width double, height double")
    once = geometry.canonicalize(spans)
    twice = geometry.canonicalize(once.drop("rank", "span_key"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    shuffled = geometry.canonicalize(spans.orderBy(F.rand(3)).repartition(5))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, shuffled.collect()))
    assert geometry.content_hash(once).first() == geometry.content_hash(shuffled).first()


def test_flip_to_top_left(spark):
    spans = spark.createDataFrame([(780.0, 10.0, 792.0), (10.0, 20.0, 792.0)], "y0 double, y1 double, height double")
    assert [(r.flipped, r.y0, r.y1) for r in geometry.to_top_left(spans).collect()] == [(True, 12.0, 782.0), (False, 10.0, 20.0)]


def test_line_tables(spark):
    many = spark.createDataFrame([("d", 0, float(i), 0.0, float(i), 50.0, 100.0, 100.0) for i in range(11)], "doc string, page_index int, x_start double, y_start double, x_end double, y_end double, width double, height double")
    (row,) = detect.line_tables(many).collect()
    assert (row.x0, row.x1, row.y1, row.n_lines) == (0.0, 10.0, 50.0, 11)


def test_first_fit(spark):
    spans = spark.createDataFrame([("d", 0, i, y, 0.0) for i, y in enumerate((0.0, 4.0, 8.0, 12.0, 3.0))], "doc string, page_index int, span_idx int, y0 double, x0 double")
    assert {r.span_idx: r.line_id for r in lines.first_fit_lines(spans).collect()} == {0: 0, 4: 0, 1: 0, 2: 1, 3: 1}


def test_merge_plan(spark):
    rows = [(1, 0, 0, "A-1"), (1, 0, 1, "A-2"), (1, 0, 2, "A-2"), (1, 0, 3, None), (1, 1, 0, "A-2"), (1, 1, 1, "A-10"), (1, 1, 2, None), (1, 2, 0, "A-2"), (1, 2, 1, "A-1.5")]
    pages = spark.createDataFrame(rows, "set_id long, source int, page_index long, id string")
    plan = sorted((r.pos, r.source, r.page_index, r.id, r.status) for r in merge.plan_merge(pages).collect())
    assert plan == [(-1, 1, 2, None, "no-id"), (0, 0, 0, "A-1", "kept"), (1, 2, 1, "A-1.5", "inserted"), (2, 2, 0, "A-2", "replaced"), (3, 1, 1, "A-10", "inserted"), (4, 0, 3, None, "kept")]
    strict = {(r.source, r.page_index) for r in merge.plan_merge(pages, strict_compat=True).where("pos >= 0").collect()}
    assert (1, 0) in strict and (2, 0) not in strict
    assert merge.plan_merge(pages, "append-only").where("pos >= 0").count() == 9
    ranges = sorted((r.output_page, r.source, r.first_page, r.last_page) for r in sinks.page_copy_plan(merge.plan_merge(pages, "append-only")).collect())
    assert ranges == [(0, 0, 0, 3), (4, 1, 0, 2), (7, 2, 0, 1)]


def test_merged_columns(spark):
    xs = spark.createDataFrame([("d", 0, x) for x in (0, 5, 12, 30)], "doc string, page_index int, x long")
    assert [r.x for r in tables.merge_columns(xs).orderBy("col_idx").collect()] == [7.25, 30.0]
