"""Values that the operators must give by their definition, worked out by hand."""

import pytest
from folioframe.operators import detect, geometry, narrative, sequence


def runs(spark, values, pages=None):
    rows = [(1, i, x, p) for i, (x, p) in enumerate(zip(values, pages or [None] * len(values)))]
    table = spark.createDataFrame(rows, "doc_id int, page_index int, section_id string, page_in_section int")
    return sorted(tuple(r)[2:] for r in sequence.section_runs(table).collect())


def test_runs(spark):
    X, Y = "23 05 00", "23 07 00"
    assert runs(spark, [None, X, None, X, None]) == [(X, 1, 4, 4)]
    assert runs(spark, [X, X, None, Y, Y]) == [(X, 0, 2, 3), (Y, 3, 4, 2)]
    assert runs(spark, [X, X, X, X], [1, 2, 1, 2]) == [(X, 0, 1, 2), (X, 2, 3, 2)]
    # a number that returns to 1 without an id ends the run
    assert runs(spark, [X, X, None, None, X], [1, 2, 1, 2, 3]) == [(X, 0, 1, 2), (X, 4, 4, 1)]
    assert runs(spark, [None, None]) == []


def test_renames(spark):
    def found(*lines):
        table = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, line string")
        old, new = (spark.createDataFrame([(x,) for x in ids], "id string") for ids in (["A-1", "A-2", "E-5"], ["B-1", "B-2", "E-5"]))
        return [tuple(r)[1:] for r in narrative.rename_suggestions(table, old, new).orderBy("line_no").collect()]

    assert found("sheet A-1 is now sheet B-1") == [(0, "B-1", "A-1", "two_id_match")]
    assert found("Sheet B-1 added", "formerly", "A-1") == [(2, "B-1", "A-1", "context_match")]
    assert found("A-1", "B-1") == [] and found("B-1", "E-5", "A-1") == [] and found("B-1 A-1 A-2") == [] and found("B-1", "B-2 A-2", "A-1") == [(1, "B-2", "A-2", "two_id_match")]


def span(i, y0, y1, x0=10.0, page=0, width=600.0, height=1000.0):
    return ("d", page, i, f"t{i}", x0, float(y0), 100.0, float(y1), "F", 10.0, False, False, False, 0, width, height)


SPANS = "doc string, page_index int, span_idx int, text string, x0 double, y0 double, x1 double, y1 double, font_name string, font_size double, is_bold boolean, is_italic boolean, is_fixed boolean, rotation int, width double, height double"


def test_hashes_see_fractions_and_page_sizes(spark):
    def hashes(*spans):
        table = geometry.canonicalize(spark.createDataFrame(list(spans), SPANS))
        return geometry.content_hash(table).first().content_hash, geometry.span_hash(table).first().span_hash

    base = hashes(span(0, 10, 20))
    assert base == hashes(span(0, 10, 20)) and all(a != b for a, b in zip(base, hashes(span(0, 10, 20, x0=10.9))))
    assert base[0] != hashes(span(0, 10, 20, height=999.0))[0] and base[0] != hashes(span(0, 10, 20), span(1, 30, 40))[0]


@pytest.mark.parametrize(
    ("boxes", "want"),
    [
        # header at 5-6 %, footer at 93-95 %, body between
        ([(50, 60)] * 5 + [(930, 950)] * 5 + [(400, 410)], (0.05, 0.06, 0.12, 0.88, 0.93, 0.95)),
        # nothing in either zone
        ([(400, 410)], (0.0, 0.12, 0.12, 0.88, 0.88, 1.0)),
        # sparse bins at the edge count for the outer end only
        ([(0, 10)] * 2 + [(50, 110)] * 5, (0.0, 0.11, 0.12, 0.88, 0.88, 1.0)),
    ],
)
def test_regions(spark, boxes, want):
    table = spark.createDataFrame([span(i, *b) for i, b in enumerate(boxes)], SPANS)
    assert tuple(detect.page_regions(table).first())[1:] == pytest.approx(want)
