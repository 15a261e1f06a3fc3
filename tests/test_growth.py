"""Plans and folds whose tasks must not grow with the input."""

import random

import pytest
from conftest import DATA
from folioframe.operators import change_sets, lines, merge, ordering, tables
from folioframe.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def windows(df):
    """The partition columns of each window of a plan that numbers rows."""
    return [x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in plan(df).splitlines() if "Window [row_number()" in x]


def sheets(spark, ids, doc="a"):
    return spark.createDataFrame([(doc, i, x) for i, x in enumerate(ids)], "doc string, page_index int, id string")


SHEETS = ["split_drawings_groups", "merge_replace_only", "drawings_row_order", "merge_id_map", "inventory_rows", "unmatched_issues", "issue_codes", "inventory_summary", "merge_unmatched", "discipline_classify", "discipline_rollup_counts", "corrected_inventory", "corrected_summary", "validate_near"]


@pytest.mark.parametrize("name", SHEETS)
def test_no_window_sorts_a_whole_document(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    for by in windows(df):
        # the document alone would be l_returnflag or doc, and then the order
        columns = [c.split("#")[0].strip() for c in by.split(",")]
        assert len(columns) > 2, (name, by)


def test_row_numbers_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(5)) for i in range(400)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc string, i int, k int")
    table = table.selectExpr("doc", "i", "k", "k div 2 AS coarse", "i div 50 AS fine")
    want = {}
    for doc in {r[0] for r in rows}:
        want |= {(doc, i): n for n, (_, i) in enumerate(sorted((k, i) for d, i, k in rows if d == doc))}
    for coarse, fine in ((["coarse"], ["k", "fine"]), (["k"], [])):
        got = ordering.row_numbers(table, ["doc"], coarse, fine, ["k", "i"], "place")
        assert {(r.doc, r.i): r.place for r in got.collect()} == want


def test_split_by_ids_with_equal_keys(spark):
    pages = sheets(spark, ["B-1", "A-1", "A-01", None, "A-2", "A-02", "A-2"]).withColumnRenamed("id", "normalized_id")
    got = ordering.split_drawings(pages, ["A"])
    assert "HashAggregate(keys=[doc#" in plan(got).replace(" ", "")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "A", 5, 4, 1, 6), ("a", "_OTHER", 2, 1, 0, 3)]


def test_replaced_pages_of_one_id_are_cut_by_page(spark, monkeypatch):
    monkeypatch.setattr(merge, "PAGES", 4)
    original, addendum = sheets(spark, ["A", "X", "B", None, "X"], "o"), sheets(spark, ["X", "B"] * 10 + ["Y", None], "n")
    df = merge.replace_pages(original, addendum)
    assert all("pages" in by for by in windows(df) if "part" in by) and windows(df)
    got = [(r.doc, r.page_index) for r in sorted(df.collect(), key=lambda r: r.pos)]
    assert got == [("o", 0), *(("n", i) for i in range(0, 20, 2)), *(("n", i) for i in range(1, 20, 2)), ("o", 3)]
    assert sorted(r.pos for r in df.collect()) == list(range(22))


def test_first_fit_over_batches(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(3), i, rng.choice([float(rng.randrange(60)), rng.random() * 60, None]), rng.choice([0.0, 1.0])) for i in range(300)]
    spans = spark.createDataFrame(rows, "doc string, page_index int, span_idx int, y0 double, x0 double")
    df = lines.first_fit_lines(spans)
    assert "FlatMapGroupsInPandas" not in plan(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.span_idx: r.line_id for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for page in {r[:2] for r in rows}:
        tops = []
        for _, _, i, y, _ in sorted((r for r in rows if r[:2] == page), key=lambda r: (r[3] is None, r[3] or 0.0, r[4], r[2])):
            fits = [n for n, top in enumerate(tops) if y is not None and top is not None and abs(y - top) <= 5]
            if not fits:
                tops.append(y)
            assert got[i] == (fits[0] if fits else len(tops) - 1)
    assert df.where("doc = 'zzz'").count() == 0


def test_map_of_an_id_keeps_no_list(spark):
    df = merge.id_map(sheets(spark, ["A", "B", "A", None]))
    assert "collect_list" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [("a", "A", 2, 0, True), ("a", "B", 1, 1, False)]


def test_merged_columns_over_batches(spark):
    rng = random.Random(3)
    rows = [(d, p, x) for d in "ab" for p in range(4) for x in rng.sample(range(200), 30)]
    df = tables.merge_columns(spark.createDataFrame(rows, "doc string, page_index int, x long"))
    assert "FlatMapGroupsInPandas" not in plan(df)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, df.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in "ab":
        for p in range(4):
            columns = []
            for x in sorted(x for e, q, x in rows if (e, q) == (d, p)):
                near = next((i for i, c in enumerate(columns) if abs(x - c) < 10), None)
                if near is None:
                    columns.append(float(x))
                else:
                    columns[near] = (columns[near] + x) / 2
            want += [(d, p, i, c) for i, c in enumerate(columns)]
    assert got == want


def plain_merge(rows, mode, strict):
    """The plan by scans of the whole working set."""
    work, lost = [(0, p, i, k, "kept") for s, p, i, k in rows if s == 0], []
    for source in sorted({r[0] for r in rows if r[0] > 0}):
        groups = {}
        for s, page, i, key in rows:
            if s == source:
                groups.setdefault(i or "", []).append((source, page, i or None, key))
        for i, new in groups.items():
            at = [n for n, w in enumerate(work) if w[2] == i]
            if mode == "append-only":
                work += [(*n, "appended") for n in new]
            elif not i:
                lost += [(*n, "no-id") for n in new]
            elif at and strict and all(work[n][0] for n in at):
                continue
            elif at:
                work = [w for n, w in enumerate(work) if w[2] != i or n < at[0]]
                work[at[0] : at[0]] = [(*n, "replaced") for n in new]
            elif mode == "replace-only":
                lost += [(*n, "unmatched") for n in new]
            else:
                place = next((n for n, w in enumerate(work) if w[3] is not None and w[3] > new[0][3]), None)
                if place is None:
                    place = next((n for n, w in enumerate(work) if w[2] is None), len(work))
                work[place:place] = [(*n, "inserted") for n in new]
    return [(n, *w[:3], w[4]) for n, w in enumerate(work)] + [(-1, *w[:3], w[4]) for w in lost]


@pytest.mark.parametrize("mode", ["replace+insert", "replace-only", "append-only"])
@pytest.mark.parametrize("strict", [False, True])
def test_merge_plan_as_by_scans(mode, strict):
    rng = random.Random(4)
    for t in range(500):
        rows = []
        for s in range(rng.randrange(1, 5)):
            for p in range(rng.randrange(12)):
                i = rng.choice([None, "", *[f"{x:02d}" for x in range(rng.choice([3, 8, 20]))] * 2])
                rows.append((s, p, i, i and (i[:-1] if t % 2 else i)))  # keys of which several ids have one
        assert list(merge._merged([list(r) for r in rows], mode, strict)) == plain_merge(rows, mode, strict)


def test_merge_plan_of_many_sets(spark):
    rng = random.Random(5)
    rows = [(n, s, p, rng.choice([None, *(f"A-{x}" for x in range(9))])) for n in range(40) for s in range(3) for p in range(rng.randrange(9))]
    df = merge.plan_merge(spark.createDataFrame(rows, "set_id long, source int, page_index long, id string"))
    assert "FlatMapGroupsInPandas" not in plan(df)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = []
    for n in {r[0] for r in rows}:
        want += [(n, *r) for r in plain_merge(sorted(((s, p, i, i) for m, s, p, i in rows if m == n), key=lambda r: r[:2]), "replace+insert", False)]
    assert got == sorted(want, key=repr)


def test_merge_plan_takes_time_as_it_has_pages():
    import time

    pages = [[0, i, f"{i:06d}", f"{i:06d}"] for i in range(0, 40_000, 2)] + [[1, i, f"{i:06d}", f"{i:06d}"] for i in range(1, 40_000, 2)]
    began = time.thread_time()
    assert [r[3] for r in merge._merged(pages, "replace+insert", False)] == [f"{i:06d}" for i in range(40_000)]
    assert time.thread_time() - began < 10


def test_issues_make_each_part_once(spark):
    texts = ["Revisions to Drawings\n1. A-101 Plan\n2. A-101 Plan", "Revisions to Specifications\nSECTION 1 2 3\nSECTION 26 05 00\nSECTION 26 05 00", "nothing"]
    rows = [(d, p + 1, texts[t]) for d, ts in enumerate([(0, 1), (2,), (1,), (0,)]) for p, t in enumerate(ts)] + [(9, 1, "Revisions to Drawings"), (9, 2, "Revisions to Specifications")]
    df = change_sets.narrative_issues(spark.createDataFrame(rows, "doc_id int, page_number int, text string"))
    assert plan(df).count("Scan ExistingRDD") == 1
    dup, bad, section = ("NARR_DUP_SHEET_ID", "A-101", 2), ("NARR_BAD_SECTION_ID", None, 1), ("NARR_DUP_SECTION_ID", "26 05 00", 2)
    want = [(0, *dup), (0, *bad), (0, *section), (2, *bad), (2, *section), (3, *dup), (9, "NARR_NO_DRAWINGS_PARSED", None, 0), (9, "NARR_NO_SPECS_PARSED", None, 0)]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
