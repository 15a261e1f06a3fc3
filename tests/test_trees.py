"""Trees deeper than those of the queries."""

import random

import pytest
from folioframe.operators import report, trees


def test_parents_at_every_level(spark):
    rng = random.Random(5)
    rows = [("chain", i, i) for i in range(12)] + [("mixed", i, rng.choice([-1, 0, 2, 5, 6, 7, 9, 40, None])) for i in range(200)]
    nodes = spark.createDataFrame(rows, "group_id string, ord bigint, level int")

    def parent(group, i, level):
        earlier = [o for g, o, k in rows if g == group and o < i and None not in (k, level) and k < level]
        return max(earlier, default=None)

    for build in (trees.parents_by_level, trees.outline_from_flat):
        assert {(r.group_id, r.ord): r.parent_ord for r in build(nodes).collect()} == {(g, i): parent(g, i, k) for g, i, k in rows}
        assert build(nodes.limit(0)).count() == 0
        assert {r.parent_ord for r in build(nodes.where("level = 6 OR level IS NULL")).collect()} == {None}


def test_hoisting_over_long_chains(spark):
    rng = random.Random(6)
    nodes = {0: (None, "a")} | {i: (i - 1, "a" if i == 19 else None) for i in range(1, 20)}  # 18 removed nodes in a row
    nodes |= {20: (None, None), 21: (20, None), 22: (21, "a"), 23: (10, "a")}
    nodes |= {i: (rng.randrange(24, i) if i > 24 else None, rng.choice(["a", None, None, None])) for i in range(24, 120)}

    def nearest(i):
        while i is not None and nodes[i][1] is None:
            i = nodes[i][0]
        return i

    table = spark.createDataFrame([(i, p, a) for i, (p, a) in nodes.items()], "node_id bigint, parent_id bigint, anchor string")
    got = [(r.node_id, r.parent_id) for r in report.hoist_unanchored(table).collect()]
    assert sorted(got) == [(i, nearest(p)) for i, (p, a) in nodes.items() if a]
    assert report.hoist_unanchored(table.limit(0)).count() == 0


def node(i, parent, order, anchor=None, kind="list-item", section="S"):
    return {"doc": "d", "section_id": section, "node_id": i, "parent_id": parent, "ord": order, "level": 0 if parent is None else 1, "kind": kind, "marker": None, "text": i, "anchor": anchor or i}


def test_patch():
    rows = [node("a", None, 0), node("a1", "a", 1), node("a2", "a", 2), node("b", None, 3), node("c", None, 4, section="T")]

    def after(*ops):
        return [r["node_id"] for r in trees.patched(rows, list(ops))]

    assert after() == ["a", "a1", "a2", "b", "c"]
    assert after({"op": "delete", "targets": ["a"]}) == ["b", "c"]
    assert after({"op": "insert", "target": "a", "text": "x"}) == ["a", "a1", "a2", "a-inserted-0", "b", "c"]
    assert after({"op": "insert", "target": "a2", "position": "before", "text": "x"}) == ["a", "a1", "a2-inserted-0", "a2", "b", "c"]
    assert after({"op": "move", "sources": ["b", "a1"], "target": "c", "position": "child"}) == ["a", "a2", "c", "b", "a1"]
    markers = [r["marker"] for r in trees.patched(rows, [{"op": "renumber", "target": "a1", "new_start": "z", "style": "alpha-lower"}])]
    assert markers == [None, "z", "aa", None, None]
    twice = [*rows, node("d", None, 5, anchor="a1", section="T")]
    assert trees.patched(twice, [{"op": "replace", "target": "a1", "section_id": "T", "text": "new"}])[-1]["text"] == "new"
    for bad in ({"op": "replace", "target": "a1", "text": ""}, {"op": "delete", "targets": ["nowhere"]}, {"op": "move", "sources": ["a"], "target": "a2"}, {"op": "turn"}):
        with pytest.raises(ValueError):
            trees.patched(twice, [bad])


def test_many_edits_plan_at_once(spark):
    rows = [node(f"n{i}", None, i) for i in range(60)]
    ops = [{"op": "insert", "target": "n5", "text": str(i)} for i in range(60)]
    table = spark.createDataFrame(rows, "doc string, section_id string, node_id string, parent_id string, ord bigint, level int, kind string, marker string, text string, anchor string")
    out = [r.text for r in trees.apply_patch(table, ops).orderBy("ord").collect()]
    assert out == [f"n{i}" for i in range(6)] + [str(i) for i in reversed(range(60))] + [f"n{i}" for i in range(6, 60)]
