"""Outlines and section trees as adjacency tables ``node_id, parent_id, level, ord, title``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKERS = [("alpha-lower", "^[ ]*([a-z])[.)][ ]+.+$"), ("alpha-upper", "^[ ]*([A-Z])[.)][ ]+.+$"), ("numeric", "^[ ]*([0-9]+)[.)][ ]+.+$"), ("roman", "^[ ]*([ivxlcdmIVXLCDM]+)[.)][ ]+.+$")]
ANCHORS = ["([0-9]+[.][0-9]+(-[A-Z][.][0-9]+[a-z]?[.][0-9]+)?)", "([A-Z][.][0-9]+[a-z]?[.][0-9]+)"]
FITS = ["XYZ", "Fit", "FitH"]


def list_marker(text: Column) -> tuple[Column, Column]:
    """Style and marker of a list item; nulls for other texts."""
    style, marker = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(MARKERS):
        hit = text.rlike(pattern)
        style, marker = F.when(hit, name).otherwise(style), F.when(hit, F.regexp_extract(text, pattern, 1)).otherwise(marker)
    return style, marker


def anchor(text: Column) -> Column:
    """The first anchor, by the first pattern that has one with text behind it."""
    out = F.lit(None).cast("string")
    for pattern in reversed(ANCHORS):
        found = F.regexp_extract(text, pattern, 1)
        rest = F.trim(F.substr(text, F.instr(text, found) + F.length(found)))
        out = F.when((found != "") & (rest != ""), found).otherwise(out)
    return out


def next_marker(style: Column, marker: Column) -> Column:
    letter = F.when(F.lower(marker) == "z", F.when(marker == "z", "aa").otherwise("AA")).otherwise(F.char(F.ascii(marker) + 1))
    return F.when(style.isin("alpha-lower", "alpha-upper"), letter).when(style == "numeric", (marker.cast("bigint") + 1).cast("string")).otherwise(marker)


def list_items(lines: DataFrame) -> DataFrame:
    style, marker = list_marker(F.col("line"))
    return lines.withColumns({"style": style, "marker": marker}).where("style IS NOT NULL").select("source", "doc_id", "line_no", "style", "marker")


def numbering_breaks(items: DataFrame) -> DataFrame:
    """Items whose marker isn't the one that follows the marker before it."""
    w = Window.partitionBy("source", "doc_id").orderBy("line_no")
    expected = F.lag(next_marker(F.col("style"), F.col("marker"))).over(w)
    return items.withColumn("expected", expected).where(F.lower("marker") != F.lower("expected")).select("source", "doc_id", "line_no", "marker", "expected")


def anchors(lines: DataFrame) -> DataFrame:
    return lines.withColumn("anchor", anchor(F.col("line"))).where("anchor IS NOT NULL").select("source", "doc_id", "line_no", "anchor")


def duplicate_anchors(found: DataFrame) -> DataFrame:
    """All but the first line of each anchor."""
    n = F.row_number().over(Window.partitionBy("source", "doc_id", "anchor").orderBy("line_no"))
    return found.withColumn("nth", n).where("nth > 1")


def parents_by_level(nodes: DataFrame, group: str = "group_id") -> DataFrame:
    """Adds ``parent_ord``: the nearest earlier node of a lower level, for nodes ``group, ord, level``; a null level has no parent.

    The levels are read from the data first; there is a running column for each
    of them.
    """
    levels = sorted(r.level for r in nodes.select("level").where("level IS NOT NULL").distinct().collect())
    w = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > k, F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(w)) for k in levels[:-1]]
    none = F.lit(None).cast("bigint")
    return nodes.withColumn("parent_ord", F.greatest(none, none, *last))


def depths(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """``node_id, depth, root``, by recursion from the roots."""
    # a join for each level of the tree
    front = nodes.where("parent_id IS NULL").select("node_id", F.lit(0).alias("depth"), F.col("node_id").alias("root"))
    out = front
    while True:
        up = front.select(F.col("node_id").alias("p"), "depth", "root")
        front = nodes.join(up, F.col("parent_id") == F.col("p")).select("node_id", (F.col("depth") + 1).alias("depth"), "root")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def ranges(nodes: DataFrame, last_page: int) -> DataFrame:
    """Each node's pages: from its own to the one before its next sibling's, at least its own."""
    w = Window.partitionBy("parent_id").orderBy("page_index", "ord")
    end = F.coalesce(F.lead("page_index").over(w) - 1, F.lit(last_page))
    return nodes.select("node_id", "parent_id", "page_index", F.greatest("page_index", end).alias("end_page"))


def sibling_links(nodes: DataFrame) -> DataFrame:
    """Links of an outline as it is written: previous and next sibling, first and last child, children."""
    w = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    linked = nodes.withColumns({"prev_id": F.lag("node_id").over(w), "next_id": F.lead("node_id").over(w)})
    kids = nodes.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("up")).agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("first_id"), F.max_by("node_id", F.struct("ord", "node_id")).alias("last_id"), F.count(F.lit(1)).alias("n_children"))
    return linked.join(kids, F.col("node_id") == F.col("up"), "left").select("node_id", "prev_id", "next_id", "first_id", "last_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def normal_title(title: Column, most: int = 120) -> Column:
    """One line, without a dash at the end, cut to a length with an ellipsis."""
    t = F.trim(F.regexp_replace(title, F.lit("[ \\t\\r\\n\\f]+"), F.lit(" ")))
    t = F.trim(F.regexp_replace(t, F.lit("[ ]*[-—][ ]*$"), F.lit("")))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def duplicate_titles(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level", normal_title(F.col("title")).alias("title")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedupe_siblings(nodes: DataFrame) -> DataFrame:
    """Of siblings with the same normal title the first stays."""
    n = F.row_number().over(Window.partitionBy("parent_id", normal_title(F.col("title"))).orderBy("ord", "node_id"))
    return nodes.withColumn("nth", n).where("nth = 1").drop("nth")


def validate_destinations(nodes: DataFrame, page_count: int, fit: str | None = None) -> DataFrame:
    """Adds ``is_valid`` and ``error``: the page exists, and the kind of view is known."""
    inside = (F.col("page_index") >= 0) & (F.col("page_index") < page_count)
    known = F.col(fit).isNull() | F.col(fit).isin(FITS) if fit else F.lit(True)
    return nodes.withColumn("is_valid", inside & known).withColumn("error", F.when(~inside, F.concat(F.lit("page "), F.col("page_index").cast("string"), F.lit(f" is not in 0-{page_count - 1}"))).when(~known, "unknown view"))


def shape_outline(nodes: DataFrame, max_depth: int = 3, most: int = 120) -> DataFrame:
    """Nodes to a depth, with normal titles; nodes without a title go, and their children move to the nearest kept ancestor."""
    kept = nodes.where(F.col("level") <= max_depth).withColumn("title", normal_title(F.col("title"), most))
    gone = kept.where("title = ''").select(F.col("node_id").alias("gone_id"), F.col("parent_id").alias("gone_parent"))
    out = kept.where("title <> ''")
    for _ in range(max_depth + 1):
        out = out.join(gone, F.col("parent_id") == F.col("gone_id"), "left").withColumn("parent_id", F.when(F.col("gone_id").isNotNull(), F.col("gone_parent")).otherwise(F.col("parent_id"))).drop("gone_id", "gone_parent")
    return out


def correct_outline(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Nodes with changes ``node_id, new_title, new_page, is_deleted`` applied."""
    joined = nodes.join(changes, "node_id", "left").where(~F.coalesce("is_deleted", F.lit(False)))
    return joined.withColumns({"title": F.coalesce("new_title", "title"), "page_index": F.coalesce("new_page", "page_index")}).drop("new_title", "new_page", "is_deleted")


def articles_in_ranges(articles: DataFrame, sections: DataFrame, width: int = 16) -> DataFrame:
    """The section range (``doc, section_id, start_page, end_page``) that holds each article's page; pages are bucketed, so it is an equi-join."""
    spread = sections.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_page") / width), F.floor(F.col("end_page") / width))))
    keyed = articles.withColumn("bucket", F.floor(F.col("page_index") / width))
    return keyed.join(spread, ["doc", "bucket"]).where(F.col("page_index").between(F.col("start_page"), F.col("end_page"))).drop("bucket")


def heading_pages(lines: DataFrame, pattern: str, share: float = 0.3) -> DataFrame:
    """The best page for a heading in each document: high on the page 1000, centred 500, not tiny 200; the first of equals.

    ``lines`` has ``doc, page_index, bucket, line_text, x0, x1, width, height``.
    """
    hit = lines.where((F.col("bucket") < share * F.col("height")) & F.col("line_text").rlike(pattern))
    centre = (F.col("x0") + F.col("x1")) / 2 / F.col("width")
    score = (1 - F.col("bucket") / F.col("height")) * 1000 + F.when(centre.between(0.1, 0.9), 500).otherwise(0) + F.when(F.col("x1") - F.col("x0") > 0.1 * F.col("width"), 200).otherwise(0)
    return hit.withColumn("score", score).groupBy("doc").agg(F.max_by("page_index", F.struct("score", -F.col("page_index"))).alias("page_index"), F.max("score").alias("score"))


def validate_patch(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each operation's verdict by how many nodes have its target: MISSING_ANCHOR, NOT_FOUND, AMBIGUOUS, MATCH_FAILED or OK."""
    counts = nodes.where("anchor IS NOT NULL").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("text"))
    joined = ops.join(counts, F.col("target_anchor") == F.col("anchor"), "left")
    verdict = F.when(F.col("target_anchor").isNull(), "MISSING_ANCHOR").when(F.col("n").isNull(), "NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("match_text").isNotNull() & ~F.contains("text", F.col("match_text")), "MATCH_FAILED").otherwise("OK")
    return joined.select("ord", "op", "target_anchor", verdict.alias("verdict"))


def marker_after(marker: str, style: str) -> str:
    """The marker behind one of a list: ``alpha-lower``, ``alpha-upper`` or ``numeric``; after z comes aa."""
    if style == "numeric":
        return str(int(marker) + 1)
    last = "z" if style == "alpha-lower" else "Z"
    return chr(ord(last) - 25) * 2 if marker == last else chr(ord(marker[0]) + 1)


def patched(rows: list[dict], ops: list[dict]) -> list[dict]:
    """The nodes of one document after the edits, in their new order; see ``apply_patch``."""
    nodes = {r["node_id"]: dict(r) for r in sorted(rows, key=lambda r: (r["ord"], r["node_id"]))}
    below: dict[tuple, list[str]] = {}
    for node in nodes.values():
        node["parent_id"] = node["parent_id"] if node["parent_id"] in nodes else None
        below.setdefault(_place(node), []).append(node["node_id"])

    def one(anchor: str, op: dict) -> dict:
        found = [n for n in nodes.values() if n["anchor"] == anchor and op.get("section_id") in (None, n["section_id"])]
        if len(found) != 1:
            raise ValueError(f"cannot {op['op']}: {anchor!r} is on {len(found)} nodes")
        return found[0]

    def subtree(node_id: str) -> list[str]:
        todo, out = [node_id], []
        while todo:
            out.append(todo.pop())
            todo += below.get(("", out[-1]), [])
        return out

    def put(ids: list[str], target: dict, position: str) -> None:
        if position == "child":
            parent = target["node_id"]
            below.setdefault(("", parent), []).extend(ids)
        else:
            parent, beside = target["parent_id"], below[_place(target)]
            at = beside.index(target["node_id"]) + (position == "after")
            beside[at:at] = ids
        for i in ids:
            nodes[i]["parent_id"] = parent
            for j in subtree(i):
                nodes[j]["section_id"] = target["section_id"]

    for number, op in enumerate(ops):
        kind = op["op"]
        if kind == "insert":
            target = one(op["target"], op)
            new = dict.fromkeys(target) | {"node_id": f"{target['node_id']}-inserted-{number}", "ord": target["ord"]}
            new |= {c: target[c] for c in ("doc", "section_id")}
            new |= {"level": op.get("level", target["level"])} | {c: op.get(c) for c in ("kind", "marker", "text")}
            nodes[new["node_id"]] = new
            put([new["node_id"]], target, op.get("position", "after"))
        elif kind == "delete":
            for anchor in op["targets"]:
                node = one(anchor, op)
                below[_place(node)].remove(node["node_id"])
                for i in subtree(node["node_id"]):
                    del nodes[i]
        elif kind == "move":
            sources, target = [one(x, op) for x in op["sources"]], one(op["target"], op)
            if any(target["node_id"] in subtree(n["node_id"]) for n in sources):
                raise ValueError(f"cannot move: {op['target']!r} is among what moves")
            for node in sources:
                below[_place(node)].remove(node["node_id"])
            put([n["node_id"] for n in sources], target, op.get("position", "after"))
        elif kind == "renumber":
            start, marker = one(op["target"], op), op["new_start"]
            beside = below[_place(start)]
            for i in beside[beside.index(start["node_id"]) :]:
                if nodes[i]["level"] == start["level"] and nodes[i]["kind"] == "list-item":
                    nodes[i]["marker"] = marker
                    marker = marker_after(marker, op["style"])
        elif kind == "replace":
            one(op["target"], op)["text"] = op["text"]
        else:
            raise ValueError(f"unknown operation {kind}")
    sections = dict.fromkeys(r["section_id"] for r in sorted(rows, key=lambda r: (r["ord"], r["node_id"])))
    todo = [i for section in reversed(sections) for i in reversed(below.get((section, None), []))]
    out = []
    while todo:
        node = nodes[todo.pop()]
        out.append(node | {"ord": len(out)})
        todo += reversed(below.get(("", node["node_id"]), []))
    return out


def _place(node: dict) -> tuple:
    """Whose list a node is in: its parent's, or its section's."""
    return (node["section_id"], None) if node["parent_id"] is None else ("", node["parent_id"])


def apply_patch(nodes: DataFrame, ops: list[dict]) -> DataFrame:
    """Each document's nodes after ordered edits, numbered anew in reading order.

    ``nodes`` has ``doc, section_id, node_id, parent_id, ord, level, kind,
    marker, text, anchor``.  Edits name nodes by anchor, which has to be on
    exactly one node of the document (of ``section_id``, if given), else the
    patch fails: ``insert`` (``target``, ``position`` before, after or child),
    ``delete`` (``targets``, with all below them), ``move`` (``sources`` in order
    to ``target``), ``renumber`` (list items of one level from ``target`` on,
    from ``new_start`` in ``style``) and ``replace`` (``text``).  A patch is a
    true fold, so each document is edited by one task, in one exchange however
    many edits there are.
    """
    names = ["doc", "section_id", "node_id", "parent_id", "ord", "level", "kind", "marker", "text", "anchor"]
    table = nodes.select(*[F.col(c).cast("bigint" if c == "ord" else "int" if c == "level" else "string") for c in names])

    def run(batch: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(patched(batch.to_pylist(), ops), schema=batch.schema)

    return table.groupBy("doc").applyInArrow(run, table.schema)


def outline_from_flat(rows: DataFrame) -> DataFrame:
    """A flat list ``group_id, ord, level, title`` as a tree: the parent is the latest earlier item of a lower level."""
    return parents_by_level(rows)


def section_html(nodes: DataFrame) -> DataFrame:
    """HTML of each section from nodes ``section_id, ord, level, title``; special characters are escaped."""
    esc = F.col("title")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    row = F.concat(F.lit('<div class="level-'), F.col("level").cast("string"), F.lit('">'), esc, F.lit("</div>"))
    got = nodes.select("section_id", "ord", row.alias("html")).groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("ord", "html"))).alias("rows"))
    return got.select("section_id", F.concat(F.lit('<section data-id="'), F.col("section_id"), F.lit('">'), F.array_join("rows.html", "\n"), F.lit("</section>")).alias("html"))
