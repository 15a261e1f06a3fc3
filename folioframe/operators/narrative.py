"""Change narratives: parsing of lines, and validation against an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import ids_in_text, normalize_section_id

_WORD = "(^|[^0-9a-z_]){}([^0-9a-z_]|$)"
HEADER = "^(?i)SECTION[ ]+[0-9]"


def normalize_text(text: Column) -> Column:
    """Line ends, spaces, dashes, bullets, runs of spaces, trailing spaces and of blank lines in one form."""
    steps = [("\r\n?", "\n"), (" ", " "), ("[‐-―]", "-"), ("[•●▪]", "-"), ("[ \t]+", " "), (" +\n", "\n"), ("\n{3,}", "\n\n")]
    for pattern, by in steps:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(by))
    return text


def verb(line: Column) -> Column:
    """What a line asks for; the first that fits of delete, add, insert (as add), replace, adjust and revise."""
    low = F.lower(line)

    def has(word: str) -> Column:
        return low.rlike(_WORD.format(word))

    return (
        F.when(has("delete"), "delete").when(low.rlike("^([0-9]+[.][ ]*)?add[ ]+") | F.contains(low, F.lit("has been added")), "add").when(has("insert"), "add").when(has("replace"), "replace")
        .when(has("adjust") | has("revise") | has("revised") | has("re[ ]*-[ ]*issued") | has("reissued"), "revise").otherwise("unknown")
    )


def parse_actions(lines: DataFrame) -> DataFrame:
    """Verb and target (what follows a colon) of each line that isn't a header."""
    target = F.regexp_extract("line", ":[ ]*(.+)$", 1)
    action = verb(F.col("line"))
    return lines.where(~F.col("line").rlike(HEADER) & (F.trim("line") != "")).select("doc_id", "line_no", action.alias("verb"), F.when((action != "unknown") & (target != ""), target).alias("target"))


def parse_sections(lines: DataFrame) -> DataFrame:
    """A block from each header to the next: section id, title after the dash, lines and their first and last number."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    blocks = lines.withColumn("block", F.sum(F.when(F.col("line").rlike(HEADER), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    header = F.min_by("line", "line_no")
    out = blocks.groupBy("doc_id", "block").agg(header.alias("header"), (F.count(F.lit(1)) - 1).alias("n_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return out.select("doc_id", "block", normalize_section_id(F.regexp_extract("header", "SECTION[ ]+([0-9 .-]+)", 1)).alias("section_id"), F.regexp_extract("header", "-[ ]*(.*)$", 1).alias("title"), "n_lines", "first_line", "last_line")


def line_ids(lines: DataFrame) -> DataFrame:
    """``doc_id, line_no, id``: ids of each line, in order of appearance."""
    return lines.select("doc_id", "line_no", F.explode(ids_in_text(F.upper("line"))).alias("id"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """Ids on several lines of one narrative."""
    return ids.groupBy("doc_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")).where("n > 1")


def match_exactly(narrative: DataFrame, inventory: DataFrame) -> DataFrame:
    """How often each narrative id is in the inventory: NOT_FOUND, OK or AMBIGUOUS."""
    counts = inventory.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    joined = narrative.select("id").distinct().join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("status", F.when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "OK").otherwise("AMBIGUOUS"))


def similarity(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / most.cast("double"))


def near_matches(wanted: DataFrame, inventory: DataFrame, threshold: float = 0.75, best: int = 3) -> DataFrame:
    """The most similar inventory ids of each wanted id: ``id, candidate, similarity, place``.

    Candidates come from an equi-join instead of comparing all pairs, and none
    is missed: two strings within e edits share one of e + 1 pieces of the
    second, unchanged and moved by at most e places.  Inventory ids are cut into
    that many pieces; wanted ids give their substrings of the same places.
    """
    share = (1 - threshold) / threshold
    most = lambda n: F.floor(n * share + 1e-9).cast("int")

    def piece(n, k, i):
        """First place, from 0, and length of piece i of k pieces of n characters."""
        short, extra = F.floor(n / k).cast("int"), n % k
        longer = F.greatest(i - (k - extra), F.lit(0))
        return i * short + longer, short + (i >= k - extra).cast("int")

    right = inventory.select(F.col("id").alias("candidate")).where("candidate <> ''").distinct().withColumn("n", F.length("candidate"))
    right = right.withColumn("k", most(F.col("n")) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    first, size = piece(F.col("n"), F.col("k"), F.col("i"))
    right = right.select("candidate", "n", "i", F.substr("candidate", first + 1, size).alias("piece"))
    left = wanted.select("id").where("id <> ''").distinct().withColumn("w", F.length("id"))
    left = left.withColumn("n", F.explode(F.sequence(F.greatest(F.lit(1), F.col("w") - most(F.col("w"))), F.col("w") + most(F.col("w")))))
    left = left.withColumn("e", F.floor((1 - threshold) * F.greatest("w", "n") + 1e-9).cast("int")).where(F.abs(F.col("w") - F.col("n")) <= F.col("e"))
    left = left.withColumn("k", most(F.col("n")) + 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    first, size = piece(F.col("n"), F.col("k"), F.col("i"))
    left = left.withColumns({"first": first, "size": size}).withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - F.col("e")), F.greatest(F.lit(0), F.col("first") + F.col("e")))))
    left = left.where(F.col("at") + F.col("size") <= F.col("w")).select("id", "n", "i", F.substr("id", F.col("at") + 1, F.col("size")).alias("piece")).distinct()
    pairs = left.join(right, ["n", "i", "piece"]).select("id", "candidate").distinct()
    scored = pairs.withColumn("similarity", similarity(F.col("id"), F.col("candidate"))).where(F.col("similarity") >= threshold)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "candidate"))).where(F.col("place") <= best)


def not_mentioned(changed: DataFrame, narrative: DataFrame, most: int = 50) -> DataFrame:
    """The first ids of changed inventory rows that no narrative names."""
    return changed.select("id").distinct().join(narrative.select("id").distinct(), "id", "left_anti").orderBy("id").limit(most)


def rename_suggestions(lines: DataFrame, original: DataFrame, addendum: DataFrame) -> DataFrame:
    """Renames that lines tell of: ``doc_id, line_no, new_id, old_id, reason``.

    A line with two ids, one only in the addendum and one only in the original,
    tells of a rename (``two_id_match``).  A line whose one id is only in the
    addendum waits for the next line that has ids: if that has one, only in the
    original, the first renames it (``context_match``).
    """
    ids = lines.select("doc_id", "line_no", ids_in_text(F.upper("line")).alias("ids")).where(F.size("ids") > 0)
    known = original.select("id", F.lit("old").alias("kind")).unionByName(addendum.select("id", F.lit("new").alias("kind"))).distinct()
    known = known.groupBy("id").agg(F.max("kind").alias("kind"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    few = ids.where(F.size("ids") <= 2).select("doc_id", "line_no", F.posexplode("ids").alias("at", "id")).join(known, "id", "left")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("id")))
    state = few.groupBy("doc_id", "line_no").agg(of("new").alias("new_id"), of("old").alias("old_id"), F.count("kind").alias("n_known"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    seq = ids.select("doc_id", "line_no", F.size("ids").alias("n")).join(state, ["doc_id", "line_no"], "left")
    waiting = F.when((F.lag("n").over(w) == 1) & F.lag("old_id").over(w).isNull(), F.lag("new_id").over(w))
    seq = seq.withColumn("waiting", waiting)
    two = (F.col("n") == 2) & (F.col("n_known") == 2) & F.col("new_id").isNotNull() & F.col("old_id").isNotNull()
    context = (F.col("n") == 1) & F.col("old_id").isNotNull() & F.col("waiting").isNotNull()
    found = seq.withColumn("reason", F.when(two, "two_id_match").when(context, "context_match")).where("reason IS NOT NULL")
    return found.select("doc_id", "line_no", F.when(F.col("reason") == "two_id_match", F.col("new_id")).otherwise(F.col("waiting")).alias("new_id"), "old_id", "reason")
