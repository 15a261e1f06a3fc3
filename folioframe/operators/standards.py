"""Reference data of drawing disciplines and specification divisions, and classification by it.

The tables come with the package and have a fixed size, hence the broadcasts.
"""

from __future__ import annotations

import csv
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import section_format, sheet_prefix

_DATA = Path(__file__).resolve().parents[1] / "data"
#: alias, code of the discipline, display name, confidence in hundredths
ALIASES = [
    ("FP", "FIRE", "Fire Protection", 95), ("FA", "FIRA", "Fire Alarm", 95), ("DDC", "MTEC", "Direct Digital Controls", 95), ("ATC", "MTEC", "Automatic Temperature Control", 95),
    ("SEC", "TELE", "Security", 90), ("AV", "TELE", "Audio/Video", 90), ("IT", "TELE", "Information Technology", 90),
]
CONTROLS_WORDS = ["CONTROL", "DDC", "BAS", "SEQUENCE", "POINT", "DIAGRAM"]
CIVIL_WORDS = ["SITE", "GRADING", "DRAINAGE", "UTILITY", "ROAD", "PAVING", "EROSION", "SURVEY"]


@cache
def rows(name: str) -> tuple[tuple, ...]:
    with open(_DATA / f"{name}.csv", newline="", encoding="utf-8") as lines:
        return tuple(tuple(r) for r in list(csv.reader(lines))[1:])


def disciplines(spark: SparkSession) -> DataFrame:
    data = [(i, e, c, n, f, int(o), u == "1") for i, e, c, n, f, o, u in rows("disciplines")]
    return spark.createDataFrame(data, "discipline_id string, eid string, code string, name string, full_name string, sort_order int, is_uds boolean")


def divisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c, n, int(o)) for i, c, n, o in rows("divisions")], "division_id string, code string, name string, sort_order int")


def legacy_sections(spark: SparkSession) -> DataFrame:
    data = [(*r, i) for i, r in enumerate(rows("legacy_sections"))]
    return spark.createDataFrame(data, "legacy_division string, range_lo string, range_hi string, title string, division_id string, division_code string, ord int")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, code string, display_name string, confidence_pct int")


def overlay(base: DataFrame, changes: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """``base`` with user rows put over it: equal keys are merged column by column, new ones added, removed ones left out."""
    others = [c for c in base.columns if c != key]
    merged = base.join(changes.select(key, *[F.col(c).alias(f"new_{c}") for c in others]), key, "full_outer").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in others])
    return merged.join(removed.select(key), key, "left_anti") if removed is not None else merged


def _any_word(title: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.upper(F.coalesce(title, F.lit(""))), w))


def classify_disciplines(sheets: DataFrame, id_col: str = "normalized_id", title_col: str = "title") -> DataFrame:
    """Adds ``prefix, discipline_code, discipline, modifier, sort_order, confidence_pct, basis``.

    An alias comes first; then a single letter, of which ``C`` is told apart by
    words of the title; then two letters as discipline and modifier.
    """
    spark = sheets.sparkSession
    dim = disciplines(spark)
    by_code = dim.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy(F.col("sort_order").desc()))).where("n = 1")
    alias = aliases(spark).join(by_code, "code").select(F.col("alias").alias("prefix"), F.struct("code", F.col("display_name").alias("name"), "sort_order", "confidence_pct").alias("by_alias"))
    base = dim.where("eid LIKE '%\\\\_'").select(F.col("discipline_id").alias("letter"), F.struct("code", "name", "sort_order").alias("by_letter"))
    special = {c: by_code.where(F.col("code") == c).select(F.struct("code", "name", "sort_order").alias(c.lower())) for c in ("MTEC", "CIVL")}
    out = sheets.withColumn("prefix", sheet_prefix(F.col(id_col))).withColumn("letter", F.when(F.length("prefix") <= 2, F.substring("prefix", 1, 1)))
    out = out.join(F.broadcast(alias), "prefix", "left").join(F.broadcast(base), "letter", "left")
    for one in special.values():
        out = out.crossJoin(F.broadcast(one))
    title = F.col(title_col)
    is_c, controls, civil = F.col("prefix") == "C", _any_word(title, CONTROLS_WORDS), _any_word(title, CIVIL_WORDS)
    known, lettered = F.col("by_alias").isNotNull(), F.col("by_letter").isNotNull()

    def pick(field: str) -> Column:
        return F.when(known, F.col(f"by_alias.{field}")).when(is_c & controls, F.col(f"mtec.{field}")).when(is_c, F.col(f"civl.{field}")).otherwise(F.col(f"by_letter.{field}"))

    score = F.when(known, F.col("by_alias.confidence_pct")).when(is_c, F.when(controls | civil, 85).otherwise(70)).when(lettered, F.when(F.length("prefix") == 1, 95).otherwise(90)).otherwise(0)
    basis = F.when(known, "ALIAS").when(is_c, "HEURISTIC").when(lettered, "UDS").otherwise("UNKNOWN")
    return out.withColumns(
        {
            "discipline_code": F.coalesce(pick("code"), F.lit("UNKN")), "discipline": F.coalesce(pick("name"), F.lit("Unknown")), "modifier": F.when(~known & lettered & (F.length("prefix") == 2), F.substring("prefix", 2, 1)),
            "sort_order": F.coalesce(pick("sort_order"), F.lit(999)), "confidence_pct": score, "basis": basis,
        }
    ).drop("letter", "by_alias", "by_letter", "mtec", "civl")


def find_legacy(codes: DataFrame, code: str = "code", strict_compat: bool = False) -> DataFrame:
    """The first legacy range that holds each distinct 5-digit code of its division.

    ``strict_compat`` lets a range hold only the code 00000.
    """
    ranges = F.broadcast(legacy_sections(codes.sparkSession))
    inside = F.col(code) == "00000" if strict_compat else F.col(code).between(F.col("range_lo"), F.col("range_hi"))
    hit = codes.select(code).distinct().join(ranges, (F.substring(code, 1, 2) == F.col("legacy_division")) & inside)
    return hit.groupBy(code).agg(F.min_by(F.struct("title", "division_id"), "ord").alias("range")).select(code, F.col("range.title").alias("legacy_title"), F.col("range.division_id").alias("legacy_to"))


def classify_sections(sections: DataFrame, code: str = "code", strict_compat: bool = False) -> DataFrame:
    """Adds ``division_id, division, sort_order, confidence_pct, basis``."""
    kind = section_format(F.col(code))
    legacy = find_legacy(sections.where(kind == "legacy-5digit"), code, strict_compat)
    out = sections.withColumn("kind", kind).join(legacy, code, "left")
    wanted = F.when(F.col("kind") == "modern-6digit", F.substring(code, 1, 2)).otherwise(F.col("legacy_to"))
    dim = divisions(sections.sparkSession).select(F.col("division_id").alias("d_id"), F.col("name").alias("d_name"), F.col("sort_order").alias("d_order"))
    out = out.withColumn("wanted", wanted).join(F.broadcast(dim), F.col("wanted") == F.col("d_id"), "left")
    modern, known, ranged = F.col("kind") == "modern-6digit", F.col("d_id").isNotNull(), F.col("legacy_to").isNotNull()
    valid = F.col("kind") != "invalid"
    own = F.when(valid, F.coalesce("wanted", F.substring(code, 1, 2)))
    return out.withColumns(
        {
            "division_id": own, "division": F.col("d_name"), "sort_order": F.when(valid, F.coalesce("d_order", own.cast("int"))).otherwise(999),
            "confidence_pct": F.when(modern & known, 100).when(modern, 70).when(ranged & known, 95).when(ranged, 90).when(valid, 60).otherwise(20),
            "basis": F.when(modern, "MASTERFORMAT").when(valid, "MASTERFORMAT_LEGACY").otherwise("UNKNOWN"),
        }
    ).drop("kind", "wanted", "d_id", "d_name", "d_order", "legacy_to", "legacy_title")


def resolve_discipline(terms: DataFrame, term: str = "term") -> DataFrame:
    """Looks a term up as id, extended id, code and alias, in this order."""
    spark = terms.sparkSession
    dim, up = disciplines(spark), F.upper(F.col(term))
    out = terms.withColumn("up", up)
    ways = [("id", dim.where("eid LIKE '%\\\\_'"), "discipline_id"), ("eid", dim, "eid"), ("code", dim, "code"), ("alias", aliases(spark), "alias")]
    for name, source, key in ways:
        found = source.groupBy(F.col(key).alias("up")).agg(F.max("code").alias(f"by_{name}"))
        out = out.join(F.broadcast(found), "up", "left")
    return out.withColumn("resolved", F.coalesce(*[f"by_{n}" for n, _, _ in ways])).withColumn("way", F.coalesce(*[F.when(F.col(f"by_{n}").isNotNull(), n) for n, _, _ in ways])).select(term, "resolved", "way")
