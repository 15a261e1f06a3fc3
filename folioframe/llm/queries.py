"""The registered queries of this subpackage with their production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import langid, licenses, quality, simhash
from .common import read
from .decontamination import decontaminate, decontaminate_sql
from .linededup import drop_boilerplate, drop_boilerplate_sql
from .mixing import mix, mix_sql
from .revisits import resolve_pages, resolve_pages_sql
from .sstable import token_shards
from .winnowing import fingerprints, fingerprints_sql


def _quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return quality.classify(docs, quality.fit(docs, read(spark, d, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": lambda spark, d: licenses.scan_documents(read(spark, d, "documents")),
        "op2_winnowing": lambda spark, d: fingerprints(read(spark, d, "documents")),
        "op3_quality_classifier": _quality,
        "op4_language_id": lambda spark, d: langid.identify_documents(read(spark, d, "documents")),
        "op5_simhash_neardup": lambda spark, d: simhash.group_documents(read(spark, d, "documents")),
        "op6_source_mixing": lambda spark, d: mix(read(spark, d, "documents")),
        "op7_decontamination": lambda spark, d: decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op8_token_sstable": lambda spark, d: token_shards(read(spark, d, "documents")),
        "op9_revisit_resolution": lambda spark, d: resolve_pages(read(spark, d, "pages")),
        "op10_line_dedup": lambda spark, d: drop_boilerplate(read(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_winnowing": fingerprints_sql(),
        "op6_source_mixing": mix_sql(),
        "op7_decontamination": decontaminate_sql(),
        "op9_revisit_resolution": resolve_pages_sql(),
        "op10_line_dedup": drop_boilerplate_sql(),
    }
