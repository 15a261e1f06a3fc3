"""The corpus pipeline, from raw documents to token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` applies them in order.

A stage lets texts go to Python in small batches, for the rest of the session
too: the executors' memory adds up over the stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioframe.llm import decontamination, mixing, quality, simhash, sstable
from folioframe.llm.common import materialise, read, small_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject.

    A null or empty text is rejected; without labels of both classes all others
    stay.  Long texts are read whole, repeated rows share their verdict, and a
    probability on the threshold is kept.  An empty table stays empty; all
    columns pass through, extra ones too, whatever they are called.
    """
    small_batches(spark)
    return quality.good_documents(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest ``doc_id``.

    Null ids come last; of rows that agree in id and text the first in order of
    the other columns stays.  Null texts stay as they are, and texts without
    words are compared for equality only.  Long texts count whole.  An empty
    table stays empty; all columns pass through, whatever they are called.
    """
    small_batches(spark)
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go.

    Null and empty texts stay, and so does everything if the benchmark is empty
    or null.  Long texts are scanned whole, each repeated row by itself; half
    of the words covered is enough to go.  ``n_chars`` follows the text.  An
    empty table stays empty; other columns pass through, whatever they are
    called.
    """
    small_batches(spark)
    return decontamination.decontaminate_documents(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mixture, a row for each time that one is taken; all sources weigh the same.

    A null source is the source ``''``.  A null or empty text has no tokens and
    is taken when its place is before the cut; repeated rows share a place and
    are taken together.  An empty table, or one without tokens, gives no rows;
    long texts are counted whole; all columns pass through, whatever they are
    called.
    """
    return mixing.mix_documents(docs)


def output_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, sorted by document.

    A null id comes first; a null or empty text has no tokens; repeated rows
    are repeated entries, in order of their token ids.  A long text is one
    entry, not cut.  An empty table gives no shards; only ``doc_id`` and
    ``text`` are read, whatever other columns are called.
    """
    small_batches(spark)
    return sstable.token_shards(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token shards", output_stage),
]

#: The classifier, the forest and the shards can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage keeps is written to the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
