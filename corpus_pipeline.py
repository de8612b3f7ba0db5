"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; all but the last return the columns of
documents. run() applies them in order, each written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.llm import common, decontamination, jaccard, packing, quality, secrets


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of at least quality.THRESHOLD).

    Null and empty texts are scored as empty; repeated rows share their score; null ids are never
    learned from; without labels every score is one half, and nothing stays; an empty table gives no rows.
    """
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    name = common.unused(docs, "score")
    return quality.scored(docs, model, name).filter(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more; that of the smallest id, null ids last.

    Rows that share an id, or have none, are judged by their texts; equal rows are one; texts without words,
    null ones too, are no duplicates of one another; an empty table gives no rows.
    """
    return jaccard.one_of_each(docs, words=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other parameters.

    Null and empty texts stay; rows that share an id, or have none, are judged each by its own
    text; with an empty benchmark all stay; an empty table gives no rows.
    """
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows.

    Null and empty texts stay as they are, as do repeated rows and null ids; an empty table gives no rows.
    """
    return secrets.redacted(docs, common.shared_dir(spark, "secret-ledger"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens.

    Null and empty texts are an end id each; repeated rows and null ids are packed each; an empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL has no compression dictionaries, tries or tokenizers: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
