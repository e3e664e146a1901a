"""Corpus pipeline: quality, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents. A stage judges all rows its predecessor kept.

Defined cases, besides those that each operator states: a null or empty text is scored
and may stay; it has no shingles, no benchmark words and no words for the mix, which it
leaves there. Rows that repeat an id are judged one by one; copies are near duplicates,
of which one stays. A null id is an id of its own. A null source is a source. Columns
that documents have beside its own pass through every stage but the last, whatever
their names, if none begins with two underscores and none is quality_score. Tables without rows give no rows, and
without usable labels all documents stay.

SQL cannot express the classifier, the mix or the tokenizer, so ORACLE_SQL is None and
the stages are tested against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import common, decontaminate, jaccard_join, mixing, quality, storage, tokens
from ferrule.llm.queries import END_ID, MIX_WEIGHTS, table, tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, learnt from the labelled ones among them."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("quality_score") >= quality.CUT).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by a benchmark item."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, pass after pass; documents without any go."""
    mixed, _ = mixing.mix(docs, MIX_WEIGHTS)
    return mixing.mixed_texts(docs, mixed)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files in the shared folder, and what each document has in them."""
    common.prepare(spark)
    folder = storage.make_folder(common.shared_path(spark, "tokens"))
    return tokens.documents_of(spark, tokens.write(docs, folder, tokenizer_path(), END_ID))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
