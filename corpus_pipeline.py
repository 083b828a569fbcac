"""The corpus pipeline: five stages over ``documents``, each by one operator of ``sawmill.llm``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is
written as Parquet and read again. All but the last return the columns of documents.
Empty tables pass through every stage; what nulls mean is said in each operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sawmill.llm.common import saved, table, tokenizer_path
from sawmill.llm.ngram_join import keep_one
from sawmill.llm.outliers import keep_regular
from sawmill.llm.packing import pack
from sawmill.llm.pii import sanitised
from sawmill.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7; the model is fitted on the labelled ones that aren't held out."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return keep_regular(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without personal data and the terms that give it away."""
    return sanitised(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Two fitted models, groups and packing: SQL can't express them; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
