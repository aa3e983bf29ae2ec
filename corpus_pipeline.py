"""From raw documents to packed sequences.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir), works on every document that the stages
before it kept, and returns a DataFrame; all but the last keep the columns of ``documents``. ``run`` writes each
stage's result as Parquet to the session's shared folder and reads it back for the next one.

1. ``quality_classifier``: documents that the positive-unlabelled classifier scores below its threshold go.
2. ``quality_rules``: documents that break a rule of the threshold table go.
3. ``exact_dedup``: of equal texts the one with the largest id stays.
4. ``ngram_jaccard``: of each group that near-duplicate links connect the one with the smallest id stays.
5. ``packing``: the rest is packed into sequences of 4,096 tokens; one row per piece.

Defined cases: a null text counts as empty (the rules reject it); texts of any length are read whole; of rows that
repeat an id and a text one stays; a null id is the smallest of its group; without labels every document scores alike and
stays; an empty table gives an empty result; other columns of ``documents``, whatever their names, are carried to the last
stage.

No SQL expresses the trained classifier or the online packing; the tests hold the rows against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartlane.llm import jaccard_rtree, patricia, pu_classifier, quality_rules, sum_of_squares
from cartlane.llm.common import ship_package, table, tokenizer_path, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


def quality_rule_table(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return patricia.keep_documents(docs, keep="largest")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_rtree.keep_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sum_of_squares.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_table),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
