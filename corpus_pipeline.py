"""A training corpus from ``documents``: filter, deduplicate, mask, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run`` writes as Parquet
in the shared checkpoint folder and hands, read again, to the next. All but the last return the
columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm import jaccard, mixing, packing, pii, quality
from tablecare.llm.common import read_table, ship, written
from tablecare.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rule and the risk-controlled rules keep."""
    ship(spark)
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data replaced by its kind in brackets."""
    ship(spark)
    return pii.masked(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's share of the mix takes them, good ones first."""
    ship(spark)
    return mixing.mix_rows(docs, labels=read_table(spark, sf_dir, "labels"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in the training sequences."""
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data),
          ("mixing", mixed), ("packing", packed)]

#: Cutoffs, links, sampling and packing cannot be said in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
