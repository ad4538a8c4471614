"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from sentrylake.llm._shared import in_fold, released, stored


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of a quality score of 0.7 or more, learnt from the labels outside the held-out fold."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), training=~in_fold(4, 2))
    return docs.where(quality_classifier.score_column(docs, model) >= 0.7)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.keep_passing(docs)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the later copies of runs of lines; n_chars follows the text."""
    out = line_dedup.without_copies(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("line_dedup", drop_copied_lines),
    ("jaccard_join", one_of_each_group),
    ("packing", pack),
]

#: SQL can express neither the fitted models nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with released(spark):  # a stage's scratch tables go when its result is stored
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
