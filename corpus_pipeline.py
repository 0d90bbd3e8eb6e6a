"""From raw documents to packed training sequences, a written table between the stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import jaccard_join, language, mixing, packing, quality_rules
from rollbook.llm.samples import fold
from rollbook.llm.tables import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``und`` and ambiguous texts go."""
    return language.keep_known(docs, language.learn(docs, fold("doc_id", 4) != 2))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word likeness 0.8 or more: the least doc_id."""
    components = jaccard_join.jaccard_components(docs, size=5, percent=80)
    others = components.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as the mix takes them; a document stands there once for each pass."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all mixed documents in sequences of 2048 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("jaccard_join", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: Learned models, seeded draws and tokenizers are not to be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
