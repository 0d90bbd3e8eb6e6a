"""The queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm import (
    alignment,
    jaccard_join,
    kd_shards,
    language,
    lexical,
    mixing,
    order_minhash,
    packing,
    page_text,
    quality_rules,
    token_codes,
    toxicity,
    url_reputation,
)
from rollbook.llm.samples import fold

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every text, its edited text and how near the next one is."""
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = toxicity.score_texts(docs, toxicity.learn(docs, labels))
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return page_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the documents."""
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, fold("doc_id", 4) != 2)
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return language.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous"
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and learned verdict of every text."""
    labels = table(spark, sf_dir, "labels")
    return quality_rules.judge(table(spark, sf_dir, "documents"), labels)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word n-grams are alike by 90 percent."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 3, 90)


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url, by the outcomes of all pages' texts."""
    pages, docs, labels = (table(spark, sf_dir, name) for name in ("pages", "documents", "labels"))
    return url_reputation.judge(pages, url_reputation.page_outcomes(pages, docs, labels))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in a mix of all sources weighed 1, 2 and 3 in turn."""
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(table(spark, sf_dir, "documents"), path, end_id=1)
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in directly addressable codes and read back."""
    path = public_tokenizers.path("word_bpe_49k.json")
    segments = token_codes.write_tokens(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_codes.read_documents(segments).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two tokenizers' ids of every text lie against each other, and how usual their links."""
    paths = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align_texts(table(spark, sf_dir, "documents"), *paths, keep_groups=False)
    return alignment.link_scores(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    rows = kd_shards.assign(table(spark, sf_dir, "documents"), shards=16).rows
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return lexical.rank_documents(docs, items, k=50)


_TERMS = """regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LEXICAL_SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
spread AS (SELECT row, doc_id, unnest({_TERMS}) AS term FROM numbered),
lengths AS (SELECT row, count(*) AS n FROM spread GROUP BY row),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS terms FROM lengths),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM spread GROUP BY row, doc_id, term),
weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counts, whole GROUP BY term, documents),
items AS (SELECT DISTINCT item_id, text FROM benchmark),
wanted AS (SELECT DISTINCT item_id, text, term FROM (
    SELECT item_id, text, unnest({_TERMS}) AS term FROM items)),
scored AS (
    SELECT item_id, wanted.text, row, doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // terms))))::BIGINT
            AS score
    FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN lengths USING (row), whole
    GROUP BY item_id, wanted.text, row, doc_id),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (
        PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

QUERIES: dict[str, Query] = {
    run.__name__: run
    for run in (
        op1_order_minhash,
        op2_toxicity,
        op3_page_text,
        op4_language,
        op5_quality_rules,
        op6_jaccard_join,
        op7_url_reputation,
        op8_mixing,
        op9_packing,
        op10_token_codes,
        op11_alignment,
        op12_kd_shards,
        op13_lexical,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE: dict[str, str] = {"op13_lexical": LEXICAL_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
