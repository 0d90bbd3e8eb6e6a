"""Bounded samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null without doc_id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def _least_hashes(marks: DataFrame, counts: list[Row], per_label: int, reach: int) -> DataFrame:
    """sample_id and label of the ``per_label`` least hashes of each label that are in reach.

    Only hashes that about ``reach`` ids of a label lie below are ranked; ``counts`` has the
    label and the count of its ids.
    """
    span = [
        (row["label"], int(2**64 * min(1.0, reach / row["count"])) - 2**63 - 1) for row in counts
    ]
    schema = f"label {marks.schema['label'].dataType.simpleString()}, below long"
    below = marks.sparkSession.createDataFrame(span, schema)
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    return (
        marks.join(F.broadcast(below), "label")
        .where(F.xxhash64("doc_id") <= F.col("below"))
        .withColumn("rank", F.row_number().over(by_hash))
        .where(F.col("rank") <= per_label)
        .select(F.col("doc_id").alias("sample_id"), "label")
    )


def labelled_texts(docs: DataFrame, marks: DataFrame, per_label: int, labels: int) -> list[tuple]:
    """(label, text) of at most ``per_label`` documents of each of at most ``labels`` labels.

    ``marks`` has doc_id and label, neither null. The documents are chosen by a hash of their
    ids, among ids alone; only the chosen texts are read to the driver, in a fixed order. The
    labels that are kept are the most frequent ones.
    """
    counts = marks.groupBy("label").count().orderBy(F.desc("count"), "label").limit(labels)
    counts = counts.collect()
    reach, short = 2 * per_label, True
    while short:
        ids = _least_hashes(marks, counts, per_label, reach)
        rows = ids.collect()
        found = Counter(row["label"] for row in rows)
        short = any(found[row["label"]] < min(per_label, row["count"]) for row in counts)
        reach *= 4
    ids = docs.sparkSession.createDataFrame(rows, ids.schema)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("sample_id"))
    rows = rows.select("label", "sample_id", "text").collect()
    return [(label, text) for label, _, text in sorted(rows)]
