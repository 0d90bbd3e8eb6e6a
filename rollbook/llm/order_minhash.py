"""Order MinHash: fingerprints that tell how far two texts are from each other by edits.

All runs of ``K`` code points (k-mers) of a text are numbered by occurrence, so that a repeated
k-mer counts as often as it stands there. Each of ``FUNCTIONS`` hash functions selects the
``TUPLE`` numbered k-mers of least hash; they are put back into the order of the text, and the
tuple is hashed. Two fingerprints agree in a place if the texts share these k-mers in the same
order, so both missing and moved passages lower the likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import range_bounds, range_of, shuffle_partitions
from rollbook.llm.words import mix

K = 6
TUPLE = 2
FUNCTIONS = 64
#: k-mers that are hashed by all functions at once.
BLOCK = 4096

_RNG = np.random.default_rng(2019)
_FLIP = _RNG.integers(0, 2**32, (FUNCTIONS, 1), dtype=np.uint32)
_TIMES = _RNG.integers(0, 2**32, (FUNCTIONS, 1), dtype=np.uint32) | np.uint32(1)
_SEEDS = _RNG.integers(0, 2**63, FUNCTIONS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = np.arange(FUNCTIONS)[:, None]

COMPARED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` code points; a shorter text, also an empty one, is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = min(k, len(points))
    out = np.full(max(1, len(points) - k + 1), np.uint64(size + 1))
    with np.errstate(over="ignore"):
        for step in range(size):
            out = out * _BASE + points[step : step + len(out)] + np.uint64(1)
    return mix(out)


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also differ by how often the same k-mer stood before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    if not same.any():
        return mix(hashes)
    places = np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(same, 0, places))
    out = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        out[order] = ordered + (places - first).astype(np.uint64) * _BASE
    return mix(out)


def fingerprint(text: str) -> np.ndarray:
    """One 32-bit number for each hash function; equal texts have equal fingerprints."""
    plain = kmers(text)
    low = (numbered(plain) >> np.uint64(32)).astype(np.uint32)
    values, places = [], []
    for begin in range(0, len(low), BLOCK):
        hashed = (low[None, begin : begin + BLOCK] ^ _FLIP) * _TIMES
        for _ in range(min(TUPLE, hashed.shape[1])):
            at = hashed.argmin(axis=1)[:, None]
            values.append(hashed[_ROWS, at].astype(np.uint64))
            places.append(at + begin)
            hashed[_ROWS, at] = np.uint32(0xFFFFFFFF)
    values, places = np.hstack(values), np.hstack(places)
    least = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
    chosen = np.sort(places[_ROWS, least], axis=1)
    out = _SEEDS
    with np.errstate(over="ignore"):
        for column in plain[chosen].T:
            out = mix(out * _BASE + column)
    return (out >> np.uint64(32)).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of places in which two fingerprints agree, 0 to 1."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they and its next one are.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty); other columns are not read. The next
    document is the one with the next lower doc_id, after the last the first; rows with the same
    doc_id follow each other by text, rows without doc_id come last. A single document is its own
    next one. Two empty texts are alike (1). An empty table gives no rows.

    The documents are dealt into ranges of doc_id, one for each task, which sorts its range and
    reads it once. Each range gets a copy of the first document of the range after it: one text
    for each task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = shuffle_partitions(spark)
    bounds = [-x for x in range_bounds(rows.select((-F.col("doc_id")).alias("k")), "k", parts)]
    # Range 0 holds the highest doc_ids; a range starts with its bound and nulls end the last one.
    last = max(0, len(bounds) - 1)
    place = range_of(-F.col("doc_id"), [-x for x in bounds])
    place = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(place)
    dealt = rows.withColumn("bucket", place).withColumn("copy", F.lit(0))
    if bounds:
        after = {bounds[k]: (k - 1) % len(bounds) for k in range(len(bounds))}
        pairs = spark.createDataFrame(list(after.items()), "doc_id long, bucket int")
        firsts = rows.where(F.col("doc_id").isin(bounds)).join(F.broadcast(pairs), "doc_id")
    else:
        firsts = rows.withColumn("bucket", F.lit(0))
    copies = firsts.groupBy("bucket").agg(F.min("text").alias("text"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", "bucket", F.lit(1).alias("copy"))
    ordered = (
        dealt.unionByName(copies)
        .repartitionById(max(1, parts), "bucket")
        .sortWithinPartitions("bucket", "copy", F.col("doc_id").desc_nulls_last(), "text")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for key, text, _, copy in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = fingerprint(text)
                if held is not None:
                    before, past, print_ = held
                    changed = edited(past, text)
                    other = fingerprint(changed) if changed != past else print_
                    digest = hashlib.sha256(changed.encode()).hexdigest()
                    near = likeness(print_, other), likeness(print_, own)
                    row = (before, len(past), digest, print_.tobytes().hex())
                    out.append((*row, other.tobytes().hex(), *near))
                held = None if copy else (key, text, own)
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in COMPARED.split(", ")])

    return ordered.mapInArrow(read, COMPARED)
