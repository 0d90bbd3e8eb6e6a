"""Exact Jaccard join of documents on word n-grams, rare n-grams first.

The distinct n-grams of a document are put in one order for all documents, rare ones first. Two
documents whose sets are alike enough share an n-gram among the first few of each (the prefix),
so the join is on prefix n-grams only. A match is kept if the sizes allow the likeness (length
filter), if enough n-grams stand behind the matched places (positional filter), and, before the
sets are compared, if the counts of both in fixed ranges of hashes allow it (suffix filter).
Every pair is verified once, on the whole sets.

Equal sets are one class, and the join is among classes. Groups of thousands of near copies are
not spelled out pair by pair: each prefix n-gram first compares its documents with one pivot,
its least one, and then only documents that are still in different components. No link between
components is lost, because every pair that passes the filters either meets as pivot and
document, is in one component already, or is compared in the second step.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.components import components
from rollbook.llm.tables import written
from rollbook.llm.words import slices, text_bytes, windows, word_hashes, word_spans
from rollbook.llm.workers import giving_back

#: Cells of the table of n-gram counts that gives the order; each task gets all of them.
COUNT_CELLS = 1 << 18
#: Ids up to which the documents to keep are found by a broadcast (16 MB), else by a shuffle.
BROADCAST_IDS = 2_000_000
#: n-grams up to which those that documents share are sent to every task (32 MB), else shuffled.
BROADCAST_GRAMS = 2_000_000
#: Groups to which the pairs of one document are dealt when their sets are compared.
PIVOT_GROUPS = 64
#: The suffix filter cuts the hashes into 64 ranges, and into four times as many while a range
#: would hold this many n-grams of a set, so that it tells long sets apart as well as short ones.
FULL_RANGE = 16
#: Larger counts are taken as this one, so that a range is one byte; that only weakens the filter.
MOST_IN_CELL = 127
SETS = "doc_id long, n_shingles long, digest binary, cells array<int>, counts array<long>"


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct ``size``-word n-grams of each text, A-Z taken as a-z.

    A text with fewer words has its whole sequence as its only one; one without words has none.
    """
    for part in slices(texts):
        data, offsets = text_bytes(part)
        starts, ends, first = word_spans(data, offsets)
        hashes, _, runs = windows(word_hashes(data, starts, ends), first, size)
        edges = np.concatenate(([0], np.cumsum(runs)))
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            yield np.unique(hashes[begin:end])


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def prefix_size(sizes: np.ndarray, percent: int) -> np.ndarray:
    """n-grams of a set of which one must be shared by any set that is alike enough."""
    return sizes - -(-sizes * percent // 100) + 1


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets."""
    needed = -(-percent * (len(a) + len(b)) // (100 + percent))
    return len(np.intersect1d(a, b, assume_unique=True)) >= needed


def range_counts(grams: np.ndarray) -> np.ndarray:
    """How many of a set's hashes are in each of its ranges, up to a limit.

    Limited counts differ by no more than the whole ones, so no pair that is alike is lost.
    """
    bits = 6
    while len(grams) >= FULL_RANGE << bits:
        bits += 2
    places = (grams >> np.uint64(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(places, minlength=1 << bits), MOST_IN_CELL).astype(np.int8)


def lists(values: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, kind), *values])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _needed(percent: int, a: str, b: str) -> Column:
    return F.ceil(F.lit(percent) * (F.col(a) + F.col(b)) / F.lit(100 + percent))


def _may_link(percent: int, n: str, at: str, other_n: str, other_at: str) -> Column:
    """Length and positional filter of one match of two prefixes."""
    size = F.least(n, other_n) * 100 >= F.greatest(n, other_n) * percent
    behind = F.least(F.col(n) - F.col(at), F.col(other_n) - F.col(other_at))
    return size & (behind >= _needed(percent, n, other_n))


def _band(percent: int, n: str) -> Column:
    """Bands of set sizes, wide enough that sets of likeness ``percent`` differ by one at most.

    The bands are a thousandth wider than the ratio of such sizes, which outweighs rounding.
    """
    return F.floor(F.log(F.col(n).cast("double")) / math.log(100 / percent * 1.001)).cast("int")


def _sent(table: DataFrame, most: int) -> DataFrame:
    """A written table, sent to every task if it is counted to have at most ``most`` rows."""
    return F.broadcast(table) if table.count() <= most else table


def _suffixes_allow(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Suffix filter: sets whose counts in ranges of hashes differ too much share too little.

    Sets of so different size that their ranges differ are left to be verified.
    """
    for side in ("b", "a"):
        known = prefixes.select(
            F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("cells").alias(f"c_{side}")
        )
        pairs = pairs.join(known, side)
    apart = F.aggregate(
        F.zip_with("c_a", "c_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))),
        F.lit(0),
        lambda s, x: s + x,
    )
    shared = (F.col("n_a") + F.col("n_b") - apart) / 2
    other = F.size("c_a") != F.size("c_b")
    return pairs.where(other | (shared >= _needed(percent, "n_a", "n_b"))).select("a", "b").distinct()


def _verified(
    docs: DataFrame, pairs: DataFrame, prefixes: DataFrame, size: int, percent: int
) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose whole sets are alike."""
    pairs = written(_suffixes_allow(pairs.distinct(), prefixes, percent), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if pairs.count() <= BROADCAST_IDS // 2:
        ids = F.broadcast(ids)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x.astype("<u8").tobytes() for x in shingle_sets(batch.column("text"), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.binary())], ["id", "grams"]
            )

    chosen = docs.join(ids, "doc_id", "left_semi").mapInArrow(giving_back(sets), "id long, grams binary")
    chosen = written(chosen, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows without b bring the sets of a; those behind them are compared with these."""
        of, sets = None, []
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("a", "salt", "b")]
            keep = []
            for a, salt, b, data in zip(*columns, batch.column("grams"), strict=True):
                grams = np.frombuffer(data.as_buffer(), "<u8")
                if of != (a, salt):
                    of, sets = (a, salt), []
                if b is None:
                    sets.append(grams.copy())
                keep.append(b is not None and any(alike(x, grams, percent) for x in sets))
            links = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"])
            yield links.filter(pa.array(keep, pa.bool_()))

    # A pivot's pairs are dealt to groups, each of which gets the pivot's set once.
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(PIVOT_GROUPS)).cast("int"))
    left = salted.select("a", "salt", F.lit(None).cast("long").alias("b"), F.col("a").alias("id"))
    both = left.distinct().unionByName(salted.withColumn("id", F.col("b"))).join(chosen, "id")
    both = both.select("a", "salt", "b", "grams").repartition("a", "salt")
    both = both.sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return written(both.mapInArrow(giving_back(compare), "a long, b long"), "verified")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, class_id and component_id of every row of ``docs``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. ``class_id`` is the least
    doc_id of the documents with the same set, ``component_id`` the least one reachable by links
    of ``percent`` or more. A null, empty or blank text has no n-grams and is linked with
    nothing, not even its like. Rows with the same doc_id are one document with several texts.
    Rows without doc_id have their number of n-grams, but no class and no component. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_CELLS, np.int64)
        names = [c.split()[0] for c in SETS.split(", ")]
        kinds = [pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            sizes, digests = [], []
            for grams in shingle_sets(batch.column("text"), size):
                np.add.at(counts, cell(grams), 1)
                sizes.append(len(grams))
                digest = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                digests.append(digest if len(grams) else None)
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64())]
            columns += [pa.array(digests, pa.binary()), *(pa.nulls(len(sizes), t) for t in kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)
        used = np.flatnonzero(counts)
        row = [pa.array([None], t) for t in (pa.int64(), pa.int64(), pa.binary())]
        row += [pa.array([x.tolist()], t) for x, t in zip((used, counts[used]), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(row, names)

    summary = written(docs.mapInArrow(giving_back(summarize), SETS), "summary")
    counted = summary.where("cells is not null").select(
        F.explode(F.arrays_zip("cells", "counts")).alias("c")
    )
    counted = counted.groupBy("c.cells").agg(F.sum("c.counts").alias("n")).toArrow()
    frequency = np.zeros(COUNT_CELLS, np.int64)
    frequency[counted["cells"].to_numpy()] = counted["n"].to_numpy()

    rows = summary.where("cells is null").select("doc_id", "n_shingles", "digest")
    classes = written(
        rows.where("doc_id is not null and digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("class_id")),
        "classes",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out, cells = [], [], []
            for grams in shingle_sets(batch.column("text"), size):
                cells.append(range_counts(grams))
                order = np.lexsort((grams, frequency[cell(grams)]))
                count = int(prefix_size(np.int64(len(grams)), percent)) if len(grams) else 0
                sizes.append(len(grams))
                out.append(grams[order[:count]].astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int32()),
                    lists(out, np.int64),
                    lists(cells, np.int8),
                ],
                ["id", "n", "grams", "cells"],
            )

    first = written(classes.select(F.col("class_id").alias("id")).distinct(), "first")
    prefixes = docs.mapInArrow(giving_back(cut), "id long, n int, grams array<long>, cells array<tinyint>")
    prefixes = written(prefixes.join(_sent(first, BROADCAST_IDS), "id", "left_semi"), "prefixes")
    # Where an id has several sets, the one of the pivot is not told: those matches skip the filter.
    several = prefixes.groupBy("id").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    several = _sent(written(several, "several"), BROADCAST_IDS)
    place = F.shiftleft(F.col("n").cast("long"), 32) + F.col("at")
    members = prefixes.join(several, "id", "left").select(
        "id", "n", "sets", F.posexplode("grams").alias("at", "gram")
    )
    members = members.withColumn("place", F.when(F.col("sets").isNull(), place).otherwise(-1))
    pivots = members.groupBy("gram").agg(
        F.min("id").alias("pivot"), F.max("id").alias("last"), F.min_by("place", "id").alias("of")
    )
    pivots = written(pivots.where("pivot != last").drop("last"), "pivots")
    shared = members.drop("sets", "place").join(_sent(pivots, BROADCAST_GRAMS), "gram")
    shared = written(shared, "shared")

    matches = shared.where("id != pivot").withColumns(
        {
            "an": F.shiftright("of", 32).cast("int"),
            "aat": F.col("of").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"),
        }
    )
    matches = matches.where((F.col("of") < 0) | _may_link(percent, "an", "aat", "n", "at"))
    pairs = matches.select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    links = _verified(docs, pairs, prefixes, size, percent)

    found = components(links)
    placed = shared.join(found, "id", "left").select(
        "gram",
        "id",
        "n",
        "at",
        "pivot",
        F.coalesce("component", "id").alias("component"),
    )
    split = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("rows"))
    split = split.groupBy("gram").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"),
        F.count(F.lit(1)).alias("parts"),
    )
    open_ = placed.where("id != pivot").join(split.where("parts > 1"), "gram")
    open_ = open_.withColumn("in_main", F.col("component") == F.col("main"))
    open_ = written(open_.drop("pivot", "parts", "main"), "open")
    # Sets that may link lie in the same or neighbouring bands of size, and are joined by band.
    open_ = open_.withColumn("band", _band(percent, "n"))
    near = F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band")
    minor = open_.where("not in_main").select(
        "gram", near, *(F.col(c).alias(f"a_{c}") for c in ("id", "n", "at", "component"))
    )
    rest = minor.join(open_, ["gram", "band"]).where(
        (F.col("a_component") != F.col("component"))
        & (F.col("in_main") | (F.col("a_id") < F.col("id")))
        & _may_link(percent, "a_n", "a_at", "n", "at")
    )
    rest = rest.select(F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b"))
    links = links.union(_verified(docs, rest, prefixes, size, percent))

    # Two sets of one doc_id are one document.
    same = rows.where("digest is not null and doc_id is not null").join(classes, "digest")
    linked = components(links.union(_own(same)))
    named = classes.join(linked, classes["class_id"] == linked["id"], "left").select(
        "digest", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    out = rows.join(named, "digest", "left")
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _own(same: DataFrame) -> DataFrame:
    """Links among the classes of rows with the same doc_id."""
    spread = same.groupBy("doc_id").agg(
        F.min("class_id").alias("a"), F.collect_set("class_id").alias("all")
    )
    return spread.where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
