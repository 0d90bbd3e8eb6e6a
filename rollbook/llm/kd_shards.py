"""Sharding by a k-d tree over the documents' metadata, cut at weighted medians.

A cell of the tree that is to make ``n`` shards is cut along the metadata dimension in which it
is widest, where ``n // 2`` of its ``n`` parts of the bytes lie before, until each cell makes one
shard, which then has the target bytes. All cells of a level are cut together. A cut is found by
narrowing: the keys of a cell between two bounds are counted in even buckets, in Spark, and the
bucket that holds the wanted weight gives the next bounds, until it holds one row or hardly any
bytes. So no sort, no sample and no cell's rows in one task are needed, and a value that a third
of all rows share is cut like any other: below its metadata, a key has bits of a hash.

Cells, bounds and buckets stay tables; the driver gets totals and the number of open cells.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import written

#: Even buckets of a cell in one step of narrowing.
BUCKETS = 4096
#: A bucket is not narrowed further if its bytes are at most this share of a shard's target.
CLOSE = 0.0005
#: Cells up to which their table is sent to every task (below 16 MB), else joined by shuffle.
BROADCAST_CELLS = 100_000
#: Documents that one task numbers within a shard.
SLICE_ROWS = 50_000
#: A dimension's values are told apart in so many steps of its range; hash bits stand below.
VALUE_BITS, HASH_BITS = 30, 32

#: Column names and what makes an ordered number of each.
Dimensions = dict[str, Callable[[str], Column]]


def text_key(name: str) -> Column:
    """The first seven bytes of a text as a number, so that it orders as the texts do; null: -1."""
    data = F.hex(F.substring(F.encode(F.col(name).cast("string"), "UTF-8"), 1, 7))
    return F.coalesce(F.conv(F.rpad(data, 14, "0"), 16, 10).cast("long"), F.lit(-1))


def number_key(name: str) -> Column:
    """A number as it is; null: the least one."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 62)))


def size_key(name: str) -> Column:
    """A size by its logarithm, so that few huge documents do not make all others look alike."""
    size = F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.floor(F.log2(size + 1) * (1 << 20)).cast("long")


#: Source, language, length and number of a document.
DOCUMENTS: Dimensions = {
    "source": text_key,
    "lang": text_key,
    "n_chars": size_key,
    "doc_id": number_key,
}


@dataclass(frozen=True)
class Shards:
    """``rows``: row, doc_id, size, text_crc32, shard and slot of every document; ``count``."""

    rows: DataFrame
    count: int


def _points(docs: DataFrame, dimensions: Dimensions, row: Column) -> DataFrame:
    """A thin row for each document: its key in each dimension, scaled to the whole range."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(
        row.alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *(key(name).alias(f"v{i}") for i, (name, key) in enumerate(dimensions.items())),
    )
    raw = written(raw, "kd-rows")
    ends = raw.agg(*(f(f"v{i}") for i in range(len(dimensions)) for f in (F.min, F.max))).first()
    hashed = F.xxhash64("row", "doc_id", "text_crc32")
    low = hashed.bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    keys = []
    for i in range(len(dimensions)):
        least, most = (float(x) if x is not None else 0.0 for x in ends[2 * i : 2 * i + 2])
        share = (F.col(f"v{i}").cast("double") - least) / max(1.0, most - least)
        step = F.least(F.floor(share * (1 << VALUE_BITS)), F.lit((1 << VALUE_BITS) - 1))
        keys.append((F.shiftleft(step.cast("long"), HASH_BITS) + low).alias(f"k{i}"))
    return raw.select("row", "doc_id", "size", "text_crc32", hashed.alias("hash"), *keys)


def _sent(cells: DataFrame, count: int) -> DataFrame:
    """A table of cells, of which there are at most ``count``, sent to all tasks if that is few."""
    return F.broadcast(cells) if count <= BROADCAST_CELLS else cells


def _key(dimensions: int) -> Column:
    return F.element_at(F.array(*(f"k{i}" for i in range(dimensions))), F.col("axis") + 1)


def _open_cells(points: DataFrame, cells: DataFrame, dimensions: int, count: int) -> DataFrame:
    """The cells to cut, with their widest dimension, its bounds and the weight wanted before.

    The width is that of the values; among equal widths the first dimension is taken.
    """
    several = cells.where("shards > 1")
    inside = points.join(_sent(several, count), "cell")
    ends = [f(f"k{i}").alias(f"{n}{i}") for i in range(dimensions) for n, f in (("a", F.min), ("z", F.max))]
    found = inside.groupBy("cell").agg(F.sum("size").alias("bytes"), *ends)
    width = [F.shiftright(f"z{i}", HASH_BITS) - F.shiftright(f"a{i}", HASH_BITS) for i in range(dimensions)]
    axis = F.array_position(F.array(*width), F.array_max(F.array(*width))).cast("int") - 1
    found = found.withColumn("axis", axis)
    half = F.floor(F.col("shards") / 2)
    return found.join(several, "cell").select(
        "cell",
        "axis",
        F.element_at(F.array(*(f"a{i}" for i in range(dimensions))), F.col("axis") + 1).alias("low"),
        F.element_at(F.array(*(f"z{i}" for i in range(dimensions))), F.col("axis") + 1).alias("high"),
        F.lit(0).cast("long").alias("before"),
        F.col("bytes").alias("within"),
        (F.col("bytes") * half / F.col("shards")).alias("goal"),
        F.lit(False).alias("done"),
    )


def _narrowed(points: DataFrame, open_: DataFrame, close: float, dimensions: int, count: int) -> DataFrame:
    """One step: the bucket of each open cell that holds the wanted weight."""
    todo = open_.where("not done")
    key = F.col("key")
    width = F.floor((F.col("high") - F.col("low")) / F.lit(BUCKETS)).cast("long") + 1
    rows = (
        points.join(_sent(todo, count), "cell")
        .withColumn("key", _key(dimensions))
        .where(key.between(F.col("low"), F.col("high")))
        .withColumn("bucket", F.floor((key - F.col("low")) / width))
    )
    buckets = rows.groupBy("cell", "axis", "before", "goal", "bucket").agg(
        F.sum("size").alias("within"),
        F.count(F.lit(1)).alias("n"),
        F.min("key").alias("low"),
        F.max("key").alias("high"),
    )
    # At most BUCKETS + 1 rows of a cell meet in a window.
    upto = Window.partitionBy("cell").orderBy("bucket")
    upto = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.col("start") + F.col("within")
    held = buckets.withColumn("start", F.col("before") + F.sum("within").over(upto) - F.col("within"))
    held = held.where((F.col("start") < F.col("goal")) & (after >= F.col("goal")))
    small = (F.col("n") == 1) | (F.col("low") == F.col("high")) | (F.col("within") <= close)
    narrowed = held.select(
        "cell", "axis", "low", "high", F.col("start").alias("before"), "within", "goal", small.alias("done")
    )
    return open_.where("done").unionByName(narrowed)


def assign(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: Dimensions | None = None,
    row: Column | None = None,
) -> Shards:
    """Put every document into one of ``shards`` shards, or into as many as have ``target_bytes``.

    ``docs`` needs ``doc_id``, ``text`` and what ``dimensions`` reads (by default source, lang
    and n_chars); other columns are not read. A document weighs the UTF-8 bytes of its text (null:
    none) and one more. The shards' weights differ from each other by little more than the
    heaviest document. Nulls in a dimension come first in it. Each row is a document of its own,
    also if doc_ids or whole rows are repeated or null; equal texts may be parted. Shards are
    numbered from 0 in the order of the tree, slots gapless from 0 in each shard. With fewer
    documents than shards some shards are empty. An empty table gives no rows.

    ``row`` tells rows apart; by default it is their place in the scan, which is kept in a
    written table, so that lost tasks are repeated alike.
    """
    dimensions = DOCUMENTS if dimensions is None else dimensions
    row = F.monotonically_increasing_id() if row is None else row
    points = written(_points(docs, dimensions, row).withColumn("cell", F.lit(0).cast("long")), "kd-points")
    total, rows = points.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("Tell the number of shards or their target bytes.")
        shards = max(1, -(-total // target_bytes))
    if shards < 1:
        raise ValueError("There must be at least one shard.")
    spark = docs.sparkSession
    cells = spark.createDataFrame([(0, 0, shards)], "cell long, first long, shards long")
    close = CLOSE * total / shards
    many = len(dimensions)
    for level in range((shards - 1).bit_length()):
        count = min(shards, 1 << level)
        open_ = written(_open_cells(points, cells, many, count), "kd-cells")
        while not open_.where("not done").isEmpty():
            open_ = written(_narrowed(points, open_, close, many, count), "kd-cells")
        # The last bucket goes to the side to which more of it belongs.
        left = F.col("before") + F.col("within") - F.col("goal") <= F.col("goal") - F.col("before")
        cuts = open_.select("cell", "axis", F.when(left, F.col("high")).otherwise(F.col("low") - 1).alias("cut"))
        on_right = F.coalesce((_key(many) > F.col("cut")).cast("long"), F.lit(0))
        names = [c for c in points.columns if c != "cell"]
        points = points.join(_sent(cuts, count), "cell", "left").select(
            *names, (F.col("cell") * 2 + on_right).alias("cell")
        )
        points = written(points, "kd-points")
        half = F.floor(F.col("shards") / 2)
        halves = F.array(
            F.struct((F.col("cell") * 2).alias("cell"), "first", half.alias("shards")),
            F.struct((F.col("cell") * 2 + 1).alias("cell"), (F.col("first") + half).alias("first"), (F.col("shards") - half).alias("shards")),
        )
        same = F.array(F.struct((F.col("cell") * 2).alias("cell"), "first", "shards"))
        parts = F.explode(F.when(F.col("shards") > 1, halves).otherwise(same)).alias("c")
        cells = written(cells.select(parts).select("c.*"), "kd-cells")
    placed = points.join(_sent(cells, shards), "cell").withColumnRenamed("first", "shard")
    return Shards(_numbered(placed, max(1, -(-rows // SLICE_ROWS))), shards)


def _numbered(placed: DataFrame, slices: int) -> DataFrame:
    """Slots within each shard, in the order of a hash; no task numbers a whole large shard."""
    sliced = placed.withColumn("slice", F.pmod(F.shiftright("hash", 32), F.lit(slices)))
    sizes = sliced.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "slice").orderBy("hash", "row")
    return (
        sliced.withColumn("at", F.row_number().over(inner))
        .join(sizes, ["shard", "slice"])
        .select(
            "row",
            "doc_id",
            "size",
            "text_crc32",
            F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("at") - 1).alias("slot"),
        )
    )


def write_shards(
    docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, **settings
) -> DataFrame:
    """Write all columns of ``docs`` to ``path``, in a folder ``shard=N`` for each shard.

    Returns shard, rows and bytes of each shard that is not empty. A column of ``docs`` must not
    be named shard. The documents are kept once in the shared folder, where each gets its number,
    and once written.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("The documents have a column named shard.")
    kept = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "kd-docs")
    assigned = assign(kept.select("row", "doc.*"), shards, target_bytes, row=F.col("row"), **settings)
    placed = written(assigned.rows, "kd-shards")
    out = kept.join(placed.select("row", "shard"), "row").select("doc.*", "shard")
    out.write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
