"""Mixing sources to target weights, in blocks of words that are drawn by index.

The words of a source, document after document, are cut into blocks of a fixed length. A source
gets so many slots of the output that its blocks there hold its target of words; a source that
is taken more than once is taken in passes over all its blocks, each pass in an order of its
own. The slots are dealt to output shards by multinomial draws, conditioned on each source's
total: the shards are halved again and again, and each half draws its sources' counts from what
its parent has, with a seed of its own. So a task finds its shards' counts alone, and reruns
agree. A source's next slots take the blocks that a pseudorandom permutation of its block
numbers names, and slots are joined to blocks by number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.tables import SPACES, WORD, written

BLOCK_WORDS = 128
SHARD_BLOCKS = 4096
#: A source is repeated so often at most.
MOST_REPEATS = 3
#: Sources the driver plans for.
MOST_SOURCES = 100_000
#: Documents of all sources in one slice, in which the words of each source are counted through.
SLICE_ROWS = 5_000
#: Draws are exact below so many slots; longer blocks make fewer.
MOST_SLOTS = 1_000_000_000

SLOTS = "shard long, place int, source_id int, pass int, block long, words int"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], repeats: int = MOST_REPEATS) -> list[float]:
    """Words for each source: all sizes shared by weight, none above ``repeats`` times its size.

    What a source cannot take is shared again among the others by weight.
    """
    out = [0.0] * len(sizes)
    rest, left = float(sum(sizes)), set(range(len(sizes)))
    while left:
        weight = sum(weights[i] for i in left)
        share = {i: rest * weights[i] / weight for i in left}
        over = {i for i in left if share[i] > repeats * sizes[i]}
        if not over:
            for i in left:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
            rest -= out[i]
        left -= over
    return out


@dataclass(frozen=True)
class Permutation:
    """A pseudorandom order of the numbers below ``size``, a number at a time (Feistel rounds)."""

    size: int
    key: int
    rounds: int = 6

    def _half(self) -> int:
        return max(1, ((self.size - 1).bit_length() + 1) // 2)

    def _mix(self, x: np.ndarray, step: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x + np.uint64((self.key + step * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(
                0xBF58476D1CE4E5B9
            )
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self._half()) - 1)

    def _walk(self, x: np.ndarray, steps: list[int], back: bool) -> np.ndarray:
        bits = np.uint64(self._half())
        low = np.uint64((1 << self._half()) - 1)
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):
            a, b = x[todo] >> bits, x[todo] & low
            for step in steps:
                if back:
                    a, b = b ^ self._mix(a, step), a
                else:
                    a, b = b, a ^ self._mix(b, step)
            x[todo] = (a << bits) | b
            todo = todo[x[todo] >= self.size]
        return x.astype(np.int64)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        return self._walk(places, list(range(self.rounds)), False)

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """The places of these numbers."""
        return self._walk(numbers, list(range(self.rounds))[::-1], True)


@dataclass(frozen=True)
class SourcePlan:
    """How a source of ``size`` words fills ``slots`` slots; the last has ``last_words`` words."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last_words: int
    key: int

    def order(self, pass_: int) -> Permutation:
        return Permutation(self.blocks, (self.key + pass_ * 0xD1B54A32D192ED03) % 2**64)


def plan_source(name: str | None, size: int, target: float, length: int, seed: int) -> SourcePlan:
    digest = hashlib.blake2b(f"{seed} {name!r}".encode(), digest_size=8).digest()
    key, blocks = int.from_bytes(digest, "little"), -(-size // length)
    plan = SourcePlan(name, size, target, blocks, 0, 0, key)
    words = round(target)
    if not size or not words:
        return plan
    passes, rest = divmod(words, size)
    short = size - (blocks - 1) * length
    if not rest:
        # The last slot is the last of a pass.
        last = int(plan.order(passes - 1).at(np.array([blocks - 1]))[0])
        whole = short if last == blocks - 1 else length
        return SourcePlan(name, size, target, blocks, passes * blocks, whole, key)
    # Words of the last pass up to the short block, which stands at ``odd``.
    odd = int(plan.order(passes).place(np.array([blocks - 1]))[0])
    if rest <= odd * length:
        count = -(-rest // length)
        last = rest - (count - 1) * length
    elif rest <= odd * length + short:
        count, last = odd + 1, rest - odd * length
    else:
        more = rest - odd * length - short
        count = odd + 1 + -(-more // length)
        last = more - (count - odd - 2) * length
    return SourcePlan(name, size, target, blocks, passes * blocks + count, last, key)


class Shards:
    """The slots of each source in each shard, drawn by halving."""

    def __init__(self, plans: list[SourcePlan], shard_blocks: int, seed: int) -> None:
        self.plans, self.shard_blocks, self.seed = plans, shard_blocks, seed
        self.totals = np.array([p.slots for p in plans], np.int64)
        self.slots = int(self.totals.sum())
        self.count = -(-self.slots // shard_blocks)
        self._path: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def counts(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of each source's first slot in this shard, and how many it has there."""
        while self._path and not self._path[-1][0] <= shard < self._path[-1][1]:
            self._path.pop()
        if not self._path:
            self._path.append((0, self.count, np.zeros_like(self.totals), self.totals))
        low, high, first, counts = self._path[-1]
        while high - low > 1:
            middle = (low + high) // 2
            draw = np.random.default_rng([self.seed, low, high])
            half = (middle - low) * self.shard_blocks
            left = draw.multivariate_hypergeometric(counts, half, method="marginals")
            if shard < middle:
                high, counts = middle, left
            else:
                low, first, counts = middle, first + left, counts - left
            self._path.append((low, high, first, counts))
        return first, counts

    def fill(self, shard: int, length: int) -> dict[str, np.ndarray]:
        """All slots of a shard, in a random order."""
        first, counts = self.counts(shard)
        parts = []
        for number, plan in enumerate(self.plans):
            slots = np.arange(first[number], first[number] + counts[number])
            if not len(slots):
                continue
            passes, blocks = slots // plan.blocks, slots % plan.blocks
            for pass_ in np.unique(passes):
                on = passes == pass_
                blocks[on] = plan.order(int(pass_)).at(blocks[on])
            words = np.where(
                blocks == plan.blocks - 1, plan.size - (plan.blocks - 1) * length, length
            )
            words[slots == plan.slots - 1] = plan.last_words
            parts.append((np.full(len(slots), number), passes, blocks, words))
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.random.default_rng([self.seed, shard]).permutation(len(columns[0]))
        source, passes, blocks, words = (c[order] for c in columns)
        return {
            "shard": np.full(len(order), shard, np.int64),
            "place": np.arange(len(order), dtype=np.int32),
            "source_id": source.astype(np.int32),
            "pass": passes.astype(np.int32),
            "block": blocks.astype(np.int64),
            "words": words.astype(np.int32),
        }


@dataclass(frozen=True)
class Mix:
    """``rows``: each document with ``size``, its ``source_id`` and its first word's number
    ``start`` in its source; ``slots``: the output; ``plans``: by source_id."""

    rows: DataFrame
    slots: DataFrame
    plans: list[SourcePlan]
    block_words: int

    def spans(self) -> DataFrame:
        """Each stretch of a document in one block, ``begin`` to ``end`` counted in the block."""
        length = F.lit(self.block_words).cast("long")
        last = F.floor((F.col("start") + F.col("size") - 1) / length)
        blocks = F.sequence(F.floor(F.col("start") / length), last)
        return (
            self.rows.where("size > 0")
            .withColumn("block", F.explode(blocks))
            .withColumn("base", F.col("block") * length)
            .withColumn("begin", F.greatest(F.col("start") - F.col("base"), F.lit(0)))
            .withColumn("end", F.least(F.col("start") + F.col("size") - F.col("base"), length))
        )

    def per_source(self) -> DataFrame:
        """source_id, source_size and target; one row for each source, at most MOST_SOURCES."""
        rows = [(i, p.size, p.target) for i, p in enumerate(self.plans)]
        spark = self.rows.sparkSession
        return spark.createDataFrame(rows, "source_id int, source_size long, target double")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    repeats: int = MOST_REPEATS,
    seed: int = 8,
    key: Column | None = None,
) -> Mix:
    """Draw a mixture of all documents; sources by code point, null last, weigh ``weights`` in turn.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns are not read. A null, empty
    or blank text has size 0 and is never taken. Null sources are one source. Rows with the same
    doc_id are documents of their own. A source's documents follow each other by a hash, so that
    reruns agree whatever the partitions are.
    Without words nothing is taken, and every target is 0. An empty table gives no rows. ``key``
    is a hash that tells rows of one doc_id apart, by default that of the text.

    The driver plans one row for each source. Documents are dealt to slices by a hash, so a
    source of any share of the rows is counted through by many tasks.
    """
    sized = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        (F.xxhash64("text") if key is None else key).alias("text_hash"),
    )
    sized = written(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).limit(MOST_SOURCES + 1)
    totals = totals.collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"There are more than {MOST_SOURCES} sources.")
    totals = sorted(((s, n, c) for s, n, c in totals), key=lambda x: (x[0] is None, x[0] or ""))
    names, sizes = [x[0] for x in totals], [x[1] for x in totals]
    shares = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    plans = [
        plan_source(name, size, target, block_words, seed)
        for name, size, target in zip(names, sizes, shares, strict=True)
    ]
    shards = Shards(plans, shard_blocks, seed)
    if shards.slots >= MOST_SLOTS:
        raise ValueError("Too many slots to draw exactly: choose a larger block_words.")

    spark = docs.sparkSession
    ids = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, source_id int")
    slices = max(1, -(-sum(x[2] for x in totals) // SLICE_ROWS))
    # Equal rows are counted first, so that many of them do not meet in one slice.
    equal = sized.groupBy("doc_id", "source", "size", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    rows = (
        equal.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(slices)))
        .join(F.broadcast(ids).withColumnRenamed("source", "name"), F.expr("source <=> name"))
        .withColumn("words", F.col("size") * F.col("n"))
    )
    before = rows.groupBy("source_id", "slice").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("source_id").orderBy("slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = before.select(
        "source_id", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before")
    )
    inner = Window.partitionBy("source_id", "slice").orderBy("doc_id", "size", "text_hash")
    inner = inner.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("words").over(inner), F.lit(0)))
    rows = rows.join(before, ["source_id", "slice"]).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    )
    start = F.col("before") + F.col("inner") + F.col("copy") * F.col("size")
    rows = rows.select("doc_id", "text_hash", "size", "source_id", start.alias("start"))
    rows = written(rows, "placed")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict(shards.fill(shard, block_words))

    # Written, so that their size is known when they are joined.
    slots = written(spark.range(shards.count).mapInArrow(deal, SLOTS), "slots")
    return Mix(rows, slots, plans, block_words)


def taken(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target and taken (words in the mix) of every document."""
    slots = mixed.slots.select("source_id", "block", "words")
    hits = mixed.spans().join(slots, ["source_id", "block"], "left")
    got = F.greatest(F.least("end", "words") - F.col("begin"), F.lit(0))
    got = F.coalesce(F.when(F.col("words").isNotNull(), got), F.lit(0))
    some = hits.groupBy("doc_id", "size", "source_id", "start").agg(F.sum(got).alias("taken"))
    none = mixed.rows.where("size = 0").select("doc_id", "size", "source_id", "start")
    every = some.unionByName(none.withColumn("taken", F.lit(0).cast("long")))
    sources = F.broadcast(mixed.per_source())
    return every.join(sources, "source_id").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each document once for each pass that takes words of it.

    The text has the words taken, with the white space behind them; ``n_chars`` is counted anew
    if ``docs`` has it, and all other columns are kept as their row has them. Documents of which
    nothing is taken go. Rows that are equal in all columns are documents of their own.
    """
    key = F.xxhash64(*(F.col(f"`{name}`") for name in docs.columns))
    mixed = mix(docs, key=key, **settings)
    slots = mixed.slots.select("source_id", "block", "pass", "words")
    hits = mixed.spans().join(slots, ["source_id", "block"])
    hits = hits.withColumn("end", F.least("end", "words").cast("long")).where("end > begin")
    offset = F.col("base") - F.col("start")
    parts = hits.groupBy("doc_id", "source_id", "text_hash", "start", "pass").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    (F.col("begin") + offset).cast("int").alias("begin"),
                    (F.col("end") - F.col("begin")).cast("int").alias("count"),
                )
            )
        ).alias("parts")
    )
    parts = parts.select(F.struct("doc_id").alias("part_id"), "text_hash", "parts")
    # The columns of a document stay in one, so that their names cannot clash. Ids in a struct are
    # equal if both are null, so the join has the keys of the grouping and texts move only once.
    texts = docs.select(
        F.struct("doc_id").alias("own_id"), key.alias("own_hash"), F.struct("*").alias("doc")
    )
    texts = texts.groupBy("own_id", "own_hash").agg(F.first("doc").alias("doc"))
    both = texts.join(parts, F.expr("own_hash = text_hash and own_id = part_id"))
    words = both.withColumn(
        "words", F.regexp_extract_all("doc.text", F.lit(f"{WORD}[{SPACES}]*"), F.lit(0))
    )
    chosen = F.transform(
        "parts", lambda x: F.array_join(F.slice("words", x["begin"] + 1, x["count"]), "")
    )
    out = words.withColumn("new_text", F.array_join(chosen, ""))
    changed = {"text": F.col("new_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    kept = (changed.get(name, F.col(f"doc.`{name}`")).alias(name) for name in docs.columns)
    return out.select(*kept)
