"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.tables import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the least id reachable, of every id in ``links`` (a, b).

    Each round ties the larger neighbours of every id to its least one, then the smaller ones;
    the rounds grow with the logarithm of the ids. Links are shuffled by id, and the driver gets
    two numbers for each round. Links may repeat and may tie an id to itself; a link with a null
    is left out. Without links there are no rows.
    """
    known = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = known.where("a = b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = known.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges, before = written(pairs.distinct(), "links"), None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u")
        large = large.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _least(large).select(
            F.explode(
                F.array(
                    F.struct(F.col("u"), F.col("m").alias("v")),
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        edges = written(small.select("e.u", "e.v").where("u != v").distinct(), "links")
    roots = edges.select(F.col("v").alias("u"), "v").union(loops)
    every = edges.union(roots.distinct())
    return every.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
