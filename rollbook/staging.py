"""Keep an aggregated table once, so that several results read it instead of the source.

A staged table is written as Parquet, in one pass, to the shared folder that
``spark.checkpoint.dir`` names; it survives lost executors and gives every reader the same rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Staged:
    """A kept table, its number of rows (or a bound of it), the sum of its counts, and what else
    was seen while it was written."""

    frame: DataFrame
    rows: int
    total: int = 0
    seen: dict[str, int] = field(default_factory=dict)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only for a local master."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="rollbook-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(
    df: DataFrame, count: str | None = None, seen: Mapping[str, Column] | None = None
) -> Staged:
    """Compute ``df`` now and keep it; ``count`` names a column to total along with the rows.

    Rows, total and the aggregates of ``seen`` are observed while the rows are written, so that
    they need no job of their own.
    """
    totals = [] if count is None else [F.sum(count).alias("total")]
    totals += [c.alias(f"seen {name}") for name, c in (seen or {}).items()]
    watch = Observation(f"stage-{uuid.uuid4().hex}")
    kept = written(df.observe(watch, F.count(F.lit(1)).alias("rows"), *totals))
    found = watch.get
    others = {name: found[f"seen {name}"] for name in seen or {}}
    return Staged(kept, found["rows"], found.get("total") or 0, others)


#: Bytes of a method above which the JVM does not compile it.
METHOD_BYTES = 8000
_LIMIT = "spark.sql.codegen.hugeMethodLimit"


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block run wide projections in pieces that the JVM compiles.

    Spark makes one method of a whole stage, however long, and the JVM interprets what is longer
    than :data:`METHOD_BYTES`. With Spark's limit at that size such a stage is run by operator, in
    short methods. Results are the same; the session's own limit is set again after the block.
    """
    before = spark.conf.get(_LIMIT)
    spark.conf.set(_LIMIT, str(min(int(before), METHOD_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(_LIMIT, before)


def together(*jobs: Callable) -> list:
    """Run independent jobs at the same time, so that small ones do not wait for each other."""
    inheriting = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheriting(job)) for job in jobs]
        return [job.result() for job in running]
