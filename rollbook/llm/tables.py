"""Tables that later steps read again, and rows dealt out in the order of a key."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.staging import shared_folder

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` values of ``key``, ascending, that cut the rows into even ranges.

    Each range starts with its bound; the first bound is the least key. Empty without keys.
    One pass over one column; the driver gets ``parts`` numbers.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = F.percentile_approx(key, shares, 10 * parts) if shares else F.array()
    low, inner = df.agg(F.min(key), cuts).first()
    return [] if low is None else sorted({low, *(inner or [])})


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of the range of ``key``; the nulls belong to range 0."""
    edges = np.array(bounds[1:], dtype=np.int64)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), "right").astype(np.int32))

    return place(F.coalesce(key, F.lit(bounds[0] if bounds else 0)).cast("long"))
