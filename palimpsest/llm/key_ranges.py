"""Ranges of an integer key that hold about as many rows each, the same however the rows were partitioned.

Keys are counted, dealt to sorted partitions and numbered there after the counts of the partitions before; no task sees more than its share. What comes to
the driver, and goes to the tasks, is the first key of each range: eight bytes for `range_rows` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def first_keys(rows: DataFrame, key: str, range_rows: int) -> np.ndarray:
    """The first key of each range, ascending; a key's rows are never in two ranges. Null keys are left out."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sorted_ = counts.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    path = scratch.write(sorted_, "keys")
    sorted_ = scratch.load(rows.sparkSession, path, sorted_)
    sizes = sorted_.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row per partition
    start = F.sum("n").over(Window.partitionBy("part").orderBy("key")) - F.col("n") + F.col("before")
    ranges = sorted_.join(F.broadcast(before), "part").select("key", F.floor(start / range_rows).alias("range"))
    found = ranges.groupBy("range").agg(F.min("key").alias("key")).select("key").toPandas()["key"].to_numpy(np.int64)
    scratch.drop(rows.sparkSession, path)
    return np.sort(found)


def range_of(key: Column, firsts: np.ndarray) -> Column:
    """The number of the range that a key is in; 0 for a null key."""

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(firsts, keys.to_numpy(np.int64), "right") - 1, 0).astype(np.int32))

    return number(F.coalesce(key, F.lit(int(firsts[0]) if len(firsts) else 0)))  # no long with nulls, which pandas would make a double
