"""Running maxima, minima and sums within a key, for keys of any size.

A window by key sorts all rows of a key in one task. Here rows are dealt out by ranges of (key, order) instead, so that a large key spans
many tasks. Each task runs its own prefix; what the tasks before it hold of the same key is one summary each, and its own prefix over these
is carried into the task's rows. Only a key that goes on from one range into the next has a carry, so there are fewer carries than ranges
and they are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.sources.shared import written

PART = "_part"


def dealt(rows: DataFrame, key: str, order: list[str | Column], parts: int) -> DataFrame:
    """rows in ranges of (key, order), written with the number of their range; rows that agree in both share a range."""
    return written(rows.repartitionByRange(parts, key, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, key: str, order: list[str | Column], value: Column, name: str, fold: Callable[[Column], Column] = F.max, current: bool = False) -> DataFrame:
    """dealt rows with `name`: fold (max, min or sum) of the value over the key's rows before this one, or with `current` up to it. Null where there is none.

    The order must tell the rows of a key apart, else rows that tie come in any order.
    """
    d = rows.withColumn("_value", value)
    local = fold(F.col("_value")).over(Window.partitionBy(key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if current else -1))
    before = fold(F.col("_sum")).over(Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    carries = d.groupBy(key, PART).agg(fold(F.col("_value")).alias("_sum")).withColumn("_carry", before).where("_carry is not null").select(F.col(key).alias("_key"), F.col(PART).alias("_in"), "_carry")
    joined = d.withColumn("_local", local).join(F.broadcast(carries), d[key].eqNullSafe(F.col("_key")) & (d[PART] == F.col("_in")), "left")
    both = F.greatest("_local", "_carry") if fold is F.max else F.least("_local", "_carry") if fold is F.min else F.coalesce(F.col("_local") + F.col("_carry"), "_local", "_carry")
    return joined.withColumn(name, both).drop("_value", "_local", "_key", "_in", "_carry")
