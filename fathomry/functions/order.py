"""Reproducible order and exact global positions without a single-task sort."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import scratch


def seeded(seed: int | str, *keys) -> Column:
    """A key that shuffles rows the same way on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def ranged(df: DataFrame, order: list, save: Callable[[DataFrame, str], DataFrame] | None = None, partitions: int | None = None) -> DataFrame:
    """df in ranges of the order as a written table, with each row's range (``__part``) and place in it (``__place``).

    What is counted and what is numbered later must be the same ranges. Their bounds are
    sampled, so a plan that computed them twice (a lost executor, an exchange that isn't reused)
    could deal the rows differently; the table can't. ``save(df, name)`` writes it, by default
    to the session's shared folder.
    """
    parted = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    placed = parted.withColumn("__id", F.monotonically_increasing_id())
    table = (save or scratch(df.sparkSession))(placed, f"ranged-{uuid.uuid4().hex[:12]}")
    # The id is a partition's number above 33 bits of a row's number.
    return table.withColumn("__part", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def running(parted: DataFrame, sums: Column, name: str) -> DataFrame:
    """(__part, name): what the ranges before a range sum up to; one row a range."""
    per = parted.groupBy("__part").agg(sums.alias("__s"))
    return per.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name))


def global_index(df: DataFrame, order: list, name: str = "idx", partitions: int | None = None, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """df with a 0-based position in the given total order.

    One shuffle deals the rows into sorted ranges, which are written with the rows' places; only
    the ranges' row counts are summed up in one place.
    """
    parted = ranged(df, order, save, partitions)
    return parted.join(F.broadcast(running(parted, F.count("*"), "__before")), "__part").withColumn(name, (F.col("__place") + F.col("__before")).cast("long")).drop("__part", "__place", "__before")
