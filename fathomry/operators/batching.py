"""Batches for contrastive training in which no key occurs twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.order import global_index, seeded
from ..functions.store import scratch

SIZE = 128


def allocate(df: DataFrame, key: str, row_id: list[str], size: int = SIZE, seed: int | str = 0) -> DataFrame:
    """df with ``batch_id``: batches of exactly ``size`` rows, each key at most once in a batch.

    Rows in the order of key and seeded hash are dealt in turn to ``floor(n / size)`` batches:
    rows of one key are neighbours, so they go to different batches as long as a key has no
    more rows than there are batches. Keys with more are cut to that many first, which can
    lower the number of batches; that repeats until nothing is cut. Rows beyond full batches
    are left out, as are all where no batch can be filled.
    """
    order = seeded(seed, *row_id)
    # Written once: how many keys have how many rows is all that the rounds below need.
    counts = scratch(df.sparkSession)(df.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys")), "counts")
    batches = None
    while True:  # only totals come to the driver; batches can only fall
        total = counts.agg(F.sum(F.col("keys") * (F.col("n") if batches is None else F.least(F.col("n"), F.lit(batches))))).first()[0] or 0
        if batches is not None and total // size >= batches:
            break
        batches = total // size
        if not batches:
            return df.limit(0).withColumn("batch_id", F.lit(0).cast("long"))
    most = counts.agg(F.max("n")).first()[0]
    rows = df.withColumn("__o", order)
    if most > batches:
        w = Window.partitionBy(key).orderBy("__o", *row_id)
        rows = rows.withColumn("__c", F.row_number().over(w)).where(F.col("__c") <= batches).drop("__c")
    placed = global_index(rows, [F.col(key), F.col("__o"), *map(F.col, row_id)], "__p").withColumn("batch_id", F.pmod("__p", F.lit(batches)))
    w = Window.partitionBy("batch_id").orderBy("__p")
    return placed.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__o", "__p", "__r")


def full_only(df: DataFrame, batch: str = "batch_id", size: int = SIZE) -> DataFrame:
    full = df.groupBy(batch).agg(F.count("*").alias("__n")).where(F.col("__n") == size).select(batch)
    return df.join(full, batch, "left_semi")


def shuffle_batches(df: DataFrame, batch: str = "batch_id", seed: int | str = 0, name: str = "position") -> DataFrame:
    """df with the batches' new positions; a batch stays together."""
    batches = global_index(df.select(batch).distinct(), [seeded(seed, batch), F.col(batch)], name)
    return df.join(batches, batch)


def fixed_chunks(df: DataFrame, order: list, size: int = SIZE, name: str = "chunk") -> DataFrame:
    return global_index(df, order, "__i").withColumn(name, F.floor(F.col("__i") / size).cast("long")).drop("__i")


def mix(sets: dict[str, DataFrame], batch: str = "batch_id", seed: int | str = 0) -> DataFrame:
    """Batches of several datasets in one table with ``dataset`` and a common ``position`` order."""
    out = None
    for name, df in sorted(sets.items()):
        part = df.withColumn("dataset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    keys = out.select("dataset", batch).distinct()
    return out.join(global_index(keys, [seeded(seed, "dataset", batch), F.col("dataset"), F.col(batch)], "position"), ["dataset", batch])
