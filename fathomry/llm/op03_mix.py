"""Mixing sources to target weights by capped water-filling.

The mix shares ``share`` times all sizes among the sources by weight; a source is clamped at
``max_epochs`` times its own size and what it can't take goes to the others by weight, until
none is above its clamp. A source then repeats whole ``floor(target / size)`` times, and the
rest is a fraction of it: its documents in the order of a seeded hash, each taken once more
while its middle word is within the fraction. That order is cut into hash buckets, so a source
of any size is summed and cut by bucket: only the one bucket in which the fraction ends is
ordered hash by hash.

Equal rows have equal hashes. Where the fraction ends among rows of one hash, only as many of
them are taken once more as fit; those rows alone are written and numbered, by ranges, so a
document that a third of all rows repeat is cut as near its target as any other and gathered
nowhere. Taken words miss the target by half of one document at most.

Defined results: a null text has size 0; null is a source of its own, ordered last; documents
of size 0 are taken no words of; an empty table gives an empty result; repeated rows are
documents of their own, and which of several equal ones is taken once more makes no difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order import global_index
from ._columns import apart
from ._work import Work

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, 17
#: A source's hashes have _BITS bits and fall into 2 ** (_BITS - _SHIFT) buckets; one of them is ordered in a single task.
_BITS, _SHIFT = 60, 48
#: Sources whose table may be broadcast; beyond, the joins shuffle.
BROADCAST_SOURCES = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_of(seed: int) -> Column:
    """A document's place in the seeded order of its source: the first 60 bits of an md5."""
    parts = [F.lit(f"{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _BITS // 4), 16, 10).cast("long")


def _small(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its size allows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def water_fill(sources: DataFrame, total: float) -> DataFrame:
    """sources(source, weight, cap) with ``target``; all caps are filled if they sum to less than total.

    Every round clamps the sources whose share is above their cap; only sums come to the driver.
    """
    level, clamped = 0.0, F.lit(False)
    while True:
        free, used = sources.agg(F.sum(F.when(~clamped, F.col("weight"))), F.sum(F.when(clamped, F.col("cap")))).first()
        if not free or (total - (used or 0.0)) / free <= level:
            return sources.withColumn("target", F.when(clamped, F.col("cap")).otherwise(F.col("weight") * F.lit(level)))
        level = (total - (used or 0.0)) / free
        clamped = F.col("weight") * F.lit(level) >= F.col("cap")


def targets(work: Work, sizes: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, whole, cut, at, some) from sizes(source, size, h), written.

    A document is taken ``whole`` times, and once more if its hash is at most ``cut``; of those
    whose hash is ``at`` (if not null), ``some`` are taken once more.
    """
    shared, work = work, work.sub("targets")
    sizes = sizes.withColumn("bucket", F.shiftright("h", _SHIFT).cast("int"))
    buckets = work.save(sizes.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets", rows=sizes.count())
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    # Ranks: each range partition counts its sources, and the few counts are summed up in order.
    parts = work.save(sources.repartitionByRange(16, F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()), "parts", rows=buckets.count())
    n = parts.count()
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = parts.join(F.broadcast(before), "part").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    weighed = work.save(weighed, "weighed", rows=n)
    total = (weighed.agg(F.sum("source_size")).first()[0] or 0) * share
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = water_fill(weighed, total).withColumn("whole", F.floor(epochs)).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    filled = work.save(filled.select("source", "source_size", "target", "whole", "rest"), "filled", rows=n)

    # Where the fraction ends: the last bucket wholly inside, and how far into the next one.
    by_source = Window.partitionBy("source")
    ends = buckets.withColumn("end", F.sum("bucket_size").over(by_source.orderBy("bucket"))).join(_small(filled.select(F.col("source").alias("f_source"), "rest")), F.col("source").eqNullSafe(F.col("f_source")))
    inside = ends.groupBy("source").agg(F.max(F.when(F.col("end") <= F.col("rest"), F.col("bucket"))).alias("last")).select(F.col("source").alias("i_source"), F.shiftleft(F.col("last").cast("long"), _SHIFT).bitwiseOR(F.lit((1 << _SHIFT) - 1)).alias("inside"))
    torn = ends.where((F.col("end") > F.col("rest")) & (F.col("end") - F.col("bucket_size") < F.col("rest"))).select("f_source", F.col("bucket").alias("t_bucket"), "rest", (F.col("end") - F.col("bucket_size")).alias("start"))
    members = sizes.join(_small(work.save(torn, "torn", rows=n)), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("bucket") == F.col("t_bucket")))
    members = members.groupBy("source", "h", "rest", "start").agg(F.count("*").alias("n"), F.max("size").alias("one"))
    start = F.col("start") + F.sum(F.col("n") * F.col("one")).over(by_source.orderBy("h")) - F.col("n") * F.col("one")
    #: row i of a hash, from 0, is taken once more if its middle is within the rest; so many of them are
    guess = F.floor((F.col("rest") - F.col("from")) / F.col("one") + 0.5)
    fits = lambda i: F.col("from") + i * F.col("one") + F.col("one") / 2 <= F.col("rest")
    fit = F.when(F.col("one") == 0, F.col("n")).when(fits(guess), guess + 1).when((guess > 0) & ~fits(guess - 1), guess - 1).otherwise(guess)
    cut = members.withColumn("from", start).withColumn("some", F.greatest(F.lit(0), F.least("n", fit)).cast("long"))
    beyond = cut.groupBy(F.col("source").alias("b_source")).agg(
        F.max(F.when(F.col("some") == F.col("n"), F.col("h"))).alias("beyond"), F.max(F.when((F.col("some") > 0) & (F.col("some") < F.col("n")), F.struct("h", "some"))).alias("part")
    )
    out = filled.join(inside, F.col("source").eqNullSafe(F.col("i_source")), "left").join(beyond, F.col("source").eqNullSafe(F.col("b_source")), "left")
    found = shared.save(out.select("source", "source_size", "target", "whole", F.coalesce("beyond", "inside").alias("cut"), F.col("part.h").alias("at"), F.col("part.some").alias("some")), "targets", rows=n)
    work.clear()
    return found


_ASKED = ("source", "source_size", "target", "whole", "cut", "at", "some")


def _repeated(work: Work, rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows(source, __h, ...) with ``__source_size``, ``__target`` and ``__repeats``.

    The rows at which a fraction ends are written and numbered; all others are decided by their hash alone.
    """
    found = found.select(*[F.col(c).alias(f"__{c}") for c in _ASKED])
    partial = found.where("__at IS NOT NULL").count()
    joined = rows.join(_small(found), F.col("source").eqNullSafe(F.col("__source")))
    at_end = F.coalesce(F.col("__h") == F.col("__at"), F.lit(False))
    once = F.coalesce((F.col("__h") <= F.col("__cut")).cast("long"), F.lit(0))
    columns = [*[f"`{c}`" for c in rows.columns], "__source_size", "__target"]
    plain = joined.where(~at_end).select(*columns, (F.col("__whole") + once).alias("__repeats"))
    if not partial:
        return plain
    ends = work.save(joined.where(at_end).select(*columns, "__whole", "__some", F.xxhash64(*[f"`{c}`" for c in rows.columns]).alias("__same"), F.monotonically_increasing_id().alias("__row")), "ends")
    numbered = global_index(ends, [F.col("source").isNull(), "source", "__same", "__row"], "__i", save=work.save)
    first = numbered.groupBy(F.col("source").alias("__source")).agg(F.min("__i").alias("__first"))
    more = (F.col("__i") - F.col("__first") < F.col("__some")).cast("long")
    counted = numbered.join(_small(work.save(first, "firsts", rows=partial)), F.col("source").eqNullSafe(F.col("__source")))
    return plain.unionByName(counted.select(*columns, (F.col("__whole") + more).alias("__repeats")))


def plan(work: Work, docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) for every document."""
    rows = work.save(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), order_of(seed).alias("h")), "sizes")
    found = targets(work, rows, **options)
    repeated = _repeated(work, rows.withColumnRenamed("h", "__h"), found)
    return repeated.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__repeats").cast("long").alias("repeats"), (F.col("__repeats") * F.col("size")).cast("long").alias("taken"))


def mix(work: Work, docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """docs as mixed: a row for each repetition, numbered from 0 in ``repetition`` (in place of such a column)."""
    rows = work.save(docs.select("source", size_of(F.col("text")).alias("size"), order_of(seed).alias("h")), "sizes")
    found = targets(work, rows, **options)
    narrow, back = apart(docs.drop("repetition"), "doc_id", "text", "source")
    repeated = _repeated(work, narrow.withColumn("__h", order_of(seed)), found)
    return back(repeated.where("__repeats > 0").withColumn("__times", F.explode(F.sequence(F.lit(0), F.col("__repeats").cast("int") - 1))), F.col("__times").alias("repetition"))
