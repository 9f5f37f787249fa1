"""Filters, joins, sampling, splitting, windows and sets over row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.order import global_index, ranged, running, seeded
from ..functions.store import scratch

# -- joins -----------------------------------------------------------------------------

#: Rows of a head that are taken by a limit instead of numbering all.
HEAD = 100_000


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() if isinstance(c, Column) else F.col(c).desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lookup(left: DataFrame, right: DataFrame, on: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(joined, missed): right is first brought to one row a key, the last."""
    one = keep_last(right, on, order)
    return left.join(one, on), left.join(one.select(*on), on, "left_anti")


def zip_rows(left: DataFrame, right: DataFrame, left_order: list, right_order: list) -> DataFrame:
    """Row i beside row i; what one side has beyond the other is left out."""
    return global_index(left, left_order, "__i").join(global_index(right, right_order, "__i"), "__i").drop("__i")


def worklist(inputs: DataFrame, finished: DataFrame, on: list[str]) -> DataFrame:
    """Inputs without a result yet."""
    return inputs.join(finished.select(*on), on, "left_anti")


def all_but(items: Column, picked: Column, first: int = 1) -> Column:
    """Items whose place (from ``first``) isn't among the picked ones."""
    return F.filter(F.transform(items, lambda x, i: F.when(~F.array_contains(picked, (i + first).cast("int")), x)), lambda x: x.isNotNull())


# -- filters ---------------------------------------------------------------------------


def drop_class(df: DataFrame, value: str, column: str = "response") -> DataFrame:
    """All but one class."""
    return df.where(F.col(column) != value)


def keep_class(df: DataFrame, value: str, column: str = "response") -> DataFrame:
    return df.where(F.col(column) == value)


def long_enough(df: DataFrame, least: int, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(kept, too short); null is too short."""
    ok = F.coalesce(F.length(column) >= least, F.lit(False))
    return df.where(ok), df.where(~ok)


def is_visual(lines: Column, marks: tuple[str, ...] = ("figure", "table", "equation")) -> Column:
    """Whether the last word of some line names something visual."""
    last = F.transform(lines, lambda line: F.element_at(F.split(F.trim(line), r"\s+"), -1))
    return F.exists(last, lambda w: w.rlike("|".join(marks)))


def response_error(response: Column) -> Column:
    """type5 nothing readable, type4 bad JSON, type1 no ``result``, type2 not a filled list, else null."""
    v = F.try_parse_json(response)
    result = F.try_variant_get(v, "$.result", "array<variant>")
    has = F.is_variant_null(v).isNotNull() & F.schema_of_variant(v).contains("result:")
    return F.when(response.isNull(), "type5").when(v.isNull(), "type4").when(~has, "type1").when(F.coalesce(F.size(result), F.lit(0)) <= 0, "type2")


def example_error(line: Column) -> Column:
    """The first rule a training example breaks, or null.

    V1 not JSON; V3 no ``query.text`` string; V4 ``pos`` not a filled list; V5 not exactly one of
    text and image filled in the first positive; V6 neither of them a string.
    """
    v = F.try_parse_json(line)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    filled = lambda path: F.coalesce(F.try_variant_get(v, path, "string") != "", F.lit(False))
    text, image = "$.pos[0].text", "$.pos[0].image"
    return (
        F.when(v.isNull(), "V1")
        .when(F.coalesce(kind("$.query.text") != "STRING", F.lit(True)), "V3")
        .when(F.coalesce(F.size(F.try_variant_get(v, "$.pos", "array<variant>")), F.lit(0)) <= 0, "V4")
        .when(filled(text) == filled(image), "V5")
        .when(~F.coalesce((kind(text) == "STRING") | (kind(image) == "STRING"), F.lit(False)), "V6")
    )


def repaired_index(line: Column) -> Column:
    """V2: the example's index, 0 where it has none."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(line), "$.index", "long"), F.lit(0))


# -- sampling and splitting ------------------------------------------------------------


def sample_n(df: DataFrame, n: int, key: list[str], seed: int | str = 0, exact: bool = False) -> DataFrame:
    """n rows chosen by a seeded hash (all, if fewer; with ``exact`` that is an error)."""
    if exact and df.limit(n).count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def split_bands(df: DataFrame, sizes: list[int], key: list[str], seed: int | str = 0, name: str = "split") -> DataFrame:
    """Shuffled, then cut: split 0 gets sizes[0] rows, split 1 the next sizes[1], and so on; the rest goes."""
    order = [seeded(seed, *key), *map(F.col, key)]
    few = sum(sizes) <= HEAD  # of few rows only those are taken to be numbered
    rows, band, at = global_index(df.orderBy(*order).limit(sum(sizes)) if few else df, order, "__i"), F.lit(None).cast("int"), 0
    for i, size in enumerate(sizes):
        band = F.when((F.col("__i") >= at) & (F.col("__i") < at + size), F.lit(i)).otherwise(band)
        at += size
    return rows.withColumn(name, band).where(F.col(name).isNotNull()).drop("__i")


def cumulative_split(df: DataFrame, size: str, limits: list[int], order: list, name: str = "split", partitions: int | None = None) -> DataFrame:
    """Rows enter split i while the sizes before them are under limits[i]; then the next split starts from there.

    Running totals are built from written ranges: each sums its own rows, and the ranges' totals are summed up.
    """
    parted = ranged(df, order, partitions=partitions)
    own = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parted.withColumn("__own", own).join(F.broadcast(running(parted, F.sum(size), "__b")), "__part").withColumn("__before", F.col("__own") + F.col("__b"))
    band = F.lit(None).cast("int")
    for i, limit in reversed(list(enumerate(limits))):
        band = F.when(F.col("__before") < limit, F.lit(i)).otherwise(band)
    return rows.withColumn(name, band).where(F.col(name).isNotNull()).drop("__part", "__place", "__own", "__b", "__before")


def chunk_length(doc: Column, place: Column, seed: int | str = 0, lengths=(4, 5, 6), shares=(0.2, 0.3, 0.5)) -> Column:
    """The length of a document's chunk number ``place``, chosen by a hash of (seed, doc, place)."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), doc.cast("string"), place.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out = F.lit(lengths[-1])
    for i in reversed(range(len(lengths) - 1)):
        out = F.when(u < sum(shares[: i + 1]), F.lit(lengths[i])).otherwise(out)
    return out


#: Chunks of a document that are added up in one task.
CHUNK_BLOCK = 1024


def variable_chunks(pages: DataFrame, doc: str, page: str, seed: int | str = 0, lengths=(4, 5, 6), shares=(0.2, 0.3, 0.5)) -> DataFrame:
    """pages with ``chunk`` from 0: a document's pages in order, in chunks of 4 to 6, the tail kept.

    Every chunk has its own drawn length, however many a document has. A document is no more
    than its first place in the written order of all pages and a count, so its chunks come from
    a sequence: blocks of CHUNK_BLOCK of them sum up their lengths, the blocks' sums are added
    up, and each chunk then names its pages' places, which are joined with the pages. Only the
    blocks' sums of one document stand in one task. A null document is one of its own.
    """
    save = scratch(pages.sparkSession)
    placed = global_index(pages.withColumns({"__d": F.col(doc)}), [F.col(doc), F.col(page)], "__g", save=save)
    docs = placed.groupBy("__d").agg(F.min("__g").alias("__first"), F.count("*").alias("__n"))
    most = F.ceil(F.col("__n") / min(lengths))
    blocks = docs.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((most - 1) / CHUNK_BLOCK))))
    start = F.col("__b") * CHUNK_BLOCK

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.withColumn("chunk", F.explode(F.sequence(start, F.least(most, start + CHUNK_BLOCK) - 1))).withColumn("__l", chunk_length(F.col("__d"), F.col("chunk"), seed, lengths, shares))

    sums = drawn(blocks).groupBy("__d", "__first", "__n", "__b").agg(F.sum("__l").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__d").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = save(sums.withColumn("__before", before), "sums")
    own = F.coalesce(F.sum("__l").over(Window.partitionBy("__d", "__b").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = drawn(sums).withColumn("__at", own + F.col("__before")).where("__at < __n")
    last = F.least(F.col("__n"), F.col("__at") + F.col("__l")) - 1
    ours = begun.select("chunk", F.explode(F.sequence(F.col("__at"), last)).alias("__p"), "__first").select("chunk", (F.col("__first") + F.col("__p")).alias("__g"))
    return placed.drop("__d").join(ours, "__g").drop("__g")


def round_robin(df: DataFrame, order: list, shards: int, name: str = "shard") -> DataFrame:
    return global_index(df, order, "__i").withColumn(name, F.pmod("__i", F.lit(shards)).cast("int")).drop("__i")


def block_cyclic(df: DataFrame, order: list, block: int, shards: int, name: str = "shard") -> DataFrame:
    """Blocks of rows go to the shards in turn."""
    return global_index(df, order, "__i").withColumn(name, F.pmod(F.floor(F.col("__i") / block), F.lit(shards)).cast("int")).drop("__i")


def padded_shards(df: DataFrame, order: list, shards: int, repeats: int = 1, name: str = "shard", selected: int | None = None) -> DataFrame:
    """Every row ``repeats`` times in order, padded with the first rows to a multiple of the shards, and dealt in turn.

    Of each shard the first ``selected`` rows stay, if given (``selected_repeats`` says how many an epoch takes).
    """
    rows = global_index(df, order, "__i").withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("position", F.col("__i") * repeats + F.col("__k"))
    total = df.count() * repeats
    pad = -total % shards
    extra = rows.where(F.col("position") < pad).withColumn("position", F.col("position") + total)
    dealt = rows.union(extra).withColumn(name, F.pmod("position", F.lit(shards)).cast("int")).drop("__i", "__k")
    return dealt if selected is None else dealt.where(F.floor(F.col("position") / shards) < selected)


# -- windows and sets ------------------------------------------------------------------


def ordinal_ids(df: DataFrame, doc: str, order: list, name: str = "qid") -> DataFrame:
    """``doc-n`` with n from 1 within the document."""
    n = F.row_number().over(Window.partitionBy(doc).orderBy(*order))
    return df.withColumn(name, F.concat(F.col(doc).cast("string"), F.lit("-"), n.cast("string")))


def place_in(df: DataFrame, group: list[str], order: list, name: str = "place") -> DataFrame:
    """df with the place from 1 within its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def rotate(items: Column, start: Column, n: int) -> Column:
    """n items from a place on, around the end."""
    twice = F.concat(items, items)
    return F.slice(twice, F.pmod(start, F.size(items)).cast("int") + 1, n)


def pick(items: Column, seed: Column) -> Column:
    return F.element_at(items, (F.pmod(seed, F.size(items)) + 1).cast("int"))


def rank_difference(base: DataFrame, test: DataFrame, key: str, value: str) -> DataFrame:
    """(key, base_rank, test_rank, difference): places by value from the top, the change with its sign."""
    def places(df: DataFrame, name: str) -> DataFrame:
        return global_index(df.select(key, value), [F.col(value).desc(), F.col(key)], "__i").select(key, (F.col("__i") + 1).alias(name))

    both = places(test, "test_rank").join(places(base, "base_rank"), key, "left")
    return both.withColumn("difference", F.when(F.col("base_rank").isNull(), "").when(F.col("base_rank") == F.col("test_rank"), "0").otherwise(F.format_string("%+d", F.col("base_rank") - F.col("test_rank"))))


def best_n(df: DataFrame, group: list[str], metric: str, n: int, larger: bool = True, tie: str | None = None) -> DataFrame:
    """The n best rows of a group, as a bounded top-n."""
    order = [F.col(metric).desc() if larger else F.col(metric).asc(), *([F.col(tie)] if tie else [])]
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def tiers(pages: DataFrame, collection: str, visual: str, share: float = 0.8) -> DataFrame:
    """(collection, n_visual, n_textual, tier): visual if more than the share of pages is."""
    n = pages.groupBy(collection).agg(F.count_if(F.col(visual)).alias("n_visual"), F.count_if(~F.col(visual)).alias("n_textual"))
    return n.withColumn("tier", F.when(F.col("n_visual") / (F.col("n_visual") + F.col("n_textual")) > share, "visual").otherwise("textual"))


def dedup_content(df: DataFrame, content: str, order: list) -> DataFrame:
    """The first row of each content, compared by md5."""
    return keep_first(df, [F.md5(content)], order)


def average_vectors(df: DataFrame, vector: str = "embedding", group: list[str] | None = None) -> DataFrame:
    """Element-wise mean in doubles, clamped to the float range."""
    at = df.select(*(group or []), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    top = 3.4028234663852886e38
    mean = at.groupBy(*(group or []), "i").agg(F.least(F.greatest(F.avg("x"), F.lit(-top)), F.lit(top)).alias("x"))
    return mean.groupBy(*(group or [])).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p.x).alias(vector))


def average_best(df: DataFrame, metric: str, n: int, vector: str = "embedding", group: list[str] | None = None, larger: bool = True, tie: str | None = None) -> DataFrame:
    """(group, vector, n): the element-wise mean of the n best rows of each group by a metric, clamped to the float range.

    Tasks hand on n rows a group at most, and one row is made of the n that are left, whose vectors are summed up in the
    order of their places; so equal tables give equal means. Rows without a metric or vector take no part.
    """
    whole = df.where(F.col(metric).isNotNull() & F.col(vector).isNotNull()).withColumn("__all", F.lit(0))
    rows = best_n(whole, group or ["__all"], metric, n, larger, tie)
    top = 3.4028234663852886e38
    held = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(vector).cast("array<double>").alias("v")))), lambda x: x.v)
    added = lambda v: F.aggregate(F.slice(v, 2, n), F.get(v, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    mean = rows.groupBy(*(group or ["__all"])).agg(held.alias("v"), F.count("*").alias("n"))
    clamped = F.transform(added(F.col("v")), lambda x: F.least(F.greatest(x / F.col("n"), F.lit(-top)), F.lit(top)))
    return mean.select(*(group or []), clamped.alias(vector), "n")


def sample_chunks(chunks: DataFrame, n: int, key: list[str], seed: int | str = 0) -> DataFrame:
    """n chunks by a seeded hash, or none at all where there are fewer."""
    enough = chunks.limit(n).count() >= n
    return sample_n(chunks, n, key, seed) if enough else chunks.limit(0)


def sort_if_complete(df: DataFrame, key: str) -> DataFrame:
    """Sorted by key from the top; left as it is if some row lacks the key."""
    return df if not df.where(F.col(key).isNull()).isEmpty() else df.orderBy(F.col(key).desc())


def selected_repeats(n: int, ratio: int, rounding: int = 256) -> int:
    """Samples of an epoch when each is repeated: the rows, rounded down, over the ratio."""
    return n // rounding * rounding // ratio if rounding else -(-n // ratio)


def decayed_batch(size: Column, parts: Column, no_odd: bool = False) -> Column:
    """The next smaller batch to try when memory runs out; 0 ends the ladder. With ``no_odd`` odd sizes are one less.

    The octave below ``size`` is cut into ``parts``; the next size is the last of its marks, counted from the octave on, that is smaller.
    """
    size = size.cast("long")
    octave = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(size - 1)) - 1)
    grid = F.greatest(F.floor(octave / parts), F.lit(1).cast("long"))
    out = octave + F.floor((size - octave - 1) / grid) * grid
    return F.when(size <= 1, 0).otherwise(out - out % 2 if no_odd else out)


def cap_members(df: DataFrame, order: list, most: int = 99_999) -> DataFrame:
    """The first ``most`` rows of an order; every task hands on that many at most."""
    return df.orderBy(*order).limit(most)


def throughput(df: DataFrame, by: list[str], samples: str = "samples", seconds: str = "seconds") -> DataFrame:
    """(by, samples_per_second, ms_per_step): a row of df is a step."""
    total = F.nullif(F.sum(seconds).cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg((F.sum(samples) / total).alias("samples_per_second"), (1000 * F.sum(seconds) / F.count("*")).alias("ms_per_step"))


def permute(df: DataFrame, key: list[str], seed: int | str = 0, name: str = "place") -> DataFrame:
    """df with a shuffled place: tables with the same keys and seed are shuffled alike."""
    return global_index(df, [seeded(seed, *key), *map(F.col, key)], name)


def resample(df: DataFrame, order: list, n: int, seed: int | str = 0) -> DataFrame:
    """n draws with replacement, numbered in ``draw``: draw i takes the row that a hash of (seed, i) points at."""
    rows = global_index(df, order, "__i")
    count = df.count()
    if not count:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw")
    hashed = F.conv(F.substring(seeded(seed, "draw"), 1, 12), 16, 10).cast("long")
    return draws.withColumn("__i", F.pmod(hashed, F.lit(count))).join(rows, "__i").drop("__i")


def shuffle_buffer(df: DataFrame, order: list, size: int, key: list[str], seed: int | str = 0, name: str = "place") -> DataFrame:
    """df in the order in which a shuffle over a moving buffer could give it out: rows are put off by less than ``size`` places, by a seeded hash."""
    late = F.pmod(F.conv(F.substring(seeded(seed, *key), 1, 12), 16, 10).cast("long"), F.lit(size))
    rows = global_index(df, order, "__i").withColumn("__at", F.col("__i") + late)
    return global_index(rows, [F.col("__at"), F.col("__i")], name).drop("__i", "__at")
