"""Lexical search that reads part of the postings: BM25 over blocks of documents with their greatest weights.

``ImpactIndex`` stores the postings of a corpus by block, a block being some documents; a term's greatest weight in a block
bounds what it adds there. A query's terms have a greatest weight each over all blocks, its cap. ``search`` finds the exact best k:

1. Each query scores, for each of its terms, the blocks where the term weighs most. The kth best score so far is a threshold
   that the final result can only raise.
2. Terms whose caps, from the smallest on, sum up to less than the threshold can't bring a document in by themselves. Only
   blocks that hold one of the other terms are looked at.
3. What a document of such a block can score at most is the sum of the block's weights of these terms and the
   caps of the rest; where that reaches the threshold, it is the sum of the block's weights of all terms. Only blocks where that does
   too are read.

A block's postings are a row of a table, so a term however frequent is split over the blocks. Queries are a table in the shared folder,
read in batches by tasks that hold some blocks: bounds and scores are products of small matrices there, and what is shuffled are
k rows for each query and group of blocks. No pair of a query and a block or a posting is a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.order import global_index
from ..functions.store import Work
from .retrieval import DEPTH, LEXICAL_DOCS, LEXICAL_QUERIES, _arrow_files, _best_columns, best

#: Documents of a block on average, and the blocks that a term is first scored in.
BLOCK_DOCS, SEEDS = 16, 2
#: Scores are rounded to so many decimals; bounds give way by more than that.
DECIMALS, SLACK = 9, 1e-6
#: Documents of a file of blocks; there are as many files as cores at least.
FILE_DOCS = 16384


class ImpactIndex:
    """blocks(block, postings of structs (term, did, w), seeds), caps(term, cap, df) of docs(did, term), a row for each word.

    ``seeds`` are the terms that weigh most in this block, or are among the SEEDS blocks where they do.
    A null term or did takes no part. ``terms`` (term), if given, are all that will be asked for; the index
    then has no other. The tables lie in the shared folder until ``clear``.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, block_docs: int = BLOCK_DOCS):
        self.work = work = Work(docs.sparkSession, "lexical")
        self.per_group = max(1, LEXICAL_DOCS // block_docs)
        docs = docs.where("did IS NOT NULL AND term IS NOT NULL")
        if terms is not None:  # words that won't be asked for are counted as one
            asked = terms.where("term IS NOT NULL").distinct().withColumn("asked", F.lit(True))
            docs = docs.select("did", "term").join(asked, "term", "left").select("did", F.when(F.col("asked"), F.col("term")).alias("term"))
        tf = work.save(docs.groupBy("did", "term").agg(F.count("*").alias("tf")), "tf")
        counted = work.save(tf.groupBy("did").agg(F.sum("tf").alias("length")), "lengths")
        tf = tf.where("term IS NOT NULL")
        self.n, average = counted.agg(F.count("*"), F.avg("length")).first()
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.ln(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(average or 1.0)))
        # Documents of like length are in one block: what a long one could score isn't held against short ones.
        placed = work.save(global_index(counted, ["length", "did"], "place", save=work.save), "placed").withColumn("block", F.floor(F.col("place") / block_docs))
        weighed = tf.join(placed, "did").join(df, "term").select("term", "block", "did", weight.alias("w"))
        files = max(docs.sparkSession.sparkContext.defaultParallelism, -(-self.n // FILE_DOCS))
        gathered = weighed.repartition(files, "block").groupBy("block").agg(F.collect_list(F.struct("term", "did", "w")).alias("postings"))
        blocks = work.save(gathered, "gathered")
        self.caps = work.save(blocks.select(F.inline("postings")).groupBy("term").agg(F.max("w").alias("cap"), F.count("*").alias("df")), "caps")
        per_group = self.per_group

        def tops(batches):
            for group in _groups(batches, per_group):
                yield _tops(group)

        place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("most").desc(), "block"))
        found = blocks.mapInArrow(tops, "term string, block long, most double").withColumn("place", place).where(F.col("place") <= SEEDS)
        self.seeds = work.save(found.groupBy("block").agg(F.collect_list("term").alias("seeds")), "seeds")
        self.blocks = blocks
        self.did = docs.schema["did"].dataType
        work.drop("tf", "lengths", "placed")

    def clear(self) -> None:
        self.work.clear()

    def scores(self, blocks: DataFrame, root: str, qid, k: int) -> DataFrame:
        """(qid, did, score, read): of blocks(block, postings, seeds), the k best documents of each group for every query of a folder, and in rows
        without a document how many postings a query read. The folder has (qid, terms, times) for the seeds alone; with
        (needed, rest, least) besides, all blocks that can reach ``least`` are scored and seeds count as read."""
        per_group = self.per_group

        def run(batches):
            for group in _groups(batches, per_group):
                yield from _group_scores(group, root, k)

        fields = [StructField("qid", qid), StructField("did", self.did), StructField("score", DoubleType()), StructField("read", LongType())]
        return blocks.select("block", "postings", "seeds").mapInArrow(run, StructType(fields))


def _groups(batches, size: int):
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def _postings(group: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """The row of its block, term, did and weight of every posting."""
    lists = group.column(1)
    terms, dids, weights = lists.flatten().flatten()
    return np.repeat(np.arange(group.num_rows), pc.list_value_length(lists).to_numpy()), terms, dids, weights.to_numpy()


def _tops(group: pa.RecordBatch) -> pa.RecordBatch:
    """(term, block, most): of each term the SEEDS blocks of a group where it weighs most."""
    row, terms, _, weight = _postings(group)
    names = terms.unique()
    block, term = group.column(0).to_numpy()[row], pc.index_in(terms, value_set=names).to_numpy()
    order = np.lexsort((-weight, block, term))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(term[order]) != 0) | (np.diff(block[order]) != 0)
    best_of = order[first]
    best_of = best_of[np.lexsort((block[best_of], -weight[best_of], term[best_of]))]
    n = np.bincount(term[best_of], minlength=len(names))
    best_of = best_of[np.arange(len(best_of)) - np.repeat(np.cumsum(n) - n, n) < SEEDS]
    return pa.RecordBatch.from_arrays([terms.take(pa.array(best_of)), pa.array(block[best_of]), pa.array(weight[best_of])], ["term", "block", "most"])


def _group_scores(group: pa.RecordBatch, root: str, k: int):
    row, terms, dids, weight = _postings(group)
    names = dids.unique()
    names = names.take(pc.sort_indices(names))  # of equal scores a place further left is a smaller id
    doc = pc.index_in(dids, value_set=names).to_numpy()
    block_of = np.zeros(len(names), int)
    block_of[doc] = row
    members = np.split(np.argsort(block_of, kind="stable"), np.cumsum(np.bincount(block_of, minlength=group.num_rows))[:-1])
    seeds = group.column(2)
    seed_row, seed_terms = np.repeat(np.arange(group.num_rows), pc.fill_null(pc.list_value_length(seeds), 0).to_numpy()), seeds.flatten()
    for asked in _arrow_files(root, LEXICAL_QUERIES):
        lists = asked.column(1).flatten()
        known = lists.unique()
        place = pc.index_in(terms, value_set=known).fill_null(-1).to_numpy()
        there = place >= 0
        if not there.any():
            continue
        # Of the queries' terms only those that the group has.
        met, column = np.unique(place[there], return_inverse=True)
        of = np.full(len(known) + 1, -1)  # the last one for terms that no query has
        of[met] = np.arange(len(met))
        documents = np.zeros((len(names), len(met)))
        documents[doc[there], column] = weight[there]
        most, n = np.zeros((2, group.num_rows, len(met)))
        np.maximum.at(most, (row[there], column), weight[there])
        np.add.at(n, (row[there], column), 1)
        seed = np.zeros((group.num_rows, len(met)))
        to = of[pc.index_in(seed_terms, value_set=known).fill_null(-1).to_numpy()]
        seed[seed_row[to >= 0], to[to >= 0]] = 1
        asks = np.repeat(np.arange(asked.num_rows), pc.list_value_length(asked.column(1)).to_numpy())
        to = of[pc.index_in(lists, value_set=known).to_numpy()]
        has = to >= 0
        wanted = np.zeros((asked.num_rows, len(met)))
        wanted[asks[has], to[has]] = asked.column(2).flatten().to_numpy()[has]
        first = (wanted > 0) @ seed.T > 0
        if asked.num_columns > 3:
            needed = wanted.copy()
            needed[asks[has], to[has]] *= asked.column(3).flatten().to_numpy(zero_copy_only=False)[has]
            rest, least = (asked.column(c).to_numpy()[:, None] for c in (4, 5))
            bound = needed @ most.T
            able = (bound > 0) & (bound + rest >= least)
            able &= wanted @ most.T >= least
        else:
            able = first
        read = (((wanted > 0) @ n.T) * (able | first)).sum(1).astype(np.int64)
        scores = np.zeros((asked.num_rows, len(names)))
        for i in np.flatnonzero(able.any(0)):
            some = np.flatnonzero(able[:, i])
            scores[np.ix_(some, members[i])] = wanted[some] @ documents[members[i]].T
        scores = np.where(scores > 0, np.round(scores, DECIMALS), -np.inf)
        columns = _best_columns(scores, k)
        found = np.take_along_axis(scores, columns, 1)
        q, c = np.nonzero(found > -np.inf)
        reads = np.flatnonzero(read)
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([asked.column(0).take(pa.array(q)), asked.column(0).take(pa.array(reads))]), pa.concat_arrays([names.take(pa.array(columns[q, c])), pa.nulls(len(reads), names.type)]),
             pa.concat_arrays([pa.array(found[q, c]), pa.nulls(len(reads), pa.float64())]), pa.concat_arrays([pa.nulls(len(q), pa.int64()), pa.array(read[reads])])],
            ["qid", "did", "score", "read"],
        )


def _needed(terms: Column, threshold: Column) -> Column:
    """Of a query's (cap, term) structs those that a document must hold one of to reach the threshold."""
    sums = F.aggregate(
        F.array_sort(terms), F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("free")),
        lambda s, t: F.when(s["sum"] + t.cap < threshold, F.struct((s["sum"] + t.cap).alias("sum"), F.concat(s.free, F.array(t.term)).alias("free"))).otherwise(F.struct(F.lit(float("inf")).alias("sum"), s.free.alias("free"))),
    )
    return F.filter(terms, lambda t: ~F.array_contains(sums.free, t.term))


def search(index: ImpactIndex, queries: DataFrame, k: int = DEPTH) -> DataFrame:
    """(qid, did, score, rank, postings, read): the best k documents of queries(qid, term), a row for each word.

    A repeated term counts as often as it comes; equal scores go by document id. ``postings`` are those of the query's
    terms, ``read`` those that were scored. Queries without a term that the index has get no rows.
    """
    work = index.work.sub("search")
    times = queries.where("term IS NOT NULL").groupBy("qid", "term").agg(F.count("*").alias("times"))
    asked = work.save(times.join(index.caps, "term").select("qid", "term", "times", (F.col("times") * F.col("cap")).alias("cap"), "df"), "asked")

    qid = asked.schema["qid"].dataType
    work.save(asked.groupBy("qid").agg(F.collect_list(F.struct("term", "times")).alias("t")).select("qid", "t.term", "t.times"), "words")
    first = index.scores(index.blocks.join(index.seeds, "block"), work.path("words"), qid, k).where("did IS NOT NULL")
    first = best(first, k).groupBy("qid").agg(F.when(F.count("*") == k, F.min("score") - SLACK).alias("least"))

    held = asked.groupBy("qid").agg(F.collect_list(F.struct("cap", "term", "times")).alias("terms"), F.sum("df").alias("postings"))
    held = held.join(first, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    held = held.withColumn("needed", _needed(F.col("terms"), F.col("least")))
    rest = F.aggregate("terms", F.lit(0.0), lambda s, t: s + t.cap) - F.aggregate("needed", F.lit(0.0), lambda s, t: s + t.cap)
    free = F.transform("terms", lambda t: F.array_contains(F.transform("needed", lambda x: x.term), t.term))
    held = work.save(held.select("qid", "terms.term", "terms.times", free.alias("needed"), rest.alias("rest"), "least", "postings"), "held")

    found = work.save(index.scores(index.blocks.join(index.seeds, "block", "left"), work.path("held"), qid, k), "found")
    run = best(found.where("did IS NOT NULL").select("qid", "did", "score"), k)
    read = found.groupBy("qid").agg(F.sum("read").alias("read"))
    return run.join(held.select("qid", "postings"), "qid").join(read, "qid").select("qid", "did", "score", "rank", "postings", "read")
