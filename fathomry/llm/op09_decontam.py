"""Benchmark decontamination over a positional inverted index; Spark expressions only.

``build_postings`` stores (token, doc_id, pos) of every training token that some benchmark
item uses: a list for any other token could never be asked for. From the index come the
collection frequencies of all terms over all documents. Each window of ``WINDOW``
consecutive item words is looked up by its two rarest terms; their postings, shifted by
their offsets in the item, are intersected, which leaves the places where the item could
stand. Windows next to each other mostly share those terms, so a passage in a document
yields a few places, not one for each window. Every place is then compared word by word, and the windows that stand there in full
mark the document's words.

From the same index, ``near_items`` finds where the rarest terms of an item stand close together,
and ``proximity`` does so for any terms, intersecting lists from the rarest on with a slack instead of
an offset. The query and the pipeline ask for exact windows only.

Defined results: null or word-less texts have no words, hits or items; an item of fewer
than ``WINDOW`` words is one window, one without words none; rows that share an item_id are
one item; a null item_id takes part in the hits but isn't listed. Repeated documents get a
row each. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._columns import apart
from ._words import n_words, words
from ._work import Work

WINDOW = 10
#: Rows that a broadcast side may have, and bytes of their texts; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its rows and the bytes of their texts and words allow."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"] + [F.octet_length(F.array_join(c, " ")) for c, kind in df.dtypes if kind == "array<string>"]
    size = sum((F.coalesce(x, F.lit(0)).cast("long") for x in texts), F.lit(0).cast("long"))
    rows, held = df.agg(F.count("*"), F.sum(size)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else df


def item_table(work: Work, benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_words): item is a key of the words, so equal texts are one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("item_words")).where(F.size("item_words") > 0)
    return work.save(rows.groupBy("item_words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).withColumn("item", F.sha2(F.array_join("item_words", " "), 256)), "items", rows=benchmark.count())


def build_postings(work: Work, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index, written: (token, doc_id, pos) for the given terms (token)."""
    tokens = docs.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "token"))
    return work.save(tokens.join(_small(terms), "token", "left_semi").select("token", "doc_id", "pos"), "postings")


def _anchors(items: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(token, item, n, anchor): for each window that can occur, its two rarest terms' places in the item."""
    at = items.select("item", F.posexplode("item_words").alias("at", "token")).join(frequency, "token", "left")
    terms = F.array_sort(F.collect_list(F.struct("at", F.coalesce("cf", F.lit(0)).alias("cf"), "token")))
    by_item = at.groupBy("item").agg(terms.alias("terms")).withColumn("n", F.size("terms"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - window, F.lit(0)))
    rarest = F.transform(starts, lambda s: F.slice(F.array_sort(F.transform(F.slice("terms", s + 1, window), lambda t: F.struct(t.cf.alias("cf"), t["at"].alias("at"), t.token.alias("token")))), 1, 2))
    possible = F.flatten(F.filter(rarest, lambda pair: F.get(pair, F.lit(0)).cf > 0))
    found = by_item.select("item", "n", F.explode(F.array_distinct(possible)).alias("a"))
    return found.select(F.col("a.token").alias("token"), "item", "n", F.col("a.at").alias("anchor"))


def _hits(docs: DataFrame, places: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, hit positions, item_ids) of each place where windows stand in full."""
    near = docs.select("doc_id", "text").join(places.withColumnRenamed("doc_id", "p_doc_id"), F.col("doc_id").eqNullSafe(F.col("p_doc_id")))
    near = near.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"), "places")
    cut = F.transform("places", lambda p: F.struct(p.item.alias("item"), p.offset.alias("offset"), F.slice("w", F.greatest(p.offset, F.lit(0)) + 1, p.n + F.least(p.offset, F.lit(0))).alias("part")))
    each = near.select("doc_id", "text_hash", F.explode(cut).alias("c")).select("doc_id", "text_hash", "c.*").join(items, "item")
    skip = F.greatest(-F.col("offset"), F.lit(0))
    size = F.least(F.lit(window), F.size("item_words"))
    starts = F.filter(F.sequence(F.lit(0), F.size("item_words") - size), lambda s: (s >= skip) & (F.slice("part", F.greatest(s - skip, F.lit(0)) + 1, size) == F.slice("item_words", s + 1, size)))
    found = each.select("doc_id", "text_hash", "offset", "item_ids", size.alias("size"), starts.alias("starts")).where(F.size("starts") > 0)
    spans = F.flatten(F.transform("starts", lambda s: F.sequence(F.col("offset") + s, F.col("offset") + s + F.col("size") - 1)))
    return found.select("doc_id", "text_hash", F.array_distinct(spans).alias("hit"), "item_ids")


class Index:
    """The stored index of a corpus for a benchmark: items, postings (token, doc_id, pos) and the terms' frequencies."""

    def __init__(self, work: Work, docs: DataFrame, benchmark: DataFrame):
        self.items = item_table(work, benchmark)
        self.n_words = self.items.agg(F.sum(F.size("item_words"))).first()[0] or 0
        terms = work.save(self.items.select(F.explode("item_words").alias("token")).distinct(), "terms", rows=self.n_words)
        self.postings = build_postings(work, docs, terms)
        self.frequency = work.save(self.postings.groupBy("token").agg(F.count("*").alias("cf")), "frequency", rows=self.n_words)


def contamination(work: Work, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, index: Index | None = None) -> DataFrame:
    """(doc_id, text_hash, n_hit, item_ids) of the documents in which a window occurs, written.

    A given index of these documents is used and kept; otherwise one is built and deleted.
    """
    found = index or Index(work, docs, benchmark)
    items, postings, frequency, n_words = found.items, found.postings, found.frequency, found.n_words
    anchors = work.save(_anchors(items, frequency, window), "anchors", rows=2 * n_words)
    at = postings.join(_small(anchors), "token").select("doc_id", "item", "n", (F.col("pos") - F.col("anchor")).alias("offset"))
    both = at.groupBy("doc_id", "item", "n", "offset").agg(F.count("*").alias("terms")).where("terms >= 2 OR n = 1")
    places = work.save(both.groupBy("doc_id").agg(F.collect_list(F.struct("item", "n", "offset")).alias("places")), "places")
    rows, n = places.agg(F.sum(F.size("places")), F.count("*")).first()
    rows = rows or 0
    hits = _hits(docs, F.broadcast(places) if rows <= BROADCAST_ROWS else places, _small(items), window)
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    found = work.save(by_doc, "found", rows=n)
    work.drop("anchors", "places", *(() if index else ("items", "terms", "postings", "frequency")))
    return found


def report(work: Work, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, contaminated) for every document."""
    found = contamination(work, docs, benchmark, window).withColumnRenamed("doc_id", "f_doc_id")
    base = docs.select("doc_id", n_words(F.col("text")).alias("n_words"), F.xxhash64("text").alias("h"))
    joined = base.join(found, F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("h") == F.col("text_hash")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids")).withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(work: Work, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those in which a window occurs."""
    found = contamination(work, docs, benchmark, window).select(F.col("doc_id").alias("__doc_id"), F.col("text_hash").alias("__hash"))
    narrow, back = apart(docs, "doc_id", "text")
    return back(narrow.join(_small(found), F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__hash")), "left_anti"))


def near_items(work: Work, index: Index, terms: int = 3, slack: int = WINDOW) -> DataFrame:
    """(doc_id, item_ids, places): where an item's rarest terms stand close together, whatever stands between.

    Of each item the ``terms`` rarest different words are looked up (all, if it has fewer); a place
    is one of the rarest with every other at most ``slack`` words away. An item with a word that no
    document has at all among them isn't found. Texts that share a doc_id are taken as one here.
    """
    words_of = index.items.select("item", F.explode(F.array_distinct("item_words")).alias("token")).join(index.frequency, "token", "left")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("cf", F.lit(0)), "token"))
    picked = words_of.withColumn("place", place).where(F.col("place") <= terms)
    need = picked.groupBy("item").agg(F.count("*").alias("need"), F.min(F.coalesce("cf", F.lit(0))).alias("least")).where("least > 0").select("item", "need")
    picked = work.save(picked.join(need, "item").select("token", "item", "place", "need"), "picked", rows=index.n_words)
    at = index.postings.join(_small(picked), "token")
    by = at.groupBy("doc_id", "item", "need").agg(F.count_if(F.col("place") == 1).alias("first"), F.collect_list(F.struct("place", "pos")).alias("at")).where("first > 0")
    of = lambda k: F.filter("at", lambda x: x.place == k)
    close = lambda p: F.forall(F.sequence(F.lit(1), F.col("need").cast("int")), lambda k: F.exists(of(k), lambda x: F.abs(x.pos - p) <= slack))
    found = by.select("doc_id", "item", F.size(F.filter(F.transform(of(F.lit(1)), lambda x: x.pos), close)).alias("places")).where("places > 0")
    named = found.join(index.items.select("item", "item_ids"), "item")
    return named.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sum("places").alias("places"))


def proximity(postings: DataFrame, terms: list[str], slack: int) -> DataFrame:
    """(doc_id, pos) where the rarest of the terms stands with every other term at most slack words away."""
    wanted = sorted(set(terms))
    count = {r.token: r.n for r in postings.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count("*").alias("n")).collect()}
    first, *rest = sorted(wanted, key=lambda t: (count.get(t, 0), t))
    found = postings.where(F.col("token") == first).select("doc_id", "pos")
    for term in rest:
        other = postings.where(F.col("token") == term).select(F.col("doc_id").alias("o_doc_id"), F.col("pos").alias("o_pos"))
        found = found.join(other, F.col("doc_id").eqNullSafe(F.col("o_doc_id")) & (F.abs(F.col("pos") - F.col("o_pos")) <= slack), "left_semi")
    return found
