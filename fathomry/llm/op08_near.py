"""Near-duplicate documents: MinHash with tensored banding, links confirmed on full sets.

A document's set is its distinct word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``; a component is what links reach.

1. Documents with equal sets form a class (128-bit fingerprint of the sorted set); only the
   class's smallest doc_id goes on, so copies are never paired with each other.
2. Two collections of ``SIDE`` groups of ``GROUP`` minhashes each are computed. Every pair of
   one group from either collection is a table: SIDE * SIDE tables of 2 * GROUP hashes cost
   2 * SIDE * GROUP minhashes instead of SIDE * SIDE * 2 * GROUP. At similarity 0.8 a pair
   meets in some table with probability (1 - (1 - 0.8^GROUP)^SIDE)^2 = 0.9985, at 0.85 in
   0.9999.
3. In each bucket (documents with one table key) every document is compared with the
   bucket's smallest, its leader. That joins nearly all of a group of near copies. Leaders are
   an aggregate, combined before its shuffle, and a bucket's documents meet theirs in a join
   of two written tables, whose partitions adaptive execution splits: no bucket is one task's.
4. Documents that met under one leader and are in different components by then may still
   link with each other. One of such a pair is outside the leader's most frequent component,
   so those outside are compared with everything under the leader: both sides are dealt into
   blocks of bounded size, a task compares two blocks, and only what is found leaves it. That is
   quadratic in a bucket of documents that share boilerplate but aren't alike: in comparisons of
   60 numbers, and beyond ``BLOCKS`` blocks of the largest size also in rows sent. Whoever has
   a partner left goes on to be compared on full sets, in blocks of ``OUTSIDE`` by ``MEMBERS`` documents
   and about ``BLOCK_SHINGLES`` shingles.
   Then nothing is untested.
5. A pair whose minhashes agree in fewer than ``least_agree`` of ``2 * SIDE * GROUP`` places
   can't reasonably have similarity 0.8 (odds below 1e-6) and is left; the rest are confirmed on
   their full sets of 64-bit shingle hashes. With ``least_agree=0`` every pair that meets in a
   table is confirmed, so what remains of chance is whether a pair meets.

Defined results: without words or with null text a document has an empty set and links with
nothing. Repeated rows share a component; rows that share a doc_id but not a text are linked
each as its text is. A row without doc_id can't be named: it links
with nothing, its component_id is null and it is kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.order import global_index
from ._arrow import bound_batches, with_bytes
from ._columns import apart
from ._graph import connected_components
from ._shingles import Shingler
from ._work import Work

WORDS, PERCENT = 5, 80
SIDE, GROUP = 10, 3
LEAST_AGREE = 32
#: Documents of a block, on average, that are compared by minhashes (240 bytes each): at least, and at most. Between
#: the two it grows so that there are BLOCKS blocks, and no document is sent to more tasks than that.
BLOCK, BLOCKS = (512, 8192), 64
#: The same for full sets, which long documents make large: those outside the leader's component, and all under it.
OUTSIDE, MEMBERS = (128, 256), (256, 512)
#: Shingles of a block of full sets, 8 bytes each: where documents are long, blocks have fewer of them.
BLOCK_SHINGLES = 1 << 20
#: Ids that a broadcast may hold (16 bytes each); beyond it the same join shuffles.
BROADCAST_IDS = 1_000_000

_SEEDS = np.random.default_rng(20_240_607).integers(1, 1 << 63, (2, 2 * SIDE * GROUP), dtype=np.uint64)
_A, _B = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """2 * SIDE * GROUP minhashes of 32 bits."""
    best = np.full(len(_A), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 8192):
            part = shingles[i : i + 8192]
            np.minimum(best, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, lefts, rights, hashes) of every document."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                s = shingler(text)
                f = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                m = minhashes(s) if len(s) else np.zeros(0, np.uint32)
                groups = [xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63) for g in m.reshape(-1, GROUP)]
                out.append((len(s), int(f[0]), int(f[1]), groups[:SIDE], groups[SIDE:], m.view(np.int32)))
            columns = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_shingles", "f1", "f2", "lefts", "rights", "hashes"])

    bound_batches(docs.sparkSession)
    return with_bytes(docs).mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, lefts array<long>, rights array<long>, hashes array<int>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): the sorted set as bytes."""

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["rep", "shingles"])

    return with_bytes(docs).mapInArrow(run, "rep long, shingles binary")


def similar(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _sets_of(work: Work, docs: DataFrame, ids: DataFrame, most: int, words: int, tag: str) -> DataFrame:
    """(rep, shingles) of the documents with these ids (doc_id), at most so many, written."""
    wanted = F.broadcast(ids) if most <= BROADCAST_IDS else ids
    return work.save(shingle_sets(docs.join(wanted, "doc_id", "left_semi"), words), f"{tag}-sets")


def _confirm(work: Work, docs: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, percent: int, least_agree: int) -> DataFrame:
    """The links (a, b) among the written pairs of reps, written."""
    one, other = (reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")) for c in "ab")
    agree = F.aggregate(F.zip_with("h_a", "h_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = pairs.join(one, "a").join(other, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).where(agree >= least_agree)
    close = work.save(close.select("a", "b"), "close", rows=pairs.count())
    n = close.count()
    sets = _sets_of(work, docs, close.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), 2 * n, words, "first")
    full = close.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b")

    def confirm(batches):
        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("s_a", "s_b"))
            keep = pa.array([similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in "ab"], ["a", "b"]).filter(keep)

    links = work.save(full.select("a", "b", "s_a", "s_b").mapInArrow(confirm, "a long, b long"), "links")
    work.drop("close", "first-sets")
    return links


def _by_group(batches, keys: list[str]):
    """Tables of the rows with one key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.any([np.r_[True, c[1:] != c[:-1]] for c in columns], axis=0))
        for start, end in zip(starts, np.r_[starts[1:], batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)


_KEYS = ["leader", "ub", "mb"]


def _block_size(bounds: tuple[int, int]) -> Column:
    return F.least(F.lit(bounds[1]), F.greatest(F.lit(bounds[0]), F.ceil(F.col("n_all") / BLOCKS)))


def _blocks(members: DataFrame, payload: DataFrame, outside: tuple[int, int], block: tuple[int, int]) -> DataFrame:
    """members(leader, rep, label, outside, n_out, n_all, s_out, s_all) as the rows of block pairs, sorted by block pair."""
    outs, alls = (F.ceil(F.greatest(F.col(f"n_{c}") / _block_size(size), F.col(f"s_{c}") / BLOCK_SHINGLES)).cast("int") for c, size in (("out", outside), ("all", block)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    fields = ["leader", "rep", "label"]
    left = members.where("outside").select(*fields, F.lit(True).alias("asks"), dealt(outs, 1).alias("ub"), F.explode(F.sequence(F.lit(0), alls - 1)).alias("mb"))
    right = members.select(*fields, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), outs - 1)).alias("ub"), dealt(alls, 2).alias("mb"))
    return left.union(right).join(payload, "rep").repartition(*_KEYS).sortWithinPartitions(*_KEYS)


def _counted(work: Work, members: DataFrame, tag: str) -> DataFrame:
    """members(leader, rep, label, n_shingles) of the leaders that still have several labels, with the blocks' sizes, written.

    ``n_`` counts documents and ``s_`` their shingles (0 where members don't have them), of all and of those outside the main label.
    """
    n = members.count()
    sized = members if "n_shingles" in members.columns else members.withColumn("n_shingles", F.lit(0).cast("long"))
    by_label = sized.groupBy("leader", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    by_leader = by_label.groupBy("leader").agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"), F.max(F.struct("n", "label", "s")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    by_leader = by_leader.select("leader", "n_all", "s_all", (F.col("n_all") - F.col("most.n")).alias("n_out"), (F.col("s_all") - F.col("most.s")).alias("s_out"), F.col("most.label").alias("main"))
    by_leader = work.save(by_leader, f"{tag}-leaders", rows=n // 2)
    found = members.join(by_leader, "leader").select("leader", "rep", "label", "n_all", "n_out", "s_all", "s_out", (F.col("label") != F.col("main")).alias("outside"))
    return work.save(found, f"{tag}-counted", rows=n)


def _late_links(work: Work, docs: DataFrame, reps: DataFrame, members: DataFrame, words: int, percent: int, least_agree: int) -> DataFrame:
    """Links between different labels among the written members(leader, rep, label); at least one for each two labels that link, written."""

    def candidates(batches):
        """Members with a partner that their minhashes don't rule out."""
        for t in _by_group(batches, _KEYS):
            h = np.array(t.column("hashes").combine_chunks().flatten()).reshape(t.num_rows, -1)
            asks, n, label = (t.column(c).to_numpy() for c in ("asks", "n_shingles", "label"))
            u, m = np.flatnonzero(asks), np.flatnonzero(~asks)
            near = np.zeros(t.num_rows, bool)
            for i in u:
                can = m[(label[m] != label[i]) & (100 * np.minimum(n[m], n[i]) >= percent * np.maximum(n[m], n[i]))]
                hit = can[(h[can] == h[i]).sum(1) >= least_agree]
                near[hit] = True
                near[i] |= len(hit) > 0
            if near.any():
                yield t.select(["leader", "rep", "label", "n_shingles"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    def confirm(batches):
        for t in _by_group(batches, _KEYS):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles").combine_chunks()]
            asks, rep, label = (t.column(c).to_numpy() for c in ("asks", "rep", "label"))
            u, m = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(u) or not len(m):
                continue
            # Every shingle of the asking block with its owner, sorted: a member finds its overlap with all at once.
            flat, owner = np.concatenate([sets[i] for i in u]), np.repeat(np.arange(len(u)), [len(sets[i]) for i in u])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            size = np.array([len(sets[i]) for i in u])
            seen, a, b = set(), [], []
            for j in m:
                low, high = np.searchsorted(flat, sets[j], "left"), np.searchsorted(flat, sets[j], "right")
                counts = high - low
                at = np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                common = np.bincount(owner[at], minlength=len(u))
                for i in np.flatnonzero((100 * common >= percent * (size + len(sets[j]) - common)) & (label[u] != label[j])):
                    two = (label[u[i]], label[j])
                    if two not in seen:  # one link joins two components
                        seen.add(two)
                        a.append(rep[u[i]])
                        b.append(rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    counted = _counted(work, members, "late")
    n = counted.count()
    if not n:
        return work.spark.createDataFrame([], "a long, b long")
    left = _blocks(counted, reps.select("rep", "n_shingles", "hashes"), BLOCK, BLOCK).mapInArrow(candidates, "leader long, rep long, label long, n_shingles long")
    counted = _counted(work, work.save(left.distinct(), "late-members", rows=n), "left")
    sets = _sets_of(work, docs, counted.select(F.col("rep").alias("doc_id")).distinct(), counted.count(), words, "late")
    links = work.save(_blocks(counted, sets, OUTSIDE, MEMBERS).mapInArrow(confirm, "a long, b long").distinct(), "late-links", rows=n)
    work.drop("late-leaders", "late-counted", "late-members", "left-leaders", "left-counted", "late-sets")
    return links


def components(work: Work, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, least_agree: int = LEAST_AGREE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    work, docs = work.sub("components"), docs.select(F.col("doc_id").cast("long"), "text")
    sketches = work.save(sketch(docs, words), "sketches")
    whole = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    copies = whole.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = work.save(copies, "copies", rows=sketches.count() // 2)
    reps = whole.join(copies, ["f1", "f2"], "left").where("rep IS NULL OR rep = doc_id")
    reps = work.save(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "lefts", "rights", "hashes"), "reps")

    tables = reps.select("rep", "rights", F.posexplode("lefts").alias("i", "left")).select("rep", "i", "left", F.posexplode("rights").alias("j", "right"))
    keyed = tables.select("rep", F.xxhash64("i", "j", "left", "right").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count("*").alias("n")).where("leader <> last").drop("last")
    shared = work.save(shared, "shared")
    met = keyed.join(shared.select("key", "leader"), "key").where("rep <> leader").select("leader", "rep").distinct()
    met = work.save(met, "met", rows=shared.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    work.drop("shared")

    links = _confirm(work, docs, reps, met.select(F.col("rep").alias("a"), F.col("leader").alias("b")), words, percent, least_agree)
    labels = connected_components(work, links, "labels", links.count())
    label = F.coalesce("label", "rep").alias("label")
    members = met.union(met.select("leader", F.col("leader").alias("rep")).distinct()).join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("leader", "rep", label)
    late = _late_links(work, docs, reps, work.save(members, "members", rows=2 * met.count()), words, percent, least_agree)
    # Components of components: the labels that late links join.
    named = labels.select(F.col("node").alias("rep"), F.col("label"))
    joined = late.join(named.select(F.col("rep").alias("a"), F.col("label").alias("la")), "a", "left").join(named.select(F.col("rep").alias("b"), F.col("label").alias("lb")), "b", "left")
    joined = joined.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = connected_components(work, joined, "merged", late.count()).select(F.col("node").alias("label"), F.col("label").alias("beyond"))
    alone = merged.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti")
    found = labels.unionByName(alone).join(merged, "label", "left").select("node", F.coalesce("beyond", "label").alias("component_id"))
    found = work.save(found, "components", rows=labels.count() + merged.count())
    work.keep("sketches", "copies", "components")

    rep = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    classed = sketches.select("doc_id", "n_shingles", "f1", "f2").join(copies, ["f1", "f2"], "left").select("doc_id", "n_shingles", rep.alias("node"))
    out = classed.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(work: Work, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id, one row a doc_id and text.

    Texts that share a doc_id are documents of their own, in the order of a hash of the text.
    """
    docs, back = apart(docs, "doc_id", "text")
    again = work.save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return back(_without_copies(work, docs, "doc_id", words, percent))
    named = docs.where("doc_id IS NOT NULL")
    once = named.join(again, "doc_id", "left_anti").select(docs.columns).union(named.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    rows = work.save(global_index(once, order, "__row", save=work.save), "rows")
    return back(_without_copies(work, rows, "__row", words, percent).select(docs.columns).union(docs.where("doc_id IS NULL")))


def _without_copies(work: Work, docs: DataFrame, key: str, words: int, percent: int) -> DataFrame:
    """docs without the rows whose component has a smaller key."""
    found = components(work, docs.select(F.col(key).alias("doc_id"), "text"), words, percent).where("NOT kept")
    gone = work.save(found.select(F.col("doc_id").alias(key)).distinct(), "gone")
    wanted = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(wanted, key, "left_anti").select(docs.columns)
