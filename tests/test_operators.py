"""Invariants and small cases of the row operators, batching, search and streams."""

import json
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.functions import store, text as T, vectors as V, vision as I
from fathomry.functions.order import global_index
from fathomry.operators import batching as B, contrastive as C, lexical as X, retrieval as R, rows as O
from fathomry.plans.prep import EXAMPLES
from fathomry.streaming import flows


def test_batches_are_full_and_free_of_conflicts(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 900, 7).otherwise(F.col("id") % 400).alias("key"))
    rows = B.allocate(df, "key", ["id"], 128).groupBy("batch_id").agg(F.count("*").alias("n"), F.countDistinct("key").alias("k")).collect()
    assert rows and all((r.n, r.k) == (128, 128) for r in rows)


def test_allocate_without_a_full_batch_is_empty(spark):
    assert B.allocate(spark.range(100).withColumn("key", F.lit(1)), "key", ["id"], 128).count() == 0


def test_batches_do_not_depend_on_input_order(spark):
    df = spark.range(1000).withColumn("key", F.col("id") % 90)
    a = {(r.id, r.batch_id) for r in B.allocate(df, "key", ["id"], 64).collect()}
    assert a == {(r.id, r.batch_id) for r in B.allocate(df.orderBy(F.desc("id")), "key", ["id"], 64).collect()}


def test_global_index_is_dense(spark):
    got = global_index(spark.range(1000), [F.desc("id")], "i", 7).collect()
    assert all(r.i == 999 - r.id for r in got) and len(got) == 1000


def test_splits_are_disjoint(spark):
    got = O.split_bands(spark.range(100), [30, 20], ["id"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {0: 30, 1: 20}
    with pytest.raises(ValueError):
        O.sample_n(spark.range(5), 6, ["id"], exact=True)


def test_search_equals_numpy_in_any_blocks(spark):
    x = np.random.default_rng(0).normal(size=(60, 5))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [float("nan")] * 5)]
    q = spark.createDataFrame(rows, "qid long, embedding array<double>")
    got = R.search(q, q.withColumnRenamed("qid", "did"), 3, exclude_self=True, block=7)
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = {(i, int(j), r + 1) for i in range(60) for r, j in enumerate(np.argsort(-s[i])[:3])}
    assert {(r.qid, r.did, r["rank"]) for r in got.collect()} == want


def test_merge_keeps_the_first_list(spark):
    rows = spark.createDataFrame([(1, 5, 0.2, 0), (1, 5, 0.9, 1), (1, 6, 0.5, 1)], "qid int, did int, score double, shard int")
    assert [(r.did, r.score) for r in R.merge(rows, 5).orderBy("rank").collect()] == [(6, 0.5), (5, 0.2)]


def test_validator_reasons(spark):
    df = spark.createDataFrame([(x, e or "") for x, e in EXAMPLES], "line string, want string")
    for r in df.select("line", "want", O.example_error(F.col("line")).alias("got")).collect():
        assert (r.got or "") == r.want, r.line


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.wrap(F.lit("aa bb cccccc d"), 5)) == ["aa", "bb", "cccccc", "d"]
    assert one(T.wrap(F.lit("aa bb cccccc d"), 6)) == ["aa bb", "cccccc", "d"]
    assert one(T.wrap(F.lit("cccccc"), 6)) == ["", "cccccc"]
    assert one(T.brace_json(F.lit("x } {"))) is None
    assert one(T.fenced_json(F.lit("no"))) is None
    assert one(T.leading_int(F.lit("12a"))) == 12 and one(T.leading_int(F.lit("a"))) == float("inf")
    assert T.glob_regex("a*[!b]?.x") == r"^(?s:a.*[^b].\.x)$"
    df = spark.createDataFrame([("<b>", "v")], "a string, b string")
    assert df.select(T.fill_template(df, "<a> <b>").alias("x")).first().x == "v v"
    with pytest.raises(ValueError):
        T.fill_template(df, "<zzz>")
    with pytest.raises(Exception, match="none of the id fields"):
        no = spark.createDataFrame([(None,)], "id string")
        no.select(T.doc_key(no)).collect()


def test_vectors(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(V.l2_normalize(v)) == pytest.approx([0.6, 0.8])
    assert sum(one(V.softmax(v))) == pytest.approx(1)
    assert one(V.cross_entropy(v, F.lit(1))) == pytest.approx(np.log(1 + np.exp(-1)))
    assert one(V.one_hot(F.lit(1), 2, 0.2)) == pytest.approx([0.1, 0.9])
    assert one(V.js_divergence(F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.5), F.lit(0.5)))) == pytest.approx(0)
    assert one(V.has_nan(F.array(F.lit(1.0), F.lit(float("nan"))))) is True


def test_slice_grid_small_image_needs_none(spark):
    one = lambda w, h: spark.range(1).select(I.slice_grid(F.lit(w), F.lit(h)).alias("g")).first().g
    assert one(300, 300) is None
    assert tuple(one(2000, 500)) == (4, 1)


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"id": "1", "text": "x"}\n{"id": "2", "text": "y"}\n')
    done = str(tmp_path / "done")
    stream = lambda: flows.stream_jsonl(spark, str(src), "id string, text string")
    run = lambda: flows.resume(stream(), done, lambda df: df.withColumn("n", F.length("text")), "id", str(tmp_path / "cp")).start().awaitTermination()
    run()
    (src / "b.json").write_text('{"id": "2", "text": "again"}\n{"id": "3", "text": "zz"}\n')
    run()
    assert {(r.id, r.n) for r in spark.read.parquet(done).collect()} == {("1", 1), ("2", 1), ("3", 2)}


def test_retries_report_instead_of_failing(spark):
    def call(row):
        if row["id"] == "2":
            raise ValueError("no")
        return "ok"

    got = {r.id: (r.response, r.error) for r in flows.respond(spark.createDataFrame([("1",), ("2",)], "id string"), call, 3).collect()}
    assert got["1"] == ("ok", None) and got["2"][1] == "ValueError: no"


def test_encoder_is_deterministic(spark):
    df = spark.createDataFrame([("1", "a b"), ("2", "a b")], "id string, text string")
    a, b = (r.embedding for r in flows.encode(df, flows.hash_encoder(8)).orderBy("id").collect())
    assert a == b and sum(x * x for x in a) == pytest.approx(1, abs=1e-5)


def test_running_top_k_over_shards(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"qid": 1, "did": 5, "score": 0.5}\n{"qid": 1, "did": 6, "score": 0.7}\n{"qid": 2, "did": 6, "score": 0.1}\n')
    (src / "b.json").write_text('{"qid": 1, "did": 7, "score": 0.6}\n{"qid": 1, "did": 6, "score": 0.2}\n')
    stream = flows.stream_jsonl(spark, str(src), "qid long, did long, score double", max_files=1)
    q = flows.running_top_k(stream, 2).writeStream.outputMode("update").format("memory").queryName("best").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    assert {(1, 6, 0.7, 1), (1, 7, 0.6, 2), (2, 6, 0.1, 1)} <= {tuple(r) for r in spark.table("best").collect()}


def test_running_top_k_of_many_queries_has_few_states(spark, tmp_path):
    """Queries share states, 16 here for 3,000 and one for rows without a query; what comes later finds what was kept."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    rows = [(q, d, float((q * 7 + d * 5) % 11)) for q in range(3000) for d in range(4)] + [(None, d, float(d)) for d in range(4)]
    for part in (0, 1):
        (src / f"{part}.json").write_text("".join(json.dumps({"qid": q, "did": d, "score": s}) + "\n" for q, d, s in rows if d % 2 == part))
    stream = flows.stream_jsonl(spark, str(src), "qid long, did long, score double", max_files=1)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    write = lambda batch, number: batch.write.parquet(f"{out}/batch={number}")
    q = flows.running_top_k(stream, 3, buckets=16).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(x.numRowsTotal for x in q.lastProgress.stateOperators) == 17
    got = {(r.qid, r.did, r["rank"]) for r in spark.read.parquet(f"{out}/batch=1").collect()}
    by = {}
    for q, d, s in rows:
        by.setdefault(q, []).append((-s, d))
    assert got == {(q, d, i) for q, x in by.items() for i, (_, d) in enumerate(sorted(x)[:3], 1)}


def test_variable_chunks_of_a_long_document(spark):
    """Lengths are drawn for every chunk: a document of 7,000 pages (over one block) has no cycle."""
    import hashlib

    pages = [("a", p) for p in range(7000)] + [("b", p) for p in range(3)] + [(None, 5)]
    df = spark.createDataFrame(pages, "doc string, page int").repartition(5)
    got = {(r.doc, r.page): r.chunk for r in O.variable_chunks(df, "doc", "page").collect()}
    for doc, n in (("a", 7000), ("b", 3), (None, 1)):
        place, chunk, want = 0, 0, []
        while place < n:
            u = int(hashlib.md5("|".join(["0", *([doc] if doc else []), str(chunk)]).encode()).hexdigest()[:8], 16) / 2**32
            size = 4 if u < 0.2 else 5 if u < 0.5 else 6
            want += [chunk] * min(size, n - place)
            place, chunk = place + size, chunk + 1
        assert [got[doc, p if doc else 5] for p in range(n)] == want
    assert len(got) == len(pages)


def test_cumulative_split_over_many_ranges(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("n"))
    got = {r.id: r.split for r in O.cumulative_split(df, "n", [50, 400], [F.col("id")], partitions=9).collect()}
    before, want = 0, {}
    for i in range(500):
        if before < 400:
            want[i] = 0 if before < 50 else 1
        before += i % 7
    assert got == want


def test_search_in_small_blocks_equals_brute_force(spark):
    """Blocks of a few vectors, equal scores, equal ids on both sides, and vectors that take no part."""
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, (90, 4)).astype(float)
    x[40:60] = x[3]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(200, None), (201, [float("nan")] * 4), (202, [None] * 4)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries, corpus = df.withColumnRenamed("id", "qid").where("qid % 2 = 0"), df.withColumnRenamed("id", "did")
    for own in (False, True):
        got = {(r.qid, r.rank): r.did for r in R.search(queries, corpus, 6, own, block=5, corpus_block=7).collect()}
        want = {}
        for q in range(0, 90, 2):
            best = sorted((-float(sum(a * b for a, b in zip(x[q], x[d]))), d) for d in range(90) if not (own and d == q))
            scores = sorted((round(s, 9), d) for s, d in best)[:6]
            want |= {(q, r + 1): d for r, (_, d) in enumerate(scores)}
        assert got == want
    assert R.search(queries.limit(0), corpus, 3).count() == 0 and R.search(queries, corpus.limit(0), 3).count() == 0


def test_search_hands_on_k_rows_a_query_and_task(spark, monkeypatch):
    """Lists run through all of a task's blocks; equal scores are cut by id, whichever block they come in."""
    x = np.random.default_rng(4).integers(-3, 4, (600, 3)).astype(float)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    queries, corpus = df.where("id < 50").withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "did")
    want = {(q, r + 1): d for q in range(50) for r, (_, d) in enumerate(sorted((-float(x[q] @ x[d]), d) for d in range(600))[:5])}
    assert {(r.qid, r.rank): r.did for r in R.search(queries, corpus, 5, block=16, corpus_block=10).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(R, "best", lambda run, k: run)
        tasks = corpus.rdd.getNumPartitions()
        assert R.search(queries, corpus, 5, block=16, corpus_block=10).count() == 50 * 5 * tasks
        parts = R.search(queries, corpus, 5, block=16, corpus_block=10, held_bytes=3 * 8 * 80).count() / (50 * 5)  # each partition in two
        assert tasks < parts <= 3 * tasks
    assert {(r.qid, r.rank): r.did for r in R.search(queries, corpus, 5, block=16, corpus_block=10, held_bytes=3 * 8 * 80).collect()} == want


def test_full_lists_gather_only_scores_that_reach_them(monkeypatch):
    """Whole rows are searched until the lists are full; later blocks give what reaches a list's last score. Equal scores, equal ids, own ids, rising scores."""
    rng, sought = np.random.default_rng(8), []
    best_columns = R._best_columns
    monkeypatch.setattr(R, "_best_columns", lambda scores, keep: (sought.append(scores.size), best_columns(scores, keep))[1])
    dids = np.sort(np.concatenate([np.arange(1990), np.full(10, 700)]))
    qids = np.arange(0, 2000, 100)
    for kind, searched in (("any", 1), ("equal", 1), ("rising", 20)):
        whole = {"any": rng.normal(size=(20, 2000)), "equal": rng.integers(0, 40, (20, 2000)).astype(float), "rising": np.arange(2000.0) + rng.normal(size=(20, 1))}[kind]
        sought.clear()
        lists = R.Lists(qids, 5)
        for at in rng.permutation(20) * 100 if kind != "rising" else range(0, 2000, 100):
            lists.offer(dids[at : at + 100], whole[:, at : at + 100].copy(), own=False)
        for i, q in enumerate(qids):
            want = sorted((-s, d) for s, d in zip(whole[i], dids) if d != q)[:5]
            assert list(zip(-lists.scores[i], lists.dids[i])) == want
        assert sum(sought) <= searched * 20 * 100, kind


@pytest.mark.parametrize("held_bytes", [1 << 20, 4 * 8 * 20, 4 * 8 * 31])
def test_self_search_equals_search(spark, held_bytes):
    x = np.random.default_rng(5).integers(-4, 5, (150, 4)).astype(float)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (301, [float("inf")] * 4), (302, [])]
    df = spark.createDataFrame(rows[:-1], "qid long, embedding array<double>")
    for own in (False, True):
        got = {(r.qid, r.rank): r.did for r in R.self_search(df, 7, own, 9, 13, held_bytes).collect()}
        assert got == {(q, r + 1): d for q in range(150) for r, (_, d) in enumerate(sorted((-float(x[q] @ x[d]), d) for d in range(150) if not (own and d == q))[:7])}
    assert R.self_search(df.limit(0), 3).isEmpty() and R.self_search(df.limit(1), 3).count() == 1


@pytest.mark.parametrize("blocks", [1, 2, 3, 4, 7, 10])
@pytest.mark.parametrize("parts", [1, 3])
def test_stripes_meet_each_pair_once(blocks, parts):
    met = [frozenset({i, (i + s) % blocks}) for i, first, end in R.stripes(blocks, parts) for s in range(first, end)]
    assert len(met) == len(set(met)) == blocks * (blocks + 1) // 2


def test_natural_key_of_long_digit_runs(spark):
    names = ["a2", "a10", "a" + "9" * 20, "a1" + "0" * 20, "a002b", "a2b", "b1"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in reversed(names)], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()]
    assert got == ["a2", "a002b", "a2b", "a10", "a" + "9" * 20, "a1" + "0" * 20, "b1"]


def test_batch_losses_do_not_depend_on_micro_batches(spark):
    rng = np.random.default_rng(5)
    rows = [(b, i, [float(v) for v in rng.normal(size=3)], [[float(v) for v in rng.normal(size=3)] for _ in range(2)]) for b in range(3) for i in range(4 + b)]
    pairs = spark.createDataFrame(rows, "batch int, i int, query array<double>, doc array<array<double>>").repartition(4)
    a, b = ({r.batch: (r.loss, r.other, r.accuracy) for r in C.batch_losses(pairs, 0.2, 2, micro).collect()} for micro in (2, 100))
    for k in a:
        assert a[k] == pytest.approx(b[k])
        q, d = np.array([r[2] for r in rows if r[0] == k]), np.array([v for r in rows if r[0] == k for v in r[3]])
        s = q @ d.T / 0.2
        own = s[np.arange(len(q)), 2 * np.arange(len(q))]
        assert a[k][0] == pytest.approx(np.mean(np.log(np.exp(s).sum(1)) - own)) and a[k][1] == pytest.approx(np.mean(np.log(np.exp(s[:, ::2]).sum(0)) - own))
        assert a[k][2] == np.mean(s.argmax(1) == 2 * np.arange(len(q)))
    one = {r.batch: r.loss for r in C.in_batch_loss(C.gather_batches(pairs.withColumn("doc", F.get("doc", F.lit(0))), 3)).collect()}
    q, d = np.array([r[2] for r in rows]), np.array([r[3][0] for r in rows])
    s = q @ d.T / 0.2
    assert one == {0: pytest.approx(np.mean(np.log(np.exp(s).sum(1)) - np.diag(s)))}


def test_dropout_is_seeded(spark):
    states = F.array(F.array(*[F.lit(1.0)] * 64), F.array(*[F.lit(2.0)] * 64))
    one, two, other = (spark.range(1).select(V.dropout(states, 0.5, F.lit(s)).alias("x")).first().x for s in (1, 1, 2))
    assert one == two != other and set(one[0]) == {0.0, 2.0} and set(one[1]) == {0.0, 4.0}


def test_wrap_equals_a_loop(spark):
    """Words of any length, other white space, characters beyond the first plane."""
    rng = np.random.default_rng(8)
    texts = ["", "  ", "a", "x" * 9 + " y", None, "\U0001d11e" * 8 + "\t\U0001d11e a\n\u2028 b\u00a0c"]
    texts += [" ".join("w" * int(n) for n in rng.integers(1, 14, int(rng.integers(1, 60)))) for _ in range(60)]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for width in (2, 7, 12, 40):
        got = {r.i: r.w for r in df.select("i", T.wrap(F.col("t"), width).alias("w")).collect()}
        for i, t in enumerate(texts):
            if t is None:
                assert got[i] is None
                continue
            want, line = [], ""
            for w in t.split():
                if len(line) + len(w) + 1 <= width:
                    line += " " + w
                else:
                    want.append(line.strip(" "))
                    line = w
            assert got[i] == ([*want, line.strip(" ")] if line else want), (i, width)


@pytest.mark.parametrize("block_docs", [1, 4, 1000])
def test_lexical_search_in_blocks_equals_all_scores(spark, block_docs):
    """Equal scores, repeated and unknown terms, null rows, hot terms, fewer documents than k."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    chances = 1 / np.arange(1, 61)
    docs = [(d, str(w)) for d in range(150) for w in rng.choice(words, int(rng.integers(1, 12)), p=chances / chances.sum())]
    docs += [(200 + d, w) for d in range(20) for w in ("w5", "w9", "w59")] + [(300, None), (None, "w1")]
    asked = [(q, str(w)) for q in range(25) for w in rng.choice(words, int(rng.integers(1, 9)))] + [(50, "none"), (51, "w59"), (51, "w59"), (52, None), (53, "w0")]
    d, q = spark.createDataFrame(docs, "did long, term string"), spark.createDataFrame(asked, "qid long, term string")
    whole = d.where("did IS NOT NULL AND term IS NOT NULL")
    with store.cleared():
        for k in (1, 10):
            want = {(r.qid, r.rank): (r.did, r.score) for r in R.lexical(q, whole, k).collect()}
            for terms in (None, q.select("term")):
                rows = X.search(X.ImpactIndex(d, terms, block_docs=block_docs), q, k).collect()
                assert {(r.qid, r.rank): (r.did, r.score) for r in rows} == want
                assert all(0 < r["read"] <= r.postings for r in rows)
                if block_docs == 1 and k == 1:
                    assert sum({r.qid: r["read"] for r in rows}.values()) < 0.7 * sum({r.qid: r.postings for r in rows}.values())


def test_lexical_search_hands_on_k_rows_a_query_and_group(spark, monkeypatch):
    """A term of all documents that all queries ask for: no row for each pair of a query and a document."""
    d, q = spark.range(300).select(F.col("id").alias("did"), F.lit("hot").alias("term")), spark.range(30).select(F.col("id").alias("qid"), F.lit("hot").alias("term"))
    handed, best = [], X.best
    monkeypatch.setattr(X, "best", lambda run, k: (handed.append(run.count()), best(run, k))[1])
    with store.cleared():
        rows = X.search(X.ImpactIndex(d, q.select("term")), q, 3).collect()
    assert {(r.qid, r.did, r["rank"], r.postings, r["read"]) for r in rows} == {(q, d, d + 1, 300, 300) for q in range(30) for d in range(3)}
    assert handed and max(handed) <= 30 * 3 * spark.sparkContext.defaultParallelism


def test_cleared_deletes_all_tables(spark):
    """Whatever was written inside of the block is gone when it ends."""
    from pathlib import Path

    root = Path(store.shared_root(spark).removeprefix("file://")) / "fathomry"
    before = {p for p in root.glob("*")}
    vectors = spark.range(30).select(F.col("id").alias("qid"), F.array(F.col("id").cast("double")).alias("embedding"))
    terms = spark.range(30).select(F.col("id").alias("did"), F.lit("a").alias("term"))
    with store.cleared():
        R.search(vectors, vectors.withColumnRenamed("qid", "did"), 2).collect()
        R.self_search(vectors, 2).collect()
        X.search(X.ImpactIndex(terms), terms.select(F.col("did").alias("qid"), "term")).collect()
        O.cumulative_split(spark.range(30).withColumn("n", F.lit(1)), "n", [10], ["id"]).collect()
        assert {p for p in root.glob("*")} > before
    assert {p for p in root.glob("*")} == before


def test_batch_sizes_go_down_by_parts_of_octaves(spark):
    """The ladders that the sizes of a halving batch are known by."""
    def ladder(size, parts, no_odd=False):
        out = [size]
        while out[-1]:
            out.append(spark.range(1).select(O.decayed_batch(F.lit(out[-1]), F.lit(parts), no_odd)).first()[0])
        return out[:-1]

    assert ladder(64, 4) == [64, 56, 48, 40, 32, 28, 24, 20, 16, 14, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
    assert ladder(64, 4, True) == [64, 56, 48, 40, 32, 28, 24, 20, 16, 14, 12, 10, 8, 6, 4, 2]
    assert ladder(64, 2) == [64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1] and ladder(64, 1) == [64, 32, 16, 8, 4, 2, 1]
    assert ladder(22, 3)[:4] == [22, 21, 16, 14] and ladder(17, 3)[1] == 16


def test_average_of_the_best(spark):
    rows = [(g, i, float(i % 7), [float(i), 2.0 * i]) for g in "ab" for i in range(20)] + [("a", 90, None, [9.0, 9.0]), ("a", 91, 99.0, None), ("c", 1, 1.0, [3e38, -3e38]), ("c", 2, 1.0, [3.4e38 * 2, 0.0])]
    df = spark.createDataFrame(rows, "g string, i int, m double, embedding array<double>")
    got = {r.g: (r.embedding, r.n) for r in O.average_best(df, "m", 3, group=["g"], tie="i").collect()}
    assert got["a"] == got["b"] == ([(6 + 13 + 5) / 3, 2 * (6 + 13 + 5) / 3], 3) and got["c"] == ([3.4028234663852886e38, -1.5e38], 2)
    assert O.average_best(df.where("g <> 'c'"), "m", 1, larger=False, tie="i").first().embedding == [0.0, 0.0]
    assert O.average_best(df.limit(0), "m", 3).isEmpty()


def test_wrap_takes_unicode_white_space(spark):
    text = "one\u00a0two\u2003three\u2028four\x85five\x1csix"
    assert spark.createDataFrame([(text,)], "t string").select(T.wrap(F.col("t"), 10)).first()[0] == ["one two", "three four", "five six"]


def test_token_ids_equal_the_tokenizer(spark):
    """Whole and cut texts, arrays of texts, nulls and empty texts, very long ones, and special ids that are never cut."""
    from tokenizers import Tokenizer

    from fathomry.operators import tokens as K
    from fathomry.plans.prep import VOCABULARY

    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ["The quick brown fox", None, "", "naïve Ärger 3.14", "word " * 50_000, "<|endoftext|>"]
    rows = [(i, t, [t, "second", None] if i % 2 else None if i == 4 else []) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, query string, passages array<string>")

    def want(t, n):
        return None if t is None else [1, *tokenizer.encode(t, add_special_tokens=False).ids[: n and n - 3], 2, 3]

    for q, p in ((8, 5), (3, None), (None, 100)):
        got = {r.id: r for r in K.encode(df, VOCABULARY, {"query": q, "passages": p}, [1], [2, 3]).collect()}
        for i, t, more in rows:
            assert got[i].query_ids == want(t, q) and got[i].passages_ids == (None if more is None else [want(x, p) for x in more])
            assert (got[i].query, got[i].passages) == (t, more)
    with pytest.raises(ValueError):
        K.encode(df, VOCABULARY, {"query": 2}, [1], [2, 3])
    assert K.encode(df.limit(0), VOCABULARY, {"query": 8}).isEmpty()
    ids = spark.createDataFrame([([5, 6],), ([],), ([1, 2, 3, 4],)], "ids array<int>")
    right = [tuple(r) for r in ids.select(K.padded(F.col("ids"), 3, 9), K.mask(F.col("ids"), 3)).collect()]
    assert right == [([5, 6, 9], [1, 1, 0]), ([9, 9, 9], [0, 0, 0]), ([1, 2, 3, 4], [1, 1, 1, 1])]
    assert ids.select(K.padded(F.col("ids"), 3, 9, True)).first()[0] == [9, 5, 6] and ids.select(K.mask(F.col("ids"), 3, True)).first()[0] == [0, 1, 1]


def test_lexical_search_shuffles_no_pairs(spark, monkeypatch):
    """Blocks of a few documents and queries, ties, repeated and unknown terms, ids of either kind: the k best of plain BM25."""
    monkeypatch.setattr(R, "LEXICAL_DOCS", 7)
    monkeypatch.setattr(R, "LEXICAL_QUERIES", 3)
    docs = {d: [f"w{(d * i) % 11}" for i in range(1, 4 + d % 5)] for d in range(60)}
    queries = {f"q{q}": [f"w{q}", f"w{(q * 3) % 11}", f"w{q}", "nowhere"] for q in range(11)} | {"none": ["nowhere"]}
    q = spark.createDataFrame([(k, w) for k, x in queries.items() for w in x], "qid string, term string")
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for x in docs.values() for w in set(x))
    want = set()
    for k, x in queries.items():
        idf = lambda w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
        score = {d: round(sum(idf(w) * y.count(w) * 2.2 / (y.count(w) + 1.2 * (0.25 + 0.75 * len(y) / average)) for w in x if w in y), 9) for d, y in docs.items() if set(x) & set(y)}
        want |= {(k, d, i) for i, d in enumerate(sorted(score, key=lambda d: (-score[d], d))[:5], 1)}
    for kind in ("long", "string"):
        name = (lambda d: f"{d:02d}") if kind == "string" else int
        table = spark.createDataFrame([(name(d), w) for d, x in docs.items() for w in x], f"did {kind}, term string")
        out = R.lexical(q, table, 5)
        assert {(r.qid, r.did, r["rank"]) for r in out.collect()} == {(k, name(d), i) for k, d, i in want}
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
