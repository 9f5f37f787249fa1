"""The pipeline operators on small tables with every awkward case, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomry.llm import _cover, op01_topk, op02_warc, op03_mix, op04_chat, op05_license, op06_toxic, op07_tokens, op08_near, op09_decontam, op10_lines
from fathomry.llm._graph import connected_components
from fathomry.llm._work import Work

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, score string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with what operators compute."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Ärger", "naïve", "THE", "the", "İ"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    rows = [(i, text(int(rng.integers(1, 60))), f"s{i % 4}") for i in range(60)]
    base = text(80).split()
    for i in range(60, 110):
        w = list(base)
        for j in rng.integers(0, 80, int(rng.integers(0, 7))):
            w[j] = str(rng.choice(vocab))
        rows.append((i, " ".join(w), None if i % 3 == 0 else "s0"))
    rows += [(200, None, "s1"), (201, "", None), (202, " \t\n ", "s2"), (203, "one", "s2"), (204, "One", "s2"), (205, rows[0][1], "s9"), (205, rows[0][1], "s9"), (None, "lost words here", "s1"), (None, rows[0][1], "s1")]
    rows += [(300 + i, "Shared line\n\n" + text(5) + "\n  shared LINE\t\nend", "s3") for i in range(12)]
    return rows


# -- 1 -----------------------------------------------------------------------------------


def brute_topk(rows, k, every):
    """Every row against every row with another id, in Python integers."""
    live = [(i, [int(np.floor(64 * np.float32(x).astype(float))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, a in live:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in live if i != q)[:k]
            out += Counter((q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("spread", [0.0, 0.02, 1.0])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(5, 8))
    rows = [(i, [float(x) for x in centers[i % 5] + spread * rng.normal(size=8)]) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 8), (903, [float("inf")] * 8), (904, [1.0, 2.0]), (None, [1.0] * 8), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = op01_topk.top_k(Work(spark, "t1"), df, F.col("vec_id") % 20 == 0, 20)
    assert Counter(map(tuple, got.collect())) == brute_topk(rows, 20, 20)


def test_topk_of_ids_with_several_vectors_and_of_repeated_rows(spark):
    """An id's own rows never fill its list; other ids' repeated rows are candidates each."""
    rng = np.random.default_rng(4)
    near = [5.0, 5.0, 5.0]
    rows = [(20, [x + 0.1 * i for x in near]) for i in range(30)] + [(40, near)] * 30 + [(41, near)] * 3 + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = Counter(map(tuple, op01_topk.top_k(Work(spark, "t1"), df, F.col("vec_id") % 20 == 0, 20).collect()))
    assert got == brute_topk(rows, 20, 20)


def test_topk_of_large_vectors_is_exact(spark):
    """Beyond the range of floats and of 64 bits: 1e9, 2 and 3 under ids 0, 1 and 2 all answer each other."""
    for rows in ([(0, [1e9]), (1, [2.0]), (2, [3.0])], [(0, [1e30, -1.0]), (20, [1e30, 7.0]), (1, [1e30, 1e30]), (2, [-1e30, 3.0]), (3, [0.5, 0.5]), (40, [3e38, 3e38])], [(i, [float(3e7 + i), float(i % 7)]) for i in range(50)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert Counter(map(tuple, op01_topk.top_k(Work(spark, "t1"), df, F.col("vec_id") % 20 == 0, 20).collect())) == brute_topk(rows, 20, 20)


def test_cover_tree_has_its_invariants():
    x = np.floor(64 * np.random.default_rng(3).normal(size=(700, 6)))
    centers, entered, owner = _cover.farthest_first(x, 90)
    between = _cover.reach(x[centers], x[centers])
    for level in range(1, 12):
        scale = entered[1] / _cover.BASE**level
        net = [j for j, r in enumerate(entered) if r > scale]
        assert all(between[i, j] > scale - 1e-6 for i in net for j in net if i < j)  # apart
        assert all(between[j, net].min() <= scale + 1e-6 for j, r in enumerate(entered) if r <= scale)  # covered
    order, tree = _cover.build(x, 8)
    assert sorted(order) == list(range(700)) and tree.nodes[0, 1:3].tolist() == [0, 700]
    for c, lo, hi, first, end in tree.nodes:
        n = [tuple(tree.nodes[k, 1:3]) for k in range(first, end)]
        assert not n or (n[0][0] == lo and n[-1][1] == hi and all(x[1] == y[0] for x, y in zip(n, n[1:])) and tree.nodes[first, 0] == c)  # nested
    for k, (c, lo, hi, *_) in enumerate(tree.nodes):
        assert np.sqrt(((tree.x[lo:hi] - tree.x[c]) ** 2).sum(1)).max() <= tree.radius[k]
    again = _cover.load(tree.x, *_cover.dump(tree))
    assert (again.nodes == tree.nodes).all() and (again.radius == tree.radius).all()


def test_topk_prunes_clusters_and_stays_exact(spark):
    rng = np.random.default_rng(2)
    x = np.floor(64 * (np.repeat(rng.normal(size=(12, 6)) * 3, 200, 0) + 0.01 * rng.normal(size=(2400, 6))))
    order, tree = _cover.build(x, 8)
    perm, asked = _cover.build(x[::50], 4)
    best = _cover.Best(len(perm), 5)
    scored = _cover.search(asked, tree, _cover.Ids.from_lists([[i] for i in order]), best)
    assert scored <= 0.1 * len(perm) * len(x)
    s = (x[::50][perm] @ x.T).astype(int)
    for i in range(len(perm)):
        assert list(zip(-best.scores[i], best.ids[i])) == sorted((-v, j) for j, v in enumerate(s[i]))[:5]
    work = Work(spark, "t1")
    df = spark.createDataFrame([(i, [float(c) / 64 for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert op01_topk.top_k(work, df, F.col("vec_id") % 20 == 0, 20).count() == 120 * 20
    assert op01_topk.share_scored(work) <= 0.1


def test_topk_empty_and_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    run = lambda d: [tuple(r) for r in op01_topk.top_k(Work(spark, "t1"), d, F.col("vec_id") % 20 == 0).collect()]
    assert run(df) == [(0, 1, 1, 64 * 128)] and run(df.limit(0)) == []


# -- 2 -----------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 70
    rows = [(3, "u3", long), (1, "u\r\n1", long), (2, None, "short"), (4, "u4", None), (5, "u5", "short"), (None, "u6", long), (6, "u7", "x" * 200_000), (1, "u\r\n1", long)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/a"
    op02_warc.write_archive(op02_warc.to_records(Work(spark, "t2"), pages, F.col("page_id"), F.col("url"), F.col("html")), path, maxFileBytes=2000)
    back = op02_warc.read_archive(spark, path).collect()
    got = Counter((r.record_id, r.target_uri, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload), r.http_length, r.payload_digest) for r in back)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, u, t in rows:
        again = t == long and i != 1
        want[None if i is None else str(i), u, "revisit" if again else "response", "1" if again else None, None if again else (t or "").encode(), len((t or "").encode()), sha(t)] += 1
    assert got == want
    some = op02_warc.read_archive(spark, path, payload="digest").where((F.col("record_type") == "revisit") & F.col("record_id").isin("3", "5"))
    assert [r.record_id for r in some.collect()] == ["3"]
    plan = some._jdf.queryExecution().toString()
    assert "payload" in plan
    assert all(r.payload is None and r.payload_sha256 is None for r in op02_warc.read_archive(spark, path, payload="none").collect())


def test_warc_filters_skip_payloads_and_plain_files(tmp_path):
    import gzip
    import io

    record = lambda i: {"record_id": i, "record_type": "response", "target_uri": f"u{i}", "payload_digest": "d", "refers_to": None, "http_length": 50_000, "payload": bytes(50_000)}
    raw = [op02_warc.record_bytes(record(i)) for i in range(50)]
    wanted = lambda h: h["warc-target-uri"] == "u49"
    noise = np.random.default_rng(0).integers(0, 256, 50_000, dtype=np.uint8).tobytes()
    members = b"".join(op02_warc.member(op02_warc.record_bytes(record(i) | {"payload": noise}), 1) for i in range(50))
    for data in (b"".join(raw), b"".join(map(gzip.compress, raw)), members):
        got = list(op02_warc.records(io.BytesIO(data), len(data), wanted, "full"))
        assert [(r[0], len(r[8])) for r in got] == [("49", 50_000)]
        assert list(op02_warc.records(io.BytesIO(data[:-30_000]), len(data) - 30_000, wanted, "full")) in ([], got)
    assert gzip.decompress(members)[:8] == b"WARC/1.1"


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/e"
    op02_warc.write_archive(op02_warc.to_records(Work(spark, "t2"), pages, F.col("page_id"), F.col("url"), F.col("html")), path)
    assert op02_warc.read_archive(spark, path).count() == 0


# -- 3 -----------------------------------------------------------------------------------


def fill(sizes, weights):
    """Targets by resharing step by step."""
    total, cap = 1.5 * sum(sizes), [2.0 * s for s in sizes]
    free, target = set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        rest = total - sum(cap[i] for i in range(len(sizes)) if i not in free)
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= cap[i]}
        for i in free:
            target[i] = cap[i] if i in over else share[i]
        if not over:
            break
        free -= over
    return target


def test_mix_targets_and_taken(spark, corpus):
    docs = docs_of(spark, corpus)
    rows = op03_mix.plan(Work(spark, "t3"), docs).collect()
    size = Counter()
    for _, t, s in corpus:
        size[s] += len(SPACE.findall(t or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(names, fill([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert len(rows) == len(corpus)
    assert sorted({(r.source_size, round(r.target, 6)) for r in rows}) == sorted({(size[s], round(want[s], 6)) for s in names})
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    biggest = max(r.size for r in rows)
    assert all(abs(v - want[k]) <= biggest for k, v in taken.items())
    again = op03_mix.plan(Work(spark, "t3"), docs.repartition(7)).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    mixed = op03_mix.mix(Work(spark, "t3"), docs)
    assert mixed.columns == [*docs.columns, "repetition"] and sum(len(SPACE.findall(r.text or "")) for r in mixed.collect()) == sum(taken.values())


def test_mix_cuts_repeated_rows_near_their_target(spark):
    """Rows that are equal in id and text can't be told apart by a hash, and still only as many as fit are taken."""
    rows = [(7, "a b c", "p")] * 300 + [(None, "x y z w", None)] * 150 + [(i, "k " * (1 + i % 9), "q") for i in range(500)] + [(9, None, "z"), (9, "", "z")]
    docs = docs_of(spark, rows).repartition(5)
    plan = op03_mix.plan(Work(spark, "t3"), docs).collect()
    assert len(plan) == len(rows)
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - t) <= 4.5 for s, t in target.items()), (taken, target)
    mixed = op03_mix.mix(Work(spark, "t3"), docs)
    assert Counter({r.source: r.n for r in mixed.groupBy("source").agg(F.sum(op03_mix.size_of(F.col("text"))).alias("n")).collect()}) == taken
    assert Counter(map(tuple, plan)) == Counter(map(tuple, op03_mix.plan(Work(spark, "t3"), docs.coalesce(1)).collect()))


def test_mix_equals_its_sql_on_awkward_rows(spark, corpus, tmp_path):
    import duckdb

    from fathomry.llm.sql import ORACLE

    rows = corpus + [(3, "m n o p q", "s1")] * 40 + [(800, "long " * 50_000, "s2")]
    docs = docs_of(spark, rows)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = Counter(con.execute(f"SELECT doc_id, source, size, source_size, target, taken FROM ({ORACLE['op3_mix']})").fetchall())
    assert want == Counter(map(tuple, op03_mix.plan(Work(spark, "t3"), docs).drop("repeats").collect()))


def test_mix_large_source_is_cut_close_to_its_target(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 5)).alias("source"), F.lit("x y z").alias("text"))
    rows = op03_mix.plan(Work(spark, "t3"), docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in rows)
    assert op03_mix.plan(Work(spark, "t3"), docs.limit(0)).count() == 0


# -- 4 -----------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["\\", "<", "</turn>\n", "<+>", "<turn:user>\n", "\\s\\l", "", None, "\n", "é𝄞<", ">\n", "a|b" * 500]
    rows = [(c, t, role, nasty[(c + 5 * t) % len(nasty)]) for c in range(12) for t, role in enumerate(["user", "user", "assistant", "assistant", "a>\n<b\\", None, "assistant"])]
    rows += [(60, 0, "user", "long <\\ " * 40_000), (60, 1, "assistant", "reply </turn> " * 40_000)]
    rows += [(50, None, "user", "late"), (50, 0, "assistant", "first"), (51, 1, "user", "b"), (51, 1, "user", "a"), (51, 1, "user", "a"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = op04_chat.format_chats(df)
    got = {r.conv_id: r for r in op04_chat.read_back(chats).collect()}
    masks = {r.conv_id: (r.formatted, r.loss_mask) for r in chats.collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].turns] == [(r, x) for _, _, r, x in turns]
        assert got[c].loss_text == "".join(x for _, _, r, x in turns if r == "assistant")
        formatted, mask = masks[c]
        assert sum(m.chars for m in mask) == len(formatted)
        at, under = 0, ""
        for m in mask:
            under += formatted[at : at + m.chars] if m.loss else ""
            at += m.chars
        assert under.replace("\\l", "<").replace("\\s", "\\") == got[c].loss_text
        assert formatted.count("<turn:") == sum(i == 0 or turns[i - 1][2] != x[2] for i, x in enumerate(turns))
    assert op04_chat.read_back(op04_chat.format_chats(df.limit(0))).count() == 0


def test_chat_loss_is_read_under_the_mask(spark):
    """What the mask marks is the loss text, whatever the roles say; a mask that is off by a character is an error."""
    rows = [(1, 0, "user", "a<b"), (1, 1, "user", ""), (1, 2, "assistant", "c\\d"), (1, 3, "assistant", "é𝄞"), (1, 4, "user", "e")]
    chats = op04_chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    flipped = chats.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("loss", ~m.loss)))
    assert [op04_chat.read_back(x).first().loss_text for x in (chats, flipped)] == ["c\\dé𝄞", "a<be"]
    off = chats.withColumn("loss_mask", F.transform("loss_mask", lambda m, i: m.withField("chars", m.chars + F.when(i == 1, 1).otherwise(0))))
    with pytest.raises(Exception, match="doesn't fit"):
        op04_chat.read_back(off).collect()


# -- 5 -----------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark, corpus):
    said = ["Released under the MIT License.", "mit\nlicense mit license", "Apache-LICENSE and the General Public License", "general public", "MITLicense", "xmit license",
            "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated files", "licensed under cc by-nc 4.0", "under the terms of\n\nthe GNU general license",
            "Licensed Apache Version 2.0 under the", "Released under the Apache License", "Licensed under CC BY-SA 4.0", "a\n\nReleased under the\nMIT license\n \t\nb\n\nunder CC BY-NC 4.0 licensed",
            "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "the " * 30_000 + "MIT license released under"]
    rows = corpus + [(500 + i, t, "s") for i, t in enumerate(said)]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, tuple(r.base_labels), tuple(r.found), round(r.score, 9)) for r in op05_license.scan(Work(spark, "t5"), docs_of(spark, rows)).collect())
    want = Counter()
    for i, t, _ in rows:
        low = (t or "").translate(AZ)
        w = WORD.findall(low)
        at = {label: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, label in op05_license.PHRASES}
        places = sorted(x for v in at.values() for x in v)
        found, best = set(), 0.0
        for block in re.split(r"\n[\x20\x09-\x0D]*\n", low):
            for label, text in op05_license.TEMPLATES:
                ts = set(op05_license.template_tokens(text))
                share = len(ts & set(WORD.findall(block))) / len(ts)
                if share >= 0.8 - 1e-12 and set(op05_license.MARKS.get(label, ())) <= set(WORD.findall(block)):
                    found.add(label)
                    best = max(best, share)
        want[i, len(w), len(places), places[0] if places else None, places[-1] if places else None, tuple(sorted(k for k, v in at.items() if v)), tuple(sorted(found)), round(1.0 if places else best, 9)] += 1
    assert got == want
    assert op05_license.scan(Work(spark, "t5"), docs_of(spark, rows).limit(0)).count() == 0
    pairs = Counter((r.doc_id, r.block, r.label, round(r.share, 9), r.marked) for r in op05_license.matches(Work(spark, "t5"), docs_of(spark, rows)).collect())
    every = Counter()
    for i, t, _ in rows:
        for k, block in enumerate(re.split(r"\n[\x20\x09-\x0D]*\n", (t or "").translate(AZ))):
            have = set(WORD.findall(block))
            for label, text in op05_license.TEMPLATES:
                ts = set(op05_license.template_tokens(text))
                if len(ts & have) / len(ts) >= 0.8 - 1e-12:
                    every[i, k, label, round(len(ts & have) / len(ts), 9), set(op05_license.MARKS.get(label, ())) <= have] += 1
    assert pairs == every
    labels = {r.doc_id: r.found for r in op05_license.scan(Work(spark, "t5"), docs_of(spark, rows[-5:])).collect()}
    assert [labels[i] for i, _, _ in rows[-5:-3]] == [[], ["cc-by-sa-4.0"]]  # an Apache notice isn't MIT's, nor one Creative Commons licence another


# -- 6 -----------------------------------------------------------------------------------


def test_toxicity_learns_and_is_held_out(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts, labels = [], []
    for i in range(600):
        w = [word() for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            w[int(rng.integers(0, 30))] = "Zyxwv" + word()
        texts.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    texts += [(700, None, "s"), (701, "", "s"), (702, "zyxwv " * 30_000, "s"), (None, "a", "s")]
    docs, known = docs_of(spark, texts), spark.createDataFrame(labels + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = op06_toxic.train(docs, known)
    rows = op06_toxic.with_scores(docs.select("doc_id", "text"), model).select("doc_id", "score", op06_toxic.held_out(F.col("doc_id")).alias("held")).collect()
    truth = {i: y for i, _, y in labels}
    held = [(truth[r.doc_id], r.score) for r in rows if r.doc_id in truth and r.held]
    assert {r.doc_id for r in rows if r.held} == {i for i, _, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == bool(y) for y, s in held]) > 0.95
    score = {r.doc_id: r.score for r in rows}
    assert score[700] == score[701] < 0.5 < score[702]
    kept = op06_toxic.drop_toxic(docs, known)
    assert kept.columns == docs.columns and kept.where("doc_id = 702").isEmpty() and kept.where("doc_id IS NULL").count() == 1


def ngrams(t):
    return {(t or "").lower()[i : i + n] for n in range(3, 9) for i in range(len(t or "") - n + 1)}


def brute_toxicity(train, share, asked, grams=ngrams):
    """Scores by dictionaries of features and Newton's method on a dense matrix."""
    sets, y = [grams(t) for t, _ in train], np.array([k for _, k in train], bool)
    count = [Counter(g for s, k in zip(sets, y) if k == side for g in s) for side in (False, True)]
    ratio = {}
    for g in count[0] | count[1]:
        a, b = count[1][g], count[0][g]
        r = np.log((a + 1) / (y.sum() + 2)) - np.log((b + 1) / ((~y).sum() + 2))
        if a + b >= op06_toxic.LEAST_DOCS and abs(r) >= op06_toxic.LEAST_Z * np.sqrt(1 / (a + 1) + 1 / (b + 1)):
            ratio[g] = r
    names = sorted(ratio)
    x = np.array([[ratio[g] if g in s else 0.0 for g in names] + [1.0] for s in sets])
    c, sign = np.where(y, share / y.mean(), (1 - share) / (1 - y.mean())), np.where(y, 1.0, -1.0)
    w, ridge = np.zeros(len(names) + 1), np.diag([op06_toxic.PENALTY] * len(names) + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(sign * (x @ w)))
        w -= np.linalg.solve((x.T * (c * p * (1 - p))) @ x + ridge + 1e-12 * np.eye(len(w)), -x.T @ (c * p * sign) + ridge @ w)
    return [1 / (1 + np.exp(-(sum(ratio[g] * w[k] for k, g in enumerate(names) if g in s) + w[-1]))) for s in map(grams, asked)], len(names)


def test_toxicity_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqr"), 5))
    texts, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        w = [word() for _ in range(12)]
        if rng.random() < (0.8 if toxic else 0.1):
            w[3] = "VilE" + str(rng.choice(list("xyz")))
        if rng.random() < (0.1 if toxic else 0.6):
            w[7] = "sunny"
        texts.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(toxic)))
    texts += [(900, None, "s"), (901, "", "s"), (902, "ab", "s"), (903, "vilex sunny", "s")]
    docs, known = docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = [(t, y) for (i, t, _), (_, _, y) in zip(texts, labels) if zlib.crc32(str(i).encode()) % 5]
    want, features = brute_toxicity(kept, np.mean([y for _, y in kept]), [t for _, t, _ in texts])
    got = {r.doc_id: r.score for r in op06_toxic.with_scores(docs.select("doc_id", "text"), op06_toxic.train(docs, known)).collect()}
    assert features > 5 and max(abs(got[i] - w) for (i, _, _), w in zip(texts, want)) < 0.01


def test_toxicity_fit_is_bounded_and_the_same_in_any_order(spark, monkeypatch):
    """A doc_id with several texts is one training row, and the bytes of training texts are bounded."""
    rows = [(i, ("bad thing " if i % 2 else "good deed ") + f"n{i % 7} " * 5, "s") for i in range(200)] + [(3, f"other text {k}", "s") for k in range(50)]
    known = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    one, two = (op06_toxic.train(docs_of(spark, r), known) for r in (rows, rows[::-1]))
    assert (one.dense == two.dense).all() and one.intercept == two.intercept and one.some.any()
    monkeypatch.setattr(op06_toxic, "MAX_TRAIN_BYTES", 600)
    op06_toxic.train(docs_of(spark, rows), known)
    monkeypatch.setattr(op06_toxic, "MAX_TRAIN_BYTES", 0)
    assert not op06_toxic.train(docs_of(spark, rows), known).some.any()


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, [(1, "a", "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert op06_toxic.with_scores(docs.drop("score"), op06_toxic.train(docs, none)).first().score == 0.5
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert op06_toxic.with_scores(docs.drop("score"), op06_toxic.train(docs, one)).first().score < 0.5
    assert op06_toxic.with_scores(docs.drop("score").limit(0), op06_toxic.train(docs, none)).count() == 0


# -- 7 -----------------------------------------------------------------------------------


def test_token_histogram_answers_every_limit(spark, corpus):
    with open(op07_tokens.VOCABULARY, "rb") as f:
        encode = op07_tokens.load_encoding(f.read()).encode_ordinary
    lengths = sorted(len(encode(t or "")) for _, t, _ in corpus)
    long = "many words " * 30_000
    docs = docs_of(spark, corpus + [(9, "<|endoftext|>", "s"), (10, long, "s")])
    lengths = sorted([*lengths, len(encode("<|endoftext|>")), len(encode(long))])
    s = op07_tokens.summarise(Work(spark, "t7"), op07_tokens.histogram(docs)).cache()
    for r in s.collect():
        assert (r.docs_at_most, r.docs_above) == (sum(n <= r.length for n in lengths), sum(n > r.length for n in lengths))
        assert r.quantile == pytest.approx(sum(n <= r.length for n in lengths) / len(lengths))
        assert (r.tokens_at_most, r.truncated_total) == (sum(n for n in lengths if n <= r.length), sum(min(n, r.length) for n in lengths))
    for limit in (0, 1, 7, 50, 10_000):
        assert op07_tokens.truncated_total(s, limit) == sum(min(n, limit) for n in lengths)
    assert op07_tokens.quantile(s, 0.5) == lengths[-(-len(lengths) // 2) - 1]
    empty = op07_tokens.summarise(Work(spark, "t7"), op07_tokens.histogram(docs.limit(0)))
    assert empty.count() == 0 and op07_tokens.truncated_total(empty, 5) == 0 and op07_tokens.quantile(empty, 0.5) is None
    counted = op07_tokens.with_counts(docs.select("doc_id", "text"))
    assert sorted(r.n_tokens for r in counted.collect()) == lengths


# -- 8 -----------------------------------------------------------------------------------


def brute_components(rows, k):
    sets = []
    for _, t, _ in rows:
        w = SPACE.findall((t or "").translate(AZ))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), None if r[0] is None else least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, words):
    got = op08_near.components(Work(spark, "t8"), docs_of(spark, corpus), words).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(corpus, words)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_loose_group(spark):
    """A group around the threshold: leaders don't reach everybody, chains do."""
    rng = np.random.default_rng(8)
    base, rows = [f"v{i}" for i in range(100)], []
    for i in range(400):
        w = list(base)
        for j in rng.choice(100, int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{rng.integers(0, 10_000)}"
        rows.append((int(i), " ".join(w), "s"))
    got = op08_near.components(Work(spark, "t8"), docs_of(spark, rows), 2).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_near_duplicates_in_small_blocks_and_without_the_minhash_cut(spark, monkeypatch):
    """A bucket of documents that share most of their text without being alike, some of them copies of each other."""
    rng = np.random.default_rng(9)
    base, rows = [f"b{i}" for i in range(60)], []
    for i in range(120):
        own = [f"o{i // 2}_{j}" for j in range(25)]
        if i % 2:
            own[3] = f"e{i}"
        rows.append((int(i), " ".join(base + own), "s"))
    rng.shuffle(rows)
    rows.append((500, "long " + "word " * 20_000, "s"))
    monkeypatch.setattr(op08_near, "BLOCK", (8, 16))
    monkeypatch.setattr(op08_near, "OUTSIDE", (4, 8))
    monkeypatch.setattr(op08_near, "MEMBERS", (8, 9))
    for least in (op08_near.LEAST_AGREE, 0):
        got = op08_near.components(Work(spark, "t8"), docs_of(spark, rows), 2, least_agree=least).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_keep_one(spark, corpus):
    docs = docs_of(spark, corpus)
    kept = op08_near.keep_one(Work(spark, "t8"), docs)
    want = {i for i, _, c in brute_components(corpus, 5) if i == c}
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([*want - {None}, None, None])
    assert op08_near.keep_one(Work(spark, "t8"), docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(10, 60)] + [(5, 5), (99, 98), (98, 99)], "a long, b long")
    got = {r.node: r.label for r in connected_components(Work(spark, "tg"), edges, "c").collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, 98: 98, 99: 98}


# -- 9 -----------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark, corpus):
    items = [(1, " ".join(corpus[3][1].split()[:40])), (10, "The SHARED line w1"), (2, "one"), (3, None), (4, "..."), (5, "lost, words; HERE"), (1, "line end"), (6, "w1 " * 30), (7, "absent w2"), (None, "end")]
    rows = corpus + [(600, "x " + "w1 " * 25 + "y", "s"), (601, "w1 " * 9, "s"), (602, items[0][1].replace(" ", "--").upper() + " tail", "s"), (603, "pad " * 20_000 + items[0][1] + " pad" * 20_000, "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in op09_decontam.report(Work(spark, "t9"), docs, bench).collect())
    words = lambda t: WORD.findall((t or "").translate(AZ))
    want, dirty = Counter(), 0
    for i, t, _ in rows:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids |= {str(item)} if item is not None else set()
        dirty += bool(hit)
        want[i, len(w), len(hit), tuple(sorted(ids))] += 1
    assert got == want
    clean = op09_decontam.drop_contaminated(Work(spark, "t9"), docs, bench)
    assert clean.count() == len(rows) - dirty and clean.columns == docs.columns
    assert op09_decontam.report(Work(spark, "t9"), docs, bench.limit(0)).where("contaminated").isEmpty()
    assert op09_decontam.report(Work(spark, "t9"), docs.limit(0), bench).count() == 0


def test_near_items_equal_brute_force(spark, corpus):
    items = [(1, " ".join(corpus[3][1].split()[:12])), (2, "w1 w2 w3"), (3, "absent w2"), (4, None), (5, "shared"), (6, "w5 w5 w6 w5"), (1, "end line")]
    rows = [(i, t, s) for i, t, s in corpus if i is not None and i != 205] + [(700, "w3 x x x w1 x x x x x w2", "s"), (701, "w1 " + "x " * 30 + "w2 w3", "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    work = Work(spark, "t9")
    index = op09_decontam.Index(work, docs, bench)
    words = lambda t: WORD.findall((t or "").translate(AZ))
    cf = Counter(w for _, t, _ in rows for w in words(t))
    for terms, slack in ((3, 10), (2, 4)):
        want = defaultdict(lambda: [set(), 0])
        for item, text in items:
            rare = sorted(set(words(text)), key=lambda w: (cf[w], w))[:terms]
            for i, t, _ in rows if rare and all(cf[w] for w in rare) else ():
                w = words(t)
                n = sum(1 for p, x in enumerate(w) if x == rare[0] and all(any(w[q] == r for q in range(max(0, p - slack), min(len(w), p + slack + 1))) for r in rare))
                if n:
                    want[i][0].add(str(item))
                    want[i][1] += n
        got = {r.doc_id: (r.item_ids, r.places) for r in op09_decontam.near_items(work, index, terms, slack).collect()}
        assert got == {i: (sorted(ids), n) for i, (ids, n) in want.items()} and got
    # The index stays for the exact windows.
    exact = op09_decontam.contamination(work, docs, bench, index=index)
    assert exact.count() == op09_decontam.report(Work(spark, "t9"), docs, bench).where("contaminated").count() and index.postings.count() > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b"), (2, "b a"), (3, "a x x x x b"), (4, "a")], "doc_id long, text string")
    terms = spark.createDataFrame([("a",), ("b",)], "token string")
    postings = op09_decontam.build_postings(Work(spark, "t9"), docs, terms)
    assert {r.doc_id for r in op09_decontam.proximity(postings, ["a", "b"], 3).collect()} == {1, 2}


# -- 10 ----------------------------------------------------------------------------------


def brute_lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    n = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and n[key(x)] >= least)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_equals_brute_force(spark, corpus):
    rows = corpus + [(700 + i, f"dup\xa0\nÉTÉ\n{'z' * 20_000}", "s") for i in range(10)]
    docs = docs_of(spark, rows)
    index = op10_lines.build_index(Work(spark, "t10"), docs)
    want = brute_lines(rows)
    got = Counter(tuple(r) for r in op10_lines.line_report(docs, index).collect())
    assert got == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want)
    cleaned = op10_lines.drop_lines(docs, index)
    assert cleaned.columns == docs.columns and cleaned.dtypes == docs.dtypes
    texts = Counter((r.doc_id, r.text, r.n_chars) for r in cleaned.collect())
    assert texts == Counter((i, None if t is None else new, None if t is None else len(new)) for (i, t, _), (_, _, _, new) in zip(rows, want))
    empty = op10_lines.build_index(Work(spark, "t10"), docs.limit(0))
    assert op10_lines.line_report(docs.limit(0), empty).count() == 0 and op10_lines.line_report(docs, empty).where("n_dropped > 0").isEmpty()


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(1).integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    h[1:3] = h[0]
    h[1, 1], h[2, 1] = 5, 6
    sizes, bits = op10_lines.perfect_hash(h)
    shard = op10_lines.Shard(sizes, bits, b"", b"")
    assert sorted(shard.slot(h)) == list(range(5000))
    assert len(bits) < 5000 and (op10_lines.Shard([], b"", b"", b"").count(h) == 0).all()


def test_lines_in_fifty_shards_are_read_once_a_pass(spark, corpus, monkeypatch):
    docs = docs_of(spark, corpus)
    keys = len({x.strip(" \t\n\x0b\x0c\r").translate(AZ) for _, t, _ in corpus for x in (t or "").split("\n")} - {""})
    index = op10_lines.build_index(Work(spark, "t10"), docs, shard_keys=max(1, keys // 60))
    assert index.shards["often"] >= 1 and sum(index.shards.values()) >= 50
    got = Counter(tuple(r) for r in op10_lines.line_report(docs, index).collect())
    assert got == Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(corpus))
    texts = [None if t is None else t.encode() for _, t, _ in corpus]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7], pa.binary())], ["text"]) for i in range(0, len(texts), 7)]
    for least, tiers in ((10, ("often",)), (1, ("often", "rest"))):
        count = index.reader(least)
        found = [n for held in op10_lines._held(iter(batches)) for _, ns in op10_lines.probe(held, 0, count, 1) for n in ns]
        assert count.reads <= sum(index.shards[t] for t in tiers) and len(found) == len(corpus)
    # Every distinct line is in the index, with its count.
    n = Counter(k for t in texts for k in {op10_lines.line_key(x) for x in (t or b"").split(b"\n")})
    assert [x.tolist() for x in found] == [[n[k] if (k := op10_lines.line_key(x)) else 0 for x in (t or b"").split(b"\n")] for t in texts]
    monkeypatch.setattr(op10_lines, "HELD_BYTES", 1)
    assert sum(1 for _ in op10_lines._held(iter(batches))) == len(batches)
    counted = op10_lines.with_counts(docs, index, "found").collect()
    assert sorted((r.text or "", tuple(r.found)) for r in counted) == sorted(((t or b"").decode(), tuple(x.tolist())) for t, x in zip(texts, found))


@pytest.mark.parametrize("hot_rows", [3, 1000])
def test_warc_without_a_broadcast_equals_with(spark, monkeypatch, hot_rows):
    """Digests by the thousand: hot ones are decided first and their rows spread; nothing is decided otherwise."""
    page = lambda i: "many copies " * 20 if i % 3 else f"pair {i // 6} " * 30
    rows = [(i, f"u{i}", page(i)) for i in range(120)] + [(None, "u", page(1)), (None, "v", None), (5, "again", page(5)), (500, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = lambda: sorted(map(str, op02_warc.to_records(Work(spark, "t"), pages, F.col("page_id"), F.col("url"), F.col("html")).collect()))
    want = made()
    monkeypatch.setattr(op02_warc, "BROADCAST_DIGESTS", 2)
    monkeypatch.setattr(op02_warc, "HOT_ROWS", hot_rows)
    assert made() == want and sum("revisit" in r for r in want) > 80


def test_decontamination_without_broadcasts_equals_with(spark, monkeypatch, corpus):
    """Sides whose texts are too long to be broadcast are shuffled, with the same result."""
    items = [(f"i{k}", " ".join(WORD.findall((t or "").translate(AZ))[3:40])) for k, (_, t, _) in enumerate(corpus[60:90])]
    docs, benchmark = docs_of(spark, corpus), spark.createDataFrame(items, "item_id string, text string")
    made = lambda: sorted(map(str, op09_decontam.report(Work(spark, "t"), docs, benchmark).collect()))
    want = made()
    monkeypatch.setattr(op09_decontam, "BROADCAST_BYTES", 10)
    assert made() == want and sum("contaminated=True" in r for r in want) > 20


def test_blocks_of_long_documents_are_small(spark, monkeypatch, corpus):
    """Blocks bounded by their shingles find the same components; no block holds many long sets."""
    rng = np.random.default_rng(11)
    base = [f"x{k}" for k in rng.integers(0, 5000, 3000)]
    long = []
    for i in range(40):
        w = list(base)
        for j in rng.integers(0, len(w), int(rng.integers(0, 500))):
            w[j] = f"y{rng.integers(0, 9999)}"
        long.append((1000 + i, " ".join(w), "s"))
    docs = docs_of(spark, corpus + long)
    made = lambda: sorted(map(str, op08_near.components(Work(spark, "t"), docs, words=2).collect()))
    want = made()
    monkeypatch.setattr(op08_near, "BLOCK_SHINGLES", 2000)
    assert made() == want
    members = spark.createDataFrame([(1, i, i % 3, 1000) for i in range(60)], "leader long, rep long, label long, n_shingles long")
    sizes = spark.createDataFrame([(i, 1000) for i in range(60)], "rep long, n_shingles long")
    counted = op08_near._counted(Work(spark, "t"), members, "t")
    blocks = op08_near._blocks(counted, sizes, op08_near.OUTSIDE, op08_near.MEMBERS).groupBy("ub", "mb", "asks").agg(F.sum("n_shingles").alias("s"))
    assert counted.first().s_all == 60_000 and counted.first().s_out == 40_000 and blocks.agg(F.max("s")).first()[0] <= 8000
