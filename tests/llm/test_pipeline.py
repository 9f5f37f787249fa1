"""The pipeline on the smallest tables: shapes, effects, and the guard around it."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_ops import AZ, SPACE, WORD, brute_components, brute_lines, brute_toxicity, fill

import __spark_entry__
import corpus_pipeline
from fathomry.llm import op03_mix, op06_toxic

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.dtypes == kinds, name
        assert docs.count() <= before
        before = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns == [*docs.columns, "repetition"]
    assert mixed.select("doc_id").distinct().join(docs, "doc_id", "left_anti").isEmpty()
    assert mixed.where("repetition > 1").isEmpty()
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, whole.select("doc_id", "repetition").collect())) == sorted(map(str, mixed.select("doc_id", "repetition").collect()))


def brute_pipeline(docs, labels, items):
    """(doc_id, text, repetition) rows: every stage by plain Python over (doc_id, text, source) rows with unique ids.

    Whole texts have more n-grams than the classifier has slots, so its features here are slots too.
    """
    toxic = {}
    for i, y in labels:
        if i is not None and y is not None:
            toxic[i] = max(toxic.get(i, 0), y)
    known = {i: y for i, y in toxic.items() if zlib.crc32(str(i).encode()) % 5}
    train = [(t, known[i]) for i, t, _ in docs if i in known]
    scores, _ = brute_toxicity(train, np.mean(list(known.values())), [t for _, t, _ in docs], lambda t: set(op06_toxic.slots(t).tolist()))
    docs = [d for d, s in zip(docs, scores) if s < 0.5]
    docs = [(i, None if t is None else new, s) for (i, t, s), (_, _, _, new) in zip(docs, brute_lines(docs))]
    first = {i: c for i, _, c in brute_components(docs, 5)}
    docs = [d for d in docs if first[d[0]] == d[0]]
    words = lambda t: WORD.findall((t or "").translate(AZ))
    windows = defaultdict(set)
    for t in items:
        w = words(t)
        n = min(10, len(w))
        windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    clean = []
    for d in docs:
        w = words(d[1])
        if not any(tuple(w[k : k + n]) in found for n, found in windows.items() if n for k in range(len(w) - n + 1)):
            clean.append(d)
    size = lambda t: len(SPACE.findall(t or ""))
    by = defaultdict(list)
    for d in clean:
        by[d[2]].append(d)
    names = sorted(s for s in by if s is not None) + [s for s in by if s is None]
    sizes = [sum(size(t) for _, t, _ in by[s]) for s in names]
    out = Counter()
    for s, n, target in zip(names, sizes, fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])):
        whole = math.floor(target / n) if n else 0
        before = 0
        for _, i, t in sorted((int(hashlib.md5(f"17|{i}|{t or ''}".encode()).hexdigest()[:15], 16), i, t) for i, t, _ in by[s]):
            taken = whole + (before + size(t) / 2 <= target - whole * n)
            before += size(t)
            out += Counter((i, t, k) for k in range(taken))
    return out


def test_run_equals_brute_force(spark):
    table = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").collect()
    want = brute_pipeline([(r.doc_id, r.text, r.source) for r in table("documents")], [(r.doc_id, r.toxic) for r in table("labels")], [r.text for r in table("benchmark")])
    got = Counter((r.doc_id, r.text, r.repetition) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    from pyspark.sql import functions as F

    long = "many words " * 20_000
    rows = [(1, "plain text of one", "s1"), (1, "plain text of one", "s1"), (2, None, None), (3, "", "s2"), (4, long, "s1"), (None, "no id here", "s1"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "s2"), (6, "rare\nline " * 3, None)]
    rows += [(10 + i, f"Common line\nown words {i} " + "x " * i, "s3") for i in range(12)]
    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("text_hash", "repetition", "rep", "label", "key", "bucket", "size", "score", "toxic", "item", "h", "count"):
        docs = docs.withColumn(name, F.lit("clash"))
    inner = ["score", "doc_id", "hash", "h", "row", "repeats", "times", "part", "place", "before", "id", "i", "first", "same", "rest", *op03_mix._ASKED]
    docs = docs.select("*", *[F.lit(f"clash {k}").alias(f"__{c}") for k, c in enumerate(inner)])
    spark.createDataFrame([(1, 1, 0), (3, 0, 1), (4, None, None), (10, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            want = [c for c in docs.columns if c != "repetition"] + ["repetition"] if name == "mixing" else docs.columns
            assert out.columns == want, name
            got = out.count()
            assert got <= table.count() * 2 if name == "mixing" else got <= table.count(), name
            assert out.where(" OR ".join(f"__{c} <> 'clash {k}' OR __{c} IS NULL" for k, c in enumerate(inner))).isEmpty(), name
    lines = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert lines[12] == "own words 2 x x " and lines[2] is None and lines[3] == ""
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).where("doc_id = 5").isEmpty()
    near = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert near.where("doc_id = 1").count() == 1 and near.where("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("kind", ["no labels", "other documents", "one class", "null labels", "all too long"])
def test_toxicity_keeps_all_without_a_classifier(spark, tmp_path, monkeypatch, kind):
    rows = [(i, f"text {i} of some length", "en", "s", 1) for i in range(200)] + [(None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = {"no labels": [], "other documents": [(1000 + i, 1, i % 2) for i in range(50)], "one class": [(i, 1, 1) for i in range(200)], "null labels": [(i, 1, None) for i in range(200)], "all too long": [(i, 1, i % 2) for i in range(200)]}[kind]
    if kind == "all too long":
        monkeypatch.setattr(op06_toxic, "MAX_TRAIN_BYTES", 10)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == 201


def test_toxicity_passes_over_a_training_text_that_does_not_fit(spark, tmp_path, monkeypatch):
    """A text above the bound, wherever it stands in the order, leaves the others to be trained on."""
    bad = lambda i: i % 4 == 0
    rows = [(i, (f"vile filthy slur number {i} " if bad(i) else f"kind quiet words number {i} ") * 3, "en", "s", 1) for i in range(240)]
    monkeypatch.setattr(op06_toxic, "MAX_TRAIN_BYTES", 60_000)
    for k in (1, 7, 100):
        rows[k] = (k, "long innocent words " * 5000, "en", "s", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(bad(i) and i != 100)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stay = {r.doc_id for r in corpus_pipeline.toxicity(spark, docs, str(tmp_path)).collect()}
    assert stay >= {i for i in range(240) if not bad(i)} and not stay & {i for i in range(240) if bad(i) and i != 100}
