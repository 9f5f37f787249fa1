"""Queries that take whole tables and whole texts, of awkward rows."""

import base64
import hashlib

from fathomry.plans import QUERIES

TEXTS = {i: " ".join(f"w{i}x{k}" for k in range(20_000 if i == 6 else 30)) for i in range(1, 9)}


def _documents(spark, root):
    rows = [(i, text, "en", "s", len(text)) for i, text in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return str(root)


def _run(spark, name, root, *key):
    return {tuple(r[k] for k in key): r for r in QUERIES[name](spark, root).collect()}


def test_whole_texts_come_through(spark, tmp_path):
    root = _documents(spark, tmp_path)
    filled, kept = _run(spark, "template_fill", root, "doc_id"), _run(spark, "empty_fallback", root, "doc_id")
    coded, body = _run(spark, "base64_roundtrip", root, "doc_id"), _run(spark, "title_body", root, "doc_id")
    for i, text in TEXTS.items():
        assert filled[i,].prompt == f"Title: s [en] {text}"
        assert kept[i,].text == ("empty document" if i % 5 == 0 else text)
        assert (coded[i,].coded, coded[i,].text) == (base64.b64encode(text.encode()).decode(), text)
        assert body[i,].body == ("" if i % 4 == 0 else "s") + "\t" + text


def test_training_examples_hold_whole_texts(spark, tmp_path):
    found = _run(spark, "training_examples", _documents(spark, tmp_path), "query", "place")
    assert {k: r.passage for k, r in found.items()} == {("Find s", 0): "empty passage", ("Find s", 1): TEXTS[2], ("Find s", 2): "empty passage"}


def test_union_holds_odd_documents(spark, tmp_path):
    root = _documents(spark, tmp_path)
    spark.createDataFrame([(1, "b")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert sorted(_run(spark, "union_shards", root, "doc_id", "origin")) == sorted([*((i, "d") for i in TEXTS), (1, "b")])


def test_positives_of_any_id_are_injected(spark, tmp_path):
    rows = [(i, [1.0, i / 300], i % 2) for i in range(260)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = _run(spark, "inject_positives", str(tmp_path), "qid", "did")
    want = {(q, d) for q in range(0, 260, 10) for d in range(0, 260, 2) if d != q}
    assert {k for k, r in found.items() if r.score == 1000.0} == want


def test_every_pdf_line_comes_back_in_its_place(spark, tmp_path):
    """A row for each page, also for equal ones."""
    spark.createDataFrame([(i, f"u{i}", f"html {i % 3}") for i in (5, 3, 9, 1, 7, 2)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = _run(spark, "pdf_jsonl", str(tmp_path), "line")
    assert {k[0]: r.content for k, r in found.items()} == {n: hashlib.md5(f"html {i % 3}".encode()).hexdigest() for n, i in enumerate((1, 2, 3, 5, 7, 9))}
