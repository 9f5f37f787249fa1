"""Readers and writers, round trip."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from fathomry.sources import archives, files, tfrecord, trec


def write(path, text):
    path.write_text(text)
    return str(path)


def test_jsonl_and_map(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"id": "1", "text": "x"}\n{"id": "2", "text": null}\n{"id": "1", "text": "y"}\n')
    got = files.read_jsonl(spark, str(tmp_path), "id string, text string", F.col("text").isNotNull(), "*.jsonl")
    assert sorted(r.text for r in got.collect()) == ["x", "y"]
    assert {r.id: r.text for r in files.read_jsonl_map(spark, str(tmp_path), "id string, text string").collect()} == {"1": "y", "2": None}


def test_tsv_collection_queries_and_dispatch(spark, tmp_path):
    p = write(tmp_path / "c.tsv", "1\tT\tbody\n")
    assert files.read_collection(spark, p).first().asDict() == {"text_id": "1", "title": "T", "text": "body"}
    assert files.read_queries(spark, write(tmp_path / "q.txt", "7\twhy\n")).first().text == "why"
    assert files.read_by_suffix(spark, write(tmp_path / "h.tsv", "a\tb\n1\t2\n")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        files.read_by_suffix(spark, "x.csvx")


def test_whole_json_and_class_map(spark, tmp_path):
    p = write(tmp_path / "w.json", json.dumps({"data": [{"a": 1}, {"a": 2}]}, indent=1))
    assert [r.a for r in files.read_whole_json(spark, p, "data array<struct<a: int>>").collect()] == [1, 2]
    assert [(r.label, r.class_index) for r in files.read_class_map(spark, write(tmp_path / "m.txt", "cat\ndog\n")).collect()] == [("cat", 0), ("dog", 1)]


def test_runs_and_qrels(spark, tmp_path):
    run = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 2.0)], "qid string, did string, score double")
    trec.write_run(run, str(tmp_path / "run"))
    back = trec.read_run(spark, str(tmp_path / "run"), unique=True)
    assert [(r.did, r.score) for r in back.orderBy("position").collect()] == [("b", 2.0), ("a", 1.0)]
    assert trec.read_run(spark, write(tmp_path / "three", "q\tz\t0.5\n")).first().score == 0.5
    with pytest.raises(Exception, match="wrong number of fields"):
        trec.read_run(spark, write(tmp_path / "bad", "q z\n")).collect()
    with pytest.raises(Exception, match="document twice"):
        trec.read_trec_qrels(spark, write(tmp_path / "dup", "q 0 a 1\nq 0 a 2\n")).collect()
    with pytest.raises(Exception, match="isn't 1"):
        trec.read_trec_qrels(spark, write(tmp_path / "two", "q 0 a 2\n"), only_ones=True).collect()
    beir = trec.read_beir_qrels(spark, write(tmp_path / "beir.tsv", "query-id\tcorpus-id\tscore\nq\ta\t0\nq\ta\t2\n"))
    assert [tuple(r) for r in beir.collect()] == [("q", "a", 2)]
    assert trec.positives(beir, 1).first().dids == ["a"]
    trec.write_beir_qrels(beir, str(tmp_path / "out"))
    assert [r.rel for r in trec.read_beir_qrels(spark, str(tmp_path / "out")).collect()] == [1]


def tar(path, members):
    with tarfile.open(path, "w:gz" if str(path).endswith("gz") else "w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_tar_zip_members(spark, tmp_path):
    inner = tar(tmp_path / "in.tar", {"z/deep.png": b"deep"})
    path = tar(tmp_path / "a.tar.gz", {"x/1.png": b"one", "x/2.txt": b"two", "in.tar": open(inner, "rb").read()})
    rows = archives.read_archive(spark, path)
    assert {r["name"]: bytes(r.content) for r in rows.collect()} == {"x/1.png": b"one", "x/2.txt": b"two", "z/deep.png": b"deep"}
    ids = spark.createDataFrame([("1.png",)], "id string")
    assert [r.id for r in archives.members_of(rows, ids).collect()] == ["1.png"]
    assert archives.read_members(rows, spark.createDataFrame([("x/2.txt",), ("no",)], "name string")).where("text IS NULL").first()["name"] == "no"
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("p/q.json", "{}")
    assert [r["name"] for r in archives.read_archive(spark, str(tmp_path / "b.zip"), r"\.json$").collect()] == ["p/q.json"]
    assert {r.label for r in archives.read_image_tar(spark, path).collect()} == {"x", "z"}


def test_shards(spark, tmp_path):
    tar(tmp_path / "s-000.tar", {"k1.jpg": b"i1", "k1.cls": b"3", "k1.json": b'{"alt": -1}', "k2.jpg": b"i2", "k2.cls": b"4", "k2.json": b'{"alt": 8}'})
    (tmp_path / "s-001.tar").write_bytes(b"not a tar at all" * 100)
    pattern = str(tmp_path / "s-{000..001}.tar|2")
    assert {r.key: r.label for r in archives.read_shards(spark, pattern).collect()} == {"k1": 3, "k2": 4}
    assert {r.key: r.label for r in archives.read_shards(spark, pattern, alt_label="alt").collect()} == {"k2": 8}
    assert archives.expand("a-{08..10}.tar::b-{x,y}.tar|50") == (["a-08.tar", "a-09.tar", "a-10.tar", "b-x.tar", "b-y.tar"], 50)


def test_image_folder_and_pdfs(spark, tmp_path):
    for name in ("c10/a.png", "c2/b.JPG", "c2/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = {r.label: r.class_index for r in files.read_image_folder(spark, str(tmp_path)).collect()}
    assert got == {"c2": 0, "c10": 1}
    (tmp_path / "d.pdf").write_bytes(b"%PDF /Type /Pages /Type /Page /Type/Page")
    assert files.read_pdfs(spark, str(tmp_path)).first().pages == 2


def test_dataset_and_batches(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, None)], "batch_id int, text string")
    assert files.write_dataset(df, str(tmp_path / "d"), name="n") == 2
    meta = next((tmp_path / "d/metadata").glob("part*"))
    assert files.row_count(df.limit(0), str(meta)) == 2 and files.row_count(df, str(tmp_path / "none")) == 2
    files.write_batches(df, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("batch_id=*")) == ["batch_id=0", "batch_id=1"]
    files.write_predictions(df, str(tmp_path / "p"), "csv")
    assert spark.read.csv(str(tmp_path / "p"), header=True).count() == 2


def test_parquet_rows_and_figures(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "train"))
    rows = files.read_parquet_rows(spark, str(tmp_path / "train"))
    assert sorted((r.id, r.doc_id) for r in rows.collect()) == [(0, 0), (1, 1), (2, 2)]
    nested = spark.createDataFrame([([("c", [("i",)]), ("d", [("j",), ("k",)]), ("e", [])],)], "caption_images array<struct<caption: string, cil_pairs: array<struct<image: string>>>>")
    assert [(r.figure, r.caption, r.image) for r in files.read_figures(nested).collect()] == [(0, "c", "i")]


def test_rolled_files_end_at_the_bound(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * 90, None) for i in range(100)], "id int, text string, more string").coalesce(1)
    files.write_rolled_jsonl(df, str(tmp_path / "r"), 1000)
    sizes = [p.stat().st_size for p in (tmp_path / "r").glob("*.jsonl")]
    assert len(sizes) > 5 and max(sizes) < 1000 + 150
    assert files.read_jsonl(spark, str(tmp_path / "r"), "id int, text string, more string").count() == 100
    assert '"more":null' in next((tmp_path / "r").glob("*.jsonl")).read_text()


def test_archives_read_only_the_members_asked_for(spark, tmp_path):
    df = spark.createDataFrame([("a.tar.gz" if i % 2 else "b.tar.gz", f"d/{i}.png", bytes([i]) * 10) for i in range(20)], "archive string, name string, content binary")
    archives_path = str(tmp_path / "x")
    files.write_archives(df.repartition(3), archives_path, F.col("archive"), F.col("name"), F.col("content"))
    ids = spark.createDataFrame([("3.png",), ("8.png",), ("none",), (None,)], "id string")
    got = archives.read_archive(spark, archives_path, ids=ids).collect()
    assert {(r["name"], bytes(r.content)) for r in got} == {("d/3.png", b"\x03" * 10), ("d/8.png", b"\x08" * 10)}
    reader = archives.ArchiveReader({"path": archives_path})
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [10, 10]
    assert archives.read_archive(spark, archives_path, ids=ids.limit(0)).count() == 0


def test_pages_in_compressed_object_streams(tmp_path):
    import zlib

    packed = zlib.compress(b"1 0 << /Type /Page >> 2 40 << /Type/Page/Parent 3 0 R >> << /Type /Pages >>")
    pdf = b"%PDF-1.5\n<< /Type /Page >>\n5 0 obj << /Type /ObjStm /N 2 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\n6 0 obj << /ObjStm >> stream\nnot zlib"
    assert files.count_pages(pdf) == 3 and files.count_pages(b"") == 0


def test_damaged_metadata_warns_and_counts(spark, tmp_path):
    df = spark.range(3)
    with pytest.warns(UserWarning, match="damaged"):
        assert files.row_count(df, write(tmp_path / "m.json", "{broken")) == 3
    assert files.row_count(df, str(tmp_path / "none")) == 3


def test_class_maps_and_split_folders(spark, tmp_path):
    assert {r.label: r.class_index for r in files.class_map(spark, {"a": 1, "b": 0}).collect()} == {"a": 1, "b": 0}
    with pytest.raises(ValueError):
        files.class_map(spark, "x.pkl")
    (tmp_path / "training").mkdir()
    assert files.split_folder(str(tmp_path), "train[:5%]").endswith("/training") and files.split_folder(str(tmp_path), "val") == str(tmp_path)


def test_tfrecords(spark, tmp_path):
    crc = tfrecord.masked_crc(b"123456789")
    crc = (crc - 0xA282EAD8) & 0xFFFFFFFF
    assert (crc >> 17 | crc << 15) & 0xFFFFFFFF == 0xE3069283  # the published check value of CRC-32C
    message = tfrecord.encode_example({"a": [1, -2, 1 << 40], "b": ["x", "\u00e9"], "c": [0.5], "d": []})
    assert tfrecord.decode_example(message) == {"a": ([], [], [1, -2, 1 << 40]), "b": ([b"x", "\u00e9".encode()], [], []), "c": ([], [0.5], []), "d": ([], [], [])}
    loose = b"\x0a\x10\x0a\x0e\x0a\x01k\x12\x09\x1a\x07\x08\x05\x08\xac\x02\x08\x01"  # integers that aren't packed
    assert tfrecord.decode_example(loose)["k"][2] == [5, 300, 1]
    (tmp_path / "x.tfrecord").write_bytes(tfrecord.record(message) * 3)
    assert [r.row for r in tfrecord.read_tfrecords(spark, str(tmp_path), check=True).collect()] == [0, 1, 2]
    (tmp_path / "x.tfrecord").write_bytes(tfrecord.record(message)[:-6] + b"zz" + tfrecord.record(message)[-4:])
    with pytest.raises(Exception, match="damaged at record 0"):
        tfrecord.read_tfrecords(spark, str(tmp_path / "x.tfrecord"), check=True).collect()
    (tmp_path / "x.tfrecord").write_bytes(b"")
    assert tfrecord.read_tfrecords(spark, str(tmp_path)).count() == 0


def test_small_tfrecord_files_share_tasks(spark, tmp_path):
    tfrecord.write_tfrecords(spark.range(600).select("id", F.when(F.col("id") % 7 > 0, F.lit("\u00e9")).alias("text")).repartition(4), str(tmp_path / "d"), 100)
    rows = tfrecord.read_tfrecords(spark, str(tmp_path / "d"), check=True)
    assert len(list((tmp_path / "d").iterdir())) > 100 and rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = rows.collect()
    assert sorted((r.features["id"].ints[0], [bytes(b) for b in r.features["text"].bytes]) for r in got) == [(i, ["\u00e9".encode()] if i % 7 else []) for i in range(600)]
    assert len({(r.file, r.row) for r in got}) == 600 and all(r.file.endswith(".tfrecord") for r in got)
    packed = [p.paths for p in tfrecord._packed([("a", 1), ("b", 1 << 30), ("c", 1), ("d", 2)], 1)]
    assert packed == [["a"], ["b"], ["c", "d"]]


def test_tfrecords_of_documents_without_text(spark, tmp_path):
    from fathomry import plans

    rows = [(1, "x", 1), (2, None, None), (3, "", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in plans.QUERIES["tfrecord_scan"](spark, str(tmp_path)).collect()) == [(1, "x", 1.0), (2, None, None), (3, "", 0.0)]


def test_members_are_read_from_their_places_by_several_tasks(spark, tmp_path):
    import io
    import tarfile

    def tar(members):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, data in members:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
        return out.getvalue()

    deep = tar([("d.png", b"deep")])
    inner = tar([(f"x/{i}.png", bytes([i]) * 1000 * i) for i in range(40)] + [("again.tar", deep), ("empty", b"")])
    long_name = "n" * 300 + ".txt"
    (tmp_path / "a.tar").write_bytes(tar([("first.txt", b"1"), ("in.tar", inner), (long_name, b"2" * 5000)]))
    (tmp_path / "b.tar").write_bytes(tar([]))
    want = {(f"in.tar/x/{i}.png", bytes([i]) * 1000 * i) for i in range(40)} | {("in.tar/empty", b""), ("first.txt", b"1"), (long_name, b"2" * 5000)}
    for depth, more in ((1, {("in.tar/again.tar", deep)}), (2, {("in.tar/again.tar/d.png", b"deep")}), (0, None)):
        index = archives.member_index(spark, f"file://{tmp_path}", nesting=depth)
        rows = archives.read_places(index, 1 << 16)
        got = {(r["name"], bytes(r.content)) for r in rows.collect()}
        assert got == (want | more if more else {("first.txt", b"1"), ("in.tar", inner), (long_name, b"2" * 5000)})
        assert all(r.size == len(r.content) for r in rows.collect())
    parts = archives.read_places(archives.member_index(spark, f"file://{tmp_path}/a.tar"), 1 << 16).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
    assert {r["name"] for r in archives.read_places(archives.member_index(spark, f"file://{tmp_path}", r"x/1\d\.png$")).collect()} == {f"in.tar/x/{i}.png" for i in range(10, 20)}
    whole = (tmp_path / "a.tar").read_bytes()
    index = archives.member_index(spark, f"file://{tmp_path}/a.tar").cache()
    assert index.count() == 44
    (tmp_path / "a.tar").write_bytes(whole[:100_000])
    with pytest.raises(Exception, match="ends within"):
        archives.read_places(index).collect()


def test_pages_are_counted_by_the_page_tree():
    """Cross-reference tables and streams, updates, nested page trees, indirect counts, unused pages; damage falls back to page objects."""
    import zlib

    from fathomry.plans.files import pdf_of
    from fathomry.sources.pdf import count_pages, unpredicted, value_at

    for n in (0, 1, 7):
        for packed in (False, True):
            assert count_pages(pdf_of(n, b"text /Type /Page ", packed, 3)) == n
    old = pdf_of(3, b"x")
    root = b"2 0 obj\n<< /Type /Pages /Kids [3 0 R 90 0 R] /Count 91 0 R >>\nendobj\n"
    more = b"90 0 obj\n<< /Type /Pages /Kids [4 0 R 5 0 R] /Count 2 /Parent 2 0 R >>\nendobj\n91 0 obj\n5\nendobj\n"
    at, place = len(old), old.rindex(b"xref", 0, old.rindex(b"startxref"))
    update = root + more + b"xref\n2 1\n%010d 00000 n\r\n90 2\n%010d 00000 n\r\n%010d 00000 n\r\n" % (at, at + len(root), at + len(root) + more.index(b"91 0 obj"))
    update += b"trailer\n<< /Size 92 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (place, at + len(root) + len(more))
    assert count_pages(old + update) == 5  # what the newest tree says
    assert count_pages(old[: old.rindex(b"xref", 0, old.rindex(b"startxref"))]) == 4  # no sections: all page objects
    assert count_pages(old.replace(b"/Pages 2 0 R", b"/Pages 77 0 R")) == 4 and count_pages(b"") == 0 and count_pages(b"startxref\n99999\n") == 0
    circle = old.replace(b"/Count 3", b"/Count 2 0 R")
    assert count_pages(circle) == 4
    assert value_at(b" << /A [1 2.5 (a\\)(b)) <0A> 7 0 R true null] /B<</C/D>> >>", 0)[0] == {b"/A": [1, 2.5, b"a\\)(b)", b"0A", 7, True, None], b"/B": {b"/C": b"/D"}}
    rows = [bytes([9, 200, 30]), bytes([10, 1, 255]), bytes([0, 0, 7]), bytes([250, 3, 4]), bytes([5, 6, 7])]
    packed, above = b"", bytes(3)
    for kind, row in enumerate(rows):
        guess = []
        for i in range(3):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            near = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            guess.append((0, left, up, (left + up) // 2, near)[kind])
        packed += bytes([kind]) + bytes((x - g) & 255 for x, g in zip(row, guess))
        above = row
    assert unpredicted(packed, 3) == b"".join(rows)


def test_splits_are_planned_from_the_description():
    from fathomry.sources import splits as P

    info = {"splits": {"train": {"name": "train", "filenames": ["d-train-0.tar", "d-train-1.tar", "d-train-2.tar"], "shard_lengths": [10, 5, 20], "num_samples": 35}, "val": {"name": "val", "filenames": ["v.tar"], "shard_lengths": [4], "num_samples": 4, "alt_label": "alt"}}}
    assert P.plan(info, "train") == [("d-train-0.tar", 0, 10), ("d-train-1.tar", 0, 5), ("d-train-2.tar", 0, 20)]
    assert P.plan(info, "train[8:16]") == [("d-train-0.tar", 8, 10), ("d-train-1.tar", 0, 5), ("d-train-2.tar", 0, 1)]
    assert P.plan(info, "train[-3:]+val[:50%]") == [("d-train-2.tar", 17, 20), ("v.tar", 0, 2)] and P.plan(info, "train[5:5]") == []
    assert P.plan(info, "train[40%:60%]") == [("d-train-1.tar", 4, 5), ("d-train-2.tar", 0, 6)]
    whole = [n for s in P.even_parts("train", 4, 35) for f, a, b in P.plan(info, s) for n in [(f, i) for i in range(a, b)]]
    assert len(whole) == len(set(whole)) == 35 and P.even_parts("train", 4, 35) == ["train[0:9]", "train[9:18]", "train[18:26]", "train[26:35]"]
    assert P.find_split(info, "val").alt_label == "alt" and P.find_split(info, "x-{0..2}.tar|99") == P.Split("", ("x-0.tar", "x-1.tar", "x-2.tar"), (), 99)
    assert P.plan(info, "x-{0..1}.tar") == [("x-0.tar", 0, -1), ("x-1.tar", 0, -1)]
    for bad in ("test", "train[1:2", "nothing[:3]"):
        with pytest.raises(ValueError):
            P.plan(info, bad)
    shards = P.plan(info, "train")
    assert [P.worker_plan(shards, w, 2) for w in (0, 1)] == [[shards[0], shards[2]], [shards[1]]] and P.worker_plan(shards, 0, 1) == shards
    assert P.samples_per_worker(35, 4) == 8 and P.samples_per_worker(35, 4, 2) == 9 and P.samples_per_worker(35, 4, 1, 8, True) == 16


def test_only_planned_samples_are_read(spark, tmp_path):
    from fathomry.sources import splits as P

    for shard in range(3):
        members = {f"{shard}-{i}.{e}": (b"%d" % i if e == "cls" else b"img%d" % i) for i in range(shard * 2 + 2) for e in ("jpg", "cls")}
        tar(tmp_path / f"s-{shard}.tar", members)
    info = {"splits": {"train": {"filenames": [f"s-{i}.tar" for i in range(3)], "shard_lengths": [2, 4, 6], "num_samples": 12}}}
    (tmp_path / "_info.json").write_text(json.dumps(info))
    got = P.read_split(spark, str(tmp_path), "train[1:5]").collect()
    assert {(r.key, r.place, r.label, bytes(r.image)) for r in got} == {("0-1", 1, 1, b"img1"), ("1-0", 0, 0, b"img0"), ("1-1", 1, 1, b"img1"), ("1-2", 2, 2, b"img2")}
    assert P.read_split(spark, str(tmp_path), "train[:2]+train[1:3]").count() == 4  # the second sample twice
    assert P.read_split(spark, str(tmp_path), "train[3:3]").isEmpty() and P.read_split(spark, str(tmp_path), "s-{0..2}.tar").count() == 12
    with pytest.warns(UserWarning):
        assert P.read_info(f"{tmp_path}/none") == {}


def test_contents_of_planned_samples_are_not_joined(spark, tmp_path):
    """What is broadcast is the plan alone, whatever the index's size is, and places travel with the members."""
    from fathomry.sources import splits as P

    tar(tmp_path / "s.tar", {f"x/{i}.{e}": b"%d" % i for e in ("cls", "jpg") for i in (3, 1, 2, 0)})
    found = P.read_plan(spark, f"file://{tmp_path}", [("s.tar", 1, 3), ("s.tar", 2, -1)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == plan.count("BroadcastExchange") == 1 and "SortMergeJoin" not in plan
    assert sorted((r.place, r.key, r.label, bytes(r.image)) for r in found.collect()) == [(1, "x/1", 1, b"1"), (2, "x/2", 2, b"2"), (2, "x/2", 2, b"2"), (3, "x/0", 0, b"0")]
    index = archives.member_index(spark, f"file://{tmp_path}/s.tar")
    read = archives.read_places(index.select("size", F.col("offset").alias("from"), "*").drop("size").join(index.select("name", "size"), "name"))
    assert read.columns == ["archive", "name", "size", "content", "from"] and {(r.name, r["from"]) for r in read.collect()} == {(r.name, r.offset) for r in index.collect()}


def test_crc_of_any_length():
    """By lanes as byte by byte, and the published values."""
    import numpy as np

    def slow(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc = crc >> 8 ^ tfrecord._TABLE[(crc ^ b) & 0xFF]
        crc ^= 0xFFFFFFFF
        return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF

    data = np.random.default_rng(3).integers(0, 256, 70_000, dtype=np.uint8).tobytes()
    for n in (0, 1, 31, 32, 255, 256, 257, 288, 511, 512, 513, 1000, 4096, 5555, 65_536, 70_000):
        assert tfrecord.masked_crc(data[:n]) == slow(data[:n])
    unmask = lambda m: (lambda x: (x >> 17 | x << 15) & 0xFFFFFFFF)((m - 0xA282EAD8) & 0xFFFFFFFF)
    assert unmask(tfrecord.masked_crc(bytes(32))) == 0x8A9136AA and unmask(tfrecord.masked_crc(b"\xff" * 32)) == 0x62A8AB43 and unmask(tfrecord.masked_crc(b"123456789")) == 0xE3069283
