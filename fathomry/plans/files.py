"""Round trips through files: every writer and reader over whole tables, in the session's shared folder."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.order import running
from ..functions.store import Work
from ..operators import rows as O
from ..sources import archives as A, files as S, splits as P, trec
from ..sources.tfrecord import write_tfrecords
from .registry import Tables, query


def _folder(t: Tables, name: str) -> str:
    return Work(t.spark, "files").path(name)


def _in_order(df: DataFrame, *keys: str) -> DataFrame:
    """df in files whose names follow the order."""
    return df.repartitionByRange(4, *keys).sortWithinPartitions(*keys)


# -- rows ------------------------------------------------------------------------------


@query("SELECT doc_id, text, source FROM documents WHERE n_chars > 200")
def jsonl_scan(t):
    S.write_jsonl(t.documents, path := _folder(t, "d"))
    return S.read_jsonl(t.spark, path, "doc_id long, text string, source string, n_chars long", F.col("n_chars") > 200).drop("n_chars")


@query("SELECT c_nationkey, max(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey")
def jsonl_last_row_map(t):
    S.write_jsonl(_in_order(t.customer.select("c_custkey", "c_nationkey"), "c_custkey"), path := _folder(t, "m"))
    return S.read_jsonl_map(t.spark, path, "c_custkey long, c_nationkey int", "c_nationkey").select("c_nationkey", "c_custkey")


@query("SELECT p_partkey, p_name, p_type FROM part")
def tsv_scan(t):
    t.part.select("p_partkey", "p_name", "p_type").write.option("sep", "\t").option("header", True).csv(path := _folder(t, "p.tsv"))
    return S.read_by_suffix(t.spark, path, "p_partkey long, p_name string, p_type string")


@query("SELECT p_partkey::VARCHAR AS text_id, p_name AS title, p_type AS text FROM part")
def tsv_collection(t):
    t.part.select("p_partkey", "p_name", "p_type").write.option("sep", "\t").csv(path := _folder(t, "c"))
    return S.read_collection(t.spark, path)


@query("SELECT p_partkey::VARCHAR AS qid, p_name AS text FROM part")
def query_map(t):
    t.part.select("p_partkey", "p_name").write.option("sep", "\t").csv(path := _folder(t, "q"))
    return S.read_queries(t.spark, path)


@query("SELECT s_suppkey, unnest(['jsonl', 'tsv', 'parquet']) AS kind FROM supplier")
def suffix_dispatch(t):
    s, root, out = t.supplier.select("s_suppkey"), _folder(t, "s"), None
    S.write_jsonl(s, f"{root}/a.jsonl")
    s.write.option("sep", "\t").option("header", True).csv(f"{root}/b.tsv")
    s.write.parquet(f"{root}/plain")
    for kind, name in (("jsonl", "a.jsonl"), ("tsv", "b.tsv"), ("parquet", "plain")):
        part = S.read_by_suffix(t.spark, f"{root}/{name}", "s_suppkey long").select("s_suppkey", F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out


@query("SELECT r_regionkey, r_name FROM region")
def memory_scan(t):
    return S.from_memory(t.spark, [r.asDict() for r in t.region.collect()], "r_regionkey int, r_name string")


@query("SELECT doc_id, lang FROM documents")
def training_glob(t):
    d = t.documents.select("doc_id", "lang")
    S.write_jsonl(d, path := _folder(t, "g"))
    d.select(F.lit("not a record").alias("value")).write.mode("append").text(path)
    return S.read_jsonl(t.spark, path, "doc_id long, lang string", glob="*.json")


@query("SELECT count(*) AS counted, count(*) AS stated FROM documents")
def dataset_with_metadata(t):
    n = S.write_dataset(t.documents, path := _folder(t, "n"), name="documents")
    stated = S.row_count(t.documents.limit(0), f"{path}/metadata")
    return t.spark.range(1).select(F.lit(n).cast("long").alias("counted"), F.lit(stated).cast("long").alias("stated"))


@query("SELECT doc_id, text, lang FROM documents")
def rolled_jsonl(t):
    S.write_rolled_jsonl(t.documents.select("doc_id", "text", "lang"), path := _folder(t, "r"), 1 << 16)
    return S.read_jsonl(t.spark, path, "doc_id long, text string, lang string")


@query("SELECT l_orderkey, l_linenumber, (l_orderkey % 7)::INTEGER AS batch_id FROM lineitem")
def batch_folders(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 7).cast("int").alias("batch_id"))
    S.write_batches(rows, path := _folder(t, "b"))
    return S.read_jsonl(t.spark, path, "l_orderkey long, l_linenumber int, batch_id int")


@query("SELECT n_nationkey, n_name FROM nation")
def whole_json(t):
    data = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("data"))
    files = data.select(F.concat("n_regionkey", F.lit(".json")).alias("name"), F.to_json(F.struct("data")).alias("json"))
    S.write_files(files, path := _folder(t, "w"), F.col("name"), F.col("json"))
    return S.read_whole_json(t.spark, path, "data array<struct<n_nationkey: int, n_name: string>>")


@query("SELECT c_name AS value FROM customer")
def line_list(t):
    t.customer.select("c_name").write.text(path := _folder(t, "l"))
    return S.read_lines(t.spark, path)


@query("SELECT s_name AS label, row_number() OVER (ORDER BY s_suppkey) - 1 AS class_index FROM supplier")
def class_map_file(t):
    S.write_files(t.supplier.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x.s_name), "\n").alias("x")), path := _folder(t, "k"), F.lit("map.txt"), F.col("x"))
    return S.class_map(t.spark, f"{path}/map.txt")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents")
def parquet_rows(t):
    _in_order(t.documents.select("doc_id"), "doc_id").write.parquet(path := _folder(t, "rows"))
    return S.read_parquet_rows(t.spark, path, "part", "row")


@query("""SELECT doc_id, 0 AS figure, lang AS caption, source AS image FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 1, 'b', source FROM documents WHERE (doc_id + 1) % 3 = 1""")
def nested_figures(t):
    pairs = lambda n: F.slice(F.array(F.struct(F.col("source").alias("image")), F.struct(F.col("lang").alias("image"))), 1, (n % 3).cast("int"))
    figures = F.array(F.struct(F.col("lang").alias("caption"), pairs(F.col("doc_id")).alias("cil_pairs")), F.struct(F.lit("b").alias("caption"), pairs(F.col("doc_id") + 1).alias("cil_pairs")))
    t.documents.select("doc_id", figures.alias("caption_images")).write.parquet(path := _folder(t, "f"))
    return S.read_figures(t.spark.read.parquet(path))


@query("SELECT page_id, html IS NOT NULL AS found FROM pages UNION ALL SELECT -page_id, false FROM pages WHERE page_id > 0")
def store_lookup(t):
    S.write_pages(t.pages.select("page_id", "html"), path := _folder(t, "store"), max_records=100)
    ids = t.pages.select("page_id").union(t.pages.select(-F.col("page_id")).where("page_id > 0"))
    found, missing = S.look_up(t.spark.read.parquet(path), ids, "page_id")
    return found.select("page_id", F.col("html").isNotNull().alias("found")).union(missing.select("page_id", F.lit(False)))


@query("SELECT page_id, md5(html) AS content FROM pages WHERE page_id % 3 = 0")
def sampled_page_images(t):
    store = t.pages.select("page_id", F.base64(F.col("html").cast("binary")).alias("image"))
    S.write_pages(store, path := _folder(t, "pages"))
    found = S.page_images(t.pages.where("page_id % 3 = 0"), t.spark.read.parquet(path), "page_id")
    return found.select("page_id", F.md5("image").alias("content"))


# -- runs and judgements ---------------------------------------------------------------


@query("SELECT o_custkey::VARCHAR AS qid, count(*) AS n FROM orders GROUP BY 1")
def trec_qrels_ones(t):
    t.orders.select(F.concat_ws(" ", "o_custkey", F.lit("0"), "o_orderkey", F.lit("1"))).write.text(path := _folder(t, "qrels"))
    return trec.read_trec_qrels(t.spark, path, only_ones=True).groupBy("qid").agg(F.count("*").alias("n"))


@query("SELECT o_custkey::VARCHAR AS qid, list_sort(list(o_orderkey::VARCHAR)) AS dids FROM orders WHERE o_orderkey % 3 >= 1 GROUP BY 1")
def trec_qrels_threshold(t):
    t.orders.select(F.concat_ws("  ", "o_custkey", F.lit("0"), "o_orderkey", F.col("o_orderkey") % 3)).write.text(path := _folder(t, "qrels"))
    return trec.positives(trec.read_trec_qrels(t.spark, path), 1)


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS did, (o_orderkey % 3)::INTEGER AS rel FROM orders")
def beir_qrels_files(t):
    """Several files with a header each; the first half of the pairs comes twice and the last line counts."""
    rows = t.orders.select(F.col("o_custkey").alias("query-id"), F.col("o_orderkey").alias("corpus-id"), (F.col("o_orderkey") % 3).alias("score"))
    old = rows.where("`corpus-id` % 2 = 0").withColumn("score", F.lit(9))
    path = _folder(t, "beir")
    old.repartition(3).write.option("sep", "\t").option("header", True).csv(f"{path}/1")
    rows.repartition(3).write.option("sep", "\t").option("header", True).csv(f"{path}/2")
    return trec.read_beir_qrels(t.spark, [f"{path}/1", f"{path}/2"])


@query("SELECT o_custkey::VARCHAR AS qid, list_sort(list(o_orderkey::VARCHAR)) AS dids FROM orders GROUP BY 1")
def beir_qrels_positives(t):
    trec.write_beir_qrels(t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("did")), path := _folder(t, "beir"))
    return trec.positives(trec.read_beir_qrels(t.spark, path), 1)


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS did, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
def run_file(t):
    run = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("did"), F.col("o_totalprice").alias("score"))
    trec.write_run(run.repartition("qid"), path := _folder(t, "run"))
    back = trec.read_run(t.spark, path, unique=True)
    return O.place_in(back, ["qid"], ["position"], "place").select("qid", "did", "score", F.col("place").cast("long").alias("place"))


@query("SELECT o_custkey::VARCHAR AS qid, o_orderkey::VARCHAR AS did, o_totalprice AS score FROM orders")
def run_file_three_columns(t):
    t.orders.select(F.concat_ws("\t", "o_custkey", "o_orderkey", "o_totalprice")).write.text(path := _folder(t, "run"))
    return trec.read_run(t.spark, path).select("qid", "did", "score")


# -- binary files and archives ---------------------------------------------------------


@query("SELECT 'page_' || page_id || '.PNG' AS id, md5(html) AS content FROM pages")
def image_scan(t):
    S.write_files(t.pages, path := _folder(t, "img"), F.concat(F.lit("page_"), "page_id", F.lit(".PNG")), F.col("html"))
    S.write_files(t.region, path, F.concat("r_name", F.lit(".txt")), F.col("r_name"))
    return S.read_images(t.spark, path).select("id", F.md5(F.unbase64("image")).alias("content"))


@query("SELECT page_id::VARCHAR || '.txt' AS name, md5(html) AS content FROM pages")
def text_file_per_id(t):
    S.write_files(t.pages, path := _folder(t, "txt"), F.concat(F.col("page_id").cast("string"), F.lit(".txt")), F.col("html"))
    return S.read_binary(t.spark, path, "*.txt").select(F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("content"))


def pdf_of(pages: int, text: bytes, packed: bool = False, spare: int = 1) -> bytes:
    """A small PDF with so many pages, each with the text, and ``spare`` page objects that no page tree holds; packed, its
    objects are in an object stream, found by a cross-reference stream with a PNG predictor."""
    ids = [str(3 + i).encode() for i in range(pages)]
    text = zlib.compress(text)
    page = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>"
    last = 3 + pages + spare
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(i + b" 0 R" for i in ids), pages), *[page % last] * (pages + spare)]
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def add(number: int, body: bytes) -> None:
        places[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    stream = lambda about, data: b"<< %s /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (about, len(data), data)
    add(last, stream(b"", text))
    if not packed:
        for i, body in enumerate(objects, 1):
            add(i, body)
        table = b"xref\n0 %d\n0000000000 65535 f\r\n" % (last + 1) + b"".join(b"%010d 00000 n\r\n" % places[i] for i in range(1, last + 1))
        return bytes(out) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (last + 1, len(out))
    heads, bodies, at = [], b"", 0
    for i, body in enumerate(objects, 1):
        heads.append(b"%d %d" % (i, len(bodies)))
        bodies += body + b"\n"
    head = b" ".join(heads) + b" "
    add(last + 1, stream(b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)), zlib.compress(head + bodies)))
    at = len(out)
    rows = [bytes(7), *((2).to_bytes(1, "big") + (last + 1).to_bytes(4, "big") + i.to_bytes(2, "big") for i in range(len(objects)))]
    rows += [(1).to_bytes(1, "big") + places.get(i, at).to_bytes(4, "big") + bytes(2) for i in (last, last + 1, last + 2)]
    filtered, above = b"", bytes(7)
    for row in rows:  # each row as its difference from the one above
        filtered += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above))
        above = row
    add(last + 2, stream(b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (last + 3), zlib.compress(filtered)))
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at


@query("SELECT 'p' || page_id AS name, (page_id % 5)::INTEGER AS pages FROM pages")
def pdf_pages(t):
    """Every page's text as a PDF of up to four pages, every other one packed, all with a page object that isn't in use."""
    def run(batches):
        for batch in batches:
            yield batch.assign(pdf=[pdf_of(i % 5, (x or "").encode(), i % 2 == 1) for i, x in zip(batch["page_id"], batch["html"])])[["page_id", "pdf"]]

    pdfs = t.pages.select("page_id", "html").mapInPandas(run, "page_id long, pdf binary")
    S.write_files(pdfs, path := _folder(t, "pdf"), F.concat(F.lit("deep/p"), "page_id", F.lit(".pdf")), F.col("pdf"))
    return S.read_pdfs(t.spark, path).select(F.regexp_extract("path", r"(p\d+)\.pdf$", 1).alias("name"), "pages")


@query("SELECT row_number() OVER (ORDER BY page_id) - 1 AS line, md5(html) AS content FROM pages")
def pdf_jsonl(t):
    """A document is named after its file and line. The files are ranges of page ids, in order of their names, so a line's number
    among all is its number in its file and the lines of the files before it."""
    pages = t.pages.select("page_id", F.base64(F.col("html").cast("binary")).alias("pdf"))
    order = F.col("page_id").asc_nulls_last()
    S.write_jsonl(pages.repartitionByRange(order).sortWithinPartitions(order), path := _folder(t, "pj"))
    rows = S.read_pdf_jsonl(t.spark, path).select(F.regexp_extract("name", r"^(.*)_\d+\.pdf$", 1).alias("__part"), F.regexp_extract("name", r"_(\d+)\.pdf$", 1).cast("long").alias("line"), F.md5("pdf").alias("content"))
    return rows.join(F.broadcast(running(rows, F.count("*"), "before")), "__part").select((F.col("line") + F.col("before")).alias("line"), "content")


def _tarred(t: Tables, kind: str, suffix: str) -> str:
    archive = F.concat(F.lit("a"), F.col("page_id") % 6, F.lit(suffix))
    A_name = F.concat(F.lit("c"), F.col("page_id") % 4, F.lit("/p"), "page_id", F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".txt"))
    S.write_archives(t.pages, path := _folder(t, "arc"), archive, A_name, F.col("html"), kind)
    return path


_MEMBER = "'c' || page_id % 4 || '/p' || page_id || CASE WHEN page_id % 2 = 0 THEN '.png' ELSE '.txt' END"


@query(f"SELECT {_MEMBER} AS name, md5(html) AS content FROM pages WHERE page_id % 3 = 0")
def tar_members_in_ids(t):
    ids = t.pages.where("page_id % 3 = 0").select(F.concat(F.lit("p"), "page_id", F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".txt")).alias("id"))
    rows = A.read_archive(t.spark, _tarred(t, "tar", ".tar.gz"), ids=ids)
    return rows.select("name", F.md5("content").alias("content"))


@query(f"SELECT {_MEMBER} AS name, strlen(html) AS size FROM pages WHERE page_id % 2 = 1")
def zip_members(t):
    return A.read_archive(t.spark, _tarred(t, "zip", ".zip"), r"\.txt$").select("name", "size")


@query(f"SELECT {_MEMBER} AS name, html AS text FROM pages UNION ALL SELECT 'none', NULL")
def tar_member_by_name(t):
    rows = A.read_archive(t.spark, _tarred(t, "tar", ".tar"))
    names = rows.select("name").union(t.spark.range(1).select(F.lit("none").alias("name")))
    return A.read_members(rows, names)


@query(f"SELECT {_MEMBER} AS name, 'c' || page_id % 4 AS label, md5(html) AS content FROM pages WHERE page_id % 2 = 0")
def image_tar(t):
    rows = A.read_image_tar(t.spark, _tarred(t, "tar", ".tar"))
    return rows.select("name", "label", F.md5(F.unbase64("image")).alias("content"))


@query("""SELECT 'o' || page_id % 2 AS archive, 'i' || page_id % 6 || '.tar/p' || page_id || '.png' AS name, md5(html) AS content FROM pages
UNION ALL SELECT 'o' || page_id % 2, 'plain' || page_id || '.txt', md5(url) FROM pages WHERE page_id % 5 = 0""")
def nested_tar_index(t):
    """Archives inside archives and members beside them: the offsets of all are a table, and each is read from its place."""
    inner, outer = _folder(t, "inner"), _folder(t, "outer")
    S.write_archives(t.pages, inner, F.concat(F.lit("i"), F.col("page_id") % 6, F.lit(".tar")), F.concat(F.lit("p"), "page_id", F.lit(".png")), F.col("html"), "tar")
    name = F.substring_index("path", "/", -1)
    whole = S.read_binary(t.spark, inner, "*.tar").select(F.concat(F.lit("o"), F.substring(name, 2, 1).cast("int") % 2).alias("a"), name.alias("n"), F.col("content").alias("data"))
    beside = t.pages.where("page_id % 5 = 0").select(F.concat(F.lit("o"), F.col("page_id") % 2), F.concat(F.lit("plain"), "page_id", F.lit(".txt")), F.col("url").cast("binary"))
    S.write_archives(whole.union(beside), outer, F.concat("a", F.lit(".tar")), F.col("n"), F.col("data"), "tar")
    index = Work(t.spark, "files").save(A.member_index(t.spark, outer), "index")
    rows = A.read_places(index, 1 << 16)
    return rows.select(F.regexp_extract("archive", r"([^/]+)\.tar$", 1).alias("archive"), "name", F.md5("content").alias("content"))


@query("SELECT 'c' || page_id % 12 AS label, page_id % 12 AS class_index, count(*) AS n FROM pages GROUP BY 1, 2")
def image_folder(t):
    S.write_files(t.pages, path := _folder(t, "imgs"), F.concat(F.lit("c"), F.col("page_id") % 12, F.lit("/"), "page_id", F.lit(".png")), F.col("html"))
    return S.read_image_folder(t.spark, path).groupBy("label", "class_index").agg(F.count("*").alias("n"))


@query("SELECT page_id::VARCHAR AS key, (page_id % 9 - 2)::INTEGER AS label, md5(html) AS content FROM pages WHERE page_id % 9 >= 2")
def web_shards(t):
    ext = F.explode(F.map_from_arrays(F.array(F.lit("jpg"), F.lit("cls"), F.lit("json")), F.array(F.col("html"), (F.col("page_id") % 5).cast("string"), F.format_string('{"alt": %d}', F.col("page_id") % 9 - 2)))).alias("ext", "data")
    parts = t.pages.select("page_id", ext)
    S.write_archives(parts, path := _folder(t, "wds"), F.format_string("s-%03d.tar", F.col("page_id") % 4), F.concat(F.col("page_id").cast("string"), F.lit("."), "ext"), F.col("data"))
    rows = A.read_shards(t.spark, path + "/s-{000..003}.tar|100", alt_label="alt")
    return rows.select("key", "label", F.md5("image").alias("content"))


@query("""WITH r AS (SELECT page_id, md5(html) AS content, page_id % 5 = 0 AS val, row_number() OVER (PARTITION BY page_id % 5 = 0 ORDER BY page_id) - 1 AS r FROM pages),
s AS (SELECT *, CASE WHEN val THEN 'v' || r % 2 ELSE 's' || r % 3 END AS shard FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY val ORDER BY shard, page_id) - 1 AS i, count(*) OVER (PARTITION BY val) AS n FROM s)
SELECT printf('%08d', page_id) AS key, CASE WHEN val THEN 'val' ELSE 'train' END AS split, (page_id % 7)::INTEGER AS label, content FROM p
WHERE CASE WHEN val THEN i >= 3 ELSE i < round_even(n * 0.75, 0) AND i >= 5 END""")
def shard_ranges(t):
    """Two splits of shards with a description; of one a range in parts of a hundred, of the other all but the first three."""
    root, val = _folder(t, "sharded"), F.col("page_id") % 5 == 0
    place = F.row_number().over(Window.partitionBy(val).orderBy("page_id")) - 1
    rows = t.pages.withColumn("r", place).select("html", "page_id", F.when(val, F.concat(F.lit("v"), F.col("r") % 2)).otherwise(F.concat(F.lit("s"), F.col("r") % 3)).alias("shard"))
    ext = F.explode(F.map_from_arrays(F.array(F.lit("jpg"), F.lit("cls")), F.array(F.col("html"), (F.col("page_id") % 7).cast("string")))).alias("ext", "data")
    S.write_archives(rows.select("shard", "page_id", ext), root, F.concat("shard", F.lit(".tar")), F.concat(F.format_string("%08d", "page_id"), F.lit("."), "ext"), F.col("data"))
    lengths = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    of = lambda kind: sorted(s for s in lengths if s[0] == kind)
    info = {"splits": {name: {"name": name, "filenames": [f"{s}.tar" for s in of(k)], "shard_lengths": [lengths[s] for s in of(k)], "num_samples": sum(lengths[s] for s in of(k))} for name, k in (("train", "s"), ("val", "v"))}}
    parts = [P.read_plan(t.spark, root, P.plan(info, spec)).withColumn("split", F.lit(name)) for name, spec in (("train", "train[5:75%]"), ("val", "val[3:]"))]
    return parts[0].union(parts[1]).select("key", "split", "label", F.md5("image").alias("content"))


@query("SELECT s_suppkey, s_name FROM supplier")
def dataset_by_prefix(t):
    t.supplier.select("s_suppkey", "s_name").write.parquet(f"{(root := _folder(t, 'hf'))}/validation")
    return S.open_dataset(t.spark, "hfds/", S.split_folder(root, "val[:10%]"))


@query("SELECT doc_id, text, n_chars::FLOAT AS score FROM documents")
def tfrecord_scan(t):
    rows = t.documents.select("doc_id", F.array_compact(F.array("text")).alias("text"), F.col("n_chars").cast("float").alias("score"))
    write_tfrecords(rows, path := _folder(t, "tf"), 1 << 16)
    f = lambda name, kind: F.get(F.element_at("features", name)[kind], F.lit(0))
    return S.open_dataset(t.spark, "tfds/", path).select(f("doc_id", "ints").alias("doc_id"), F.decode(f("text", "bytes"), "UTF-8").alias("text"), f("score", "floats").alias("score"))


# -- reports ---------------------------------------------------------------------------


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def prediction_split_json(t):
    S.write_predictions(t.supplier.select("s_suppkey", "s_name"), path := _folder(t, "split"), "json-split")
    parts = t.spark.read.text(path, wholetext=True).select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("v"))
    return parts.select(F.explode("v.data").alias("r")).select(F.get("r", F.lit(0)).alias("s_suppkey"), F.get("r", F.lit(1)).alias("s_name"))


@query("SELECT s_suppkey::VARCHAR AS key, s_name FROM supplier")
def prediction_index_json(t):
    S.write_predictions(t.supplier.select("s_suppkey", "s_name"), path := _folder(t, "index"), "json-index")
    parts = t.spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<s_name: string>>")).alias("key", "v"))
    return parts.select("key", "v.s_name")


@query("SELECT s_suppkey, s_name, unnest(['csv', 'json', 'parquet']) AS form FROM supplier")
def prediction_tables(t):
    rows, root, out = t.supplier.select("s_suppkey", "s_name"), _folder(t, "pred"), None
    for form in ("csv", "json", "parquet"):
        S.write_predictions(rows, f"{root}/{form}", form)
        reader = t.spark.read.schema("s_suppkey long, s_name string")
        part = (reader.option("header", True).csv(f"{root}/csv") if form == "csv" else reader.format(form).load(f"{root}/{form}")).withColumn("form", F.lit(form))
        out = part if out is None else out.union(part)
    return out


@query("SELECT r_regionkey AS epoch, r_name AS loss FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def summary_csv(t):
    path = f"{_folder(t, 'sum')}.csv"
    S.append_summary(t.region.select(F.col("r_regionkey").alias("epoch"), F.col("r_name").alias("loss")), path)
    S.append_summary(t.nation.select(F.col("n_nationkey").alias("epoch"), F.col("n_name").alias("loss")), path)
    return t.spark.read.schema("epoch int, loss string").option("header", True).csv(path)


@query("SELECT item_id || '.md' AS name, md5('# ' || item_id || chr(10) || chr(10) || '![](images/' || item_id || '.png)' || chr(10) || chr(10) || text || chr(10)) AS content FROM benchmark")
def markdown_preview(t):
    S.write_markdown(t.benchmark, path := _folder(t, "md"), F.col("item_id"), F.col("text"), F.encode("text", "UTF-8"))
    return S.read_binary(t.spark, path, "*.md").select(F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("content"))
