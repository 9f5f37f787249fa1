"""Streams over folders that grow, and the hooks for models, clients and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.store import Work
from ..operators import retrieval as R
from ..sources import files as S
from ..streaming import flows
from .registry import Tables, query


def _folder(t: Tables, name: str) -> str:
    return Work(t.spark, "flows").path(name)


def _drain(stream: DataFrame, t: Tables, name: str) -> DataFrame:
    """What a stateless stream gives for all files that are there."""
    out = _folder(t, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(t, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(out)


@query("SELECT doc_id, upper(lang) AS lang FROM documents WHERE n_chars > 100")
def stream_scan(t):
    S.write_jsonl(t.documents.select("doc_id", "lang", "n_chars").repartition(6), path := _folder(t, "in"))
    keep = lambda df: df.where("n_chars > 100").select("doc_id", F.upper("lang").alias("lang"))
    return _drain(flows.stream_jsonl(t.spark, path, "doc_id long, lang string, n_chars long", keep, max_files=2), t, "out")


@query("SELECT doc_id, length(text) AS n FROM documents")
def stream_worklist(t):
    """The work stops after a part, the folder grows by rows that were done already, and it goes on."""
    rows, path, done, at = t.documents.select("doc_id", "text"), _folder(t, "in"), _folder(t, "done"), _folder(t, "checkpoint")
    work = lambda df: df.select("doc_id", F.length("text").cast("long").alias("n"))
    for part in (rows.where("doc_id % 3 = 0"), rows):
        S.write_jsonl(part.repartition(2), path, mode="append")
        flows.resume(flows.stream_jsonl(t.spark, path, "doc_id long, text string"), done, work, "doc_id", at).start().awaitTermination()
    return t.spark.read.parquet(done).select("doc_id", "n")


def _restarted(t: Tables, rows: DataFrame, k: int) -> DataFrame:
    """The running top k of rows that come as files: the query drains what is there and stops, the folder grows, and it goes on from its checkpoint."""
    path, out, at = (_folder(t, name) for name in ("in", "kept", "checkpoint"))
    first = F.pmod(F.xxhash64("did"), F.lit(3)) == 0
    for part in (rows.where(first), rows.where(~first)):
        S.write_jsonl(part.repartition(2), path, mode="append")
        stream = flows.stream_jsonl(t.spark, path, "qid long, did long, score double", max_files=1)
        flows.keep_top_k(stream, k, out, at).awaitTermination()
    return flows.last_top_k(t.spark, out)


@query("""WITH q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT qid, vec_id AS did, vec_id % 3 AS shard, list_dot_product(e, embedding::DOUBLE[]) AS score FROM q, embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY score DESC, did) AS r FROM s)
SELECT qid, did, rank FROM (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM p WHERE r <= 5) WHERE rank <= 10""")
def stream_top_k(t):
    """Shards' results come as files; the state holds each query's ten best so far."""
    vectors = t.embeddings.select(F.col("vec_id").alias("did"), "embedding")
    queries = vectors.where("did % 10 = 0").withColumnRenamed("did", "qid")
    parts = [R.search(queries, vectors.where(F.col("did") % 3 == i), 5).drop("rank") for i in range(3)]
    return _restarted(t, parts[0].union(parts[1]).union(parts[2]), 10).select("qid", "did", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey AS qid, o_orderkey AS did FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def stream_best_kept(t):
    """Of each group the best rows are kept while files come, as keyed state."""
    rows = t.orders.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("did"), F.col("o_totalprice").alias("score"))
    return _restarted(t, rows, 3).select("qid", "did")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 7 < 3 THEN 'n' || length(text) END AS response, CASE WHEN doc_id % 7 >= 3 THEN 'ValueError: busy' END AS error FROM documents")
def client_with_retries(t):
    """A client that fails some times for some rows: three tries are enough for part of them."""
    def flaky():
        left: dict[str, int] = {}

        def call(row: dict) -> str:
            at = left.setdefault(row["id"], int(row["id"]) % 7)
            if at:
                left[row["id"]] = at - 1
                raise ValueError("busy")
            return f"n{len(row['text'])}"

        return call

    return flows.respond(t.documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), flaky(), 3)


@query("SELECT doc_id::VARCHAR AS id, length(text)::DOUBLE AS chars, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks FROM documents")
def encoder_loop(t):
    encoder = lambda batch: [[float(len(x)), float(x.count(" "))] for x in batch["text"]]
    out = flows.encode(t.documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")), encoder)
    return out.select("id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("blanks"))


@query("SELECT doc_id, CASE WHEN length(text) % 5 = 0 THEN NULL WHEN contains(text, 'the') THEN 'en' ELSE 'other' END AS found FROM documents")
def detector_hook(t):
    """A detector that fails on some texts: those rows get null, the others of their batch don't."""
    def detector(texts):
        if any(len(x) % 5 == 0 for x in texts):
            raise ValueError("can't tell")
        return ["en" if "the" in x else "other" for x in texts]

    return flows.detect(t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), detector, "text", "found").select("doc_id", "found")


@query("WITH p AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages WHERE page_id % 4 <> 0) SELECT page_id, unnest(range(1, len(parts) + 1))::INTEGER AS number, md5(unnest(parts)) AS content FROM p")
def splitter_hook(t):
    """A splitter that can't read some documents, which are left out."""
    def splitter(content):
        if content.startswith("!"):
            raise ValueError("unreadable")
        return content.split("<p>")

    rows = t.pages.select("page_id", F.concat(F.when(F.col("page_id") % 4 == 0, "!").otherwise(""), "html").alias("content"))
    return flows.split_pages(rows, splitter, "page_id", kind="string").select("page_id", "number", F.md5("page").alias("content"))
