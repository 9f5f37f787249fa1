"""The operators' queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._work import Work


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op01_topk as op

    return op.top_k(Work(spark, "op1"), _table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op02_warc as op

    work = Work(spark, "op2")
    pages = _table(spark, sf_dir, "pages")
    op.write_archive(op.to_records(work, pages, F.col("page_id"), F.col("url"), F.col("html")), work.path("archive"))
    back = op.read_archive(spark, work.path("archive"), payload="digest")
    revisit = F.col("record_type") == "revisit"
    return back.select(
        F.col("record_id").cast("long").alias("page_id"), F.when(revisit, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(F.col("payload_sha256")).alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op03_mix as op

    return op.plan(Work(spark, "op3"), _table(spark, sf_dir, "documents")).drop("repeats")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op04_chat as op

    said = "\\### Assistant: </turn> ok"
    row = lambda turn, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
    more = spark.range(1).select(F.inline(F.array(row(0, "user"), row(1, "assistant"))))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    back = op.read_back(op.format_chats(turns))
    each = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op05_license as op

    out = op.scan(Work(spark, "op5"), _table(spark, sf_dir, "documents"))
    both = F.sort_array(F.array_union("base_labels", "found"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(both, ",").alias("labels"), "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op06_toxic as op

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = op.with_scores(docs, op.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", op.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op07_tokens as op

    return op.summarise(Work(spark, "op7"), op.histogram(_table(spark, sf_dir, "documents")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op08_near as op

    return op.components(Work(spark, "op8"), _table(spark, sf_dir, "documents"), words=2)


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op09_decontam as op

    out = op.report(Work(spark, "op9"), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op10_lines as op

    docs = _table(spark, sf_dir, "documents")
    return op.line_report(docs, op.build_index(Work(spark, "op10"), docs))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op11_variants as op

    return op.variants(Work(spark, "op11"), _table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op12_packing as op

    return op.sequences(Work(spark, "op12"), _table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import op13_runs as op

    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    found = op.find_runs(op.planted(_table(spark, sf_dir, "documents"))).withColumn("best", op.strongest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_topk, op2_warc, op3_mix, op4_chat_format, op5_license_scan, op6_toxicity, op7_token_counts, op8_minhash, op9_decontam, op10_line_dedup, op11_variants, op12_packing, op13_runs)}
