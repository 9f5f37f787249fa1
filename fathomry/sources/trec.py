"""Run and judgement files, read and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def _fields(spark: SparkSession, path, pattern: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("position"))
    return lines.where(F.trim("value") != "").select(F.split(F.trim("value"), pattern).alias("f"), "position", "value")


def _wrong(sizes: list[int]) -> Column:
    ok = F.size("f").isin(sizes)
    return F.when(ok, F.size("f")).otherwise(F.raise_error(F.concat(F.lit("a line has the wrong number of fields: "), F.col("value"))).cast("int"))


def _unique(df: DataFrame) -> DataFrame:
    """An error for a document that a query has twice."""
    n = F.count("*").over(Window.partitionBy("qid", "did"))
    return df.withColumn("qid", F.when(n > 1, F.raise_error(F.concat(F.lit("document twice: "), "qid", F.lit(" "), "did"))).otherwise(F.col("qid")))


def read_run(spark: SparkSession, path, sep: str = "\t", unique: bool = False) -> DataFrame:
    """(qid, did, score, position) from six or three columns."""
    f = _fields(spark, path, sep).withColumn("n", _wrong([3, 6]))
    six = F.col("n") == 6
    out = f.select(F.get("f", F.lit(0)).alias("qid"), F.when(six, F.get("f", F.lit(2))).otherwise(F.get("f", F.lit(1))).alias("did"), F.when(six, F.get("f", F.lit(4))).otherwise(F.get("f", F.lit(2))).cast("double").alias("score"), "position")
    return _unique(out) if unique else out


def read_trec_qrels(spark: SparkSession, path, unique: bool = True, only_ones: bool = False) -> DataFrame:
    """(qid, did, rel) from ``qid 0 did rel``; with ``only_ones`` any other rel is an error."""
    f = _fields(spark, path, r"\s+").withColumn("n", _wrong([4]))
    rel = F.get("f", F.lit(3)).cast("int")
    if only_ones:
        rel = F.when(rel == 1, rel).otherwise(F.raise_error(F.concat(F.lit("relevance isn't 1: "), F.col("value"))).cast("int"))
    out = f.where("n = 4").select(F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("did"), rel.alias("rel"))
    return _unique(out) if unique else out


def read_beir_qrels(spark: SparkSession, path) -> DataFrame:
    """(qid, did, rel) from TSV files with a header each; of a pair that comes twice the last line of the last file counts."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", True).schema("qid string, did string, rel int")
    lines = reader.csv(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("place"))
    return lines.groupBy("qid", "did").agg(F.max_by("rel", "place").alias("rel"))


def positives(qrels: DataFrame, threshold: int = 1) -> DataFrame:
    """(qid, dids): a query's documents at the threshold or above, in order."""
    return qrels.where(F.col("rel") >= threshold).groupBy("qid").agg(F.sort_array(F.collect_list("did")).alias("dids"))


def as_map(qrels: DataFrame) -> DataFrame:
    """(qid, judgements): did -> rel."""
    return qrels.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("did", "rel")))).alias("judgements"))


def run_lines(run: DataFrame, run_id: str = "run", tie: str = "did") -> DataFrame:
    """(qid, rank, value): ``qid Q0 did rank score run_id``, tab-separated, ranks from 1 by score."""
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), tie)))
    return ranked.select("qid", "rank", F.concat_ws("\t", F.col("qid").cast("string"), F.lit("Q0"), F.col("did").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.lit(run_id)).alias("value"))


def write_run(run: DataFrame, path: str, run_id: str = "run", mode: str = "error") -> None:
    run_lines(run, run_id).sortWithinPartitions("qid", "rank").select("value").write.mode(mode).text(path)


def write_beir_qrels(qrels: DataFrame, path: str, mode: str = "error") -> None:
    """``query-id, corpus-id, score`` with a header and the constant score 1."""
    qrels.select(F.col("qid").alias("query-id"), F.col("did").alias("corpus-id"), F.lit(1).alias("score")).write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def write_metrics(values: DataFrame, path: str, mode: str = "error") -> None:
    """All measures as fixed-width lines."""
    from ..functions.text import metric_line

    values.select(metric_line(F.col("measure"), F.lit("all"), F.col("value")).alias("value")).write.mode(mode).text(path)
