"""Training examples and batches of them: projections over nested rows.

An example has ``query``, ``pos`` and ``neg``; multimodal parts are structs of text, image and
instruction, text-only parts are arrays whose first element is the instruction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import or_empty, with_instruction
from .rows import pick, rotate


def _part(p: Column) -> Column:
    return F.struct(or_empty(with_instruction(p.instruction, p.text), p.image, "passage").alias("text"), p.image.alias("image"))


def multimodal(df: DataFrame, passages: int) -> DataFrame:
    """(query, passages): instruction before text, then the first positive and the first negatives."""
    chosen = F.concat(F.slice("pos", 1, 1), F.slice(F.coalesce("neg", F.slice("pos", 1, 0)), 1, passages - 1))
    query = F.struct(with_instruction(F.col("query.instruction"), F.col("query.text")).alias("text"), F.col("query.image").alias("image"))
    return df.select(query.alias("query"), F.transform(chosen, _part).alias("passages"))


def text_only(df: DataFrame, passages: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., query, passages) from arrays: the instruction and each text, with one blank between."""
    join = lambda a, x: F.concat_ws(" ", F.get(a, F.lit(0)), x)
    pos, neg = F.slice("pos", 2, 1), F.slice("neg", 2, passages - 1)
    texts = F.concat(F.transform(pos, lambda x: join(F.col("pos"), x)), F.transform(neg, lambda x: join(F.col("neg"), x)))
    return df.select(*keep, join(F.col("query"), F.get("query", F.lit(1))).alias("query"), texts.alias("passages"))


def pretraining(df: DataFrame, column: str = "text") -> DataFrame:
    """(query, passages): a text beside itself."""
    return df.select(F.col(column).alias("query"), F.array(column).alias("passages"))


def reranking(df: DataFrame, epoch: int, seed: Column) -> DataFrame:
    """(query, positive, negative): the pair that seed and epoch point at."""
    at = seed + epoch
    return df.select("query", pick(F.col("pos"), at).alias("positive"), pick(F.col("neg"), at).alias("negative"))


def query_generation(df: DataFrame) -> DataFrame:
    """(source, target): the first positive and its query."""
    return df.select(F.get("pos", F.lit(0)).alias("source"), F.col("query").alias("target"))


def contrastive_query_generation(df: DataFrame, epoch: int, seed: Column, sep: str = " ") -> DataFrame:
    """(source, target): a positive and a negative together, and the query that tells them apart."""
    at = seed + epoch
    return df.select(F.concat_ws(sep, pick(F.col("pos"), at), pick(F.col("neg"), at)).alias("source"), F.col("query").alias("target"))


def pairwise_distillation(df: DataFrame) -> DataFrame:
    return df.select("query", "positive", "negative", F.col("score").cast("double").alias("score"))


def listwise_distillation(df: DataFrame, epoch: int, n: int) -> DataFrame:
    """(query, docs, scores): n documents and their scores, from a place that moves on with each epoch."""
    start = F.lit(epoch * n)
    return df.select("query", rotate(F.col("docs"), start, n).alias("docs"), rotate(F.col("scores"), start, n).alias("scores"))


# -- batches ---------------------------------------------------------------------------


def collate(df: DataFrame, batch: str, order: list) -> DataFrame:
    """(batch, queries, passages): a batch's examples side by side, passages flattened in order."""
    row = F.struct(*order, "query", "passages")
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return rows.select(batch, F.transform("r", lambda r: r.query).alias("queries"), F.flatten(F.transform("r", lambda r: r.passages)).alias("passages"))


def collate_pairs(df: DataFrame, batch: str, order: list) -> DataFrame:
    """(batch, positives, negatives): (query, document) pairs of both kinds."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(*order, "query", "positive", "negative"))).alias("r"))
    side = lambda c: F.transform("r", lambda r: F.struct(r.query.alias("query"), r[c].alias("doc")))
    return rows.select(batch, side("positive").alias("positives"), side("negative").alias("negatives"))


def collate_columns(df: DataFrame, batch: str, order: list, columns: list[str]) -> DataFrame:
    """(batch, columns...): rows as one list a column."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("r"))
    return rows.select(batch, *[F.col(f"r.{c}").alias(c) for c in columns])
