"""Contrastive training statistics of batches, and accuracy aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vectors as V
from ..functions.order import global_index


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, questions, documents) of a batch in the order of i."""
    i = t.column("i").to_numpy()
    order = pa.array(np.argsort(i, kind="stable"))
    q, d = (t.column(c).take(order).combine_chunks() for c in ("query", "doc"))
    while pa.types.is_list(d.type.value_type):
        d = d.flatten()
    matrix = lambda x: np.asarray(x.flatten(), np.float64).reshape(len(x), -1)
    return np.sort(i, kind="stable"), matrix(q), matrix(d)


def score_matrix(pairs: DataFrame, temperature: float = 0.2, passages: int = 1) -> DataFrame:
    """(batch, i, j, s): question i against every document j of its batch.

    pairs(batch, i, query, doc) holds one row a question; with several passages ``doc`` is an
    array of vectors and question i's positive is document ``i * passages``. A batch has a fixed
    size and is one matrix product in one task.
    """
    def run(t: pa.Table) -> pa.Table:
        i, q, d = _sides(t)
        s = q @ d.T / temperature
        j = (i[:, None] * passages + np.arange(passages)).ravel()
        return pa.table({"batch": pa.repeat(t.column("batch")[0], s.size), "i": pa.array(np.repeat(i, s.shape[1])), "j": pa.array(np.tile(j, len(i))), "s": pa.array(s.ravel())})

    return _numbered(pairs).groupBy("batch").applyInArrow(run, f"batch {pairs.schema['batch'].dataType.simpleString()}, i long, j long, s double")


def _numbered(pairs: DataFrame) -> DataFrame:
    return pairs.select("batch", F.col("i").cast("long").alias("i"), "query", "doc")


def gather_batches(pairs: DataFrame, devices: int) -> DataFrame:
    """Negatives across devices: the batches of ``devices`` neighbours as one, each question with a number of its own."""
    sizes = pairs.groupBy("batch").agg((F.max("i") + 1).alias("__n"))
    sizes = sizes.withColumn("__g", F.floor(F.col("batch") / devices)).withColumn("__at", F.sum("__n").over(Window.partitionBy("__g").orderBy("batch")) - F.col("__n"))
    return pairs.join(sizes, "batch").select(F.col("__g").alias("batch"), (F.col("__at") + F.col("i")).cast("long").alias("i"), "query", "doc")


def batch_losses(pairs: DataFrame, temperature: float = 0.2, passages: int = 1, micro: int = 256) -> DataFrame:
    """(batch, loss, other, accuracy): softmax cross-entropy of questions over the batch's documents
    and of positives over its questions, and how often a question's positive scores highest (of
    equal scores the first document counts).

    ``micro`` questions are scored at a time, so a batch of any size takes no more memory than its
    vectors and ``micro`` rows of scores; sums over a document's column are carried on. Losses don't depend on it.
    """
    def run(t: pa.Table) -> pa.Table:
        i, q, d = _sides(t)
        n = len(q)
        own = np.arange(n) * passages
        losses, hits = np.empty(n), np.empty(n)
        top, total = np.full(n, -np.inf), np.zeros(n)
        for a in range(0, n, micro):
            raw = q[a : a + micro] @ d.T
            rows, s = np.arange(len(raw)), raw / temperature
            most = s.max(1)
            losses[a : a + micro] = np.log(np.exp(s - most[:, None]).sum(1)) + most - s[rows, own[a : a + micro]]
            hits[a : a + micro] = raw.argmax(1) == own[a : a + micro]
            columns = s[:, own]
            new = np.maximum(top, columns.max(0))
            total = total * np.exp(top - new) + np.exp(columns - new).sum(0)
            top = new
        positive = (q * d[own]).sum(1) / temperature
        other = np.log(total) + top - positive
        one = lambda x: pa.array([float(x.mean())], pa.float64())
        return pa.table({"batch": t.column("batch").slice(0, 1), "loss": one(losses), "other": one(other), "accuracy": one(hits)})

    return _numbered(pairs).groupBy("batch").applyInArrow(run, f"batch {pairs.schema['batch'].dataType.simpleString()}, loss double, other double, accuracy double")


def in_batch_loss(pairs: DataFrame, temperature: float = 0.2, passages: int = 1, both: bool = False, micro: int = 256) -> DataFrame:
    """(batch, loss): softmax cross-entropy over the batch's documents; ``both`` averages it with documents against questions."""
    found = batch_losses(pairs, temperature, passages, micro)
    return found.select("batch", ((F.col("loss") + F.col("other")) / 2).alias("loss") if both else "loss")


def in_batch_accuracy(pairs: DataFrame, passages: int = 1) -> DataFrame:
    """(batch, accuracy): how often a question's positive scores highest; of equal scores the first document counts."""
    return batch_losses(pairs, 1.0, passages).select("batch", "accuracy")


def mixup_targets(df: DataFrame, key: str, label: str, classes: int, share: float, smoothing: float = 0.0) -> DataFrame:
    """(key, target): row i's smoothed one-hot mixed with that of row n - 1 - i, rows by key."""
    rows = global_index(df.select(key, label), [F.col(key)], "__i")
    n = df.count()
    other = rows.select((F.lit(n - 1) - F.col("__i")).alias("__i"), F.col(label).alias("__other"))
    mixed = V.mixup(V.one_hot(F.col(label), classes, smoothing), V.one_hot(F.col("__other"), classes, smoothing), share)
    return rows.join(other, "__i").select(key, mixed.alias("target"))


def top_k_accuracy(df: DataFrame, ks=(1, 5), best: str = "best", label: str = "label") -> DataFrame:
    """Percent of rows whose label is among the first k predictions."""
    return df.agg(*[F.round(100 * F.avg(F.array_contains(F.slice(best, 1, k), F.col(label)).cast("double")), 6).alias(f"top{k}") for k in ks])


def real_label_accuracy(df: DataFrame, ks=(1, 5), best: str = "best", real: str = "real") -> DataFrame:
    """Percent of rows where one of the first k predictions is in the set of real labels; rows without any are left out."""
    return df.where(F.size(real) > 0).agg(*[F.round(100 * F.avg(F.arrays_overlap(F.slice(best, 1, k), F.col(real)).cast("double")), 6).alias(f"top{k}") for k in ks])


def weighted_mean(df: DataFrame, by: list[str], value: str = "value", n: str = "n") -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))).alias("mean"))


def subset_logits(logits, valid: list[int]):
    """The logits of valid classes only."""
    return F.transform(F.array(*[F.lit(i) for i in valid]), lambda i: F.get(logits, i))
