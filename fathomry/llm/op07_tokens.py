"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Every whole text is encoded once; a task keeps only how many documents have each length.
The histogram has at most as many rows as there are distinct lengths, whatever the number
of documents. Sums from below and above then answer any context limit: at ``length`` L the
row holds the documents and tokens at most L, the documents above, and the total when each
document is cut at L tokens. Between two rows all of these are constant or linear, so
``truncated_total`` and ``quantile`` read any limit or share off the same table.

Defined results: a null or empty text has 0 tokens; special tokens in a text are ordinary
text; repeated rows count each; an empty table gives an empty histogram, totals of 0 and no
quantile.
"""

from __future__ import annotations

import base64
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._arrow import bound_batches
from ._work import Work

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that goes with the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that are summed up together before their blocks are.
_BLOCK = 1024


def load_encoding(vocabulary: bytes, pattern: str = PATTERN):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _encoder(spark: SparkSession, path: str, pattern: str):
    """A function that makes the encoding in a task; the vocabulary's size bounds what is sent."""
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())
    return lambda: load_encoding(held.value, pattern)


def with_counts(docs: DataFrame, column: str = "n_tokens", path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with the encoded length of every text, in place of a column of that name."""
    from pyspark.sql.types import LongType, StructType

    docs = docs.drop(column)
    make = _encoder(docs.sparkSession, path, pattern)

    def run(batches):
        encode = make().encode_ordinary
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column(column, pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64()))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, LongType()))


def histogram(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs)."""
    make = _encoder(docs.sparkSession, path, pattern)

    def run(batches):
        encode, seen = make().encode_ordinary, Counter()
        for batch in batches:
            seen.update(len(encode(t)) if t else 0 for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n_docs"])

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def summarise(work: Work, counts: DataFrame) -> DataFrame:
    """(length, n_docs, docs_at_most, docs_above, tokens_at_most, tokens_above, truncated_total, quantile), a row for each length.

    A row answers the context limit of its length; ``quantile`` is the share of documents that don't exceed it.
    """
    counts = work.save(counts.withColumn("block", F.floor(F.col("length") / _BLOCK)), "histogram")
    tokens = F.col("length") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each 1024 lengths: as few as the longest document has tokens / 1024.
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = (F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_beyond") for c in "dt")
    blocks = blocks.select("block", *beyond, F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.join(blocks, "block").select(
        "length", "n_docs", "all_docs", "all_tokens",
        (F.col("d_beyond") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_above"),
        (F.col("t_beyond") + F.coalesce(F.sum(tokens).over(inside), F.lit(0))).alias("tokens_above"),
    )
    at_most = F.col("all_tokens") - F.col("tokens_above")
    return rows.select("length", "n_docs", (F.col("all_docs") - F.col("docs_above")).alias("docs_at_most"), "docs_above", at_most.alias("tokens_at_most"), "tokens_above", (at_most + F.col("length") * F.col("docs_above")).alias("truncated_total"), ((F.col("all_docs") - F.col("docs_above")) / F.col("all_docs")).alias("quantile"))


def truncated_total(summary: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at ``limit``."""
    below = summary.where(F.col("length") <= limit).agg(F.max_by(F.struct("tokens_at_most", "docs_above"), "length")).first()[0]
    if below is not None:
        return below["tokens_at_most"] + limit * below["docs_above"]
    return limit * (summary.agg(F.sum("n_docs")).first()[0] or 0)


def quantile(summary: DataFrame, share: float) -> int | None:
    """The smallest length that at least this share of the documents don't exceed."""
    docs = F.col("docs_at_most") + F.col("docs_above")
    return summary.where(F.col("docs_at_most") >= share * docs).agg(F.min("length")).first()[0]
