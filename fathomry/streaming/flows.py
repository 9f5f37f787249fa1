"""The same operators over folders that grow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType


def stream_jsonl(spark: SparkSession, path: str, schema: StructType | str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, max_files: int | None = None) -> DataFrame:
    """New files of a folder as they come, through a stateless transform."""
    reader = spark.readStream.schema(schema)
    return transform((reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path))


def resume(stream: DataFrame, done_path: str, work: Callable[[DataFrame], DataFrame], key: str, checkpoint: str, buckets: int = 256):
    """A writer that runs ``work`` on keys that have no result yet and appends what comes out.

    The checkpoint remembers the files read; the anti-join guards against keys that come again and
    against a batch that is run again. Results lie in ``buckets`` folders by a hash of the key, so a
    micro-batch reads the keys of its own buckets only.
    """
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key]).withColumn("__bucket", bucket)
        try:
            done = spark.read.parquet(done_path)
        except AnalysisException as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            mine = [r[0] for r in batch.select("__bucket").distinct().collect()]  # at most ``buckets`` numbers
            batch = batch.join(done.where(F.col("__bucket").isin(mine)).select("__bucket", key), ["__bucket", key], "left_anti")
        work(batch.drop("__bucket")).withColumn("__bucket", bucket).write.mode("append").partitionBy("__bucket").parquet(done_path)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


#: Groups of queries that share a state: a call of Python and a round trip to the state for each, not for each query.
BUCKETS = 1024


class BestOf(StatefulProcessor):
    """Keeps the k best documents of each query of a bucket; the state never holds more, as the bytes of three columns."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "qids binary, dids binary, scores binary")

    def _cut(self, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["qid", "score", "did"], ascending=[True, False, True]).drop_duplicates(["qid", "did"])
        return pool[pool.groupby("qid").cumcount() < self.k]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pool, touched = None, []
        if self.best.exists():
            qids, dids, scores = self.best.get()
            pool = pd.DataFrame({"qid": np.frombuffer(qids, np.int64), "did": np.frombuffer(dids, np.int64), "score": np.frombuffer(scores)})
        for new in rows:
            new = pd.DataFrame({"qid": new["qid"].astype("int64"), "did": new["did"].astype("int64"), "score": new["score"].astype(float)})
            touched.append(new["qid"].unique())
            pool = self._cut(new if pool is None else pd.concat([pool, new]))
        self.best.update((pool["qid"].to_numpy().tobytes(), pool["did"].to_numpy().tobytes(), pool["score"].to_numpy().tobytes()))
        out = pool[pool["qid"].isin(np.concatenate(touched))]
        rank = out.groupby("qid").cumcount() + 1
        yield pd.DataFrame({"qid": out["qid"] if key[0] >= 0 else None, "did": out["did"], "score": out["score"], "rank": rank})

    def close(self) -> None:
        pass


def running_top_k(scores: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """Top k of each query over all shards so far, from a stream of (qid, did, score).

    Queries are dealt into buckets by a hash of their id, and a bucket's queries are worked on together. Rows without a qid are
    a bucket of their own. The number of buckets belongs to the checkpoint.
    """
    bucket = F.when(F.col("qid").isNull(), -1).otherwise(F.pmod(F.xxhash64("qid"), F.lit(buckets))).cast("int")
    dealt = scores.select(bucket.alias("bucket"), F.coalesce(F.col("qid"), F.lit(0)).alias("qid"), "did", "score")
    return dealt.groupBy("bucket").transformWithStateInPandas(BestOf(k), "qid long, did long, score double, rank int", "Update", "none")


def keep_top_k(scores: DataFrame, k: int, out: str, checkpoint: str):
    """A started query that drains a stream of (qid, did, score) and writes the running top k of each query it touches.

    A micro-batch has a folder of its own, which it writes again if it is run again; the state goes on from the checkpoint
    when the query is started anew. ``last_top_k`` reads what holds by then.
    """
    spark, key = scores.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # the started query keeps it

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        return running_top_k(scores, k).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def last_top_k(spark: SparkSession, out: str) -> DataFrame:
    """(qid, did, score, rank) as each query's last micro-batch left it."""
    rows = spark.read.parquet(out)
    last = rows.groupBy("qid").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["qid", "batch"]).drop("batch")


def with_retries(call: Callable, times: int):
    """A batch function that tries each row up to ``times`` and reports instead of failing: (id, response, error)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                response = error = None
                for _ in range(times):
                    try:
                        response, error = call(row), None
                        break
                    except Exception as e:  # noqa: BLE001  any failure of the client is a retry
                        error = f"{type(e).__name__}: {e}"
                out.append({"id": row["id"], "response": response, "error": error})
            yield pd.DataFrame(out, columns=["id", "response", "error"])

    return run


def respond(df: DataFrame, call: Callable, times: int = 5) -> DataFrame:
    """(id, response, error) of a client called on every row; ids are preserved."""
    return df.withColumn("id", F.col("id").cast("string")).mapInPandas(with_retries(call, times), "id string, response string, error string")


def pool(df: DataFrame, pooler: Callable[[pd.DataFrame], list], key: str, states: str = "states", mask: str = "mask") -> DataFrame:
    """(key, embedding) from a model's own pooling of token states, in batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "embedding": list(pooler(batch))})

    return df.select(key, states, mask).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>")


def detect(df: DataFrame, detector: Callable[[pd.Series], list], column: str = "text", name: str = "lang") -> DataFrame:
    """df with what a batch detector (a language detector, say) makes of a column; null where it fails on a batch's row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = list(detector(batch[column]))
            except Exception:  # noqa: BLE001  one row spoils the batch: ask row by row
                found = []
                for i in range(len(batch)):
                    try:
                        found += list(detector(batch[column].iloc[i : i + 1]))
                    except Exception:  # noqa: BLE001
                        found.append(None)
            yield batch.assign(**{name: found})

    return df.mapInPandas(run, StructType([*df.schema.fields]).add(name, "string"))


def split_pages(df: DataFrame, splitter: Callable[[bytes], Iterator], key: str, column: str = "content", name: str = "page", kind: str = "binary") -> DataFrame:
    """(key, number, page): one row for each part that a splitter or renderer makes of a document, numbered from 1; none where it fails."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in zip(batch[key], batch[column]):
                try:
                    pages = list(splitter(content))
                except Exception:  # noqa: BLE001  unreadable documents are left out
                    continue
                yield pd.DataFrame({key: [k] * len(pages), "number": range(1, len(pages) + 1), name: pages})

    return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, number int, {name} {kind}")


def encode(df: DataFrame, encoder: Callable[[pd.DataFrame], list], text: str = "text") -> DataFrame:
    """(id, embedding) from a batch encoder; a vector with a NaN is an error."""
    from ..functions.vectors import has_nan

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "embedding": list(encoder(batch))})

    out = df.withColumn("id", F.col("id").cast("string")).mapInPandas(run, "id string, embedding array<float>")
    return out.withColumn("id", F.when(has_nan(F.col("embedding")), F.raise_error(F.concat(F.lit("NaN in the embedding of "), "id"))).otherwise(F.col("id")))


def hash_encoder(dim: int = 64, text: str = "text") -> Callable[[pd.DataFrame], list]:
    """A deterministic stand-in for a model: signed hashes of the words, for tests."""
    import hashlib

    def encoder(batch: pd.DataFrame) -> list:
        out = []
        for value in batch[text].fillna(""):
            v = [0.0] * dim
            for w in value.split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
            size = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / size for x in v])
        return out

    return encoder
