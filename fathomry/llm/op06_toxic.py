"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are whether an n-gram of 3 to 8 code points (hashed to ``2 ** BITS`` slots)
occurs in the whole lower-cased text. Each is scaled by its log-count ratio
``log((toxic documents with it + 1) / (toxic + 2)) - log((others with it + 1) / (others + 2))``
over the training rows; a logistic regression with an L2 penalty is then fitted on the
scaled features. N-grams found in fewer than ``LEAST_DOCS`` training documents, or whose
ratio is within ``LEAST_Z`` of its standard errors from 0, are left out. Classes are weighted back to the shares
they have among all labelled rows, so 0.5 is an even chance.

The classifier is fitted in one task on at most ``MAX_TRAIN`` labelled documents of together
at most ``MAX_TRAIN_BYTES`` (half of the documents per class if there are as many, in the order
of a hash of doc_id; a text that is longer than what is left of the bytes is passed over); neither bound grows with the corpus. A doc_id
with several texts is one training document, the one with the smallest hash. Scoring covers
every document in a single pass without a shuffle.

Defined results: a null or empty text has no features and gets the score of the intercept;
without any labelled text every score is 0.5, with one class only 0.0 or 1.0 damped by one
row each (``drop_toxic`` drops nothing in either case); null labels are left out; a doc_id labelled twice counts as toxic if either row
says so; an empty table gives an empty result. Other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import bound_batches
from ._columns import apart

ORDERS, BITS = (3, 8), 21
MAX_TRAIN, MAX_TRAIN_BYTES, LEAST_DOCS, LEAST_Z = 8000, 64 << 20, 4, 3.0
#: Training documents whose gradient is summed at a time.
BLOCK = 512
PENALTY, STEPS = 0.3, 40

_MULTIPLIERS = np.random.default_rng(911).integers(1, 1 << 31, ORDERS[1], dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def slots_by_order(text: str | None):
    """A slot for every n-gram of each order, repeats included; an order's 32-bit hash extends the one before."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    h = np.zeros(len(c), np.uint32)
    for order in range(1, min(ORDERS[1], len(c)) + 1):
        h = h[: len(c) - order + 1] ^ c[order - 1 :]
        h *= _MULTIPLIERS[order - 1]
        h ^= h >> np.uint32(15)
        if order >= ORDERS[0]:
            yield (h * _MULTIPLIERS[0]) >> np.uint32(32 - BITS)


def slots(text: str | None) -> np.ndarray:
    """The slots of all orders."""
    found = list(slots_by_order(text))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Model:
    """Weights by slot; most are 0. ``classes`` says of how many classes there were training texts."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, intercept: float, classes: int = 2):
        self.dense = np.zeros(1 << BITS, np.float32)
        self.dense[at] = weights
        self.some = self.dense != 0
        self.intercept, self.classes = intercept, classes

    def score(self, text: str | None) -> float:
        found = [s[self.some.take(s)] for s in slots_by_order(text)]
        z = self.intercept + float(self.dense[np.unique(np.concatenate(found))].sum(dtype=np.float64)) if found else self.intercept
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with step halving; f returns the value and the gradient."""
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, slope = f(x)
    for _ in range(steps):
        d, alphas = slope.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * y
        if past:
            s, y, rho = past[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(d))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            d += (a - rho * (y @ d)) * s
        step, drop = 1.0, slope @ d
        while True:
            new, new_slope = f(x - step * d)
            if new <= value - 1e-4 * step * drop or step < 1e-6:
                break
            step /= 2
        s, y = -step * d, new_slope - slope
        done = abs(value - new) < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + s, new, new_slope
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y, 1 / (s @ y))]
        if done:
            break
    return x


def _counts(texts: list[str | None], toxic: np.ndarray) -> np.ndarray:
    """Documents of either class with each slot."""
    counts, seen = np.zeros((2, 1 << BITS), np.int32), np.zeros(1 << BITS, bool)
    for text, y in zip(texts, toxic, strict=True):
        seen[slots(text)] = True
        once = np.flatnonzero(seen)
        seen[once] = False
        counts[int(y), once] += 1
    return counts


def log_ratios(counts: np.ndarray, toxic: int, others: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-count ratios, their standard errors) from the documents of either class with each feature."""
    ratio = np.log((counts[1] + 1) / (toxic + 2)) - np.log((counts[0] + 1) / (others + 2))
    return ratio.astype(np.float32), np.sqrt(1 / (counts[1] + 1) + 1 / (counts[0] + 1)).astype(np.float32)


def fit(texts: list[str | None], toxic: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, intercept) for training rows whose classes have ``share`` toxic in truth."""
    toxic = toxic.astype(bool)
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    if toxic.all() or not toxic.any():
        n = len(texts)
        return np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log((toxic.sum() + 1) / (n - toxic.sum() + 1)))
    counts = _counts(texts, toxic)
    ratio, error = log_ratios(counts, int(toxic.sum()), int((~toxic).sum()))
    at = np.flatnonzero((counts.sum(0) >= LEAST_DOCS) & (np.abs(ratio) >= LEAST_Z * error))
    scale = ratio[at].astype(np.float64)
    del counts, ratio, error
    column = np.full(1 << BITS, -1, np.int32)
    column[at] = np.arange(len(at))
    # Each block of documents: its columns, one document after the other, and where a document's begin.
    blocks = []
    for i in range(0, len(texts), BLOCK):
        found = [np.unique((k := column[slots(t)])[k >= 0]) for t in texts[i : i + BLOCK]]
        blocks.append((np.concatenate(found), np.repeat(np.arange(len(found), dtype=np.int32), [len(k) for k in found])))
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    sign = np.where(toxic, 1.0, -1.0)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, b = p[:-1], p[-1]
        scaled, value, grad, pulls = w * scale, 0.0, np.zeros(len(at)), 0.0
        for i, (columns, rows) in zip(range(0, len(texts), BLOCK), blocks, strict=True):
            y, c = sign[i : i + BLOCK], weight[i : i + BLOCK]
            z = y * (np.bincount(rows, scaled[columns], len(y)) + b)
            pull = -y * c / (1 + np.exp(np.clip(z, -50, 50)))
            value += float((c * np.logaddexp(0, -z)).sum())
            grad += np.bincount(columns, pull[rows], len(at))
            pulls += pull.sum()
        return value + PENALTY / 2 * (w @ w), np.append(grad * scale + PENALTY * w, pulls)

    p = _minimise(loss, np.zeros(len(at) + 1), STEPS)
    weights = p[:-1] * scale
    keep = np.abs(weights) > 1e-6
    return at[keep], weights[keep].astype(np.float32), float(p[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that aren't held out; only the weights come to the driver."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    share = (n_toxic or 0) / n if n else 0.0

    def some(toxic: int, most: int) -> DataFrame:
        return known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    half = MAX_TRAIN // 2
    positive = min(int(n_toxic or 0), max(half, MAX_TRAIN - int(n - (n_toxic or 0))))
    chosen = some(1, positive).union(some(0, MAX_TRAIN - positive))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text a doc_id, however many rows it has: combined before the shuffle.
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    ordered = one.select(F.xxhash64("doc_id").alias("h"), "doc_id", "t.text", F.col("toxic").cast("int").alias("toxic")).repartition(1).sortWithinPartitions("h", "doc_id")

    def run(batches):
        texts, toxic, left = [], [], MAX_TRAIN_BYTES
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                size = len((text or "").encode("utf-8", "surrogatepass"))
                if size > left:  # the next one may fit
                    continue
                left -= size
                texts.append(text)
                toxic.append(y)
        at, weights, intercept = fit(texts, np.array(toxic, np.int64), share)
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([intercept], pa.float64()), pa.array([len(set(toxic))], pa.int32())], ["at", "weights", "intercept", "classes"])

    bound_batches(docs.sparkSession)
    found = ordered.select("text", "toxic").mapInArrow(run, "at binary, weights binary, intercept double, classes int").first()
    if found is None:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 0)
    return Model(np.frombuffer(found["at"], "<i4").astype(np.int64), np.frombuffer(found["weights"], "<f4"), found["intercept"], found["classes"])


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of every whole text, in place of a column of that name."""
    docs = docs.drop(column)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = held.value.score
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column(column, pa.array([score(t) for t in texts], pa.float64()))

    bound_batches(docs.sparkSession)
    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those that score at the threshold or above.

    Without training texts of both classes nothing tells toxic from other, and all of docs stays.
    """
    model = train(docs, labels)
    if model.classes < 2:
        return docs
    narrow, back = apart(docs, "doc_id", "text")
    return back(with_scores(narrow, model, "__score").where(F.col("__score") < threshold))
