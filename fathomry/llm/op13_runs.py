"""Periodic runs of words: a harmonic grid of LCE queries on suffix arrays.

A run is a stretch of consecutive words with smallest period p (words p apart are identical), at least
``max(LEAST_WORDS, TIMES * p)`` long, that no neighbouring word extends. For each period p the places
``j * p`` form a grid, n / p of them, so all periods together ask about n ln n questions: how far do the words from jp and
from (j+1)p on agree, and how far do the words before them? Both answers are longest common extensions,
forward and backward, and say where the stretch with period p around jp begins and ends.

An extension is the smallest LCP between two places of the suffix array: suffixes are sorted by prefix doubling, neighbours'
LCPs are read off the ranks of all doublings, and the minima of ranges come from a sparse table of which only one
level is held at a time. The same is done for the reversed words. A run of at least 4p words holds four places of its
grid, all with one word, so pairs that aren't followed by two more equal words need no query, and a text
without such places needs no suffix array: nearly all texts.

A stretch found for p and for a smaller period is the same run: the smallest period divides the others (they
fit four times), and has the same ends.

A text is worked on whole in one task, which is inherent to a row; texts are spread as they are read and never
shuffled. Beside its text a task holds 4 bytes for each word, and, if places are to be asked, about 40 more and
4 for each doubling that its longest repeat needs.

Defined results: a null, empty or word-less text has no runs and collapses to an empty text; rows
are worked on one by one, so repeated rows and ids and null ids give a row each; an empty table gives
an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._arrow import bound_batches, with_bytes

#: Words of a run at least, and periods.
LEAST_WORDS, TIMES = 6, 4
#: Bytes of text that are split into words at a time.
BLOCK = 1 << 20

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(text: bytes | None) -> tuple[np.ndarray, list[bytes]]:
    """The words as numbers, and the distinct words in the order of these."""
    known: dict[bytes, int] = {}
    parts, start, text = [], 0, text or b""
    while start < len(text):
        cut = _SPACE.search(text, start + BLOCK) if start + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[start:end].split()
        for w in words:
            if w not in known:
                known[w] = len(known)
        parts.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32), list(known)


def range_min(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(a[low : high + 1]) of every range; level k of the sparse table holds the minima of 2**k numbers."""
    level = np.frexp(high - low + 1)[1] - 1
    out, table = np.empty(len(low), a.dtype), a
    for k in range(int(level.max(initial=-1)) + 1):
        now = np.flatnonzero(level == k)
        out[now] = np.minimum(table[low[now]], table[high[now] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Extensions:
    """Longest common extensions of suffixes of x."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
        levels = []
        while int(rank.max()) + 1 < n:
            step = 1 << len(levels)
            levels.append(rank)
            key = rank.astype(np.int64) * (n + 1)
            key[:-step] += rank[step:] + 1  # nothing follows: 0
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        suffixes = np.empty(n, np.int32)
        suffixes[rank] = np.arange(n, dtype=np.int32)
        lcp, a, b = np.zeros(n, np.int32), suffixes[:-1].copy(), suffixes[1:].copy()
        for k in reversed(range(len(levels))):
            # Two different suffixes have one rank only if 2**k words of both are there and equal.
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
            levels.pop()
        lcp[1:] = a - suffixes[:-1]
        self.rank, self.lcp = rank, lcp

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on agree; i and j are different."""
        a, b = self.rank[i], self.rank[j]
        return range_min(self.lcp, np.minimum(a, b) + 1, np.maximum(a, b))


def grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, p) of the pairs i = jp and i + p to ask about: those with the same word at i, i + p, i + 2p and i + 3p.

    Small periods are tested period by period, all places at once; large ones, which have few places, place by
    place, all periods at once.
    """
    n = len(x)
    most, small = n // TIMES, min(n // TIMES, int(n**0.5) + 1)
    places, periods = [], []
    for p in range(1, small + 1):
        y = x[::p]
        same = y[1:] == y[:-1]
        j = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(j):
            places.append(j * p)
            periods.append(np.full(len(j), p))
    for j in range(n // (small + 1)):
        last = min(most, (n - 1) // (j + 3))
        if last <= small:
            break
        p = np.arange(small + 1, last + 1)
        first = x[j * p]
        p = p[(first == x[(j + 1) * p]) & (first == x[(j + 2) * p]) & (first == x[(j + 3) * p])]
        if len(p):
            places.append(j * p)
            periods.append(p)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(places), join(periods)


def runs_of(x: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of all runs, by start, then period."""
    i, p = grid(x)
    if not len(i):
        return np.zeros((0, 3), np.int64)
    n = len(x)
    ahead = Extensions(x)(i, i + p).astype(np.int64)
    back, some = np.zeros(len(i), np.int64), i > 0
    if some.any():
        back[some] = Extensions(x[::-1].copy())(n - i[some], n - i[some] - p[some])
    start, end = i - back, i + p + ahead
    long = end - start >= np.maximum(LEAST_WORDS, TIMES * p)
    start, end, p = start[long], end[long], p[long]
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(p)]
    start, end, p = start[first], end[first], p[first]
    order = np.lexsort((p, start))
    return np.stack([start, end - start, p], 1)[order]


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run is cut to its first period."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def find_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; ``collapsed`` joins the words that stay by one space."""

    def run(batches):
        for batch in batches:
            sizes, found, texts = [], [], []
            for text in batch.column(1):
                x, words = word_ids(text.as_py())
                r = runs_of(x)
                sizes.append(len(x))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in r.tolist()])
                texts.append(b" ".join(map(words.__getitem__, (x[kept(len(x), r)] if len(r) else x).tolist())))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = with_bytes(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, r: F.when(better(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts, by the crc32 of doc_id, made periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n, words = F.floor(h / 10), F.size("words"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    a = F.when(n > 0, F.col("g") % n).cast("int")
    chosen = chosen.withColumn("a", a).withColumn("p", (F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    repeated = F.concat(F.slice("words", 1, F.col("a")), F.transform(F.sequence(F.col("a"), n - 1), lambda i: F.get("words", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return chosen.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
