"""Retrieval metrics as one plan: a rank window, then one aggregate for all measures asked for.

``run(qid, did, score)`` is ranked by score, ties by document id from the end of the
alphabet (``tie`` changes that). Documents that aren't judged are not relevant. Only
queries that are in both run and qrels count; a query that returned nothing can be named
in ``queries`` and scores 0. Ideal gains come from all judgements of a query, as the numbers of its judgements
of each relevance: no list of judgements is sorted or gathered. Judgements of whole classes of documents (``ByClass``) are
never made into pairs: they are counted by the classes' sizes and looked up by a document's class.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.stats import student_p

# Default cutoffs of the parametric measures.
CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))
DEFAULTS = {
    "P": CUTS, "recall": CUTS, "map_cut": CUTS, "ndcg_cut": CUTS, "relative_P": CUTS, "success": (1, 5, 10),
    "iprec_at_recall": RECALLS, "Rprec_mult": tuple(i / 5 for i in range(1, 11)),
}
# Measures without parameters, and the nicknames.
PLAIN = (
    "num_q", "num_ret", "num_rel", "num_rel_ret", "map", "gm_map", "Rprec", "bpref", "gm_bpref", "recip_rank", "11pt_avg", "ndcg", "infAP",
    "set_P", "set_recall", "set_F", "set_map", "set_relative_P", "utility", "num_nonrel_judged_ret", "ndcg_rel", "Rndcg", "G", "binG",
)
NICKNAMES = {
    "all_trec": (*PLAIN, *DEFAULTS),
    "official": ("num_q", "num_ret", "num_rel", "num_rel_ret", "map", "gm_map", "Rprec", "bpref", "recip_rank", "iprec_at_recall", "P"),
    "set": ("num_q", "num_ret", "num_rel", "num_rel_ret", "utility", "set_P", "set_relative_P", "set_recall", "set_map", "set_F"),
}
#: Names that stand for strings, not for numbers.
UNSUPPORTED = ("relstring", "runid")
#: Measures that need the ideal gains at every rank; their definitions are those of ``_by_gain``.
BY_GAIN = ("ndcg_rel", "Rndcg")
FLOOR = 1e-5
#: Keys that the queries of a class of documents are dealt over where its judgements are made into pairs.
SPREAD = 64


def parse_measures(names) -> dict[str, tuple]:
    """Base measure -> its parameters. ``m.5,10`` and ``m_5`` are merged; a bare name stands for the defaults unless there are explicit ones."""
    asked: dict[str, set] = {}
    for name in [x for n in ([names] if isinstance(names, str) else names) for x in NICKNAMES.get(n, (n,))]:
        if name in PLAIN or name in DEFAULTS:
            asked.setdefault(name, set())
            continue
        m = re.fullmatch(r"(.+?)[._](\d+(?:\.\d+)?(?:,\d+(?:\.\d+)?)*)", name)
        if not m or m[1] not in DEFAULTS:
            raise ValueError(f"unsupported measure {name}")
        asked.setdefault(m[1], set()).update(float(x) if "recall" in m[1] and m[1] != "recall" or "mult" in m[1] else int(x) for x in m[2].split(","))
    return {k: tuple(sorted(v or DEFAULTS.get(k, ()))) for k, v in asked.items()}


def ranked(run: DataFrame, tie: str = "docno_desc") -> DataFrame:
    """run with ``rank`` from 1 within each query."""
    last = F.col("did").desc() if tie == "docno_desc" else F.col("did").asc()
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), last)))


def _gain(rel: Column) -> Column:
    return F.greatest(F.coalesce(rel, F.lit(0)), F.lit(0)).cast("double")


@dataclass
class ByClass:
    """Judgements of whole classes: rels(qid, part, rel) hold for all documents of members(did, part), but not for the one
    that has the query's id. A document is in one class, and a query judges a class once."""

    rels: DataFrame
    members: DataFrame

    def counts(self) -> DataFrame:
        """(qid, rel, n): how many documents a query judges so."""
        sizes = self.rels.join(self.members.groupBy("part").agg(F.count("*").alias("n")), "part").select("qid", "rel", "n")
        own = self.rels.join(self.members.withColumnRenamed("did", "qid"), ["qid", "part"]).select("qid", "rel", F.lit(-1).cast("long").alias("n"))
        return sizes.unionByName(own).groupBy("qid", "rel").agg(F.sum("n").alias("n")).where("n > 0")

    def look_up(self, run: DataFrame) -> DataFrame:
        """run with its rows' ``rel``; null where there is no judgement."""
        there = run.join(self.members, "did", "left").join(self.rels, ["qid", "part"], "left").drop("part")
        return there.withColumn("rel", F.when(F.col("qid") != F.col("did"), F.col("rel")))

    def pairs(self) -> DataFrame:
        """(qid, did, rel): all judgements. A class's queries are dealt over SPREAD keys, so that no class is one task's; its members go to each."""
        rels = self.rels.withColumn("__key", F.pmod(F.xxhash64("qid"), F.lit(SPREAD)))
        members = self.members.withColumn("__key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
        return rels.join(members.hint("merge"), ["part", "__key"]).where("qid <> did").select("qid", "did", "rel")


def counts(qrels: DataFrame | ByClass) -> DataFrame:
    """(qid, rel, n): a query's judgements by relevance."""
    return qrels.counts() if isinstance(qrels, ByClass) else qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))


def look_up(run: DataFrame, qrels: DataFrame | ByClass) -> DataFrame:
    """run with its rows' ``rel``; null where there is no judgement."""
    return qrels.look_up(run) if isinstance(qrels, ByClass) else run.join(qrels.select("qid", "did", "rel"), ["qid", "did"], "left")


@F.pandas_udf(DoubleType())
def _discounts(places: pd.Series) -> pd.Series:
    """The sum of the discounts 1 / log2(i + 1) of the first so many places."""
    block, (ends, which) = 1 << 20, np.unique(places.to_numpy(np.int64), return_inverse=True)
    out, total = np.zeros(len(ends)), 0.0
    for first in range(0, int(ends[-1]) if len(ends) else 0, block):
        sums = total + np.cumsum(1 / np.log2(np.arange(first, min(first + block, ends[-1])) + 2.0))
        here = (ends > first) & (ends <= first + block)
        out[here], total = sums[ends[here] - first - 1], sums[-1]
    return pd.Series(out[which])


def _levels(qrels: DataFrame | ByClass) -> DataFrame:
    """(qid, rel, n, start, end, gain): of the ideal order, the places (start, end] of a query's judgements of a relevance."""
    w = Window.partitionBy("qid").orderBy(F.col("rel").desc())
    levels = counts(qrels).withColumn("end", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return levels.withColumn("start", F.col("end") - F.col("n")).withColumn("gain", _gain(F.col("rel")))


def evaluate(run: DataFrame, qrels: DataFrame | ByClass, measures, level: int = 1, queries: DataFrame | None = None, tie: str = "docno_desc") -> DataFrame:
    """(qid, measure, value), a row for each query and measure."""
    asked = parse_measures(measures)
    if by_gain := [m for m in asked if m in BY_GAIN]:
        rest = [m for m in asked if m not in BY_GAIN]
        found = _by_gain(run, qrels, by_gain, level, queries, tie)
        if not rest:
            return found
        names = [m if m not in DEFAULTS else f"{m}.{','.join(map(str, asked[m]))}" for m in rest]
        return evaluate(run, qrels, names, level, queries, tie).unionByName(found)
    discount = F.log2(F.col("rank") + 1)
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    between = lambda k=None: _discounts("end") - _discounts("start") if k is None else _discounts(F.least("end", F.lit(k))) - _discounts(F.least("start", F.lit(k)))
    gains = {f"ideal_{k}": between(k) for k in asked.get("ndcg_cut", ())}
    if "ndcg" in asked:
        gains["ideal"] = between()
    per_query = _levels(qrels).select("qid", "rel", "n", "gain", *((F.col("gain") * v).alias(k) for k, v in gains.items())).groupBy("qid").agg(
        some(F.col("rel") >= level).alias("R"), some((F.col("rel") < level) & (F.col("rel") >= 0)).alias("N"),
        F.sum(F.when(F.col("rel") >= level, F.col("gain") * F.col("n"))).alias("gains"), *(F.sum(k).alias(k) for k in gains),
    )

    rel = F.coalesce(F.col("rel") >= level, F.lit(False))
    judged_non = F.coalesce((F.col("rel") < level) & (F.col("rel") >= 0), F.lit(False))
    w = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = look_up(ranked(run, tie), qrels).join(per_query, "qid")
    rows = rows.withColumn("hit", rel).withColumn("cum", F.count_if(rel).over(w)).withColumn("non", F.count_if(judged_non).over(w)).withColumn("pool", F.count("rel").over(w))
    cum, rank, hit = F.col("cum"), F.col("rank"), F.col("hit")
    R, N = F.col("R"), F.col("N")
    precision = cum / rank
    least = F.least(R, N)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    over_R = lambda c: F.when(F.first(R) > 0, c / F.first(R)).otherwise(F.lit(0.0))
    found = lambda k=None: F.count_if(hit if k is None else hit & (rank <= k))
    ap = over_R(zero(F.sum(F.when(hit, precision))))
    bpref = over_R(zero(F.sum(F.when(hit, F.when(least > 0, 1 - F.least(F.col("non"), least) / least).otherwise(F.lit(1.0))))))
    above = F.when(rank > 1, (F.col("pool") - 1) / rank * (cum - 1 + FLOOR) / (cum - 1 + F.col("non") + 2 * FLOOR)).otherwise(F.lit(0.0))
    set_p, set_r = found() / F.count("*"), over_R(found())
    iprec = lambda x: zero(F.max(F.when(cum >= F.floor(R * F.lit(float(x)) + 0.9), precision)))
    simple = {
        "num_q": F.lit(1.0), "num_ret": F.count("*"), "num_rel": F.first(R), "num_rel_ret": found(), "map": ap, "gm_map": F.ln(F.greatest(ap, F.lit(FLOOR))),
        "Rprec": over_R(F.count_if(hit & (rank <= R))), "bpref": bpref, "gm_bpref": F.ln(F.greatest(bpref, F.lit(FLOOR))),
        "recip_rank": zero(1 / F.min(F.when(hit, rank))), "11pt_avg": sum((iprec(x) for x in RECALLS), F.lit(0.0)) / len(RECALLS),
        "ndcg": zero(F.sum(_gain(F.col("rel")) / discount) / F.nullif(F.first("ideal"), F.lit(0.0))), "infAP": over_R(zero(F.sum(F.when(hit, 1 / rank + above)))),
        "set_P": set_p, "set_recall": set_r, "set_F": F.when(set_p + set_r > 0, 2 * set_p * set_r / (set_p + set_r)).otherwise(F.lit(0.0)), "set_map": set_p * set_r,
        "set_relative_P": F.when(F.first(R) > 0, found() / F.least(F.count("*"), F.first(R))).otherwise(F.lit(0.0)),
        "utility": 2 * found() - F.count("*"), "num_nonrel_judged_ret": F.count_if(judged_non),
        # Gains are discounted by how many documents that aren't relevant stand above, so the ideal is the sum of gains.
        "G": zero(F.sum(F.when(hit, _gain(F.col("rel")) / F.log2(2 + rank - cum))) / F.nullif(F.first("gains"), F.lit(0.0))),
        "binG": over_R(zero(F.sum(F.when(hit, 1 / F.log2(2 + rank - cum))))),
    }
    by_cut = {
        "P": lambda k: found(k) / k, "recall": lambda k: over_R(found(k)), "map_cut": lambda k: over_R(zero(F.sum(F.when(hit & (rank <= k), precision)))),
        "relative_P": lambda k: F.when(F.first(R) > 0, found(k) / F.least(F.lit(k), F.first(R))).otherwise(F.lit(0.0)), "success": lambda k: (found(k) > 0).cast("double"),
        "ndcg_cut": lambda k: zero(F.sum(F.when(rank <= k, _gain(F.col("rel")) / discount)) / F.nullif(F.first(f"ideal_{k}"), F.lit(0.0))),
        "iprec_at_recall": iprec, "Rprec_mult": lambda x: F.when(F.first(R) > 0, F.count_if(hit & (rank <= F.floor(R * F.lit(float(x)) + 0.9))) / F.first(F.floor(R * F.lit(float(x)) + 0.9))).otherwise(F.lit(0.0)),
    }
    columns: dict[str, Column] = {}
    for name, params in asked.items():
        if name in simple:
            columns[name] = simple[name]
        for p in params:
            columns[f"{name}_{p:.2f}" if isinstance(p, float) else f"{name}_{p}"] = by_cut[name](p)
    wide = rows.groupBy("qid").agg(*(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in columns.items()))
    if queries is not None:
        empty = queries.select("qid").distinct().join(per_query.select("qid", "R"), "qid").join(wide.select("qid"), "qid", "left_anti")
        low = F.lit(math.log(FLOOR))
        value = {"num_q": F.lit(1.0), "num_rel": R.cast("double"), "gm_map": low, "gm_bpref": low}
        wide = wide.unionByName(empty.select("qid", *(value.get(k, F.lit(0.0)).alias(k) for k in columns)))
    return wide.unpivot("qid", [F.col(f"`{c}`") for c in columns], "measure", "value")


def _by_gain(run: DataFrame, qrels: DataFrame | ByClass, asked: list[str], level: int, queries: DataFrame | None, tie: str) -> DataFrame:
    """``ndcg_rel``: nDCG at the rank of each relevant document that was found, averaged over all relevant ones.
    ``Rndcg``: nDCG at as many ranks as there are judgements of a relevance or more, averaged over a query's positive relevances."""
    discount = F.log2(F.col("rank") + 1)
    up_to = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    levels = _levels(qrels)
    total = levels.groupBy("qid").agg(F.sum(F.when(F.col("rel") >= level, F.col("n")).otherwise(F.lit(0))).alias("R"))
    rows = look_up(ranked(run, tie), qrels).join(total, "qid").withColumn("dcg", F.sum(_gain(F.col("rel")) / discount).over(up_to))
    # The ideal sum up to a row's rank: what each relevance has to give by then.
    met = rows.select("qid", "did", "rank", "rel", "dcg", "R").join(levels.select("qid", "start", "end", "gain"), "qid")
    met = met.withColumn("ideal", F.col("gain") * (_discounts(F.least("end", "rank")) - _discounts(F.least("start", "rank"))))
    rows = met.groupBy("qid", "rank").agg(F.first("rel").alias("rel"), F.first("dcg").alias("dcg"), F.first("R").alias("R"), F.sum("ideal").alias("ideal"))
    at = F.col("ideal")
    out = None
    if "ndcg_rel" in asked:
        each = F.sum(F.when(F.coalesce(F.col("rel") >= level, F.lit(False)), F.col("dcg") / F.nullif(at, F.lit(0.0))))
        out = rows.groupBy("qid").agg(F.when(F.first("R") > 0, F.coalesce(each, F.lit(0.0)) / F.first("R")).otherwise(F.lit(0.0)).alias("value")).select("qid", F.lit("ndcg_rel").alias("measure"), "value")
    if "Rndcg" in asked:
        # A cutoff is the last ideal place of its relevance; beyond the run's end its last sum counts.
        best = F.sum(F.col("gain") * F.col("each")).over(Window.partitionBy("qid").orderBy("end").rowsBetween(Window.unboundedPreceding, 0))
        cuts = levels.where("rel > 0").withColumn("each", _discounts("end") - _discounts("start")).select(F.col("qid").alias("c_qid"), F.col("end").alias("cut"), best.alias("best"))
        reached = rows.select("qid", "rank", "dcg").join(cuts, (F.col("qid") == F.col("c_qid")) & (F.col("rank") <= F.col("cut")))
        by_cut = reached.groupBy("qid", "cut", "best").agg(F.max("dcg").alias("dcg"))
        n = cuts.groupBy(F.col("c_qid").alias("qid")).agg(F.count("*").alias("n"))
        per = by_cut.groupBy("qid").agg(F.sum(F.col("dcg") / F.nullif(F.col("best"), F.lit(0.0))).alias("s"))
        part = rows.select("qid").distinct().join(per, "qid", "left").join(n, "qid", "left").select("qid", F.lit("Rndcg").alias("measure"), F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("value"))
        out = part if out is None else out.unionByName(part)
    if queries is not None:
        empty = queries.select("qid").distinct().join(total.select("qid"), "qid", "left_semi").join(run.select("qid"), "qid", "left_anti")
        out = out.unionByName(empty.select("qid", F.explode(F.array(*map(F.lit, asked))).alias("measure"), F.lit(0.0).alias("value")))
    return out


def aggregate(values: DataFrame) -> DataFrame:
    """(measure, value) over queries: sums of counts, the geometric mean for ``gm_``, else means."""
    name = F.col("measure")
    value = F.when(name.startswith("num_"), F.sum("value")).when(name.startswith("gm_"), F.exp(F.avg("value"))).otherwise(F.avg("value"))
    return values.groupBy("measure").agg(value.alias("value"))


def mrr(run: DataFrame, qrels: DataFrame | ByClass, cutoff: int | None = None) -> DataFrame:
    """(qid, rr) of the qrels' queries that are in the run, 0 without a relevant document in reach."""
    reach = F.lit(True) if cutoff is None else F.col("rank") <= cutoff
    rows = look_up(ranked(run).join(counts(qrels).select("qid"), "qid", "left_semi"), qrels)
    return rows.groupBy("qid").agg(F.coalesce(1 / F.min(F.when(reach & (F.col("rel") > 0), F.col("rank"))), F.lit(0.0)).alias("rr"))


def paired_t(a: DataFrame, b: DataFrame) -> DataFrame:
    """(n, mean_difference, t, p) of two (qid, value) tables over their common queries: the paired t-test, both sides.

    t and p are null for fewer than two queries and where all differences are equal.
    """
    d = a.select("qid", F.col("value").alias("x")).join(b.select("qid", F.col("value").alias("y")), "qid").select((F.col("x") - F.col("y")).alias("d"))
    tested = d.agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), (F.avg("d") / F.nullif(F.stddev_samp("d"), F.lit(0.0)) * F.sqrt(F.count("*").cast("double"))).alias("t"))
    return tested.withColumn("p", student_p(F.col("t"), F.col("n") - 1))
