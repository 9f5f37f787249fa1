"""Metric values that are known exactly, name sets, empty inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.operators import metrics as M

QRELS = [("q1", "d1", 0), ("q1", "d2", 1), ("q1", "d3", 0), ("q2", "d2", 1), ("q2", "d3", 1)]
RUN = "qid string, did string, score double"
REL = "qid string, did string, rel int"


def values(spark, run, qrels, measures, **kw):
    out = M.evaluate(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, REL), measures, **kw).collect()
    return {(r.qid, r.measure): r.value for r in out}


@pytest.mark.parametrize(("scores", "ndcg"), [((1.0, 0.0, 1.5), 0.5), ((1.0, 2.0, 1.5), 1.0), ((4.0, 2.0, 1.5), 0.6309297535714575)])
def test_ndcg(spark, scores, ndcg):
    run = [("q1", f"d{i + 1}", s) for i, s in enumerate(scores)]
    assert values(spark, run, QRELS, "ndcg")["q1", "ndcg"] == pytest.approx(ndcg)


def test_documented_example(spark):
    run = [("q1", "d1", 1.0), ("q1", "d2", 0.0), ("q1", "d3", 1.5), ("q2", "d1", 1.5), ("q2", "d2", 0.2), ("q2", "d3", 0.5)]
    got = values(spark, run, QRELS, ("map", "ndcg"))
    assert got["q1", "map"] == pytest.approx(1 / 3)
    assert got["q2", "map"] == pytest.approx(0.5833333333333333)
    assert got["q2", "ndcg"] == pytest.approx(0.6934264036172708)


def test_cutoffs(spark):
    run = [("q1", "d1", 1.0), ("q1", "d2", 0.0), ("q1", "d3", 1.5)]
    got = values(spark, run, QRELS, "ndcg_cut.1,2,3,1000")
    assert [got["q1", f"ndcg_cut_{k}"] for k in (1, 2, 3, 1000)] == pytest.approx([0, 0, 0.5, 0.5])


def test_parameters_are_merged_and_override_defaults():
    assert M.parse_measures(["P.5", "P_10", "P.100,20"]) == {"P": (5, 10, 20, 100)}
    assert M.parse_measures(["P"]) == {"P": M.CUTS}
    assert M.parse_measures(["P", "P_3"]) == {"P": (3,)}
    assert set(M.parse_measures("set")) == set(M.NICKNAMES["set"])
    with pytest.raises(ValueError):
        M.parse_measures(["nope"])


def test_level_two_counts_only_higher_grades(spark):
    qrels = [("q", "a", 1), ("q", "b", 2)]
    run = [("q", "a", 2.0), ("q", "b", 1.0)]
    assert values(spark, run, qrels, ("map", "num_rel"), level=2) == {("q", "map"): 0.5, ("q", "num_rel"): 1.0}


@pytest.mark.parametrize(("run", "qrels"), [([], QRELS), ([("q1", "d1", 1.0)], []), ([], []), ([("other", "d1", 1.0)], QRELS)])
def test_empty_inputs_give_no_rows(spark, run, qrels):
    assert values(spark, run, qrels, ("ndcg", "map")) == {}


def test_query_without_results_scores_zero(spark):
    named = spark.createDataFrame([("q1",), ("q2",), ("q9",)], "qid string")
    got = values(spark, [("q2", "d2", 1.0)], QRELS, ("map", "num_rel", "gm_map"), queries=named)
    assert got["q1", "map"] == 0 and got["q1", "num_rel"] == 1 and got["q1", "gm_map"] == pytest.approx(math.log(1e-5))
    assert got["q2", "map"] == 0.5 and not any(q == "q9" for q, _ in got)


def test_row_order_does_not_matter(spark):
    run = [("q1", f"d{i}", float(i % 4)) for i in range(12)]
    qrels = [("q1", f"d{i}", i % 3) for i in range(9)]
    asked = ("all_trec",)
    assert values(spark, run, qrels, asked) == values(spark, run[::-1], qrels[::-1], asked)


def test_aggregates(spark):
    v = spark.createDataFrame([("a", "num_ret", 2.0), ("b", "num_ret", 3.0), ("a", "map", 0.2), ("b", "map", 0.4), ("a", "gm_map", math.log(0.2)), ("b", "gm_map", math.log(0.8))], "qid string, measure string, value double")
    got = {r.measure: r.value for r in M.aggregate(v).collect()}
    assert got["num_ret"] == 5 and got["map"] == pytest.approx(0.3) and got["gm_map"] == pytest.approx(0.4)


def test_mrr_counts_ranked_queries_only(spark):
    run = spark.createDataFrame([("q1", "d1", 3.0), ("q1", "d2", 2.0)], RUN)
    got = {r.qid: r.rr for r in M.mrr(run, spark.createDataFrame(QRELS, REL), 10).collect()}
    assert got == {"q1": 0.5}


def test_paired_t_equals_published_tables(spark):
    """Two-sided 5 %, 1 % and 0.1 % points of Student's t."""
    from fathomry.functions.stats import incomplete_beta, student_p

    table = [(1, 12.706, 0.05), (2, 4.303, 0.05), (4, 2.776, 0.05), (10, 2.228, 0.05), (30, 2.042, 0.05), (120, 1.980, 0.05), (1, 63.657, 0.01), (5, 4.032, 0.01), (10, 3.169, 0.01), (10, 4.587, 0.001), (10_000_000, 1.96, 0.05), (7, 0.0, 1.0), (3, -3.182, 0.05)]
    df = spark.createDataFrame(table, "v long, t double, p double").select("p", student_p(F.col("t"), F.col("v")).alias("got"))
    assert all(abs(r.p - r.got) < 2e-4 * max(1, r.p * 10) for r in df.collect())
    one = lambda a, b, x: spark.range(1).select(incomplete_beta(F.lit(a), F.lit(b), F.lit(x))).first()[0]
    assert one(1.0, 1.0, 0.3) == pytest.approx(0.3, abs=1e-12) and one(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-12) and one(0.5, 0.5, 0.25) == pytest.approx(1 / 3, abs=1e-12)


def test_paired_t_of_few_queries(spark):
    values = lambda *v: spark.createDataFrame(list(enumerate(v)), "qid long, value double")
    # t = 3 / (sqrt(2.5) / sqrt(5)) with 4 degrees of freedom
    r = M.paired_t(values(1.0, 2.0, 3.0, 4.0, 5.0), values(0.0, 0.0, 0.0, 0.0, 0.0)).first()
    assert (r.n, r.mean_difference) == (5, 3.0) and r.t == pytest.approx(18**0.5) and r.p == pytest.approx(0.013236, abs=1e-6)
    assert M.paired_t(values(1.0), values(0.0)).first().p is None and M.paired_t(values(1.0, 2.0), values(0.0, 1.0)).first().p is None


def test_judgements_by_class_are_never_pairs(spark):
    """Classes give what their pairs give, for every measure, and no join makes more rows than the run has."""
    members = spark.range(60).select(F.col("id").alias("did"), (F.col("id") % 6).alias("part"))
    rels = spark.range(0, 60, 5).select(F.col("id").alias("qid"), F.posexplode(F.array(*map(F.lit, (2, 0, -1, 1)))).alias("part", "rel")).withColumn("part", (F.col("part") + F.col("qid")) % 6)
    classes = M.ByClass(rels, members)
    pairs = {(q, d, r) for q, p, r in rels.collect() for d in range(60) if d % 6 == p and d != q}
    assert {tuple(x) for x in classes.pairs().collect()} == pairs
    run = spark.range(0, 60, 5).select(F.col("id").alias("qid"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i")).select("qid", ((F.col("i") * 7 + F.col("qid")) % 60).alias("did"), (F.col("i") % 9).cast("double").alias("score"))
    table = spark.createDataFrame(sorted(pairs), "qid long, did long, rel int")
    key = lambda values: {(r.qid, r.measure): pytest.approx(r.value, abs=1e-9) for r in values.collect()}
    want = key(M.evaluate(run, table, "all_trec"))
    assert {(r.qid, r.measure): r.value for r in M.evaluate(run, classes, "all_trec").collect()} == want and len(want) > 1000
    plan = M.evaluate(run, classes, ("ndcg", "map"))._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "__key" not in plan
    assert {tuple(r) for r in M.mrr(run, classes, 10).collect()} == {tuple(r) for r in M.mrr(run, table, 10).collect()}


def test_ideal_gains_by_counts_at_any_number_of_places(spark):
    """The sum of discounts beyond a block of a million places."""
    places = [0, 1, 2, 50, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 2_500_000]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in places], "p long").coalesce(1).select(M._discounts("p")).collect()]
    sums = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2_500_000) + 2.0))])
    assert got == pytest.approx([sums[p] for p in places], rel=1e-12)
