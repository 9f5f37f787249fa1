"""Embedding, pooling and loss queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as V
from ..operators import contrastive as C, rows as O
from ..streaming import flows
from .registry import query

_D = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
_SUM = "list_sum(list_transform({}, lambda x: {}))"
#: Eight token states of eight numbers each, and a mask that ends early by vec_id.
_STATES = f"st AS (SELECT vec_id, list_transform(range(0, 8), lambda i: e[8 * i + 1 : 8 * i + 8]) AS s, list_transform(range(0, 8), lambda i: CASE WHEN i < 3 + vec_id % 6 THEN 1 ELSE 0 END) AS m FROM ({_D}))"


def _states(t) -> DataFrame:
    s = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i < 3 + F.col("vec_id") % 6).cast("int"))
    return t.embeddings.select("vec_id", s.alias("s"), m.alias("m"))


def _first(column) -> DataFrame:
    return F.round(F.get(column, F.lit(0)), 6)


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: (3 * x / greatest(sqrt(list_sum(list_transform(e, lambda y: 9 * y * y))), 1e-12)) * x)), 6) AS v FROM ({_D})")
def l2_normalize(t):
    scaled = F.transform(V.doubles(F.col("embedding")), lambda x: x * 3)
    return t.embeddings.select("vec_id", F.round(V.dot(V.l2_normalize(scaled), F.col("embedding")), 6).alias("v"))


@query(f"WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(list_transform(range(1, 9), lambda k: list_sum(list_transform(range(1, 9), lambda j: s[j][k] * m[j])) / list_sum(m))), 6) AS x FROM st")
def pool_mean(t):
    return _long(_states(t).select("vec_id", V.pool_mean(F.col("s"), F.col("m")).alias("v")))


@query(f"""WITH {_STATES}, w AS (SELECT vec_id, s, list_transform(range(1, 9), lambda j: m[j] * list_sum(m[1 : j])) AS w FROM st)
SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(list_transform(range(1, 9), lambda k: list_sum(list_transform(range(1, 9), lambda j: s[j][k] * w[j])) / list_sum(w))), 6) AS x FROM w""")
def pool_wmean(t):
    return _long(_states(t).select("vec_id", V.pool_weighted_mean(F.col("s"), F.col("m")).alias("v")))


@query(f"WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(s[list_sum(m)::BIGINT]), 6) AS x FROM st")
def pool_last(t):
    return _long(_states(t).select("vec_id", V.doubles(V.pool_last(F.col("s"), F.col("m"))).alias("v")))


@query(f"WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(s[1]), 6) AS x FROM st")
def pool_cls(t):
    return _long(_states(t).select("vec_id", V.doubles(V.pool_first(F.col("s"))).alias("v")))


def _long(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


# Pairs: vector 2i asks, vector 2i + 1 answers; a batch is 32 questions.
_PAIRS = f"""p AS (SELECT a.vec_id // 64 AS batch, a.vec_id // 2 % 32 AS i, a.e AS q, b.e AS d FROM ({_D}) a JOIN ({_D}) b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
s AS (SELECT a.batch, a.i, b.i AS j, list_dot_product(a.q, b.d) / 0.2 AS s FROM p a JOIN p b USING (batch))"""


def _pairs(t) -> DataFrame:
    v = t.embeddings.select("vec_id", "embedding")
    q = v.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("query"))
    d = v.where("vec_id % 2 = 1").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("doc"))
    return q.join(d, "vec_id").select(F.floor(F.col("vec_id") / 64).alias("batch"), (F.floor(F.col("vec_id") / 2) % 32).alias("i"), "query", "doc")


@query(f"WITH {_PAIRS}, l AS (SELECT batch, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY batch, i) SELECT batch, round(avg(loss), 6) AS loss FROM l GROUP BY batch")
def inbatch_ce(t):
    return C.in_batch_loss(_pairs(t), 0.2).select("batch", F.round("loss", 6).alias("loss"))


@query(f"""WITH {_PAIRS}, l AS (SELECT batch, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY batch, i),
r AS (SELECT batch, j, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY batch, j)
SELECT batch, round((a + b) / 2, 6) AS loss FROM (SELECT batch, avg(loss) AS a FROM l GROUP BY batch) JOIN (SELECT batch, avg(loss) AS b FROM r GROUP BY batch) USING (batch)""")
def inbatch_ce_biaxial(t):
    return C.in_batch_loss(_pairs(t), 0.2, both=True).select("batch", F.round("loss", 6).alias("loss"))


@query(f"WITH {_PAIRS}, l AS (SELECT batch, i, arg_max(j, s) AS best FROM s GROUP BY batch, i) SELECT batch, round(avg((best = i)::INT), 6) AS accuracy FROM l GROUP BY batch")
def inbatch_accuracy(t):
    return C.in_batch_accuracy(_pairs(t)).select("batch", F.round("accuracy", 6).alias("accuracy"))


_LSE = "ln(list_sum(list_transform(e[1:10], lambda x: exp(x))))"


@query(f"SELECT vec_id, round(0.9 * ({_LSE} - e[label + 1]) + 0.1 * ({_LSE} - list_sum(e[1:10]) / 10), 6) AS loss FROM ({_D})")
def label_smoothing_ce(t):
    return t.embeddings.select("vec_id", F.round(V.label_smoothing_ce(F.slice("embedding", 1, 10), F.col("label")), 6).alias("loss"))


@query(f"SELECT vec_id, round({_LSE} - (e[label + 1] * 0.91 + 0.01 * (list_sum(e[1:10]) - e[label + 1])), 6) AS loss FROM ({_D})")
def soft_target_loss(t):
    target = V.one_hot(F.col("label"), 10, 0.1)
    return t.embeddings.select("vec_id", F.round(V.soft_target_ce(F.slice("embedding", 1, 10), target), 6).alias("loss"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i = label + 1 THEN ln(1 + exp(-e[i])) ELSE ln(1 + exp(e[i])) END)) / 10, 6) AS loss FROM ({_D})")
def binary_loss(t):
    return t.embeddings.select("vec_id", F.round(V.binary_ce(F.slice("embedding", 1, 10), V.one_hot(F.col("label"), 10)), 6).alias("loss"))


_SIG = "(1 / (1 + exp(-e[i])))"


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i = label + 1 THEN -ln(greatest({_SIG}, 1e-8)) * pow(1 - {_SIG}, 1) ELSE -ln(greatest(least(1 - {_SIG} + 0.05, 1), 1e-8)) * pow(1 - least(1 - {_SIG} + 0.05, 1), 4) END)), 6) AS loss FROM ({_D})")
def asymmetric_loss(t):
    return t.embeddings.select("vec_id", F.round(V.asymmetric_loss(F.slice("embedding", 1, 10), V.one_hot(F.col("label"), 10)), 6).alias("loss"))


_SOFT = "list_transform({0}, lambda x: exp(x) / list_sum(list_transform({0}, lambda y: exp(y))))"


@query(f"""WITH d AS (SELECT vec_id, {_SOFT.format('e[1:8]')} AS p, {_SOFT.format('e[9:16]')} AS q FROM ({_D}))
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: p[i] * (ln(p[i]) - ln((p[i] + q[i]) / 2)) + q[i] * (ln(q[i]) - ln((p[i] + q[i]) / 2)))) / 2, 6) AS v FROM d""")
def js_divergence(t):
    p, q = (V.softmax(F.slice("embedding", s, 8)) for s in (1, 9))
    return t.embeddings.select("vec_id", p.alias("p"), q.alias("q")).select("vec_id", F.round(V.js_divergence(F.col("p"), F.col("q")), 6).alias("v"))


@query(f"""WITH o AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings),
m AS (SELECT a.vec_id, a.label AS x, b.label AS y FROM o a JOIN o b ON b.i = a.n - 1 - a.i)
SELECT vec_id, unnest(range(0, 10)) AS c, round(unnest(list_transform(range(0, 10), lambda c: 0.7::DOUBLE * (CASE WHEN c = x THEN 0.91 ELSE 0.01 END) + 0.3::DOUBLE * (CASE WHEN c = y THEN 0.91 ELSE 0.01 END))), 6) AS v FROM m""")
def mixup_pairs(t):
    out = C.mixup_targets(t.embeddings.select("vec_id", "label"), "vec_id", "label", 10, 0.7, 0.1)
    return out.select("vec_id", F.posexplode("target").alias("c", "v")).select("vec_id", F.col("c").cast("long").alias("c"), F.round("v", 6).alias("v"))


@query(f"SELECT round(100 * avg((list_position(list_reverse_sort(e[1:10]), e[label + 1]) <= 1)::INT), 6) AS top1, round(100 * avg((list_position(list_reverse_sort(e[1:10]), e[label + 1]) <= 5)::INT), 6) AS top5 FROM ({_D})")
def topk_accuracy(t):
    best = F.transform(V.top_k(F.slice("embedding", 1, 10), 5), lambda p: p["index"])
    return C.top_k_accuracy(t.embeddings.select(best.alias("best"), "label"), (1, 5))


@query(f"""WITH r AS (SELECT vec_id, label, list_position(e[1:10], list_max(e[1:10])) - 1 AS top, CASE WHEN vec_id % 7 = 0 THEN [] ELSE [label, (label + 1) % 10] END AS real FROM ({_D}))
SELECT round(100 * avg(list_contains(real, top)::INT), 6) AS top1 FROM r WHERE len(real) > 0""")
def real_label_accuracy(t):
    real = F.when(F.col("vec_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("label"), (F.col("label") + 1) % 10))
    best = F.transform(V.top_k(F.slice("embedding", 1, 10), 1), lambda p: p["index"].cast("int"))
    return C.real_label_accuracy(t.embeddings.select(best.alias("best"), real.alias("real")), (1,))


@query("SELECT label, round(sum(embedding[1]::DOUBLE * vec_id) / sum(vec_id), 6) AS mean FROM embeddings GROUP BY label")
def weighted_mean(t):
    return C.weighted_mean(t.embeddings.select("label", F.get("embedding", F.lit(0)).cast("double").alias("value"), F.col("vec_id").alias("n")), ["label"]).select("label", F.round("mean", 6).alias("mean"))


@query("SELECT label, i, round(avg(x), 6) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY label, i")
def vector_average(t):
    m = O.average_vectors(t.embeddings, "embedding", ["label"])
    return m.select("label", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("""WITH best AS (SELECT label, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS r FROM embeddings) WHERE r <= 10)
SELECT label, i, round(avg(x), 6) AS x, count(*) AS n FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(e) AS x FROM best) GROUP BY label, i""")
def average_of_best(t):
    """The mean of each label's ten vectors with the largest first component."""
    rows = t.embeddings.select("vec_id", "label", "embedding", F.get("embedding", F.lit(0)).cast("double").alias("metric"))
    m = O.average_best(rows, "metric", 10, group=["label"], tie="vec_id")
    return m.select("label", "n", F.posexplode("embedding").alias("i", "x")).select("label", (F.col("i") + 1).cast("long").alias("i"), F.round("x", 6).alias("x"), "n")


# -- micro-batches, devices, and the losses that stand alone ---------------------------


@query(f"WITH {_PAIRS}, l AS (SELECT batch, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY batch, i) SELECT batch, round(avg(loss), 6) AS loss FROM l GROUP BY batch")
def inbatch_ce_micro(t):
    """The same loss from micro-batches of 5 questions."""
    return C.in_batch_loss(_pairs(t), 0.2, micro=5).select("batch", F.round("loss", 6).alias("loss"))


@query(f"""WITH {_PAIRS.partition(",\ns AS")[0]}, g AS (SELECT batch // 4 AS batch, (batch % 4) * 32 + i AS i, q, d FROM p),
s AS (SELECT a.batch, a.i, b.i AS j, list_dot_product(a.q, b.d) / 0.2 AS s FROM g a JOIN g b USING (batch)),
l AS (SELECT batch, i, ln(sum(exp(s))) - max(s) FILTER (i = j) AS loss FROM s GROUP BY batch, i) SELECT batch, round(avg(loss), 6) AS loss FROM l GROUP BY batch""")
def cross_device_ce(t):
    """Negatives of four devices: each question against the documents of four batches."""
    return C.in_batch_loss(C.gather_batches(_pairs(t), 4), 0.2).select("batch", F.round("loss", 6).alias("loss"))


@query(f"WITH {_PAIRS} SELECT batch, i, j, round(s, 6) AS s FROM s")
def score_matrix(t):
    return C.score_matrix(_pairs(t), 0.2).select("batch", "i", "j", F.round("s", 6).alias("s"))


@query(f"""WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(list_transform(range(1, 9), lambda k:
  CASE WHEN ('0x' || substr(md5(vec_id || '|' || (k - 1)), 1, 8))::BIGINT / 4294967296 >= 0.25 THEN list_sum(list_transform(range(1, 9), lambda j: s[j][k] * m[j])) / list_sum(m) / 0.75 ELSE 0 END)), 6) AS x FROM st""")
def pool_dropout(t):
    """A quarter of the components, by a seed for each row."""
    s = V.dropout(F.col("s"), 0.25, F.col("vec_id"))
    return _long(_states(t).select("vec_id", V.pool_mean(s, F.col("m")).alias("v")))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (e[i] - e[i + 32]) ** 2)) / 32, 6) AS mse, round(list_sum(list_transform(range(1, 33), lambda i: e[i] ** 2 * (ln(e[i] ** 2) - e[i + 32]))), 6) AS kl FROM ({_D})")
def distillation_losses(t):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    squares = F.transform(V.doubles(a), lambda x: x * x)
    return t.embeddings.select("vec_id", F.round(V.mse(a, b), 6).alias("mse"), F.round(V.kl_divergence(squares, V.doubles(b)), 6).alias("kl"))


@query(f"SELECT vec_id, round(e[4], 6) AS a, round(e[1], 6) AS b, round(e[64], 6) AS c FROM ({_D})")
def valid_label_logits(t):
    v = C.subset_logits(V.doubles(F.col("embedding")), [3, 0, 63])
    return t.embeddings.select("vec_id", *[F.round(F.get(v, F.lit(i)), 6).alias(n) for i, n in enumerate("abc")])


@query("SELECT vec_id, vec_id % 9 = 0 AS bad FROM embeddings")
def nan_guard(t):
    v = F.transform("embedding", lambda x, i: F.when((i == 5) & (F.col("vec_id") % 9 == 0), F.lit(float("nan")).cast("float")).otherwise(x))
    return t.embeddings.select("vec_id", V.has_nan(v).alias("bad"))


@query(f"WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i, round(unnest(list_transform(range(1, 9), lambda k: list_max(list_transform(range(1, 9), lambda j: CASE WHEN m[j] = 1 THEN s[j][k]::FLOAT END)))), 6)::DOUBLE AS x FROM st")
def pool_by_model(t):
    """A model's own pooling: the largest value of each component."""
    def pooler(batch):
        return [[float(max(s[k] for s, m in zip(states, mask) if m)) for k in range(8)] for states, mask in zip(batch["s"], batch["m"])]

    return _long(flows.pool(_states(t), pooler, "vec_id", "s", "m").select("vec_id", V.doubles(F.col("embedding")).alias("v")))


@query(f"""WITH {_STATES} SELECT vec_id, unnest(range(1, 9)) AS i,
round(unnest(list_transform(range(0, 8), lambda j: CASE WHEN j >= 1 AND j < 3 THEN s[j][1] * 10 WHEN j >= 5 AND j < 6 + vec_id % 2 THEN s[j - 4][2] * 10 ELSE s[j + 1][1] END)), 6) AS x FROM st""")
def vision_scatter(t):
    """Two images' states in the places that the bounds name; the first component of every token."""
    ten = lambda first, component, n: F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda j: F.array(F.get(F.get("s", j), F.lit(component)) * 10))
    bounds = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(5).alias("start"), (6 + F.col("vec_id") % 2).cast("int").alias("end")))
    tokens = F.transform("s", lambda x: F.array(F.get(V.doubles(x), F.lit(0))))
    images = F.array(F.transform(ten(0, 0, 2), lambda x: V.doubles(x)), F.transform(ten(0, 1, 2), lambda x: V.doubles(x)))
    out = V.scatter(tokens, bounds, images)
    return _long(_states(t).select("vec_id", F.transform(out, lambda x: F.get(x, F.lit(0))).alias("v")))
