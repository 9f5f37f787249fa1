"""Vector and loss arithmetic on arrays, in doubles, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v at length 1; a vector shorter than eps is divided by eps."""
    size = F.greatest(norm(v), F.lit(eps))
    return F.transform(doubles(v), lambda x: x / size)


def has_nan(v: Column) -> Column:
    return F.exists(doubles(v), lambda x: F.isnan(x) | x.isNull())


def _weighted(states: Column, weights: Column, floor: float) -> Column:
    """Weighted mean of an array of vectors."""
    total = F.greatest(_sum(doubles(weights)), F.lit(floor))
    dim = F.size(F.get(states, F.lit(0)))
    scaled = F.zip_with(states, doubles(weights), lambda s, w: F.transform(doubles(s), lambda x: x * w))
    zero = F.array_repeat(F.lit(0.0), dim)
    return F.transform(F.aggregate(scaled, zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y)), lambda x: x / total)


def pool_mean(states: Column, mask: Column, floor: float = 1e-9) -> Column:
    return _weighted(states, mask, floor)


def pool_weighted_mean(states: Column, mask: Column, floor: float = 1e-9) -> Column:
    """Later tokens weigh more: the mask times its running sum."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    # The running sums are built in one walk: it appends m * sum to a list that only grows.
    step = lambda s, m: F.struct((s.sum + m).alias("sum"), F.array_append(s["all"], m * (s.sum + m)).alias("all"))
    running = F.aggregate(doubles(mask), start, step, lambda s: s["all"])
    return _weighted(states, running, floor)


def pool_last_normal(states: Column, mask: Column, left_padded: Column | None = None) -> Column:
    """The last state at length 1."""
    return l2_normalize(pool_last(states, mask, left_padded))


def scatter(states: Column, bounds: Column, images: Column) -> Column:
    """Token states with those inside the k-th bound (start, end) replaced by the k-th image's, one after the other."""
    spans = F.arrays_zip(bounds.alias("b"), images.alias("v"))

    def one(state: Column, i: Column) -> Column:
        inside = F.get(F.filter(spans, lambda x: (x.b.start <= i) & (i < x.b.end)), F.lit(0))
        return F.coalesce(F.get(inside.v, (i - inside.b.start).cast("int")), state)

    return F.transform(states, one)


def dropout(states: Column, share: float, seed: Column) -> Column:
    """Whole components of all states set to 0 with probability ``share`` and the rest scaled up, by an md5 of (seed, component): reproducible."""
    if not share:
        return states
    dim = F.size(F.get(states, F.lit(0)))
    kept = F.transform(F.sequence(F.lit(0), dim - 1), lambda i: F.when(F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32) >= share, 1 / (1 - share)).otherwise(0.0))
    return F.transform(states, lambda s: F.zip_with(doubles(s), kept, lambda x, k: x * k))


def pool_last(states: Column, mask: Column, left_padded: Column | None = None) -> Column:
    """The last position if the whole batch is left-padded, else that of the last masked-in token."""
    last = F.element_at(states, -1)
    right = F.element_at(states, F.greatest(_sum(doubles(mask)).cast("int"), F.lit(1)))
    return right if left_padded is None else F.when(left_padded, last).otherwise(right)


def pool_first(states: Column) -> Column:
    return F.get(states, F.lit(0))


def softmax(logits: Column) -> Column:
    top = F.array_max(doubles(logits))
    e = F.transform(doubles(logits), lambda x: F.exp(x - top))
    total = _sum(e)
    return F.transform(e, lambda x: x / total)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(doubles(logits))
    log_total = F.ln(_sum(F.transform(doubles(logits), lambda x: F.exp(x - top))))
    return F.transform(doubles(logits), lambda x: x - top - log_total)


def top_k(values: Column, k: int) -> Column:
    """The k largest as (value, index); of equal values the smaller index first."""
    pairs = F.transform(doubles(values), lambda x, i: F.struct((-x).alias("x"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p.x).alias("value"), p["index"].alias("index")))


def one_hot(label: Column, classes: int, smoothing: float = 0.0) -> Column:
    """Label smoothing gives every class an equal share of ``smoothing``."""
    off = smoothing / classes
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.when(c == label, F.lit(1 - smoothing + off)).otherwise(F.lit(off)))


def mixup(one: Column, other: Column, share: float) -> Column:
    return F.zip_with(one, other, lambda x, y: x * share + y * (1 - share))


# -- losses of one row -----------------------------------------------------------------


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.get(log_softmax(logits), label)


def label_smoothing_ce(logits: Column, label: Column, smoothing: float = 0.1) -> Column:
    logs = log_softmax(logits)
    return -F.get(logs, label) * (1 - smoothing) - _sum(logs) / F.size(logs) * smoothing


def soft_target_ce(logits: Column, target: Column) -> Column:
    return -_sum(F.zip_with(log_softmax(logits), doubles(target), lambda x, y: x * y))


def kl_divergence(target: Column, logs: Column) -> Column:
    """Sum of t * (ln t - logs), where t is 0 nothing."""
    return _sum(F.zip_with(doubles(target), doubles(logs), lambda t, q: F.when(t > 0, t * (F.ln(t) - q)).otherwise(F.lit(0.0))))


def js_divergence(*distributions: Column) -> Column:
    """Mean divergence of distributions from their mixture (clamped at 1e-7)."""
    n = len(distributions)
    mixture = doubles(distributions[0])
    for d in distributions[1:]:
        mixture = F.zip_with(mixture, doubles(d), lambda x, y: x + y)
    logs = F.transform(mixture, lambda x: F.ln(F.least(F.greatest(x / n, F.lit(1e-7)), F.lit(1.0))))
    total = kl_divergence(distributions[0], logs)
    for d in distributions[1:]:
        total = total + kl_divergence(d, logs)
    return total / n


def binary_ce(logits: Column, target: Column) -> Column:
    """Mean of -t ln s(x) - (1 - t) ln s(-x)."""
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    each = F.zip_with(doubles(logits), doubles(target), lambda x, t: t * soft(-x) + (1 - t) * soft(x))
    return _sum(each) / F.size(logits)


def asymmetric_loss(logits: Column, target: Column, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05, eps: float = 1e-8) -> Column:
    """Multi-label loss with separate focusing of both signs; the negative side is shifted by ``clip``."""
    def each(x: Column, t: Column) -> Column:
        pos = 1 / (1 + F.exp(-x))
        neg = F.least(1 - pos + clip, F.lit(1.0)) if clip else 1 - pos
        loss = t * F.ln(F.greatest(pos, F.lit(eps))) + (1 - t) * F.ln(F.greatest(neg, F.lit(eps)))
        weight = F.pow(1 - (pos * t + neg * (1 - t)), gamma_pos * t + gamma_neg * (1 - t))
        return -loss * weight

    return _sum(F.zip_with(doubles(logits), doubles(target), each))


def mse(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))) / F.size(a)
