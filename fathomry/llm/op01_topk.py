"""Exact top-k inner products by dual-tree cover-tree search.

Queries and data are indexed together: one set of pivots, chosen on a bounded sample, sends
every vector of either side to its nearest pivot, and below a pivot both are cut into chunks of
bounded size. Each data chunk is stored with its cover tree (``_cover``). A task takes one chunk
of queries, builds their tree, visits the pivots' chunks in the order of their upper bounds and
descends both trees at once: a pair of nodes with centers a, b and covering radii r, s can't
score above ``a.b + r|b| + s|a| + rs``, and is pruned when that is below the worst kept score of
the queries under its node. What is left is scored in exact integer arithmetic (as floats where
every sum is below their exact range). ``share_scored`` tells how many pairs were.

Equal vectors are one point that keeps the rows of its k + 1 smallest ids: more can't be in any
answer. So a vector that a third of all rows share costs one point. A query whose id has several
rows leaves all of them out before its list is cut to k. The index is a table in the shared
folder; tasks read the chunks they need one by one, nothing is broadcast but the pivots.

Vectors whose norm is 2**31 or more don't fit that arithmetic. They are chunks of their own,
compared with everything in Python integers, whatever it takes; their order is exact, and a
score outside of 64 bits is given as the nearest number inside.

Defined results: vectors that are null, hold a null or non-finite component, and rows without
vec_id take no part; shorter vectors count as padded with 0; repeated rows are a candidate each
and a query each; a row with the query's own id never answers it; ties go to the smaller
vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _cover as C
from ._work import Work

K, SCALE = 20, 64
#: Data points and query points of a chunk; pivots at most, and the sample that they come from.
CHUNK, GROUP, PIVOTS, SAMPLE = 4096, 4096, 1024, 8192
#: Points of a leaf, on average.
DATA_LEAF, QUERY_LEAF = 8, 4
#: Tasks of the search at most.
MOST_TASKS = 10_000
#: The pivot of vectors that are compared in Python integers.
HUGE = -1

_KINDS = ((1, "<i1"), (2, "<i2"), (4, "<i4"), (8, "<f8"))


def pack(v: np.ndarray) -> bytes:
    """A canonical form of a vector of integers (as doubles): the narrowest type, trailing zeros gone."""
    v = v[: np.max(np.flatnonzero(v), initial=-1) + 1]
    top = max(v.max(initial=0), -v.min(initial=0) - 1)
    size, kind = next((s, k) for s, k in _KINDS if s == 8 or top < 1 << (8 * s - 1))
    return bytes([size]) + (v + 0.0).astype(kind).tobytes()


def unpack(packed: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(p, dict(_KINDS)[p[0]], offset=1) for p in packed]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def is_huge(v: np.ndarray) -> bool:
    with np.errstate(over="ignore"):
        return not float((v * v).sum()) < (1 << 62) * (1 - 1e-9)


def integers(x: np.ndarray) -> list[list[int]]:
    return [[int(c) for c in row] for row in x]


def exact_products(x: list[list[int]], y: list[list[int]]) -> list[list[int]]:
    return [[sum(a * b for a, b in zip(u, v)) for v in y] for u in x]


def quantise(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, vec, query, huge) of the rows that take part."""

    def plain(batch: pa.RecordBatch):
        """A batch of whole rows of one length and small components, all at once; None if it isn't one."""
        v = batch.column(1)
        sizes = np.diff(np.asarray(v.offsets))
        if v.null_count or not len(sizes) or sizes.min() != sizes.max() or not sizes[0] or v.flatten().null_count:
            return None
        x = np.floor(np.asarray(v.flatten(), np.float64).reshape(len(sizes), -1) * SCALE)
        if not np.isfinite(x).all() or not (x[:, -1] != 0).all() or x.max() > 127 or x.min() < -128:
            return None
        same = np.zeros(len(x), bool)
        return [b"\x01" + row.tobytes() for row in x.astype("<i1")], same

    def run(batches):
        for batch in batches:
            if (done := plain(batch)) is not None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done[0], pa.binary()), batch.column(2), pa.array(done[1])], ["vec_id", "vec", "query", "huge"])
                continue
            ids, packed, query, huge = [], [], [], []
            for i, v, q in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                with np.errstate(over="ignore"):
                    x = np.floor(np.array([np.nan if c is None else c for c in v], np.float64) * SCALE)
                if np.isfinite(x).all():
                    ids.append(i)
                    packed.append(pack(x))
                    query.append(q)
                    huge.append(is_huge(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(query, pa.bool_()), pa.array(huge, pa.bool_())], ["vec_id", "vec", "query", "huge"])

    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    return rows.select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("query")).mapInArrow(run, "vec_id long, vec binary, query boolean, huge boolean")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the point that the others cover worst."""
    return sample[C.farthest_first(sample, n)[0]] if len(sample) else sample


def _placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with the nearest pivot and the distance to it; HUGE and 0 for those."""

    def run(batches):
        for batch in batches:
            huge = batch.column(batch.schema.get_field_index("huge")).to_numpy(zero_copy_only=False).astype(bool)
            x = unpack([p if not h else b"\x01" for p, h in zip(batch.column(batch.schema.get_field_index("vec")).to_pylist(), huge)])
            away = C.reach(x, pivots) if len(pivots) else np.zeros((len(x), 1))
            leaf = away.argmin(1)
            far = np.where(huge, 0.0, away[np.arange(len(leaf)), leaf])
            yield batch.append_column("leaf", pa.array(np.where(huge, HUGE, leaf).astype(np.int32))).append_column("away", pa.array(far))

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    return points.mapInArrow(run, StructType([*points.schema.fields]).add("leaf", IntegerType()).add("away", DoubleType()))


def _chunks(placed: DataFrame, size: int) -> tuple[DataFrame, dict[int, float], int]:
    """placed with a chunk in each leaf; the leaves' radii (at most PIVOTS and one); how many chunks there are."""
    stats = {r.leaf: (r.n, r.radius) for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    parts = placed.sparkSession.createDataFrame([(leaf, math.ceil(n / size)) for leaf, (n, _) in stats.items()], "leaf int, parts int")
    dealt = placed.join(F.broadcast(parts), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")).drop("parts")
    return dealt, {leaf: radius for leaf, (_, radius) in stats.items()}, sum(math.ceil(n / size) for n, _ in stats.values())


def _matrix(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a component, the components) of a chunk, in the narrowest type for all."""
    top = max(x.max(initial=0), -x.min(initial=0) - 1)
    size, kind = next((s, k) for s, k in _KINDS if s == 8 or top < 1 << (8 * s - 1))
    return size, x.astype(kind).tobytes()


_CHUNK = "leaf int, points int, size int, vecs binary, starts binary, ids binary, nodes binary, radius binary"


def _stored(t: pa.Table) -> pa.Table:
    """A chunk of data as one row: its points in the order of its cover tree, their ids, and the tree."""
    x, ids = unpack(t.column("vec").to_pylist()), C.Ids.from_lists(t.column("ids").to_pylist())
    nodes = radius = b""
    if t.column("leaf")[0].as_py() != HUGE:
        order, tree = C.build(x, DATA_LEAF)
        x, ids, (nodes, radius) = tree.x, ids.take(order), C.dump(tree)
    size, vecs = _matrix(x)
    binary = lambda b: pa.array([b], pa.binary())
    return pa.table({
        "leaf": t.column("leaf").slice(0, 1), "points": pa.array([len(x)], pa.int32()), "size": pa.array([size], pa.int32()), "vecs": binary(vecs),
        "starts": binary(ids.starts.astype("<i8").tobytes()), "ids": binary(ids.flat.astype("<i8").tobytes()), "nodes": binary(nodes), "radius": binary(radius),
    })


def _loaded(row: list) -> tuple[np.ndarray, C.Ids, bytes, bytes]:
    n, size, vecs, starts, ids, nodes, radius = row
    x = np.frombuffer(vecs, dict(_KINDS)[size]).reshape(n, -1).astype(np.float64)
    return x, C.Ids(np.frombuffer(starts, "<i8"), np.frombuffer(ids, "<i8")), nodes, radius


def _merged(scores: list[int], ids: list[int], keep: int) -> tuple[list[int], list[int]]:
    best = sorted(zip((-s for s in scores), ids))[:keep]
    return [-s for s, _ in best], [i for _, i in best]


def top_k(work: Work, vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query row."""
    spark, keep = work.spark, k + 1
    rows = work.save(quantise(vectors, is_query), "rows")
    lone = rows.groupBy("vec", "huge", "vec_id").agg(F.least(F.count("*"), F.lit(keep)).cast("int").alias("n"))
    first = lone.withColumn("place", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("place") <= keep)
    each = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x.vec_id, x.n)))
    points = work.save(first.groupBy("vec", "huge").agg(each.alias("ids")), "points")
    n = points.count()
    sample = unpack([bytes(r.vec) for r in points.where("NOT huge").select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()])
    pivots = choose_pivots(sample, max(1, min(PIVOTS, math.ceil(n / CHUNK))))

    data, radii, _ = _chunks(work.save(_placed(points, pivots), "data"), CHUNK)
    work.save(data.groupBy("leaf", "chunk").applyInArrow(_stored, _CHUNK), "index", "leaf")
    # An id with several rows could fill its own list: such queries know what to leave out, each by itself.
    several = rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id", F.lit(True).alias("has_own"))
    queries = rows.where("query").join(several, "vec_id", "left").select(F.col("vec_id").alias("query_id"), "vec", "huge", F.coalesce("has_own", F.lit(False)).alias("has_own"))
    queries = work.save(queries.withColumn("own", F.when(F.col("has_own"), F.col("query_id")).otherwise(F.lit(0))), "queries")
    asked, _, groups = _chunks(work.save(_placed(queries.select("vec", "huge", "has_own", "own").distinct(), pivots), "asked"), GROUP)
    path, order = work.path("index"), sorted(leaf for leaf in radii if leaf != HUGE)

    def answer(t: pa.Table) -> pa.Table:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        filesystem, root = pafs.FileSystem.from_uri(path)

        def chunks(leaf: int):
            for info in filesystem.get_file_info(pafs.FileSelector(f"{root}/leaf={leaf}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with filesystem.open_input_file(info.path) as f:
                        for batch in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["points", "size", "vecs", "starts", "ids", "nodes", "radius"]):
                            yield _loaded([c[0].as_py() for c in batch.columns])

        packed, own, has_own = t.column("vec").to_pylist(), t.column("own").to_numpy(), t.column("has_own").to_numpy().astype(bool)
        huge = t.column("leaf")[0].as_py() == HUGE
        found: list[tuple[list[int], list[int]]] = [([], []) for _ in packed]
        scored = total = 0
        if not huge:
            perm, tree = C.build(unpack(packed), QUERY_LEAF)
            packed, own, has_own = [packed[i] for i in perm], own[perm], has_own[perm]
            best = C.Best(len(packed), keep, own, has_own)

            def leaf_bound(leaf: int) -> float:
                p = C.Tree(pivots[leaf : leaf + 1], np.array([[0, 0, 1, 0, 0]], np.int32), np.array([radii[leaf]]))
                return float(C.bounds(tree, p)[0, 0])

            for leaf in sorted(order, key=lambda x: -leaf_bound(x)):
                if leaf_bound(leaf) < best.worst(tree)[0]:
                    break  # the bounds only fall from here on
                for x, ids, nodes, radius in chunks(leaf):
                    scored += C.search(tree, C.load(x, nodes, radius), ids, best)
            real = [ids != C.NONE.max for ids in best.ids]
            found = [(s[r].tolist(), i[r].tolist()) for s, i, r in zip(best.scores, best.ids, real)]
        if huge or HUGE in radii:
            exact = integers(unpack(packed))
            for leaf in [*order, HUGE] if huge else [HUGE]:
                for x, ids, *_ in chunks(leaf):
                    scored += len(exact) * len(x)
                    for n, scores in enumerate(exact_products(exact, integers(x))):
                        new = [(s, int(i)) for k, s in enumerate(scores) for i in ids.flat[ids.starts[k] : ids.starts[k + 1]] if not (has_own[n] and own[n] == i)]
                        found[n] = _merged(found[n][0] + [s for s, _ in new], found[n][1] + [i for _, i in new], keep)
        inside = [[max(C.NONE.min, min(C.NONE.max, s)) for s in scores] for scores, _ in found]
        return pa.table({
            "vec": pa.array(packed, pa.binary()), "has_own": pa.array(has_own), "own": pa.array(own), "ids": pa.array([i for _, i in found], pa.list_(pa.int64())), "scores": pa.array(inside, pa.list_(pa.int64())),
            "scored": pa.array([scored] + [0] * (len(packed) - 1), pa.int64()), "asked": pa.array([len(packed)] + [0] * (len(packed) - 1), pa.int64()),
        })

    # A chunk of queries is little to read and much to do, so tasks go by their number, not by bytes.
    spread = asked.repartition(max(1, min(groups, MOST_TASKS)), "leaf", "chunk")
    found = work.save(spread.groupBy("leaf", "chunk").applyInArrow(answer, "vec binary, has_own boolean, own long, ids array<long>, scores array<long>, scored long, asked long"), "found")
    work.keep("queries", "found", "points")
    pairs = queries.join(found.select("vec", "has_own", "own", "ids", "scores"), ["vec", "has_own", "own"]).select("query_id", F.filter(F.arrays_zip("ids", "scores"), lambda x: x.ids != F.col("query_id")).alias("best"))
    return pairs.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.ids").alias("vec_id"), F.col("b.scores").alias("score"))


def share_scored(work: Work) -> float | None:
    """Of all pairs of a distinct query and a distinct point, the share that the run in this folder scored; None without pairs."""
    found = work.load("found", "vec binary, has_own boolean, own long, ids array<long>, scores array<long>, scored long, asked long")
    scored, asked = found.agg(F.sum("scored"), F.sum("asked")).first()
    points = work.load("points", "vec binary, huge boolean, ids array<long>").count()
    return scored / (asked * points) if asked and points else None
