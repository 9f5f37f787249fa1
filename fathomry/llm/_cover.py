"""Cover trees over integer vectors and the dual-tree search for the largest inner products.

A tree over n points comes from their farthest-first order: point j enters at the distance r_j
to all before it. Centers of level l are those with ``r_j > r_1 / BASE ** l``. That gives the
cover tree's invariants: levels are nested, centers of one level are more than its scale apart,
and every center of the next level is within that scale of its parent, the nearest center of
the levels above. The order ends where there is a center for every ``leaf`` points, and each
point then belongs to its nearest center, so leaves are small blocks instead of single points.
A node knows its covering radius: how far its own points really are from its center, at most.

Points lie in the order of the leaves, so a node is a range of them, and a tree is stored as two
arrays beside its points.
"""

from __future__ import annotations

import numpy as np

BASE = 1.5
_FIELDS = 5  # of a node: center, first and last point + 1, first and last child + 1


def wide(x: np.ndarray, dim: int) -> np.ndarray:
    """x with zeros up to dim columns."""
    return np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x


def reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, rounded up: never less than they are."""
    dim = max(x.shape[1], y.shape[1])
    x, y = wide(x, dim), wide(y, dim)
    sums = (x * x).sum(1)[:, None] + (y * y).sum(1)[None]
    return np.sqrt(np.maximum(sums - 2 * (x @ y.T), 0) + sums * ((dim + 8) * 2.0**-52))


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, of vectors whose norms are under 2**31."""
    dim = max(x.shape[1], y.shape[1])
    x, y = wide(x, dim), wide(y, dim)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(dim, 1)
    if most < 1 << 24:
        return (x.astype(np.float32) @ y.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


class Tree:
    """``x``: points in leaf order; ``nodes``: an int32 row of _FIELDS for each node; ``radius`` of each."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, radius: np.ndarray):
        self.x, self.nodes, self.radius = x, nodes, radius
        self.center = x[nodes[:, 0]]
        self.norm = np.sqrt((self.center * self.center).sum(1)) * (1 + 2.0**-40)
        self.leaf = nodes[:, 3] == nodes[:, 4]

    def __len__(self) -> int:
        return len(self.nodes)


def farthest_first(x: np.ndarray, most: int) -> tuple[list[int], list[float], np.ndarray]:
    """(centers, the distance at which each entered, each point's nearest center by its number)."""
    centers, entered = [0], [np.inf]
    away, owner = reach(x, x[:1])[:, 0], np.zeros(len(x), np.int64)
    same = float(np.abs(x).max(initial=0)) * 1e-5 + 1e-9
    while len(centers) < most:
        j = int(away.argmax())
        if away[j] <= same:
            break
        entered.append(float(away[j]))
        d = reach(x, x[j : j + 1])[:, 0]
        near = d < away
        owner[near], away[near] = len(centers), d[near]
        centers.append(j)
    return centers, entered, owner


def build(x: np.ndarray, leaf: int) -> tuple[np.ndarray, Tree]:
    """(order, tree over x[order])."""
    centers, entered, owner = farthest_first(x, -(-len(x) // leaf))
    m = len(centers)
    level = [0] + [1 + int(np.floor(np.log(entered[1] / r) / np.log(BASE) + 1e-9)) for r in entered[1:]]
    between = reach(x[centers], x[centers])
    kids: list[dict[int, list[int]]] = [{} for _ in range(m)]
    for j in range(1, m):
        above = [i for i in range(j) if level[i] < level[j]]
        parent = above[int(between[j, above].argmin())]
        kids[parent].setdefault(level[j], []).append(j)
    # Points in the order in which a walk down the tree meets their leaves; a center's own points come first.
    points = [np.flatnonzero(owner == j) for j in range(m)]
    order: list[np.ndarray] = []
    span: dict[tuple[int, int], tuple[int, int]] = {}

    def walk(j: int, levels: list[int], lo: int) -> int:
        """The node of center j that still has children at these levels, from point lo on; where it ends. Levels bound the depth."""
        if levels:
            hi = walk(j, levels[1:], lo)
            for c in kids[j][levels[0]]:
                hi = walk(c, sorted(kids[c]), hi)
        else:
            order.append(points[j])
            hi = lo + len(points[j])
        span[j, len(levels)] = lo, hi
        return hi

    walk(0, sorted(kids[0]), 0)
    order = np.concatenate(order)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    xs = x[order]
    rows, radius, queue = [], [], [(0, sorted(kids[0]))]
    at = 0
    while at < len(queue):
        j, levels = queue[at]
        at += 1
        lo, hi = span[j, len(levels)]
        first = len(queue)
        if levels:
            queue.append((j, levels[1:]))
            queue += [(c, sorted(kids[c])) for c in kids[j][levels[0]]]
        rows.append((place[centers[j]], lo, hi, first, len(queue)))
        radius.append(float(reach(xs[lo:hi], xs[place[centers[j]]][None]).max()))
    return order, Tree(xs, np.array(rows, np.int32).reshape(-1, _FIELDS), np.array(radius))


def dump(tree: Tree) -> tuple[bytes, bytes]:
    return tree.nodes.astype("<i4").tobytes(), tree.radius.astype("<f8").tobytes()


def load(x: np.ndarray, nodes: bytes, radius: bytes) -> Tree:
    return Tree(x, np.frombuffer(nodes, "<i4").reshape(-1, _FIELDS), np.frombuffer(radius, "<f8"))


def bounds(q: Tree, d: Tree) -> np.ndarray:
    """No point under a node of q scores higher with one under a node of d: nodes of q by nodes of d."""
    dim = max(q.center.shape[1], d.center.shape[1])
    norms = q.norm[:, None] * d.norm[None]
    dots = wide(q.center, dim) @ wide(d.center, dim).T
    return dots + norms * ((dim + 8) * 2.0**-52) + q.radius[:, None] * d.norm[None] + d.radius[None] * q.norm[:, None] + q.radius[:, None] * d.radius[None] + 1e-3


NONE = np.iinfo(np.int64)


class Ids:
    """Several ids a point: one array, and where each point's begin in it."""

    def __init__(self, starts: np.ndarray, flat: np.ndarray):
        self.starts, self.flat = starts, flat

    @classmethod
    def from_lists(cls, ids) -> Ids:
        sizes = np.array([len(x) for x in ids], np.int64)
        return cls(np.r_[0, np.cumsum(sizes)], np.array([i for x in ids for i in x], np.int64))

    def take(self, points: np.ndarray) -> Ids:
        flat, counts = self.of(points)
        return Ids(np.r_[0, np.cumsum(counts)], flat)

    def of(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the points' ids one after the other, how many each has)."""
        first = self.starts[points]
        counts = self.starts[points + 1] - first
        return self.flat[np.repeat(first - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())] if len(points) else self.flat[:0], counts


class Best:
    """The best (score, id) of each query so far; a query's own id, where it has one to leave out, never enters."""

    def __init__(self, n: int, keep: int, own: np.ndarray | None = None, has_own: np.ndarray | None = None):
        self.keep = keep
        self.scores, self.ids = np.full((n, keep), NONE.min), np.full((n, keep), NONE.max)
        self.own = np.zeros(n, np.int64) if own is None else own
        self.has_own = np.zeros(n, bool) if has_own is None else has_own

    def offer(self, lo: int, hi: int, scores: np.ndarray, ids: Ids) -> None:
        """scores of queries lo to hi x points; a point stands for all its ids."""
        floor = self.scores[lo:hi, -1]
        if scores.shape[1] > self.keep:
            kth = np.partition(scores, -self.keep, axis=1)[:, -self.keep]
            floor = np.where(self.has_own[lo:hi], floor, np.maximum(floor, kth))
        q, p = np.nonzero(scores >= floor[:, None])
        if not len(q):
            return
        i, counts = ids.of(p)
        q, s = np.repeat(q, counts), np.repeat(scores[q, p], counts)
        fine = ~(self.has_own[lo + q] & (self.own[lo + q] == i))
        q, s, i = q[fine], s[fine], i[fine]
        hit = np.unique(q)
        q, s, i = np.concatenate([q, np.repeat(hit, self.keep)]), np.concatenate([s, self.scores[lo + hit].ravel()]), np.concatenate([i, self.ids[lo + hit].ravel()])
        order = np.lexsort((i, ~s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        top = rank < self.keep
        self.scores[lo + q[top], rank[top]], self.ids[lo + q[top], rank[top]] = s[top], i[top]

    def worst(self, tree: Tree, promised: np.ndarray | None = None) -> np.ndarray:
        """Under each node of the queries' tree, the lowest of the last scores, or of what is promised where that is higher."""
        last, nodes = self.scores[:, -1] if promised is None else np.maximum(self.scores[:, -1], promised), tree.nodes
        out = np.empty(len(nodes), np.int64)
        for n in range(len(nodes) - 1, -1, -1):
            _, lo, hi, first, end = nodes[n]
            out[n] = last[lo:hi].min() if first == end else out[first:end].min()
        return out


def _promise(q: Tree, d: Tree, best: Best, most: np.ndarray) -> np.ndarray:
    """For queries with no list yet a score that their last one will reach: that of the data leaves that promise most."""
    out = np.full(len(q.x), NONE.min)
    leaves, size = np.flatnonzero(d.leaf), d.nodes[:, 2] - d.nodes[:, 1]
    if len(d.x) < best.keep:
        return out
    for n in np.flatnonzero(q.leaf):
        _, lo, hi, *_ = q.nodes[n]
        if best.scores[lo:hi, -1].min() == NONE.min:
            by = leaves[np.argsort(-most[n, leaves], kind="stable")]
            by = by[: int(np.searchsorted(np.cumsum(size[by]), best.keep)) + 1]
            scores = products(q.x[lo:hi], d.x[np.concatenate([np.arange(d.nodes[k, 1], d.nodes[k, 2]) for k in by])])
            out[lo:hi] = np.where(best.has_own[lo:hi], NONE.min, np.partition(scores, -best.keep, axis=1)[:, -best.keep])
    return out


#: Queries that are scored together where nothing tells them apart, and points at a time.
TOGETHER, AT_ONCE = 64, 1024


def search(q: Tree, d: Tree, ids: Ids, best: Best) -> int:
    """Offer best all that d holds for q's queries, but for node pairs whose bound is below the
    worst kept score under their query node; the number of point pairs that were scored.

    The descent goes down both trees at once, all pairs of a depth together. Query leaves beside
    each other that are left with the same data leaves are scored in one block.
    """
    most, scored = bounds(q, d), 0
    promised = _promise(q, d, best, most)
    worst = best.worst(q, promised)
    alive = np.zeros((len(q), len(d)), bool)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        kept = most[a, b] >= worst[a]
        a, b = a[kept], b[kept]
        end = q.leaf[a] & d.leaf[b]
        alive[a[end], b[end]] = True
        a, b = a[~end], b[~end]
        down = ~d.leaf[b] & (q.leaf[a] | (d.radius[b] >= q.radius[a]))
        (a1, b1), (b2, a2) = _children(d, b[down], a[down]), _children(q, a[~down], b[~down])
        a, b = np.concatenate([a1, a2]), np.concatenate([b1, b2])
    size = d.nodes[:, 2] - d.nodes[:, 1]
    leaves = np.flatnonzero(q.leaf)
    leaves = leaves[np.argsort(q.nodes[leaves, 1])]
    start = 0
    while start < len(leaves):
        n, end = leaves[start], start + 1
        while end < len(leaves) and q.nodes[leaves[end], 2] - q.nodes[n, 1] <= TOGETHER and (alive[leaves[end]] == alive[n]).all():
            end += 1
        group, start = leaves[start:end], end
        lo, hi = q.nodes[group[0], 1], q.nodes[group[-1], 2]
        high, mine = most[group].max(0), np.flatnonzero(alive[n])
        # Leaves that promise most come first; those that fall below what has been found meanwhile are left.
        mine = mine[np.argsort(-high[mine], kind="stable")]
        for part in np.array_split(mine, max(1, int(size[mine].sum()) // AT_ONCE)):
            part = part[high[part] >= np.maximum(best.scores[lo:hi, -1], promised[lo:hi]).min()]
            if len(part):
                points = np.concatenate([np.arange(d.nodes[k, 1], d.nodes[k, 2]) for k in part])
                best.offer(lo, hi, products(q.x[lo:hi], d.x[points]), ids.take(points))
                scored += int(hi - lo) * len(points)
    return scored


def _children(tree: Tree, side: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(other repeated, children) for each node in side."""
    first, n = tree.nodes[side, 3].astype(np.int64), tree.nodes[side, 4].astype(np.int64) - tree.nodes[side, 3]
    child = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
    return np.repeat(other, n), child
