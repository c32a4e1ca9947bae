"""Exact top-k search by inner product with cover trees on both sides.

The rows are cut into blocks; each block gets a cover tree: a node has a centre,
which is one of its points, and the radius that covers its points. Its children's
centres are a net: the farthest points in turn, more than half the radius apart,
until every point is within half the radius of one, or the most children are reached
(in many dimensions nearly all points are far from each other); each point goes
to its nearest centre. The queries get trees in the same way. A query block meets
every data block (queries are a stated set). A node pair's best inner product is
at most

    <q, d> + |q| * R + |d| * r + r * R

for centres q, d and radii r, R. If that is below the worst k-th score of the
query node's queries, the pair is pruned. Otherwise the larger node is opened;
a query leaf scans the leaves that are left, the best bounds first. A task keeps
its queries' best scores from block to block, so the bounds tighten. Scores of
all tasks meet in a window of k rows per query and task.

Defined cases: vectors that are null or hold null, NaN or infinite components,
and rows without an id, take no part; only vectors of equal length are compared;
repeated rows are candidates each on its own, and as queries they are one query;
ties go to the smaller id; an empty table gives an empty result. Sums beyond
2**53 are formed with Python integers, and scores beyond a long are cut to its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

K, EVERY, BLOCK, QUERIES = 10, 100, 8192, 512
#: Most points of a leaf and most children of a node, of trees over rows and over queries.
ROWS_TREE, QUERIES_TREE = (64, 48), (64, 8)
EXACT = 2.0**53


class Tree:
    """Points in tree order; node i has a centre, a radius, its points' range and its children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, most: int, fanout: int):
        self.most, self.fanout = most, fanout
        self.float = points.astype(np.float64)
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.span: list[tuple[int, int]] = []
        self.order: list[np.ndarray] = []
        self.filled = 0
        if len(ids):
            self._grow(np.arange(len(ids)), 0)
        order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.ids, self.points = ids[order], self.float[order]
        self.exact = points[order] if points.dtype == object else None
        self.at = self.float[np.array(self.centre, np.int64)]
        self.length = np.sqrt((self.at**2).sum(1))
        self.r = np.array(self.radius)
        self.leaf = np.array([not len(c) for c in self.children], bool)
        self.start, self.size = (np.array([x[i] for x in self.span], np.int64) for i in (0, 1))
        self.size -= self.start

    def _grow(self, members: np.ndarray, centre: int) -> int:
        node, start = len(self.centre), self.filled
        points = self.float[members]
        far = np.sqrt(((points - self.float[centre]) ** 2).sum(1))
        radius = float(far.max())
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append(np.empty(0, np.int64))
        self.span.append((0, 0))
        if len(members) <= self.most or not radius:
            self.order.append(members)
            self.filled += len(members)
        else:
            # a net: each new centre is the point farthest from those so far, until all are covered
            picks, owner, gap = [centre], np.zeros(len(members), np.int64), far
            while gap.max() > radius / 2 and len(picks) < self.fanout:
                new = int(gap.argmax())
                dist = np.sqrt(((points - points[new]) ** 2).sum(1))
                closer = dist < gap
                owner[closer] = len(picks)
                gap = np.minimum(gap, dist)
                picks.append(int(members[new]))
            self.children[node] = np.array([self._grow(members[owner == i], c) for i, c in enumerate(picks) if (owner == i).any()])
        self.span[node] = (start, self.filled)
        return node


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, size: int, k: int):
        self.k = k
        self.score: list[list] = [[] for _ in range(size)]  # of (-score, id), sorted
        self.worst = np.full(size, -np.inf)

    def offer(self, query: int, own: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = (scores >= self.worst[query]) & (ids != own)
        scores, ids = scores[keep], ids[keep]
        if not len(ids):
            return
        if len(ids) > self.k:
            first = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[first], ids[first]
        merged = sorted(self.score[query] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)])[: self.k]
        self.score[query] = merged
        if len(merged) == self.k:
            self.worst[query] = -merged[-1][0]


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Offer ``best`` every point of ``data`` that can be among a query's k best."""
    if not len(queries.ids) or not len(data.ids):
        return
    slow = queries.exact is not None or data.exact is not None

    def bound(q: int, nodes: np.ndarray) -> np.ndarray:
        r, big = queries.r[q], data.r[nodes]
        top = data.at[nodes] @ queries.at[q] + queries.length[q] * big + data.length[nodes] * r + r * big
        return top + np.abs(top) * 1e-9 + 1.0

    def prune(q: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = bound(q, nodes)
        keep = top >= best.worst[slice(*queries.span[q])].min()
        return nodes[keep], top[keep]

    def opened(nodes: np.ndarray) -> np.ndarray:
        return np.concatenate([data.children[n] for n in nodes]) if len(nodes) else nodes

    def exact_scores(i: int, rows: np.ndarray) -> np.ndarray:
        a = [int(x) for x in (queries.exact if queries.exact is not None else queries.points)[i]]
        b = data.exact if data.exact is not None else data.points
        return np.array([sum(x * int(y) for x, y in zip(a, b[row], strict=True)) for row in rows], object)

    def scan(q: int, leaves: np.ndarray) -> None:
        sizes = data.size[leaves]
        rows = np.arange(sizes.sum()) + np.repeat(data.start[leaves] - np.cumsum(sizes) + sizes, sizes)
        low, high = queries.span[q]
        scores = None if slow else queries.points[low:high] @ data.points[rows].T
        for i in range(low, high):
            best.offer(i, queries.ids[i], exact_scores(i, rows) if slow else scores[i - low], data.ids[rows])

    def visit(q: int, nodes: np.ndarray) -> None:
        nodes, _ = prune(q, nodes)
        kids = queries.children[q]
        if len(kids):
            # the side with the larger node is opened
            large = ~data.leaf[nodes] & (data.r[nodes] > queries.r[q])
            nodes = np.concatenate([nodes[~large], opened(nodes[large])]).astype(np.int64)
            for kid in kids:
                visit(int(kid), nodes)
            return
        leaves = []
        while len(nodes):
            leaves.append(nodes[data.leaf[nodes]])
            nodes, _ = prune(q, opened(nodes[~data.leaf[nodes]]).astype(np.int64))
        nodes = np.concatenate(leaves) if leaves else nodes
        # the best bounds first, so that the worst k-th score rises early
        nodes = nodes[np.argsort(-bound(q, nodes), kind="stable")]
        step = 8
        while len(nodes):
            scan(q, nodes[:step])
            nodes, _ = prune(q, nodes[step:])
            step *= 4

    visit(0, np.array([0]))


def _pack(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows of one length: dims, ids and vectors as bytes."""
    held: dict[int, list] = {}

    def out(dims: int) -> pa.RecordBatch:
        rows = held.pop(dims)
        ids = np.array([r[0] for r in rows], np.int64).tobytes()
        return pa.record_batch([pa.array([dims], pa.int32()), pa.array([ids], pa.binary()), pa.array([np.array([r[1] for r in rows], np.float64).tobytes()], pa.binary())], ["dims", "ids", "vs"])

    for batch in batches:
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = held.setdefault(len(vector), [])
            rows.append((key, vector))
            if len(rows) == most:
                yield out(len(vector))
    for dims in list(held):
        yield out(dims)


def _tree(dims: int, ids: bytes, vs: bytes, most: int, fanout: int) -> Tree:
    """The tree over floor(1024 * x) of the packed vectors."""
    points = np.floor(np.frombuffer(vs, np.float64).reshape(-1, dims) * 1024.0) if dims else np.zeros((len(ids) // 8, 0))
    if points.size and float(np.abs(points).max()) ** 2 * max(dims, 1) >= EXACT / 4:
        points = np.array([[int(x) for x in p] for p in points.tolist()], object)
    return Tree(np.frombuffer(ids, np.int64), points, most, fanout)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row whose id is a multiple of ``every``."""
    fine = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
        .filter("vec_id is not null and vector is not null")
        .filter(fine)
    )
    blocks = rows.mapInArrow(lambda it: _pack(it, BLOCK), "dims int, ids binary, vs binary")
    asked = cut(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]))
    groups = -(-asked.count() // QUERIES)
    if not groups:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    packed = cut(asked.repartition(groups).mapInArrow(lambda it: _pack(it, QUERIES), "dims int, ids binary, vs binary"))
    data = cut(blocks.select("dims", "ids", "vs", F.xxhash64("ids").alias("block")))
    queries = packed.select("dims", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
    # every query block to every data block of its length: one row of the pair is a block, not a vector
    keyed = data.select("dims", "block").join(queries, "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree, asked_trees, bests = None, None, {}, {}

        def flush() -> pa.RecordBatch:
            out = [(int(trees.ids[i]), vec, max(-(2**63), min(2**63 - 1, -minus))) for key, trees in asked_trees.items() for i, found in enumerate(bests[key].score) for minus, vec in found]
            asked_trees.clear()
            bests.clear()
            return pa.record_batch([pa.array([o[c] for o in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if last != row["block"]:
                    last, tree = row["block"], _tree(row["dims"], row["ids"], row["vs"], *ROWS_TREE)
                key = (row["dims"], row["q_ids"])
                if key not in bests:
                    if len(bests) == 64:
                        yield flush()
                    asked_trees[key] = _tree(row["dims"], row["q_ids"], row["q_vs"], *QUERIES_TREE)
                    bests[key] = Best(len(asked_trees[key].ids), k)
                search(asked_trees[key], tree, bests[key])
        yield flush()

    pairs = keyed.join(data.select("block", "ids", "vs"), "block").select("block", "dims", "ids", "vs", "q_ids", "q_vs")
    with small_batches(vectors.sparkSession, 16):
        found = cut(pairs.mapInArrow(run, "query_id long, vec_id long, score long"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
