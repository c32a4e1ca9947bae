"""Hard negatives: rows of other labels whose score lies just below a positive's.

Scores are inner products of floor(SCALE * x). Exact search over a pivot table:

* A vector x gets one more coordinate, sqrt(M^2 - |x|^2), with M no less than any
  length; an anchor q gets a zero. Then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>: a high
  score is a small Euclidean distance.
* The distances of every row to a few pivots are stored with it. By the triangle
  inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for each pivot p, which
  brackets the score without the vectors. Rows lie in blocks of one label, sorted by
  their nearest pivot; a block's least and greatest distances bracket all of it.
* First pass: a block of an anchor's label is passed over, and so is a row, if the
  upper bound lies below the anchor's worst positive so far. Second pass, blocks of
  other labels: what can't lie in a window below a positive, above the window's worst
  row so far, is passed over. Scores of what is left are computed exactly.

The rows stay where they are; anchors (a stated set) come to them in groups of at
most GROUP_BYTES, which are broadcast; a group takes one pass over the rows for
positives and one for negatives. Each task keeps the best few of an anchor; those of
all tasks meet in a window by anchor.

A sample of SAMPLE rows gives the pivots, the farthest from the others in turn, and
each window's first bound: if enough rows of the sample lie in it, the worst of the
best of them. The sample decides how much is passed over, not what is found.

Defined cases: rows with a null id, label or vector, or a null, NaN or infinite
component (also one that is infinite after scaling) take no part; only vectors of equal length are
compared; ties go to the smaller id; rows that recur are candidates each by itself,
an anchor that recurs is one anchor (if they differ, the least label, then vector by its bytes); rows
with an anchor's id aren't its positives or negatives; an empty table gives an empty
result; further columns are left out of the plan and can't clash. Where products may
pass 2**52, nothing is passed over and sums are Python integers; scores beyond a long
are cut to its ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

SCALE, POSITIVES, NEGATIVES, EVERY = 256, 5, 3, 50
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
PIVOTS, SAMPLE, BLOCK, GROUP_BYTES = 32, 512, 2048, 1 << 24
#: Pivots that bracket each row of a block which all PIVOTS left over.
FEW = 8
EXACT = 2.0**52
_LONG = 2**63


def usable(vector: str) -> F.Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x * SCALE) < float("inf")))


def choose_pivots(sample: np.ndarray, top: float) -> np.ndarray:
    """Rows of ``sample`` with their further coordinate, each the farthest from those before."""
    points = np.hstack([sample, np.sqrt(np.maximum(top - (sample**2).sum(1), 0.0))[:, None]])
    picks, gap = [int((points**2).sum(1).argmin())], np.full(len(points), np.inf)
    while len(picks) < min(PIVOTS, len(points)):
        gap = np.minimum(gap, np.sqrt(((points - points[picks[-1]]) ** 2).sum(1)))
        picks.append(int(gap.argmax()))
    return points[picks]


def distances(points: np.ndarray, pivots: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Of each row (with its further coordinate) to each pivot."""
    whole = np.hstack([points, further[:, None]])
    return np.stack([np.sqrt(((whole - p) ** 2).sum(1)) for p in pivots], 1)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(SCALE * x) of the vectors of each length."""
    if not len(column):
        return
    sizes = np.diff(column.offsets.to_numpy())
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield at, np.floor(values.reshape(len(at), dims) * SCALE)


def _binary(rows: np.ndarray, narrow: bool) -> pa.Array:
    rows = rows.astype(np.float32 if narrow else np.float64)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _unpack(packed: bytes, rows: int, columns: int) -> np.ndarray:
    narrow = len(packed) == rows * columns * 4
    return np.frombuffer(packed, np.float32 if narrow else np.float64).reshape(rows, columns).astype(np.float64)


def _place(pivots: dict[int, np.ndarray], top: float):
    """label, dims, cell (nearest pivot), near, vec_id, v and d (distances to pivots) of each row.
    Whole numbers below 2**24 are packed as floats of 32 bits, distances too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points in _vectors(batch.column(2)):
                dims = points.shape[1]
                further = np.sqrt(np.maximum(top - (points**2).sum(1), 0.0)) if math.isfinite(top) else np.zeros(len(at))
                d = distances(points, pivots[dims], further) if dims in pivots else np.zeros((len(at), 1))
                cell = d.argmin(1)
                rows = pa.array(at)
                yield pa.record_batch(
                    [batch.column(0).take(rows), pa.array(np.full(len(at), dims, np.int32)), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(at)), cell]), batch.column(1).take(rows), _binary(points, top < 2.0**48), _binary(d, True)],
                    ["label", "dims", "cell", "near", "vec_id", "v", "d"],
                )

    return run


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows of one label and length become blocks."""

    def out() -> pa.RecordBatch:
        values = ([at[0]], [at[1]], [np.array([h[0] for h in held], np.int64).tobytes()], [b"".join(h[1] for h in held)], [b"".join(h[2] for h in held)])
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["label", "dims", "ids", "vs", "ds"])

    at, held = None, []
    for batch in batches:
        for label, dims, key, v, d in zip(*(batch.column(c).to_pylist() for c in ("label", "dims", "vec_id", "v", "d")), strict=True):
            if held and (at != (label, dims) or len(held) == BLOCK):
                yield out()
                held = []
            at = (label, dims)
            held.append((key, v, d))
    if held:
        yield out()


class Anchors:
    """A group's anchors of one length, as arrays."""

    def __init__(self, rows: list, dims: int, top: float, positives: dict[int, list[int]] | None = None):
        self.ids = np.array([r["vec_id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.points = _unpack(b"".join(r["v"] for r in rows), len(rows), dims)
        self.top, self.square = top, (self.points**2).sum(1)
        self.positives = positives or {}

    def to_pivots(self, pivots: np.ndarray | None) -> np.ndarray:
        if pivots is None:
            return np.zeros((len(self.ids), 1))
        return distances(self.points, pivots, np.zeros(len(self.ids)))


def _bracket(d: np.ndarray, low: np.ndarray, high: np.ndarray, square: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of anchors (rows; distances ``d``) with rows or blocks
    (columns) whose distances to the pivots lie from ``low`` to ``high``."""
    far = near = None
    for x, lo, hi in zip(d.T, low.T, high.T, strict=True):
        least = np.maximum(x[:, None] - hi[None, :], lo[None, :] - x[:, None])
        most = x[:, None] + hi[None, :]
        near, far = (least, most) if near is None else (np.maximum(near, least), np.minimum(far, most))
    near = np.maximum(near, 0.0)
    total = square[:, None] + top
    slack = total * 2e-6 + 1e-3  # distances have 24 bits
    return (total - far**2) / 2 - slack, (total - near**2) / 2 + slack


def _exact(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return a @ b.T
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    return np.array([[sum(x * y for x, y in zip(p, q, strict=True)) for q in right] for p in left], object).reshape(len(left), len(right))


class Search:
    """The best rows of each anchor's windows [low, high] of scores, as blocks come by."""

    def __init__(self, anchors: Anchors, pivots: np.ndarray | None, wide: bool, keep: int, other_label: bool, sample: tuple | None = None):
        self.a, self.keep, self.other, self.wide = anchors, keep, other_label, wide
        self.d = anchors.to_pivots(None if wide else pivots)
        self.bound = pivots is not None and not wide
        if other_label:
            self.windows = [[(-(-LOW * p // 100), HIGH * p // 100) for p in anchors.positives.get(int(i), [])] for i in anchors.ids]
        else:
            self.windows = [[(-math.inf, math.inf)] for _ in anchors.ids]
        if sample and self.bound:
            self._seed(*sample)
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in w] for w in self.windows]
        self.least = np.array([min((low for low, high in w if low <= high), default=math.inf) for w in self.windows], object if wide else float)
        self.most = np.array([max((high for low, high in w if low <= high), default=-math.inf) for w in self.windows], object if wide else float)
        self.met = self.computed = 0

    def _seed(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray) -> None:
        """Raise windows to the ``keep``-th best score that the sample has in them."""
        scores = _exact(self.a.points, points, False)
        for i, windows in enumerate(self.windows):
            mine = np.sort(scores[i, (ids != self.a.ids[i]) & ((labels != self.a.labels[i]) if self.other else (labels == self.a.labels[i]))])
            for k, (low, high) in enumerate(windows):
                held = mine[: np.searchsorted(mine, high, side="right")]
                if len(held) >= self.keep and held[-self.keep] > low:
                    windows[k] = (int(held[-self.keep]), high)

    def offer(self, label: int, ids: np.ndarray, points: np.ndarray, d: np.ndarray) -> None:
        here = np.flatnonzero(((self.a.labels != label) if self.other else (self.a.labels == label)) & (self.least <= self.most))
        if len(here) and self.bound:
            low, high = _bracket(self.d[here], d.min(0)[None], d.max(0)[None], self.a.square[here], self.a.top)
            here = here[(high[:, 0] >= self.least[here]) & (low[:, 0] <= self.most[here])]
        for start in range(0, len(here), 512):
            self._rows(here[start : start + 512], ids, points, d)

    def _rows(self, here: np.ndarray, ids: np.ndarray, points: np.ndarray, d: np.ndarray) -> None:
        least, most = self.least[here][:, None], self.most[here][:, None]
        self.met += len(here) * len(ids)
        if self.bound:
            low, high = _bracket(self.d[here, :FEW], d[:, :FEW], d[:, :FEW], self.a.square[here], self.a.top)
            alive = (high >= least) & (low <= most)
        else:
            alive = np.ones((len(here), len(ids)), bool)
        rows = np.flatnonzero(alive.any(0))
        if not len(rows):
            return
        alive, ids = alive[:, rows], ids[rows]
        self.computed += int(alive.sum())
        scores = _exact(self.a.points[here], points[rows], self.wide)
        alive &= (scores >= least) & (scores <= most) & (ids[None, :] != self.a.ids[here][:, None])
        for i in np.flatnonzero(alive.any(1)):
            at = np.flatnonzero(alive[i])
            self._keep(here[i], scores[i, at], ids[at])

    def _keep(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst = []
        for k, (low, high) in enumerate(self.windows[anchor]):
            held = self.best[anchor][k]
            if low > high:
                continue
            edge = -held[-1][0] if len(held) == self.keep else low
            fit = (scores >= max(low, edge)) & (scores <= high)
            if fit.any():
                s, i = scores[fit], ids[fit]
                if len(s) > self.keep:
                    first = np.lexsort((i, -s))[: self.keep] if not self.wide else sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[: self.keep]
                    s, i = s[first], i[first]
                held = self.best[anchor][k] = sorted(held + [(-int(a), int(b)) for a, b in zip(s, i, strict=True)])[: self.keep]
            worst.append(max(low, -held[-1][0]) if len(held) == self.keep else low)
        self.least[anchor] = min(worst)

    def rows(self) -> pa.RecordBatch:
        out = [(int(self.a.ids[i]), k + 1, vec, max(-_LONG, min(_LONG - 1, -minus)), str(-minus)) for i, held in enumerate(self.best) for k, rows in enumerate(held) for minus, vec in rows]
        columns = [[o[c] for o in out] for c in range(5)]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["anchor_id", "slot", "vec_id", "score", "exact"])


_FOUND = "anchor_id long, slot int, vec_id long, score long, exact string"


def _pass(blocks: DataFrame, sent, top: float, wide: bool, keep: int, other_label: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dims, pivots, positives, samples = sent.value
        searches = {dims: Search(Anchors(rows, dims, top, positives), pivots.get(dims), wide, keep, other_label, samples.get(dims)) for dims, rows in by_dims.items()}
        for batch in batches:
            for row in batch.to_pylist():
                search = searches.get(row["dims"])
                if search:
                    ids = np.frombuffer(row["ids"], np.int64)
                    search.offer(row["label"], ids, _unpack(row["vs"], len(ids), row["dims"]), np.frombuffer(row["ds"], np.float32).reshape(len(ids), -1).astype(np.float64))
        for search in searches.values():
            yield search.rows()

    with small_batches(blocks.sparkSession, 8):
        return cut(blocks.select("label", "dims", "ids", "vs", "ds").mapInArrow(run, _FOUND))


def _best(found: DataFrame, keep: int, wide: bool) -> DataFrame:
    """The first ``keep`` of each anchor and slot. A decimal of 38 digits orders scores beyond a long."""
    order = [F.desc(F.length(F.regexp_replace("exact", "^-", "")) * F.when(F.col("exact").startswith("-"), -1).otherwise(1)), F.desc(F.when(~F.col("exact").startswith("-"), F.col("exact"))), F.col("exact")] if wide else [F.desc("score")]
    place = Window.partitionBy("anchor_id", "slot").orderBy(*order, "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= keep)


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, keep: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for
    ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter("label is not null and vec_id is not null and vector is not null").filter(usable("vector"))
    # a floor is at most 1 away from what it is taken of
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (F.abs(x * SCALE) + 1) * (F.abs(x * SCALE) + 1))
    top = rows.agg(F.max(length)).first()[0]
    top = 0.0 if top is None else float(top)
    wide = not top < EXACT
    picked = rows.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(SAMPLE).collect()
    pivots: dict[int, np.ndarray] = {}
    samples: dict[int, tuple] = {}
    if not wide:
        by_length: dict[int, list] = {}
        for r in picked:
            by_length.setdefault(len(r["vector"]), []).append(r)
        for n, some in by_length.items():
            points = np.floor(np.array([r["vector"] for r in some], np.float64).reshape(len(some), n) * SCALE)
            samples[n] = (np.array([r["vec_id"] for r in some], np.int64), np.array([r["label"] for r in some], np.int64), points)
            pivots[n] = choose_pivots(points, top)
    placed = rows.mapInArrow(_place(pivots, top), "label long, dims int, cell int, near double, vec_id long, v binary, d binary")
    by_place = ["label", "dims", "cell", "near", "vec_id"]
    blocks = cut(placed.repartitionByRange(*by_place).sortWithinPartitions(*by_place).mapInArrow(_cut_blocks, "label long, dims int, ids binary, vs binary, ds binary"))
    # of an anchor that recurs, the least
    anchors = rows.filter(F.col("vec_id") % every == 0).mapInArrow(_place(pivots, top), "label long, dims int, cell int, near double, vec_id long, v binary, d binary")
    asked = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "dims", "v")).alias("r")).select("vec_id", "r.*")
    asked = cut(asked)
    octets = asked.agg(F.sum(F.length("v") + 64)).first()[0] or 0
    groups = -(-int(octets) // GROUP_BYTES)
    results = []
    for group in range(groups):
        # about GROUP_BYTES
        mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == group).collect()
        by_dims: dict[int, list] = {}
        for r in mine:
            by_dims.setdefault(r["dims"], []).append(r)
        sent = spark.sparkContext.broadcast((by_dims, pivots, {}, samples))
        firsts = cut(_best(_pass(blocks, sent, top, wide, positives, False), positives, wide))
        sent.unpersist()
        slots: dict[int, list[int]] = {}
        for r in sorted(firsts.select("anchor_id", "rank", "exact").collect(), key=lambda r: (r["anchor_id"], r["rank"])):
            slots.setdefault(r["anchor_id"], []).append(int(r["exact"]))
        sent = spark.sparkContext.broadcast((by_dims, pivots, slots, samples))
        found = _best(_pass(blocks, sent, top, wide, keep, True), keep, wide)
        sent.unpersist()
        pos = firsts.select("anchor_id", F.col("rank").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        results.append(found.join(pos, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    if not results:
        none = asked.select(*[F.lit(0).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))])
        return none.limit(0)
    return reduce(DataFrame.unionByName, results)
