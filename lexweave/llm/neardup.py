"""Embedding near-duplicates by collision-counting projections.

Vectors of one label are compared by cosine. Equal vectors form a class first,
so copies are never expanded. Each class is projected onto PROJECTIONS random
directions. The classes are sorted along the first one (a range partitioning by
label and projection, so a hot label spreads over tasks) and cut into blocks; a
block knows its range along every direction.

Two unit vectors of cosine c differ along a Gaussian direction by a normal
variable of deviation sqrt(2 - 2c). A window of WIDTH deviations of the
threshold, centred at the query, is hit with known probability, so the count of
hits in all directions of a pair at the threshold is binomial: ``calibrated``
gives the largest count that such a pair still reaches with probability RECALL.
Block pairs whose ranges meet in fewer directions can't hold such a pair and are
left out; in the others, the hits are counted pair by pair and the pairs with
enough of them are verified in double precision. A block pair returns a number
of links for each vector and a spanning forest, never the links themselves.

Defined cases: vectors that are null, empty, zero or hold null, NaN or infinite
components, and those without label or id, link with nothing and are their own
component; vectors of different length don't link; repeated rows are copies;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small_batches

PROJECTIONS, WIDTH, RECALL, BLOCK = 40, 1.6, 0.99999, 512
SEED = 7


def calibrated(projections: int = PROJECTIONS, width: float = WIDTH, recall: float = RECALL) -> int:
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for hits in range(projections, -1, -1):
        tail += math.comb(projections, hits) * p**hits * (1 - p) ** (projections - hits)
        if tail >= recall:
            return hits
    return 0


def directions(dims: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, projections))


def usable(vector: str) -> Column:
    """Not null or empty, every component finite."""
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, packed = [], []
        for vector in batch.column("vector").to_pylist():
            v = np.array(vector, np.float64)
            scaled = v / np.abs(v).max()
            first.append(float(scaled @ directions(len(v))[:, 0] / np.linalg.norm(scaled)))
            packed.append(v.tobytes())
        yield pa.record_batch(
            [*(batch.column(c) for c in ("label", "rep", "n")), pa.array([len(p) // 8 for p in packed], pa.int32()), pa.array(first, pa.float64()), pa.array(packed, pa.binary())],
            ["label", "rep", "n", "dims", "p", "v"],
        )


def _units(packed: list[bytes], dims: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(packed), np.float64).reshape(-1, dims)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return scaled, np.linalg.norm(scaled, axis=1)


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one label and length, sorted along the first direction, become blocks."""

    def block(label: int, dims: int, held: list[tuple]) -> pa.RecordBatch:
        scaled, norm = _units([h[2] for h in held], dims)
        along = scaled / norm[:, None] @ directions(dims)
        values = [
            [held[0][0]], [label], [dims], [along.min(0).tolist()], [along.max(0).tolist()],
            [np.array([h[0] for h in held], np.int64).tobytes()], [np.array([h[1] for h in held], np.int64).tobytes()], [b"".join(h[2] for h in held)],
        ]
        return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    names = ["block", "label", "dims", "lo", "hi", "ids", "sizes", "vs"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
    at, held = None, []
    for batch in batches:
        for label, rep, n, dims, v in zip(*(batch.column(c).to_pylist() for c in ("label", "rep", "n", "dims", "v")), strict=True):
            if held and (at != (label, dims) or len(held) == BLOCK):
                yield block(*at, held)
                held = []
            at = (label, dims)
            held.append((rep, n, v))
    if held:
        yield block(*at, held)


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches by the edges a - b."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float, hits: int):
    half = WIDTH * math.sqrt(2 - 2 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims, same = row["dims"], row["block"] == row["other"]
                (va, na), (vb, nb) = (_units([row[k]], dims) for k in ("vs", "vs2"))
                rotate = directions(dims)
                pa_, pb_ = va / na[:, None] @ rotate, vb / nb[:, None] @ rotate
                count = np.zeros((len(va), len(vb)), np.uint8)
                for x, y in zip(pa_.T, pb_.T, strict=True):
                    count += np.abs(x[:, None] - y[None, :]) <= half
                i, j = np.nonzero(count >= hits)
                if same:
                    i, j = i[i < j], j[i < j]
                linked = [np.einsum("ij,ij->i", va[i[s : s + 65536]], vb[j[s : s + 65536]]) / (na[i[s : s + 65536]] * nb[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]
                if not linked or not (keep := np.concatenate(linked)).any():
                    continue
                i, j = i[keep], j[keep]
                ids_a, ids_b = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids2"], np.int64)
                size_a, size_b = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["sizes2"], np.int64)
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                shift = 0 if same else len(ids_a)
                links = np.zeros(len(ids), np.int64)
                np.add.at(links, i, size_b[j])
                np.add.at(links, j + shift, size_a[i])
                root = _roots(len(ids), i, j + shift)
                met = np.flatnonzero(links)
                yield pa.record_batch([pa.array(ids[met]), pa.array(ids[root[met]]), pa.array(links[met])], ["rep", "root", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors`` (vec_id, embedding, label)."""
    hits = calibrated()
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    fit = usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(fit, F.lit(False)), F.col("vector")))
    classes = cut(
        rows.filter("vector is not null")
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    )
    placed = cut(classes.select("label", "rep", "n", "vector").mapInArrow(_project, "label long, rep long, n long, dims int, p double, v binary"))
    sorted_ = placed.repartitionByRange("label", "dims", "p", "rep").sortWithinPartitions("label", "dims", "p", "rep")
    blocks = cut(sorted_.mapInArrow(_cut_blocks, "block long, label long, dims int, lo array<double>, hi array<double>, ids binary, sizes binary, vs binary"))

    half = WIDTH * math.sqrt(2 - 2 * threshold)
    a = blocks.select("label", "dims", "block", "lo", "hi")
    b = blocks.select("label", "dims", F.col("block").alias("other"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    near = F.transform("lo", lambda x, i: (x - half <= F.get("hi2", i)) & (F.get("lo2", i) - half <= F.get("hi", i)))
    pairs = a.join(b, ["label", "dims"]).filter("block <= other").filter(F.size(F.filter(near, lambda x: x)) >= hits).select("block", "other", "dims")
    left = blocks.select("block", "ids", "sizes", "vs")
    right = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("sizes").alias("sizes2"), F.col("vs").alias("vs2"))
    with small_batches(vectors.sparkSession, 32):
        found = cut(pairs.join(left, "block").join(right, "other").mapInArrow(_compare(threshold, hits), "rep long, root long, links long"))

    joined = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_class = classes.join(links, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left").select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    return rows.join(by_class, ["label", "vector"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
