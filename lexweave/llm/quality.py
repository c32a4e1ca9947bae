"""Quality classifier by positive-unlabelled learning.

Trusted positives are training documents labelled 1; the unlabelled set is every
training document, whatever its labels. A logistic model over FEATURES text
statistics, each also cut into BINS by the unlabelled set's quantiles, minimises
the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))

by L-BFGS. Negative labels are never used. The class prior is estimated from
positives and unlabelled: where a first score (the bins' log ratios) is so high
that only positives reach it, the unlabelled share above it is the prior times the
positives' share; the least ratio of both over all thresholds that a tenth of the
positives reach is taken.

Features of the training documents are computed once and kept as a table; mean,
spread and quantiles come from counts of its values on a grid of 131,072 numbers a
feature, and histograms and, in each step, the unlabelled risk and its gradient are
sums over all of its rows, of which some hundred numbers come to the driver. Terms
are whole multiples of 1 / UNIT, so that no sum depends on the order of rows, batches or
partitions. The model notes how often the risk was evaluated and the greatest part of
its last gradient; a warning tells if that is above FLAT. Only the trusted positives are a sample: at most about SAMPLE rows, dealt
by the hash of doc_id. Scoring reads every whole text once and shuffles nothing.

Defined cases: null text is empty text; texts of any length are read whole; rows
are scored one by one, so repeated rows and null ids are kept; several labels of
one id count as their minimum; without trusted positives every score is 0.5; an
empty table gives an empty result. labels, lang, source and doc_id don't enter a
score; columns with other names don't matter.
"""

from __future__ import annotations

import logging
import operator
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, discard, share, small_batches

#: Trusted positives at most; bins of a feature; evaluations of the risk at most; weight decay; steps that L-BFGS remembers.
SAMPLE, BINS, EVALUATIONS, DECAY, MEMORY = 12_000, 10, 60, 1e-3, 10
#: Steps of the first score's histogram, and positives' share from which on a threshold can tell the prior.
STEPS, REACHED = 1000, 0.1
THRESHOLD = 0.3
#: Sums are of multiples of 1 / UNIT: of values of SCALED times slopes of SLOPE steps; a batch has fewer than 400,000 rows. Gradient of a minimum.
SCALED, SLOPE = 2**12, 2**20
UNIT = SCALED * SLOPE
FLAT = 1e-5

_LOG = logging.getLogger(__name__)

_CLASS = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _CLASS[list(_set)] = _i
FEATURES = 20


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10)
    words, lines = raw.split(), raw.split(b"\n")
    size, n, letters = max(1, len(raw)), max(1, len(words)), max(1, kinds[1] + kinds[2] + kinds[9])
    often = Counter(words)
    upper = (text or "").upper() == (text or "")
    return np.array([
        *(kinds[1:] / size), kinds[2] / letters, np.log1p(len(words)), len(raw) / n, len(often) / n, np.log1p(len(often)) / np.log1p(n),
        max(often.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / len(lines), (kinds[4] + kinds[5]) / n, kinds[6] / n, float(upper),
    ])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # FEATURES x (BINS - 1)
    weights: np.ndarray
    constant: float | None = None
    prior: float | None = None
    evaluations: int = 0
    gradient: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], 1)
        hot = np.zeros((len(x), x.shape[1], BINS))
        np.put_along_axis(hot, at[:, :, None], 1, 2)
        return hot.reshape(len(x), -1)

    def expand(self, x: np.ndarray) -> np.ndarray:
        scaled = np.rint(np.clip((x - self.mean) / self.spread, -5, 5) * SCALED) / SCALED
        return np.hstack([scaled, self.bins(x), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return _sigmoid(self.expand(x) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior from histograms (counts by score, ascending) of both sets."""
    p, u = (np.cumsum(h[::-1]) / h.sum() for h in (positive, unlabelled))
    reached = p >= REACHED
    # what chance can add to the unlabelled share
    chance = np.sqrt(np.log(40) / (2 * unlabelled.sum()))
    return float(np.clip(((u[reached] + chance) / p[reached]).min(), 1e-3, 1 - 1e-3))


def risk(w: np.ndarray, positive: np.ndarray, prior: float, unlabelled: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    """The non-negative risk and its gradient. positive: expanded rows;
    ``unlabelled(w)``: mean loss of the unlabelled rows as negatives and its gradient."""
    z = positive @ w
    # logistic losses: log(1 + exp(-z)) as positive, log(1 + exp(z)) as negative
    value = prior * np.logaddexp(0, -z).mean()
    gradient = -prior * (positive.T @ _sigmoid(-z)) / len(z)
    loss, slope = unlabelled(w)
    rest = loss - prior * np.logaddexp(0, z).mean()
    if rest > 0:
        value += rest
        gradient = gradient + slope - prior * (positive.T @ _sigmoid(z)) / len(z)
    return value + DECAY / 2 * (w @ w), gradient + DECAY * w


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int, most: int = EVALUATIONS, trace: list | None = None) -> np.ndarray:
    """L-BFGS with a halving line search, at most ``most`` evaluations. ``trace`` is
    given (evaluations so far, greatest part of the gradient) of each point reached."""
    w, used = np.zeros(size), 1
    trace = [] if trace is None else trace
    value, gradient = evaluate(w)
    trace.append((used, float(np.abs(gradient).max())))
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while used < most and np.abs(gradient).max() > FLAT:
        way, heights = -gradient, []
        for s, y in reversed(steps):
            heights.append((s @ way) / (s @ y))
            way = way - heights[-1] * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), height in zip(steps, reversed(heights), strict=True):
            way = way + s * (height - (y @ way) / (s @ y))
        slope, length = way @ gradient, 1.0
        if slope >= 0:
            way, slope, steps = -gradient, -(gradient @ gradient), []
        while used < most:
            there, (new, bent) = w + length * way, evaluate(w + length * way)
            used += 1
            if new <= value + 1e-4 * length * slope:
                break
            length /= 2
        else:
            return w
        if (there - w) @ (bent - gradient) > 1e-12:
            steps = [*steps, (there - w, bent - gradient)][-MEMORY:]
        w, value, gradient = there, new, bent
        trace.append((used, float(np.abs(gradient).max())))
    return w


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([features(t.as_py()) for t in batch.column(0)]).reshape(-1)
        offsets = pa.array(np.arange(0, len(found) + 1, FEATURES), pa.int32())
        yield pa.record_batch([pa.ListArray.from_arrays(offsets, pa.array(found)), batch.column(1)], ["x", "p"])


def _summed(table: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(x)``, ``size`` multiples of 1 / UNIT, over the rows of ``table``: x is a matrix of some of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            sums += np.rint(of(batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)) * UNIT).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], ["at", "sum"])

    found = table.select("x").mapInArrow(run, "at int, sum long").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(20,0)")).alias("sum")).toArrow()
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = [int(n) / UNIT for n in found.column("sum").to_pylist()]
    return out


def _cells(x: np.ndarray) -> np.ndarray:
    """The place on a grid, in order, of numbers that aren't negative: the leading bits of single precision."""
    return x.astype(np.float32).view(np.int32) >> 15


def _grid(table: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, mean, spread and quantiles (a row for each feature), from counts of the values on the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)
            cells, n = np.unique(_cells(x).astype(np.int64) + (np.arange(FEATURES) << 17), return_counts=True)
            held.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], ["cell", "n"])

    found = table.select("x").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(found.column("cell").to_numpy())
    cells, n = (found.column(c).to_numpy()[order] for c in ("cell", "n"))
    value = ((cells & 0x1FFFF) << 15).astype(np.int32).view(np.float32).astype(float)  # the least of its cell
    mean, spread, edges = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros((FEATURES, BINS - 1))
    for i in range(FEATURES):
        v, k = value[cells >> 17 == i], n[cells >> 17 == i]
        mean[i] = (v * k).sum() / k.sum()
        spread[i] = np.sqrt((k * (v - mean[i]) ** 2).sum() / k.sum())
        edges[i] = v[np.searchsorted(np.cumsum(k), k.sum() * np.arange(1, BINS) / BINS)]
    return int(n[cells >> 17 == 0].sum()), mean, spread, edges


def train(docs: DataFrame, labels: DataFrame) -> Model:
    nothing = Model(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), 0.5)
    usable = labels.filter((crc_mod("doc_id", 5) != 0) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    ones = known.count()
    if not ones:
        return nothing
    # about SAMPLE ids by construction, so the broadcast is bounded
    trusted = known.filter(share("doc_id", "trusted", SAMPLE / ones)).select("doc_id", F.lit(True).alias("p"))
    mine = docs.filter(crc_mod("doc_id", 5) != 0).select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left")
    with small_batches(docs.sparkSession):
        table = cut(mine.select("text", F.coalesce("p", F.lit(False)).alias("p")).mapInArrow(_rows, "x array<double>, p boolean"))
    found = table.filter("p").select("x").toArrow()
    if not found.num_rows:
        discard(table)
        return nothing
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    x = x[np.lexsort(x.T)]  # the same order of sums on every run

    rows, mean, spread, edges = _grid(table)
    model = Model(mean, spread + 1e-9, edges, np.zeros(0))

    # a first score: by bin, the log ratio of shares
    size = FEATURES * BINS
    p, u = model.bins(x).sum(0), _summed(table, size, lambda x: model.bins(x).sum(0))
    ratio = np.log((p + 1) / (len(x) + BINS)) - np.log((u + 1) / (rows + BINS))
    low, high = (f(ratio.reshape(FEATURES, BINS), axis=1).sum() for f in (np.min, np.max))

    def histogram(x: np.ndarray) -> np.ndarray:
        at = (model.bins(x) @ ratio - low) / max(high - low, 1e-9) * (STEPS - 1)
        return np.bincount(np.clip(at, 0, STEPS - 1).astype(np.int64), minlength=STEPS).astype(float)

    prior = prior_of(histogram(x), _summed(table, STEPS, histogram))

    positive = model.expand(x)

    def unlabelled(w: np.ndarray) -> tuple[float, np.ndarray]:
        def of(x: np.ndarray) -> np.ndarray:
            e = model.expand(x)
            z = e @ w
            loss = np.rint(np.logaddexp(0, z) * UNIT) / UNIT
            return np.append(e.T @ (np.rint(_sigmoid(z) * SLOPE) / SLOPE), loss.sum())

        sums = _summed(table, positive.shape[1] + 1, of) / rows
        return float(sums[-1]), sums[:-1]

    trace: list[tuple[int, float]] = []
    model.weights = minimise(lambda w: risk(w, positive, prior, unlabelled), positive.shape[1], trace=trace)
    model.evaluations, model.gradient = trace[-1]
    _LOG.log(logging.WARNING if model.gradient > FLAT else logging.INFO, "%d evaluations, gradient %.1e at most", *trace[-1])
    model.prior = prior
    discard(table)
    return model


def _score(batch: pa.RecordBatch, at: int, model: Model) -> np.ndarray:
    return model.score(np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score(batch, 1, sent.value)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return found.withColumn("held_out", crc_mod("doc_id", 5) == 0)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts 1 for, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(batch, at, sent.value) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
