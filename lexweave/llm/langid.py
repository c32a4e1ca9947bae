"""Language identification by interpolated Kneser-Ney character language models.

Letters are numbered, upper and lower case alike; a run of anything else is one
separator, a letter that the sample doesn't have is one unknown. For each language the n-grams of a sample of
labelled documents give a Kneser-Ney model of ORDER characters. The models are
flattened into arrays sorted by the n-gram's hash (its characters' numbers, 16
bits each, in one integer, so without collisions): one row of log-probabilities, a column per
language, for every n-gram that any language has, and one row of back-off
weights for each context. A document goes to the language with the lowest
cross-entropy per character.

A document is rejected if its cross-entropy exceeds what documents of its best
language reach (their 99.9 % quantile and SLACK deviations) by models that did
not count them: the sample is dealt into FOLDS, and each fold is scored by a
model of the others. A language with fewer than FEW documents takes quantile and
deviation from all languages' documents about their means where these are
larger; one with a single document takes its mean from the others, too. Only
where no language has two documents nothing can be measured nor rejected. A
rejected document still gets its best language, so that a caller can decide.

The sample is bounded: at most about PER_LANGUAGE documents of a language, dealt
by the hash of doc_id. Whole texts are read, for training and prediction, long
ones in slices of SLICE characters, whose sums are added up. All letters of the
sample have a number of their own: 16 bits hold more than the letters that a
bounded sample of living scripts has (should it have more, the rarest are unknown).

Defined cases: null text, or text without a letter, is ``und`` with score 0 and
is rejected; rows are judged one by one, so repeated rows and null ids are kept;
without labelled documents everything is ``und``; an empty table gives an empty
result; equal cross-entropies go to the first language by code point.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut, discard, share

ORDER, PER_LANGUAGE, SLACK = 4, 1500, 3.0
#: Folds of the sample for calibration, and documents from which on a language has a quantile of its own.
FOLDS, FEW = 5, 20
UNKNOWN = "und"
#: Characters that are worked on at once, and letters' worth of evidence that a score counts at most.
SLICE, EVIDENCE = 1 << 19, 50
#: Numbers of characters: 0 is the separator, 1 an unknown letter. ORDER of them fit into 64 bits.
SPACE = 1 << 16


_BITS = np.uint64(16)


def _suffix(code: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` characters."""
    return code & np.uint64((1 << 16 * order) - 1)


def _letters() -> np.ndarray:
    """For each code point: that of its lower-case letter, or 0 if it isn't a letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def numbers(text: str, table: np.ndarray) -> np.ndarray:
    """The text's characters as numbers, runs of separators as one 0, one 0 at both ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = table[codes]
    out = np.zeros(len(n) + 2, np.uint64)
    out[1:-1] = n
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def grams(n: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each character but the first; begins are padded with 0."""
    padded = np.concatenate([np.zeros(max(0, order - 2), np.uint64), n])
    size = len(n) - 1
    code = np.zeros(size, np.uint64)
    for i in range(order):
        start = len(padded) - size - (order - 1) + i
        code = code << _BITS | padded[start : start + size]
    return code


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)  # by order: sorted hashes
    logs: list[np.ndarray] = field(default_factory=list)  # rows by key, columns by language
    contexts: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # by language: its n-grams
    limit: np.ndarray | None = None

    def log_prob(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log P of the last character after the others, per language."""
        if order == 0:
            return np.full((len(code), len(self.languages)), -np.log(SPACE), np.float32)
        at, found = _find(self.keys[order - 1], code)
        out = self.logs[order - 1][at]
        if not found.all():
            miss = code[~found]
            lower = self.log_prob(_suffix(miss, order - 1), order - 1)
            where, known = _find(self.contexts[order - 1], miss >> _BITS)
            out[~found] = lower + np.where(known[:, None], self.weights[order - 1][where], 0)
        return out

    def entropy(self, text: str | None) -> tuple[np.ndarray, int]:
        """Cross-entropy per character in each language, and the number of letters."""
        n = numbers(text or "", self.table)
        letters = int((n > 0).sum())
        code = grams(n, ORDER)
        total = np.zeros(len(self.languages))
        for lo in range(0, len(code), SLICE):
            total -= self.log_prob(code[lo : lo + SLICE]).sum(0, dtype=np.float64)
        return total / max(1, len(code)), letters

    def fit(self, counts: list[dict[str, np.ndarray]]) -> None:
        """counts: for each language, its ORDER-grams (``keys``, sorted) and how often they occur (``n``)."""
        levels = [(c["keys"], c["n"].astype(np.float64)) for c in counts]
        by_order = [levels]
        for order in range(ORDER - 1, 0, -1):  # continuation counts
            levels = [np.unique(_suffix(keys, order), return_counts=True) for keys, _ in levels]
            levels = [(k, n.astype(np.float64)) for k, n in levels]
            by_order.append(levels)
        for order, levels in enumerate(reversed(by_order), 1):
            keys = np.unique(np.concatenate([k for k, _ in levels]))
            contexts = np.unique(keys >> _BITS)
            weights = np.zeros((len(contexts), len(levels)), np.float32)
            logs = np.zeros((len(keys), len(levels)), np.float32)
            lower = self.log_prob(_suffix(keys, order - 1), order - 1)
            for i, (own, n) in enumerate(levels):
                once, twice = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
                at = np.searchsorted(contexts, own >> _BITS)
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                p = np.zeros(len(keys))
                p[np.searchsorted(keys, own)] = (n - discount) / total[at]
                p += weight[np.searchsorted(contexts, keys >> _BITS)] * np.exp(lower[:, i])
                logs[:, i], weights[:, i] = np.log(p), np.log(weight)
            self.keys.append(keys)
            self.logs.append(logs)
            self.contexts.append(contexts)
            self.weights.append(weights)


def _sample(docs: DataFrame) -> DataFrame:
    """lang, fold and text of the training sample; two documents of a language are never in one fold only."""
    usable = docs.filter((crc_mod("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rates = [(r["lang"], PER_LANGUAGE / r["n"]) for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    picked = F.lit(False)
    for lang, rate in sorted(rates):
        picked = picked | ((F.col("lang") == lang) & share("doc_id", "sample", rate))
    dealt_in = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit("check")), "doc_id", "text")  # PER_LANGUAGE rows
    return usable.filter(picked).select("lang", (F.row_number().over(dealt_in) % FOLDS).alias("fold"), "text")


def _limits(languages: list[str], own: dict[str, np.ndarray]) -> np.ndarray:
    """The highest cross-entropy that each language accepts, from those of its documents by models that did not count them."""
    own = {lang: h for lang, h in own.items() if len(h)}
    about = np.concatenate([np.zeros(0), *(h - h.mean() for h in own.values())])
    free = len(about) - len(own)
    if free < 1:
        return np.full(len(languages), np.inf)
    beyond, deviation = np.quantile(about, 0.999), np.sqrt((about**2).sum() / free)
    mean = np.mean([h.mean() for h in own.values()])
    limit = np.empty(len(languages))
    for i, lang in enumerate(languages):
        h = own.get(lang, np.full(1, mean))
        reach, spread = np.quantile(h, 0.999), h.std()
        if len(h) < FEW:
            reach, spread = max(reach, h.mean() + beyond), max(spread, deviation)
        limit[i] = reach + SLACK * spread
    return limit


def train(docs: DataFrame) -> Model:
    sample = cut(_sample(docs))
    spark = docs.sparkSession
    letters = spark.sparkContext.broadcast(_letters())

    def alphabet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0x110000, np.int64)
        for batch in batches:
            for text in batch.column(0):
                codes = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
                seen, n = np.unique(letters.value[codes], return_counts=True)
                sums[seen] += n
        sums[0] = 0
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["letter", "n"])

    counted = sample.select("text").mapInArrow(alphabet, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    known = [r["letter"] for r in counted.orderBy(F.desc("n"), "letter").limit(SPACE - 2).collect()]
    number = np.zeros(0x110000, np.int64)
    number[known] = np.arange(2, len(known) + 2)
    lower = letters.value
    table = np.where(lower > 0, np.where(number[lower] > 0, number[lower], 1), 0).astype(np.uint16)

    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    model = Model(languages, table)
    if not languages:
        return model
    sent = spark.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple, list] = {}
            for lang, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault((lang, fold), []).append(grams(numbers(text, sent.value), ORDER))
            for (lang, fold), codes in held.items():
                keys, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), fold, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "fold", "gram", "n"])

    found = sample.mapInArrow(count, "lang string, fold int, gram long, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).toArrow()
    folds, keys, times = (found.column(c).to_numpy() for c in ("fold", "gram", "n"))
    keys = keys.view(np.uint64)
    of = pc.index_in(found.column("lang"), pa.array(languages, pa.string())).to_numpy()
    # by language and n-gram, so that its counts in several folds stand side by side
    order = np.lexsort((keys, of))
    folds, keys, times, of = folds[order], keys[order], times[order], of[order]
    del found, order

    def fitted(rows: np.ndarray) -> Model:
        """The model of the counts that ``rows``, a mask, names."""
        m = Model(languages, table)
        counts = []
        for i in range(len(languages)):
            mine = rows & (of == i)
            own, first = np.unique(keys[mine], return_index=True)
            counts.append({"keys": own, "n": np.add.reduceat(times[mine], first) if len(own) else np.zeros(0, np.int64)})
        m.fit(counts)
        m.counts = [len(c["keys"]) for c in counts]
        return m

    model = fitted(np.ones(len(keys), bool))
    parts = []
    # one fold's model at a time, so that the driver never holds all of them
    for k in range(FOLDS):
        trained = spark.sparkContext.broadcast(fitted(folds != k))

        def check(batches: Iterator[pa.RecordBatch], trained=trained) -> Iterator[pa.RecordBatch]:
            m = trained.value
            for batch in batches:
                of, entropies = [], []
                for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    i = languages.index(lang)
                    if m.counts[i]:  # the language has documents in other folds
                        each, n = m.entropy(text)
                        if n:
                            of.append(lang)
                            entropies.append(float(each[i]))
                yield pa.record_batch([pa.array(of, pa.string()), pa.array(entropies, pa.float64())], ["lang", "h"])

        parts.append(sample.filter(F.col("fold") == k).select("lang", "text").mapInArrow(check, "lang string, h double").toArrow())
        trained.destroy()
    discard(sample)
    scored = pa.concat_tables(parts)
    model.limit = _limits(languages, {lang: scored.filter(pc.equal(scored.column("lang"), lang)).column("h").to_numpy() for lang in languages})
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            langs, scores, rejected, entropies = [], [], [], []
            for text in batch.column(1):
                each, n = m.entropy(text.as_py()) if m.languages else (np.zeros(0), 0)
                if not n:
                    values = (UNKNOWN, 0.0, True, None)
                else:
                    best = int(np.argmin(each))
                    odds = np.exp(-(each - each[best]) * min(n, EVIDENCE))
                    values = (m.languages[best], float(1 / odds.sum()), bool(each[best] > m.limit[best]), float(each[best]))
                for column, value in zip((langs, scores, rejected, entropies), values, strict=True):
                    column.append(value)
            yield pa.record_batch(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(entropies, pa.float64())],
                ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")


def identify(docs: DataFrame) -> DataFrame:
    found = predict(docs, train(docs))
    return found.withColumn("held_out", crc_mod("doc_id", 3) == 1)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that have a language and aren't rejected, with their columns."""
    model = train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for text in batch.column(at):
                each, n = m.entropy(text.as_py()) if m.languages else (np.zeros(0), 0)
                best = int(np.argmin(each)) if n else 0
                keep.append(bool(n) and bool(each[best] <= m.limit[best]))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
