"""Fuzzy look-up of distinct titles and names in a register, without a cartesian product.

The ratio of two strings is twice the matched characters over the sum of the lengths
(the better of the strings as they are and with their words sorted). Three bounds, each
of which no match can miss, come before it:

1. lengths: the pool is cut into blocks of strings of similar length, and a block of
   probes meets, by an equi-join on the length class, only blocks of lengths that can
   reach the cut-off;
2. characters: matched characters are at most those that both have, counted with
   repeats; one array operation per character decides a whole pair of blocks;
3. order: matched characters are at most the longest common subsequence, which a few
   operations on one integer per character give.

Blocks are bounded on both sides, so a length or a year that a third of a register has
is split like any other. The pool's blocks are made once for a register.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio

CLASS, POOL_BLOCK, PROBE_BLOCK, DEALT = 8, 1024, 256, 16
#: Hits of a pair of blocks that are handed on at once; tasks a core among which blocks of probes are dealt.
HITS, TASKS = 100_000, 4
_BLOCK = "bucket int, keys array<string>, years array<int>, refs array<long>"
_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}
_KINDS = len(_LETTERS) + 16


def blocks_of(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (key, year, ref) as blocks of keys of one length class."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(bucket: int) -> pa.RecordBatch:
            keys, years, refs = zip(*held.pop(bucket), strict=True)
            values = ([bucket], [list(keys)], [list(years)], [list(refs)])
            types = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            return pa.record_batch([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["bucket", "keys", "years", "refs"])

        for batch in batches:
            for bucket, *row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.setdefault(bucket, []).append(row)
                if len(held[bucket]) == most:
                    yield out(bucket)
        for bucket in list(held):
            yield out(bucket)

    classed = rows.filter("key <> ''").select(F.expr(f"length(key) div {CLASS}").cast("int").alias("bucket"), "key", F.col("year").cast("int").alias("year"), F.col("ref").cast("long").alias("ref"))
    return classed.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(DEALT))).mapInArrow(pack, _BLOCK)


def _counts(keys: list[str]) -> np.ndarray:
    """How often each key has each letter; rarer characters share 16 places, which can only raise a bound."""
    out = np.zeros((len(keys), _KINDS), np.int16)
    for row, key in zip(out, keys, strict=True):
        for c in key:
            row[_LETTERS.get(c, len(_LETTERS) + ord(c) % 16)] += 1
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by the bits of one integer."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def possible(a: str, b: str, need: float) -> bool:
    """Can the ratio of the strings, or of their sorted words, reach ``need``?"""
    for x, y in ((a, b), (" ".join(sorted(a.split())), " ".join(sorted(b.split())))):
        if 2 * _common(x, y) >= need * (len(x) + len(y)) - 1e-9:
            return True
    return False


def _places(keys: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct keys, and the places of each: those of key i are ``order[ends[i]:ends[i + 1]]``."""
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    of = np.fromiter((number[k] for k in keys), np.int64, len(keys))
    return list(number), np.argsort(of, kind="stable"), np.r_[0, np.cumsum(np.bincount(of, minlength=len(number)))]


def close_in(keys: list[str], years: list[int | None], pool: list[str], pool_years: list[int | None], cutoff: float, cross_year: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two blocks with a score of at least ``cutoff``, as columns: probe, entry, score, of
    the probe's year. Strings that recur, with other years or entries, are compared once."""
    mine, order, ends = _places(keys)
    theirs, p_order, p_ends = _places(pool)
    shared = np.zeros((len(mine), len(theirs)), np.int32)
    for x, y in zip(_counts(mine).T, _counts(theirs).T, strict=True):
        if x.any() and y.any():
            shared += np.minimum(x[:, None], y[None, :])
    # words that are sorted lose what white space was more than one
    size = [np.array([len(" ".join(k.split())) for k in ks]) for ks in (mine, theirs)]
    bound = 2.0 * shared / np.maximum(size[0][:, None] + size[1][None, :], 1)
    asked, had = (np.array([-1 if y is None else y for y in ys], np.int64) for ys in (years, pool_years))
    found: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.int64, np.int64, np.float64, bool)]
    for i, j in zip(*np.nonzero(bound >= cutoff - 1e-9), strict=True):
        a, b = order[ends[i] : ends[i + 1]], p_order[p_ends[j] : p_ends[j + 1]]
        same = asked[a][:, None] == had[b][None, :]
        weight = np.where(same | (asked[a][:, None] < 0), 1.0, cross_year)
        most = float(weight.max())
        if bound[i, j] * most < cutoff - 1e-9 or not possible(mine[i], theirs[j], cutoff / most):
            continue
        score = ratio(mine[i], theirs[j]) * weight
        x, y = np.nonzero(score >= cutoff)
        for column, values in zip(found, (a[x], b[y], score[x, y], same[x, y]), strict=True):
            column.append(values)
    return tuple(np.concatenate(column) for column in found)


def close(probes: DataFrame, pool: DataFrame, cutoff: float, cross_year: float = 1.0) -> DataFrame:
    """key, year, ref, score, same: the entries of ``pool`` (from ``blocks_of``) whose
    score against distinct ``probes`` (key, year) is at least ``cutoff``. A probe with a
    year weighs entries of other years by ``cross_year``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j, score, same = close_in(row["keys"], row["years"], row["p_keys"], row["p_years"], cutoff, cross_year)
                refs = np.array(row["p_refs"], np.int64)
                for lo in range(0, len(i), HITS):
                    at = slice(lo, lo + HITS)
                    keys, years = pa.array(row["keys"], pa.string()).take(pa.array(i[at])), pa.array(row["years"], pa.int32()).take(pa.array(i[at]))
                    yield pa.record_batch([keys, years, pa.array(refs[j[at]]), pa.array(score[at]), pa.array(same[at])], ["key", "year", "ref", "score", "same"])

    asked = blocks_of(probes.select("key", "year", F.lit(0).alias("ref")), PROBE_BLOCK)
    # a ratio is at most twice the shorter length over the sum of lengths
    share = cutoff / (2 - cutoff)
    low = F.floor(F.col("bucket") * CLASS * share / CLASS - 1e-9).cast("int")
    high = F.floor((F.col("bucket") * CLASS + CLASS - 1) / share / CLASS + 1e-9).cast("int") if share else F.lit(1 << 16)
    spread = asked.select(F.explode(F.sequence(low, high)).alias("bucket"), "keys", "years")
    # a number of its own, as blocks are few bytes and much work, which would be put into one task
    spread = spread.repartition(TASKS * probes.sparkSession.sparkContext.defaultParallelism, "bucket", F.xxhash64("keys", "years"))
    right = pool.select("bucket", F.col("keys").alias("p_keys"), F.col("years").alias("p_years"), F.col("refs").alias("p_refs"))
    return spread.join(right, "bucket").mapInArrow(run, "key string, year int, ref long, score double, same boolean")


