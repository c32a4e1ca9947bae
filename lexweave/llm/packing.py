"""Best-fit packing of documents into sequences of a fixed number of tokens.

Sizes are whole numbers up to the capacity, so the packing is decided on the
histogram of sizes - one count per size, at most ``capacity`` rows whatever the
number of documents - and items find their places by their rank within a size.

1. Large items (above a third of the capacity; at most two fit a sequence) are
   matched greedily: the largest first, each with the largest that still fits.
2. Small items, the largest first, go to the smallest gap that holds them; a new
   sequence is begun only if none does.

``plan`` works on counts: all items of a size that go to equal gaps are one run
(ranks to numbered sequences). A gap that a run uses shrinks to less than half, and
a size splits at most two ranges of sequences, so the runs are some tens of
thousands at most, whatever the number of items: they are sent to the tasks.

Ranks are counted by the tasks that tokenize, each for itself; a task's first rank
of a size is the sum of the counts of the tasks before it, so a size that a third
of all items have is split like any other.

A document is its tokens and an end token. One that is longer than the capacity is
cut into full pieces; the first piece takes what is over.

Tokens are those of a byte-level vocabulary given by its ranks (see the README for
why tiktoken counts them and not the other library, whose ids are the same).

Defined cases: null text is empty (one piece: the end token); rows are packed one
by one, so repeated rows and null ids are kept; ties within a size are in the order
of the input's partitions; an empty table gives an empty result; further columns
are left out of the plan and can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

CAPACITY, END = 2048, 0
#: Tokens handed on at once where ids are kept (more, if one text has more).
CHUNK = 500_000
_RANK_BITS = 48


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first rank, items, first sequence, items a sequence, offset of the first of them)."""
    left = {size: n for size, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs, begun = [], 0

    def put(size: int, items: int, first: int, each: int, offset: int) -> None:
        runs.append((size, used[size], items, first, each, offset))
        used[size] += items
        left[size] -= items

    sizes = sorted(left, reverse=True)
    large = [s for s in sizes if 3 * s > capacity]
    for a in large:
        while left[a]:
            b = next((s for s in large if s <= min(a, capacity - a) and left[s] > (s == a)), 0)
            n = left[a] // 2 if a == b else min(left[a], left[b]) if b else left[a]
            put(a, 2 * n if a == b else n, begun, 2 if a == b else 1, 0)
            if b and a != b:
                put(b, n, begun, 1, a)
            gaps[capacity - a - b].append((begun, n))
            begun += n
    for s in sizes[len(large) :]:
        while left[s]:
            gap = next((g for g in range(s, capacity + 1) if gaps[g]), 0)
            if not gap:
                gap, new = capacity, -(-left[s] // (capacity // s))
                gaps[gap].append((begun, new))
                begun += new
            first, n = gaps[gap].pop()
            each = gap // s
            full = min(n, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                gaps[gap - full // full * each * s].append((first, full))
            rest = left[s] if full < n else 0  # less than one sequence takes
            if rest:
                put(s, rest, first + full, rest, capacity - gap)
                gaps[gap - rest * s].append((first + full, 1))
            over = n - full - (1 if rest else 0)
            if over:
                gaps[gap].append((first + full + (1 if rest else 0), over))
    return runs


def pieces(docs: DataFrame, ranks: dict[bytes, int], pattern: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and ids if wanted; ``part`` and
    ``place`` count the pieces of a length within a task."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={}).encode_ordinary
        part, met = TaskContext.get().partitionId(), [0] * (capacity + 1)

        def out(ids: pa.Array) -> pa.RecordBatch:
            columns = [ids.take(pa.array(row, pa.int64()))] + [pa.array(c, t) for c, t in ((number, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()), ([part] * len(row), pa.int32()), (place, pa.int64()))]
            if keep_ids:
                offsets = pa.array(np.cumsum([0, *length]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32))))
            return pa.record_batch(columns, names)

        for batch in batches:
            row, number, start, length, crc, place, arrays, room = [], [], [], [], [], [], [], 0
            for at, text in enumerate(batch.column(1)):
                tokens = encode(text.as_py() or "")
                tokens.append(end)
                ids, size = np.array(tokens, "<u4"), len(tokens)
                cuts = [0, *range(size % capacity or capacity, size + 1, capacity)] if size > capacity else [0, size]
                for i in range(len(cuts) - 1):
                    low, high = cuts[i], cuts[i + 1]
                    row.append(at)
                    number.append(i)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(ids[low:high]))
                    place.append(met[high - low])
                    met[high - low] += 1
                if keep_ids:
                    arrays.append(ids)
                    room += size
                    if room > CHUNK:
                        yield out(batch.column(0))
                        row, number, start, length, crc, place, arrays, room = [], [], [], [], [], [], [], 0
            yield out(batch.column(0))

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * keep_ids
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _seat(runs: list[tuple[int, int, int, int, int, int]], extra: list[str]):
    """Adds sequence_id and offset to rows with length and rank."""
    runs = sorted(runs)
    size, low, _, first, each, base = (np.array(c, np.int64) for c in zip(*runs, strict=True))
    begins = (size << _RANK_BITS) + low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(begins, (length << _RANK_BITS) + rank, side="right") - 1
            nth = rank - low[at]
            sequence, offset = first[at] + nth // each[at], base[at] + nth % each[at] * length
            yield pa.record_batch([*(batch.column(c) for c in extra), pa.array(sequence), pa.array(offset)], [*extra, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of ``docs``."""
    with small_batches(docs.sparkSession, 2_000, 1 << 23):
        cut_up = cut(pieces(docs, ranks, pattern, capacity, end, keep_ids))
    tallies = cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row per size: at most ``capacity`` of them
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tallies.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut_up.join(firsts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = dict(cut_up.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long"
    if not counts:
        return cut_up.select(*kept, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return ranked.select(*kept, "rank").mapInArrow(_seat(plan(counts, capacity), kept), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids of each sequence of ``packed`` (with ids): a
    sequence holds at most ``capacity`` tokens, so no group is large."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    return rows.select("sequence_id", "length", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
