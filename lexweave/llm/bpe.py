"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Each match of the splitting pattern is encoded by itself: its bytes are merged,
always the adjacent pair whose concatenation has the lowest rank, the first of
equals, until no concatenation has one. Decoding concatenates the ids' bytes.

Two forms give the same ids:

* ``encode_native`` works on the distinct words of the whole table, with Spark
  expressions only. A fold over an array of ids merges the pair of lowest rank
  in each step; the ranks of pairs are literal arrays, a cuckoo table with two
  places for each pair. The words' ids meet the documents' words in a join.
* ``encode`` makes the same fold in Python over the distinct words of each task,
  so that texts are never shuffled. See the README for the figures of both.

The vocabulary's path is a parameter; the file is read on the driver and sent to
the executors (its size is fixed: 50,256 entries).

Defined cases: null text is empty and has no ids; rows are encoded one by one,
so repeated rows and null ids are kept; an empty table gives an empty result;
lone surrogates can't occur in a Spark string; decoding gives the text's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

#: Words that a task keeps encoded (twice as many at most), and ids that it hands on at once (more, if one text has more).
HELD, CHUNK = 250_000, 500_000
#: Longer words are merged with a heap, which gives the same ids in less time.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    get, none = ranks.get, len(ranks)
    found = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found:
        low = min(found)
        if low == none:
            break
        at = found.index(low)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del found[at]
        if at:
            found[at - 1] = get(parts[at - 1] + parts[at], none)
        if at < len(found):
            found[at] = get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, with a heap of pairs and a linked list of parts."""
    size = len(word)
    end = list(range(1, size + 1))  # of the part that begins at i; 0: no part begins there
    before = list(range(-1, size - 1))
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= size or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < size:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[word[i : end[i]]] for i in range(size) if end[i]]


class _Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers. Of what was held
    before the last HELD new words, what occurs again is taken over."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.before = ranks, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > HELD:
            self.before = dict(self)
            self.clear()
        ids = self.before.pop(word, None)
        if ids is None:
            ids = np.array(merge(word.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes()
        self[word] = ids
        return ids


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted, of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        words = _Words(sent.value)
        pieces = np.array([None] * len(sent.value), object)
        for token, rank in sent.value.items():
            pieces[rank] = token

        def out(ids_of: pa.Array) -> pa.RecordBatch:
            columns = [ids_of, pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if keep_ids:
                offsets = pa.array(np.cumsum([0, *sizes]), pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32))))
            return pa.record_batch(columns, names)

        for batch in batches:
            sizes, digests, decoded, arrays, start, room = [], [], [], [], 0, 0
            for at, text in enumerate(batch.column(1), 1):
                packed = b"".join(map(words.__getitem__, split(text.as_py() or "")))
                ids = np.frombuffer(packed, "<u4")
                sizes.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(b"".join(pieces[ids].tolist())).hexdigest())
                if keep_ids:
                    arrays.append(ids.astype(np.int32))
                room += len(ids)
                if room > CHUNK:
                    yield out(batch.column(0).slice(start, at - start))
                    sizes, digests, decoded, arrays, start, room = [], [], [], [], at, 0
            yield out(batch.column(0).slice(start))

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` (with ids) and the bytes that its ids stand for, as ``decoded``."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.array([None] * len(sent.value), object)
        for token, rank in sent.value.items():
            pieces[rank] = token
        at = names.index("ids")
        for batch in batches:
            texts = [None if not ids.is_valid else b"".join(pieces[ids.values.to_numpy()].tolist()) for ids in batch.column(at)]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.binary())], [*names, "decoded"])

    names = encoded.columns
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


# --- the native form ---------------------------------------------------------


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Pairs of ids that merge, and the id they become, as a cuckoo table: a pair
    is at place(pair, 0) or at place(pair, 1)."""
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    size = len(pairs) * 5 // 2 | 1
    keys = [-1] * size
    for key in pairs:
        which = 0
        for _ in range(500):
            at = place(key, which, size)
            key, keys[at] = keys[at], key
            if key < 0:
                break
            which = 1 if at == place(key, 0, size) else 0
        else:
            raise ValueError("the pairs don't fit into the table")
    return keys, [pairs.get(k, -1) for k in keys]


def place(key: int, which: int, size: int) -> int:
    return (key * 48271 >> 11 if which else key) % size


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """word and its ids (array<int>), for distinct ``words``: a fold that merges one pair a step."""
    keys, values = pair_table(ranks)
    size, none = len(keys), len(ranks)
    keys_, values_ = (F.split(F.lit(",".join(map(str, v))), ",").cast(kind) for v, kind in ((keys, "array<bigint>"), (values, "array<int>")))
    first = F.split(F.lit(",".join(str(ranks[bytes([i])]) for i in range(256))), ",").cast("array<int>")

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def rank(a: Column, b: Column) -> Column:
        def at(key: Column, which: int) -> Column:
            return ((F.shiftright(key * 48271, 11) if which else key) % size).cast("int")

        def find(key: Column) -> Column:
            here = [F.when(F.get(keys_, at(key, w)) == key, F.get(values_, at(key, w))) for w in (0, 1)]
            return F.coalesce(*here, F.lit(none))

        return let(a.cast("long") * 65536 + b, find)

    def step(ids: Column) -> Column:
        found = F.zip_with(ids, F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), lambda a, b: F.when(b.isNull(), none).otherwise(rank(a, b)))

        def use(f: Column) -> Column:
            low = F.array_min(f)
            at = F.array_position(f, low).cast("int")
            return F.when(low == none, ids).otherwise(F.concat(F.slice(ids, F.lit(1), at - 1), F.array(low), F.slice(ids, at + 2, F.size(ids))))

        return let(found, use)

    bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length("word")), lambda i: F.get(first, F.conv(F.substring(F.hex("word"), 2 * i - 1, F.lit(2)), 16, 10).cast("int")))
    steps = F.when(F.octet_length("word") > 1, F.sequence(F.lit(2), F.octet_length("word"))).otherwise(F.array().cast("array<int>"))
    return words.select("word", F.aggregate(steps, bytes_, lambda ids, _: step(ids)).alias("ids"))


def encode_native(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """As ``encode``: split, fold the distinct words, join, gather by document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.select("row", "doc_id", F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?U)({pattern})"), 0)).alias("at", "word"))
    words = split.filter("word is not null").select("word").distinct()
    pieces = F.split(F.lit(",".join(t.hex() for t, _ in sorted(ranks.items(), key=lambda x: x[1]))), ",")
    little = lambda i: F.regexp_replace(F.lpad(F.hex(i), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1")
    done = encode_words(words, ranks).select(
        "word", F.size("ids").alias("n"), F.array_join(F.transform("ids", little), "").alias("packed"), F.array_join(F.transform("ids", lambda i: F.get(pieces, i)), "").alias("bytes")
    )
    met = split.join(done, "word", "left").groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("at", "packed", "bytes")))).alias("parts"),
    )
    gathered = lambda c: F.sha2(F.unhex(F.array_join(F.transform("parts", lambda p: p[c]), "")), 256)
    return met.select("doc_id", "n_tokens", gathered("packed").alias("ids_sha256"), gathered("bytes").alias("decoded_sha256"))
