"""The prefix trie, best-fit packing and hard negatives against brute force, with
nulls, empty texts, ties, repeated rows, clashing columns and empty tables."""

import base64
import hashlib
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexweave.llm import bpe, negatives, packing, trie
from lexweave.llm.queries import op11_prefix_trie, op12_best_fit_packing, op13_hard_negatives

TURNS = "conv_id long, turn long, role string, text string, at int, key string"


# --- trie --------------------------------------------------------------------


def _nodes(conversations: dict) -> dict:
    """(depth, smallest member) -> the other columns, from the sequences themselves."""
    members, ends, kids, top = {}, {}, {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = kids.get(k, [])
        own = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        top[k] = (sum(top[b][0] for b in below) or 1, own + sum(top[b][1] for b in below))
    return {
        (len(k), min(m)): (min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), *top[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, m in members.items()
    }


def _found(df) -> dict:
    rows = df.collect()
    out = {(r.depth, r.conv_id): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def _rebuilt(rows: list) -> dict:
    own: dict = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


@pytest.fixture(scope="module")
def talks():
    random.seed(3)
    rows = []
    for c in range(60):
        first = "hello" if c % 3 else f"hi {c}"
        for t in range(random.randint(1, 12)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", first if t == 0 else f"turn é {random.randint(0, 1)}", 1, "x"))
    copies = [(c, t, "user", f"same {t}", 1, "x") for c in range(100, 130) for t in range(11)]
    near = [(c, t, "user", f"same {t}" if t < 10 else f"end {c}", 1, "x") for c in range(200, 210) for t in range(11)]
    odd = [(61, None, None, None, 1, "x"), (61, 0, "user", "", 1, "x"), (62, 1, "a", "b", 1, "x"), (62, 1, "a", "c", 1, "x"), (62, 1, "a", "b", 1, "x"), (None, 0, "user", "lost", 1, "x"), (-7, 0, "user", "hello", 1, "x")]
    return rows + copies + near + odd + [rows[0]]


def test_trie_of_rebuilt_conversations(spark, talks, tmp_path):
    spark.createDataFrame(talks, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert _found(op11_prefix_trie(spark, str(tmp_path))) == _nodes(_rebuilt(talks))


def test_trie_of_large_groups(spark, talks, monkeypatch):
    """Hot keys, blocks of turns and pieces of ids, made small."""
    monkeypatch.setattr(trie, "HOT_LEAST", 3)
    monkeypatch.setattr(trie, "HOT_SHARE", 10)
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "PIECE_BITS", 2)
    turns, members = trie.positions(spark.createDataFrame(talks, TURNS))
    own = {}
    for c, turn, role, text, *_ in talks:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(t)] for c, t in own.items()}
    assert _found(trie.prefix_trie(turns, members.select("conv_id"))) == _nodes(own)
    got = {}
    for r in trie.shared_openings(turns, members)[0].collect():
        got.setdefault(r.conv_id, []).append(r.at)
    assert {c: sorted(a) for c, a in got.items()} == {c: list(range(1, len(t) + 1)) for c, t in _rebuilt(talks).items() if t}


def test_trie_of_nothing(spark):
    turns, members = trie.positions(spark.createDataFrame([], TURNS))
    assert trie.prefix_trie(*trie.shared_openings(turns, members)).count() == 0
    turns, _ = trie.positions(spark.createDataFrame([], TURNS))
    only = trie.prefix_trie(turns, spark.createDataFrame([(5,), (6,)], "conv_id long"))
    assert _found(only) == _nodes({5: [], 6: []})


# --- packing -----------------------------------------------------------------

DOCS = "doc_id long, text string, length string, part string"


def _seats(runs):
    bins, seen = {}, Counter()
    for size, low, items, first, each, offset in runs:
        assert low == seen[size]
        seen[size] += items
        for i in range(items):
            bins.setdefault(first + i // each, []).append((offset + i % each * size, size))
    return bins, seen


def test_plan_fills_without_gaps_or_overlaps():
    random.seed(1)
    for _ in range(200):
        capacity = random.choice([10, 30, 64, 2048])
        counts = {random.randint(1, capacity): random.choice([1, 2, 3, 7, 1000]) for _ in range(random.randint(1, 60))}
        bins, seen = _seats(packing.plan(counts, capacity))
        assert seen == counts and sorted(bins) == list(range(len(bins)))
        for seats in bins.values():
            at = 0
            for offset, size in sorted(seats):
                assert offset == at
                at += size
            assert at <= capacity


def test_plan_is_best_fit():
    """As many sequences as one item at a time takes: large ones matched, small ones into the smallest gap."""
    random.seed(2)
    for _ in range(50):
        capacity = random.choice([30, 90, 2048])
        sizes = [random.randint(1, capacity) for _ in range(random.randint(1, 400))]
        large, gaps = sorted((s for s in sizes if 3 * s > capacity), reverse=True), []
        while large:
            a = large.pop(0)
            at = next((i for i, b in enumerate(large) if a + b <= capacity), None)
            gaps.append(capacity - a - (large.pop(at) if at is not None else 0))
        for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else capacity) - s)
        bins, _ = _seats(packing.plan(Counter(sizes), capacity))
        assert len(bins) == len(gaps)


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_packing_of_documents(spark, ranks, tmp_path):
    from tokenizers import Tokenizer

    random.seed(4)
    long = " ".join(random.choices(["Wörter", "and", "the", "<|endoftext|>", "x" * 30, "\n\n  "], k=6000))
    rows = [(i, " ".join(random.choices(["a", "bb", "straße", "12 %"], k=random.randint(0, 700))), "l", "p") for i in range(80)]
    rows += [(100, long, "l", "p"), (101, None, "l", "p"), (102, "", "l", "p"), (None, "no id", "l", "p"), rows[0], rows[0], (103, "z" * 50_000, "l", "p")]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op12_best_fit_packing(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[doc, i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for seats in bins.values():
        at = 0
        for offset, size in sorted(seats):
            assert offset == at
            at += size
        assert at <= 2048
    again = packing.sequences(packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), ranks, public_tokenizers.PATTERN, 100, keep_ids=True)).collect()
    assert all(r.length == len(r.ids) <= 100 for r in again) and sum(r.length for r in again) == sum(r.length for r in found)
    assert packing.pack(spark.createDataFrame([], DOCS), ranks, public_tokenizers.PATTERN).count() == 0


def test_ranks_and_merges_are_one_vocabulary(ranks):
    """tiktoken with the ranks gives the ids of the other library with the merges."""
    import tiktoken
    from tokenizers import Tokenizer

    random.seed(6)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pool = [base64.b64encode(random.randbytes(9)).decode(), "don't", "we'LL", "  \t\n", "ñandú", "日本語", "🙂", "١٢", "a" * 40, "x=1;", "Ⅷ", " ", "é"]
    for _ in range(300):
        text = "".join(random.choices(pool, k=30))
        assert own.encode_ordinary(text) == tokenizer.encode(text, add_special_tokens=False).ids


# --- hard negatives ----------------------------------------------------------

VECTORS = "vec_id long, label int, embedding array<float>, score int, rank string"


def _mined(rows) -> Counter:
    fine = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(x * 256 // 1) for x in v]) for i, label, v, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = Counter()
    for a, la, va in sorted({(i, k, tuple(v)) for i, k, v in fine if i % 50 == 0}):
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), i, k) for i, k, v in fine if i != a and len(v) == len(va)]
        for minus, p, _ in sorted(s for s in scored if s[2] == la)[:5]:
            hits = sorted(s[:2] for s in scored if s[2] != la and 50 * -minus <= 100 * -s[0] <= 95 * -minus)[:3]
            out.update((a, p, r, n, -minus, -m) for r, (m, n) in enumerate(hits, 1))
    return out


def _pairs(df) -> Counter:
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def test_hard_negatives(spark, tmp_path):
    random.seed(5)
    centres = [[random.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, i % 3, [struct.unpack("f", struct.pack("f", x + random.gauss(0, 0.3)))[0] for x in centres[i % 4]], 1, "r") for i in range(400)]
    rows += [(500, None, [1.0] * 6, 1, "r"), (501, 1, None, 1, "r"), (502, 1, [None] * 6, 1, "r"), (550, 1, [float("nan")] * 6, 1, "r"), (551, 1, [float("inf")] * 6, 1, "r"), (None, 1, [1.0] * 6, 1, "r")]
    rows += [(600, 1, [1.0, 2.0], 1, "r"), (601, 1, [1.0, 1.5], 1, "r"), (602, 2, [1.0, 1.25], 1, "r"), (650, 2, [0.0] * 6, 1, "r"), (700, 1, [], 1, "r"), (701, 1, [], 1, "r"), (702, 2, [], 1, "r")]
    rows += [rows[1], rows[1], rows[2], rows[50], rows[50]] + [(800 + i, i % 2, rows[7][2], 1, "r") for i in range(30)]
    spark.createDataFrame(rows, VECTORS).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert _pairs(op13_hard_negatives(spark, str(tmp_path))) == _mined(rows)


def test_hard_negatives_of_huge_components_and_of_nothing(spark):
    random.seed(7)
    rows = [(i, i % 2, [random.uniform(0.5, 1) * 1e12 for _ in range(3)], 1, "r") for i in range(120)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    want = Counter({(*k[:4], *(max(-(2**63), min(2**63 - 1, s)) for s in k[4:])): n for k, n in _mined(rows).items()})
    assert _pairs(negatives.hard_negatives(df.withColumn("label", label))) == want
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_pivots_leave_most_of_clustered_vectors_out():
    """Rows of 40 narrow clusters: brackets decide nearly all pairs without the vectors."""
    import numpy as np

    random_ = np.random.default_rng(0)
    centres = random_.normal(size=(40, 64)) * 200
    points = np.floor(np.repeat(centres, 100, 0) + random_.normal(size=(4000, 64)) * 3)
    top = float(((np.abs(points) + 1) ** 2).sum(1).max())
    pivots = negatives.choose_pivots(points[::8], top)
    d = negatives.distances(points, pivots, np.sqrt(np.maximum(top - (points**2).sum(1), 0)))
    asked = [{"vec_id": i, "label": 0, "v": points[i].tobytes()} for i in range(0, 4000, 50)]
    search = negatives.Search(negatives.Anchors(asked, 64, top), pivots, False, 5, False, (np.arange(0, 4000, 8), np.zeros(500, int), points[::8]))
    for start in range(0, 4000, 100):
        search.offer(0, np.arange(start, start + 100), points[start : start + 100], d[start : start + 100])
    for i, held in zip(search.a.ids, search.best, strict=True):
        scores = points @ points[i]
        scores[i] = -np.inf
        assert [-m for m, _ in held[0]] == sorted(scores)[::-1][:5]
    assert search.computed < 0.1 * 80 * 4000
