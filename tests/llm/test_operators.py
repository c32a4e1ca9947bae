"""Each operator on small tables: against brute force, and with nulls, empty
texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexweave.llm import bpe, jaccard, langid, lm, mixing, neardup, quality, topk, urls, warc

DOCS = "doc_id long, text string, lang string, source string, size long"
random.seed(5)
WORDS = [f"w{i}" for i in range(300)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else "fr", f"s{i % 3}" if i else None, 7) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    base = [" ".join(random.choices(WORDS, k=random.randint(20, 80))) for _ in range(30)]
    near = [" ".join([*t.split()[:-1], "other"]) for t in base[:12]]
    rows = list(enumerate(base + near + base[:5] + ["", None, "one", "One two", "ONE two"], 1))
    return [*rows, rows[0], (None, base[0])]


def _sets(text, k):
    w = (text or "").encode().lower().split()
    return {b" ".join(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, texts, k, percent):
    found = {r.doc_id: r for r in jaccard.join(_docs(spark, texts), k, percent).collect()}
    sets = {i: _sets(t, k) for i, t in texts if i is not None}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
                elif a != b and root[a] != root[b] and sets[a] and sets[a] == sets[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {i: (len(s), root[i]) for i, s in sets.items()} == {i: (found[i].n_shingles, found[i].component_id) for i in sets}
    assert found[None].component_id is None
    kept = [r.doc_id for r in jaccard.keep_one(_docs(spark, texts), k, percent).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({root[i] for i in root}) and None in kept


def test_jaccard_of_large_groups(spark):
    """More near copies than RARE share their shingles, so blocks are compared."""
    base = [f"v{i}" for i in range(100)]
    rows = [(i, " ".join(base[: 90 - i % 3] + [f"x{i}"])) for i in range(60)]
    found = jaccard.join(_docs(spark, rows), 3, 90).collect()
    assert {r.component_id for r in found} == {0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.join(none).count() == 0
    assert mixing.mixed(none).count() == 0 and mixing.mix(none).count() == 0
    assert lm.class_lm(none).count() == 0
    assert langid.identify(none).count() == 0
    assert quality.classify(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neardup.near_duplicates(vectors).count() == 0 and topk.top_k(vectors).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(pages).count() == 0 and warc.derivatives(pages).count() == 0


def test_mixing(spark, texts):
    rows = mixing.mixed(_docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert all(r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r)
    total = sum(r.size for r in rows)
    assert math.isclose(sum(t for _, t in by), 1.5 * total, rel_tol=1e-9)
    for (size, target), own in by.items():
        assert sum(r.size for r in own) == size and target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) * 2
    mixed = mixing.mix(_docs(spark, texts))
    assert mixed.columns == DOCS.replace(",", "").split()[::2]
    assert Counter(r.doc_id for r in mixed.collect())[2] in (0, 1, 2)


def test_class_lm(spark, texts):
    rows = lm.class_lm(_docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    train = [t for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(count.values()), len(count)
    want = {i: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*(t or "").encode().lower().split(), b"\n"]) for i, t in texts}
    for r in rows:
        assert r.train_tokens == n and math.isclose(r.base_score, want[r.doc_id], rel_tol=1e-9) and r.score < 0


def test_class_probabilities_sum_to_one(spark):
    """Over the classes after any class, and over the items of a class."""
    import numpy as np

    bigrams = np.random.default_rng(1).poisson(2.0, (lm.SHARED + 3, lm.SHARED + 3)).astype(float)
    m = lm.Model([lm.END, b"a", b"b"], bigrams, {lm.END: 1}, 10, 3, np.zeros(lm.SHARED))
    assert np.allclose((10**m.step).sum(1), 1)
    assert np.allclose(np.bincount(m.of, 10**m.emit, lm.CLASSES)[np.unique(m.of)], 1)


VECTORS = "vec_id long, embedding array<float>, label int, rep long, score long"


def _vectors(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1, 161):
        v = [rng.gauss(0, 1) for _ in range(8)]
        rows += [(i * 10, v, i % 3, 0, 0), (i * 10 + 1, [x + rng.gauss(0, 0.15) for x in v], i % 3, 0, 0)]
    rows += [(5000, rows[0][1], 1, 0, 0), (5001, None, 1, 0, 0), (5002, [0.0] * 8, 1, 0, 0), (5003, [float("nan")] * 8, 1, 0, 0), (5004, rows[0][1], None, 0, 0), (5005, [1.0, 2.0], 1, 0, 0), (5006, [], 1, 0, 0), (5007, [None] * 8, 1, 0, 0)]
    return spark.createDataFrame(rows, VECTORS)


def test_near_duplicate_vectors(spark):
    df = _vectors(spark)
    rows = df.collect()
    good = [r for r in rows if r.embedding and r.label is not None and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    links = {r.vec_id: set() for r in rows}
    for a in good:
        for b in good:
            if a.vec_id != b.vec_id and a.label == b.label and len(a.embedding) == len(b.embedding):
                dot = sum(x * y for x, y in zip(a.embedding, b.embedding))
                if dot / math.sqrt(sum(x * x for x in a.embedding) * sum(x * x for x in b.embedding)) >= 0.93:
                    links[a.vec_id].add(b.vec_id)
    found = {r.vec_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: len(x) for i, x in links.items()} == {i: r.n_links for i, r in found.items()}
    for i, others in links.items():
        assert all(found[i].component_id == found[o].component_id for o in others)
        assert found[i].kept == (found[i].component_id == i)


def test_top_k(spark):
    df = _vectors(spark)
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in df.collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    want = set()
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:10]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()} == want


def test_bpe(spark, texts):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*texts, (900, "a" * 700 + "  é\n\n 日本語 <|endoftext|> don't"), (901, "".join(random.choices("abcdeé", k=3000)))]
    df = _docs(spark, rows)

    def want(t):
        ids = own.encode_ordinary(t or "")
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    expected = Counter((i, *want(t)) for i, t in rows)
    encoded = bpe.encode(df, ranks, public_tokenizers.PATTERN)
    assert Counter(tuple(r)[:4] for r in encoded.collect()) == expected
    decoded = bpe.decode(encoded, ranks).filter("doc_id = 900").first().decoded
    assert bytes(decoded).decode() == rows[-2][1]
    short = df.filter(F.length("text") < 100)
    native = Counter(tuple(r) for r in bpe.encode_native(short, ranks, public_tokenizers.PATTERN).collect())
    assert native == Counter((i, *want(t)) for i, t in rows if t is not None and len(t) < 100)


def test_urls(spark):
    rows = [
        (1, "https://www.Example.com/en/a", "www.example.com", "/en/a", "www.example.com/en/", "allow"),
        (2, "http://example.com/en/b?x", "example.com", "/en/b", "example.com/en/", "block"),
        (3, "http://a.example.com/de/", "a.example.com", "/de/", "com/", "allow"),
        (4, "http://x.net/es/1#t", "x.net", "/es/1", "net/es/", "block"),
        (5, "http://notcom", "notcom", "", None, "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme/net/es/", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] + ("x",) for r in rows], "page_id long, url string, host string")
    assert {tuple(r)[:5] for r in urls.judge(df).collect()} == {r[:1] + r[2:] for r in rows}


def test_url_templates_learn_from_labels(spark):
    rows = [(f"h.org", ["a", str(i)], 1, 0) for i in range(20)] + [("h.org", ["b", str(i)], 0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "host string, masked array<string>, blocked int, allowed int")
    purity = {r.masked[0]: r.purity for r in urls.templates(df).collect()}
    assert purity["a"] > 0.5 > purity["b"]


def test_warc(spark):
    html = "<html lang=\"en\"><head><title> A &amp; B </title><style>x{}</style></head><body><p>One&nbsp;two<br>three</p><script>no()</script><a href='x'>l</a></body></html>"
    rows = warc.derivatives(spark.createDataFrame([(1, "http://x", html, "t"), (2, None, None, "t")], "page_id long, url string, html string, text string")).collect()
    by = {(r.page_id, r.warc_type): r for r in rows}
    assert by[1, "conversion"].block == "One two\nthree\nl"
    assert "title: A & B" in by[1, "metadata"].block and by[1, "metadata"].refers_to == by[1, "conversion"].refers_to
    for r in rows:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert f"Content-Length: {len(r.block.encode())}".encode() in head and body == r.block.encode() + b"\r\n\r\n"


def test_warc_decodes_all_references(spark):
    from html import unescape

    raw = "&copy; 2024 &middot; &eacute;&#233;&#xE9; &notit; &copy 1 &#128; &#0; &#xD800; &NotEqualTilde; &amp;lt; &amp;copy; &unknown; & &; &hellip;&#39;"
    html = f"<html><head><title>T&amp;C&#10;{raw}</title></head><body><p>{raw}</p>a&nbsp;&#160; b</body></html>"
    rows = warc.derivatives(spark.createDataFrame([(1, "http://x", html)], "page_id long, url string, html string")).collect()
    by = {r.warc_type: r for r in rows}
    assert by["conversion"].block == unescape(raw) + "\na b"
    assert f"\r\ntitle: T&C {unescape(raw)}\r\n" in by["metadata"].block
    for r in rows:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert f"Content-Length: {len(r.block.encode())}".encode() in head and body == r.block.encode() + b"\r\n\r\n"
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()


def test_language_id(spark):
    rng = random.Random(2)
    kinds = {"en": ["the", "and", "of", "thing"], "fr": ["le", "être", "dans", "où"], "de": ["der", "und", "ß", "über"]}
    rows = [(i, " ".join(rng.choices(kinds[lang], k=30)), lang) for i, lang in enumerate(list(kinds) * 80)]
    df = spark.createDataFrame([*rows, (500, None, "en"), (501, "123 --", "en"), (502, "", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows)
    assert [found[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    kept = {r.doc_id for r in langid.keep_identified(df).collect()}
    assert kept == {i for i, _, _ in rows}


def test_language_id_rejects_with_few_documents(spark):
    """A rare language's documents stay, gibberish that is nearest to it goes; so does a language that nobody labelled."""
    rng = random.Random(6)
    kinds = {"en": (["the", "and", "of", "thing"], 120), "fr": (["le", "être", "dans", "où"], 60), "xx": (["zqa", "qazz", "zaq", "azq"], 14)}
    rows = [(lang, " ".join(rng.choices(w, k=40))) for lang, (w, n) in kinds.items() for _ in range(n)]
    junk = [(None, " ".join("".join(rng.choices("zqajxkwv", k=4)) for _ in range(40))) for _ in range(20)]
    junk += [(None, " ".join(rng.choices(["μια", "και", "δεν", "zaqi"], k=40))) for _ in range(10)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows + junk)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(found[i].lang_pred == lang and not found[i].rejected for i, (lang, _) in enumerate(rows))
    late = [found[i] for i in range(len(rows), len(rows + junk))]
    assert any(r.lang_pred == "xx" for r in late) and all(r.rejected for r in late)
    assert {r.doc_id for r in langid.keep_identified(df).collect()} == set(range(len(rows)))


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=40)) + "." if i % 5 else "SPAM!! " * 40, int(bool(i % 5))) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(found) == 402 and all(0 <= r.score <= 1 for r in found.values())
    assert sum(found[i].predicted == q for i, _, q in rows) >= 392
    assert quality.classify(docs, labels.limit(0)).first().score == 0.5


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_of_drifting_copies(spark, k, percent):
    """Copies of one passage that drift apart: frequent fingerprints, several
    components, links only between neighbours, and a passage that unrelated texts share."""
    draw = random.Random(11)
    passage, rows = [f"p{i}" for i in range(50)], []
    for group in range(3):
        words = [f"g{group}w{draw.randrange(500)}" for _ in range(draw.choice([60, 150, 300]))]
        for step in range(40):
            near = list(words)
            for _ in range(draw.randrange(6)):
                near[draw.randrange(len(near))] = f"n{draw.randrange(10**6)}"
            rows.append(" ".join(near))
            if step % 8 == 7:
                words[draw.randrange(len(words))] = f"d{step}"
    for i in range(30):
        rows.append(" ".join([*(f"o{draw.randrange(10**6)}" for _ in range(8)), *passage[: 40 + i % 11]]))
    draw.shuffle(rows)
    sets, root = [_sets(t, k) for t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    found = {r.doc_id: r.component_id for r in jaccard.join(_docs(spark, list(enumerate(rows))), k, percent).collect()}
    assert found == {i: top(i) for i in range(len(rows))}


def test_language_models_against_brute_force():
    """Interpolated Kneser-Ney by dictionaries of strings; after any context the probabilities of all characters sum to one."""
    import numpy as np

    texts = {"aa": ["aba cab", "abacus ab"], "bb": ["xyx aby", "yx xy漢字 漢"]}
    letters = sorted({c for t in texts.values() for x in t for c in x if c != " "})
    table = np.zeros(0x110000, np.uint16)
    table[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
    model = langid.Model(list(texts), table)
    counts = []
    for lang in texts:
        keys, n = np.unique(np.concatenate([langid.grams(langid.numbers(t, table), langid.ORDER) for t in texts[lang]]), return_counts=True)
        counts.append({"keys": keys, "n": n})
    model.fit(counts)
    alphabet = [0, 1, *range(2, len(letters) + 2)]

    def levels(lang):
        top = Counter()
        for t in texts[lang]:
            n = [0] * (langid.ORDER - 2) + [int(x) for x in langid.numbers(t, table)]
            top.update(tuple(n[i : i + langid.ORDER]) for i in range(len(n) - langid.ORDER + 1))
        found = {langid.ORDER: top}
        for order in range(langid.ORDER - 1, 0, -1):
            found[order] = Counter(g[1:] for g in found[order + 1])
        return found

    for i, lang in enumerate(texts):
        counted = levels(lang)

        def p(gram, counted=counted):
            if not gram:
                return 1 / langid.SPACE
            own = counted[len(gram)]
            once, twice = (sum(n == k for n in own.values()) for k in (1, 2))
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
            after = [n for g, n in own.items() if g[:-1] == gram[:-1]]
            if not after:
                return p(gram[1:])
            return max(0, own.get(gram, 0) - (d if gram in own else 0)) / sum(after) + d * len(after) / sum(after) * p(gram[1:])

        for context in [(0, 0, 0), (2, 3, 2), (5, 2, 0), (1, 1, 1), (3, 0, 2)]:
            codes = np.array([sum(c << 16 * (3 - k) for k, c in enumerate((*context, last))) for last in alphabet], np.uint64)
            got = np.exp(model.log_prob(codes)[:, i].astype(float))
            assert np.allclose(got, [p((*context, last)) for last in alphabet], rtol=1e-4)
            # numbers that no letter has are alike
            rest = np.exp(model.log_prob(codes[:1] | np.uint64(60_000))[0, i].astype(float))
            assert math.isclose(got.sum() + (langid.SPACE - len(alphabet)) * rest, 1, rel_tol=1e-4)


def test_language_id_of_a_large_alphabet(spark):
    """More letters than there are in two thousand, each with a number of its own."""
    rng = random.Random(8)
    low, high = [chr(0x4E00 + i) for i in range(1500)], [chr(0x4E00 + 1500 + i) for i in range(1500)]
    rows = [(i, "".join(rng.choices(low if i % 2 else high, k=400)), "lo" if i % 2 else "hi") for i in range(120)]
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1], None)], "doc_id long, text string, lang string")
    found = langid.identify(df).collect()
    assert len(found) == 122 and all(r.lang_pred == ("lo" if r.doc_id % 2 else "hi") for r in found if r.doc_id is not None)
    assert [r.lang_pred for r in found if r.doc_id is None] == ["hi"]


def test_quality_risk_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (90, 3))

    def unlabelled(w):
        return float(np.mean([math.log1p(math.exp(x @ w)) for x in u])), sum(x / (1 + math.exp(-(x @ w))) for x in u) / len(u)

    def brute(w, prior):
        plus = sum(math.log1p(math.exp(-(x @ w))) for x in p) / len(p)
        rest = sum(math.log1p(math.exp(x @ w)) for x in u) / len(u) - prior * sum(math.log1p(math.exp(x @ w)) for x in p) / len(p)
        return prior * plus + max(0.0, rest) + quality.DECAY / 2 * (w @ w)

    for prior, w in ((0.3, rng.normal(0, 1, 3)), (0.9, np.array([4.0, 4.0, 4.0])), (0.5, np.zeros(3))):
        value, gradient = quality.risk(w, p, prior, unlabelled)
        assert math.isclose(value, brute(w, prior), rel_tol=1e-9)
        for i in range(3):
            e = np.eye(3)[i] * 1e-6
            assert math.isclose(gradient[i], (brute(w + e, prior) - brute(w - e, prior)) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)
    best = quality.minimise(lambda w: quality.risk(w, p, 0.4, unlabelled), 3, 200)
    for _ in range(200):
        assert brute(best, 0.4) <= brute(best + rng.normal(0, 0.05, 3), 0.4) + 1e-9


def test_quality_prior():
    """Half of the unlabelled are like the positives, half never score as high."""
    import numpy as np

    positive, unlabelled = np.zeros(100), np.zeros(100)
    positive[50:] = 20
    unlabelled[50:], unlabelled[:50] = 2000, 2000
    assert math.isclose(quality.prior_of(positive, unlabelled), 0.5, abs_tol=0.02)


def test_quality_of_repeated_rows_and_nulls(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS, k=40)) + "." if i % 5 else "SPAM!! " * 40) for i in range(200)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (None, rows[3][1]), (999, "x " * 300_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(bool(i % 5))) for i in range(200)] + [(3, 1), (None, 1), (7, None)], "doc_id long, quality int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 204 and len({r.score for r in found if r.doc_id in (3, None)}) == 1
    kept = quality.keep_good(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in found if r.predicted)


def test_url_templates_against_brute_force(spark):
    """The tree by dictionaries: hosts that mix labels, a shared ``*``, deep paths, hosts without labels."""
    rng = random.Random(12)
    rows = []
    for host in ("a.net", "b.net", "c.org", "d.org"):
        for _ in range(150):
            path = [rng.choice(["es", "fr", "de", "*", "x", "y"])] + [rng.choice(["*", "p", "q", f"k{rng.randrange(40)}"]) for _ in range(rng.randrange(9))]
            known = host.endswith("net") and rng.random() < 0.6
            blocked = int(known and path[0] in ("es", "fr"))
            rows.append((host, path, blocked, int(known and not blocked)))
    rows += [("a.net", [], 0, 0), ("", [], 0, 0), ("a.net", ["deep"] * 30 + ["end"], 1, 0), ("a.net", ["deep"] * 30 + ["other"], 0, 1)]
    base = {}
    for host, path, blocked, allowed in rows:
        found = base.setdefault((host, tuple(path)), [0, 0, 0])
        found[0] += 1
        found[1] += blocked
        found[2] += blocked + allowed
    t = {k: k[1] for k in base}
    for level in range(1, 40):
        child, new = {}, dict(t)
        for k, path in t.items():
            if len(path) >= level:
                sums = child.setdefault((k[0], path[: level - 1]), {}).setdefault(path[level - 1], [0, 0, 0])
                for i in range(3):
                    sums[i] += base[k][i]
        for k, path in t.items():
            if len(path) < level or path[level - 1].startswith("*"):
                continue
            kids = {s: v for s, v in child[k[0], path[: level - 1]].items() if not s.startswith("*")}
            n, b, lab = kids[path[level - 1]]
            urls_, all_b, all_l = (sum(v[i] for v in kids.values()) for i in range(3))
            wild = None
            if len(kids) >= urls.MIN_CHILDREN and urls_ < urls.FEW_URLS * len(kids):
                wild = "*"
            elif 0 < lab < all_l:
                share = all_b / all_l
                spread = math.sqrt(share * (1 - share) * (1 / lab + 1 / (all_l - lab)))
                if spread == 0 or abs(b / lab - (all_b - b) / (all_l - lab)) / spread < urls.Z_SAME:
                    wild = urls.MERGED
            if wild:
                new[k] = (*path[: level - 1], wild, *path[level:])
        t = new
    by_host, everywhere, w = {}, {}, urls.PRIOR_WEIGHT
    for k, path in t.items():
        for table, key in ((by_host, (k[0], path)), (everywhere, path)):
            sums = table.setdefault(key, [0, 0])
            sums[0] += base[k][1]
            sums[1] += base[k][2]
    total = (sum(v[1] for v in base.values()) + w * urls.PRIOR_BLOCKED) / (sum(v[2] for v in base.values()) + w)
    want = {}
    for k, path in t.items():
        b, lab = everywhere[path]
        prior = (b + w * total) / (lab + w)
        b, lab = by_host[k[0], path]
        want[k] = ("/" + "/".join(path), round((b + w * prior) / (lab + w), 9))
    df = spark.createDataFrame(rows, "host string, masked array<string>, blocked int, allowed int")
    assert {(r.host, tuple(r.masked)): (r.template, round(r.purity, 9)) for r in urls.templates(df).collect()} == want


def test_url_keys_are_not_merged_with_names(spark):
    """Blocked branches that are alike don't take unrelated numeric paths with them."""
    pages = [f"http://x.net/{a}/{i}" for a in ("es", "fr") for i in range(6)] + [f"http://x.net/{i}/{i}" for i in range(6)] + [f"http://com.com/{i}/{i}" for i in range(6)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*pages, pages[0], None])], "page_id long, url string")
    found = urls.judge(df).collect()
    assert len(found) == 26
    assert {r.verdict for r in found if r.host == "x.net" and r.path[1].isdigit()} == {"allow"}
    assert {r.verdict for r in found if r.host == "x.net" and not r.path[1].isdigit()} == {"block"}


def test_warc_refers_to_the_response(spark):
    rows = [(1, "http://x/a\r\nX-Evil: 1", "<p>a</p>"), (2, None, None), (2, None, None), (None, "http://y", "<p>b</p>" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    sources = {r.record_id: r for r in warc.responses(df).collect()}
    derived = warc.derivatives(df).collect()
    assert len(derived) == 8 and {r.refers_to for r in derived} == set(sources)
    for r in [*derived, *sources.values()]:
        head = bytes(r.record).split(b"\r\n\r\n")[0].decode().split("\r\n")
        assert head[0] == "WARC/1.1" and all(": " in line or line.endswith(":") for line in head[1:]) and not any(x.startswith("X-Evil") for x in head)
        if r.refers_to:
            assert r.source_digest == sources[r.refers_to].payload_digest
    texts = {r.target_uri: r for r in derived if r.warc_type == "conversion"}
    assert texts["http://y"].block == "\n".join("b" * 50_000)


def test_jaccard_of_ids_with_several_texts(spark):
    """A document that has several texts ties the groups of all of them, whichever of them it represents."""
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "pqrs"]
    rows = [(9, texts[0]), (5, texts[0]), (9, texts[1]), (9, texts[2]), (12, texts[2]), (20, texts[3]), (21, texts[3]), (21, texts[3])]
    found = {(r.doc_id, r.component_id) for r in jaccard.join(_docs(spark, rows), 3, 90).collect()}
    assert found == {(9, 5), (5, 5), (12, 5), (20, 20), (21, 20)}


def test_no_word_is_lost_beyond_the_top(spark, monkeypatch):
    """Words beyond TOP get their counts by a join: the same totals, known words and scores of the base."""
    monkeypatch.setattr(lm, "ALONE", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 30))) for i in range(40)], "doc_id long, text string")
    found = []
    for top in (3, 100_000):
        monkeypatch.setattr(lm, "TOP", top)
        found.append({r.doc_id: (r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9)) for r in lm.class_lm(docs).collect()})
    assert found[0] == found[1] and len(found[0]) == 40


def test_pairs_of_blocks_are_compared_in_rounds(spark, monkeypatch):
    """What is shuffled at once is a multiple of the blocks, and the links are those of one round."""
    monkeypatch.setattr(jaccard, "ROUND", 0)
    texts = [" ".join(f"w{i // 3}x{j}" if j % 12 else f"v{i}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = jaccard.marked(docs, 3, 50).select(F.col("doc_id").alias("id"), "n", "s1", "s2")
    groups = spark.createDataFrame([(i, 0, None) for i in range(60)], "id long, group long, linked long")
    found = []
    for least in (1 << 26, 8_000):
        monkeypatch.setattr(jaccard, "LEAST", least)
        asked, real = [], jaccard._rounds
        monkeypatch.setattr(jaccard, "_rounds", lambda b, p, real=real: asked.append(real(b, p)) or asked[-1])
        links = jaccard._common_links(docs, sets, jaccard.cut(groups), 3, 50)
        found.append((asked[0], {tuple(r) for r in jaccard.components(links).collect()}))
        monkeypatch.setattr(jaccard, "_rounds", real)
    assert found[0][0] == 1 < found[1][0] and found[0][1] == found[1][1] and found[0][1]
