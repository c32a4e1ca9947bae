"""N-gram Jaccard join by vertical partitioning.

A document is the set of its distinct word shingles, as 64-bit hashes; their
global order is that of the hashes, which deals shingles out evenly however
often they occur. Fragments are ranges of that order, segments a set's part in them.

1. Documents with equal sets form a class; one of them, the smallest id, stands for it.
2. Two linked sets differ in D shingles at most, which their sizes tell. If the
   order is cut into D + SPARE fragments, SPARE segments at least are equal in
   both, whichever shingles differ. So classes meet by fingerprints of whole
   segments: shingles or passages that many documents share bring nobody
   together, as others stand beside them in their segments. The cut is by band of
   sizes; a set has fingerprints for its band, and for the next one if a partner
   can be there. One shuffle sorts them by fingerprint; a task then reads runs of
   equal ones and holds a few rows only, whatever a run's length. A fingerprint
   that occurs often within a few thousand documents is summed up to one row for
   them before it is shuffled.
3. Fingerprints of RARE classes at most give pairs, which stay if enough of them
   are shared. Those of more classes tie each of these to one of them, the hub.
   Pairs are verified by FRAGMENTS coarse fragments: the partial overlaps are
   counted separately and summed per pair, which gives the exact overlap.
4. Classes that a frequent fingerprint ties, but the links found so far leave in
   several components, are compared block by block, without pairs of blocks
   within one component: overlaps of each fragment are products of incidence
   matrices, summed, and a spanning forest is returned.

So every pair that can link is checked, or is connected by other links, whatever
its group's size, while rows grow with the input. Nothing that grows with the
input is sent to the driver or to all executors. Texts are read three times
(classes, fingerprints, segments of the candidates), in batches bounded by bytes,
so that a few long texts fill one as many short ones do.

Defined cases: null or blank text is an empty set and links with nothing; fewer
words than a shingle has are one shingle, the whole sequence; rows with equal
ids count as one document, so their components are one; a row with a null id
links with nothing and has a null component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, meet_all, small_batches
from .neardup import _roots

WORDS, PERCENT = 3, 90
RARE, FRAGMENTS, MEMBERS, BLOCK = 8, 4, 256, 256
#: Sizes of a band go up to STRETCH times its least one: more bands cost more sets
#: of fingerprints, wider ones longer sets; the sum is least from 1.5 to 1.7.
STRETCH = 1.6
#: Of the pairs of blocks compared at once: shuffled bytes as a multiple of the blocks', and bytes that are always allowed.
ROUND, LEAST = 3, 1 << 26
#: Word hashes that a task keeps at hand, and fingerprints that it sums up at once.
HELD, CHUNK = 200_000, 500_000
#: Low bits of a fingerprint that tell its band.
BAND_BITS = 6

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), 1)], np.uint64)
    a = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = len(a) - words + 1
    h = _mix(a[:n] + _C)
    for i in range(1, words):
        h = _mix(h + a[i : i + n] * _C)
    return np.unique(h)


def bands(percent: int) -> np.ndarray:
    """The least size of each band: a set's partners are in its band and the two beside it."""
    found = [1]
    while found[-1] < 1 << 40:
        found.append(max(found[-1] * 100 // percent + 1, int(found[-1] * STRETCH)))
    if len(found) > 1 << BAND_BITS:
        raise ValueError("the similarity needs more bands than fingerprints can tell")
    return np.array(found, np.int64)


def _cuts(band: int, least: np.ndarray, percent: int) -> tuple[int, int]:
    """Into how many fragments a band cuts the order, and how many segments are equal at least."""
    differ = int(2 * (least[band + 1] - 1) * (100 - percent) // (100 + percent))
    if not differ:  # equal sets only
        return 0, 0
    spare = 2 + differ // 8
    return differ + spare, spare


def _places(h: np.ndarray, cuts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(cuts)) >> np.uint64(32)


def needed(h: np.ndarray, band: int, least: np.ndarray, percent: int) -> int:
    """How many fingerprints for ``band`` any linked set shares at least, and how many
    shingles they differ in, in sum, if the larger of both is in that band: of
    two sets that can't differ in so many, more fingerprints are shared.

    Empty segments have no fingerprint, as long as fewer than ``spare`` are empty;
    else they have (a need below 1 tells), and a partner with which only empty
    segments are shared has as many, and theirs, too."""
    cuts, spare = _cuts(band, least, percent)
    return max(1, spare - (cuts - len(np.unique(_places(h, cuts))))) + cuts - spare if cuts else 1


def fingerprints(h: np.ndarray, band: int, least: np.ndarray, percent: int) -> np.ndarray:
    """Those of a set's segments as cut for ``band``, which their low bits tell."""
    cuts, spare = _cuts(band, least, percent)
    if not cuts:
        return np.empty(0, np.uint64)
    ends = np.searchsorted(_places(h, cuts), np.arange(cuts + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h), dtype=np.uint64)])
    marks = _mix(sums[ends[1:]] - sums[ends[:-1]] + _mix(np.arange(cuts, dtype=np.uint64) + np.uint64(band << 40)) * _C)
    marks = (marks >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | np.uint64(band)
    filled = ends[1:] > ends[:-1]
    return marks[filled] if spare > cuts - filled.sum() else marks


def _signature(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(h.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _band(n: int, least: np.ndarray, percent: int) -> tuple[int, bool]:
    """A size's band, and whether a larger partner can be in the next one."""
    band = int(np.searchsorted(least, n, "right")) - 1
    return band, n * 100 // percent >= least[band + 1]


def marked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, s1, s2 (the set's signature), band, need, need_next (of its fingerprints for its band and the next) of each row."""
    least = bands(percent)
    names = ["doc_id", "n", "s1", "s2", "band", "need", "need_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                h = shingles(text.as_py(), words, hashes)
                band = need = need_next = 0
                if len(h):
                    band, more = _band(len(h), least, percent)
                    need, need_next = needed(h, band, least, percent), needed(h, band + 1, least, percent) if more else 0
                rows.append((len(h), *_signature(h), band, need, need_next))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 6)]
            yield pa.record_batch([batch.column(0), *columns], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """token, c, hub: a set's fingerprints, c being the set's signature.

    Of a fingerprint that more than RARE sets of a chunk of documents have, one
    row stays, with its own c as hub; the others become rows (c, hub) that only
    pass through, with a token of their own so that they spread."""
    least = bands(percent)

    def summed(marks: list[np.ndarray], sets: list[int]) -> pa.RecordBatch:
        token = np.concatenate(marks)
        c = np.repeat(np.array(sets, np.int64), [len(m) for m in marks])
        order = np.lexsort((c, token))
        token, c = token[order], c[order]
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        often = np.repeat(size > RARE, size)
        hub = np.repeat(c[start], size)
        # the band stays readable in the low bits
        spread = (_mix(c.view(np.uint64) ^ token) >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS)) | (token & np.uint64((1 << BAND_BITS) - 1))
        token = np.where(often & (c != hub), spread, token)
        return pa.record_batch([pa.array(token.view(np.int64)), pa.array(c), pa.array(hub, mask=~often)], ["token", "c", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        marks, sets, seen, room = [], [], set(), 0
        for batch in batches:
            for text in batch.column(0):
                h = shingles(text.as_py(), words, hashes)
                if not len(h) or (c := _signature(h)[0]) in seen:
                    continue
                seen.add(c)
                band, more = _band(len(h), least, percent)
                for at in (band, band + 1)[: 1 + more]:
                    own = fingerprints(h, at, least, percent)
                    marks.append(own)
                    sets.append(c)
                    room += len(own)
                if room > CHUNK:
                    yield summed(marks, sets)
                    marks, sets, seen, room = [], [], set(), 0
        if room:
            yield summed(marks, sets)

    return docs.filter("doc_id is not null").select("text").mapInArrow(run, "token long, c long, hub long")


SELF, PAIR, TIE = 0, 1, 2


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, band, kind from rows sorted by token and c: of each fingerprint that
    several sets have, a row for each of them (SELF) and either its pairs or each
    one's tie to the first. Of a run that goes on in the next batch RARE rows are
    kept at most, or its hub."""
    mask = np.int64((1 << BAND_BITS) - 1)
    token, c = np.empty(0, np.int64), np.empty(0, np.int64)
    common, old = np.empty(0, bool), np.empty(0, bool)

    def rows(a: np.ndarray, b: np.ndarray, token: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b), pa.array((token & mask).astype(np.int32)), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "band", "kind"])

    def found(token: np.ndarray, c: np.ndarray, common: np.ndarray, old: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole runs, or of one that is known to be common; ``old`` rows have their SELF row."""
        start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.r_[start, len(token)])
        often = np.logical_or.reduceat(common, start) | (size > RARE)
        own = np.repeat(often | (size > 1), size) & ~old
        yield rows(c[own], c[own], token[own], SELF)
        hub, tied = np.repeat(c[start], size), np.repeat(often, size)
        tied &= c != hub
        yield rows(hub[tied], c[tied], token[tied], TIE)
        for n in range(2, RARE + 1):
            at = start[(size == n) & ~often]
            if len(at):
                i, j = np.triu_indices(n, 1)
                first, second = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                yield rows(c[first], c[second], token[first], PAIR)

    for batch in batches:
        if not batch.num_rows:
            continue
        new_token, new_c = (batch.column(i).to_numpy() for i in (0, 1))
        hub = batch.column(2).fill_null(0).to_numpy()
        has = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        tie = has & (hub != new_c)
        if tie.any():
            yield rows(hub[tie], new_c[tie], new_token[tie], TIE)
            yield rows(new_c[tie], new_c[tie], new_token[tie], SELF)
            new_token, new_c, has = new_token[~tie], new_c[~tie], has[~tie]
            if not len(new_token):
                continue
        token, c = np.concatenate([token, new_token]), np.concatenate([c, new_c])
        common, old = np.concatenate([common, has]), np.concatenate([old, np.zeros(len(has), bool)])
        # copies in several tasks have equal rows, one of which may tell that the fingerprint is common
        first = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (c[1:] != c[:-1])])
        common, old = np.logical_or.reduceat(common, first), np.logical_or.reduceat(old, first)
        token, c = token[first], c[first]
        last = int(np.flatnonzero(token == token[-1])[0])
        if last:
            yield from found(token[:last], c[:last], common[:last], old[:last])
            token, c, common, old = token[last:], c[last:], common[last:], old[last:]
        if len(token) > RARE:
            yield from found(token, c, np.ones(len(c), bool), old)
            token, c, common, old = token[:1], c[:1], np.ones(1, bool), np.ones(1, bool)
    if len(token):
        yield from found(token, c, common, old)


def _candidates(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) of classes to compare, and (id, component) of the groups that frequent fingerprints tie."""
    rows = _tokens(texts, words, percent).repartition("token").sortWithinPartitions("token", "c")
    with small_batches(texts.sparkSession, 100_000):
        met = cut(rows.mapInArrow(_met, "a long, b long, band int, kind int").groupBy("a", "b", "band", "kind").agg(F.count(F.lit(1)).alias("met")))

    def of(side: str) -> DataFrame:
        return classes.select(F.col("s1").alias(side), F.col("id").alias(f"id_{side}"), F.col("n").alias(f"n_{side}"), *[F.col(x).alias(f"{x}_{side}") for x in ("band", "need", "need_next")])

    def need(side: str) -> Column:
        return F.when(F.col("band") == F.col(f"band_{side}"), F.col(f"need_{side}")).otherwise(F.col(f"need_next_{side}"))

    def differ(both: Column) -> Column:
        return F.floor(both * (100 - percent) / (100 + percent))

    sizes = (F.col("n_a") * percent <= F.col("n_b") * 100) & (F.col("n_b") * percent <= F.col("n_a") * 100)
    tops = F.array(*[F.lit(int(n) - 1) for n in bands(percent)[1:]])
    partner = F.least(F.expr(f"n_a * 100 div {percent}"), F.element_at(tops, F.col("band") + 1))
    own = met.filter(F.col("kind") == SELF).select("a", "band", "met").join(of("a"), "a")
    enough = own.filter(F.col("met") >= need("a") - differ(F.col("n_a") + partner)).select(F.col("a").alias("b"), "band")
    pairs = met.filter(F.col("kind") == PAIR).join(of("a"), "a").join(of("b"), "b")
    larger = F.when(F.col("n_a") >= F.col("n_b"), F.col("band_a")).otherwise(F.col("band_b"))
    pairs = pairs.filter(sizes & (larger == F.col("band")) & (F.col("met") >= F.greatest(need("a"), need("b")) - differ(F.col("n_a") + F.col("n_b"))))
    tied = met.filter(F.col("kind") == TIE).select("a", "b", "band").join(enough, ["b", "band"], "left_semi").select("a", "b").distinct()
    ties = cut(tied.join(of("a"), "a").join(of("b"), "b").select("id_a", "id_b", sizes.alias("near")))
    near = ties.filter("near").select("id_a", "id_b").union(pairs.select("id_a", "id_b"))
    found = cut(near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).filter("a <> b").distinct())
    groups = cut(components(ties, "id_a", "id_b"))
    discard(met, ties)
    return found, groups


def _asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, s1, s2, the further columns of ``wanted`` and text of the wanted classes (id, s1, s2, further)."""
    return docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select("id", "s1", "s2", *[c for c in wanted.columns if c not in ("id", "s1", "s2")], "text")


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sets share: partial overlaps are counted in each
    fragment of the order and summed."""
    cuts = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)
    both = 0
    for x, y in zip(np.split(a, np.searchsorted(a, cuts)), np.split(b, np.searchsorted(b, cuts)), strict=True):
        if len(x) and len(y):
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            both += int((x[at] == y).sum())
    return both


def _compared(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links of a star's members with its centre, from texts sorted by star and
    place; only the centre's set is held. Repeated rows count once."""
    hashes, at, centres, before = _Hashes(), None, [], None
    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("key", "salt", "place", "id", "s1", "s2"))
        for *here, place, key, s1, s2, text in zip(*columns, batch.column("text"), strict=True):
            if here != at:
                at, centres, before = here, [], None
            if before == (place, key, s1, s2):
                continue
            h = shingles(text.as_py(), words, hashes)
            if _signature(h) != (s1, s2):  # another text of the id
                continue
            before = place, key, s1, s2
            if not place:
                centres.append((key, h))
                continue
            for other, centre in centres:
                both = _overlap(centre, h)
                if both * 100 >= (len(centre) + len(h) - both) * percent:
                    rows.append((other, key))
        yield pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 2)], ["a", "b"])


def _verified(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) that link. The pairs of an a form stars of
    about MEMBERS members. A text goes to its star as it is, as it takes less room than its set."""
    sizes = pairs.groupBy(F.col("a").alias("u")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("m"))
    dealt = meet_all(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), sizes)
    members = cut(dealt.select(F.col("v").alias("id"), F.col("u").alias("key"), F.pmod(F.xxhash64("v"), F.col("m")).alias("salt"), F.lit(1).alias("place")))
    centres = members.select(F.col("key").alias("id"), "key", "salt", F.lit(0).alias("place")).distinct()
    wanted = classes.select("id", "s1", "s2").join(members.union(centres), "id")
    rows = _asked(texts, wanted).repartition("key", "salt").sortWithinPartitions("key", "salt", "place", "id", "s1", "s2")
    with small_batches(texts.sparkSession):
        links = cut(rows.mapInArrow(lambda it: _compared(it, words, percent), "a long, b long"))
    discard(members)
    return links


def _links(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links that connect all that the links among ``pairs`` do: each class is
    compared with its least partner first, then pairs that are still apart."""
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = _verified(texts, classes, first, words, percent)
    known = components(links)
    apart = pairs.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        apart = apart.join(known.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    apart = cut(apart.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
    more = _verified(texts, classes, apart, words, percent)
    discard(apart)
    return links.union(more)


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Runs of sets of one group and linked component, sorted by size, become blocks; repeated rows count once."""
    names = ["block", "group", "linked", "low", "high", "ids", "sizes", "ends", "hashes"]
    types = [*[pa.int64()] * 5, *[pa.binary()] * 4]

    def block(at: tuple, held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(h[1]) for h in held]
        values = [held[0][2], *at, sizes[0], sizes[-1], np.array([h[0] for h in held], np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.cumsum(sizes).astype(np.int64).tobytes(), np.concatenate([h[1] for h in held]).tobytes()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    hashes, at, held, room, before = _Hashes(), None, [], 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("group", "linked", "id", "s1", "s2", "name")]
        for group, linked, key, s1, s2, name, text in zip(*columns, batch.column("text"), strict=True):
            if before == (group, key, s1, s2):
                continue
            h = shingles(text.as_py(), words, hashes)
            if _signature(h) != (s1, s2):  # another text of the id
                continue
            before = group, key, s1, s2
            if held and ((group, linked) != at or len(held) == BLOCK or room > 4_000_000):
                yield block(at, held)
                held, room = [], 0
            at = group, linked
            held.append((key, h, name))
            room += len(h)
    if held:
        yield block(at, held)


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    def unpack(row: dict, end: str) -> tuple:
        ids, sizes, ends, hashes = (np.frombuffer(row[f"{c}{end}"], np.int64) for c in ("ids", "sizes", "ends", "hashes"))
        return ids, sizes, np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0)), hashes.view(np.uint64)

    for batch in batches:
        for row in batch.to_pylist():
            (ia, na, ra, ha), (ib, nb, rb, hb) = unpack(row, ""), unpack(row, "2")
            both = np.zeros((len(ia), len(ib)), np.float32)
            shift = np.uint64(62)  # FRAGMENTS ranges of hashes
            for f in range(FRAGMENTS):
                xa, xb = (ha >> shift) == f, (hb >> shift) == f
                common = np.intersect1d(ha[xa], hb[xb])
                for lo in range(0, len(common), 4096):
                    part = common[lo : lo + 4096]
                    left, right = np.zeros((len(ia), len(part)), np.float32), np.zeros((len(ib), len(part)), np.float32)
                    for matrix, rows, h in ((left, ra[xa], ha[xa]), (right, rb[xb], hb[xb])):
                        at = np.searchsorted(part, h)
                        at[at == len(part)] = 0
                        fits = part[at] == h
                        matrix[rows[fits], at[fits]] = 1
                    both += left @ right.T
            both = both.astype(np.int64)
            i, j = np.nonzero(both * 100 >= (na[:, None] + nb[None, :] - both) * percent)
            if row["block"] == row["block2"]:
                i, j = i[i < j], j[i < j]
            if len(i):
                ids = np.concatenate([ia, ib])
                root = _roots(len(ids), i, j + len(ia))
                met = np.flatnonzero(root != np.arange(len(ids)))
                yield pa.record_batch([pa.array(ids[root[met]]), pa.array(ids[met])], ["a", "b"])


def _open_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """id, group, linked of the groups that ``links`` leave in several components.
    linked: that component if it fills a block of the group, else null."""
    known = groups.select("id", F.col("component").alias("group")).join(components(links), "id", "left").select("id", "group", F.coalesce("component", "id").alias("linked"))
    known = cut(known)
    counted = known.groupBy("group", "linked").agg(F.count(F.lit(1)).alias("members"))
    several = counted.groupBy("group").agg(F.count(F.lit(1)).alias("of")).filter("of > 1").select("group")
    large = counted.filter(F.col("members") >= BLOCK).select("group", "linked", F.lit(True).alias("fills"))
    open_ = cut(known.join(several, "group", "left_semi").join(large, ["group", "linked"], "left").select("id", "group", F.when(F.col("fills"), F.col("linked")).alias("linked")))
    discard(known)
    return open_


def _rounds(blocks: DataFrame, pairs: DataFrame) -> int:
    """In how many rounds the pairs of blocks are compared. Blocks are shuffled once for each pair,
    which grows with the square of a group; what one round shuffles, and deletes when
    it ends, is ROUND times the blocks themselves, or LEAST bytes."""
    size, asked = (df.agg(F.coalesce(F.sum("octets"), F.lit(0))).first()[0] for df in (blocks, pairs))
    return max(1, -(-asked // max(ROUND * size, LEAST)))


def _common_links(texts: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    whole = _asked(texts, classes.select("id", "s1", "s2", "n").join(groups, "id")).withColumn("name", F.xxhash64("group", "id", "s1", "s2"))
    order = ["group", "linked", "n", "id", "s1", "s2"]
    placed = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    with small_batches(texts.sparkSession):
        blocks = cut(placed.mapInArrow(lambda it: _blocks(it, words), "block long, group long, linked long, low long, high long, ids binary, sizes binary, ends binary, hashes binary"))
    octets = F.length("ids") + F.length("sizes") + F.length("ends") + F.length("hashes")
    here = cut(blocks.select("group", "block", "linked", "low", "high", octets.cast("long").alias("octets")))
    there = here.select("group", *[F.col(c).alias(f"{c}2") for c in ("block", "linked", "low", "high", "octets")])
    within = F.coalesce(F.col("linked") == F.col("linked2"), F.lit(False))
    pairs = here.join(there, "group").filter("block <= block2").filter(~within)
    pairs = cut(pairs.filter((F.col("low2") * percent <= F.col("high") * 100) & (F.col("low") * percent <= F.col("high2") * 100)).select("block", "block2", (F.col("octets") + F.col("octets2")).alias("octets")))
    full = ["ids", "sizes", "ends", "hashes"]
    left = blocks.select("block", *full)
    right = blocks.select(F.col("block").alias("block2"), *[F.col(c).alias(f"{c}2") for c in full])
    found = []
    rounds = _rounds(here, pairs)
    for i in range(rounds):
        some = pairs.filter(F.pmod(F.xxhash64("block", "block2"), F.lit(rounds)) == i).select("block", "block2")
        with small_batches(texts.sparkSession, 2):
            found.append(cut(some.join(left, "block").join(right, "block2").mapInArrow(lambda it: _block_links(it, percent), "a long, b long")))
    whole = found[0]
    for links in found[1:]:
        whole = whole.union(links)
    whole = cut(whole)
    discard(blocks, groups, here, pairs, *found)
    return whole


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with small_batches(spark):
        heads = cut(marked(texts, words, percent))
    kept = ["n", "band", "need", "need_next"]
    classes = cut(heads.filter("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in kept]))
    with small_batches(spark):
        pairs, groups = _candidates(texts, classes, words, percent)
    with small_batches(spark):
        links = cut(_links(texts, classes, pairs, words, percent))
    blocks = _common_links(texts, classes, _open_groups(groups, links), words, percent)
    # one document may stand for several sets, or for one while it copies another, if its id is repeated
    member = heads.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "id"), ["s1", "s2"], "left")
    member = member.withColumn("id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id")))
    sets = member.filter("id is not null").select("doc_id", "id").distinct()
    tied = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets"), F.min("id").alias("least")).filter("sets > 1")
    extra = sets.join(tied, "doc_id").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = components(links.union(blocks).union(extra))
    discard(pairs, groups, links, blocks)
    return (
        member.join(found, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller id; of
    repeated rows of an id, the one of the least text (then the least hash of
    all columns). Rows without id stay."""
    first = join(docs, words, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*names).alias("row"))
    kept = whole.filter("_id is not null").join(first, "_id", "left_semi")
    plain = [F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    kept = kept.groupBy("_id").agg(F.min_by("row", F.struct("row.text", F.xxhash64(*plain))).alias("row"))
    return kept.select("row.*").union(whole.filter("_id is null").select("row.*"))
