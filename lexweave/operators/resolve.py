"""Resolution of mentions against the registers.

Direct matches are joins of distinct references with the registers' indexes, whose
size is known, so that small ones are broadcast from the start. Fuzzy scores are
computed once for each distinct title or name that nothing else resolves. Documents
without back-references end there. For the others, citations are shuffled by document
and read in order, with a state of a few works: time grows with their number, memory
with the distinct years and short forms of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions import fixed
from ..functions.similarity import name_agreement, round4, similarity
from ..functions.text import alias_key, empty, let, name_key, report_key, title_key, title_stem
from ..sources.registry import CASE, WORK, Registers, case_id
from ..sources.storage import Held, kept
from .cases import neutral_text, report_text
from .fuzzy import close
from .links import case_search, held_by_primary, judgment_link, labels, work_links
from .remote import Remote, answers
from .works import PROVISION

CANDIDATE = "struct<id:string,score:double>"
MATCH = f"struct<work:{WORK},confidence:double,method:string,candidates:array<{CANDIDATE}>,notes:array<string>>"
CASE_MATCH = f"struct<case:{CASE},confidence:double,method:string,candidates:array<{CANDIDATE}>,notes:array<string>>"


@dataclass(frozen=True)
class Settings:
    accept: float = fixed.ACCEPT
    suggest: float = fixed.SUGGEST
    version: tuple[str, str | None] = ("latest", None)
    link_cases: bool = True
    #: asked for titles that the registers don't have
    remote: Remote | None = None


def _strings(*texts: str | Column) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts]).cast("array<string>")


def match(work: Column | None, confidence: float | Column, method: str, notes: Column | None = None, candidates: Column | None = None, kind: str = MATCH) -> Column:
    score = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        (work if work is not None else F.lit(None).cast(WORK if kind == MATCH else CASE)).alias("w"), score.alias("c"), F.lit(method).alias("m"),
        (candidates if candidates is not None else empty(f"array<{CANDIDATE}>")).alias("d"), (notes if notes is not None else empty("array<string>")).alias("n"),
    ).cast(kind)


def inferred_type(title: Column, year: Column) -> Column:
    t = F.lower(title)
    last = F.try_element_at(F.split(F.trim(F.regexp_replace(t, r"\.+$", "")), r"(?U)\s+"), F.lit(-1))
    secondary, y = last.isin(*fixed.SECONDARY_NOUNS), F.coalesce(year, F.lit(0))
    return (
        F.when(title.isNull() | (title == ""), "ukpga")
        .when(t.contains("(scotland)"), F.when(secondary, "ssi").when(y >= 1999, "asp").otherwise("ukpga"))
        .when(t.contains("(northern ireland)"), F.when(secondary, "nisr").when(y >= 2000, "nia").otherwise("ukpga"))
        .when(t.contains("(wales)") | t.contains("(cymru)"), F.when(secondary, "wsi").when(y >= 2020, "asc").when(y >= 2012, "anaw").otherwise("ukpga"))
        .when(t.contains("measure"), "ukcm")
        .otherwise(F.when(secondary, "uksi").otherwise("ukpga"))
    )


def search_works(probes: DataFrame, registers: Registers, cutoff: float = fixed.SEARCH_CUTOFF, limit: int = fixed.SEARCH_LIMIT) -> DataFrame:
    """probes(norm, year) with ``found``: the best works as array of (score, work).
    Works of the year come first; the others, at a penalty, only if none of them passes."""
    asked = probes.filter("norm <> ''").select(F.col("norm").alias("key"), F.col("year").cast("int").alias("year")).distinct()
    titles = registers.titles if limit <= fixed.SEARCH_LIMIT else registers.titles_of(limit)
    scored = close(asked, titles, cutoff, fixed.CROSS_YEAR)
    works = registers.works.select(F.col("ord").alias("ref"), "work")
    order = [F.desc("same"), F.desc("score"), F.desc("work.year"), "work.title", "ref"]
    # at most ``limit`` rows of a probe leave a task
    top = scored.join(works, "ref").withColumn("place", F.row_number().over(Window.partitionBy("key", "year").orderBy(*order))).filter(F.col("place") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("place", "same", "score", "work")))
    found = top.groupBy("key", "year").agg(rows.alias("rows"))
    best = F.filter("rows", lambda r: r["same"] == F.get("rows", 0)["same"])
    return found.select(F.col("key").alias("norm"), "year", F.transform(best, lambda r: F.struct(r["score"].alias("score"), r["work"].alias("work"))).alias("found"))


def _looked_up(rows: DataFrame, asking: DataFrame, registers: Registers, kind: str, name: str, key: str | None, year: str | None, asks: Column) -> DataFrame:
    """``rows`` with (n, works) as ``name``, if they ask: what the index has for their key and year.
    Each key that ``asking`` (the rows, before other look-ups) asks for meets the index once, which
    is dealt over the register's parts; only what it has meets the rows."""
    on = [(c, k) for c, k in ((key, "_k"), (year, "_y")) if c]
    asked = asking.filter(asks).select(*[F.col(c).alias(k) for c, k in on]).distinct()
    index = registers.work_index(kind)
    index = index.select(*[F.col(c).alias(k) for c, k in (("key", "_k"), ("year", "_y")) if k in {k for _, k in on}], F.struct("n", "works").alias(name))
    index = index.repartition(registers.parts, *[k for _, k in on]) if registers.parts > 1 else index
    found = asked.join(index, [k for _, k in on])
    # rows that don't ask get keys that no index has, so that they aren't one hot key
    apart = F.xxhash64(*[F.col(c) for c in asking.columns if c in _APART])
    spread = F.concat(F.lit("-"), apart.cast("string")) if key else -1 - F.pmod(apart, F.lit(1 << 20)).cast("int")
    rows = rows.withColumn("_ask", F.when(asks, F.col(on[0][0])).otherwise(spread))
    met = rows.join(found, [F.col("_ask") == F.col(on[0][1]), *[F.col(c) == F.col(k) for c, k in on[1:]]], "left")
    return met.withColumn(name, F.when(asks, F.col(name))).drop("_ask", *[k for _, k in on])


#: Columns that tell rows apart which look nothing up.
_APART = ("title", "year", "number", "work_type", "doc_id", "text_key", "ord")


def match_works(refs: DataFrame, registers: Registers, settings: Settings = Settings(), held: Held | None = None) -> DataFrame:
    """``refs`` (with title, year, number, work_type) and ``match``, for references that aren't anaphoric."""
    r = (
        refs.withColumn("_norm", F.coalesce(title_key(F.col("title")), F.lit("")))
        .withColumn("_stem", F.coalesce(title_stem(F.col("title")), F.lit("")))
        .withColumn("_alias", F.coalesce(alias_key(F.col("title")), F.lit("")))
        .withColumn("_type", F.coalesce(F.when(F.col("work_type") != "", F.col("work_type")), inferred_type(F.col("title"), F.col("year"))))
    )
    none = empty(f"array<{WORK}>")
    title, year, number = F.col("title"), F.col("year"), F.col("number")
    # a number decides; titles and aliases are looked up for those that have none
    by_number = F.coalesce((number != "") & (year != 0), F.lit(False))
    by_title = ~by_number & F.coalesce(title != "", F.lit(False))
    # six look-ups start from these
    asking = r = kept(r, held)
    for kind, key, at, asks in (
        ("number", "number", "year", by_number), ("title_year", "_norm", "year", by_title & year.isNotNull()), ("stem_year", "_stem", "year", by_title & year.isNotNull()),
        ("title", "_norm", None, by_title & year.isNull()), ("alias", "_alias", None, by_title), ("alias_year", "_alias", "year", by_title & year.isNotNull()),
    ):
        r = _looked_up(r, asking, registers, kind, f"_of_{kind}", key, at, asks)

    numbered = F.coalesce("_of_number.works", none)
    typed = F.filter(numbered, lambda w: w["work_type"] == F.col("_type"))
    r = r.withColumn("_numbers", F.when(F.size(typed) > 0, typed).otherwise(numbered))
    r = r.withColumn("_titles", F.when(year.isNotNull(), F.coalesce("_of_title_year", "_of_stem_year")).otherwise(F.col("_of_title")))
    titles, aliases, same_year = (F.coalesce(F.col(f"{c}.n"), F.lit(0)) for c in ("_titles", "_of_alias", "_of_alias_year"))
    first = lambda c: F.get(f"{c}.works", 0)
    has_number = (number != "") & (year != 0)
    has_title = title != ""
    made = F.struct(
        F.concat_ws("-", "_type", year.cast("string"), number).alias("id"),
        F.when(has_title, title).otherwise(F.concat("_type", F.lit(" "), year.cast("string"), F.lit("/"), number)).alias("title"),
        year.alias("year"), F.col("_type").alias("work_type"), number.alias("number"), empty("array<string>").alias("aliases"),
    ).cast(WORK)
    direct = (
        F.when(has_number & (F.size("_numbers") == 1), match(F.get("_numbers", 0), 1.0, "number"))
        .when(has_number & ((F.size("_numbers") == 0) | ~F.coalesce(has_title, F.lit(False))), match(made, 0.95, "number", _strings("constructed from the cited number; not in registry")))
        .when(has_number, F.lit(None).cast(MATCH))
        .when(has_title & (titles == 1), match(first("_titles"), 1.0, "exact"))
        .when(has_title & (titles > 1), match(first("_titles"), 0.90, "exact", _strings("ambiguous title; first match used")))
        .when(has_title & (aliases == 1), match(first("_of_alias"), 0.95, "alias"))
        .when(has_title & (aliases > 1) & (same_year == 1), match(first("_of_alias_year"), 0.95, "alias"))
        .when(F.coalesce(has_title, F.lit(False)), F.lit(None).cast(MATCH))
        .otherwise(match(None, 0.0, "unresolved", _strings("no title or number to resolve")))
    )
    # distinct references, from which the look-ups below branch off
    r = kept(r.withColumn("match", direct).drop("_titles", *[c for c in r.columns if c.startswith("_of_")]), held)

    # several works of one number: the most similar title, the first of equals
    several = r.filter("match is null and size(_numbers) > 1").select("_norm", "year", "number", "_type", F.posexplode("_numbers").alias("i", "work")).distinct()
    scored = several.withColumn("score", similarity("_norm", title_key(F.col("work.title"))))
    best = scored.groupBy("_norm", "year", "number", "_type").agg(F.max_by("work", F.struct("score", -F.col("i"))).alias("_best"))
    r = r.join(best, ["_norm", "year", "number", "_type"], "left")
    probes = r.filter("match is null and _best is null").select("_norm", "year").distinct()
    found = search_works(probes.withColumnRenamed("_norm", "norm"), registers, settings.suggest)
    r = _with_found(r, found)
    r = _asked(r, settings, held)
    top = F.get("found", 0)
    listed = F.coalesce(F.transform("found", lambda x: F.struct(x["work"]["id"].alias("id"), x["score"].alias("score"))), empty(f"array<{CANDIDATE}>"))
    later = (
        F.when(F.col("_best").isNotNull(), match(F.col("_best"), 0.97, "number", _strings("several works share that number")))
        .when(top["score"] >= settings.accept, match(top["work"], top["score"], "fuzzy", None, listed))
        .when(F.col("_remote").isNotNull(), match(F.col("_remote"), 0.93, "remote", None, listed))
        .otherwise(match(None, 0.0, "unresolved", _strings("no registry entry above the acceptance threshold"), listed))
    )
    r = r.withColumn("match", F.coalesce("match", later))
    return r.select(*refs.columns, "match")


def _with_found(r: DataFrame, found: DataFrame) -> DataFrame:
    right = found.select("norm", F.coalesce("year", F.lit(-1)).alias("year_key"), "found")
    left = r.withColumn("_year", F.coalesce("year", F.lit(-1)))
    joined = left.join(right, (left["_norm"] == right["norm"]) & (left["_year"] == right["year_key"]), "left")
    return joined.drop("norm", "year_key", "_year")


def _asked(r: DataFrame, settings: Settings, held: Held | None) -> DataFrame:
    """``_remote``: what the remote service knows of titles that stay unresolved."""
    if settings.remote is None:
        return r.withColumn("_remote", F.lit(None).cast(WORK))
    open_ = r.filter("match is null and _best is null").filter(F.coalesce(F.get("found", 0)["score"] < settings.accept, F.lit(True)))
    titles = open_.groupBy(F.col("_norm").alias("norm"), "year").agg(F.min("title").alias("title"))
    known = answers(titles, settings.remote, WORK, held).select(F.col("norm").alias("_n"), F.col("year").alias("_y"), F.col("work").alias("_remote"))
    return r.join(known, (r["_norm"] == known["_n"]) & r["year"].eqNullSafe(known["_y"]), "left").drop("_n", "_y")


def _learn(rows: DataFrame, refs: DataFrame, matched: DataFrame, registers: Registers, settings: Settings, held: Held | None) -> DataFrame:
    """A work that was found remotely is in the register from then on: only the first mention
    of a reference, by document and place, keeps the method; others are matched once more."""
    from_afar = matched.filter(F.col("match.method") == "remote")
    works = kept(from_afar.select("match.work.*").dropDuplicates(["id"]), held)
    again = refs.join(from_afar.select("ref"), "ref", "left_semi")
    later = match_works(again, registers.add(works=works), replace(settings, remote=None), held).select("ref", F.col("match").alias("later"))
    place = F.struct("doc_id", "text_key", "ord")
    first = rows.filter((F.col("role") == "cite") & (F.col("match.method") == "remote")).groupBy("ref").agg(F.min(place).alias("first"))
    met = rows.join(later, "ref", "left").join(first, "ref", "left")
    return met.withColumn("match", F.when(F.col("first").isNotNull() & (place > F.col("first")), F.col("later")).otherwise(F.col("match"))).drop("later", "first")


# --- back-references ---------------------------------------------------------

#: Rules by which a citation that names no work finds one: method, confidence and note.
_RULES = {
    "short": ("short-form", 0.92, None), "alias": ("alias", 0.88, None), "aliases": ("alias", 0.70, "ambiguous acronym; first match used"), "of year": ("anaphora", 0.90, None),
    "year known": ("anaphora", 0.65, "year matched the registry, not the document"), "no year": ("unresolved", 0.0, None), "noun": ("anaphora", 0.80, None),
    "recent": ("anaphora", 0.60, "fell back to the most recent work"), "nothing": ("unresolved", 0.0, "back-reference with no antecedent"),
    "bare": ("context", 0.70, "pinpoint attached to most recent work"), "alone": ("unresolved", 0.0, "pinpoint with no antecedent work"),
}


class _Antecedents:
    """What a document's citations have named so far: places in a pool of works."""

    def __init__(self):
        self.last = self.act = self.si = None
        self.by_year: dict[int, int] = {}
        self.shorts: dict[str, int] = {}

    def see(self, at: int, year: int | None, kind: str | None) -> None:
        self.last = at
        self.by_year[year] = at
        if kind in fixed.ACT_TYPES:
            self.act = at
        if kind in fixed.SI_TYPES:
            self.si = at

    def find(self, row: dict, alias: int | None, of_year: int | None) -> tuple[str, int | None]:
        """The rule and the work of a back-reference; ``alias`` and ``of_year``: the first of the register's."""
        if row["alias"] in self.shorts:
            return "short", self.shorts[row["alias"]]
        if row["alias_n"]:
            return ("alias" if row["alias_n"] == 1 else "aliases"), alias
        if row["year"] is not None:
            if row["year"] in self.by_year:
                return "of year", self.by_year[row["year"]]
            return ("year known", of_year) if row["year_n"] == 1 else ("no year", None)
        wanted = {"act": self.act, "si": self.si}.get(row["noun"])
        if wanted is not None:
            return "noun", wanted
        return ("recent", self.last) if self.last is not None else ("nothing", None)

    def moved(self, to: dict[int, int]) -> None:
        self.last, self.act, self.si = (to.get(x) for x in (self.last, self.act, self.si))
        self.by_year = {k: to[v] for k, v in self.by_year.items()}
        self.shorts = {k: to[v] for k, v in self.shorts.items()}

    def places(self) -> set[int]:
        return {x for x in (self.last, self.act, self.si, *self.by_year.values(), *self.shorts.values()) if x is not None}


_READ = ["doc_id", "text_key", "role", "mentioned", "anaphoric", "alias", "alias_n", "year", "year_n", "noun"]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``rule`` and ``found`` to rows that come by document, definitions first, then citations in order.
    Works stay in Arrow: the state names their places."""
    at, state, pool = None, _Antecedents(), None
    for batch in batches:
        n = batch.num_rows
        own = [batch.column(c) for c in ("direct_work", "alias_work", "year_work")]
        begin = len(pool) if pool is not None else 0
        pool = pa.concat_arrays(([pool] if begin else []) + own)
        known, years, kinds = pool.is_valid().to_pylist(), pool.field("year").to_pylist(), pool.field("work_type").to_pylist()
        columns = [batch.column(c).to_pylist() for c in _READ]
        rules, found = [], []
        for i, values in enumerate(zip(*columns, strict=True)):
            row = dict(zip(_READ, values, strict=True))
            if (row["doc_id"], row["text_key"]) != at:
                at, state = (row["doc_id"], row["text_key"]), _Antecedents()
            direct = begin + i if known[begin + i] else None
            rule, work = None, direct
            if row["role"] == "define":
                if direct is not None:
                    state.shorts[row["alias"]] = direct
            else:
                if not row["mentioned"]:
                    rule, work = ("bare", state.last) if state.last is not None else ("alone", None)
                elif row["anaphoric"]:
                    rule, work = state.find(row, begin + n + i, begin + 2 * n + i)
                if work is not None:
                    state.see(work, years[work], kinds[work])
            rules.append(rule)
            found.append(work)
        yield pa.record_batch([*batch.columns, pa.array(rules, pa.string()), pool.take(pa.array(found, pa.int64()))], [*batch.schema.names, "rule", "found"])
        places = sorted(state.places())
        pool = pool.take(pa.array(places, pa.int64()))
        state.moved({old: new for new, old in enumerate(places)})


def _antecedents(rows: DataFrame, registers: Registers) -> DataFrame:
    """``rows`` of documents with back-references, with the match of each citation."""
    name = F.when(F.col("role") == "define", F.col("mention.short")).when(F.col("anaphoric"), F.col("title"))
    rows = rows.withColumn("alias", alias_key(name))
    asking, back = rows, F.col("anaphoric")
    rows = _looked_up(rows, asking, registers, "alias", "_of_alias", "alias", None, back & F.col("alias").isNotNull())
    rows = _looked_up(rows, asking, registers, "year", "_of_year", None, "year", back & F.col("year").isNotNull())
    surface = F.lower("mention.surface")
    # the first noun of the list that occurs decides; acts come first
    noun = F.when(surface.rlike("act|measure"), "act").when(surface.rlike("regulations|order|rules"), "si")
    rows = rows.withColumns({
        "alias_n": F.col("_of_alias.n"), "alias_work": F.get("_of_alias.works", 0), "year_n": F.col("_of_year.n"), "year_work": F.get("_of_year.works", 0), "noun": noun,
        "direct_work": F.col("match.work"), "five": F.transform("_of_year.works", lambda w: F.struct(w["id"].alias("id"), F.lit(0.5).alias("score"))),
    })
    columns = ["doc_id", "text_key", "ord", "role", "start", "end", "surface", "mention", "chain", "mentioned", "anaphoric", "title", "year", "number", "work_type", "match", "alias", "alias_n", "alias_work", "year_n", "year_work", "noun", "direct_work", "five"]
    sorted_ = rows.select(*columns).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", F.desc("role"), "ord")
    kind = sorted_.schema["direct_work"].dataType
    told = sorted_.mapInArrow(_in_order, StructType([*sorted_.schema.fields, StructField("rule", sorted_.schema["noun"].dataType), StructField("found", kind)]))
    told = told.filter("role = 'cite'")
    ruled = F.col("match")
    for rule, (method, score, note) in _RULES.items():
        notes = _strings(F.concat(F.lit("no work from "), F.col("year").cast("string"), F.lit(" mentioned earlier"))) if rule == "no year" else _strings(note) if note else None
        five = F.coalesce("five", empty(f"array<{CANDIDATE}>")) if rule == "no year" else None
        ruled = F.when(F.col("rule") == rule, match(F.col("found"), score, method, notes, five)).otherwise(ruled)
    return told.withColumn("m", ruled)


def resolve_works(found: DataFrame, registers: Registers, settings: Settings = Settings(), held: Held | None = None) -> DataFrame:
    """Citations of ``found`` (doc_id, text_key, citations, definitions): one resolved row each.

    Mentions leave the row without their document's text. Only documents with a
    back-reference are shuffled by document.
    """
    back = F.exists("citations", lambda c: c["mention"].isNull() | F.coalesce(c["mention"]["anaphoric"], F.lit(False)))
    found = found.withColumn("back", back)
    flat = found.select("doc_id", "text_key", "back", F.posexplode("citations").alias("ord", "c")).select(
        "doc_id", "text_key", "back", "ord", F.lit("cite").alias("role"), F.col("c.s").alias("start"), F.col("c.e").alias("end"), F.col("c.surface").alias("surface"), F.col("c.mention").alias("mention"), F.col("c.chain").alias("chain")
    )
    defined = found.filter("back").select("doc_id", "text_key", "back", F.posexplode("definitions").alias("ord", "m")).select(
        "doc_id", "text_key", "back", "ord", F.lit("define").alias("role"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("surface"), F.col("m").alias("mention"), empty(f"array<{PROVISION}>").alias("chain")
    )
    m = F.col("mention")
    keys = ["title", "year", "number", "work_type"]
    rows = flat.union(defined).withColumns({
        **{k: m[k] for k in keys}, "mentioned": m.isNotNull(), "anaphoric": F.coalesce(m["anaphoric"], F.lit(False)),
    })
    # what is direct is looked up once per distinct reference; what isn't gets keys of its own
    direct = F.col("mentioned") & ~F.col("anaphoric")
    apart = F.concat(F.lit("-"), F.col("text_key").cast("string"), F.lit("-"), F.col("ord").cast("string"))
    rows = rows.withColumn("ref", F.when(direct, F.to_json(F.struct(*keys))).otherwise(apart))
    refs = flat.union(defined.filter(m["anaphoric"] == F.lit(False))).filter(m.isNotNull() & ~m["anaphoric"]).select(*[m[k].alias(k) for k in keys]).distinct().withColumn("ref", F.to_json(F.struct(*keys)))
    matched = kept(match_works(refs, registers, settings, held).select("ref", "match"), held)
    rows = rows.join(matched, "ref", "left")
    if settings.remote is not None:
        rows = _learn(rows, refs, matched, registers, settings, held)
    rows = rows.drop("ref")
    simple = rows.filter("not back and role = 'cite'").withColumn("m", F.col("match"))
    shown = ["doc_id", "text_key", "ord", "start", "end", "surface", "mention", "chain", "mentioned", "anaphoric", *keys, "m"]
    out = simple.select(*shown).unionByName(_antecedents(rows.filter("back").drop("back"), registers).select(*shown))
    linked = out.withColumn("links", work_links(F.col("m.work"), F.col("chain"), F.col("title"), F.col("year"), *settings.version))
    more = F.when(F.size("links.urls") > 1, F.array(F.concat(F.size("links.urls").cast("string"), F.lit(" provisions cited; url is the first")))).otherwise(empty("array<string>"))
    ranges = F.when(F.exists("chain", lambda p: p["end_number"].isNotNull()), _strings("range cited; url targets the first provision")).otherwise(empty("array<string>"))
    ref = F.struct(
        F.coalesce("mention.surface", F.lit("")).alias("surface"), "title", "year", "number", "work_type", (F.col("anaphoric") | ~F.col("mentioned")).alias("anaphoric")
    )
    return linked.select(
        "doc_id", "ord", "surface", "start", "end", ref.alias("work_ref"), F.col("chain").alias("provisions"), F.col("m.work").alias("work"), F.col("m.work").isNotNull().alias("resolved"),
        F.col("m.confidence").alias("confidence"), F.col("m.method").alias("method"), F.col("m.candidates").alias("candidates"), F.concat("m.notes", more, ranges).alias("notes"),
        F.col("links.url").alias("url"), F.col("links.id_uri").alias("id_uri"),
        F.struct(F.lit(settings.version[0]).alias("kind"), F.lit(settings.version[1]).cast("string").alias("date")).alias("version"), "text_key", labels(F.col("chain")).alias("label"),
    )


# --- cases -------------------------------------------------------------------


def search_cases(probes: DataFrame, registers: Registers, cutoff: float = fixed.SEARCH_CUTOFF, limit: int = fixed.SEARCH_LIMIT) -> DataFrame:
    """probes(key) with ``found``: the cases whose best name is most similar, as array of (score, case)."""
    asked = probes.filter("key <> ''").select("key", F.lit(None).cast("int").alias("year")).distinct()
    scored = close(asked, registers.case_names, cutoff).groupBy("key", F.col("ref").alias("ord")).agg(F.max("score").alias("score"))
    best = scored.join(registers.cases.select("ord", "case"), "ord")
    place = Window.partitionBy("key").orderBy(F.desc("score"), "case.name", "ord")
    top = best.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
    rows = F.array_sort(F.collect_list(F.struct("place", "score", "case")))
    return top.groupBy("key").agg(F.transform(rows, lambda r: F.struct(r["score"].alias("score"), r["case"].alias("case"))).alias("found"))


def _years_agree(case: Column, reports: Column) -> Column:
    year = case["neutral"]["year"]
    near = F.exists(reports, lambda r: (r["year"] >= year) & (r["year"] <= year + 1))
    return (F.size(reports) == 0) | year.isNull() | near


def match_cases(refs: DataFrame, registers: Registers, settings: Settings = Settings(), held: Held | None = None) -> DataFrame:
    """``refs`` (with name, neutral, reports) and ``match``."""
    none_cases = empty(f"array<{CASE}>")
    # the key of a reference is all of it, so that different ones can't meet
    keyed = refs.withColumn("_id", F.to_json(F.struct("name", "neutral", "reports"))).withColumn("_name", F.coalesce(name_key(F.col("name")), F.lit("")))
    one = keyed.dropDuplicates(["_id"]).select("_id", "_name", "name", "neutral", "reports").withColumn("_neutral", F.coalesce(F.lower(neutral_text(F.col("neutral"))), F.lit("")))
    def at(kind: str, key: str, name: str) -> DataFrame:
        return registers.case_index(kind).select(F.col("key").alias(key), F.col("cases").alias(name))

    r = kept(one.join(at("neutral", "_neutral", "_held"), "_neutral", "left").withColumn("registered", F.get("_held", 0)).drop("_held"), held)
    reports = r.select("_id", F.posexplode("reports").alias("i", "r"))
    reports = reports.withColumn("strict", report_key(F.col("r.year"), F.col("r.volume"), F.col("r.series"), F.col("r.page")))
    reports = reports.withColumn("loose", report_key(F.col("r.year"), F.lit("*"), F.col("r.series"), F.col("r.page")))
    reports = reports.join(at("strict", "strict", "strict_cases"), "strict", "left").join(at("loose", "loose", "loose_cases"), "loose", "left")
    hits = F.when(F.size("strict_cases") > 0, F.col("strict_cases")).otherwise(F.coalesce("loose_cases", none_cases))
    reports = reports.select("_id", F.struct("i", "r", hits.alias("hits"), (F.coalesce(F.size("strict_cases"), F.lit(0)) <= 0).alias("loose")).alias("hit"))
    r = r.join(reports.groupBy("_id").agg(F.array_sort(F.collect_list("hit"), lambda a, b: a["i"] - b["i"]).alias("hits")), "_id", "left")
    single = F.get(F.filter("hits", lambda h: F.size(h["hits"]) == 1), 0)
    r = r.withColumn("_single", single)
    # ambiguous reports before the first that has one case
    ambiguous = F.flatten(F.transform(F.filter("hits", lambda h: (F.size(h["hits"]) > 1) & (F.col("_single").isNull() | (h["i"] < F.col("_single.i")))), lambda h: F.transform(h["hits"], lambda c: F.struct(c["id"].alias("id"), F.lit(0.5).alias("score")))))
    r = r.withColumn("_doubtful", F.coalesce(ambiguous, empty(f"array<{CANDIDATE}>")))
    r = r.withColumn("_case", F.coalesce("registered", F.when(F.col("neutral").isNull(), F.get(F.col("_single.hits"), 0))))

    # the cited name against the names of the case
    pairs = r.filter("name is not null and _case is not null").select("_id", "_name", F.explode(F.concat(F.array("_case.name"), "_case.aliases")).alias("other"))
    agreed = pairs.withColumn("score", name_agreement("_name", name_key(F.col("other")))).groupBy("_id").agg(F.max("score").alias("_agrees"))
    r = r.join(agreed, "_id", "left")

    r = r.join(at("name", "_name", "name_cases"), "_name", "left")
    named = F.filter(F.coalesce("name_cases", none_cases), lambda c: _years_agree(c, F.col("reports")))
    r = kept(r.withColumn("_named", named), held)
    open_ = r.filter("name is not null and neutral is null and _single is null and size(_named) = 0").select(F.col("_name").alias("key"))
    r = r.join(search_cases(open_, registers, settings.suggest).withColumnRenamed("key", "_name"), "_name", "left")
    near = F.filter("found", lambda x: _years_agree(x["case"], F.col("reports")))
    r = r.withColumn("_near", F.coalesce(near, F.array().cast("array<struct<score:double,case:" + CASE + ">>")))
    r = r.withColumn("_rounded", round4(F.col("_agrees")))

    cited, registered, single = F.col("name"), F.col("registered"), F.col("_single")
    loose = single["loose"]
    volume = F.when(loose, _strings("matched ignoring the report volume")).otherwise(empty("array<string>"))
    made = F.struct(
        case_id(F.col("neutral")).alias("id"), F.coalesce(cited, neutral_text(F.col("neutral"))).alias("name"), F.col("neutral"),
        F.transform("reports", report_text).alias("reports"), empty("array<string>").alias("aliases"),
    ).cast(CASE)
    differs = F.when(cited.isNotNull() & (F.col("_agrees") < fixed.NAME_AGREES), _strings(F.concat(F.lit("cited name differs from the registry entry ("), registered["name"], F.lit(")")))).otherwise(empty("array<string>"))
    conflict = _strings(F.concat(report_text(single["r"]), F.lit(" is registered to "), F.col("_case.name"), F.lit(", but the cited name does not match")))
    clash = F.array(F.struct(F.col("_case.id").alias("id"), F.col("_rounded").alias("score")))
    listed = F.concat("_doubtful", F.transform("_near", lambda x: F.struct(x["case"]["id"].alias("id"), x["score"].alias("score"))))
    same_name = F.transform("_named", lambda c: F.struct(c["id"].alias("id"), F.lit(1.0).alias("score")))
    top = F.get("_near", 0)
    kind = {"kind": CASE_MATCH}
    found = (
        F.when(registered.isNotNull(), match(registered, 1.0, "neutral", differs, **kind))
        .when(F.col("neutral").isNotNull(), match(made, 0.95, "neutral", _strings("constructed from the neutral citation; not in registry"), **kind))
        .when(single.isNotNull() & cited.isNull(), match(F.col("_case"), F.when(loose, 0.80).otherwise(0.85), "report", F.concat(volume, _strings("matched on the report citation alone")), **kind))
        .when(single.isNotNull() & (F.col("_agrees") >= fixed.NAME_AGREES), match(F.col("_case"), F.when(loose, 0.90).otherwise(0.95), "report", volume, **kind))
        .when(single.isNotNull(), match(None, 0.0, "unresolved", conflict, clash, **kind))
        .when(cited.isNotNull() & (F.size("_named") == 1), match(F.get("_named", 0), 0.90, "name", **kind))
        .when(cited.isNotNull() & (F.size("_named") > 1), match(None, 0.0, "unresolved", _strings("several registered cases share that name"), same_name, **kind))
        .when(cited.isNotNull() & (top["score"] >= settings.accept), match(top["case"], top["score"], "fuzzy", None, listed, **kind))
        .otherwise(match(None, 0.0, "unresolved", _strings("no neutral citation, and no registry entry matched"), listed, **kind))
    )
    return keyed.join(r.select("_id", found.alias("match")), "_id").drop("_id", "_name")


def resolve_cases(found: DataFrame, registers: Registers, settings: Settings = Settings(), held: Held | None = None) -> DataFrame:
    """Case citations of ``found`` (doc_id, text_key, case_mentions): one resolved row each."""
    rows = found.select("doc_id", "text_key", F.posexplode("case_mentions").alias("ord", "c")).select("doc_id", "text_key", "ord", "c.*")
    r = match_cases(rows, registers, settings, held)
    neutral = F.col("match.case.neutral")
    r = r.withColumn("link", F.when(neutral.isNotNull(), judgment_link(neutral)))
    court = F.concat(neutral["court"], F.when(neutral["division"].isNotNull(), F.concat(F.lit(" ("), neutral["division"], F.lit(")"))).otherwise(""))
    missing = neutral.isNotNull() & F.col("link.url").isNull()
    note = F.when(missing, F.array(F.concat(F.lit("no direct link for "), court))).otherwise(empty("array<string>"))
    barred = missing & ~held_by_primary(neutral)
    words = F.coalesce(F.when(neutral.isNotNull(), neutral_text(neutral)), F.when(F.col("name") != "", F.col("name")), F.col("match.case.name"), report_text(F.get("reports", 0)), F.col("surface"))
    url = F.coalesce(F.col("link.url"), F.when(~F.coalesce(barred, F.lit(False)), case_search(words)))
    source = F.when(F.col("link.url").isNotNull(), F.col("link.source")).when(url.isNotNull(), "search")
    ref = F.struct("surface", "name", "neutral", "reports", "pinpoint")
    return r.select(
        "doc_id", "ord", "surface", F.col("s").alias("start"), F.col("e").alias("end"), ref.alias("case_ref"), F.col("match.case").alias("case"),
        F.col("match.case").isNotNull().alias("resolved"), F.col("match.confidence").alias("confidence"), F.col("match.method").alias("method"),
        F.col("match.candidates").alias("candidates"), F.concat("match.notes", note).alias("notes"), url.alias("url"), source.alias("source"), "text_key",
    )

