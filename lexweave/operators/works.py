"""Legislation in text: titled works, instruments, back-references, pinpoints and their binding.

Everything happens within the row, so a document's text is never shuffled.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import alias_key, clash, cut, empty, find, group, let, newlines, table

PROVISION = "struct<kind:string,number:string,subdivisions:array<string>,end_number:string>"
MENTION = "struct<s:int,e:int,surface:string,title:string,year:int,number:string,work_type:string,anaphoric:boolean,short:string>"
GROUP = f"struct<s:int,e:int,chain:array<{PROVISION}>>"
CITATION = f"struct<s:int,e:int,surface:string,mention:{MENTION},chain:array<{PROVISION}>>"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _mention(x: Column, title: Column, year: Column, number: Column, kind: Column, back: bool, short: Column | None = None) -> Column:
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("surface"), title.alias("title"), year.alias("year"), number.alias("number"),
        kind.alias("work_type"), F.lit(back).alias("anaphoric"), (short if short is not None else _null()).alias("short"),
    ).cast(MENTION)


def is_short_form(candidate: Column) -> Column:
    """Is what stands in brackets a short form, rather than a number?"""
    bare = F.replace(F.replace(candidate, F.lit("."), F.lit("")), F.lit(" "), F.lit(""))
    words = F.split(F.trim(F.replace(candidate, F.lit("."), F.lit(""))), r"(?U)\s+")
    upper = F.exists(words, lambda w: (F.length(w) >= 2) & (F.upper(w) == w) & w.rlike(r"(?U)\p{L}"))
    last = F.regexp_replace(F.lower(F.try_element_at(F.split(candidate, r"(?U)\s+"), F.lit(-1))), "s+$", "")
    return (
        (candidate != "") & (F.length(candidate) <= 50) & ~bare.rlike(r"(?iU)^c\d+$") & ~candidate.contains("/")
        & candidate.rlike(r"(?U)\p{L}") & (upper | last.isin(*fixed.SHORT_FORM_NOUNS))
    )


def titled_works(text: Column) -> Column:
    def one(x: Column) -> Column:
        part = lambda i: group(x["m"], fixed.WORK, i)
        devolved, si, ssi = part(4), part(6), part(7)
        number = F.coalesce(part(3), part(5), si, ssi)
        kind = F.when(part(3).isNotNull(), _null()).when(devolved.isNotNull(), F.lower(devolved)).when(si.isNotNull(), "uksi").when(ssi.isNotNull(), "ssi")
        short = F.trim(F.regexp_extract(F.substring(text, x["e"] + 1, F.lit(80)), fixed.SHORT_FORM, 1))

        def titled(title: Column) -> Column:
            words = F.split(title, r"(?U)\s+")
            article = F.lower(F.get(words, 0)).isin(*fixed.ARTICLES)
            rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
            return F.when(~article, title).when(F.size(words) >= 3, rest)

        return _mention(x, let(part(1), titled), part(2).cast("int"), number, kind, False, F.when(is_short_form(short), short))

    return F.filter(F.transform(find(text, fixed.WORK), one), lambda m: m["title"].isNotNull())


def instruments(text: Column) -> Column:
    def one(x: Column) -> Column:
        code = F.upper(F.regexp_replace(F.regexp_extract(x["m"], fixed.INSTRUMENT, 1), "[. ]", ""))
        kind = F.coalesce(F.try_element_at(table(fixed.INSTRUMENT_TYPES), code), F.lit("uksi"))
        return _mention(x, _null(), group(x["m"], fixed.INSTRUMENT, 2).cast("int"), group(x["m"], fixed.INSTRUMENT, 3), kind, False)

    return F.transform(find(text, fixed.INSTRUMENT), one)


def _back(text: Column, pattern: str, title: bool = False, year: bool = False) -> Column:
    def one(x: Column) -> Column:
        first = group(x["m"], pattern, 1)
        return _mention(x, F.trim(first) if title else _null(), first.cast("int") if year else _null("int"), _null(), _null(), True)

    return F.transform(find(text, pattern), one)


def _free(mentions: Column, taken: Column) -> Column:
    return F.filter(mentions, lambda m: ~clash(m, taken))


def _spans(mentions: Column) -> Column:
    return F.transform(mentions, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e")))


def provisions(kind: Column, items: Column) -> Column:
    """``45(2), 46 to 48`` as provisions; a range's end belongs to the one before it."""

    def add(done: Column, x: Column) -> Column:
        link = F.trim(F.regexp_replace(F.regexp_extract(x, fixed.PROVISION_ITEM, 1), r"(?U)\s+", " "))
        item = F.regexp_extract(x, fixed.PROVISION_ITEM, 2)
        number = F.upper(F.regexp_extract(item, rf"(?iuU)^({fixed.NUMBER})", 1))
        subs = F.regexp_extract_all(item, F.lit(r"(?U)\(\s*([0-9A-Za-z]{1,4})\s*\)"), F.lit(1))
        last = F.try_element_at(done, F.lit(-1))
        ends = link.isin(*fixed.RANGE_WORDS) & (F.size(done) > 0)
        ranged = F.struct(last["kind"].alias("kind"), last["number"].alias("number"), last["subdivisions"].alias("subdivisions"), number.alias("end_number"))
        new = F.struct(kind.alias("kind"), number.alias("number"), subs.alias("subdivisions"), _null().alias("end_number"))
        kept = F.when(ends, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.concat(kept, F.array(F.when(ends, ranged).otherwise(new).cast(PROVISION)))

    return F.aggregate(F.regexp_extract_all(items, F.lit(fixed.PROVISION_ITEM), F.lit(0)), empty(f"array<{PROVISION}>"), add)


def _raw_pinpoints(text: Column) -> Column:
    def one(x: Column) -> Column:
        kind = F.try_element_at(table(fixed.KINDS), F.lower(F.regexp_extract(x["m"], fixed.PROVISION, 1)))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.try_element_at(table(fixed.RANKS), kind).alias("rank"), provisions(kind, F.regexp_extract(x["m"], fixed.PROVISION, 2)).alias("chain"))

    return F.transform(find(text, fixed.PROVISION), one)


def _nested(text: Column, raw: Column) -> Column:
    """``paragraph 4 of Schedule 2`` as one group, the outermost first."""
    open_group = f"struct<s:int,e:int,rank:int,chain:array<{PROVISION}>>"

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        inner = F.coalesce(cut(text, last["e"], x["s"]).rlike(fixed.NESTING_GAP) & (x["rank"] < last["rank"]), F.lit(False))
        joined = F.struct(last["s"].alias("s"), x["e"].alias("e"), x["rank"].alias("rank"), F.concat(x["chain"], last["chain"]).alias("chain"))
        kept = F.when(inner, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.concat(kept, F.array(F.when(inner, joined).otherwise(x).cast(open_group)))

    groups = F.aggregate(raw, empty(f"array<{open_group}>"), add)
    return F.transform(groups, lambda g: F.struct(g["s"].alias("s"), g["e"].alias("e"), g["chain"].alias("chain")).cast(GROUP))


def _bound(text: Column, mentions: Column, groups: Column) -> Column:
    """Citations: the gaps allowed between a pinpoint and its work hold no other
    token, so each pinpoint binds to the token next to it or to none."""
    stream = F.array_sort(F.concat(
        F.transform(mentions, lambda m: F.struct(m["s"].alias("s"), m["e"].alias("e"), F.lit(False).alias("pin"), m.alias("mention"), _null(f"array<{PROVISION}>").alias("chain"))),
        F.transform(groups, lambda g: F.struct(g["s"].alias("s"), g["e"].alias("e"), F.lit(True).alias("pin"), _null(MENTION).alias("mention"), g["chain"].alias("chain"))),
    ))

    def forward(t: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            after = F.get(t, i + 1)
            return F.coalesce(x["pin"] & ~after["pin"] & cut(text, x["e"], after["s"]).rlike(fixed.FORWARD_GAP), F.lit(False))

        return F.transform(t, one)

    def citations(t: Column, fwd: Column) -> Column:
        def backward(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(t, i - 1))
            gap = cut(text, before["e"], x["s"])
            used = F.when(i > 1, F.get(fwd, i - 2)).otherwise(False)
            return F.coalesce(x["pin"] & ~F.get(fwd, i) & ~before["pin"] & (newlines(gap) <= 1) & gap.rlike(fixed.BACKWARD_GAP) & ~used, F.lit(False))

        def out(bwd: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                after, before = F.get(t, i + 1), F.when(i > 0, F.get(t, i - 1))
                ahead, behind = F.get(fwd, i), F.get(bwd, i)
                taken = F.when(i > 0, F.get(fwd, i - 1)).otherwise(False) | F.coalesce(F.get(bwd, i + 1), F.lit(False))
                mention = F.when(~x["pin"], x["mention"]).when(ahead, after["mention"]).when(behind, before["mention"])
                s = F.when(behind, F.least(before["s"], x["s"])).otherwise(x["s"])
                e = F.when(ahead, F.greatest(after["e"], x["e"])).otherwise(x["e"])
                cite = F.struct(s.alias("s"), e.alias("e"), cut(text, s, e).alias("surface"), mention.alias("mention"), F.coalesce(x["chain"], empty(f"array<{PROVISION}>")).alias("chain")).cast(CITATION)
                return F.when(x["pin"] | ~taken, cite)

            return F.filter(F.transform(t, one), lambda c: c.isNotNull())

        return let(F.transform(t, backward), out)

    by_place = lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0)
    return F.array_sort(let(stream, lambda t: let(forward(t), lambda f: citations(t, f))), by_place)


def acronym_keys(text: Column) -> Column:
    """Keys of all that may be an acronym of a registered work."""
    return F.array_distinct(F.transform(_back(text, fixed.ACRONYM_ANAPHOR, title=True), lambda m: alias_key(m["title"])))


@cache
def _steps(aliases: tuple[str, ...] | None) -> list[tuple[str, Column]]:
    """The columns of ``find_citations`` in order; building them takes longer than most queries' planning."""
    text, c = F.col("text"), F.col
    if aliases is None:
        registered = F.coalesce("known_aliases", empty("array<string>"))
    else:
        registered = F.array(*[F.lit(a) for a in aliases]).cast("array<string>")
    return [
        ("_x", _spans(c("case_mentions"))),
        ("_w", titled_works(text)), ("_w", _free(c("_w"), c("_x"))),
        ("definitions", F.filter("_w", lambda m: m["short"].isNotNull())),
        ("_x", F.concat("_x", _spans(c("_w")))),
        ("_i", instruments(text)), ("_i", _free(c("_i"), c("_x"))),
        ("_x", F.concat("_x", _spans(c("_i")))),
        ("_a", _back(text, fixed.YEAR_ANAPHOR, year=True)), ("_a", _free(c("_a"), c("_x"))),
        ("_x", F.concat("_x", _spans(c("_a")))),
        ("_known", F.concat(F.transform("definitions", lambda m: alias_key(m["short"])), registered)),
        ("_s", _back(text, fixed.ACRONYM_ANAPHOR, title=True)),
        ("_s", F.filter("_s", lambda m: ~clash(m, c("_x")) & F.array_contains(c("_known"), alias_key(m["title"])))),
        ("_x", F.concat("_x", _spans(c("_s")))),
        ("_b", _back(text, fixed.BARE_ANAPHOR)), ("_b", _free(c("_b"), c("_x"))),
        ("_x", F.concat("_x", _spans(c("_b")))),
        ("_p", F.filter(_raw_pinpoints(text), lambda p: ~clash(p, c("_x")))),
        ("_g", _nested(text, c("_p"))),
        ("_m", F.concat("_w", "_i", "_a", "_s", "_b")),
        ("citations", _bound(text, c("_m"), c("_g"))),
    ]


def find_citations(docs: DataFrame, aliases: list[str] | None) -> DataFrame:
    """``docs`` (with ``case_mentions``) and ``citations`` (array of CITATION, by
    place) and ``definitions`` (mentions that define a short form). ``aliases``:
    keys of registered aliases; None if ``docs`` has those of each text as ``known_aliases``."""
    d = docs
    for name, column in _steps(None if aliases is None else tuple(aliases)):
        d = d.withColumn(name, column)
    return d.drop("_x", "_w", "_i", "_a", "_s", "_b", "_p", "_g", "_m", "_known")
