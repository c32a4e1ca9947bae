"""Case citations in text: tokens, clusters, pinpoints, names, known names.

Everything happens within the row, so a document's text is never shuffled.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import SPAN, clash, collapse, cut, empty, find, group, let, name_key, newlines, table

NEUTRAL = "struct<year:int,court:string,number:string,division:string>"
REPORT = "struct<year:int,series:string,page:string,volume:string,square:boolean>"
TOKEN = f"struct<s:int,e:int,neutral:{NEUTRAL},report:{REPORT}>"
CLUSTER = f"struct<s:int,e:int,neutral:{NEUTRAL},reports:array<{REPORT}>>"
MENTION = f"struct<s:int,e:int,surface:string,name:string,neutral:{NEUTRAL},reports:array<{REPORT}>,pinpoint:string>"


def neutral(match: Column) -> Column:
    """The parts of a neutral citation; null if ``match`` isn't one."""
    division = group(match, fixed.NEUTRAL, 4)
    parts = F.struct(
        group(match, fixed.NEUTRAL, 1).cast("int").alias("year"),
        collapse(F.regexp_extract(match, fixed.NEUTRAL, 2)).alias("court"),
        F.regexp_extract(match, fixed.NEUTRAL, 3).alias("number"),
        F.coalesce(F.try_element_at(table(fixed.DIVISIONS), F.lower(division)), division).alias("division"),
    )
    return F.when(match.rlike(fixed.NEUTRAL), parts).cast(NEUTRAL)


def report(match: Column) -> Column:
    parts = F.struct(
        group(match, fixed.REPORT, 2).cast("int").alias("year"),
        F.replace(collapse(F.regexp_extract(match, fixed.REPORT, 4)), F.lit("’"), F.lit("'")).alias("series"),
        F.regexp_extract(match, fixed.REPORT, 5).alias("page"),
        group(match, fixed.REPORT, 3).alias("volume"),
        (F.regexp_extract(match, fixed.REPORT, 1) == "[").alias("square"),
    )
    return F.when(match.rlike(fixed.REPORT), parts).cast(REPORT)


def _exactly(text: Column, pattern: str, parse) -> Column:
    whole = F.regexp_extract(F.trim(text), f"^(?:{pattern})$".replace("^(?:(?U)", "(?U)^(?:", 1), 0)
    return F.when(whole != "", parse(F.trim(text)))


def parse_neutral(text: Column) -> Column:
    """The parts of a string that is a neutral citation and nothing else, else null."""
    return _exactly(text, fixed.NEUTRAL, neutral)


def parse_report(text: Column) -> Column:
    return _exactly(text, fixed.REPORT, report)


def neutral_text(n: Column) -> Column:
    division = F.when(n["division"].isNotNull(), F.concat(F.lit(" ("), n["division"], F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), n["year"].cast("string"), F.lit("] "), n["court"], F.lit(" "), n["number"], division)


def report_text(r: Column) -> Column:
    volume = F.when(r["volume"].isNotNull(), F.concat(r["volume"], F.lit(" "))).otherwise("")
    left, right = F.when(r["square"], "[").otherwise("("), F.when(r["square"], "]").otherwise(")")
    return F.concat(left, r["year"].cast("string"), right, F.lit(" "), volume, r["series"], F.lit(" "), r["page"])


def _clusters(text: Column, tokens: Column) -> Column:
    """Adjacent tokens of one case; at most one neutral citation in each."""

    def add(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        gap = cut(text, last["e"], t["s"])
        joins = last.isNotNull() & gap.rlike(fixed.CITE_GAP) & (newlines(gap) <= 1) & (last["neutral"].isNull() | t["neutral"].isNull())
        own = F.when(t["report"].isNotNull(), F.array(t["report"])).otherwise(empty(f"array<{REPORT}>"))
        longer = F.struct(last["s"].alias("s"), t["e"].alias("e"), F.coalesce(last["neutral"], t["neutral"]).alias("neutral"), F.concat(last["reports"], own).alias("reports"))
        new = F.struct(t["s"].alias("s"), t["e"].alias("e"), t["neutral"].alias("neutral"), own.alias("reports"))
        kept = F.when(F.coalesce(joins, F.lit(False)), F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        item = F.when(F.coalesce(joins, F.lit(False)), longer).otherwise(new).cast(CLUSTER)
        return F.concat(kept, F.array(item))

    return F.aggregate(tokens, empty(f"array<{CLUSTER}>"), add)


def sentence_start(text: Column, low: Column, high: Column) -> Column:
    """Just after the last sentence end in text[low:high]; a few characters more tell what stands before a stop."""
    seen = F.greatest(low - 4, F.lit(0))
    rest = F.try_element_at(F.split(cut(text, seen, high), fixed.SENTENCE_END, -1), F.lit(-1))
    return F.greatest(low, high - F.length(rest))


_LEADERS = rf"(?U)^(?:(?:{'|'.join(fixed.NAME_LEADERS)})(?=\s|$)\s*)*"
_TRAILERS = rf"(?iuU)(?:(?:^|\s+)(?:{'|'.join(w.replace('.', chr(92) + '.') for w in sorted(fixed.NAME_TRAILERS, key=len, reverse=True))}),*)+$"


def _named(text: Column, start: Column, after: Column) -> Column:
    """(name, s) of the case whose citation begins at ``start``; s is where the name begins."""
    low = sentence_start(text, F.greatest(after, start - fixed.NAME_REACH), start)

    def strip(before: Column) -> Column:
        whole, raw = F.regexp_extract(before, fixed.NAME_BEFORE, 0), F.regexp_extract(before, fixed.NAME_BEFORE, 1)
        lead = F.length(F.regexp_extract(raw, _LEADERS, 0))
        body = F.regexp_replace(F.substring(raw, lead + 1, F.length(raw)), _TRAILERS, "")
        name = F.regexp_replace(collapse(body), ",+$", "")
        return F.struct(name.alias("name"), (start - F.length(whole) + lead).alias("s"))

    def check(x: Column) -> Column:
        words = F.split(x["name"], " ")
        v = F.array(F.lit("v"), F.lit("v."))
        good = (F.arrays_overlap(words, v) | F.get(words, 0).isin("Re", "re")) & ~F.get(words, 0).isin("v", "v.") & (x["name"] != "")
        return F.when(good, x).otherwise(F.struct(F.lit(None).cast("string").alias("name"), start.alias("s")))

    return let(let(cut(text, low, start), strip), check)


#: Characters after a citation in which its pinpoint is sought first, and what they are if it may go on.
_NEAR = 400
_ALL_PINPOINT = rf"(?iuU)^[\s\d,.\[\]\-–a-hprst]{{{_NEAR}}}"


def _mentions(text: Column, clusters: Column) -> Column:
    def pin(c: Column) -> Column:
        near = F.substring(text, c["e"] + 1, F.lit(_NEAR))
        # a pinpoint is longer than that only if all of it is white space, digits and the like
        tail = F.when(near.rlike(_ALL_PINPOINT), F.substring(text, c["e"] + 1, F.length(text))).otherwise(near)
        found = F.regexp_extract(tail, fixed.CASE_PINPOINT, 1)
        return F.struct(
            c["s"].alias("s"), (c["e"] + F.length(F.regexp_extract(tail, fixed.CASE_PINPOINT, 0))).alias("e"), c["neutral"].alias("neutral"),
            c["reports"].alias("reports"), F.when(found != "", collapse(found)).alias("pinpoint"),
        )

    def name(pinned: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            after = F.when(i > 0, F.get(pinned, i - 1)["e"]).otherwise(0)
            return let(
                _named(text, c["s"], after),
                lambda n: F.struct(
                    n["s"].alias("s"), c["e"].alias("e"), cut(text, n["s"], c["e"]).alias("surface"), n["name"].alias("name"),
                    c["neutral"].alias("neutral"), c["reports"].alias("reports"), c["pinpoint"].alias("pinpoint"),
                ),
            )

        return F.transform(pinned, one)

    return let(F.transform(clusters, pin), name)


_LAST_WORDS = ("others", "another")


def _edge(word: Column) -> Column:
    return F.substring(word, 1, 1).rlike(r"^[\p{Lu}\p{Lt}\p{Nd}(]$")


def _pivots(text: Column) -> Column:
    def some(pattern: str, left: bool) -> Column:
        return F.transform(find(text, pattern), lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lit(left).alias("left")))

    return F.array_sort(F.concat(some(fixed.V_PIVOT, True), some(fixed.RE_PIVOT, False)))


def _around(text: Column, p: Column) -> Column:
    """What may be a name around a pivot: spans (minus, i, j, s, e), in the order in which they are preferred."""
    right_text = F.get(F.split(F.substring(text, p["e"] + 1, F.lit(fixed.PIVOT_REACH)), fixed.SENTENCE_END, -1), 0)
    low = sentence_start(text, F.greatest(F.lit(0), p["s"] - fixed.PIVOT_REACH), p["s"])
    words = find(cut(text, low, p["s"]), r"(?U)\S+")
    lefts = F.transform(F.slice(words, F.greatest(F.size(words) - fixed.PIVOT_WORDS + 1, F.lit(1)), F.lit(fixed.PIVOT_WORDS)), lambda w: low + w["s"])
    lefts = F.when(p["left"], lefts).otherwise(F.array(p["s"]))

    def end(w: Column) -> Column:
        word = F.regexp_replace(w["m"], "[,.;:]+$", "")
        return F.struct((p["e"] + w["s"] + F.length(word)).alias("e"), word.alias("w"))

    rights = F.filter(F.transform(F.slice(find(right_text, r"(?U)\S+"), 1, fixed.PIVOT_WORDS), end), lambda r: _edge(r["w"]) | r["w"].isin(*_LAST_WORDS))
    starts = F.filter(lefts, lambda s: _edge(cut(text, s, s + 1)))

    def spans(r: Column) -> Column:
        return F.flatten(F.transform(starts, lambda s, i: F.transform(r, lambda x, j: F.struct((s - x["e"]).alias("minus"), i.alias("i"), j.alias("j"), s.alias("s"), x["e"].alias("e")))))

    return let(rights, spans)


def name_keys(text: Column) -> Column:
    """Keys of all that may be a registered name in the text."""
    keys = F.flatten(F.transform(_pivots(text), lambda p: F.transform(_around(text, p), lambda c: name_key(cut(text, c["s"], c["e"])))))
    return F.when(_has_pivot(text), F.array_distinct(keys)).otherwise(empty("array<string>"))


def _has_pivot(text: Column) -> Column:
    return text.rlike(rf"{fixed.V_PIVOT}|{fixed.RE_PIVOT[4:]}")


def _known(text: Column, taken: Column, known: Column) -> Column:
    """Cases cited by a registered name alone, around a pivot: the longest words that make a known name."""

    def best(p: Column) -> Column:
        return F.array_min(F.filter(_around(text, p), lambda c: F.array_contains(known, name_key(cut(text, c["s"], c["e"])))))

    free = F.filter(_pivots(text), lambda p: ~clash(p, taken))
    found = F.filter(F.transform(free, best), lambda b: b.isNotNull())

    def pick(done: Column, b: Column) -> Column:
        new = F.struct(b["s"].alias("s"), b["e"].alias("e"), cut(text, b["s"], b["e"]).alias("m"))
        return F.when(clash(b, taken) | clash(b, done), done).otherwise(F.concat(done, F.array(new)))

    picked = F.aggregate(found, empty(SPAN), pick)
    none = lambda kind: F.lit(None).cast(kind)
    return F.transform(
        picked,
        lambda p: F.struct(
            p["s"].alias("s"), p["e"].alias("e"), p["m"].alias("surface"), collapse(p["m"]).alias("name"), none(NEUTRAL).alias("neutral"),
            empty(f"array<{REPORT}>").alias("reports"), none("string").alias("pinpoint"),
        ),
    )


@cache
def _steps(names: tuple[str, ...] | None) -> list[tuple[str, Column]]:
    """The columns of ``find_cases`` in order."""
    text = F.col("text")
    none = empty(f"array<{MENTION}>")
    neutrals = F.transform(find(text, fixed.NEUTRAL), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), neutral(x["m"]).alias("neutral"), F.lit(None).cast(REPORT).alias("report")).cast(TOKEN))
    reports = F.transform(find(text, fixed.REPORT), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast(NEUTRAL).alias("neutral"), report(x["m"]).alias("report")).cast(TOKEN))
    known = F.coalesce("known_names", empty("array<string>")) if names is None else F.array(*[F.lit(n) for n in names])
    extra = F.when(_has_pivot(text), _known(text, F.col("_m"), known)).otherwise(none) if names != () else none
    by_start = lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)
    return [
        ("_n", neutrals), ("_r", reports),
        ("_t", F.array_sort(F.concat("_n", F.filter("_r", lambda x: ~clash(x, F.col("_n")))))),
        ("_c", _clusters(text, F.col("_t"))), ("_m", _mentions(text, F.col("_c"))),
        ("_k", extra.cast(f"array<{MENTION}>")),
        ("case_mentions", F.array_sort(F.concat(F.col("_m").cast(f"array<{MENTION}>"), "_k"), by_start)),
    ]


def find_cases(docs: DataFrame, names: list[str] | None) -> DataFrame:
    """``docs`` with ``case_mentions``: an array of MENTION in text order. ``names``: keys of
    registered names; None if ``docs`` has those of each text as ``known_names``."""
    d = docs
    for name, column in _steps(None if names is None else tuple(names)):
        d = d.withColumn(name, column)
    return d.drop("_n", "_r", "_t", "_c", "_m", "_k")
