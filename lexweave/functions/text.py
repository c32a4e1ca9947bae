"""Scalar expressions over text: finding with offsets, comparison keys, escapes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPAN = "array<struct<s:int,e:int,m:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def empty(kind: str) -> Column:
    return F.array().cast(kind)


#: Marks around matches, and what stands for them where a text has them itself: none is a letter, digit or white space.
_BEGIN, _END, _OTHER = "\x00", "\x01", "\x02"


def find(text: Column, pattern: str) -> Column:
    """All matches with their offsets, in code points: array of (s, e, m).

    One scan puts marks around the matches; the pieces between the marks add up
    to offsets. (A split by the pattern would compile it for every row.)
    """
    marked = F.regexp_replace(F.translate(text, _BEGIN + _END, _OTHER * 2), F.lit(pattern), F.lit(f"{_BEGIN}$0{_END}"))
    pieces = F.split(marked, _BEGIN, -1)

    def add(state: Column, x: Column) -> Column:
        m = F.substring_index(x, _END, 1)
        s = state["at"]
        e = s + F.length(m)
        # without its mark, a piece is the match and what follows it
        return F.struct((s + F.length(x) - 1).alias("at"), F.concat(state["out"], F.array(F.struct(s.alias("s"), e.alias("e"), m.alias("m")))).alias("out"))

    def offsets(v: Column) -> Column:
        start = F.struct(F.length(F.get(v, 0)).alias("at"), empty(SPAN).alias("out"))
        return F.when(F.size(v) <= 1, empty(SPAN)).otherwise(F.aggregate(F.slice(v, F.lit(2), F.size(v)), start, add, lambda a: a["out"]))

    found = let(pieces, offsets)
    # a match that held a mark gets its own characters back
    own = F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(x["m"].contains(_OTHER), cut(text, x["s"], x["e"])).otherwise(x["m"]).alias("m")))
    return F.coalesce(own, empty(SPAN))


def group(match: Column, pattern: str, index: int) -> Column:
    """A group of a match, null if it took no part."""
    found = F.regexp_extract(match, pattern, index)
    return F.when(found != "", found)


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def clash(x: Column, spans: Column) -> Column:
    """Does (s, e) overlap any of the spans?"""
    return F.exists(spans, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility characters up to U+FFFF that stand for one character, and the Latin ligatures."""
    one, to = [], []
    for c in range(0xA0, 0x10000):
        if 0x3000 < c < 0xFB00 or 0xD800 <= c < 0xE000:
            continue
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and n != chr(c):
            one.append(chr(c))
            to.append(n)
    many = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in (*range(0xFB00, 0xFB07), 0x2026, 0x2116, 0x2122)]
    return "".join(one), "".join(to), many


_ONE, _TO, _MANY = _compatible()


def clean(text: Column) -> Column:
    """Compatibility forms, curly quotes and dashes made plain, white space collapsed."""
    plain = F.translate(F.translate(text, _ONE, _TO), "‘’“”–—− ", "''\"\"--- ")
    for char, stands in _MANY:
        plain = F.replace(plain, F.lit(char), F.lit(stands))
    return collapse(F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text))


def title_key(title: Column) -> Column:
    t = F.replace(F.lower(clean(title)), F.lit("&"), F.lit(" and "))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, "^the +", ""), rf" +{fixed.YEAR}$", ""))


def title_stem(title: Column) -> Column:
    return F.regexp_replace(title_key(title), rf"(?:(?:^| )(?:{'|'.join(fixed.TITLE_NOUNS)}))+$", "")


def alias_key(alias: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean(alias)), r"^the\s+", ""), "[^a-z0-9 ]+", "")


def name_key(name: Column) -> Column:
    t = F.replace(F.lower(clean(name)), F.lit("&"), F.lit(" and "))
    t = F.regexp_replace(F.regexp_replace(t, r"\bvs?\.?(?=\s)", " v "), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, fixed.CASE_NOISE, " "), " +", " "))


def report_key(year: Column, volume: Column, series: Column, page: Column) -> Column:
    return F.concat_ws("|", year.cast("string"), F.coalesce(volume, F.lit("")), F.regexp_replace(F.lower(series), "[^a-z0-9&]", ""), page)


def query(text: Column) -> Column:
    """Form encoding; Spark's differs for ``~`` and ``*``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def html(text: Column) -> Column:
    for char, stands in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(stands))
    return text


def table(values: dict[str, str | int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
