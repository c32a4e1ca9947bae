"""Pages and identifiers of works, pinpoints and judgments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import empty, let, query, table
from .cases import neutral_text

#: fixed values: how instruments are cited
CODES = {"uksi": "SI", "ssi": "SSI", "nisr": "SR", "wsi": "WSI"}
TARGET = "struct<path:array<string>,subdivisions:array<string>>"


def version(text: str) -> tuple[str, str | None]:
    """``latest``, ``prospective``, ``original`` or ``as-at:DATE`` as (kind, date)."""
    if text in ("latest", "prospective", "original"):
        return text, None
    if text.startswith("as-at:") and text[6:]:
        return "point-in-time", text[6:]
    raise ValueError(f"unknown version: {text!r}")


def chosen_version(original: bool = False, as_at: str | None = None, prospective: bool = False) -> tuple[str, str | None]:
    if original:
        return "original", None
    if as_at:
        return "point-in-time", as_at
    return ("prospective" if prospective else "latest"), None


def suffix(kind: str, date: str | None) -> str:
    return "/enacted" if kind == "original" else f"/{date}" if kind == "point-in-time" and date else ""


def work_url(w: Column, part: str = "") -> Column:
    return F.concat(F.lit(f"{fixed.WORKS_SITE}{part}/"), w["work_type"], F.lit("/"), w["year"].cast("string"), F.lit("/"), w["number"])


def work_citation(w: Column) -> Column:
    number, year = w["number"], w["year"].cast("string")
    kind = w["work_type"]
    tail = (
        F.when(kind.isin("ukpga", "ukla"), F.concat(F.lit(" (c. "), number, F.lit(")")))
        .when(kind.isin("uksi", "ssi", "nisr", "wsi"), F.concat(F.lit(" ("), F.try_element_at(table(CODES), kind), F.lit(" "), year, F.lit("/"), number, F.lit(")")))
        .when(kind.isin("asp", "anaw", "asc", "nia"), F.concat(F.lit(" ("), kind, F.lit(" "), number, F.lit(")")))
        .otherwise("")
    )
    return F.concat(w["title"], tail)


def case_citation(c: Column) -> Column:
    neutral = F.when(c["neutral"].isNotNull(), neutral_text(c["neutral"]))
    cites = F.filter(F.array(neutral, F.get(c["reports"], 0)), lambda x: x.isNotNull())
    shown = F.array_join(cites, ", ")
    return F.when(F.coalesce(c["name"] == F.get(cites, 0), F.lit(False)), shown).otherwise(F.trim(F.concat_ws(" ", c["name"], shown)))


def label(p: Column) -> Column:
    subs = F.array_join(F.transform(p["subdivisions"], lambda s: F.concat(F.lit("("), s, F.lit(")"))), "")
    end = F.when(p["end_number"].isNotNull(), F.concat(F.lit(" to "), p["end_number"])).otherwise("")
    return F.concat(p["kind"], F.lit(" "), p["number"], subs, end)


def labels(chain: Column) -> Column:
    return F.array_join(F.transform(chain, label), ", ")


def targets(chain: Column) -> Column:
    """What a pinpoint addresses: the most specific provisions. Only schedules lead a path."""

    def rank(p: Column) -> Column:
        return F.coalesce(F.try_element_at(table(fixed.RANKS), p["kind"]), F.lit(9))

    def deepest(rows: Column) -> Column:
        return let(F.array_max(F.transform(rows, rank)), lambda top: F.filter(rows, lambda p: rank(p) == top))

    def path(rows: Column) -> Column:
        return F.flatten(F.transform(rows, lambda p: F.array(p["kind"], p["number"])))

    def build(parts: Column) -> Column:
        schedules, leaves = parts["schedules"], parts["leaves"]
        only = (F.size(leaves) == 0) & (F.size(schedules) > 0)
        before = F.when(only, F.slice(schedules, F.lit(1), F.greatest(F.size(schedules) - 1, F.lit(0)))).otherwise(schedules)
        ends = F.when(F.size(leaves) > 0, deepest(leaves)).when(only, F.slice(schedules, -1, 1)).otherwise(deepest(chain))
        return F.transform(ends, lambda p: F.struct(F.concat(path(before), F.array(p["kind"], p["number"])).alias("path"), p["subdivisions"].alias("subdivisions")))

    parts = F.struct(
        F.filter(chain, lambda p: p["kind"] == "schedule").alias("schedules"),
        F.filter(chain, lambda p: ~p["kind"].isin(*fixed.CONTAINERS)).alias("leaves"),
    )
    return F.when(F.size(chain) > 0, let(parts, build)).otherwise(empty(f"array<{TARGET}>")).cast(f"array<{TARGET}>")


def work_search(title: Column, year: Column) -> Column:
    parts = F.array(F.when(title != "", F.concat(F.lit("title="), query(title))), F.when(year != 0, F.concat(F.lit("year="), year.cast("string"))))
    asked = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "&")
    return F.concat(F.lit(f"{fixed.WORKS_SITE}/all"), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))


def work_links(work: Column, chain: Column, title: Column, year: Column, kind: str = "latest", date: str | None = None) -> Column:
    """struct(url, id_uri, urls) of a resolved work, or a search page."""
    end = suffix(kind, date)

    def url(t: Column) -> Column:
        mark = F.when(F.size(t["subdivisions"]) > 0, F.concat(F.lit("#"), F.array_join(F.concat(t["path"], t["subdivisions"]), "-"))).otherwise("")
        return F.concat(work_url(work), F.lit("/"), F.array_join(t["path"], "/"), F.lit(end), mark)

    def uri(t: Column) -> Column:
        return F.concat(work_url(work, "/id"), F.lit("/"), F.array_join(F.concat(t["path"], t["subdivisions"]), "/"))

    def found(ts: Column) -> Column:
        whole = F.concat(work_url(work), F.lit(end))
        urls = F.when(F.size(ts) > 0, F.transform(ts, url)).otherwise(F.array(whole))
        ids = F.when(F.size(ts) > 0, uri(F.get(ts, 0))).otherwise(work_url(work, "/id"))
        return F.struct(F.get(urls, 0).alias("url"), ids.alias("id_uri"), urls.alias("urls"))

    nothing = F.struct(work_search(title, year).alias("url"), F.lit(None).cast("string").alias("id_uri"), empty("array<string>").alias("urls"))
    return F.when(work.isNull(), nothing).otherwise(let(targets(chain), found))


def judgment_link(n: Column) -> Column:
    """struct(url, source) of a neutral citation; nulls if no page is known."""
    code = n["court"]
    first = F.try_element_at(table({c[0]: c[1] for c in fixed.COURTS if c[1]}), code)
    second = F.try_element_at(table({c[0]: c[2] for c in fixed.COURTS if c[2]}), code)
    divisions = F.create_map(*[x for c in fixed.COURTS for x in (F.lit(c[0]), F.array(*[F.lit(d) for d in c[3]]).cast("array<string>"))])
    needed = code.isin(*[c[0] for c in fixed.COURTS if c[4]])
    division = n["division"]
    path = F.when(division.isNull(), F.when(~needed, first)).when(F.array_contains(F.try_element_at(divisions, code), division), F.concat(first, F.lit("/"), F.lower(division)))
    year, number = n["year"].cast("string"), n["number"]
    one = F.when(n["year"] >= fixed.NEUTRAL_SINCE, F.concat(F.lit(f"{fixed.CASES_SITE}/"), path, F.lit("/"), year, F.lit("/"), number))
    page = F.replace(F.replace(second, F.lit("{year}"), year), F.lit("{number}"), number)
    two = F.when(~needed & division.isNull(), F.concat(F.lit(f"{fixed.CASES_SITE_2}/"), page))
    return F.struct(F.coalesce(one, two).alias("url"), F.when(one.isNotNull(), "tna").when(two.isNotNull(), "bailii").alias("source"))


def held_by_primary(n: Column) -> Column:
    return n["court"].isin(*[c[0] for c in fixed.COURTS if c[1]])


def case_search(text: Column) -> Column:
    return F.concat(F.lit(f"{fixed.CASES_SITE}/search?query="), query(text))
