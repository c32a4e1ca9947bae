"""Registers of works and cases as tables, with an index per lookup.

Registers may be of any size. An index has one row per key, with the number of entries
and the first few of them, so a year or an alias that many works have makes no large row.
A small table becomes a literal of known size, which Spark broadcasts; a large one is
written to the shared folder, so that its size is known too and joins shuffle it.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import alias_key, empty, name_key, report_key, title_key, title_stem
from ..operators.cases import NEUTRAL, neutral_text, parse_neutral, parse_report, report_text
from ..operators.fuzzy import POOL_BLOCK, blocks_of
from .storage import Held, kept, release

WORK = "struct<id:string,title:string,year:int,work_type:string,number:string,aliases:array<string>>"
CASE = f"struct<id:string,name:string,neutral:{NEUTRAL},reports:array<string>,aliases:array<string>>"
WORKS_VARIABLE, CASES_VARIABLE = "LEXWEAVE_WORKS", "LEXWEAVE_CASES"
#: Rows up to which a table becomes a literal; keys up to which extraction knows them as a literal.
LITERAL_ROWS, LITERAL_KEYS = 20_000, 5_000
#: Works of a part of a large register's look-ups.
PART_WORKS = 25_000
#: Entries of a key that an index lists (of numbers, all: a number has one per type).
LISTED = 5
#: What an acronym's key looks like.
ACRONYM_KEY = r"^[a-z][a-z0-9]{1,9}( [0-9]{4})?$"
_WORK_FILE = "id string, title string, year int, work_type string, number string, aliases array<string>"
_CASE_FILE = "id string, name string, neutral string, reports array<string>, aliases array<string>"


def _seed(name: str) -> list[list[str]]:
    lines = resources.files(__package__).joinpath(name).read_text("utf-8").splitlines()
    return [[part.strip() for part in line.split(" |")] for line in lines if line and not line.startswith("#")]


def _several(text: str) -> list[str]:
    return [x.strip() for x in text.split(";") if x.strip()]


def work_entries(spark: SparkSession) -> DataFrame:
    rows = [(None, title, int(year), kind, number, _several(aliases)) for year, kind, number, title, aliases in _seed("works.txt")]
    return spark.createDataFrame(rows, _WORK_FILE)


def case_entries(spark: SparkSession) -> DataFrame:
    rows = [(None, name, neutral or None, _several(reports), _several(aliases)) for name, neutral, reports, aliases in _seed("cases.txt")]
    return spark.createDataFrame(rows, _CASE_FILE)


def _from_file(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Entries of a JSON file: ``{key: [...]}`` or a bare list."""
    text = spark.read.text(path, wholetext=True)
    listed = f"array<struct<{', '.join(': '.join(c.split(' ', 1)) for c in schema.split(', '))}>>"
    bare = F.from_json("value", listed)
    inside = F.from_json(F.get_json_object("value", f"$.{key}"), listed)
    starts = F.trim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
    return text.select(F.explode(F.when(starts, bare).otherwise(inside)).alias("x")).select("x.*")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    return _from_file(spark, path, "works", _WORK_FILE)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return _from_file(spark, path, "cases", _CASE_FILE)


#: Bits of ``ord`` below the number of the part: a part may have 2**20 partitions of 2**33 rows, and there may be 2**10 parts.
ROW_BITS = 53


def _ordered(parts: list[DataFrame]) -> DataFrame:
    """The union with ``ord``, a long that grows in load order, with gaps: each row
    gets it where it lies, so no task sees a whole register."""
    if len(parts) > 1 << 10:
        raise ValueError("more than 1024 lists of entries")
    stacked = None
    for i, part in enumerate(parts):
        one = part.withColumn("ord", F.lit(i << ROW_BITS) + F.monotonically_increasing_id())
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked


def works_of(parts: list[DataFrame]) -> DataFrame:
    """works(ord, work, keys): entries of one id are merged - the first stands, its aliases grow."""
    entries = _ordered(parts)
    entries = entries.withColumn("id", F.coalesce("id", F.concat_ws("-", "work_type", F.col("year").cast("string"), "number")))
    rows = F.array_sort(F.collect_list(F.struct("ord", "title", "year", "work_type", "number", F.coalesce("aliases", empty("array<string>")).alias("aliases"))))
    merged = entries.groupBy("id").agg(rows.alias("rows"), F.max("ord").alias("ord"))
    first = F.get("rows", 0)
    work = F.struct("id", first["title"].alias("title"), first["year"].alias("year"), first["work_type"].alias("work_type"), first["number"].alias("number"), F.array_distinct(F.flatten(F.transform("rows", lambda r: r["aliases"]))).alias("aliases"))
    works = merged.select("ord", work.cast(WORK).alias("work"))
    return works.select("ord", "work", title_key(F.col("work.title")).alias("norm"), title_stem(F.col("work.title")).alias("stem"), F.transform("work.aliases", alias_key).alias("alias_keys"))


def case_id(n: Column) -> Column:
    return F.when(n.isNotNull(), F.concat_ws("-", F.replace(F.lower(n["court"]), F.lit(" "), F.lit("-")), F.lower(n["division"]), n["year"].cast("string"), F.lower(n["number"])))


def cases_of(parts: list[DataFrame]) -> DataFrame:
    """cases(ord, case, keys): of entries of one id the last stands. An entry
    without neutral citation, report and id raises, and so does one that can't be read."""
    entries = _ordered(parts).withColumn("n", parse_neutral(F.col("neutral")))
    entries = entries.withColumn("reports", F.coalesce("reports", empty("array<string>"))).withColumn("parsed", F.transform("reports", parse_report))
    wrong = (F.col("neutral").isNotNull() & F.col("n").isNull()) | F.exists("parsed", lambda r: r.isNull())
    nothing = F.col("neutral").isNull() & (F.size("reports") == 0) & F.col("id").isNull()
    parsed = F.transform("parsed", report_text)
    key = F.transform("parsed", lambda r: report_key(r["year"], r["volume"], r["series"], r["page"]))
    own = F.concat(F.lit("report-"), F.replace(F.replace(F.get("keys", 0), F.lit("|"), F.lit("-")), F.lit("--"), F.lit("-")))
    checked = (
        entries.withColumn("keys", key)
        .withColumn("id", F.when(wrong | nothing, F.raise_error(F.concat(F.lit("not a usable case: "), "name"))).otherwise(F.coalesce("id", case_id(F.col("n")), own)))
        .withColumn("case", F.struct("id", "name", F.col("n").alias("neutral"), parsed.alias("reports"), F.coalesce("aliases", empty("array<string>")).alias("aliases")).cast(CASE))
    )
    loose = F.transform("parsed", lambda r: report_key(r["year"], F.lit("*"), r["series"], r["page"]))
    names = F.transform(F.concat(F.array("name"), "case.aliases"), name_key)
    rows = checked.select("ord", "case", "keys", loose.alias("loose"), names.alias("names"), F.lower(neutral_text(F.col("n"))).alias("neutral_key"))
    last = rows.groupBy("case.id").agg(F.max_by(F.struct(*rows.columns), "ord").alias("r"))
    return last.select("r.*")


def settled(df: DataFrame, weight: Column | None = None) -> DataFrame:
    """``df``, computed once, as a table whose size planning knows. ``weight``: for how many entries a row counts."""
    held: Held = []
    whole = kept(df, held)
    if whole.agg(F.coalesce(F.sum(weight if weight is not None else F.lit(1)), F.lit(0))).first()[0] > LITERAL_ROWS:
        return whole
    first = whole.toArrow()
    release(held)
    return df.sparkSession.createDataFrame(first, df.schema)


def parts_of(works: int) -> int:
    """Into how many parts the look-ups of so many works are dealt, so that none grows with the register."""
    return max(1, -(-works // PART_WORKS))


def _work_lookups(works: DataFrame, parts: int = 1) -> DataFrame:
    """kind, key, year, n, works: how many works a key has, and the first of them in load order.

    Keys are sorted by the work's place alone; works join those that are listed. A large
    register is dealt over ``parts``, as what a task sorts would else grow with it."""
    year = F.col("year")
    none = F.lit(None).cast("int")

    def one(kind: str, key: Column, at: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), at.alias("year"))

    def deal(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(parts, *by) if parts > 1 else df

    every = F.array(one("number", F.col("number"), year), one("title_year", F.col("norm"), year), one("stem_year", F.col("stem"), year), one("title", F.col("norm"), none), one("year", F.lit(""), year))
    aliases = F.flatten(F.transform("alias_keys", lambda a: F.array(one("alias", a, none), one("alias_year", a, year))))
    keyed = deal(works.select("ord", "work.number", "work.year", "norm", "stem", "alias_keys"), "ord")
    rows = keyed.select("ord", F.explode(F.concat(every, aliases)).alias("k")).select("ord", "k.*")
    key = ["kind", "key", "year"]
    place = Window.partitionBy(*key).orderBy("ord")
    first = rows.filter("kind <> 'number'").withColumn("place", F.row_number().over(place)).filter(F.col("place") <= LISTED).drop("place")
    listed = deal(first.unionByName(rows.filter("kind = 'number'")), "ord").join(deal(works.select("ord", "work"), "ord"), "ord")
    # counts come as rows of their own, so that lists and counts need one shuffle and no join
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.lit(None).cast(f"struct<ord:bigint,work:{WORK}>"))
    both = listed.select(*key, F.lit(0).cast("long").alias("n"), F.struct("ord", "work").alias("row")).unionByName(counts)
    met = deal(both, *key).groupBy(*key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("row")).alias("rows"))
    return met.select(*key, "n", F.transform("rows", lambda r: r["work"]).alias("works"))


def _case_lookups(cases: DataFrame) -> DataFrame:
    """kind, key, cases in load order; of a neutral citation, the last."""
    def some(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    neutral = F.filter(F.array("neutral_key"), lambda k: k != "")
    keys = F.concat(some("strict", F.col("keys")), some("loose", F.col("loose")), some("name", F.col("names")), some("neutral", neutral))
    rows = cases.select("ord", "case", F.explode(keys).alias("k")).select("ord", "case", "k.*")
    listed = rows.filter("kind <> 'neutral'").groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("ord", "case")), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("rows"))
    listed = listed.select("kind", "key", F.transform("rows", lambda r: r["case"]).alias("cases"))
    return listed.unionByName(rows.filter("kind = 'neutral'").groupBy("kind", "key").agg(F.array(F.max_by("case", "ord")).alias("cases")))


def _literal(keys: DataFrame) -> list[str] | None:
    rows = keys.limit(LITERAL_KEYS + 1).collect()
    return None if len(rows) > LITERAL_KEYS else sorted(r[0] for r in rows)


@dataclass
class Registers:
    """The registers that documents are resolved against. Works and indexes are made when they are
    first asked for, cases at once, since an entry may be unusable; ``aliases`` and ``names`` are the keys that extraction looks for, None if they
    are too many for a literal: extraction then joins its candidates with the index."""

    make_works: Callable[[], DataFrame]
    cases: DataFrame
    #: what ``from_entries`` was given, by which ``add`` goes on
    entries: tuple[list[DataFrame], list[DataFrame]] | None = None

    @staticmethod
    def of(works: DataFrame, cases: DataFrame) -> Registers:
        return Registers(lambda: settled(works), settled(cases))

    @cached_property
    def works(self) -> DataFrame:
        return self.make_works()

    @cached_property
    def parts(self) -> int:
        """Into how many parts what is made of the works is dealt."""
        return parts_of(self.works.count())

    @cached_property
    def work_lookups(self) -> DataFrame:
        return settled(_work_lookups(self.works, self.parts))

    @cached_property
    def case_lookups(self) -> DataFrame:
        return settled(_case_lookups(self.cases))

    @cached_property
    def aliases(self) -> list[str] | None:
        # only these can be found in a text without a definition
        return _literal(self.work_lookups.filter((F.col("kind") == "alias") & F.col("key").rlike(ACRONYM_KEY)).select("key"))

    @cached_property
    def names(self) -> list[str] | None:
        return _literal(self.case_lookups.filter("kind = 'name'").select("key"))

    def titles_of(self, limit: int) -> DataFrame:
        """Blocks of titles for a search of the first ``limit``. Works of one title and year
        score alike, and the first of them by title and load order are all that it can list."""
        place = Window.partitionBy("norm", "work.year").orderBy("work.title", "ord")
        works = self.works.select("norm", "work", "ord")
        works = works.repartition(self.parts, "ord") if self.parts > 1 else works
        first = works.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= limit)
        return settled(blocks_of(first.select(F.col("norm").alias("key"), F.col("work.year").alias("year"), F.col("ord").alias("ref")), POOL_BLOCK), F.size("keys"))

    @cached_property
    def titles(self) -> DataFrame:
        return self.titles_of(fixed.SEARCH_LIMIT)

    @cached_property
    def case_names(self) -> DataFrame:
        called = self.cases.select("ord", F.explode(F.array_distinct("names")).alias("key"))
        return settled(blocks_of(called.select("key", F.lit(None).cast("int").alias("year"), F.col("ord").alias("ref")), POOL_BLOCK), F.size("keys"))

    def work_index(self, kind: str) -> DataFrame:
        """key, year, n, works of one kind of lookup."""
        return self.work_lookups.filter(F.col("kind") == kind).drop("kind")

    def case_index(self, kind: str) -> DataFrame:
        return self.case_lookups.filter(F.col("kind") == kind).drop("kind")

    @staticmethod
    def from_entries(works: list[DataFrame], cases: list[DataFrame]) -> Registers:
        """Of entries as in register files, in load order."""
        found = Registers.of(works_of(works), cases_of(cases))
        found.entries = (works, cases)
        return found

    def add(self, works: DataFrame | None = None, cases: DataFrame | None = None) -> Registers:
        """Registers with further entries, as if loaded last: a work that is there already keeps
        its fields and gains aliases; a case that is there already is replaced, keys included."""
        if self.entries is None:
            raise ValueError("these registers were not made from entries")
        mine, theirs = self.entries
        return Registers.from_entries([*mine, *([works] if works is not None else [])], [*theirs, *([cases] if cases is not None else [])])

    @staticmethod
    def load(spark: SparkSession, works: list[str] = (), cases: list[str] = (), seed: bool = True) -> Registers:
        """The seed and the files named, in order."""
        parts = ([work_entries(spark)] if seed else []) + [read_works(spark, p) for p in works]
        more = ([case_entries(spark)] if seed else []) + [read_cases(spark, p) for p in cases]
        return Registers.from_entries(parts or [spark.createDataFrame([], _WORK_FILE)], more or [spark.createDataFrame([], _CASE_FILE)])

    @staticmethod
    def default(spark: SparkSession) -> Registers:
        named = [[p.strip() for p in os.environ.get(v, "").split(os.pathsep) if p.strip()] for v in (WORKS_VARIABLE, CASES_VARIABLE)]
        return Registers.load(spark, *named)

    def work(self, work_id: str) -> DataFrame:
        return self.works.filter(F.col("work.id") == work_id).select("work.*")

    def case(self, case_id_: str) -> DataFrame:
        return self.cases.filter(F.col("case.id") == case_id_).select("case.*")

    # --- lookups by key: works or cases in load order ---

    def _works_by(self, keep: Column) -> DataFrame:
        return self.works.filter(keep).orderBy("ord").select("work.*")

    def _cases_by(self, keep: Column) -> DataFrame:
        return self.cases.filter(keep).orderBy("ord").select("case.*")

    def by_number(self, year: int, number: str, work_type: str | None = None) -> DataFrame:
        hit = (F.col("work.year") == year) & (F.col("work.number") == str(number))
        return self._works_by(hit & (F.col("work.work_type") == work_type) if work_type else hit)

    def by_title(self, title: str, year: int | None = None) -> DataFrame:
        """Of a year, works of that title, else of its stem; without, of any year."""
        norm, stem = title_key(F.lit(title)), title_stem(F.lit(title))
        if year is None:
            return self._works_by(F.col("norm") == norm)
        of_year = self.works.filter(F.col("work.year") == year)
        exact = of_year.agg(F.coalesce(F.bool_or(F.col("norm") == norm), F.lit(False)).alias("exact"))  # one row
        hits = of_year.crossJoin(F.broadcast(exact)).filter(F.when(F.col("exact"), F.col("norm") == norm).otherwise(F.col("stem") == stem))
        return hits.orderBy("ord").select("work.*")

    def by_alias(self, alias: str) -> DataFrame:
        return self._works_by(F.array_contains("alias_keys", alias_key(F.lit(alias))))

    def by_year(self, year: int) -> DataFrame:
        return self._works_by(F.col("work.year") == year)

    def by_neutral(self, text: str) -> DataFrame:
        """The last case of a neutral citation."""
        return self._cases_by(F.col("neutral_key") == F.lower(neutral_text(parse_neutral(F.lit(text))))).limit(1) if text else self._cases_by(F.lit(False))

    def by_report(self, text: str, any_volume: bool = False) -> DataFrame:
        r = parse_report(F.lit(text))
        key = report_key(r["year"], F.lit("*") if any_volume else r["volume"], r["series"], r["page"])
        return self._cases_by(F.array_contains("loose" if any_volume else "keys", key))

    def by_name(self, name: str) -> DataFrame:
        return self._cases_by(F.array_contains("names", name_key(F.lit(name))))

    def list_works(self, year: int | None = None, limit: int = 20) -> DataFrame:
        rows = self.works if year is None else self.works.filter(F.col("work.year") == year)
        return rows.select("work.*").orderBy("year", "title").limit(limit)

    def list_cases(self, limit: int = 20) -> DataFrame:
        return self.cases.select("case.*").orderBy(F.coalesce("neutral.year", F.lit(0)), "name").limit(limit)

    def sizes(self) -> DataFrame:
        return self.works.agg(F.count(F.lit(1)).alias("works")).crossJoin(self.cases.agg(F.count(F.lit(1)).alias("cases")))


def courts(spark: SparkSession) -> DataFrame:
    rows = [(code, first, second, list(divisions), needed) for code, first, second, divisions, needed in fixed.COURTS]
    return spark.createDataFrame(rows, "code string, primary_path string, secondary_page string, divisions array<string>, division_required boolean")


def write_json(df: DataFrame, key: str) -> str:
    """A register's entries as the text of a register file."""
    return json.dumps({key: [r.asDict(recursive=True) for r in df.collect()]})


