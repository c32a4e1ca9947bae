"""Registers that change, their look-ups and files; fuzzy joins; antecedents; postings."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import fixed
from lexweave.functions.similarity import ratio
from lexweave.operators import fuzzy, resolve
from lexweave.operators.resolve import Settings, match_works, search_cases, search_works
from lexweave.plans import pipeline
from lexweave.sources import registry
from lexweave.sources.registry import Registers, read_cases, read_works

WORK = "id string, title string, year int, work_type string, number string, aliases array<string>"
CASE = "id string, name string, neutral string, reports array<string>, aliases array<string>"


def _works(spark, *rows):
    return spark.createDataFrame([(own[0] if own else None, t, y, k, n, list(a)) for t, y, k, n, a, *own in rows], WORK)


def _cases(spark, *rows):
    return spark.createDataFrame([(None, name, neutral, list(r), list(a)) for name, neutral, r, a in rows], CASE)


@pytest.fixture(scope="module")
def small(spark):
    works = _works(
        spark, ("Theft Act", 1968, "ukpga", "60", ["TA"]), ("Fraud Act", 2006, "ukpga", "35", ["FA", "the Fraud"]), ("Finance Act", 2006, "ukpga", "25", ["FA"]),
        ("Theft Act", 1978, "ukpga", "31", []), ("Roads Regulations", 2006, "uksi", "35", []), ("Fishing Act", 2010, "ukpga", "1", ["FA"]),
        ("Parks Act", 2001, "ukpga", "7", [], "parks"), ("Lakes Act", 2001, "ukpga", "7", [], "lakes"),
    )
    cases = _cases(spark, ("Smith v Jones", "[2010] UKSC 5", ["[2011] 1 AC 3"], ["Re Smith"]), ("Brown v Green", None, ["[1990] 2 AC 7"], []), ("Smith v Jones", "[2012] UKSC 9", [], []), ("Black v White", None, ["[2011] 2 AC 3"], []))
    return Registers.from_entries([works], [cases])


def _ids(df):
    return [r.id for r in df.collect()]


def test_lookups_by_key(small):
    assert _ids(small.by_number(2006, "35")) == ["ukpga-2006-35", "uksi-2006-35"] and _ids(small.by_number(2006, "35", "uksi")) == ["uksi-2006-35"]
    assert _ids(small.by_title("The Theft Act")) == ["ukpga-1968-60", "ukpga-1978-31"] and _ids(small.by_title("theft act", 1978)) == ["ukpga-1978-31"]
    assert _ids(small.by_title("Theft Order", 1968)) == ["ukpga-1968-60"] and _ids(small.by_title("Nothing", 1968)) == []
    assert _ids(small.by_alias("the FA")) == ["ukpga-2006-35", "ukpga-2006-25", "ukpga-2010-1"] and _ids(small.by_year(1978)) == ["ukpga-1978-31"]
    assert _ids(small.by_neutral("[2010] uksc 5".upper())) == ["uksc-2010-5"] and _ids(small.by_name("Smith and another v. Jones")) == ["uksc-2010-5", "uksc-2012-9"]
    assert len(_ids(small.by_report("[2011] 1 AC 3"))) == 1 and len(_ids(small.by_report("[2011] AC 3"))) == 0 and len(_ids(small.by_report("[2011] AC 3", any_volume=True))) == 2
    assert _ids(small.work("ukpga-2006-25")) == ["ukpga-2006-25"] and _ids(small.case("uksc-2012-9")) == ["uksc-2012-9"] and _ids(small.work("none")) == []
    assert [r.title for r in small.list_works(2006, 2).collect()] == ["Finance Act", "Fraud Act"] and small.list_cases().count() == 4
    assert small.sizes().first() == (8, 4)


def test_add_merges_works_and_replaces_cases(spark, small):
    more = small.add(
        _works(spark, ("Another title", 1968, "ukpga", "60", ["TA", "Thieving"]), ("New Act", 2020, "ukpga", "1", [])),
        _cases(spark, ("Renamed v Jones", "[2010] UKSC 5", ["[2015] 1 AC 9"], [])),
    )
    theft = more.work("ukpga-1968-60").first()
    assert theft.title == "Theft Act" and theft.aliases == ["TA", "Thieving"] and more.sizes().first() == (9, 4)
    assert _ids(more.by_alias("Thieving")) == ["ukpga-1968-60"] and _ids(more.by_title("Another title")) == []
    assert _ids(more.by_name("Renamed v Jones")) == ["uksc-2010-5"] and _ids(more.by_name("Re Smith")) == [] and _ids(more.by_report("[2011] 1 AC 3")) == []
    assert small.sizes().first() == (8, 4)


def test_register_files(spark, small, tmp_path, monkeypatch):
    (tmp_path / "w.json").write_text(json.dumps({"works": [{"title": "Swans Act", "year": 1999, "work_type": "ukpga", "number": "4"}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"name": "Up v Down", "neutral": "[2001] UKHL 3", "reports": []}]))
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "No way", "reports": []}]))
    assert read_works(spark, str(tmp_path / "w.json")).first().title == "Swans Act" and read_cases(spark, str(tmp_path / "c.json")).first().name == "Up v Down"
    monkeypatch.setenv(registry.WORKS_VARIABLE, str(tmp_path / "w.json"))
    monkeypatch.setenv(registry.CASES_VARIABLE, str(tmp_path / "c.json"))
    found = Registers.default(spark)
    assert found.sizes().first() == (179, 11) and _ids(found.by_title("Swans Act", 1999)) == ["ukpga-1999-4"]
    with pytest.raises(Exception, match="not a usable case"):
        Registers.load(spark, cases=[str(tmp_path / "bad.json")])
    again = json.loads(registry.write_json(small.list_works(limit=100), "works"))
    assert len(again["works"]) == 8


TEXTS = {
    "several of a number": "The Lake Act 2001 (c. 7) applies.",
    "direct alias": "See the Fraud Act 2006 and s 2 of FA.",
    "alias alone": "TA governs.",
    "fuzzy name": "As in Smyth v Jones [1990] 1 WLR 1, costs follow.",
    "fuzzy case": "As in Browne v Green [1990] 9 WLR 1, costs follow.",
    "two of a name": "The rule in Smith v Jones holds.",
    "report by volume": "It was said at [2011] AC 3.",
    "ambiguous title": "the Theft Act applies; the Theft Act 1968 too.",
    "unresolved with candidates": "the Thefts Acte Order 2006",
    "no antecedent of year": "The 2006 Act is meant.",
}


def _resolved(spark, registers, settings=Settings()):
    r = pipeline.resolve(spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string"), registers, settings)
    works = sorted((c.doc_id, c.ord, c.surface, c.work.id if c.work else None, c.method, c.confidence, tuple(x.id for x in c.candidates), tuple(c.notes)) for c in r.citations.collect())
    cases = sorted((c.doc_id, c.ord, c.surface, c.case.id if c.case else "", c.method, c.confidence, tuple(x.id for x in c.candidates), tuple(c.notes)) for c in r.cases.collect())
    r.release()
    return works, cases


def test_rungs(spark, small):
    works, cases = _resolved(spark, small)
    by_doc = {(w[0], w[1]): w for w in works}
    number = by_doc["several of a number", 0]
    assert number[3:6] == ("lakes", "number", 0.97) and number[7] == ("several works share that number",)
    assert [w[4] for w in works if w[0] == "direct alias"][-1] == "alias" and by_doc["alias alone", 0][3:6] == ("ukpga-1968-60", "alias", 0.88)
    year = by_doc["no antecedent of year", 0]
    assert year[4] == "unresolved" and year[6] == ("ukpga-2006-35", "ukpga-2006-25", "uksi-2006-35") and year[7] == ("no work from 2006 mentioned earlier",)
    found = {c[0]: c for c in cases}
    assert found["fuzzy case"][3:5] == (found["fuzzy case"][3], "fuzzy") and found["fuzzy case"][5] == ratio("browne v green", "brown v green")
    assert found["two of a name"][4] == "unresolved" and set(found["two of a name"][6]) == {"uksc-2010-5", "uksc-2012-9"}
    assert found["report by volume"][4] == "unresolved" and len(found["report by volume"][6]) == 2


def test_large_registers_give_the_same(spark, small, monkeypatch):
    """No literal of keys, no literal tables: candidates meet the index in a join."""
    want = _resolved(spark, small)
    monkeypatch.setattr(registry, "LITERAL_KEYS", 1)
    monkeypatch.setattr(registry, "LITERAL_ROWS", 2)
    monkeypatch.setattr(fuzzy, "POOL_BLOCK", 2)
    large = Registers.of(registry.works_of(small.entries[0]), registry.cases_of(small.entries[1]))
    assert large.names is None and large.aliases is None
    assert _resolved(spark, large) == want


# --- fuzzy joins -------------------------------------------------------------

NOUNS = ["data", "protection", "companies", "finance", "housing", "land", "reform", "employment", "rights", "health", "safety", "water", "industry", "criminal", "justice", "café", "no 2"]


def test_close_equals_the_full_product(spark):
    random.seed(8)
    titles = sorted({" ".join(random.choices(NOUNS, k=random.randint(1, 6))) + " act" for _ in range(1200)})
    pool = [(t, 1950 + i % 70, i) for i, t in enumerate(titles)]
    probes = []
    for i in range(60):
        t = list(random.choice(titles))
        for _ in range(random.randint(0, 4)):
            t[random.randrange(len(t))] = random.choice("abcdefg xé")
        probes.append(("".join(t).strip(), random.choice([None, 1950 + i % 90])))
    blocks = fuzzy.blocks_of(spark.createDataFrame(pool, "key string, year int, ref long"), 100)
    for cutoff, cross in ((0.6, 0.75), (0.86, 1.0)):
        found = {(r.key, r.year, r.ref): (r.score, r.same) for r in fuzzy.close(spark.createDataFrame(probes, "key string, year int").distinct(), blocks, cutoff, cross).collect()}
        want = {}
        for key, year in set(probes):
            for title, of, ref in pool:
                weight = 1.0 if year is None or year == of else cross
                if (score := ratio(key, title) * weight) >= cutoff:
                    want[key, year, ref] = (score, year == of)
        assert found == want
    plan = fuzzy.close(spark.createDataFrame(probes, "key string, year int"), blocks, 0.6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (bucket" in plan and "Cartesian" not in plan


def test_bounds_never_lie_below_the_ratio():
    random.seed(9)
    for _ in range(3000):
        a, b = ("".join(random.choices("abc d", k=random.randint(1, 14))) for _ in range(2))
        assert fuzzy.possible(a, b, ratio(a, b))


def test_search_order(spark, small):
    probes = spark.createDataFrame([("theft act", None), ("theft act", 1978), ("theft act", 1900), ("", 1978)], "norm string, year int")
    found = {(r.norm, r.year): [(x.work.id, round(x.score, 3)) for x in r.found] for r in search_works(probes, small, 0.3, 5).collect()}
    assert [i for i, _ in found["theft act", None]][:2] == ["ukpga-1978-31", "ukpga-1968-60"] and len(found["theft act", None]) == 5
    assert found["theft act", 1978] == [("ukpga-1978-31", 1.0)] and found["theft act", 1900][0] == ("ukpga-1978-31", 0.75) and ("", 1978) not in found
    named = {r.key: [(x.case.id, x.score) for x in r.found] for r in search_cases(spark.createDataFrame([("smith v jones",), ("re smith",)], "key string"), small, 0.9).collect()}
    assert named["smith v jones"] == [("uksc-2010-5", 1.0), ("uksc-2012-9", 1.0)] and named["re smith"] == [("uksc-2010-5", 1.0)]


# --- antecedents -------------------------------------------------------------


def _folded(citations):
    """Methods and works of one document's citations, read with all works that were seen."""
    seen, out = [], []
    for kind, value in citations:
        last = lambda test=lambda w: True: next((w for w in reversed(seen) if test(w)), None)  # noqa: B023, E731
        acts, sis = (lambda w: w[1] in fixed.ACT_TYPES), (lambda w: w[1] in fixed.SI_TYPES)
        if kind == "direct":
            found = value
        elif kind == "year":
            found = last(lambda w: w[0] == value)  # noqa: B023
        elif kind == "bare":
            found = last()
        else:
            found = last(acts if kind == "act" else sis) or last()
        if found:
            seen.append(found)
        out.append(f"{found[1]}-{found[0]}-{found[2]}" if found else None)
    return out


def test_antecedents_in_long_documents(spark, small):
    random.seed(10)
    pool = [(2001 + i, "ukpga", str(i + 1)) for i in range(5)] + [(2001 + i, "uksi", str(i + 90)) for i in range(5)]
    docs, want = [], {}
    for d in range(6):
        text, cites = [], []
        for _ in range(400 if d == 0 else 40):
            kind = random.choice(["direct", "direct", "year", "act", "si", "bare"])
            year, type_, number = work = random.choice(pool)
            said = {
                "direct": f"The Made Up Act {year} (c. {number}) counts." if type_ == "ukpga" else f"SI {year}/{number} counts.",
                "year": f"The {year} Act counts.", "act": "The Act counts.", "si": "The Regulations count.", "bare": "Section 5 counts.",
            }[kind]
            text.append(said)
            cites.append((kind, work if kind == "direct" else year))
        docs.append((d, " And so. ".join(text)))
        want[d] = _folded(cites)
    docs.append((7, docs[0][1]))
    want[7] = want[0]
    registers = Registers.from_entries([_works(spark, ("Nothing Act", 1900, "ukpga", "1", []))], [_cases(spark, ("A v B", "[2000] UKHL 1", [], []))])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        r = pipeline.resolve(spark.createDataFrame(docs, "doc_id int, text string"), registers)
        found = {}
        for c in r.citations.orderBy("doc_id", "ord").collect():
            found.setdefault(c.doc_id, []).append(c.work.id if c.work else None)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == want


# --- postings and streams ----------------------------------------------------


def test_postings_in_blocks(spark, small, monkeypatch, tmp_path):
    monkeypatch.setattr(pipeline, "POSTINGS", 7)
    docs = spark.createDataFrame([(i, f"See section {i % 3} of the Theft Act 1968 and section 9 of the Theft Act 1968." if i % 4 else "The Fraud Act 2006.") for i in range(60)], "doc_id int, text string")
    r = pipeline.resolve(docs.repartition(5), small)
    rows = sorted((x for x in pipeline.cited_by(r).collect() if x.id == "ukpga-1968-60"), key=lambda x: x.block)
    assert [x.block for x in rows] == list(range(7)) and [len(x.documents) for x in rows] == [7] * 6 + [3]
    assert [(d.doc_id, d.place) for x in rows for d in x.documents] == [(i, n) for n, i in enumerate(i for i in range(60) if i % 4)]
    assert rows[0].documents[0].pinpoints == ["section 1", "section 9"] and rows[0].documents[0].n == 2
    assert [(w.id, w.mentions, w.documents, w.blocks) for w in pipeline.cited_works(r).collect()] == [("ukpga-1968-60", 90, 45, 7), ("ukpga-2006-35", 15, 15, 3)]
    pipeline.write_index(r, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index" / "works")).count() == 2 and spark.read.json(str(tmp_path / "index" / "work_postings")).select(F.sum(F.size("documents"))).first()[0] == 60


def test_recurring_strings_are_compared_once(monkeypatch):
    calls = []
    monkeypatch.setattr(fuzzy, "ratio", lambda a, b: calls.append((a, b)) or ratio(a, b))
    keys, pool = ["theft act"] * 40 + ["fraud act"], ["thefts act"] * 300
    i, j, score, same = fuzzy.close_in(keys, [1900 + k for k in range(40)] + [None], pool, [1900 + k % 50 for k in range(300)], 0.9, 0.75)
    assert set(calls) == {("theft act", "thefts act")} and len(calls) == 1
    assert len(i) == 40 * 6 and same.all() and set(score) == {ratio("theft act", "thefts act")} and all(j % 50 == i)


def test_blocks_of_probes_are_dealt_over_tasks(spark):
    probes = spark.createDataFrame([(f"act {i} of {i * 7}", None) for i in range(200)], "key string, year int")
    blocks = fuzzy.blocks_of(spark.createDataFrame([("act 3 of 20", 1990, 1)], "key string, year int, ref long"), 100)
    assert fuzzy.close(probes, blocks, 0.6).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_works_are_made_when_asked_for(spark, small, monkeypatch):
    """What only asks for cases makes no register of works."""
    made, settled = [], registry.settled
    monkeypatch.setattr(registry, "settled", lambda df, *a: made.append(df.columns[1]) or settled(df, *a))
    found = Registers.from_entries(*small.entries)
    assert found.cases.count() == small.cases.count() and made == ["case"]
    assert found.works.count() == small.works.count() == found.works.count() and made == ["case", "work"]


def test_search_lists_the_first_of_many_works_of_a_title_and_year(spark):
    works = _works(spark, *[("Theft Act", 1968 + i % 2, "ukpga", str(i), []) for i in range(40)])
    found = Registers.from_entries([works], [_cases(spark, ("A v B", "[2010] UKSC 5", [], []))])
    assert sum(len(r["keys"]) for r in found.titles.collect()) == 10
    probes = spark.createDataFrame([("theft act", 1968)], "norm string, year int")
    for limit in (5, 12):
        listed = [x.work.number for x in search_works(probes, found, 0.6, limit).first().found]
        assert listed == [str(i) for i in range(0, 2 * limit, 2)]


def test_no_task_sees_a_whole_register(spark, small):
    """Load order without a window over all entries; indexes only when they are asked for."""
    for made in (registry.works_of([small.entries[0][0]] * 2), registry.cases_of([small.entries[1][0]] * 2)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SinglePartition" not in plan
    parts = [spark.createDataFrame([(None, f"T{p}", 2000, "ukpga", str(i), [f"a{p}"]) for i in range(50)], WORK).repartition(7) for p in range(3)]
    found = Registers.from_entries(parts, small.entries[1])
    assert {(r.work.title, tuple(r.work.aliases)) for r in found.works.collect()} == {("T0", ("a0", "a1", "a2"))}
    assert found.sizes().first() == (50, 4) and not {"work_lookups", "case_lookups", "titles", "case_names"} & set(vars(found))


def test_lookups_of_a_large_register_are_dealt(spark, small, monkeypatch):
    """The parts grow with the register, not what a task sorts; and look-ups that are dealt find the same."""
    works = _works(spark, *[("Theft Act", 1968 + i % 2, "ukpga", str(i), ["TA", f"A{i % 50}"]) for i in range(200)], ("Fraud Act", 2006, "ukpga", "35", []))
    made = registry.works_of([works]).persist()
    whole, dealt = (sorted(r for r in registry._work_lookups(made, parts).select("kind", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("year", F.lit(0)).alias("year"), "n", F.transform("works", lambda w: w["id"]).alias("ids")).collect()) for parts in (1, 9))
    assert whole == dealt and {(r.n, len(r.ids)) for r in whole if r.kind == "title"} == {(200, 5), (1, 1)}
    assert registry._work_lookups(made, 9).rdd.getNumPartitions() == 9 and [registry.parts_of(n) for n in (0, 1, 1_200_000, 7_200_000)] == [1, 1, 48, 288]
    want = _resolved(spark, small)
    monkeypatch.setattr(registry, "PART_WORKS", 2)
    monkeypatch.setattr(registry, "LITERAL_ROWS", 2)
    large = Registers.of(registry.works_of(small.entries[0]), registry.cases_of(small.entries[1]))
    assert large.parts == 4 and _resolved(spark, large) == want


def test_references_with_a_number_are_no_hot_key(spark, small):
    """Many numbers of one title: only the numbers are looked up, so the title is no key that one task gets."""
    refs = spark.createDataFrame([("Fraud Act", 2006, str(i), None) for i in range(200)], "title string, year int, number string, work_type string")
    keys = refs.select("*", F.lit("fraud act").alias("_norm"))
    met = resolve._looked_up(keys, keys, small, "title", "hit", "_norm", None, F.col("number") == "35")
    assert met.filter("hit is not null").select("number").collect() == [("35",)] and met.count() == 200
    assert met.columns == [*keys.columns, "hit"]
    found = match_works(refs, small).select("number", "match.work.id", "match.method", "match.confidence").collect()
    assert {tuple(r) for r in found} == {(str(i), f"ukpga-2006-{i}", "number", 1.0 if i == 35 else 0.95) for i in range(200)} - {("25", "ukpga-2006-25", "number", 0.95)} | {("25", "ukpga-2006-25", "number", 1.0)}


def test_documents_of_few_tasks_are_dealt_without_a_sort(spark):
    docs = spark.range(0, 4_000, 1, 1).select(F.lit(None).cast("string").alias("doc_id"), F.lit("the same").alias("text"))
    dealt = pipeline.spread(docs)
    assert "RoundRobinPartitioning" not in dealt._jdf.queryExecution().executedPlan().toString() and dealt.columns == docs.columns
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 4_000 and max(sizes) < 2 * min(sizes)
