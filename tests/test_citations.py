"""Fixtures of extraction, resolution, links, annotation and the citator, resolved as one table."""

import pytest

from lexweave.operators.links import chosen_version, suffix, version
from lexweave.plans import pipeline, suite
from lexweave.sources.registry import Registers

TEXTS = {
    "act": "the Human Rights Act 1998 applies",
    "scot": "Land Reform (Scotland) Act 2003 (asp 2)",
    "comma": "Copyright, Designs and Patents Act 1988",
    "short": 'the Data Protection Act 2018 ("the DPA"). Section 45 of the DPA is engaged.',
    "number": "the Theft Act 1968 (c. 60)",
    "made": "the Fictional Widgets Act 1911 (c. 7)",
    "typo": "the Data Protecton Act 2018",
    "none": "The EU and the USA disagreed.",
    "wrong": "the Human Rights Act 1066",
    "wrap": "the Public Interest Disclosure Act 1998,\n    ss 1-3",
    "apart": "the Theft Act 1968\n\n    section 1 is engaged",
    "nested": "paragraph 4 of Schedule 2 to the Companies Act 2006",
    "subs": "section 45(2)(a) of the Human Rights Act 1998",
    "miller": "See R (Miller) v Prime Minister [2019] UKSC 41, [2020] AC 373 at [30]-[35].",
    "re": "In Re B (A Child) [2013] UKSC 33 the court held.",
    "two": "Smith v Jones [2018] EWCA Civ 1, [2019] UKSC 2.",
    "alone": "Following Patel v Mirza and Montgomery v Lanarkshire Health Board, the Brexit v Remain debate.",
    "report": "Smith v Jones [1996] Ch 1, at para 45, and the Human Rights Act 1998.",
    "brind": "R v Secretary of State for the Home Department, ex p. Brind [1991] 1 AC 696.",
    "one subdivision": "section 45(1) of the Human Rights Act 1998",
    "far": "Smith v Jones [2018] EWCA Civ 1 at" + " " * 600 + "[12], and so on.",
    "empty": "",
    "null": None,
}
SITE = "https://www.legislation.gov.uk"


@pytest.fixture(scope="module")
def resolved(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    r = pipeline.resolve(docs, Registers.load(spark))
    cites, cases = {k: [] for k in TEXTS}, {k: [] for k in TEXTS}
    for c in r.citations.orderBy("doc_id", "ord").collect():
        cites[c.doc_id].append(c)
    for c in r.cases.orderBy("doc_id", "ord").collect():
        cases[c.doc_id].append(c)
    return r, cites, cases


def test_offsets_are_those_of_the_text(resolved):
    for rows in resolved[1:]:
        for name, found in rows.items():
            for c in found:
                assert TEXTS[name][c.start : c.end] == c.surface


def test_works(resolved):
    cites = resolved[1]
    first = {k: (v[0].work.id if v[0].work else None, v[0].method) for k, v in cites.items() if v}
    assert first["act"] == ("ukpga-1998-42", "exact")
    assert first["scot"][0] == "asp-2003-2"
    assert first["number"] == ("ukpga-1968-60", "number")
    assert first["made"] == ("ukpga-1911-7", "number")
    assert first["typo"] == ("ukpga-2018-12", "fuzzy")
    assert first["wrong"] == (None, "unresolved")
    assert [c.method for c in cites["short"]] == ["exact", "short-form", "short-form"]
    assert cites["none"] == cites["empty"] == cites["null"] == []
    assert cites["comma"][0].work_ref.title == "Copyright, Designs and Patents Act"


def test_pinpoints(resolved):
    cites = resolved[1]
    assert len(cites["wrap"]) == 1 and cites["wrap"][0].provisions[0].end_number == "3"
    assert [c.method for c in cites["apart"]] == ["exact", "context"]
    assert [p.kind for p in cites["nested"][0].provisions] == ["schedule", "paragraph"]
    assert cites["nested"][0].url == f"{SITE}/ukpga/2006/46/schedule/2/paragraph/4"
    assert cites["subs"][0].url == f"{SITE}/ukpga/1998/42/section/45#section-45-2-a"
    assert cites["subs"][0].id_uri == f"{SITE}/id/ukpga/1998/42/section/45/2/a"


def test_cases(resolved):
    cases, cites = resolved[2], resolved[1]
    miller = cases["miller"][0]
    assert (miller.case_ref.name, miller.case_ref.pinpoint, miller.case.id) == ("R (Miller) v Prime Minister", "[30]-[35]", "uksc-2019-41")
    assert cases["re"][0].case_ref.name == "Re B (A Child)"
    assert len(cases["two"]) == 2
    assert [c.case.id for c in cases["alone"]] == ["uksc-2016-42", "uksc-2015-11"]
    assert cases["report"][0].case_ref.pinpoint == "para 45" and [c.work.id for c in cites["report"]] == ["ukpga-1998-42"]
    assert cases["brind"][0].case_ref.name == "R v Secretary of State for the Home Department, ex p. Brind"


def test_single_subdivision_begins_the_title(resolved):
    """A bracket after a digit is a word boundary, so that the title takes it."""
    cite = resolved[1]["one subdivision"][0]
    assert cite.surface == "(1) of the Human Rights Act 1998" and cite.url == f"{SITE}/ukpga/1998/42"


def test_pinpoint_far_from_its_citation(resolved):
    assert resolved[2]["far"][0].case_ref.pinpoint == "[12]"


def test_texts_that_share_an_id(spark):
    """Each text is resolved by itself; totals are those of the id; nothing is counted twice."""
    first, second = "The Theft Act 1968 applies. Section 1 remains.", "Section 2 bites. The Human Rights Act 1998 too."
    docs = spark.createDataFrame([(1, first), (1, second), (2, "")], "doc_id int, text string")
    r = pipeline.resolve(docs, Registers.load(spark))
    found = {c.surface: (c.work.id if c.work else None, c.method) for c in r.citations.collect()}
    assert found["Section 1"] == ("ukpga-1968-60", "context") and found["Section 2"] == (None, "unresolved")
    stats = {x.doc_id: x for x in pipeline.document_stats(r).collect()}
    assert len(stats) == 2 and (stats[1].citations, stats[1].resolved, stats[2].citations) == (4, 3, 0)
    total = pipeline.corpus_stats(r).first()
    assert (total.documents, total.total_citations, total.resolved_citations) == (2, 4, 3)
    texts = sorted(x.annotated for x in pipeline.annotate(r).filter("doc_id = 1").collect())
    assert [t.count("](") for t in texts] == [1, 2] or [t.count("](") for t in texts] == [2, 2]
    assert all(("Theft" in t) != ("Human" in t) for t in texts)


def test_rounding_and_name_agreement(spark):
    from pyspark.sql import functions as F

    from lexweave.functions.similarity import name_agreement, ratio, round4

    values = [m / t for t in range(1, 200) for m in range(t + 1)] + [k / 20000 for k in range(20001)]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", round4(F.col("x")).alias("r")).collect()
    assert all(r.r == round(r.x, 4) for r in rows)
    pairs = [("r v smith", "r v smith jones", 1.0), ("a v b", "b v a", 0.0), ("x y", "x z", ratio("x y", "x z")), ("a v b v c", "a v b", ratio("a v b v c", "a v b")), (None, "a v b", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", name_agreement(F.col("a"), F.col("b"))).collect())


def test_annotation_and_index(resolved):
    r = resolved[0]
    texts = {x.doc_id: x.annotated for x in pipeline.annotate(r).collect()}
    assert texts["act"] == f"the [Human Rights Act 1998]({SITE}/ukpga/1998/42) applies"
    assert texts["none"] == TEXTS["none"] and texts["null"] == ""
    stats = pipeline.corpus_stats(r).first()
    assert stats.documents == len(TEXTS)
    hra = {x.id: x for x in pipeline.cited_works(r).collect()}["ukpga-1998-42"]
    assert hra.mentions == 4 and hra.documents == 4
    (posted,) = [x for x in pipeline.cited_by(r).collect() if x.id == "ukpga-1998-42"]
    assert [d.doc_id for d in posted.documents] == ["act", "one subdivision", "report", "subs"]
    with pytest.raises(ValueError):
        pipeline.annotate(r, "pdf")


def test_versions():
    assert suffix(*version("original")) == "/enacted" and suffix(*version("as-at:1991-02-01")) == "/1991-02-01"
    assert suffix(*version("latest")) == suffix(*version("prospective")) == ""
    assert chosen_version(original=True, as_at="x") == ("original", None)
    with pytest.raises(ValueError):
        version("yesterday")


def test_embedded_citations_beside_pinpoints_of_the_text_itself(spark, tmp_path):
    """A text's own "SS 49" is a pinpoint by context, not a citation of the Act."""
    text = "Im berge er schß die.\nSS 4914997113902518 enieäach."
    spark.createDataFrame([(3654, text), (3655, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = suite.embedded_citations(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.start) for r in found] == [(3654, len(text) + 6)]


def test_recurring_texts_are_resolved_once(spark, monkeypatch):
    """With the same rows as if each document were resolved by itself."""
    texts = [TEXTS["short"], TEXTS["miller"], TEXTS["typo"], None, "no law", "The Theft Act 1968. The 1968 Act, s 2."]
    docs = spark.createDataFrame([(f"d{i}", texts[i % 6]) for i in range(30)] + [(None, texts[0])], "doc_id string, text string")
    registers = Registers.default(spark)
    asked = []
    extract = pipeline.extract
    monkeypatch.setattr(pipeline, "extract", lambda d, *a: asked.append(d.count()) or extract(d, *a))
    once = pipeline.resolve(docs, registers)
    monkeypatch.setattr(pipeline, "recurring", lambda texts: False)
    each = pipeline.resolve(docs, registers)
    # a null text is an empty one, as is each of its kind
    assert asked == [6, 31]
    rows = lambda df: sorted(map(str, df.collect()))
    for a, b in ((once.citations, each.citations), (once.cases, each.cases)):
        assert a.columns == b.columns and rows(a) == rows(b) and rows(a)
    assert rows(pipeline.corpus_stats(once)) == rows(pipeline.corpus_stats(each))
    assert rows(pipeline.cited_works(once)) == rows(pipeline.cited_works(each)) and rows(pipeline.cited_by(once)) == rows(pipeline.cited_by(each))


@pytest.fixture(scope="module")
def recurring(spark):
    """60 documents of three texts, all in one partition, and how often an id was made."""
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def named(i):
        made.add(1)
        return f"d{i:02}"

    texts = ["section 45(2)(a) of the Human Rights Act 1998", "the Theft Act 1968 (c. 60). The 1968 Act, s 2.", "the Fictional Widgets Act 1911 (c. 7)"]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "i int, text string").coalesce(1)
    docs = docs.select(F.udf(named, "string")("i").alias("doc_id"), "text")
    return pipeline.resolve(docs, Registers.load(spark)), made


def test_labels_are_made_with_the_citations(recurring):
    from lexweave.operators.links import labels

    rows = recurring[0].citations.select("label", labels(recurring[0].citations["provisions"]).alias("own")).collect()
    assert len(rows) == 80 and all(x.label == x.own for x in rows) and {x.label for x in rows} == {"", "section 45(2)(a)", "section 2"}


def test_stats_of_recurring_texts_come_from_the_different_texts(recurring):
    from dataclasses import replace

    r = recurring[0]
    total = pipeline.corpus_stats(replace(r, citations=None, cases=None)).first()
    assert (total.documents, total.total_citations, total.resolved_citations, total.distinct_works, total.total_case_citations) == (60, 80, 80, 3, 0)


def test_postings_are_shuffled_twice_before_they_are_numbered(recurring, monkeypatch):
    plans, kept = [], pipeline.kept
    monkeypatch.setattr(pipeline, "kept", lambda df, held=None: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, held))
    assert pipeline.cited_by(recurring[0]).count() == 3
    (plan,) = plans
    # one of counts by pinpoint, one by range
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange rangepartitioning") == 1


def test_directory_reads_documents_once(recurring):
    r, made = recurring
    before = made.value
    found = [(x.id, x.mentions, x.documents) for x in pipeline.cited_works(r).collect()]
    assert found == [("ukpga-1968-60", 40, 20), ("ukpga-1998-42", 20, 20), ("ukpga-1911-7", 20, 20)]
    assert made.value - before == 60


def test_few_tasks_of_documents_are_dealt(recurring):
    """A file of one task is spread, however few bytes it has."""
    from pyspark.sql import functions as F

    assert recurring[0].citations.select(F.spark_partition_id()).distinct().count() > 1
