"""Remote look-up, input of several paths, streams, references matched by themselves."""

import os

import pytest

import lexweave
from lexweave.operators.remote import Remote, answers, entries
from lexweave.operators.resolve import WORK
from lexweave.plans import pipeline
from lexweave.sources.documents import in_order
from lexweave.streaming.citations import append_to, resolve_stream

#: fixed values: what the service answers
FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">
<entry><id>http://www.legislation.gov.uk/id/ukpga/1947/48</id><title>Agriculture Act 1947</title></entry>
<entry><id>urn:nonsense</id><title>Agriculture Act 2020</title></entry>
<entry><title>Agriculture Act 2020</title></entry>
<entry><id>http://www.legislation.gov.uk/id/ukpga/2020/21</id><title>Agriculture Act 2020</title></entry></feed>"""


def _service(folder):
    """Answers with FEED and notes what it was asked."""

    def fetch(title, year):
        with open(f"{folder}/asked", "a") as asked:
            asked.write(f"{title}|{year}\n")
        if "Broken" in title:
            raise RuntimeError("boom")
        return "not xml" if "Garbled" in title else FEED

    return fetch


def _asked(folder):
    return sorted(open(f"{folder}/asked").read().splitlines())


def test_entries():
    assert entries(FEED) == [("ukpga", 1947, "48", "Agriculture Act 1947"), ("ukpga", 2020, "21", "Agriculture Act 2020")] and entries("<feed") == entries(None) == []


def test_answers_and_memo(spark, tmp_path):
    remote = Remote(_service(tmp_path), memo=str(tmp_path / "memo"))
    rows = [("agriculture act", 2020, "Agriculture Act"), ("agriculture act", 1947, "Agriculture Act"), ("agriculture act", 1900, "Agriculture Act"), ("agriculture act", None, "Agriculture Act"),
            ("interplanetary sandwich act", 2020, "Interplanetary Sandwich Act"), ("broken act", 2020, "Broken Act"), ("garbled act", 2020, "Garbled Act")]
    asked = spark.createDataFrame(rows, "norm string, year int, title string")
    found = {(r.norm, r.year): r.work.id for r in answers(asked, remote, WORK).collect()}
    assert found == {("agriculture act", 2020): "ukpga-2020-21", ("agriculture act", 1947): "ukpga-1947-48", ("agriculture act", None): "ukpga-1947-48", ("agriculture act", 1900): "ukpga-1947-48"}
    once = _asked(tmp_path)
    assert once == sorted(f"{t}|{y}" for _, y, t in rows)
    more = spark.createDataFrame([*rows, ("new act", 2020, "New Act")], "norm string, year int, title string")
    assert {(r.norm, r.year): r.work.id for r in answers(more, remote, WORK).collect()} == found
    assert _asked(tmp_path) == sorted([*once, "New Act|2020"])  # misses and failures aren't asked again


def test_remote_hits_are_learned(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the Agriculture Act 2020 applies. The Agriculture Act 2020, s 3."), (2, "the Agriculture Act 2020 and the Sandwich Act 2020"), (3, "the Theft Act 1968")], "doc_id int, text string")
    registers = lexweave.Registers.load(spark)
    r = lexweave.resolve(docs, registers, lexweave.Settings(remote=Remote(_service(tmp_path))))
    found = [(c.doc_id, c.method, c.confidence, c.work.id if c.work else None) for c in r.citations.orderBy("doc_id", "ord").collect()]
    assert found == [(1, "remote", 0.93, "ukpga-2020-21"), (1, "exact", 1.0, "ukpga-2020-21"), (2, "exact", 1.0, "ukpga-2020-21"), (2, "unresolved", 0.0, None), (3, "exact", 1.0, "ukpga-1968-60")]
    assert r.citations.filter("doc_id = 1").orderBy("ord").first().url == "https://www.legislation.gov.uk/ukpga/2020/21"
    assert _asked(tmp_path) == ["Agriculture Act|2020", "Sandwich Act|2020"]
    more = registers.add(works=lexweave.learned(r))
    assert [w.id for w in more.by_number(2020, "21").collect()] == ["ukpga-2020-21"]


def test_paths_and_their_order(spark, tmp_path):
    os.makedirs(tmp_path / "b" / "deep")
    for name, text in (("b/deep/x.TXT", "first"), ("b/a.md", "second"), ("b/skip.csv", "no"), ("a.csv", "named")):
        (tmp_path / name).write_text(text)
    docs = lexweave.read_paths(spark, [str(tmp_path / "b"), str(tmp_path / "a.csv")])
    assert [r.text for r in docs.orderBy("place").collect()] == ["second", "first", "named"] == [r.text for r in in_order(docs).orderBy("doc_id").collect()]
    with pytest.raises(ValueError):
        lexweave.of_text(spark, "")


def test_stream_of_documents(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "the Theft Act 1968, s 1"), (2, "Patel v Mirza [2016] UKSC 42")], "doc_id int, text string").write.parquet(source)
    registers = lexweave.Registers.load(spark)

    def run():
        resolve_stream(spark.readStream.schema("doc_id int, text string").parquet(source), registers, append_to(out), str(tmp_path / "state")).awaitTermination()

    run()
    spark.createDataFrame([(3, "the Equality Act 2010")], "doc_id int, text string").write.mode("append").parquet(source)
    run()
    assert sorted(r.work.id for r in spark.read.parquet(f"{out}/citations").collect()) == ["ukpga-1968-60", "ukpga-2010-15"] and spark.read.parquet(f"{out}/cases").count() == 1


def test_references_by_themselves(spark):
    """A title or a case is resolved without a document."""
    registers = lexweave.Registers.load(spark)
    refs = spark.createDataFrame([("Theft Act", 1968, None, None), (None, 2017, "692", "uksi"), ("Nothing", 1900, None, None)], "title string, year int, number string, work_type string")
    found = {r.title: r.match for r in lexweave.match_works(refs, registers).collect()}
    assert found["Theft Act"].work.id == "ukpga-1968-60" and found[None].method == "number" and found["Nothing"].method == "unresolved"
    docs = spark.createDataFrame([(1, "See Patel v Mirza [2016] UKSC 42 at [3].")], "doc_id int, text string")
    mention = pipeline.extract(docs, registers).selectExpr("inline(case_mentions)").select("name", "neutral", "reports")
    assert lexweave.match_cases(mention, registers).first().match.case.id == "uksc-2016-42"
