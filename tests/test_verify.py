"""Verification of registers against fetched pages."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexweave.functions.similarity import ratio, round2
from lexweave.operators import verify
from lexweave.sources.registry import Registers

WORK = "id string, title string, year int, work_type string, number string, aliases array<string>"
CASE = "id string, name string, neutral string, reports array<string>, aliases array<string>"
#: fixed value: where the pages are
SITE = "https://www.legislation.gov.uk/ukpga"


@pytest.fixture(scope="module")
def registers(spark):
    works = [(None, title, 2000 + i, "ukpga", str(i), []) for i, title in enumerate(["Theft Act", "Bees' Act", 'The "Odd\\" Bees\' Act', "Fraud Act", "Seeds Act", "Plants Act"])]
    cases = [(None, "Smith v Jones", "[2010] UKSC 1", [], []), (None, "Re Z", "[2010] UKSC 2", [], ["Z v Council"]), (None, "Old v Older", "[1990] UKHL 3", [], []),
             (None, "A v B", None, ["[1970] AC 1"], []), (None, "X v Y", "[2010] UKSC 5", [], [])]
    return Registers.from_entries([spark.createDataFrame(works, WORK)], [spark.createDataFrame(cases, CASE)])


def _site():
    """What the site answers; made within a function, so that workers get it whole."""
    said = {0: "<title>Theft\n Act 2000</title>", 1: "<TITLE>Wasps Control Order</TITLE>", 2: "<title>Other \\ 'thing'</title>", 3: "<p>nothing</p>"}

    def page(url):
        n = int(url.rsplit("/", 1)[1])
        if n == 4:
            return 410, "<title>Seeds Act</title>"
        if n == 5:
            raise TimeoutError("slow")
        return 200, said[n]

    return page


def _asked(folder, answer):
    def fetch(url):
        with open(f"{folder}/asked", "a") as notes:
            notes.write(f"{url}\n")
        return answer(url)

    return fetch


def test_report_of_works(spark, registers, tmp_path):
    urls = verify.work_pages(registers)
    pages = verify.pages(urls.union(urls), _asked(tmp_path, _site()), memo=str(tmp_path / "memo"))
    report = verify.check_works(registers, pages)
    rows = {r.id: r for r in report.collect()}
    assert {i: r.status for i, r in rows.items()} == {"ukpga-2000-0": "OK", "ukpga-2001-1": "TITLE", "ukpga-2002-2": "TITLE", "ukpga-2003-3": "OK", "ukpga-2004-4": "HTTP", "ukpga-2005-5": "ERROR"}
    for i, name, said, a, b in (("ukpga-2001-1", "Bees' Act", "Wasps Control Order", "bees act", "wasps control order"), ("ukpga-2002-2", 'The "Odd\\" Bees\' Act', "Other \\ 'thing'", "odd bees act", "other thing")):
        assert rows[i].detail == f"registry={name!r} site={said!r} ({ratio(a, b):.2f})"
        assert rows[i].line == f"  {'TITLE':<6} {i:<18} {rows[i].detail}"
    assert rows["ukpga-2004-4"].detail == f"410 {SITE}/2004/4" and rows["ukpga-2005-5"].detail == "TimeoutError" and rows["ukpga-2000-0"].line is None
    assert verify.totals(report).first().asDict() == {"checked": 6, "verified": 2, "failed": 4, "skipped": 0}
    assert [r.year for r in verify.in_report_order(report).collect()] == list(range(2000, 2006))
    asked = sorted((tmp_path / "asked").read_text().splitlines())
    assert asked == sorted(f"{SITE}/{2000 + i}/{i}" for i in range(6))
    # a second run asks for nothing that has an answer, failures included
    verify.pages(urls, _asked(tmp_path, _site()), memo=str(tmp_path / "memo")).count()
    assert sorted((tmp_path / "asked").read_text().splitlines()) == asked


def test_report_of_cases(spark, registers, tmp_path):
    said = {"1": "Smith and another v Jones Ltd - Find Case Law - The Archives", "2": "Z v Council - Find Case Law", "5": "Quite Another v Someone"}
    pages = verify.pages(verify.case_pages(registers), _asked(tmp_path, lambda url: (200, f"<title>{said[url.rsplit('/', 1)[1]]}</title>")), verify.CASES_AT_A_TIME)
    report = {r.name: r for r in verify.check_cases(registers, pages).collect()}
    assert {n: r.status for n, r in report.items()} == {"Smith v Jones": "OK", "Re Z": "OK", "Old v Older": "SKIP", "A v B": "SKIP", "X v Y": "NAME"}
    assert report["A v B"].detail == "no direct link" and report["Old v Older"].detail.startswith("not checkable: https://www.bailii.org/")
    assert re.fullmatch(r"registry='X v Y' site='Quite Another v Someone' \(0\.\d\d\)", report["X v Y"].detail)
    assert len((tmp_path / "asked").read_text().splitlines()) == 3


def test_nothing_fetched_and_pages_twice(spark, registers):
    none = spark.createDataFrame([], "url string, status int, body string, error string")
    assert {(r.status, r.detail) for r in verify.check_works(registers, none).collect()} == {("ERROR", "not fetched")}
    twice = spark.createDataFrame([(f"{SITE}/2000/0", 200, "<title></title>", None), (f"{SITE}/2000/0", 200, "<title></title>", None), (None, 200, "", None)], "url string, status int, body string, error string")
    rows = {r.id: r for r in verify.check_works(registers, twice).collect()}
    assert len(rows) == 6 and rows["ukpga-2000-0"].detail == "registry='Theft Act' site='' (0.00)"


def test_two_digits_as_python_rounds(spark):
    r = random.Random(3)
    values = [SequenceMatcher(None, "a" * r.randint(1, 90), "a" * r.randint(1, 90) + "b" * r.randint(0, 40)).ratio() for _ in range(3000)] + [i / 200 for i in range(201)] + [0.625, 0.735, 1.0]
    found = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.format_string("%.2f", round2(F.col("v"))).alias("shown")).collect()
    assert [x for x in found if x.shown != f"{x.v:.2f}"] == []
