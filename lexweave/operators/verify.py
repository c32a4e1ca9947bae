"""Verification of registers: does the page of each work and case bear its name?

Pages are asked for once per address by a few tasks side by side, ``fetch`` running on the
executors; answers, failures included, are kept in a folder if one is named, so a run that
was broken off goes on where it ended. What a page says is judged by Spark: only pages with
a title are compared, each with the one entry it belongs to.

Statuses: OK; HTTP (any answer but 200); ERROR (no answer); TITLE or NAME (the page bears
another name); SKIP (cases without a page that may be asked for automatically). An address
without a page in ``pages`` is an ERROR. A page without a title element is taken as right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import name_agreement, round2, similarity
from ..functions.text import collapse, name_key, title_key
from ..sources.registry import Registers
from ..sources.storage import Held, kept
from .links import judgment_link, work_url

#: fixed values: least scores, pages asked for at a time, seconds to wait, the end of a judgment page's title, widths of a line
TITLE_CUTOFF, NAME_CUTOFF = 0.75, 0.6
WORKS_AT_A_TIME, CASES_AT_A_TIME, TIMEOUT = 6, 4, 40.0
SITE_SUFFIX = r"(?U)\s+-\s+Find Case Law.*$"
STATUS_WIDTH, WORK_WIDTH, CASE_WIDTH = 6, 18, 22
_TITLE = r"(?is)<title>(.*?)</title>"
_PAGES = "url string, status int, body string, error string"

Fetch = Callable[[str], tuple[int, str]]


def fetch_page(url: str) -> tuple[int, str]:
    """Status and text of a page; redirections are followed."""
    try:
        with urlopen(Request(url, headers={"User-Agent": "lexweave register verification"}), timeout=TIMEOUT) as answer:
            return answer.status, answer.read().decode("utf-8", "replace")
    except HTTPError as refused:
        return refused.code, ""


def _earlier(urls: DataFrame, memo: str) -> DataFrame | None:
    try:
        return urls.sparkSession.read.schema(_PAGES).parquet(memo)
    except AnalysisException:
        return None  # nothing was asked so far


def pages(urls: DataFrame, fetch: Fetch = fetch_page, at_a_time: int = WORKS_AT_A_TIME, memo: str | None = None, held: Held | None = None) -> DataFrame:
    """url, status, body, error of each distinct address of ``urls`` (url); null addresses are left out."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():
                try:
                    status, body, error = *fetch(url), None
                except Exception as failed:  # noqa: BLE001  whatever stops a page from being read is reported by its name
                    status, body, error = None, None, type(failed).__name__
                # a page at a time: bodies may be long
                yield pa.record_batch([pa.array([url]), pa.array([status], pa.int32()), pa.array([body], pa.string()), pa.array([error], pa.string())], ["url", "status", "body", "error"])

    asked = urls.select("url").filter("url is not null").distinct()
    known = _earlier(urls, memo) if memo else None
    new = asked if known is None else asked.join(known, "url", "left_anti")
    found = new.repartition(at_a_time).mapInArrow(ask, _PAGES)
    if not memo:
        return kept(found, held)
    found.write.mode("append").parquet(memo)
    return _earlier(urls, memo).join(asked, "url", "left_semi")


def _quoted(text: Column) -> Column:
    """In single quotes, or in double ones if it has single ones only."""
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))


def _padded(text: Column, width: int) -> Column:
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def _met(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``entries`` (with url) and status_code, error, site (the page's title, null if it has none) of the page."""
    # the title is taken before the join, so that bodies aren't shuffled
    found = pages.groupBy("url").agg(F.min(F.struct(  # an address has one page; of several, always the same
        F.col("status").alias("status_code"), F.col("error").alias("error"),
        F.when((F.col("status") == 200) & F.col("body").rlike(_TITLE), collapse(F.regexp_extract("body", _TITLE, 1))).alias("site"),
    )).alias("page"))
    met = entries.join(found, "url", "left")
    return met.select(*entries.columns, "page.status_code", F.when(F.col("page").isNull(), "not fetched").otherwise(F.col("page.error")).alias("error"), "page.site")


def _judged(met: DataFrame, low: Column, wrong: str, named: Column, width: int, skip: Column | None = None) -> DataFrame:
    """id, year, name, url, status, detail, score and the line of a report."""
    bad = F.concat(F.lit("registry="), _quoted(named), F.lit(" site="), _quoted(F.col("site")), F.format_string(" (%.2f)", round2(F.col("score"))))
    skip = skip if skip is not None else F.lit(None).cast("string")
    rungs = [
        (skip.isNotNull(), "SKIP", skip), (F.col("error").isNotNull(), "ERROR", F.col("error")),
        (F.col("status_code") != 200, "HTTP", F.concat(F.col("status_code").cast("string"), F.lit(" "), F.col("url"))), (low, wrong, bad),
    ]
    status, detail = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for held, name, text in rungs:
        held = F.coalesce(held, F.lit(False))
        status, detail = status.when(held, name), detail.when(held, text)
    judged = met.select("id", "year", named.alias("name"), "url", status.otherwise("OK").alias("status"), detail.otherwise("").alias("detail"), "score")
    line = F.concat(F.lit("  "), _padded(F.col("status"), STATUS_WIDTH), F.lit(" "), _padded(F.col("id"), width), F.lit(" "), F.col("detail"))
    return judged.withColumn("line", F.when(F.col("status") != "OK", line))


def work_pages(registers: Registers) -> DataFrame:
    """The addresses of all works."""
    return registers.works.select(work_url(F.col("work")).alias("url"))


def case_pages(registers: Registers) -> DataFrame:
    """The addresses of the cases that may be asked for."""
    return registers.cases.select(judgment_link(F.col("case.neutral"))["url"].alias("url")).filter(F.col("url").startswith(fixed.CASES_SITE))


def check_works(registers: Registers, pages: DataFrame, cutoff: float = TITLE_CUTOFF) -> DataFrame:
    """A row for each work: id, year, name, url, status, detail, score, line (null if it is right)."""
    entries = registers.works.select("work.id", "work.year", "work.title", "norm", work_url(F.col("work")).alias("url"))
    met = _met(entries, pages).withColumn("score", similarity("norm", title_key(F.col("site"))))
    return _judged(met, F.col("score") < cutoff, "TITLE", F.col("title"), WORK_WIDTH)


def check_cases(registers: Registers, pages: DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """The same for each case, by the one of its names that agrees best."""
    entries = registers.cases.select("ord", "case.id", "case.neutral.year", F.col("case.name").alias("called"), "names", judgment_link(F.col("case.neutral"))["url"].alias("url"))
    met = _met(entries, pages)
    each = met.filter("site is not null").select("ord", F.explode(F.array_distinct("names")).alias("own"), name_key(F.regexp_replace("site", SITE_SUFFIX, "")).alias("theirs"))
    best = each.withColumn("score", name_agreement(F.col("own"), F.col("theirs"))).groupBy("ord").agg(F.max("score").alias("score"))
    met = met.join(best, "ord", "left").withColumn("site", F.regexp_replace("site", SITE_SUFFIX, ""))
    skip = F.when(F.col("url").isNull(), "no direct link").when(~F.col("url").startswith(fixed.CASES_SITE), F.concat(F.lit("not checkable: "), F.col("url")))
    return _judged(met, F.col("score") < cutoff, "NAME", F.col("called"), CASE_WIDTH, skip)


def totals(report: DataFrame) -> DataFrame:
    """checked, verified, failed, skipped: one row."""
    count = lambda held: F.count(F.when(held, 1))
    ok, skipped = F.col("status") == "OK", F.col("status") == "SKIP"
    return report.agg(count(~skipped).alias("checked"), count(ok).alias("verified"), count(~ok & ~skipped).alias("failed"), count(skipped).alias("skipped"))


def in_report_order(report: DataFrame) -> DataFrame:
    """By year and name, as a report lists them."""
    return report.orderBy(F.coalesce("year", F.lit(0)), "name", "id")
