"""Look-up of titles that no register has in a remote service, as a stage of its own.

Each distinct title and year is asked once, by a few tasks side by side: ``fetch`` runs
on the executors and gives the text of an Atom feed. Answers, misses and failures
included, are written to a folder if one is named, and titles that it has aren't asked
again. Feeds are parsed where they arrive; titles are compared by Spark.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.similarity import similarity
from ..functions.text import empty, title_key
from ..sources.storage import Held, kept

#: fixed values: the service's feed, its ids, the least score, the weight of another year, how long an answer may take
FEED = f"{fixed.WORKS_SITE}/all/data.feed"
ID = r"/id/([a-z]+)/([0-9]{4})/([^/\s]+)"
LEAST_SCORE, OTHER_YEAR, TIMEOUT = 0.8, 0.8, 10.0
_ATOM = "{http://www.w3.org/2005/Atom}"
_ANSWERS = "norm string, year int, title string, feed string"


def fetch_feed(title: str, year: int | None) -> str:
    """The service's feed of works with that title."""
    asked = {"title": title} | ({"year": str(year)} if year else {})
    with urlopen(Request(f"{FEED}?{urlencode(asked)}", headers={"Accept": "application/atom+xml"}), timeout=TIMEOUT) as answer:
        return answer.read().decode("utf-8", "replace")


@dataclass(frozen=True)
class Remote:
    fetch: Callable[[str, int | None], str] = fetch_feed
    #: folder of answers that outlives a run; None: they last as long as the result
    memo: str | None = None
    least_score: float = LEAST_SCORE
    #: how many titles are asked at a time
    parallel: int = 4


def entries(feed: str | None) -> list[tuple[str, int, str, str]]:
    """(type, year, number, title) of a feed's works; of what can't be read, none."""
    try:
        found = list(ET.fromstring(feed or "").iter(f"{_ATOM}entry"))
    except ET.ParseError:
        return []
    out = []
    for entry in found:
        id_, title = entry.findtext(f"{_ATOM}id"), entry.find(f"{_ATOM}title")
        parts = re.search(ID, id_ or "")
        if parts and title is not None:
            out.append((parts[1], int(parts[2]), parts[3], (title.text or "").strip()))
    return out


def _known(asked: DataFrame, memo: str) -> DataFrame | None:
    try:
        return asked.sparkSession.read.schema(_ANSWERS).parquet(memo)
    except AnalysisException:
        return None  # nothing was asked so far


def feeds(asked: DataFrame, remote: Remote, held: Held | None = None) -> DataFrame:
    """norm, year, title, feed of each of ``asked`` (norm, year, title); feed is null if the service failed."""
    fetch = remote.fetch

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for title, year in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(fetch(title, year))
                except Exception:  # noqa: BLE001  a service that fails is one that doesn't know
                    texts.append(None)
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], ["norm", "year", "title", "feed"])

    asked = asked.select("norm", F.col("year").cast("int").alias("year"), "title")
    known = _known(asked, remote.memo) if remote.memo else None
    on = lambda other: (asked["norm"] == other["norm"]) & asked["year"].eqNullSafe(other["year"])
    new = asked if known is None else asked.join(known, on(known), "left_anti")
    answers = new.repartition(remote.parallel).mapInArrow(ask, _ANSWERS)
    if not remote.memo:
        return kept(answers, held)
    answers.write.mode("append").parquet(remote.memo)
    known = _known(asked, remote.memo)
    return known.join(asked.select(F.col("norm").alias("n"), F.col("year").alias("y")), (F.col("n") == known["norm"]) & F.col("y").eqNullSafe(known["year"]), "left_semi")


def answers(asked: DataFrame, remote: Remote, work_type: str, held: Held | None = None) -> DataFrame:
    """norm, year, work: the best work of each feed whose title is close enough, the first of equals."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, y, i, *e) for n, y, feed in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for i, e in enumerate(entries(feed))]
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string())
            names = ["norm", "year", "place", "type", "entry_year", "number", "entry_title"]
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

    found = feeds(asked, remote, held).select("norm", "year", "feed").mapInArrow(parse, "norm string, year int, place int, type string, entry_year int, number string, entry_title string")
    weight = F.when(F.col("year").isNotNull() & (F.col("entry_year") != F.col("year")), OTHER_YEAR).otherwise(1.0)
    scored = found.withColumn("score", similarity("norm", title_key(F.col("entry_title"))) * weight).filter(F.col("score") >= remote.least_score)
    work = F.struct(
        F.concat_ws("-", "type", F.col("entry_year").cast("string"), "number").alias("id"), F.col("entry_title").alias("title"), F.col("entry_year").alias("year"),
        F.col("type").alias("work_type"), "number", empty("array<string>").alias("aliases"),
    ).cast(work_type)
    return scored.groupBy("norm", "year").agg(F.max_by(work, F.struct("score", -F.col("place"))).alias("work"))
