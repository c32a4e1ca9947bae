"""Whole passes over a table of documents: resolve, annotate, serialise, index.

The text of a document is read once for extraction; only mentions are shuffled.
``annotate`` and ``to_json`` join the finished citations back to the texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import round4
from ..functions.text import empty, html
from ..operators.cases import find_cases, name_keys, neutral_text
from ..operators.links import case_citation, judgment_link, label, work_citation, work_url
from ..operators.resolve import Settings, resolve_cases, resolve_works
from ..operators.works import acronym_keys, find_citations
from ..sources.registry import Registers
from ..sources.storage import Held, kept, release

WHOLE_WORK, WHOLE_JUDGMENT = "(whole work)", "(whole judgment)"


@dataclass
class Once:
    """Where texts recur: citations and cases of each different text, with ``named``, the
    number of documents with an id that have it."""

    citations: DataFrame
    cases: DataFrame


@dataclass
class Resolved:
    """Citations of documents. A doc_id names a document; if several texts have
    the same one, each is resolved and annotated by itself (``text_key`` tells
    them apart), and totals are those of the id."""

    documents: DataFrame  # doc_id, text
    citations: DataFrame
    cases: DataFrame
    #: what was kept on the way
    held: Held = field(default_factory=list)
    once: Once | None = None

    def release(self) -> None:
        """Drop what was kept on the way, when the results are written."""
        release(self.held)


def extract(docs: DataFrame, registers: Registers, settings: Settings = Settings()) -> DataFrame:
    """doc_id, text_key, case_mentions, citations, definitions for each document (doc_id, text)."""
    texts = dealt(docs.select("doc_id", "text")).select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    names, aliases = registers.names if settings.link_cases else [], registers.aliases
    if names is None:
        texts = _registered(texts, name_keys(F.col("text")), registers.case_index("name"), "known_names")
    if aliases is None:
        texts = _registered(texts, acronym_keys(F.col("text")), registers.work_index("alias"), "known_aliases")
    found = find_cases(texts, names)
    if not settings.link_cases:
        found = found.withColumn("case_mentions", F.slice("case_mentions", 1, 0))
    return find_citations(found, aliases).select("doc_id", "text_key", "case_mentions", "citations", "definitions")


def _registered(texts: DataFrame, candidates: Column, index: DataFrame, name: str) -> DataFrame:
    """``texts`` and, as ``name``, those of a text's candidates that the index has. For
    registers too large for a literal: the candidates' keys are joined with the index, and
    the texts that have one get theirs by the hash of the text."""
    asked = texts.select("text_key", F.explode(candidates).alias("key")).distinct()
    held = asked.join(index.select("key").distinct(), "key", "left_semi").groupBy("text_key").agg(F.collect_set("key").alias(name))
    return texts.join(held, "text_key", "left")


#: A table of less than this many bytes a core is dealt over all cores before its texts are searched.
SMALL_SHARE = 16 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """``docs``, dealt evenly if it is small: a file of one row group is one task,
    and finding citations takes far longer than moving so few texts. Large tables
    stay where they are."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return docs.repartition(cores) if int(size) < cores * SMALL_SHARE else docs


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt over all cores if fewer tasks than these have rows: a file of a few
    megabytes may hold a million short documents. They are dealt by the hash of their place,
    as dealing them in turn first sorts all rows of a task."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.select(F.spark_partition_id()).distinct().count() >= cores:
        return docs
    return docs.withColumn("_at", F.monotonically_increasing_id()).repartition(cores, "_at").drop("_at")


def text_key() -> Column:
    """Tells texts of the same doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def resolve(docs: DataFrame, registers: Registers, settings: Settings = Settings()) -> Resolved:
    """The citations of documents. The mentions are kept, since works, cases and
    the look-ups of each start from them."""
    held: Held = []
    texts = docs.select("doc_id", "text")
    # what a remote service knows goes to the first mention of a corpus, so documents aren't alike there
    if settings.remote is None and recurring(texts):
        return _resolved_once(texts, registers, settings, held)
    found = kept(extract(docs, registers, settings), held)
    return Resolved(texts, resolve_works(found, registers, settings, held), resolve_cases(found, registers, settings, held), held)


def recurring(texts: DataFrame) -> bool:
    """Does a text occur twice or more on average? One pass that only hashes the texts."""
    rows, different = texts.agg(F.count(F.lit(1)), F.approx_count_distinct(text_key())).first()
    return 0 < 2 * different <= rows


def _resolved_once(texts: DataFrame, registers: Registers, settings: Settings, held: Held) -> Resolved:
    """As ``resolve``, for texts that recur: citations depend on the text alone, so each
    different text is resolved once, and documents meet its citations by two hashes of it."""
    other = F.xxhash64(F.lit("other"), F.coalesce("text", F.lit("")))
    counted = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("doc_id").alias("named"))
    once = kept(counted.select(other.alias("doc_id"), "text", "named"), held)
    found = kept(extract(once, registers, settings), held)
    keys = spread(texts.select("doc_id", text_key().alias("text_key"), other.alias("_other")))
    times = once.select("doc_id", text_key().alias("text_key"), "named")

    def back(one: DataFrame) -> DataFrame:
        return keys.join(one.withColumnRenamed("doc_id", "_other"), ["text_key", "_other"]).select(*one.columns)

    works, cases = kept(resolve_works(found, registers, settings, held), held), kept(resolve_cases(found, registers, settings, held), held)
    return Resolved(texts, back(works), back(cases), held, Once(*(one.join(times, ["doc_id", "text_key"]) for one in (works, cases))))


def learned(r: Resolved) -> DataFrame:
    """Works that were found remotely, as entries for ``Registers.add``."""
    return r.citations.filter("method = 'remote'").select("work.*").dropDuplicates(["id"])


# --- annotation --------------------------------------------------------------


def annotate(r: Resolved, fmt: str = "markdown", min_confidence: float = 0.0) -> DataFrame:
    """doc_id, annotated: each citation with a page and enough confidence becomes a link.

    A fold over the citations by start; one that begins within an earlier one is left out.
    """
    if fmt not in ("markdown", "html"):
        raise ValueError(f"unknown format: {fmt!r}")
    escape = html if fmt == "html" else lambda t: t
    works = r.citations.select("doc_id", "text_key", "start", "end", F.lit(0).alias("kind"), "ord", "surface", "url", "confidence", "method", F.coalesce(work_citation(F.col("work")), F.lit("unresolved")).alias("title"))
    cases = r.cases.select("doc_id", "text_key", "start", "end", F.lit(1).alias("kind"), "ord", "surface", "url", "confidence", "method", F.coalesce(case_citation(F.col("case")), F.lit("unresolved")).alias("title"))

    def link(c: Column) -> Column:
        if fmt == "html":
            shown = F.format_string(
                '<a href="%s" title="%s" data-confidence="%.2f" data-method="%s">%s</a>', html(c["url"]), html(c["title"]), c["confidence"], c["method"], html(c["surface"])
            )
        else:
            shown = F.format_string("[%s](%s)", F.replace(F.replace(c["surface"], F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]")), c["url"])
        return F.when((F.length(c["url"]) > 0) & (c["confidence"] >= min_confidence), shown).otherwise(escape(c["surface"]))

    one = F.struct("start", "kind", "ord", "end", "surface", "url", "confidence", "method", "title")
    marks = works.union(cases).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(one)).alias("marks"))
    both = r.documents.select("doc_id", text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text")).join(marks, ["doc_id", "text_key"], "left")
    text = F.col("text")

    def add(state: Column, c: Column) -> Column:
        before = escape(F.substring(text, state["at"] + 1, c["start"] - state["at"]))
        longer = F.struct(c["end"].alias("at"), F.concat(state["out"], before, link(c)).alias("out"))
        return F.when(c["start"] < state["at"], state).otherwise(longer)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda s: F.concat(s["out"], escape(F.substring(text, s["at"] + 1, F.length(text))))
    return both.select("doc_id", F.coalesce(F.aggregate("marks", start, add, rest), escape(text)).alias("annotated"))


# --- per document ------------------------------------------------------------


def document_stats(r: Resolved) -> DataFrame:
    """One row per doc_id, those without citations included."""
    yes = F.when(F.col("resolved"), 1).otherwise(0)
    works = r.citations.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("citations"), F.sum(yes).alias("resolved"), F.count_distinct("work.id").alias("distinct_works"), _in_order("work").alias("works")
    )
    cases = r.cases.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("case_citations"), F.sum(yes).alias("cases_resolved"), F.count_distinct("case.id").alias("distinct_cases"), _in_order("case").alias("cases")
    )
    joined = r.documents.select("doc_id").distinct().join(works, "doc_id", "left").join(cases, "doc_id", "left")
    zero = {c: 0 for c in ("citations", "resolved", "distinct_works", "case_citations", "cases_resolved", "distinct_cases")}
    none = empty("array<string>")
    filled = joined.fillna(zero).withColumns({c: F.coalesce(c, none) for c in ("works", "cases")})
    return filled.withColumn("unresolved", F.col("citations") - F.col("resolved"))


def _in_order(target: str) -> Column:
    """Distinct ids in the order of their first mention."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("resolved"), F.struct("ord", F.col(f"{target}.id").alias("id")))))
    return F.array_distinct(F.transform(pairs, lambda p: p["id"]))


def _work_json(w: Column) -> Column:
    return F.when(w.isNotNull(), F.struct(*[w[c].alias(c) for c in ("id", "title", "year", "work_type", "number", "aliases")], work_url(w).alias("url"), work_citation(w).alias("citation")))


def _case_json(c: Column) -> Column:
    n = c["neutral"]
    return F.when(
        c.isNotNull(),
        F.struct(c["id"].alias("id"), c["name"].alias("name"), F.when(n.isNotNull(), neutral_text(n)).alias("neutral"), c["reports"].alias("reports"), c["aliases"].alias("aliases"),
                 F.when(n.isNotNull(), judgment_link(n)["url"]).alias("url"), case_citation(c).alias("citation")),
    )


def _rounded(df: DataFrame) -> DataFrame:
    scores = F.transform("candidates", lambda c: F.struct(c["id"].alias("id"), round4(c["score"]).alias("score")))
    return df.withColumn("confidence", round4(F.col("confidence"))).withColumn("candidates", scores)


def to_json(r: Resolved, include_text: bool = False) -> DataFrame:
    """doc_id, json: a document's citations, cases and totals."""
    cites = _rounded(r.citations).withColumnRenamed("label", "provision_label").withColumn("work", _work_json(F.col("work")))
    order = ["ord", "surface", "start", "end", "work_ref", "provisions", "provision_label", "work", "resolved", "confidence", "method", "candidates", "notes", "url", "id_uri", "version"]
    works = cites.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order)), _by_ord).alias("citations_"))
    cases = _rounded(r.cases).withColumn("case", _case_json(F.col("case")))
    order = ["ord", "surface", "start", "end", "case_ref", "case", "resolved", "confidence", "method", "candidates", "notes", "url", "source"]
    judged = cases.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order)), _by_ord).alias("cases_"))
    totals = document_stats(r)
    stats = F.struct("citations", "resolved", "unresolved", "distinct_works", "case_citations", "cases_resolved", "distinct_cases")
    shown = [F.col("text")] if include_text else []
    joined = totals.join(works, "doc_id", "left").join(judged, "doc_id", "left")
    if include_text:
        joined = joined.join(r.documents, "doc_id")
    none = lambda name: F.coalesce(name, F.array().cast(joined.schema[name].dataType))
    whole = F.struct(*shown, none("citations_").alias("citations"), none("cases_").alias("cases"), stats.alias("stats"))
    return joined.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def _by_ord(a: Column, b: Column) -> Column:
    return F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)


def report_table(r: Resolved) -> DataFrame:
    """What a reader sees of each citation: surface cut to 44 characters, target to 46."""
    flat = lambda c, n: F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)
    dash = F.lit("—")
    works = r.citations.select("doc_id", "start", flat("surface", 44).alias("surface"), F.coalesce(flat(work_citation(F.col("work")), 46), dash).alias("resolved_as"), "method", "confidence", F.coalesce("url", dash).alias("url"))
    cases = r.cases.select("doc_id", "start", flat("surface", 44).alias("surface"), F.coalesce(flat(case_citation(F.col("case")), 46), dash).alias("resolved_as"), "method", "confidence", F.coalesce("url", dash).alias("url"))
    return works.union(cases)


# --- the citator -------------------------------------------------------------


#: Documents of a row of postings.
POSTINGS = 1_000


def _hits(rows: DataFrame, target: str) -> DataFrame:
    return rows.filter("resolved").withColumn("id", F.col(f"{target}.id"))


def _directory(r: Resolved, target: str) -> DataFrame:
    """One row per work or case, with its entry as first seen: the documents' citations are read
    once, and the entry is looked up among those of the different texts if texts recur."""
    name = "citations" if target == "work" else "cases"
    hit, entries = _hits(getattr(r, name), target), _hits(getattr(r.once or r, name), target)
    # counts of documents combine before the shuffle, so a work that all cite is no hot key
    docs = hit.groupBy("id", "doc_id").agg(F.min(F.struct("ord", "text_key")).alias("at"), F.count(F.lit(1)).alias("n"))
    totals = docs.groupBy("id").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("documents"), F.min(F.struct("doc_id", "at.ord", "at.text_key")).alias("first_seen"))
    totals = kept(totals, r.held)
    first = totals.select("id", "first_seen.ord", "first_seen.text_key")
    entries = entries.select("id", "ord", "text_key", F.col(target).alias("entry")).join(first, ["id", "ord", "text_key"]).select("id", "entry").dropDuplicates(["id"])
    return totals.join(entries, "id").withColumn("blocks", F.ceil(F.col("documents") / POSTINGS))


def _postings(rows: DataFrame, target: str, whole: str, pin: Column, held: Held) -> DataFrame:
    """Per work or case, blocks of POSTINGS documents with their pinpoints, by doc_id. No row
    grows with the corpus: places come from a range sort and counts of the partitions before."""
    hit = _hits(rows, target).select("id", "doc_id", "ord", F.when(pin != "", pin).otherwise(whole).alias("label"))
    # counts of equal pinpoints combine before the shuffle
    pins = hit.groupBy("id", "doc_id", "label").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))
    # the pinpoints of a document and work lie in one part of the range sort, so they need no shuffle of their own
    docs = pins.repartitionByRange("id", "doc_id").groupBy("id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("pins"), F.sum("n").alias("n"))
    docs = docs.select("id", "doc_id", "n", F.transform("pins", lambda p: p["label"]).alias("pinpoints"))
    placed = kept(docs.sortWithinPartitions("id", "doc_id").withColumn("seq", F.monotonically_increasing_id()), held)
    placed = placed.withColumn("part", F.shiftright("seq", 33))
    runs = placed.groupBy("id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("docs"))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("id", "part", (F.coalesce(F.sum("docs").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    numbered = placed.join(starts, ["id", "part"]).withColumn("place", F.col("seq") + F.col("shift"))
    listed = F.array_sort(F.collect_list(F.struct("place", "doc_id", "pinpoints", "n")), lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0))
    return numbered.groupBy("id", F.expr(f"place div {POSTINGS}").alias("block")).agg(listed.alias("documents"))


_SHOWN = ["mentions", "documents", "blocks"]


def _ordered(directory: DataFrame, entry: Column) -> DataFrame:
    """The most cited first, then the first seen."""
    return directory.select(entry.alias("e"), *_SHOWN, "first_seen").select("e.*", *_SHOWN, "first_seen").orderBy(F.desc("mentions"), "first_seen").drop("first_seen")


def cited_works(r: Resolved) -> DataFrame:
    """The directory of the citator: cited works with mentions, documents and blocks of postings."""
    return _ordered(_directory(r, "work"), _work_json(F.col("entry")))


def cited_cases(r: Resolved) -> DataFrame:
    return _ordered(_directory(r, "case"), _case_json(F.col("entry")))


def cited_by(r: Resolved, kind: str = "work") -> DataFrame:
    """id, block, documents: the postings of cited works (or cases), up to POSTINGS documents a row."""
    if kind == "work":
        return _postings(r.citations, "work", WHOLE_WORK, F.col("label"), r.held)
    return _postings(r.cases, "case", WHOLE_JUDGMENT, F.col("case_ref.pinpoint"), r.held)


def citing_pinpoints(r: Resolved) -> DataFrame:
    """The citator in rows: id, doc_id, pinpoint, n. Scales where a map per work would not."""
    works = r.citations.filter("resolved").select(F.lit("work").alias("kind"), F.col("work.id").alias("id"), "doc_id", F.col("label").alias("p"), F.lit(WHOLE_WORK).alias("whole"))
    cases = r.cases.filter("resolved").select(F.lit("case").alias("kind"), F.col("case.id").alias("id"), "doc_id", F.col("case_ref.pinpoint").alias("p"), F.lit(WHOLE_JUDGMENT).alias("whole"))
    rows = works.union(cases)
    return rows.groupBy("kind", "id", "doc_id", F.when(F.col("p") != "", F.col("p")).otherwise(F.col("whole")).alias("pinpoint")).agg(F.count(F.lit(1)).alias("n"))


def _unresolved(rows: DataFrame, key: Column) -> DataFrame:
    counted = rows.filter("not resolved").groupBy(key.alias("reference")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("doc_id", "ord")).alias("first_seen"))
    return counted.orderBy(F.desc("count"), "first_seen").drop("first_seen")


def unresolved_works(r: Resolved) -> DataFrame:
    title = F.col("work_ref.title")
    return _unresolved(r.citations, F.when(title != "", title).otherwise(F.col("surface")))


def unresolved_cases(r: Resolved) -> DataFrame:
    name = F.col("case_ref.name")
    return _unresolved(r.cases, F.when(name != "", name).otherwise(F.trim(F.regexp_replace("surface", r"(?U)\s+", " "))))


def corpus_stats(r: Resolved) -> DataFrame:
    """One row; citations count if their document has an id, as in ``document_stats``."""
    docs = r.documents.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("documents"))
    named, yes = F.col("doc_id").isNotNull(), F.col("resolved")

    def of(rows: DataFrame, target: str, total: str, resolved: str, distinct: str) -> tuple[DataFrame, DataFrame]:
        # ids are told apart by themselves, so that sums don't pass through their shuffle
        if r.once:
            times = lambda n: F.coalesce(F.sum(n), F.lit(0))
            return rows.agg(times(F.col("named")).alias(total), times(F.when(yes, F.col("named"))).alias(resolved)), rows.agg(F.count_distinct(f"{target}.id").alias(distinct))
        return rows.agg(F.count(F.when(named, 1)).alias(total), F.count(F.when(named & yes, 1)).alias(resolved)), rows.agg(F.count_distinct(f"{target}.id").alias(distinct))

    works, which = of((r.once or r).citations, "work", "total_citations", "resolved_citations", "distinct_works")
    cases, whose = of((r.once or r).cases, "case", "total_case_citations", "resolved_case_citations", "distinct_cases")
    return docs.crossJoin(works).crossJoin(cases).crossJoin(which).crossJoin(whose)  # one row each


def index(r: Resolved) -> dict[str, DataFrame]:
    """The corpus index: documents, works and cases with their postings, unresolved, unresolved_cases, stats."""
    return {
        "documents": document_stats(r).select("doc_id", "citations", "resolved", "works", "case_citations", "cases_resolved", "cases"),
        "works": cited_works(r), "work_postings": cited_by(r), "unresolved": unresolved_works(r),
        "cases": cited_cases(r), "case_postings": cited_by(r, "case"), "unresolved_cases": unresolved_cases(r), "stats": corpus_stats(r),
    }


def write_index(r: Resolved, path: str) -> None:
    for name, df in index(r).items():
        df.write.mode("overwrite").json(f"{path}/{name}")


__all__ = ["Registers", "Resolved", "Settings", "annotate", "extract", "index", "label", "resolve", "to_json"]
