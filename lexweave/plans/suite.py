"""The citation queries and, for each, what it must give, computed another way.

The driver's tables hold no citations, so each query writes them from columns: a
row's text is one of a few templates filled with the row's own values, and the
SQL says what the template stands for, from the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import round4, similarity
from ..operators import cases as C
from ..operators import links as L
from ..operators import resolve as R
from ..operators import verify as V
from ..operators import works as W
from ..sources.registry import Registers, courts
from . import pipeline as P

_held: dict[str, Registers] = {}
L_, T_, B_ = "https://www.legislation.gov.uk", "https://caselaw.nationalarchives.gov.uk", "https://www.bailii.org"


def registers(spark: SparkSession) -> Registers:
    """The seed registers, loaded once in an application."""
    app = spark.sparkContext.applicationId
    if app not in _held:
        _held.clear()
        _held[app] = Registers.default(spark)
    return _held[app]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(key: Column, texts: list[Column]) -> Column:
    out = texts[-1]
    for i, t in reversed(list(enumerate(texts[:-1]))):
        out = F.when(key % len(texts) == i, t).otherwise(out)
    return out


def _say(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _case(key: str, values: list[str]) -> str:
    """SQL: the value of template ``key % n``."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text for each line, of eight kinds."""
    n, k = F.col("l_linenumber"), F.col("l_partkey") % 90 + 1
    texts = [
        _say("See section ", n, " of the Human Rights Act 1998."),
        _say("Under the Theft Act 1968 (c. 60), s ", n, "(", k, ")(a) applies."),
        _say("See ss ", k, " to ", k + 2, " of the Companies Act 2006 today."),
        _say("Relying on paragraph ", k, " of Schedule ", n, " to the Equality Act 2010, they won."),
        _say("The Fictional Widgets Act 1911 (c. ", k, ") is made up."),
        _say("See SI 1950/", k, ", regulation ", n, "."),
        _say("They cite the Interplanetary Sandwich Act 1977, s ", k, " often."),
        _say("See the Working Time Order 1998, regulation ", n, "."),
    ]
    # orders and line numbers recur, so a line is known by these columns together
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    key = F.concat_ws("-", *[c.cast("string") for c in (F.col("l_orderkey"), n, F.col("l_partkey"), F.col("l_suppkey"), cents)])
    return _table(spark, sf_dir, "lineitem").select(key.alias("doc_id"), _choose(F.col("l_orderkey") + n, texts).alias("text"))


LINES = f"""
SELECT doc_id, t, n, k,
  {_case('t', ["'section ' || n || ' of the Human Rights Act 1998'", "'Theft Act 1968 (c. 60), s ' || n || '(' || k || ')(a)'", "'ss ' || k || ' to ' || (k + 2) || ' of the Companies Act 2006'",
               "'paragraph ' || k || ' of Schedule ' || n || ' to the Equality Act 2010'", "'The Fictional Widgets Act 1911 (c. ' || k || ')'", "'SI 1950/' || k || ', regulation ' || n",
               "'Interplanetary Sandwich Act 1977, s ' || k", "'Working Time Order 1998, regulation ' || n"])} AS surface,
  {_case('t', ['4', '10', '4', '11', '0', '4', '14', '8'])} AS start,
  {_case('t', ["'ukpga-1998-42'", "'ukpga-1968-60'", "'ukpga-2006-46'", "'ukpga-2010-15'", "'ukpga-1911-' || k", "'uksi-1950-' || k", 'NULL', "'uksi-1998-1833'"])} AS work_id,
  {_case('t', ["'exact'", "'number'", "'exact'", "'exact'", "'number'", "'number'", "'unresolved'", "'exact'"])} AS method,
  {_case('t', ['1.0', '1.0', '1.0', '1.0', '0.95', '0.95', '0.0', '1.0'])}::DOUBLE AS confidence,
  {_case('t', [f"'{L_}/ukpga/1998/42/section/' || n", f"'{L_}/ukpga/1968/60/section/' || n || '#section-' || n || '-' || k || '-a'", f"'{L_}/ukpga/2006/46/section/' || k",
               f"'{L_}/ukpga/2010/15/schedule/' || n || '/paragraph/' || k", f"'{L_}/ukpga/1911/' || k", f"'{L_}/uksi/1950/' || k || '/regulation/' || n",
               f"'{L_}/all?title=Interplanetary+Sandwich+Act&year=1977'", f"'{L_}/uksi/1998/1833/regulation/' || n"])} AS url,
  {_case('t', [f"'{L_}/id/ukpga/1998/42/section/' || n", f"'{L_}/id/ukpga/1968/60/section/' || n || '/' || k || '/a'", f"'{L_}/id/ukpga/2006/46/section/' || k",
               f"'{L_}/id/ukpga/2010/15/schedule/' || n || '/paragraph/' || k", f"'{L_}/id/ukpga/1911/' || k", f"'{L_}/id/uksi/1950/' || k || '/regulation/' || n", 'NULL',
               f"'{L_}/id/uksi/1998/1833/regulation/' || n"])} AS id_uri,
  {_case('t', ["'section ' || n", "'section ' || n || '(' || k || ')(a)'", "'section ' || k || ' to ' || (k + 2)", "'schedule ' || n || ', paragraph ' || k", "''", "'regulation ' || n", "'section ' || k", "'regulation ' || n"])} AS label
FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS doc_id, (l_orderkey + l_linenumber) % 8 AS t, l_linenumber AS n, l_partkey % 90 + 1 AS k FROM lineitem)
"""


def citations_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a text per line, each citation with offsets, target, method, page and identifier."""
    r = P.resolve(_lineitem(spark, sf_dir), registers(spark))
    return r.citations.select("doc_id", "surface", "start", "end", F.col("work.id").alias("work_id"), "method", "confidence", "url", "id_uri", "label")


FULL = f"SELECT doc_id, surface, start::INT AS start, (start + length(surface))::INT AS \"end\", work_id, method, confidence, url, id_uri, label FROM ({LINES})"


def citator_pinpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.resolve(_lineitem(spark, sf_dir), registers(spark))
    # a document has one row of a work and pinpoint
    rows = P.citing_pinpoints(r).filter("kind = 'work'")
    return rows.groupBy("id", "pinpoint").agg(F.count("doc_id").alias("documents"), F.sum("n").alias("mentions"))


PINPOINTS = f"SELECT work_id AS id, CASE WHEN label = '' THEN '(whole work)' ELSE label END AS pinpoint, count(DISTINCT doc_id) AS documents, count(*)::BIGINT AS mentions FROM ({LINES}) WHERE work_id IS NOT NULL GROUP BY ALL"


def citator_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cited_works(P.resolve(_lineitem(spark, sf_dir), registers(spark)))
    return found.select("id", "citation", "url", "mentions", "documents")


WORKS = f"""
SELECT work_id AS id, {_case("any_value(t)", ["'Human Rights Act 1998 (c. 42)'", "'Theft Act 1968 (c. 60)'", "'Companies Act 2006 (c. 46)'", "'Equality Act 2010 (c. 15)'",
  "'Fictional Widgets Act (c. ' || any_value(k) || ')'", "'uksi 1950/' || any_value(k) || ' (SI 1950/' || any_value(k) || ')'", "NULL", "'The Working Time Regulations 1998 (SI 1998/1833)'"])} AS citation,
  '{L_}/' || replace(work_id, '-', '/') AS url, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS documents
FROM ({LINES}) WHERE work_id IS NOT NULL GROUP BY work_id
"""


def citator_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of documents that cite a work: how many, from which to which, and with how many pinpoints."""
    blocks = P.cited_by(P.resolve(_lineitem(spark, sf_dir), registers(spark)))
    d = F.col("documents")
    return blocks.select(
        "id", "block", F.size(d).cast("long").alias("documents"), F.get(d, 0)["doc_id"].alias("first"), F.try_element_at(d, F.lit(-1))["doc_id"].alias("last"),
        F.aggregate(d, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("mentions"), F.md5(F.array_join(F.flatten(F.transform(d, lambda x: x["pinpoints"])), "|").cast("binary")).alias("pinpoints"),
    )


POSTED = f"""
WITH x AS (SELECT work_id AS id, doc_id, CASE WHEN label = '' THEN '(whole work)' ELSE label END AS p, count(*) AS n FROM ({LINES}) WHERE work_id IS NOT NULL GROUP BY ALL),
y AS (SELECT *, (row_number() OVER (PARTITION BY id ORDER BY doc_id) - 1) // 1000 AS block FROM x)
SELECT id, block::BIGINT AS block, count(*) AS documents, min(doc_id) AS first, max(doc_id) AS last, sum(n)::BIGINT AS mentions, md5(string_agg(p, '|' ORDER BY doc_id)) AS pinpoints FROM y GROUP BY id, block
"""


def citator_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each work in the index. The window runs over one row per work."""
    found = P.cited_works(P.resolve(_lineitem(spark, sf_dir), registers(spark)))
    return found.withColumn("seq", F.monotonically_increasing_id()).select("id", F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"))


ORDERED = f"SELECT work_id AS id, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) AS place FROM ({LINES}) WHERE work_id IS NOT NULL GROUP BY work_id"


def citator_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unresolved_works(P.resolve(_lineitem(spark, sf_dir), registers(spark)))


UNRESOLVED = f"SELECT 'Interplanetary Sandwich Act' AS reference, count(*) AS count FROM ({LINES}) WHERE work_id IS NULL HAVING count(*) > 0"


def citator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.corpus_stats(P.resolve(_lineitem(spark, sf_dir), registers(spark)))


STATS = f"""
SELECT (SELECT count(*) FROM lineitem) AS documents, count(*) AS total_citations, count(work_id) AS resolved_citations, 0::BIGINT AS total_case_citations,
  0::BIGINT AS resolved_case_citations, count(DISTINCT work_id) AS distinct_works, 0::BIGINT AS distinct_cases FROM ({LINES})
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several citations: definitions, back-references, context."""
    k = F.col("o_orderkey") % 40 + 1
    texts = [
        _say('The Data Protection Act 2018 ("the DPA") applies. Section ', k, " of the DPA is engaged."),
        _say("The Theft Act 1968 applies. The 1968 Act was later amended. Section ", k, " remains."),
        _say("See the Theft Act 1968 and SI 2017/692. The Act, s ", k, ", governs."),
        _say("The Theft Act 1968 and the Working Time Regulations 1998 apply. The Regulations, reg ", k, ", bite."),
        _say("The Act is in force, see s ", k, "."),
        _say("The court applied the PACE codes and TUPE, reg ", k, "."),
        _say("The 1861 Act was cited. The Data Protecton Act 2018, s ", k, "."),
    ]
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), _choose(F.col("o_orderkey"), texts).alias("text"))


def back_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.resolve(_orders(spark, sf_dir), registers(spark))
    return r.citations.select("doc_id", "ord", "surface", F.col("work.id").alias("work_id"), "method", round4(F.col("confidence")).alias("confidence"), "url", F.array_join("notes", "; ").alias("notes"))


def _back_rows() -> str:
    dpa, theft, wtr = "ukpga/2018/12", "ukpga/1968/60", "uksi/1998/1833"
    rows: list[list[tuple]] = [
        [("'The Data Protection Act 2018'", dpa, "exact", 1.0, "''", ""), ("'the DPA'", dpa, "short-form", 0.92, "''", ""), ("'Section ' || k || ' of the DPA'", dpa, "short-form", 0.92, "'/section/' || k", "")],
        [("'The Theft Act 1968'", theft, "exact", 1.0, "''", ""), ("'The 1968 Act'", theft, "anaphora", 0.9, "''", ""), ("'Section ' || k", theft, "context", 0.7, "'/section/' || k", "pinpoint attached to most recent work")],
        [("'Theft Act 1968'", theft, "exact", 1.0, "''", ""), ("'SI 2017/692'", "uksi/2017/692", "number", 1.0, "''", ""), ("'The Act, s ' || k", theft, "anaphora", 0.8, "'/section/' || k", "")],
        [("'The Theft Act 1968'", theft, "exact", 1.0, "''", ""), ("'Working Time Regulations 1998'", wtr, "exact", 1.0, "''", ""), ("'The Regulations, reg ' || k", wtr, "anaphora", 0.8, "'/regulation/' || k", "")],
        [("'The Act'", None, "unresolved", 0.0, "''", "back-reference with no antecedent"), ("'s ' || k", None, "unresolved", 0.0, "''", "pinpoint with no antecedent work")],
        [("'the PACE'", "ukpga/1984/60", "alias", 0.88, "''", ""), ("'TUPE, reg ' || k", "uksi/2006/246", "alias", 0.88, "'/regulation/' || k", "")],
        [("'The 1861 Act'", "ukpga/1861/100", "anaphora", 0.65, "''", "year matched the registry, not the document"), ("'The Data Protecton Act 2018, s ' || k", dpa, "fuzzy", 0.973, "'/section/' || k", "")],
    ]
    out = []
    for t, cites in enumerate(rows):
        for i, (surface, path, method, confidence, end, note) in enumerate(cites):
            work = f"'{path.replace('/', '-')}'" if path else "NULL"
            url = f"'{L_}/{path}' || {end}" if path else f"'{L_}/all'"
            out.append(f"SELECT doc_id, {i} AS ord, {surface} AS surface, {work} AS work_id, '{method}' AS method, {confidence}::DOUBLE AS confidence, {url} AS url, '{note}' AS notes FROM o WHERE t = {t}")
    return "WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 7 AS t, o_orderkey % 40 + 1 AS k FROM orders) " + " UNION ALL ".join(out)


def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.document_stats(P.resolve(_orders(spark, sf_dir), registers(spark)))
    return stats.select("doc_id", "citations", "resolved", "unresolved", "distinct_works", F.array_join("works", ",").alias("works"), "case_citations", "cases_resolved", "distinct_cases")


TOTALS = f"""
SELECT o_orderkey AS doc_id, {_case('o_orderkey', ['3', '3', '3', '3', '2', '2', '2'])}::BIGINT AS citations, {_case('o_orderkey', ['3', '3', '3', '3', '0', '2', '2'])}::BIGINT AS resolved,
  {_case('o_orderkey', ['0', '0', '0', '0', '2', '0', '0'])}::BIGINT AS unresolved, {_case('o_orderkey', ['1', '1', '2', '2', '0', '2', '2'])}::BIGINT AS distinct_works,
  {_case('o_orderkey', ["'ukpga-2018-12'", "'ukpga-1968-60'", "'ukpga-1968-60,uksi-2017-692'", "'ukpga-1968-60,uksi-1998-1833'", "''", "'ukpga-1984-60,uksi-2006-246'", "'ukpga-1861-100,ukpga-2018-12'"])} AS works,
  0::BIGINT AS case_citations, 0::BIGINT AS cases_resolved, 0::BIGINT AS distinct_cases FROM orders
"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case citations of each rung of the ladder."""
    k = F.col("c_custkey") % 60 + 1
    texts = [
        _say("See R (Miller) v Prime Minister [2019] UKSC 41 at [", k, "]."),
        _say("Following Smith v Jones [2020] EWCA Civ ", k, ", costs follow."),
        _say("See Patel v Mirza [2017] AC 467 at [", k, "]."),
        _say("It was reported at [2020] AC 373."),
        _say("See Essop v Home Office [2017] WLR 1343 at para ", k, "."),
        _say("The case of Lachaux v Smith [2020] AC 612 differs."),
        _say("The principle in Montgomery v Lanarkshire Health Board applies."),
        _say("See Patel v Mirza [2006] AC ", k, "."),
        _say("Applying Donoghue v Stevenson [1932] AC 562, it failed."),
        _say("In Re X [2010] NIQB ", k, " relief was refused."),
        _say("See [2019] EWHC ", k, " (ch); [2019] EWHC ", k + 1, "."),
        _say("As in Hill v Hall [1999] UKHL ", k, ", no."),
    ]
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _choose(F.col("c_custkey"), texts).alias("text"))


def case_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.resolve(_customers(spark, sf_dir), registers(spark))
    return r.cases.select(
        "doc_id", "ord", "surface", F.col("case_ref.name").alias("name"), F.col("case_ref.pinpoint").alias("pinpoint"), F.col("case.id").alias("case_id"), "method", "confidence",
        F.array_join(F.transform("candidates", lambda c: c["id"]), ",").alias("candidates"), "url", "source",
    )


def _case_rows() -> str:
    q = f"{T_}/search?query="
    rows: list[list[tuple]] = [
        [("'R (Miller) v Prime Minister [2019] UKSC 41 at [' || k || ']'", "'R (Miller) v Prime Minister'", "'[' || k || ']'", "'uksc-2019-41'", "neutral", 1.0, "", f"'{T_}/uksc/2019/41'", "tna")],
        [("'Smith v Jones [2020] EWCA Civ ' || k", "'Smith v Jones'", "NULL", "'ewca-civ-2020-' || k", "neutral", 0.95, "", f"'{T_}/ewca/civ/2020/' || k", "tna")],
        [("'Patel v Mirza [2017] AC 467 at [' || k || ']'", "'Patel v Mirza'", "'[' || k || ']'", "'uksc-2016-42'", "report", 0.95, "", f"'{T_}/uksc/2016/42'", "tna")],
        [("'[2020] AC 373'", "NULL", "NULL", "'uksc-2019-41'", "report", 0.85, "", f"'{T_}/uksc/2019/41'", "tna")],
        [("'Essop v Home Office [2017] WLR 1343 at para ' || k", "'Essop v Home Office'", "'para ' || k", "'uksc-2017-27'", "report", 0.9, "", f"'{T_}/uksc/2017/27'", "tna")],
        [("'Lachaux v Smith [2020] AC 612'", "'Lachaux v Smith'", "NULL", "NULL", "unresolved", 0.0, "uksc-2019-27", f"'{q}Lachaux+v+Smith'", "search")],
        [("'Montgomery v Lanarkshire Health Board'", "'Montgomery v Lanarkshire Health Board'", "NULL", "'uksc-2015-11'", "name", 0.9, "", f"'{T_}/uksc/2015/11'", "tna")],
        [("'Patel v Mirza [2006] AC ' || k", "'Patel v Mirza'", "NULL", "NULL", "unresolved", 0.0, "", f"'{q}Patel+v+Mirza'", "search")],
        [("'Donoghue v Stevenson [1932] AC 562'", "'Donoghue v Stevenson'", "NULL", "NULL", "unresolved", 0.0, "", f"'{q}Donoghue+v+Stevenson'", "search")],
        [("'Re X [2010] NIQB ' || k", "'Re X'", "NULL", "'niqb-2010-' || k", "neutral", 0.95, "", "NULL", None)],
        [("'[2019] EWHC ' || k || ' (ch)'", "NULL", "NULL", "'ewhc-ch-2019-' || k", "neutral", 0.95, "", f"'{T_}/ewhc/ch/2019/' || k", "tna"),
         ("'[2019] EWHC ' || (k + 1)", "NULL", "NULL", "'ewhc-2019-' || (k + 1)", "neutral", 0.95, "", f"'{q}%5B2019%5D+EWHC+' || (k + 1)", "search")],
        [("'Hill v Hall [1999] UKHL ' || k", "'Hill v Hall'", "NULL", "'ukhl-1999-' || k", "neutral", 0.95, "", f"'{B_}/uk/cases/UKHL/1999/' || k || '.html'", "bailii")],
    ]
    out = []
    for t, cites in enumerate(rows):
        for i, (surface, name, pin, case, method, confidence, candidates, url, source) in enumerate(cites):
            shown = f"'{source}'" if source else "NULL"
            out.append(f"SELECT doc_id, {i} AS ord, {surface} AS surface, {name} AS name, {pin} AS pinpoint, {case} AS case_id, '{method}' AS method, {confidence}::DOUBLE AS confidence, '{candidates}' AS candidates, {url} AS url, {shown} AS source FROM c WHERE t = {t}")
    return "WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 12 AS t, c_custkey % 60 + 1 AS k FROM customer) " + " UNION ALL ".join(out)


def citator_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.cited_cases(P.resolve(_customers(spark, sf_dir), registers(spark)))
    return found.select("id", "mentions", "documents")


CASES = "SELECT case_id AS id, count(*)::BIGINT AS mentions, count(DISTINCT doc_id)::BIGINT AS documents FROM ({}) WHERE case_id IS NOT NULL GROUP BY case_id"


def citator_unresolved_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unresolved_cases(P.resolve(_customers(spark, sf_dir), registers(spark)))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    texts = [
        _say("A & B <cited> the Human Rights Act 1998, s ", size, ", and Patel v Mirza [2016] UKSC 42."),
        _say("The Companies Act 2006 applies. Section ", size, " imposes a duty."),
        _say("No law in part \"", F.col("p_name"), "\" at all."),
    ]
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), _choose(F.col("p_partkey"), texts).alias("text"))


def annotated_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.annotate(P.resolve(_parts(spark, sf_dir), registers(spark)))


def annotated_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.annotate(P.resolve(_parts(spark, sf_dir), registers(spark)), "html", 0.9)


def _annotated(html: bool) -> str:
    size, name = "p_size", "p_name"
    hra, ca, pm = f"{L_}/ukpga/1998/42/section/", f"{L_}/ukpga/2006/46", f"{T_}/uksc/2016/42"
    if html:
        link = lambda url, title, c, m, s: f"'<a href=\"' || {url} || '\" title=\"{title}\" data-confidence=\"{c}\" data-method=\"{m}\">' || {s} || '</a>'"
        one = f"'A &amp; B &lt;cited&gt; the ' || {link(f"'{hra}' || {size}", 'Human Rights Act 1998 (c. 42)', '1.00', 'exact', f"'Human Rights Act 1998, s ' || {size}")} || ', and ' || {link(f"'{pm}'", 'Patel v Mirza [2016] UKSC 42, [2017] AC 467', '1.00', 'neutral', "'Patel v Mirza [2016] UKSC 42'")} || '.'"
        two = f"{link(f"'{ca}'", 'Companies Act 2006 (c. 46)', '1.00', 'exact', "'The Companies Act 2006'")} || ' applies. Section ' || {size} || ' imposes a duty.'"
        three = f"'No law in part &quot;' || {name} || '&quot; at all.'"
    else:
        one = f"'A & B <cited> the [Human Rights Act 1998, s ' || {size} || ']({hra}' || {size} || '), and [Patel v Mirza \\[2016\\] UKSC 42]({pm}).'"
        two = f"'[The Companies Act 2006]({ca}) applies. [Section ' || {size} || ']({ca}/section/' || {size} || ') imposes a duty.'"
        three = f"'No law in part \"' || {name} || '\" at all.'"
    return f"SELECT p_partkey AS doc_id, {_case('p_partkey', [one, two, three])} AS annotated FROM part"


def documents_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's JSON, read back: totals, first surface and page, rounded confidence."""
    found = P.to_json(P.resolve(_parts(spark, sf_dir), registers(spark)), include_text=True)
    get = lambda path: F.get_json_object("json", path)
    return found.select(
        "doc_id", get("$.stats.citations").cast("long").alias("citations"), get("$.stats.case_citations").cast("long").alias("case_citations"), get("$.citations[0].provision_label").alias("label"),
        get("$.citations[0].work.citation").alias("citation"), get("$.cases[0].case.neutral").alias("neutral"), F.length(get("$.text")).cast("long").alias("length"),
    )


JSON = f"""
SELECT p_partkey AS doc_id, {_case('p_partkey', ['1', '2', '0'])}::BIGINT AS citations, {_case('p_partkey', ['1', '0', '0'])}::BIGINT AS case_citations,
  {_case('p_partkey', ["'section ' || p_size", "''", 'NULL'])} AS label, {_case('p_partkey', ["'Human Rights Act 1998 (c. 42)'", "'Companies Act 2006 (c. 46)'", 'NULL'])} AS citation,
  {_case('p_partkey', ["'[2016] UKSC 42'", 'NULL', 'NULL'])} AS neutral,
  length({_case('p_partkey', ["'A & B <cited> the Human Rights Act 1998, s ' || p_size || ', and Patel v Mirza [2016] UKSC 42.'", "'The Companies Act 2006 applies. Section ' || p_size || ' imposes a duty.'", "'No law in part \"' || p_name || '\" at all.'"])})::BIGINT AS length
FROM part
"""


def embedded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real texts around a citation: offsets are code points of the whole document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n\nSee section "), (F.col("doc_id") % 200).cast("string"), F.lit(" of the Human Rights Act 1998.\n\n"), "text").alias("text"))
    r = P.resolve(docs, registers(spark))
    # texts have pinpoints of their own ("SS 49"), which are put down to the Act by context but don't name it
    return r.citations.filter((F.col("work.id") == "ukpga-1998-42") & (F.col("method") == "exact")).select("doc_id", "start", "end", "url")


EMBEDDED = f"""
SELECT doc_id, (length(text) + 6)::INT AS start, (length(text) + 6 + length('section ' || doc_id % 200 || ' of the Human Rights Act 1998'))::INT AS "end",
  '{L_}/ukpga/1998/42/section/' || doc_id % 200 AS url FROM documents WHERE text IS NOT NULL
"""


def versioned_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a version. After a single subdivision the title begins with its
    bracket, as after any word, and the citation is of the whole work; not so after two."""
    k = F.col("s_suppkey")
    texts = [_say("See section ", k, "(1) of the Human Rights Act 1998."), _say("See section ", k, "(1)(b) of the Human Rights Act 1998.")]
    docs = _table(spark, sf_dir, "supplier").select(k.alias("doc_id"), _choose(k, texts).alias("text"))
    # the citations are resolved once; a version only changes their links
    cites = P.resolve(docs, registers(spark)).citations.select("doc_id", "work", "provisions", "work_ref")
    out = None
    for text in ("latest", "prospective", "original", "as-at:1999-02-01"):
        links = L.work_links(F.col("work"), F.col("provisions"), F.col("work_ref.title"), F.col("work_ref.year"), *L.version(text))
        one = cites.withColumn("links", links).select("doc_id", F.lit(text).alias("asked"), "links.url", "links.id_uri")
        out = one if out is None else out.union(one)
    return out


VERSIONED = " UNION ALL ".join(
    f"SELECT s_suppkey AS doc_id, '{text}' AS asked, {_case('s_suppkey', [f"'{L_}/ukpga/1998/42{end}'", f"'{L_}/ukpga/1998/42/section/' || s_suppkey || '{end}#section-' || s_suppkey || '-1-b'"])} AS url, "
    f"{_case('s_suppkey', [f"'{L_}/id/ukpga/1998/42'", f"'{L_}/id/ukpga/1998/42/section/' || s_suppkey || '/1/b'"])} AS id_uri FROM supplier"
    for text, end in (("latest", ""), ("prospective", ""), ("original", "/enacted"), ("as-at:1999-02-01", "/1999-02-01"))
)


def pinpoint_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of a nested pinpoint a page's path names."""
    k = F.col("s_suppkey")
    texts = [_say("Part ", k, " of Schedule 2 to the Companies Act 2006"), _say("section ", k, " of Part 2 of the Companies Act 2006"), _say("Part ", k, " of the Companies Act 2006"),
             _say("sections ", k, ", ", k + 1, " and ", k + 2, "A of the Companies Act 2006"), _say("paragraph ", k, " of Part 2 of Schedule 1 to the Companies Act 2006")]
    docs = _table(spark, sf_dir, "supplier").select(k.alias("doc_id"), _choose(k, texts).alias("text"))
    r = P.resolve(docs, registers(spark))
    return r.citations.select("doc_id", "url", L.labels(F.col("provisions")).alias("label"), F.array_join("notes", "; ").alias("notes"))


TARGETS = f"""
SELECT s_suppkey AS doc_id, '{L_}/ukpga/2006/46' || {_case('s_suppkey', ["'/schedule/2'", "'/section/' || s_suppkey", "'/part/' || s_suppkey", "'/section/' || s_suppkey", "'/schedule/1/paragraph/' || s_suppkey"])} AS url,
  {_case('s_suppkey', ["'schedule 2, part ' || s_suppkey", "'part 2, section ' || s_suppkey", "'part ' || s_suppkey", "'section ' || s_suppkey || ', section ' || (s_suppkey + 1) || ', section ' || (s_suppkey + 2) || 'A'", "'schedule 1, part 2, paragraph ' || s_suppkey"])} AS label,
  {_case('s_suppkey', ["''", "''", "''", "'3 provisions cited; url is the first'", "''"])} AS notes FROM supplier
"""


def _part_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of works from parts: every part is an Act of a year, known by two aliases, and
    loaded again with a third, under another title that doesn't count."""
    key, name = F.col("p_partkey"), F.col("p_name")
    entry = lambda title, aliases: F.struct(F.lit(None).cast("string").alias("id"), title.alias("title"), (key % 200 + 1800).cast("int").alias("year"), F.lit("ukpga").alias("work_type"), key.cast("string").alias("number"), aliases.alias("aliases"))
    first = entry(F.concat(F.initcap(name), F.lit(" Act")), F.array(F.concat(F.lit("P"), key), F.concat(F.lit("ALL"), key % 3)))
    again = entry(F.concat(name, F.lit(" again")), F.array(F.concat(F.lit("Q"), key), F.concat(F.lit("P"), key)))
    return _table(spark, sf_dir, "part").select(F.explode(F.array(F.struct(F.lit(0).alias("at"), first.alias("e")), F.struct(F.lit(1).alias("at"), again.alias("e")))).alias("x")).orderBy("x.at", "x.e.year", F.col("x.e.number").cast("long")).select("x.e.*")


def _supplier_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A register of cases from suppliers; every tenth is loaded again with another name and report."""
    key = F.col("s_suppkey")
    entry = lambda name, page: F.struct(F.lit(None).cast("string").alias("id"), name.alias("name"), F.concat(F.lit("[2010] UKSC "), key).alias("neutral"), F.array(F.concat(F.lit("[2011] 1 AC "), page)).alias("reports"), F.array(F.concat(F.lit("Re Supplier "), key)).alias("aliases"))
    first, again = entry(F.concat(F.lit("Smith"), key, F.lit(" v Jones")), key), entry(F.concat(F.lit("Brown"), key, F.lit(" v Jones")), key + 2_000)
    rows = F.filter(F.array(F.struct(F.lit(0).alias("at"), first.alias("e")), F.struct(F.lit(1).alias("at"), again.alias("e"))), lambda x: (x["at"] == 0) | (key % 10 == 0))
    return _table(spark, sf_dir, "supplier").select(F.explode(rows).alias("x")).orderBy("x.at", "x.e.neutral").select("x.e.*")


def _table_registers(spark: SparkSession, sf_dir: str) -> Registers:
    return Registers.from_entries([_part_works(spark, sf_dir)], [_supplier_cases(spark, sf_dir)])


def register_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works loaded twice: the first entry stands, aliases are joined; the listing of a year too."""
    found = _table_registers(spark, sf_dir)
    rows = found.works.select("work.*").select("id", "title", "year", F.array_join("aliases", ",").alias("aliases"), F.lit("all").alias("of"))
    listed = found.list_works(1807, 1_000_000).select("id", "title", "year", F.array_join("aliases", ",").alias("aliases"), F.lit("1807").alias("of"))
    numbered = found.by_number(1803, "3").select("id", "title", "year", F.array_join("aliases", ",").alias("aliases"), F.lit("number").alias("of"))
    by_alias = found.by_alias("the ALL2").select("id", "title", "year", F.array_join("aliases", ",").alias("aliases"), F.lit("alias").alias("of"))
    return rows.union(listed).union(numbered).union(by_alias)


_INITCAP = "list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ')"
REGISTERED = f"""
WITH w AS (SELECT 'ukpga-' || (p_partkey % 200 + 1800) || '-' || p_partkey AS id, {_INITCAP} || ' Act' AS title, (p_partkey % 200 + 1800)::INT AS year,
  'P' || p_partkey || ',ALL' || (p_partkey % 3) || ',Q' || p_partkey AS aliases, p_partkey AS k FROM part)
SELECT id, title, year, aliases, 'all' AS of FROM w UNION ALL SELECT id, title, year, aliases, '1807' FROM w WHERE year = 1807
UNION ALL SELECT id, title, year, aliases, 'number' FROM w WHERE k = 3 UNION ALL SELECT id, title, year, aliases, 'alias' FROM w WHERE k % 3 = 2
"""


def register_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases loaded twice: the last entry stands, and the keys of the first are gone."""
    found = _table_registers(spark, sf_dir)
    keys = found.case_lookups.select("kind", "key", F.explode("cases").alias("c"))
    return keys.select("kind", "key", F.col("c.id").alias("id"), F.col("c.name").alias("name"))


CASES_REGISTERED = """
WITH c AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 0 THEN 'Brown' ELSE 'Smith' END || s_suppkey || ' v Jones' AS name, CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey + 2000 ELSE s_suppkey END AS page FROM supplier)
SELECT x.kind, x.key, 'uksc-2010-' || k AS id, name FROM c, unnest([{'kind': 'strict', 'key': '2011|1|ac|' || page}, {'kind': 'loose', 'key': '2011|*|ac|' || page}, {'kind': 'name', 'key': lower(name)},
  {'kind': 'name', 'key': 're supplier ' || k}, {'kind': 'neutral', 'key': '[2010] uksc ' || k}]) t(x)
"""


def register_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many works and cases the registers of parts and suppliers have, and with some entries added."""
    found = _table_registers(spark, sf_dir)
    extra = _part_works(spark, sf_dir).withColumn("year", F.col("year") + 200)
    return found.sizes().withColumn("of", F.lit("tables")).union(found.add(works=extra).sizes().withColumn("of", F.lit("added")))


def registered_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that cite works and cases of registers made from tables: by title, direct alias, alias of several works, number, report, name."""
    k, s = F.col("p_partkey"), F.col("p_size")
    texts = [
        _say("See section ", s, " of the ", F.initcap("p_name"), " Act ", k % 200 + 1800, "."),
        _say("Under P", k, ", s ", s, ", it falls."),
        _say("Under ALL", k % 3, ", s ", s, ", it falls."),
        _say("The Nonesuch Act ", k % 200 + 1800, " (c. ", k, ") has a number."),
        _say("The ", k % 200 + 1800, " Act is a guess."),
    ]
    docs = _table(spark, sf_dir, "part").select(k.alias("doc_id"), _choose(k, texts).alias("text"))
    r = P.resolve(docs, _table_registers(spark, sf_dir))
    return r.citations.select("doc_id", "surface", F.col("work.id").alias("work_id"), "method", "confidence", F.size("candidates").cast("long").alias("candidates"), F.array_join("notes", "; ").alias("notes"))


def _registered_sql() -> str:
    own = "'ukpga-' || y || '-' || k"
    rows = [
        ("'section ' || s || ' of the ' || n || ' Act ' || y", f"CASE WHEN twins = 1 THEN {own} ELSE first_twin END", "'exact'", "CASE WHEN twins = 1 THEN 1.0 ELSE 0.9 END", "0", "CASE WHEN twins = 1 THEN '' ELSE 'ambiguous title; first match used' END"),
        ("'P' || k || ', s ' || s", own, "'alias'", "0.88", "0", "''"),
        ("'ALL' || (k % 3) || ', s ' || s", "first_all", "'alias'", "CASE WHEN alls = 1 THEN 0.88 ELSE 0.7 END", "0", "CASE WHEN alls = 1 THEN '' ELSE 'ambiguous acronym; first match used' END"),
        ("'The Nonesuch Act ' || y || ' (c. ' || k || ')'", own, "'number'", "1.0", "0", "''"),
        ("'The ' || y || ' Act'", f"CASE WHEN of_year = 1 THEN {own} END", "CASE WHEN of_year = 1 THEN 'anaphora' ELSE 'unresolved' END", "CASE WHEN of_year = 1 THEN 0.65 ELSE 0.0 END",
         "CASE WHEN of_year = 1 THEN 0 ELSE least(of_year, 5) END", "CASE WHEN of_year = 1 THEN 'year matched the registry, not the document' ELSE 'no work from ' || y || ' mentioned earlier' END"),
    ]
    column = lambda i: _case("k", [r[i] for r in rows])
    return f"""
WITH p AS (SELECT p_partkey AS k, p_size AS s, p_partkey % 200 + 1800 AS y, {_INITCAP} AS n FROM part),
q AS (SELECT *, count(*) OVER (PARTITION BY n, y) AS twins, count(*) OVER (PARTITION BY k % 3) AS alls, count(*) OVER (PARTITION BY y) AS of_year,
  first_value('ukpga-' || y || '-' || k) OVER (PARTITION BY n, y ORDER BY k) AS first_twin, first_value('ukpga-' || y || '-' || k) OVER (PARTITION BY k % 3 ORDER BY y, k) AS first_all FROM p)
SELECT k AS doc_id, {column(0)} AS surface, {column(1)} AS work_id, {column(2)} AS method, ({column(3)})::DOUBLE AS confidence, ({column(4)})::BIGINT AS candidates, {column(5)} AS notes FROM q
"""


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part's name with a letter too many, the equally best of at most five works in
    the register of parts: of its year, or, where that year has none, the most recent at a penalty."""
    name = F.concat(F.lower("p_name"), F.lit("x act"))
    probes = _table(spark, sf_dir, "part").select(name.alias("norm"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 200 + 1800).otherwise(1700).cast("int").alias("year"))
    found = R.search_works(probes, _table_registers(spark, sf_dir), 0.6)
    best = F.filter("found", lambda f: f["score"] == F.get("found", 0)["score"])
    return found.select("norm", "year", F.posexplode(best).alias("place", "f")).select("norm", "year", "place", F.col("f.work.id").alias("work_id"), round4(F.col("f.score")).alias("score"))


#: all letters of the title are matched, one of the probe is over
FUZZY = """
WITH w AS (SELECT p_partkey AS k, lower(p_name) AS n, p_partkey % 200 + 1800 AS y FROM part),
p AS (SELECT DISTINCT n, CASE WHEN k % 2 = 0 THEN y ELSE 1700 END AS year FROM w),
m AS (SELECT p.n, p.year, w.y, w.k, row_number() OVER (PARTITION BY p.n, p.year ORDER BY w.y DESC, w.k) - 1 AS place FROM p JOIN w ON w.n = p.n AND (w.y = p.year OR p.year = 1700))
SELECT n || 'x act' AS norm, year::INT AS year, place::INT AS place, 'ukpga-' || y || '-' || k AS work_id,
  round(CASE WHEN year = 1700 THEN 0.75 ELSE 1 END * 2.0 * (length(n) + 4) / (2.0 * (length(n) + 4) + 1), 4)::DOUBLE AS score FROM m WHERE place < 5
"""


def _part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages of the works made from parts say: the title, another one, nothing, no answer."""
    k, title = F.col("p_partkey"), F.concat(F.initcap("p_name"), F.lit(" Act"))
    url = F.concat(F.lit(f"{L_}/ukpga/"), k % 200 + 1800, F.lit("/"), k)
    bodies = [
        F.concat(F.lit("<html><title>\n  "), title, F.lit("\t 1999 </title><title>no</title>")), F.concat(F.lit("<TITLE>"), title, F.repeat(F.lit("7"), F.length("p_name") + 4), F.lit("</Title>")),
        F.lit("<title>not found</title>"), F.lit(None).cast("string"), F.lit("<p>no title</p>"), F.concat(F.lit("<title>"), title, F.lit("7</title>")), F.lit(""),
    ]
    status = F.when(k % 7 == 2, 404).when(k % 7 != 3, 200)
    made = _table(spark, sf_dir, "part").select(k.alias("k"), url.alias("url"), status.cast("int").alias("status"), _choose(k, bodies).alias("body"), F.when(k % 7 == 3, "TimeoutError").alias("error"))
    return made.filter("k % 7 <> 6").drop("k")


def verification_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on works whose pages were fetched: right, another title, refused, no answer, never asked."""
    return V.check_works(_table_registers(spark, sf_dir), _part_pages(spark, sf_dir)).select("id", "status", "detail", "line")


def _lined(rows: str, width: int) -> str:
    return f"SELECT id, status, detail, CASE WHEN status <> 'OK' THEN '  ' || rpad(status, 6, ' ') || ' ' || rpad(id, greatest({width}, length(id))::INT, ' ') || ' ' || detail END AS line FROM ({rows})"


_WORKS_VERIFIED = f"""
SELECT 'ukpga-' || (p_partkey % 200 + 1800) || '-' || p_partkey AS id, {_case('p_partkey', ["'OK'", "'TITLE'", "'HTTP'", "'ERROR'", "'OK'", "'OK'", "'ERROR'"])} AS status,
  {_case('p_partkey', ["''", "'registry=''' || t || ' Act'' site=''' || t || ' Act' || repeat('7', length(p_name) + 4) || ''' (0.67)'", f"'404 {L_}/ukpga/' || (p_partkey % 200 + 1800) || '/' || p_partkey", "'TimeoutError'", "''", "''", "'not fetched'"])} AS detail
FROM (SELECT *, {_INITCAP} AS t FROM part)
"""


def _checked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on cases made from suppliers, some of which have no page or one that isn't asked for."""
    k = F.col("s_suppkey")
    neutral = F.when(k % 7 == 4, F.concat(F.lit("[2010] UKHL "), k)).when(k % 7 != 5, F.concat(F.lit("[2010] UKSC "), k))
    rows = _table(spark, sf_dir, "supplier").select(
        F.lit(None).cast("string").alias("id"), F.concat(F.lit("Smith"), k, F.lit(" v Jones")).alias("name"), neutral.alias("neutral"),
        F.array(F.concat(F.lit("[2011] 1 AC "), k)).alias("reports"), F.array(F.concat(F.lit("Re Supplier "), k)).alias("aliases"),
    )
    end = F.lit(" - Find Case Law - Archives</title>")
    bodies = [
        F.concat(F.lit("<title>Smith"), k, F.lit(" -v- Jones"), end), F.concat(F.lit("<title>Re Supplier "), k, end), F.concat(F.lit("<title>@@@"), end), F.lit(""),
        F.lit("<title>not asked</title>"), F.lit("<title>not asked</title>"), F.lit(None).cast("string"),
    ]
    pages = _table(spark, sf_dir, "supplier").select(
        F.concat(F.lit(f"{T_}/uksc/2010/"), k).alias("url"), F.when(k % 7 == 3, 503).when(k % 7 != 6, 200).cast("int").alias("status"), _choose(k, bodies).alias("body"), F.when(k % 7 == 6, "ConnectError").alias("error")
    )
    return V.check_cases(Registers.from_entries([_part_works(spark, sf_dir)], [rows]), pages)


def verification_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked_cases(spark, sf_dir).select("id", "status", "detail", "line")


_CASES_VERIFIED = f"""
SELECT {_case('s_suppkey', ["'uksc-2010-' || s_suppkey"] * 4 + ["'ukhl-2010-' || s_suppkey", "'report-2011-1-ac-' || s_suppkey", "'uksc-2010-' || s_suppkey"])} AS id,
  {_case('s_suppkey', ["'OK'", "'OK'", "'NAME'", "'HTTP'", "'SKIP'", "'SKIP'", "'ERROR'"])} AS status,
  {_case('s_suppkey', ["''", "''", "'registry=''Smith' || s_suppkey || ' v Jones'' site=''@@@'' (0.00)'", f"'503 {T_}/uksc/2010/' || s_suppkey", f"'not checkable: {B_}/uk/cases/UKHL/2010/' || s_suppkey || '.html'", "'no direct link'", "'ConnectError'"])} AS detail
FROM supplier
"""


def verification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    works = V.totals(V.check_works(_table_registers(spark, sf_dir), _part_pages(spark, sf_dir))).withColumn("of", F.lit("works"))
    return works.union(V.totals(_checked_cases(spark, sf_dir)).withColumn("of", F.lit("cases")))


VERIFIED_TOTALS = " UNION ALL ".join(
    f"SELECT count(*) FILTER (WHERE status <> 'SKIP') AS checked, count(*) FILTER (WHERE status = 'OK') AS verified, count(*) FILTER (WHERE status NOT IN ('OK', 'SKIP')) AS failed, "
    f"count(*) FILTER (WHERE status = 'SKIP') AS skipped, '{of}' AS of FROM ({rows})"
    for of, rows in (("works", _WORKS_VERIFIED), ("cases", _CASES_VERIFIED))
)


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison keys of part names dressed up."""
    name = F.col("p_name")
    dressed = F.concat(F.lit("The  "), name, F.lit(" (Scotland) & Works Regulations 2003"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", T.title_key(dressed).alias("title"), T.title_stem(dressed).alias("stem"), T.alias_key(F.concat(F.lit("the "), name, F.lit("."))).alias("alias"),
        T.name_key(F.concat(name, F.lit(" Ltd vs. The "), name, F.lit(" and others"))).alias("case_name"), R.inferred_type(F.concat(name, F.lit(" (Scotland) Regulations")), F.lit(2003)).alias("work_type"), T.query(dressed).alias("query"), T.html(F.concat(F.lit("<"), name, F.lit("'>"))).alias("html"),
    )


_KEY = "trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
NORMAL = f"""
SELECT p_partkey, {_KEY} || ' scotland and works regulations' AS title, {_KEY} || ' scotland and works' AS stem, regexp_replace(lower(p_name), '[^a-z0-9 ]+', '', 'g') AS alias,
  {_KEY} || ' v ' || {_KEY} AS case_name, 'ssi' AS work_type, replace(url_encode('The  ' || p_name || ' (Scotland) & Works Regulations 2003'), '%20', '+') AS query,
  '&lt;' || replace(replace(p_name, '&', '&amp;'), '''', '&#x27;') || '&#x27;&gt;' AS html FROM part
"""


def judgment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of neutral citations in each court, from the nation table's keys."""
    n = _table(spark, sf_dir, "nation").select("n_nationkey").join(courts(spark).select("code"), F.lit(True))
    made = F.struct((F.col("n_nationkey") + 1990).alias("year"), F.col("code").alias("court"), F.col("n_nationkey").cast("string").alias("number"), F.lit(None).cast("string").alias("division")).cast(C.NEUTRAL)
    rows = n.withColumn("n", made)
    return rows.select("n_nationkey", "code", C.neutral_text(F.col("n")).alias("text"), L.judgment_link(F.col("n"))["url"].alias("url"), L.judgment_link(F.col("n"))["source"].alias("source"))


def _judgments() -> str:
    from ..functions.fixed import COURTS

    rows = ", ".join("('{}', {}, {}, {})".format(c, f"'{p}'" if p else "NULL", f"'{s}'" if s else "NULL", str(need).lower()) for c, p, s, _, need in COURTS)
    return f"""
WITH c(code, first, second, needed) AS (VALUES {rows}),
x AS (SELECT n_nationkey, n_nationkey + 1990 AS year, c.* FROM nation, c),
y AS (SELECT *, CASE WHEN year >= 2001 AND NOT needed THEN '{T_}/' || first || '/' || year || '/' || n_nationkey END AS one,
  CASE WHEN NOT needed THEN '{B_}/' || replace(replace(second, '{{year}}', year::VARCHAR), '{{number}}', n_nationkey::VARCHAR) END AS two FROM x)
SELECT n_nationkey, code, '[' || year || '] ' || code || ' ' || n_nationkey AS text, coalesce(one, two) AS url, CASE WHEN one IS NOT NULL THEN 'tna' WHEN two IS NOT NULL THEN 'bailii' END AS source FROM y
"""


def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bracketed strings define a short form."""
    k = F.col("s_suppkey")
    shown = _choose(k, [_say("DPA ", k), _say("c. ", k), _say("SI 2017/", k), _say("the ", k, " Act"), _say("in part ", k), _say("UK")])
    return _table(spark, sf_dir, "supplier").select(k.alias("doc_id"), shown.alias("candidate"), W.is_short_form(shown).alias("short"))


SHORT = f"""
SELECT s_suppkey AS doc_id, {_case('s_suppkey', ["'DPA ' || s_suppkey", "'c. ' || s_suppkey", "'SI 2017/' || s_suppkey", "'the ' || s_suppkey || ' Act'", "'in part ' || s_suppkey", "'UK'"])} AS candidate,
  {_case('s_suppkey', ['true', 'false', 'false', 'true', 'false', 'true'])} AS short FROM supplier
"""


def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and itself with its words in another order are equal."""
    name = F.col("p_name")
    turned = F.array_join(F.reverse(F.split(name, " ")), " ")
    pairs = _table(spark, sf_dir, "part").select("p_partkey", name.alias("a"), turned.alias("b"))
    return pairs.select("p_partkey", similarity("a", "b").alias("score"))


Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        citations_full, back_references, case_citations, embedded_citations, document_totals, citator_pinpoints, citator_works, citator_unresolved, citator_stats, citator_cases,
        citator_unresolved_cases, annotated_markdown, annotated_html, documents_json, versioned_links, pinpoint_targets, fuzzy_search, normal_forms, judgment_pages,
        register_works, register_cases, register_sizes, registered_citations, citator_postings, citator_order, short_forms, title_similarity,
        verification_works, verification_cases, verification_totals,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    cases = _case_rows()
    return {
        "citations_full": FULL, "back_references": _back_rows(), "case_citations": cases, "embedded_citations": EMBEDDED, "document_totals": TOTALS, "citator_pinpoints": PINPOINTS,
        "citator_works": WORKS, "citator_unresolved": UNRESOLVED, "citator_stats": STATS, "citator_cases": CASES.format(cases),
        "citator_unresolved_cases": f"SELECT name AS reference, count(*) AS count FROM ({cases}) WHERE case_id IS NULL GROUP BY name",
        "annotated_markdown": _annotated(False), "annotated_html": _annotated(True), "documents_json": JSON, "versioned_links": VERSIONED, "pinpoint_targets": TARGETS, "fuzzy_search": FUZZY,
        "normal_forms": NORMAL, "judgment_pages": _judgments(),
        "register_works": REGISTERED, "register_cases": CASES_REGISTERED, "registered_citations": _registered_sql(), "citator_postings": POSTED, "citator_order": ORDERED,
        "register_sizes": "SELECT (SELECT count(*) FROM part) * m AS works, (SELECT count(*) FROM supplier) AS cases, o AS of FROM (VALUES (1, 'tables'), (2, 'added')) v(m, o)",
        "verification_works": _lined(_WORKS_VERIFIED, 18), "verification_cases": _lined(_CASES_VERIFIED, 22), "verification_totals": VERIFIED_TOTALS,
        "short_forms": SHORT, "title_similarity": "SELECT p_partkey, 1.0::DOUBLE AS score FROM part",
    }
