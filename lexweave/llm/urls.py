"""URL filters by a path-template tree.

Rules come first: the longest rule that fits decides. All other urls are judged
by templates learned from the whole table, per host:

1. Each path segment that is a number, a hash or a similar key becomes ``*``
   (a file's extension stays). Urls are summed to one row per host and masked
   path, so what follows works on far fewer rows than there are urls.
2. From the root down, one level at a time, as deep as any two paths of a host
   part: where a branch point has many children that each hold few urls, the
   segment is variable and becomes ``*`` as well; sibling branches whose labelled
   share of blocked urls doesn't differ significantly from that of all the others
   together (two-sided z test) are merged into one, ``[*]``, apart from keys.
3. Urls that a rule decides are the labels. A template's purity is its share of
   blocked labelled urls, smoothed towards that of the same template on all hosts,
   which is smoothed towards that of all labels; so a host without labels goes by
   what others tell of its templates. Templates at ``reject`` or above are blocked.

All sums combine before they are shuffled, and joins are against one row per
branch, so a host with a third of all urls can be split.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged as the root of the empty host; repeated rows are
judged alike; a null page_id is kept; urls of any length and depth are read
whole; further columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
MIN_CHILDREN, FEW_URLS, Z_SAME = 8, 4.0, 1.96
#: Smoothing: so many labelled urls' worth of what is believed; that share of blocked urls if there are no labels at all.
PRIOR_WEIGHT, PRIOR_BLOCKED, REJECT = 4.0, 0.2, 0.5
#: What branches that are alike are merged into.
MERGED = "[*]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: str | Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        site, _, start = text.partition("/")
        fits = ((host == site) | host.endswith(f".{site}")) & path.startswith(f"/{start}")
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def masked(path: Column) -> Column:
    """The path's segments as an array, keys masked."""

    def mask(part: Column) -> Column:
        end = F.regexp_extract(part, r"(\.[A-Za-z]{1,5})?$", 0)
        stem = F.substring(part, F.lit(1), F.length(part) - F.length(end))
        key = stem.rlike(r"^[0-9]+$") | stem.rlike(r"^(?=.*[0-9])[0-9A-Fa-f-]{8,}$") | stem.rlike(r"^\d{4}-\d{2}-\d{2}$")
        return F.when(key, F.concat(F.lit("*"), end)).otherwise(part)

    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), mask)


def _same(blocked: Column, labelled: Column, all_blocked: Column, all_labelled: Column) -> Column:
    """Is a branch's share of blocked urls like that of its siblings together?"""
    rest = all_labelled - labelled
    share = all_blocked / all_labelled
    spread = F.sqrt(share * (1 - share) * (1 / labelled + 1 / rest))
    differs = F.abs(blocked / labelled - (all_blocked - blocked) / rest)
    return F.when(spread > 0, differs / spread < Z_SAME).otherwise(True)


def templates(rows: DataFrame) -> DataFrame:
    """host, masked, template, purity from rows of host, masked (array), blocked and allowed (0 or 1)."""
    base = rows.groupBy("host", "masked").agg(
        F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("blocked"), F.sum(F.col("blocked") + F.col("allowed")).alias("labelled")
    )
    tree = cut(base.withColumn("t", F.col("masked")))
    level = 0
    # below a level at which each path is alone on its branch there are no siblings
    while _parts(tree, level):
        level += 1
        deep = F.size("t") >= level
        tree_ = tree.withColumn("above", F.when(deep, F.slice("t", 1, level - 1))).withColumn("seg", F.when(deep, F.try_element_at("t", F.lit(level))))
        child = tree_.filter("seg is not null").groupBy("host", "above", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
        named = F.when(~F.col("seg").startswith("*"), 1).otherwise(0)
        point = child.groupBy("host", "above").agg(
            F.sum(named).alias("children"), F.sum(F.col("n") * named).alias("urls"), F.sum(F.col("blocked") * named).alias("all_blocked"), F.sum(F.col("labelled") * named).alias("all_labelled")
        )
        many = (F.col("children") >= MIN_CHILDREN) & (F.col("urls") < FEW_URLS * F.col("children"))
        alike = (F.col("labelled") > 0) & (F.col("all_labelled") > F.col("labelled")) & _same(F.col("blocked"), F.col("labelled"), F.col("all_blocked"), F.col("all_labelled"))
        becomes = F.when(many, "*").when(alike, MERGED)
        merge = child.filter(~F.col("seg").startswith("*")).join(point, ["host", "above"]).select("host", "above", "seg", becomes.alias("wild")).filter("wild is not null")
        joined = tree_.join(merge, ["host", "above", "seg"], "left")
        star = F.concat(F.slice("t", 1, level - 1), F.array("wild"), F.slice(F.col("t"), F.lit(level + 1), F.size("t")))
        last, tree = tree, cut(joined.withColumn("t", F.when(F.col("wild").isNotNull(), star).otherwise(F.col("t"))).drop("above", "seg", "wild"))
        discard(last)
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/")))
    total = tree.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + PRIOR_WEIGHT * PRIOR_BLOCKED) / (F.coalesce(F.sum("labelled"), F.lit(0)) + PRIOR_WEIGHT)).alias("share")).first()

    def smoothed(towards: Column) -> Column:
        return (F.sum("blocked") + PRIOR_WEIGHT * towards) / (F.sum("labelled") + PRIOR_WEIGHT)

    by_host = tree.groupBy("host", "template").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"))
    everywhere = by_host.groupBy("template").agg(smoothed(F.lit(total["share"])).alias("share"))
    purity = (F.col("blocked") + PRIOR_WEIGHT * F.col("share")) / (F.col("labelled") + PRIOR_WEIGHT)
    judged = by_host.join(everywhere, "template").select("host", "template", purity.alias("purity"))
    return tree.select("host", "masked", "template").join(judged, ["host", "template"])


def _parts(tree: DataFrame, level: int) -> bool:
    """Do any two paths of a host part below ``level`` segments?"""
    deeper = tree.filter(F.size("t") > level).groupBy("host", F.slice("t", 1, level).alias("above")).agg(F.count(F.lit(1)).alias("paths"))
    return not deeper.filter("paths > 1").isEmpty()


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of ``pages``."""
    host, path = split_url("url")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = (
        pages.select("page_id", host.alias("host"), path.alias("path"))
        .withColumns({"rule": rule, "said": says, "masked": masked(F.col("path"))})
        .withColumn("blocked", F.when(F.col("said") == "block", 1).otherwise(0))
        .withColumn("allowed", F.when(F.col("said") == "allow", 1).otherwise(0))
    )
    found = templates(rows)
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return rows.join(found, ["host", "masked"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "template", "purity"
    )
