"""Mixing sources to target weights with hash-threshold histograms, native Spark only.

Every document gets a hash in hex digits. Words are summed by source and hash
bucket (the first three digits); the running sum tells in which bucket a
source's budget ends; only that bucket is summed again by the next three
digits, then by three more. What remains is one threshold per source, so the
documents are chosen by a comparison, without a sort. A target above a source's
size takes all of it once and the documents below the threshold once more.

Defined cases: null text has size 0; null sources form one source, the last;
repeated rows count as often as they occur and are taken alike, as the hash is
that of doc_id (null ids share a hash); an empty table gives an empty result;
further columns are kept out of the plan and don't clash. Documents of size 0
take 0 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5, 2, 1)
#: Of all words, how much the mix takes; and how often a source can be taken at most.
SHARE, MOST = 1.5, 2.0
DIGITS, LEVELS = 3, 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, skey (the source, never null), size and hash of each document."""
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")).alias("skey"),
        word_count("text").alias("size"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")), 1, DIGITS * LEVELS).alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """skey, source_size, target. Excess over ``most`` times a source's size goes
    to the others by weight: target = min(weight * level, most * size), where the
    level is the greatest that any number of full sources, in order of
    size / weight, asks for. The windows run over one row per source."""
    by_source = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    # '+' sorts before '-', so null comes last, the others by code point
    place = F.row_number().over(Window.orderBy("skey")) - 1
    everything = Window.orderBy("ratio", "skey")
    earlier = everything.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)) + 1)
    return (
        by_source.withColumn("place", place)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("level", F.max((F.col("total") - F.col("full")) / (F.col("weights") - F.col("used"))).over(whole))
        .select("skey", "source_size", F.least(F.col("weight") * F.col("level"), F.col("cap")).alias("target"))
    )


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with ``times`` (how often everything is taken) and ``cutoff``: the
    documents whose hash is below it, or equal to it if ``inclusive``, are taken
    once more."""
    size = F.col("source_size")
    times = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    goals = goals.withColumn("times", times).withColumn("rest", F.when(size > 0, F.col("target") - F.col("times") * size).otherwise(0.0))
    edge = goals.filter("rest > 0").select("skey", F.lit("").alias("prefix"), F.col("rest").alias("left"))
    for level in range(1, LEVELS + 1):
        # only the bucket in which the budget ends is looked into
        inside = sizes.select("skey", F.substring("h", 1, DIGITS * level).alias("bucket"), F.substring("h", 1, DIGITS * (level - 1)).alias("prefix"), "size")
        sums = inside.join(edge, ["skey", "prefix"]).groupBy("skey", "bucket").agg(F.sum("size").alias("sum"), F.first("left").alias("left"))
        running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        edge = cut(
            sums.withColumn("upto", F.sum("sum").over(running))
            .filter((F.col("upto") - F.col("sum") <= F.col("left")) & (F.col("left") < F.col("upto")))
            .select("skey", F.col("bucket").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("sum"))).alias("left"), "sum")
        )
    last = edge.select("skey", F.col("prefix").alias("cutoff"), (F.col("left") * 2 >= F.col("sum")).alias("inclusive"))
    return goals.join(last, "skey", "left")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``."""
    sizes = cut(sized(docs))
    plan = cut(thresholds(sizes, cut(targets(sizes, weights, share, most))))
    return _taken(sizes, plan).select("doc_id", "size", "source_size", "target", "taken")


def _taken(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    below = (F.col("h") < F.col("cutoff")) | (F.col("inclusive") & (F.col("h") == F.col("cutoff")))
    copies = F.col("times") + F.when(F.coalesce(below, F.lit(False)), 1).otherwise(0)
    return sizes.join(plan, "skey").withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their columns.
    The decision needs only a row's hash and source, so the texts meet just the
    thresholds: one row per source."""
    sizes = cut(sized(docs))
    plan = cut(thresholds(sizes, cut(targets(sizes, weights, share, most)))).select("skey", "times", "cutoff", "inclusive")
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    keyed = whole.select(
        "row",
        F.coalesce(F.concat(F.lit("+"), "row.source"), F.lit("-")).alias("skey"),
        F.substring(F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null")).cast("binary")), 1, DIGITS * LEVELS).alias("h"),
        F.lit(0).alias("size"),
    )
    taken = _taken(keyed, plan).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("row.*")
