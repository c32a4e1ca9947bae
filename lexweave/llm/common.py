"""What the operators of this subpackage share: cutting lineage, components, text helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever words are counted: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. Where none is named, one of our own if
    there is one machine only (local mode), else an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexweave-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder (to ``path``, if given) and read it back, so that
    later steps neither recompute it nor lose it with an executor. What was
    shuffled for it is deleted when it is written."""
    spark = df.sparkSession
    path = path or new_path(spark)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.cut_path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``cut`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Within it, the session has these settings."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def small_batches(spark: SparkSession, rows: int = 10_000, octets: int = 1 << 24) -> AbstractContextManager:
    """Within it, what is run hands Python at most ``rows`` rows and about
    ``octets`` bytes at a time (one row at least): for long texts and blocks."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(octets)})


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null counts as empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary")) % modulus


def share(column: str, salt: str, rate: float) -> Column:
    """Is the row among about ``rate`` of all rows, by the whole 64-bit hash of the value as text?"""
    if rate >= 1:
        return F.lit(True)
    return F.xxhash64(F.col(column).cast("string"), F.lit(salt)) < F.lit(int(rate * 2.0**64) - 2**63)


#: Parts into which a vertex's edges are dealt where they meet its one row.
SALTS = 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected ``edges``: (id, component), where
    component is the smallest id that can be reached. Ids without an edge to
    another id are not returned. Alternates large-star and small-star steps
    until nothing changes. Each step is two aggregations with map-side combining
    and joins against one row per id; a hub's edges are dealt over SALTS keys.
    Only counts and sums of hashes come to the driver; a step's table is deleted
    when the next one is written.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    links = cut(links)
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = meet_all(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = meet_all(large, root)
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            root.select("u", F.col("m").alias("v"))
        )
        last, links = links, cut(small.distinct())
        discard(last)
        before, mark = mark, _mark(links)
        if mark == before:
            break
    tree = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return tree.union(tree.select(F.col("component").alias("id"), "component").distinct())


def meet_all(rows: DataFrame, one: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the value m that ``one`` (u, m) has for u."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    each = one.select("u", "m", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    return dealt.join(each, ["u", "salt"])


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
    return tuple(row)
