"""Documents: files and folders, tables, single texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: files that a folder is searched for
SUFFIXES = ("txt", "md", "html", "xml", "json")
LONGEST_REQUEST = 2_000_000


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text of a folder's files, at any depth. Undecodable bytes are replaced; markup stays."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    return named.select(F.col("path").alias("doc_id"), _text().alias("text"))


def _text():
    return F.make_valid_utf8(F.col("content").cast("string"))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """A file named by itself is read whatever its suffix."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), _text().alias("text"))


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """doc_id (the path), text, place of files and folders together. A folder gives its files of
    SUFFIXES at any depth by path, a file itself whatever its suffix; ``place`` (path's number,
    file) tells the order, which later steps that go by doc_id don't know otherwise."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    parts = []
    for i, path in enumerate(paths):
        at = hadoop(path)
        folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
        part = read_folder(spark, path) if folder else read_file(spark, path)
        parts.append(part.select("doc_id", "text", F.struct(F.lit(i).alias("argument"), F.col("doc_id").alias("file")).alias("place")))
    return reduce(DataFrame.unionByName, parts)


def in_order(docs: DataFrame, width: int = 12) -> DataFrame:
    """``docs`` of ``read_paths`` under ids that sort in their order: number of the path, then the file."""
    return docs.select(F.concat(F.lpad(F.col("place.argument").cast("string"), width, "0"), F.lit(":"), "doc_id").alias("doc_id"), "text")


def read_table(spark: SparkSession, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return spark.read.parquet(path).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


def of_text(spark: SparkSession, *texts: str, doc_id: str = "input") -> DataFrame:
    """One document of the texts, joined by a space; between 1 and LONGEST_REQUEST characters."""
    text = " ".join(texts)
    if not 1 <= len(text) <= LONGEST_REQUEST:
        raise ValueError("a text has between 1 and 2,000,000 characters")
    return spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
