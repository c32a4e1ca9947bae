"""Keeping tables that several steps start from."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame

#: What ``kept`` made: tables in memory, or folders of the shared folder.
Held = list


def kept(df: DataFrame, held: Held | None = None) -> DataFrame:
    """``df``, computed once: as Parquet in the shared folder that ``spark.checkpoint.dir``
    names, so that a lost executor takes nothing with it and planning knows its size; in
    memory and on local disk where none is named and there is one machine only, else an
    error. What was made is noted in ``held`` for ``release``."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = [] if held is None else held
    if named:
        path = f"{named}/lexweave-{uuid.uuid4().hex}"
        df.write.parquet(path)
        held.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return df


def release(held: Held) -> None:
    """Drop what ``kept`` noted in ``held``; results that read it can't be read any more, unless it was in memory."""
    while held:
        one = held.pop()
        if isinstance(one, DataFrame):
            one.unpersist()
        else:
            spark, name = one
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
