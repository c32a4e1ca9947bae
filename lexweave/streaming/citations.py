"""Citations of a stream of documents. Documents don't depend on each other, so each micro-batch is resolved as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.resolve import Settings
from ..plans.pipeline import Resolved, resolve
from ..sources.registry import Registers


def resolve_stream(docs: DataFrame, registers: Registers, sink: Callable[[Resolved, int], None], checkpoint: str, settings: Settings = Settings(), once: bool = True) -> StreamingQuery:
    """Hand each micro-batch's result to ``sink``. ``sink`` gets the batch's number, so that a batch that is run again can replace what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(resolve(rows, registers, settings), number)

    writer = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_to(path: str) -> Callable[[Resolved, int], None]:
    """A sink that writes citations and cases by batch; a repeated batch overwrites itself."""

    def write(r: Resolved, number: int) -> None:
        r.citations.write.mode("overwrite").parquet(f"{path}/citations/batch={number}")
        r.cases.write.mode("overwrite").parquet(f"{path}/cases/batch={number}")

    return write
