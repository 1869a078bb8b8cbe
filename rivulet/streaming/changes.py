"""Change logs as Structured Streaming sources: netted per row, merged into a stored state batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.aggregates import specs, usable
from ..operators.relational import filter_rows
from ..sources.storage import remove

META = ("seq", "op", "row_id")


def log_schema(row: T.StructType) -> T.StructType:
    """``seq``, ``op`` (insert, update, delete), ``row_id`` and the row as it is after the change."""
    fields = [T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("row_id", T.LongType())]
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in row.fields])


def net(changes: DataFrame) -> DataFrame:
    """The last change of each row, in one aggregation: last write wins by ``seq``."""
    rest = [c for c in changes.columns if c != "row_id"]
    last = changes.groupBy("row_id").agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select("row_id", *[F.col(f"last.`{c}`").alias(c) for c in rest])


def merge(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after the changes; both have ``op``, and a deleted row stays as a mark of its ``seq``.

    So applying a batch again changes nothing, and a change that comes late
    neither undoes a newer one nor revives a deleted row.
    """
    return net(state.unionByName(changes.select(*state.columns))).select(*state.columns)


class StreamedTable:
    """Keeps a table up to date from a folder of change files; ``run()`` handles what has arrived since.

    Each batch's state is written below the checkpoint under the batch's
    number, so an object made later on the same checkpoint goes on from there,
    and a batch that is run again starts from the state before it and writes
    the same. Only the last two states are kept. Views are functions of the
    state, called per batch.
    """

    def __init__(self, spark: SparkSession, folder: str, row: T.StructType, checkpoint: str):
        self.spark, self.folder, self.row, self.checkpoint = spark, folder, row, checkpoint.rstrip("/")
        self.batches = 0
        self.sinks: list[Callable[[DataFrame, int], None]] = []

    def on_batch(self, sink: Callable[[DataFrame, int], None]) -> None:
        self.sinks.append(sink)

    def _path(self, number: int) -> str:
        return f"{self.checkpoint}/rows/batch={number}"

    def _written(self) -> list[int]:
        """Numbers of the batches whose state was written to the end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/rows")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        folders = [f.getPath() for f in fs.listStatus(path)]
        done = [f for f in folders if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
        return sorted(int(f.getName().partition("=")[2]) for f in done)

    def _state(self, before: int | None = None) -> DataFrame:
        schema = log_schema(self.row)
        known = [n for n in self._written() if before is None or n < before]
        return self.spark.read.schema(schema).parquet(self._path(known[-1])) if known else self.spark.createDataFrame([], schema)

    def _batch(self, changes: DataFrame, number: int) -> None:
        merge(self._state(number), changes).write.mode("overwrite").parquet(self._path(number))
        self.batches += 1
        for sink in self.sinks:
            sink(self.table(), number)
        for old in [n for n in self._written() if n < number][:-1]:
            remove(self.spark, self._path(old))

    def run(self) -> None:
        """One pass over all files that have arrived (``availableNow``)."""
        stream = self.spark.readStream.schema(log_schema(self.row)).parquet(self.folder)
        query = stream.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.checkpoint}/progress").trigger(availableNow=True).start()
        query.awaitTermination()

    def table(self) -> DataFrame:
        return self._state().where("op <> 'delete'").select(*[F.col(f"`{f.name}`") for f in self.row.fields])


def streamed_filter(stream: DataFrame, predicate) -> DataFrame:
    """A stateless filter of an append-only stream."""
    return filter_rows(stream, predicate)


def streamed_groups(stream: DataFrame, by: Sequence[str], agg: Sequence[tuple]) -> DataFrame:
    """Running groups of an append-only stream (``complete`` or ``update`` mode)."""
    outs = [f.column(usable(stream.schema, s)).alias(o) for o, s, f in specs(agg, stream.schema)]
    return stream.groupBy(*by).agg(*outs)
