"""Parquet in and out, tables written to the shared folder, and places of rows that stay as they are."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_swept: set[str] = set()


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local master may do without that setting; a temporary folder then
    takes its place. On a cluster its absence is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if root is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rivulet-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rivulet-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own part of the shared folder, which goes when the driver ends."""
    folder = _own_folder(spark)
    if folder not in _swept:
        _swept.add(folder)
        atexit.register(_at_exit, spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        sweep(spark)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; nothing made from it can be read afterwards."""
    remove(spark, _own_folder(spark))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows as Parquet to the shared folder and reads them from there.

    That cuts the lineage: a lost executor costs a re-read, not a
    recomputation. The write's own shuffle files go as soon as it has ended.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    try:
        spark.conf.set(_CLEANUP, "true")
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    own = "/" + _own_folder(spark).split("://", 1)[-1].split(":", 1)[-1].lstrip("/") + "/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in folder:
            remove(spark, folder)


def _scans_files(df: DataFrame) -> bool:
    """Whether the frame is one table of files and no more than projections of it."""
    node = df._jdf.queryExecution().analyzed()
    if not node.deterministic():
        return False
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def numbered(df: DataFrame, position: str) -> tuple[DataFrame, int, Callable[..., DataFrame]]:
    """``(rows with their place from 0, how many, the row at a place)``; places never change.

    Over Parquet files the place is the file's rank by name and the row's
    number in it, both of which the files themselves hold: nothing is written
    or moved. Any other frame is written once, in its own order, as a frame
    that is computed again may lay its rows out otherwise. Reading one row
    prunes to its file, and there by its number; with a second place, the rows
    up to that one come from their files only.
    """
    if _scans_files(df):
        try:
            rows = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__i"))
            return _laid_out(rows, position)
        except AnalysisException:  # files of a kind whose rows have no numbers
            pass
    marked = F.monotonically_increasing_id()
    stored = materialise(df.select("*", F.shiftright(marked, 33).cast("int").alias("__f"), marked.bitwiseAND((1 << 33) - 1).alias("__i")), "numbered")
    return _laid_out(stored, position)


def _laid_out(rows: DataFrame, position: str) -> tuple[DataFrame, int, Callable[..., DataFrame]]:
    counts = sorted(map(tuple, rows.groupBy("__f").count().collect()))
    parts, ahead = [p for p, _ in counts], [0, *accumulate(n for _, n in counts)]
    total = ahead.pop()
    names = [c for c in rows.columns if c not in ("__f", "__i")]
    kept = [F.col(f"`{c}`") for c in names]
    if len(parts) <= 1:
        placed = rows.select(*kept, F.col("__i").alias(position))
    else:
        starts = rows.sparkSession.createDataFrame(list(zip(parts, ahead)), f"__p {dict(rows.dtypes)['__f']}, __ahead long")
        placed = rows.join(F.broadcast(starts), rows["__f"] == starts["__p"]).select(*kept, (F.col("__ahead") + F.col("__i")).alias(position))

    def at(place: int, stop: int | None = None) -> DataFrame:
        if stop is not None:
            within = F.col("__f").isin(parts[bisect_right(ahead, place) - 1 : bisect_right(ahead, stop - 1)])
            return (rows.where(within) if len(parts) <= 1 else rows.where(within).join(F.broadcast(starts), F.col("__f") == F.col("__p"))).select(
                *kept, ((F.lit(0) if len(parts) <= 1 else F.col("__ahead")) + F.col("__i")).alias(position)).where((F.col(position) >= place) & (F.col(position) < stop))
        k = bisect_right(ahead, place) - 1
        while k > 0 and ahead[k] == place and counts[k][1] == 0:
            k -= 1
        return rows.where((F.col("__f") == parts[k]) & (F.col("__i") == place - ahead[k])).select(*kept, F.lit(place).cast("long").alias(position))

    return placed, total, at
