"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn exactly, from
the multivariate hypergeometric law that a uniform shuffle would follow. Rows
are permuted inside their partition and dealt out by those counts, exchanged,
and permuted again inside their shard. Shard sizes are exact by construction,
and any arrangement of the rows is equally likely.

The matrix is never built: a task draws its own row by walking down a binary
tree over the partitions, each node splitting the shards' places between its
halves with a seed of its own. Only the partitions' row counts are shipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import fresh, materialise, table

#: Rows of a shard that are put in order by one task, on average. They are whole documents.
RUN_ROWS = 100_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """At most one apart."""
    return np.array([rows // shards + (j < rows % shards) for j in range(shards)], np.int64)


def matrix_row(before: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Rows that partition ``part`` sends to each shard. ``before``: running row counts of the partitions, from 0."""
    low, high, places = 0, len(before) - 1, sizes.copy()
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _draw(rng, places, int(before[mid] - before[low]))
        if part < mid:
            high, places = mid, left
        else:
            low, places = mid, places - left
    return places


#: Populations from this size on are beyond the library's own hypergeometric draw.
LIBRARY_LIMIT = 1_000_000_000


def _draw(rng: np.random.Generator, places: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric by its marginals, of any size."""
    out, rest = np.zeros_like(places), int(places.sum())
    if rest < LIBRARY_LIMIT:
        return rng.multivariate_hypergeometric(places, n, method="marginals")
    for j, k in enumerate(places.tolist()):
        rest -= k
        out[j] = hypergeometric(rng, k, rest, n)
        n -= int(out[j])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of ``n`` drawn without replacement, how many are good: exact for any size.

    Beyond the library's limit every item is first taken with probability n in
    good + bad, which two binomial draws say for both kinds. Given its size
    such a sample is uniform, so it stays uniform if as many items are added to
    it, or taken out again, at random as it is off from ``n``; how many of
    those are good is a hypergeometric draw of about the square root of n
    items, and so on down to a few, which are drawn one by one.
    """
    total = good + bad
    if total < LIBRARY_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    if 2 * n > total:
        return good - hypergeometric(rng, good, bad, total - n)
    if n <= 64:
        found = 0
        for i in range(n):
            found += int(rng.integers(total - i)) < good - found
        return found
    x, y = int(rng.binomial(good, n / total)), int(rng.binomial(bad, n / total))
    off = n - x - y
    return x + hypergeometric(rng, good - x, bad - y, off) if off >= 0 else x - hypergeometric(rng, x, y, -off)


def shard(df: DataFrame, shards: int, seed: int = 11, run_rows: int = RUN_ROWS) -> DataFrame:
    """Every row of ``df`` with its ``shard`` and its ``slot`` in it (from 0, without gaps).

    Rows are taken as they are: nulls, ties and repeated rows are rows like
    any other. ``df`` is written once, as a task that is run again has to see
    its rows in the same order. Input columns named ``shard`` or ``slot`` are
    replaced, others may have any names. An empty table gives an empty table.
    """
    data = df.drop("shard", "slot")
    spark = df.sparkSession
    own_part, own_row, own_run, own_key = fresh(data, "_part", "_row", "_run", "_key")
    placed = _stored(data, own_part, own_row)
    counts = dict(placed.groupBy(own_part).count().collect())
    parts = sorted(counts)
    rows = sum(counts.values())
    before = np.concatenate([[0], np.cumsum([counts[p] for p in parts])]).astype(np.int64)
    sizes = shard_sizes(rows, shards)
    shipped = spark.sparkContext.broadcast((before, {p: i for i, p in enumerate(parts)}))
    runs = max(1, -(-rows // (shards * run_rows)))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, number = shipped.value
        state: dict[int, np.ndarray] = {}
        for batch in batches:
            part, row = batch.column(own_part).to_numpy(), batch.column(own_row).to_numpy()
            to, keys = np.empty(len(part), np.int32), np.empty(len(part), np.int64)
            for p in np.unique(part).tolist():
                if p not in state:
                    own = np.repeat(np.arange(shards, dtype=np.int32), matrix_row(before, sizes, number[p], seed))
                    rng = np.random.default_rng([seed, 1 << 40, p])
                    rng.shuffle(own)
                    state = {p: (own, rng.integers(0, 1 << 62, len(own)))}
                at = part == p
                to[at], keys[at] = state[p][0][row[at]], state[p][1][row[at]]
            made = [pa.array(to), pa.array((keys % runs).astype(np.int32)), pa.array(keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "shard", own_run, own_key])

    def dealt_out(rows: DataFrame) -> DataFrame:
        schema = StructType(list(rows.schema.fields)).add("shard", "integer", False).add(own_run, "integer", False).add(own_key, "long", False)
        return rows.mapInArrow(deal, schema)

    dealt = dealt_out(placed)
    order = Window.partitionBy("shard", own_run).orderBy(own_key, own_part, own_row)
    ranked = dealt.withColumn("slot", F.row_number().over(order).cast("long") - 1)
    if runs > 1:
        (own_ahead,) = fresh(data, "_ahead")
        sums = dealt_out(placed.select(own_part, own_row)).groupBy("shard", own_run).count()
        ahead = Window.partitionBy("shard").orderBy(own_run).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("shard", own_run, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(own_ahead))
        ranked = ranked.join(sums, ["shard", own_run]).withColumn("slot", F.col("slot") + F.col(own_ahead))
    return ranked.select(*[F.col(f"`{c}`") for c in data.columns], "shard", "slot")


def _stored(data: DataFrame, own_part: str, own_row: str) -> DataFrame:
    """The table with each row's partition and its place there, written so that both stay as they are."""
    schema = StructType(list(data.schema.fields)).add(own_part, "integer", False).add(own_row, "long", False)
    arrow = to_arrow_schema(schema)

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            made = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)

    return materialise(data.mapInArrow(number, schema), "numbered")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
