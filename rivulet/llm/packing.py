"""Best-fit packing by hierarchical residual packing.

Each input partition tokenizes its documents, cuts the long ones and packs
what is left best-fit. Bins that are nearly full are final. The pieces of all
other bins, however many, are packed again across the partitions: pieces of a
length are alike, so only their number for each length is needed, at most
``capacity`` - 1 numbers at any size of the input. Best-fit decreasing on those
numbers gives runs of equal bins, and a piece finds its bin by its rank among
the pieces of its length. Only lengths and checksums travel, never texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import chunks, materialise, table
from .tokens import default_vocabulary, token_ids

#: Pieces that are packed together at most in the first round.
AT_ONCE = 200_000

_PIECE = ("doc_id", "piece", "start", "length", "ids_crc32")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item numbers of each bin. The fullest bin with room is found as a bit of one integer."""
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    have, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fit = have >> size
        if fit:
            room = size + ((fit & -fit).bit_length() - 1)
            target = open_bins[room].pop()
            if not open_bins[room]:
                have &= ~(1 << room)
        else:
            room, target = capacity, []
            bins.append(target)
        target.append(i)
        room -= size
        if room:
            open_bins[room].append(target)
            have |= 1 << room
    return bins


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of ``capacity``, but for the first where there is a remainder."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    heads = [(0, first)] if first else []
    return heads + [(s, capacity) for s in range(first, length, capacity)]


def match(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on numbers of equal items: ``(size, rank, each, bin, offset)``.

    The items of a size from that rank on (up to the next row of the size) go,
    ``each`` to a bin, to the bins from that number on, at that offset. A run
    of equal bins is handled at once, so the work depends on the number of
    sizes, not on that of items. The bins are those of ``best_fit``.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # by room: first bin and number of bins
    out, bins = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        for room in [*sorted(r for r in runs if r >= size), None]:
            if not left:
                break
            old, fresh = (runs.pop(room), False) if room else ([(bins, left)], True)
            room = room or capacity
            fit = room // size
            for first, many in old:
                whole = min(many, left // fit)
                for each, k in ((fit, whole), (left - fit * whole, int(whole < many))):
                    if each and k:
                        out.append((size, rank, each, first, capacity - room))
                        runs.setdefault(room - each * size, []).append((first, k))
                        rank, left, first, many = rank + each * k, left - each * k, first + k, many - k
                if fresh:
                    bins = first
                elif many:
                    runs.setdefault(room, []).append((first, many))
    return out


def pack(
    docs: DataFrame, capacity: int = 1024, vocabulary: str | None = None, end_id: int = 2,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its text's ids and ``end_id``; a null or empty text is
    ``end_id`` alone. Only documents longer than ``capacity`` are cut, into
    pieces of ``capacity``, the first one shorter where there is a remainder.
    ``sequence_id`` is any number; offsets in a sequence start at 0 and have
    no gaps. Repeated rows are packed one by one, a null id is kept, other
    columns are not read, an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    kept = docs.select(F.col(f"`{id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    ddl = f"doc_id {dict(kept.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, grp long, rank long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    nearly = capacity - max(1, capacity // 256)

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(found), 65_536):
            columns = zip(*found[at : at + 65_536])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId()
        name, loose, full = group << 32, [], []
        ranks = [0] * (capacity + 1)

        def packed() -> list[tuple]:
            nonlocal name
            out = []
            for b in best_fit([p[3] for p in loose], capacity):
                final, at = sum(loose[i][3] for i in b) >= nearly, 0
                for p in (loose[i] for i in b):
                    if final:
                        out.append((*p, name, at, group, None))
                        at += p[3]
                    else:
                        out.append((*p, None, None, group, ranks[p[3]]))
                        ranks[p[3]] += 1
                name += final
            return out

        for batch in chunks(batches, "_text"):
            for doc, t in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()):
                ids = np.append(token_ids(t, path), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    piece = (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    if length == capacity:
                        full.append((*piece, name, 0, group, None))
                        name += 1
                    else:
                        loose.append(piece)
            if len(full) >= 4_096:
                yield from rows(full)
                full = []
            if len(loose) >= AT_ONCE:
                yield from rows(packed())
                loose = []
        yield from rows(full)
        yield from rows(packed())

    state = materialise(kept.mapInArrow(first, ddl), "pieces")
    rest = state.where("sequence_id IS NULL")
    counts = materialise(rest.groupBy("grp", "length").agg(F.count("*").alias("many")), "lengths")
    totals = {r["length"]: r["many"] for r in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    runs: dict[int, list[tuple]] = {}
    for size, *run in match(totals, capacity):
        runs.setdefault(size, []).append(run)
    shipped = docs.sparkSession.sparkContext.broadcast({size: np.array(r, np.int64).T for size, r in runs.items()})

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for size in np.unique(lengths).tolist():
                here = np.flatnonzero(lengths == size)
                begin, each, bin_, at = shipped.value[size]
                run = np.searchsorted(begin, ranks[here], side="right") - 1
                inner = ranks[here] - begin[run]
                sequence[here] = (1 << 56) + bin_[run] + inner // each[run]
                offset[here] = at[run] + inner % each[run] * size
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _PIECE], pa.array(sequence), pa.array(offset)], [*_PIECE, "sequence_id", "offset"])

    before = F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rest.join(counts.select("grp", "length", before.alias("before")), ["grp", "length"]).select(
        *_PIECE, (F.col("rank") + F.col("before")).alias("rank")
    )
    columns = [*_PIECE, "sequence_id", "offset"]
    placed = ranked.mapInArrow(place, StructType([f for f in state.schema if f.name in columns]))
    return state.where("sequence_id IS NOT NULL").select(columns).unionByName(placed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
