"""Root tables: mutable rows over immutable DataFrames.

A table is a base DataFrame, whose rows have fixed places, and a piece list
that says which stretches of it are still there and which rows were put
between them. Every mutation edits the list on the driver; only one that
touches a row of the base reads it, by a scan pruned to that row. Reads lay the
list over the base. When it grows too long, or too many rows wait on the
driver, it is written into a new base; updates alone are written as edits that
lie over the base, until they come to a part of it.
"""

from __future__ import annotations

import weakref
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.aggregates import whole_column
from ..functions.predicate import compile_predicate, parse
from ..sources.storage import materialise, numbered
from ..types import ColumnType, Schema, convert

#: Rows that wait on the driver, and pieces of the list, before a new base is written.
FLUSH_ROWS, FLUSH_PIECES = 50_000, 256
#: Which part of the base its written edits may come to before there is a new one, and how often edits are written till then.
EDITED, EDIT_FILES = 8, 256
POSITION, ROW_ID = "__pos", "__rid"
_STORAGE = {"array", "fast_reads", "fastreads", "tiered_vector", "fast_updates", "fastupdates"}


@dataclass
class Stretch:
    """Rows ``start`` to ``stop`` of the base."""

    start: int
    stop: int

    def __len__(self) -> int:
        return self.stop - self.start


@dataclass
class Held:
    """Rows that are on the driver: (row id, values)."""

    rows: list[tuple[int, list]] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.rows)


@dataclass(frozen=True, slots=True)
class Change:
    """``op``: insert, delete or update. ``row_id`` is stable; ``index`` is the place at the time of the change."""

    seq: int
    op: str
    index: int
    row_id: int
    column: str | None = None
    old: Any = None
    new: Any = None


class ChangeLog:
    """Changes with absolute numbers; consumers hold cursors, and what all have seen may be dropped."""

    def __init__(self) -> None:
        self._events: list[Change] = []
        self._base = 0
        self.generation = 0

    def __len__(self) -> int:
        return len(self._events)

    @property
    def total(self) -> int:
        return self._base + len(self._events)

    def push(self, op: str, index: int, row_id: int, column: str | None = None, old: Any = None, new: Any = None) -> Change:
        change = Change(self.total, op, index, row_id, column, old, new)
        self._events.append(change)
        return change

    def changes_from(self, cursor: int) -> list[Change] | None:
        """None: they were dropped, and the consumer has to start afresh."""
        return None if cursor < self._base else self._events[cursor - self._base :]

    def compact(self, cursor: int) -> None:
        n = min(max(0, cursor - self._base), len(self._events))
        if n:
            self._events, self._base = self._events[n:], self._base + n
            self.generation += 1

    def drain(self) -> list[Change]:
        out, self._events, self._base = self._events, [], self.total
        self.generation += 1
        return out

    def clear(self) -> None:
        self.drain()

    def truncate(self, total: int) -> None:
        """Takes back the changes from number ``total`` on."""
        self._events = self._events[: max(0, total - self._base)]


class Table:
    """A typed root table. Its own reads see every change at once; views see it as of the last tick."""

    def __init__(self, name: str, schema: Schema, storage: str | None = None, use_string_interning: bool = False, spark: SparkSession | None = None):
        if storage is not None and storage.strip().lower() not in _STORAGE:
            raise ValueError(f"unknown storage hint '{storage}'")
        self._name, self.schema, self._interned = name, schema, use_string_interning
        self.spark = spark or SparkSession.active()
        self._base: DataFrame | None = None
        self._at: Callable[..., DataFrame] | None = None
        self._ahead: dict[int, dict[str, Any]] = {}
        self._ids_are_places = False
        self._pieces: list[Stretch | Held] = []
        self._updates: dict[int, dict[str, Any]] = {}
        self._next_id, self._version = 0, 0
        self.log = ChangeLog()
        self._views: list[weakref.ref] = []
        self._snapshot: tuple[int, DataFrame] | None = None

    # -- construction

    @classmethod
    def from_dataframe(cls, name: str, df: DataFrame, **options: Any) -> Table:
        """A root table over a DataFrame: Parquet files are only counted, other frames written once; nothing is collected."""
        table = cls(name, Schema.from_spark(df.schema), spark=df.sparkSession, **options)
        base, n, at = numbered(df, POSITION)
        table._rebase(base.withColumn(ROW_ID, F.col(POSITION)), n, lambda *places: at(*places).withColumn(ROW_ID, F.col(POSITION)))
        table._next_id, table._ids_are_places = n, True
        return table

    @classmethod
    def from_csv(cls, name: str, csv: str, spark: SparkSession | None = None) -> Table:
        from ..sources.text import parse_csv

        return cls._loaded(name, *parse_csv(csv), spark)

    @classmethod
    def from_json(cls, name: str, json: str, spark: SparkSession | None = None) -> Table:
        from ..sources.text import parse_json

        return cls._loaded(name, *parse_json(json), spark)

    @classmethod
    def from_pandas(cls, name: str, df: Any, spark: SparkSession | None = None) -> Table:
        from ..sources.text import parse_pandas

        return cls._loaded(name, *parse_pandas(df), spark)

    @classmethod
    def _loaded(cls, name: str, columns: list, rows: list[list], spark: SparkSession | None) -> Table:
        table = cls(name, Schema(columns), spark=spark)
        names = table.column_names()
        table.append_rows([dict(zip(names, r)) for r in rows])
        return table

    def _rebase(self, base: DataFrame, n: int, at: Callable[..., DataFrame]) -> None:
        self._base, self._at, self._pieces, self._updates, self._ahead = base, at, [Stretch(0, n)] if n else [], {}, {}
        self._unedited, self._edits, self._base_rows, self._edited = (base, at), [], n, 0
        self._ids_are_places = False

    # -- metadata

    def name(self) -> str:
        return self._name

    def column_names(self) -> list[str]:
        return self.schema.get_column_names()

    def __len__(self) -> int:
        return sum(map(len, self._pieces))

    def is_empty(self) -> bool:
        return not len(self)

    def version(self) -> int:
        return self._version

    def display(self) -> str:
        return f"Table '{self._name}' [{len(self)} rows x {len(self.schema)} columns]"

    __repr__ = display

    def uses_string_interning(self) -> bool:
        return self._interned

    def interner_stats(self) -> dict[str, int] | None:
        """Distinct and all strings of the string columns; None where interning wasn't asked for."""
        if not self._interned:
            return None
        names = [n for n, t, _ in self.schema if t is ColumnType.STRING]
        if not names:
            return {"unique_strings": 0, "total_references": 0, "free_slots": 0, "memory_bytes": 0}
        values = self.to_df().select(F.explode(F.array(*[F.col(f"`{n}`") for n in names])).alias("s")).where("s IS NOT NULL")
        row = values.groupBy("s").agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("s"))).first()
        return {"unique_strings": row[0], "total_references": row[1] or 0, "free_slots": 0, "memory_bytes": row[2] or 0}

    # -- mutation

    def _values(self, row: dict[str, Any]) -> list:
        unknown = set(row) - set(self.column_names())
        if unknown:
            raise ValueError(f"unknown columns {sorted(unknown)}")
        missing = [n for n in self.column_names() if n not in row]
        if missing:
            raise ValueError(f"missing columns {missing}")
        return [convert(row[n], n, t, null) for n, t, null in self.schema]

    def append_row(self, row: dict[str, Any]) -> None:
        self.append_rows([row])

    def append_rows(self, rows: Sequence[dict[str, Any]]) -> int:
        """All or none: every row is checked before the first is taken."""
        checked = [self._values(r) for r in rows]
        if not checked:
            return 0
        if not self._pieces or not isinstance(self._pieces[-1], Held):
            self._pieces.append(Held())
        at, tail = len(self), self._pieces[-1]
        for i, values in enumerate(checked):
            tail.rows.append((self._next_id, values))
            self.log.push("insert", at + i, self._next_id)
            self._next_id += 1
            self._version += 1
        self._settle()
        return len(checked)

    def insert_row(self, index: int, row: dict[str, Any]) -> None:
        if not 0 <= index <= len(self):
            raise IndexError(f"index {index} is out of range")
        values = self._values(row)
        k, inner = self._cut(index)
        if inner is None:
            if k > 0 and isinstance(self._pieces[k - 1], Held):
                self._pieces[k - 1].rows.append((self._next_id, values))
            else:
                self._pieces.insert(k, Held([(self._next_id, values)]))
        else:
            self._pieces[k].rows.insert(inner, (self._next_id, values))
        self.log.push("insert", index, self._next_id)
        self._next_id += 1
        self._version += 1
        self._settle()

    def _cut(self, index: int) -> tuple[int, int | None]:
        """(piece, place inside) of a held row; a stretch is split so that the index is where a piece begins."""
        at = 0
        for k, piece in enumerate(self._pieces):
            if index == at:
                return k, (0 if isinstance(piece, Held) else None)
            if index < at + len(piece):
                if isinstance(piece, Held):
                    return k, index - at
                mid = piece.start + index - at
                self._pieces[k : k + 1] = [Stretch(piece.start, mid), Stretch(mid, piece.stop)]
                return k + 1, None
            at += len(piece)
        return len(self._pieces), None

    def _find(self, index: int) -> tuple[int, Stretch | Held, int]:
        """(piece number, piece, place inside or in the base)."""
        at = index
        for k, piece in enumerate(self._pieces):
            if at < len(piece):
                return k, piece, (at if isinstance(piece, Held) else piece.start + at)
            at -= len(piece)
        raise IndexError(f"index {index} is out of range")

    def delete_row(self, index: int) -> None:
        if not 0 <= index < len(self):
            raise IndexError(f"index {index} is out of range")
        k, piece, place = self._find(index)
        if isinstance(piece, Held):
            rid, _ = piece.rows.pop(place)
        else:
            rid = self._base_row(place)[ROW_ID]
            self._pieces[k : k + 1] = [s for s in (Stretch(piece.start, place), Stretch(place + 1, piece.stop)) if len(s)]
            self._updates.pop(place, None)
        self._pieces = [p for p in self._pieces if len(p)]
        self.log.push("delete", index, rid)
        self._version += 1
        self._settle()

    def set_value(self, row: int, column: str, value: Any) -> None:
        self._set(row, column, value)
        self._settle()

    def _set(self, row: int, column: str, value: Any) -> None:
        number = self.schema.get_column_index(column)
        if number is None:
            raise KeyError(column)
        if not 0 <= row < len(self):
            raise IndexError(f"row {row} is out of range")
        value = convert(value, column, *self.schema.get_column_info(number)[1:])
        _, piece, place = self._find(row)
        if isinstance(piece, Held):
            rid, values = piece.rows[place]
            old, values[number] = values[number], value
        else:
            base = self._base_row(place)
            rid, old = base[ROW_ID], self._updates.get(place, {}).get(column, base[column])
            self._updates.setdefault(place, {})[column] = value
        self.log.push("update", row, rid, column, old, value)
        self._version += 1

    def set_values(self, edits: Sequence[tuple[int, str, Any]]) -> int:
        """``(row, column, value)`` edits, all or none; the base rows they touch are read together, from the files they are in."""
        for row, column, value in edits:
            number = self.schema.get_column_index(column)
            if number is None:
                raise KeyError(column)
            if not 0 <= row < len(self):
                raise IndexError(f"row {row} is out of range")
            convert(value, column, *self.schema.get_column_info(number)[1:])
        for i in range(0, len(edits), FLUSH_ROWS):
            part = edits[i : i + FLUSH_ROWS]
            with self._read_ahead([row for row, _, _ in part]):
                for row, column, value in part:
                    self._set(row, column, value)
            self._settle()
        return len(edits)

    def delete_rows(self, rows: Sequence[int]) -> int:
        """Deletes the rows at these places, all or none; places are those before the call."""
        places = sorted(set(rows), reverse=True)
        if places and not 0 <= places[-1] <= places[0] < len(self):
            raise IndexError("a row is out of range")
        with self._read_ahead(places):
            for row in places:
                self.delete_row(row)
        return len(places)

    @contextmanager
    def _read_ahead(self, rows: Sequence[int]) -> Iterator[None]:
        """While it is open, these rows of the base are at hand."""
        starts = [0, *accumulate(map(len, self._pieces))]
        wanted = set()
        for row in rows:
            k = bisect_right(starts, row) - 1
            if isinstance(self._pieces[k], Stretch):
                wanted.add(self._pieces[k].start + row - starts[k])
        if wanted:
            keys = self.spark.createDataFrame([(p,) for p in sorted(wanted)], "__at long")
            found = self._at(min(wanted), max(wanted) + 1).join(F.broadcast(keys), F.col(POSITION) == F.col("__at")).drop("__at")
            self._ahead = {r[POSITION]: r.asDict() for r in found.toLocalIterator()}
        try:
            yield
        finally:
            self._ahead = {}

    def index_of(self, row_id: int) -> int | None:
        """Where the row with that id is now; None if there is none."""
        at = 0
        for piece in self._pieces:
            if isinstance(piece, Held):
                for i, (rid, _) in enumerate(piece.rows):
                    if rid == row_id:
                        return at + i
            at += len(piece)
        if self._base is None:
            return None
        if self._ids_are_places:
            place = row_id
        else:
            found = self._base.where(F.col(ROW_ID) == row_id).select(POSITION).first()
            place = -1 if found is None else found[0]
        at = 0
        for piece in self._pieces:
            if isinstance(piece, Stretch) and piece.start <= place < piece.stop:
                return at + place - piece.start
            at += len(piece)
        return None

    def _base_row(self, place: int) -> dict[str, Any]:
        """One row of the base: its file and number in it, or the stored place, prune the scan."""
        return self._ahead[place] if place in self._ahead else self._at(place).first().asDict()

    def _settle(self) -> None:
        held = sum(len(p) for p in self._pieces if isinstance(p, Held))
        if held > FLUSH_ROWS or len(self._pieces) > FLUSH_PIECES:
            self.flush()
        elif len(self._updates) >= FLUSH_ROWS:
            if (self._edited + len(self._updates)) * EDITED > self._base_rows or len(self._edits) >= EDIT_FILES:
                self.flush()
            else:
                self._park()

    def _park(self) -> None:
        """Writes the waiting updates and lays them, the latest of each cell, over the base, which isn't written again."""
        self._edits.append(materialise(self._waiting(), "edits").withColumn("__turn", F.lit(len(self._edits))))
        self._edited, self._updates, self._snapshot = self._edited + len(self._updates), {}, None
        edits = self._edits[0]
        for more in self._edits[1:]:
            edits = edits.unionByName(more)
        if len(self._edits) > 1:
            last = []
            for n in self.column_names():
                known = F.col(f"`__set_{n}`")
                last += [F.max(known).alias(f"__set_{n}"), F.max_by(F.struct(F.col(f"`__new_{n}`").alias("v")), F.when(known, F.col("__turn")))["v"].alias(f"__new_{n}")]
            edits = edits.groupBy("__at").agg(*last)
        edits = edits.drop("__turn")
        base, at = self._unedited

        def lay(rows: DataFrame, edits: DataFrame) -> DataFrame:
            return self._updated(rows, edits if self._edited > 20 * FLUSH_ROWS else F.broadcast(edits))

        def part(place: int, stop: int | None = None) -> DataFrame:
            return lay(at(place, stop), edits.where((F.col("__at") >= place) & (F.col("__at") < (place + 1 if stop is None else stop))))

        self._base, self._at = lay(base, edits), part

    def flush(self) -> None:
        """Writes the table as it is into a new base and lets the old lineage go."""
        n = len(self)
        base = materialise(self.to_df(hidden=True), "table")
        self._rebase(base, n, lambda place, stop=None: base.where((F.col(POSITION) >= place) & (F.col(POSITION) < (place + 1 if stop is None else stop))))
        self._snapshot = None

    # -- reads

    def to_df(self, hidden: bool = False) -> DataFrame:
        """The table as it is now; ``hidden``: with each row's place and id."""
        if self._snapshot is None or self._snapshot[0] != self._version:
            self._snapshot = (self._version, self._overlay())
        df = self._snapshot[1]
        return df if hidden else df.select(*[F.col(f"`{c}`") for c in self.column_names()])

    def _overlay(self) -> DataFrame:
        schema = self.schema.to_spark().add(POSITION, "long").add(ROW_ID, "long")
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        held, stretches, at = [], [], 0
        for piece in self._pieces:
            if isinstance(piece, Held):
                held += [(*values, at + i, rid) for i, (rid, values) in enumerate(piece.rows)]
            else:
                stretches.append((piece.start, piece.stop, at - piece.start))
            at += len(piece)
        parts = []
        if stretches:
            base = self._base
            if stretches != [(0, stretches[0][1], 0)] or len(held):
                stretches.sort()
                base = base.withColumn("__shift", self._shift(stretches)).where("__shift IS NOT NULL")
            else:
                base = base.withColumn("__shift", F.lit(0))
            if self._updates:
                base = self._updated(base, F.broadcast(self._waiting()))
            parts.append(base.withColumn(POSITION, F.col(POSITION) + F.col("__shift")).select(*schema.names))
        if held or not parts:
            parts.append(self.spark.createDataFrame(held, schema))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @staticmethod
    def _shift(stretches: list[tuple[int, int, int]]) -> Column:
        """By how much a base row moved; null if it is gone. A balanced tree of comparisons."""
        if len(stretches) == 1:
            start, stop, shift = stretches[0]
            here = (F.col(POSITION) >= start) & (F.col(POSITION) < stop)
            return F.when(here, F.lit(shift))
        mid = len(stretches) // 2
        return F.when(F.col(POSITION) < stretches[mid][0], Table._shift(stretches[:mid])).otherwise(Table._shift(stretches[mid:]))

    def _waiting(self) -> DataFrame:
        """The updates that wait on the driver, by place in the base."""
        fields = [T.StructField("__at", T.LongType())]
        for n, t, _ in self.schema:
            fields += [T.StructField(f"__set_{n}", T.BooleanType()), T.StructField(f"__new_{n}", t.spark)]
        rows = [(p, *[x for n in self.column_names() for x in (n in new, new.get(n))]) for p, new in self._updates.items()]
        return self.spark.createDataFrame(rows, T.StructType(fields))

    def _updated(self, base: DataFrame, edits: DataFrame) -> DataFrame:
        joined = base.join(edits, F.col(POSITION) == F.col("__at"), "left")
        columns = [F.when(F.coalesce(F.col(f"`__set_{n}`"), F.lit(False)), F.col(f"`__new_{n}`")).otherwise(F.col(f"`{n}`")).alias(n) for n in self.column_names()]
        return joined.select(*columns, *[c for c in base.columns if c not in self.column_names()])

    def get_row(self, index: int) -> dict[str, Any]:
        if not 0 <= index < len(self):
            raise IndexError(f"row {index} is out of range")
        _, piece, place = self._find(index)
        if isinstance(piece, Held):
            return dict(zip(self.column_names(), piece.rows[place][1]))
        row = self._base_row(place) | self._updates.get(place, {})
        return {n: row[n] for n in self.column_names()}

    def get_value(self, row: int, column: str) -> Any:
        if column not in self.column_names() or not 0 <= row < len(self):
            raise KeyError(f"no value at row {row}, column '{column}'")
        return self.get_row(row)[column]

    def row_ids(self) -> list[int]:
        return [r[ROW_ID] for r in self.to_df(hidden=True).select(ROW_ID, POSITION).orderBy(POSITION).toLocalIterator()]

    def rows_with_ids(self) -> Iterator[tuple[int, dict[str, Any]]]:
        """(row id, row) in order."""
        names = self.column_names()
        for r in self.to_df(hidden=True).orderBy(POSITION).toLocalIterator():
            yield r[ROW_ID], {n: r[n] for n in names}

    def __getitem__(self, key: int | slice | str) -> Any:
        if isinstance(key, str):
            if key not in self.column_names():
                raise KeyError(key)
            return [r[0] for r in self.to_df(hidden=True).orderBy(POSITION).select(F.col(f"`{key}`")).toLocalIterator()]
        if isinstance(key, slice):
            return read_slice(self.to_df(hidden=True), self.column_names(), POSITION, key, len(self))
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("a row number, a slice or a column name")
        at = key + len(self) if key < 0 else key
        if not 0 <= at < len(self):
            raise IndexError(f"row {key} is out of range")
        return self.get_row(at)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        seen = self._version
        for row in self._rows():
            if self._version != seen:
                raise RuntimeError("the table was changed during iteration")
            yield row
        if self._version != seen:
            raise RuntimeError("the table was changed during iteration")

    def _rows(self) -> Iterator[dict[str, Any]]:
        names = self.column_names()
        if all(isinstance(p, Held) for p in self._pieces):
            for piece in list(self._pieces):
                for _, values in list(piece.rows):
                    yield dict(zip(names, values))
            return
        for r in self.to_df(hidden=True).orderBy(POSITION).select(*[F.col(f"`{n}`") for n in names]).toLocalIterator():
            yield r.asDict()

    # -- predicates and aggregates

    def filter_expr(self, expression: str) -> list[int]:
        """Places of the rows that match now, in order."""
        df = self.to_df(hidden=True)
        tree = parse(expression)
        return [r[0] for r in df.where(compile_predicate(tree, self.schema.to_spark())).select(POSITION).orderBy(POSITION).toLocalIterator()]

    def _whole(self, kind: str, column: str) -> Any:
        df = self.to_df()
        return df.agg(whole_column(df, kind, column).alias("v")).first()["v"]

    def sum(self, column: str) -> float:
        return self._whole("sum", column)

    def count_non_null(self, column: str) -> int:
        return self._whole("count_non_null", column)

    def avg(self, column: str) -> float | None:
        return self._whole("avg", column)

    def min(self, column: str) -> float | None:
        return self._whole("min", column)

    def max(self, column: str) -> float | None:
        return self._whole("max", column)

    # -- sinks

    def to_csv(self) -> str:
        from ..sources.text import format_csv

        return format_csv(self.schema, self)

    def to_json(self) -> str:
        from ..sources.text import format_json

        return format_json(self.schema, self)

    def to_pandas(self):
        import pandas as pd

        names = self.column_names()
        rows = list(self)
        return pd.DataFrame({n: [r[n] for r in rows] for n in names}, columns=names)

    # -- views and ticks

    def filter(self, predicate):
        from .views import FilterView

        return self._registered(FilterView(self, predicate))

    def select(self, columns):
        from .views import ProjectionView

        return ProjectionView(self, columns)

    def add_computed_column(self, name, compute, kind=None):
        from .views import ComputedView

        return ComputedView(self, name, compute, kind)

    def join(self, other, on=None, how="left", left_on=None, right_on=None, strict_types=True):
        from .views import JoinView

        view = JoinView(f"{self._name}_join", self, other, on if on is not None else left_on, on if on is not None else right_on, how, strict_types)
        return view._register()

    def sort(self, by, descending=None):
        from .relational import sort_keys
        from .views import SortedView

        return self._registered(SortedView(f"{self._name}_sorted", self, sort_keys(by, descending)))

    def group_by(self, by, agg):
        from .views import AggregateView

        return self._registered(AggregateView(f"{self._name}_grouped", self, [by] if isinstance(by, str) else list(by), agg))

    def _registered(self, view):
        return view._register()

    def register(self, view) -> None:
        self._views.append(weakref.ref(view))

    def _live(self) -> list:
        self._views = [r for r in self._views if r() is not None]
        return [r() for r in self._views]

    def registered_view_count(self) -> int:
        return len(self._live())

    def tick(self) -> int:
        """Brings the live views up to date, in the order they were made; how many there are. No changes: 0."""
        if not len(self.log):
            return 0
        views = self._live()
        if not views:
            self.log.clear()
            return 0
        for view in views:
            view.sync()
        self.log.compact(min((view.cursor(self) for view in views), default=self.log.total))
        return len(views)

    def has_pending_changes(self) -> bool:
        return len(self.log) > 0

    def pending_changes_count(self) -> int:
        return len(self.log)

    def changeset_generation(self) -> int:
        return self.log.generation

    def clear_changeset(self) -> None:
        self.log.clear()


def read_slice(df: DataFrame, names: Sequence[str], position: str, key: slice, length: int) -> list[dict[str, Any]]:
    """A Python slice of rows by place: a range filter, then only those rows are brought over."""
    places = range(length)[key]
    if not len(places):
        return []
    low, high = min(places[0], places[-1]), max(places[0], places[-1])
    at = F.col(position)
    part = df.where((at >= low) & (at <= high))
    if abs(places.step) > 1:
        part = part.where(F.pmod(at - F.lit(low), F.lit(abs(places.step))) == 0)
    rows = part.orderBy(at.asc() if places.step > 0 else at.desc()).select(*[F.col(f"`{n}`") for n in names])
    return [r.asDict() for r in rows.toLocalIterator()]
