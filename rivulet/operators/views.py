"""Derived views over root tables and over each other.

A view is a lazy DataFrame pinned to the versions that its roots had at the
last sync; Catalyst plans the whole chain at once. Projections and computed
columns have no state of their own: they follow their parent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql import types as T

from ..sources.storage import numbered
from .relational import (
    JoinType, SortKey, add_column, filter_rows, group_rows, hidden, join_rows, order_of, select_columns, sort_keys, visible,
)
from .table import POSITION, ROW_ID, Table, read_slice

_AT = "__at"


def frame_of(parent: Table | View) -> DataFrame:
    """The parent's rows with its hidden order columns."""
    return parent.to_df(hidden=True).drop(ROW_ID) if isinstance(parent, Table) else parent.frame()


class View:
    """What all views share. ``frame()`` is the pinned DataFrame, hidden order columns included."""

    #: Whether ticks of the roots reach the view by its own registration.
    registers = True

    def __init__(self, name: str, *parents: Table | View):
        self._name, self.parents = name, parents
        self._cursors: dict[int, int] = {}
        self._syncs, self._parents_at = 0, ()
        self._pinned: DataFrame | None = None
        self._placed: tuple[int, DataFrame] | None = None
        self._kept = None
        self.refresh()

    def build(self) -> DataFrame:
        raise NotImplementedError

    # -- freshness

    def roots(self) -> list[Table]:
        out = []
        for p in self.parents:
            out += [r for r in ([p] if isinstance(p, Table) else p.roots()) if r not in out]
        return out

    def _register(self):
        for root in self.roots():
            root.register(self)
        return self

    def refresh(self) -> None:
        """Pins the view to its parents as they are now."""
        for p in self.parents:
            if isinstance(p, View) and not p.registers:
                p.refresh()
        if self._kept is not None:
            self._kept.sync()
            self._pinned = None
        else:
            self._pinned = self.build()
        self._count = None
        self._cursors = {id(r): r.log.total for r in self.roots()}
        self._parents_at = tuple(p.version() for p in self.parents)
        self._syncs += 1

    def maintain(self):
        """From now on ``tick()`` keeps the view's rows and applies what changed, instead of building it anew when it is read.

        For filters, groups and joins whose parents are root tables.
        """
        if not all(isinstance(p, Table) for p in self.parents):
            raise TypeError("only a view whose parents are root tables can be maintained")
        self._kept = self._incremental()
        self.refresh()
        return self

    def _incremental(self):
        raise TypeError(f"a {type(self).__name__} has no rows of its own to maintain")

    def sync(self) -> bool:
        """Brings the view up to date; whether anything had changed."""
        if tuple(p.version() for p in self.parents) == self._parents_at:
            self._cursors = {id(r): r.log.total for r in self.roots()}
            return False
        self.refresh()
        return True

    def version(self) -> int:
        return self._syncs + sum(p.version() for p in self.parents if isinstance(p, View))

    def cursor(self, root: Table) -> int:
        return self._cursors.get(id(root), root.log.total)

    def last_synced_generation(self) -> int:
        return max((r.log.generation for r in self.roots()), default=0)

    # -- reads

    def frame(self) -> DataFrame:
        """The rows with hidden columns that say their order."""
        if self._pinned is None:
            self._pinned = self._kept.frame()
        return self._pinned

    def to_df(self) -> DataFrame:
        if self._kept is not None:
            return self._kept.to_df()
        df = self.frame()
        return df.select(*[F.col(f"`{c}`") for c in visible(df)])

    def ordered(self) -> DataFrame:
        """The rows with their place in a column ``__at``.

        They are sorted by ranges and written once, then numbered by the counts
        of the written parts: no task holds more than its range. Only what
        reads by place asks for it, and it is kept until the view changes.
        """
        df = self.frame()
        if self._placed is None or self._placed[0] != self._syncs:
            rows = df.orderBy(*self.order()) if self.order() else df
            self._placed = self._syncs, numbered(rows, _AT)[0]
        return self._placed[1]

    def order(self) -> list:
        return order_of(self.frame())

    def name(self) -> str:
        return self._name

    def column_names(self) -> list[str]:
        return visible(self.frame())

    def __len__(self) -> int:
        if self._count is None:
            self._count = (self.frame() if self._kept is None else self._kept.to_df()).count()
        return self._count

    def is_empty(self) -> bool:
        return len(self) == 0

    def display(self) -> str:
        return f"{type(self).__name__} '{self._name}' [{len(self)} rows x {len(self.column_names())} columns]"

    __repr__ = display

    def get_row(self, index: int) -> dict[str, Any]:
        if not 0 <= index < len(self):
            raise IndexError(f"row {index} is out of range")
        return self[index : index + 1][0]

    def get_value(self, row: int, column: str) -> Any:
        if column not in self.column_names() or not 0 <= row < len(self):
            raise KeyError(f"no value at row {row}, column '{column}'")
        return self.get_row(row)[column]

    def __getitem__(self, key: int | slice) -> Any:
        names = self.column_names()
        if isinstance(key, slice):
            if key.start in (None, 0) and key.step in (None, 1) and key.stop is not None and key.stop >= 0:
                rows = self.frame().orderBy(*self.order()) if self.order() else self.frame()
                return [r.asDict() for r in rows.select(*[F.col(f"`{n}`") for n in names]).limit(key.stop).collect()]
            return read_slice(self.ordered(), names, _AT, key, len(self))
        if isinstance(key, bool) or not isinstance(key, int):
            raise TypeError("a row number or a slice")
        return self.get_row(key + len(self) if key < 0 else key)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        seen = tuple(r.version() for r in self.roots()), self._syncs
        df = self.frame()
        rows = df.orderBy(*self.order()) if self.order() else df
        for r in rows.select(*[F.col(f"`{n}`") for n in self.column_names()]).toLocalIterator():
            if (tuple(x.version() for x in self.roots()), self._syncs) != seen:
                raise RuntimeError("the view was changed during iteration")
            yield r.asDict()

    # -- chaining: any view over any view

    def filter(self, predicate) -> FilterView:
        return FilterView(self, predicate)._register()

    def select(self, columns: Sequence[str]) -> ProjectionView:
        return ProjectionView(self, columns)

    def add_computed_column(self, name: str, compute, kind: T.DataType | None = None) -> ComputedView:
        return ComputedView(self, name, compute, kind)

    def sort(self, by, descending=None) -> SortedView:
        return SortedView(f"{self._name}_sorted", self, sort_keys(by, descending))._register()

    def group_by(self, by, agg) -> AggregateView:
        return AggregateView(f"{self._name}_grouped", self, [by] if isinstance(by, str) else list(by), agg)._register()

    def join(self, other, on=None, how="left", left_on=None, right_on=None, strict_types=True) -> JoinView:
        keys = (on, on) if on is not None else (left_on, right_on)
        return JoinView(f"{self._name}_join", self, other, *keys, how, strict_types)._register()


class FilterView(View):
    def __init__(self, parent: Table | View, predicate):
        self.predicate = predicate
        super().__init__(f"{parent.name()}_filtered", parent)

    def build(self) -> DataFrame:
        return filter_rows(frame_of(self.parents[0]), self.predicate)

    def _incremental(self):
        from .delta import IncrementalFilter

        return IncrementalFilter(self.parents[0], self.predicate)


class _Following(View):
    """Stateless: always shows its parent as that is now."""

    registers = False

    def frame(self) -> DataFrame:
        if tuple(p.version() for p in self.parents) != self._parents_at:
            self.refresh()
        return self._pinned

    def __len__(self) -> int:
        self.frame()
        return super().__len__()


class ProjectionView(_Following):
    def __init__(self, parent: Table | View, columns: Sequence[str]):
        self.columns = list(columns)
        super().__init__(f"{parent.name()}_projected", parent)

    def build(self) -> DataFrame:
        return select_columns(frame_of(self.parents[0]), self.columns)


class ComputedView(_Following):
    def __init__(self, parent: Table | View, column: str, compute, kind: T.DataType | None = None):
        self.column, self.compute, self.kind = column, compute, kind
        super().__init__(f"{parent.name()}_computed", parent)

    def build(self) -> DataFrame:
        return add_column(frame_of(self.parents[0]), self.column, self.compute, self.kind)


class JoinView(View):
    def __init__(self, name: str, left: Table | View, right: Table | View, left_keys, right_keys, how: str | JoinType = JoinType.LEFT, strict_types: bool = True):
        self.keys, self.how, self.strict = (left_keys, right_keys), JoinType.parse(how), strict_types
        super().__init__(name, left, right)

    def build(self) -> DataFrame:
        left, right = map(frame_of, self.parents)
        return join_rows(left, right, how=self.how, left_on=self.keys[0], right_on=self.keys[1], strict_types=self.strict)

    def _incremental(self):
        from .delta import IncrementalJoin

        return IncrementalJoin(*self.parents, how=self.how, left_on=self.keys[0], right_on=self.keys[1], strict_types=self.strict)


def _literal(value: Any):
    return F.struct(*[_literal(v).alias(n) for n, v in value.asDict().items()]) if isinstance(value, Row) else F.lit(value)


def _before(df: DataFrame, names: Sequence[str], row: Row):
    """Whether a row of ``df`` comes before that one in order of the columns, nulls last."""
    out = F.lit(False)
    for n in reversed(names):
        c = F.col(f"`{n}`")
        v = _literal(row[n]).cast(df.schema[n].dataType)
        out = c.isNotNull() | out if row[n] is None else (c < v) | ((c == v) & out)
    return F.coalesce(out, F.lit(False))


class SortedView(View):
    def __init__(self, name: str, parent: Table | View, keys: Sequence[SortKey]):
        self.keys = list(keys)
        if not self.keys:
            raise ValueError("at least one sort key is needed")
        super().__init__(name, parent)

    def build(self) -> DataFrame:
        df = frame_of(self.parents[0])
        for k in self.keys:
            if k.column not in visible(df):
                raise ValueError(f"unknown sort column '{k.column}'")
        old = hidden(df)
        renamed = df.withColumnsRenamed({c: f"__s{c[2:]}" for c in old})
        return renamed.select(*[F.col(f"`{c}`") for c in visible(df)], *[F.col(f"`__s{c[2:]}`") for c in old])

    def order(self) -> list:
        return [k.to_column() for k in self.keys] + order_of(self.frame())

    def get_parent_index(self, index: int) -> int | None:
        """The place that the row has in the parent."""
        parent = self.parents[0]
        df = self.ordered()
        if isinstance(parent, Table):
            row = df.where(F.col(_AT) == index).select(f"__s{POSITION[2:]}").first()
            return row[0] if row else None
        row = df.where(F.col(_AT) == index).first()
        if row is None:
            return None
        frame = self.frame()
        return frame.where(_before(frame, hidden(frame), row)).count()


class AggregateView(View):
    """Groups in order of their first row. ``agg``: (output, source column, function) triples."""

    def __init__(self, name: str, parent: Table | View, by: Sequence[str], agg: Sequence[tuple]):
        self.by, self.agg = list(by), list(agg)
        super().__init__(name, parent)

    def build(self) -> DataFrame:
        return group_rows(frame_of(self.parents[0]), self.by, self.agg, order=True)

    def _incremental(self):
        from .delta import IncrementalGroup

        return IncrementalGroup(self.parents[0], self.by, self.agg)
