"""Incremental maintenance: views that are kept as rows and brought up to date by what changed.

A batch of changes is netted to the ids of the rows it touched; their images
before and after come from two versions of the table by a semi-join. Each rule
gives what a fresh build would: filters apply to both images; counts and sums
of integers add and subtract; minima and maxima are kept with how often they
occur; groups with a percentile or a sum of floating numbers are built anew if
touched; joins drop and redo the rows of touched keys.

What a sync writes is what changed: the rows written at first stay, with a list of
those that no longer count and a small table of new ones. Now and then both are
put together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.aggregates import specs, usable
from ..sources.storage import materialise
from .relational import JoinType, _q, filter_rows, group_rows, join_keys, join_rows
from .table import POSITION, ROW_ID, Table

_INVERTIBLE = {"sum", "count", "avg", "min", "max"}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Syncs, and touched rows since, after which the rows are put together again.
SYNCS, TOUCHED = 16, 50_000


class Tracker:
    """A table's rows at its last sync and its change cursor."""

    def __init__(self, table: Table):
        self.table, self.cursor = table, table.log.total
        self.before = table.to_df(hidden=True)

    def take(self) -> tuple[DataFrame, DataFrame, list[int] | None] | None:
        """``(before, after, touched ids)`` since the last call; None without changes.

        No ids: the log was compacted past the cursor, so the view has to be built anew.
        """
        changes = self.table.log.changes_from(self.cursor)
        if changes is not None and not changes:
            return None
        before, self.before, self.cursor = self.before, self.table.to_df(hidden=True), self.table.log.total
        return before, self.before, None if changes is None else sorted({c.row_id for c in changes})

    def ids(self, rows: Sequence[int]) -> DataFrame:
        return F.broadcast(self.table.spark.createDataFrame([(r,) for r in rows], T.StructType([T.StructField("__t", T.LongType())])))

    def images(self, df: DataFrame, rows: Sequence[int]) -> DataFrame:
        return df.join(self.ids(rows), F.col(ROW_ID) == F.col("__t"), "left_semi")

    def places(self, alias: str, place: str) -> DataFrame:
        """The place of each row at the last sync, for reading in order."""
        return self.before.select(F.col(ROW_ID).alias(alias), F.col(POSITION).alias(place))


class Layers:
    """Rows as they were written, those that no longer count (told by ``without``), and newer ones."""

    def __init__(self, rows: DataFrame, without: Callable[[DataFrame, Any], DataFrame], merge: Callable[[Any, Any], Any]):
        self.without, self.merge = without, merge
        self.reset(rows)

    def reset(self, rows: DataFrame) -> None:
        rows = materialise(rows, "kept")
        self.base, self.gone, self.fresh, self.syncs, self.touched = rows, None, None, 0, 0

    def rows(self) -> DataFrame:
        return self.base if self.fresh is None else self.without(self.base, self.gone).unionByName(self.fresh)

    def apply(self, gone: Any, fresh: DataFrame, touched: int) -> None:
        self.fresh = materialise(fresh if self.fresh is None else self.without(self.fresh, gone).unionByName(fresh), "delta")
        self.gone = gone if self.gone is None else self.merge(self.gone, gone)
        self.syncs, self.touched = self.syncs + 1, self.touched + touched
        if self.syncs >= SYNCS or self.touched > TOUCHED:
            self.reset(self.rows())


class IncrementalFilter:
    """The rows that pass, kept by id."""

    def __init__(self, table: Table, predicate: Any):
        self.tracker, self.predicate = Tracker(table), predicate
        without = lambda df, ids: df.join(self.tracker.ids(sorted(ids)), F.col(ROW_ID) == F.col("__t"), "left_anti")
        self.layers = Layers(filter_rows(self.tracker.before, predicate), without, lambda a, b: a | b)

    def sync(self) -> bool:
        taken = self.tracker.take()
        if taken is None:
            return False
        _, after, ids = taken
        if ids is None:
            self.layers.reset(filter_rows(after, self.predicate))
        else:
            self.layers.apply(set(ids), filter_rows(self.tracker.images(after, ids), self.predicate), len(ids))
        return True

    def frame(self) -> DataFrame:
        rows = self.layers.rows().drop(POSITION)
        return rows.join(self.tracker.places("__i", POSITION), F.col(ROW_ID) == F.col("__i")).drop(ROW_ID, "__i")

    def to_df(self) -> DataFrame:
        return self.layers.rows().select(*[F.col(f"`{c}`") for c in self.tracker.table.column_names()])


class IncrementalGroup:
    """Groups, kept as states where the aggregates allow it; else touched groups are built anew.

    States are numbers of rows, counts, exact sums of integers, and the least
    and greatest value with how often each occurs. What left and what came is
    taken off and added; only a group whose extreme is gone altogether is read
    again.
    """

    def __init__(self, table: Table, by: str | Sequence[str], agg: Sequence[tuple]):
        self.tracker, self.by = Tracker(table), [by] if isinstance(by, str) else list(by)
        self.agg = specs(agg, self.tracker.before.schema)
        self.sources = list(dict.fromkeys(s for _, s, _ in self.agg))
        self.keys = self.by or ["__one"]
        schema = self.tracker.before.schema
        self.summed = [any(s == t and f.kind in ("sum", "avg") for _, t, f in self.agg) for s in self.sources]
        self.extreme = [any(s == t and f.kind in ("min", "max") for _, t, f in self.agg) for s in self.sources]
        self.plain = all(f.kind in _INVERTIBLE for _, _, f in self.agg) and all(isinstance(schema[s].dataType, _INTEGERS) for s, d in zip(self.sources, self.summed) if d)
        merge = lambda a, b: materialise(a.unionByName(b).distinct(), "delta-keys")
        self.layers = Layers(self._build(self.tracker.before), self._without, merge)

    def _build(self, df: DataFrame) -> DataFrame:
        return self._states(df) if self.plain else group_rows(df, self.by, self.agg)

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df if self.by else df.withColumn("__one", F.lit(1))

    def _states(self, df: DataFrame) -> DataFrame:
        df, outs = self._keyed(df), [F.count("*").alias("__rows")]
        for i, s in enumerate(self.sources):
            v = usable(df.schema, s)
            outs.append(F.count(v).alias(f"__n{i}"))
            if self.summed[i]:
                outs.append(F.sum(F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("decimal(28,0)")).cast("decimal(38,0)").alias(f"__s{i}"))
            if self.extreme[i]:
                outs += [F.min(v).alias(f"__lo{i}"), F.max(v).alias(f"__hi{i}")]
        states = df.groupBy(*_q(self.keys)).agg(*outs)
        if not any(self.extreme):
            return states
        ends = [c for i, e in enumerate(self.extreme) if e for c in (f"__lo{i}", f"__hi{i}")]
        named, match = self._match(states.select(*_q(self.keys), *ends), ends)
        times = [F.count(F.when(usable(df.schema, self.sources[int(c[4:])]) == F.col(c), 1)).alias(f"{c}n") for c in ends]
        counted = df.join(named, match).groupBy(*_q(self.keys)).agg(*times)
        counted, match = self._match(counted, [f"{c}n" for c in ends])
        return states.join(counted, match).select(*states.columns, *[f"{c}n" for c in ends])

    def _match(self, keys: DataFrame, more: Sequence[str] = ()) -> tuple[DataFrame, Any]:
        """Null is a key like any other."""
        named = keys.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(self.keys)], *more)
        match = F.lit(True)
        for i, k in enumerate(self.keys):
            match = match & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
        return named, match

    def _without(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        return rows.join(*self._match(keys), "left_anti")

    def _moved(self, keys: DataFrame, left: DataFrame, came: DataFrame, after: DataFrame) -> DataFrame:
        """The touched groups' states after rows that left and rows that came."""
        sides = [self.layers.rows().join(*self._match(keys), "left_semi"), self._states(left), self._states(came)]
        names, rows = [c for c in sides[0].columns if c not in self.keys], None
        for i, side in enumerate(sides):
            part = side.select(*_q(self.keys), *names, F.lit(i).alias("__side"))
            rows = part if rows is None else rows.unionByName(part)
        now = rows.groupBy(*_q(self.keys)).agg(*[F.max(F.when(F.col("__side") == i, F.col(c))).alias(f"{c}_{i}") for c in names for i in range(3)])
        out = []
        for c in names:
            if c == "__rows" or c[2] in "ns":
                zero = F.lit(0).cast(rows.schema[c].dataType)
                kept, gone, new = (F.coalesce(F.col(f"{c}_{i}"), zero) for i in range(3))
                out.append((kept - gone + new).cast(rows.schema[c].dataType).alias(c))
            elif not c.endswith("n"):
                was, gone, new = (F.col(f"{c}_{i}") for i in range(3))
                times = [F.coalesce(F.col(f"{c}n_{i}"), F.lit(0).cast("long")) for i in range(3)]
                rest = times[0] - F.when(gone == was, times[1]).otherwise(0)
                further = was.isNull() | ((new <= was) if c[2] == "l" else (new >= was))
                end = F.when(rest > 0, (F.least if c[2] == "l" else F.greatest)(was, new)).when(further, new)
                out += [end.alias(c), (F.when((rest > 0) & (end == was), rest).otherwise(0) + F.when(new == end, times[2]).otherwise(0)).alias(f"{c}n")]
        moved = now.select(*_q(self.keys), *out).where("__rows > 0").select(*_q(self.keys), *names)
        if not any(self.extreme):
            return moved
        moved, short = materialise(moved, "delta-states"), F.lit(False)
        for i, e in enumerate(self.extreme):
            if e:
                short = short | (F.col(f"__n{i}") > 0) & (F.col(f"__lo{i}").isNull() | F.col(f"__hi{i}").isNull())
        again = moved.where(short).select(*_q(self.keys))
        if again.isEmpty():
            return moved
        return moved.where(~short).unionByName(self._states(self._keyed(after).join(*self._match(again), "left_semi")))

    def sync(self) -> bool:
        taken = self.tracker.take()
        if taken is None:
            return False
        before, after, ids = taken
        if ids is None or not (self.by or self.plain):
            self.layers.reset(self._build(after))
            return True
        names = list(dict.fromkeys([*self.by, *self.sources]))
        images = [self.tracker.images(df, ids).select(*_q(names), F.lit(i).alias("__came")) for i, df in enumerate((before, after))]
        images = self._keyed(materialise(images[0].unionByName(images[1]), "delta-images"))
        keys = materialise(images.select(*_q(self.keys)).distinct(), "delta-keys")
        if self.plain:
            fresh = self._moved(keys, *[images.where(F.col("__came") == i).drop("__came") for i in range(2)], after)
        else:
            fresh = group_rows(after.join(*self._match(keys), "left_semi"), self.by, self.agg)
        self.layers.apply(keys, fresh, len(ids))
        return True

    def frame(self) -> DataFrame:
        """With the first row's place, by which groups are read in order."""
        firsts = self._keyed(self.tracker.before).groupBy(*_q(self.keys)).agg(F.min(F.struct(POSITION)).alias("__first"))
        named, match = self._match(firsts, ["__first"])
        rows = self.to_df() if self.by else self._keyed(self.to_df())
        return rows.join(named, match).drop(*[f"__k{i}" for i in range(len(self.keys))], "__one")

    def to_df(self) -> DataFrame:
        rows = self.layers.rows()
        if not self.plain:
            return rows
        out = []
        for o, s, f in self.agg:
            i = self.sources.index(s)
            n, total = F.col(f"__n{i}"), F.col(f"__s{i}").cast("double") if self.summed[i] else None
            value = {"count": lambda: n, "sum": lambda: F.when(n > 0, total), "avg": lambda: F.when(n > 0, total / n), "min": lambda: F.col(f"__lo{i}"), "max": lambda: F.col(f"__hi{i}")}[f.kind]()
            out.append(value.alias(o))
        return rows.select(*_q(self.by), *out)


class IncrementalJoin:
    """Joined rows with both sides' ids. One rule serves all four modes and changes on both sides."""

    def __init__(self, left: Table, right: Table, on=None, how: str | JoinType = "left", left_on=None, right_on=None, strict_types: bool = True):
        self.left, self.right = Tracker(left), Tracker(right)
        self.keys, self.how, self.strict = join_keys(on, left_on, right_on), JoinType.parse(how), strict_types
        self.layers = Layers(self._build(self.left.before, self.right.before), self._without, lambda a, b: tuple(materialise(x.unionByName(y).distinct(), "delta-gone") for x, y in zip(a, b)))

    def _build(self, left: DataFrame, right: DataFrame) -> DataFrame:
        return join_rows(left, right, how=self.how, left_on=self.keys[0], right_on=self.keys[1], strict_types=self.strict)

    def _without(self, rows: DataFrame, gone: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
        """Rows with a touched key or a touched row on neither side."""
        keys, *ids = gone
        for prefix, names, own, t in (("", self.keys[0], "__lrid", ids[0]), ("right_", self.keys[1], "__rrid", ids[1])):
            rows = rows.join(keys, [F.col(f"`{prefix}{n}`") == F.col(f"__k{i}") for i, n in enumerate(names)], "left_anti")
            rows = rows.join(t, F.col(own) == F.col("__t"), "left_anti")
        return rows

    def sync(self) -> bool:
        taken = [t.take() for t in (self.left, self.right)]
        if taken == [None, None]:
            return False
        if any(side and side[2] is None for side in taken):
            self.layers.reset(self._build(self.left.before, self.right.before))
            return True
        keys, ids, after, many = None, [], [], 0
        for side, tracker, names in zip(taken, (self.left, self.right), self.keys):
            ids.append(tracker.ids(side[2] if side else []))
            after.append(tracker.before)
            many += len(side[2]) if side else 0
            for image in side[:2] if side else ():
                k = tracker.images(image, side[2]).select(*[F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(names)])
                keys = k if keys is None else keys.union(k)
        keys = materialise(keys.dropna().distinct(), "delta-keys")
        touched = []
        for df, own, names in zip(after, ids, self.keys):
            by_key = df.join(keys, [F.col(f"`{n}`") == F.col(f"__k{i}") for i, n in enumerate(names)], "left_semi").select(F.col(ROW_ID).alias("__t"))
            touched.append(materialise(by_key.union(own).distinct(), "delta-ids"))
        redone = self._build(*[df.join(t, F.col(ROW_ID) == F.col("__t"), "left_semi") for df, t in zip(after, touched)])
        self.layers.apply((keys, *touched), redone, many)
        return True

    def frame(self) -> DataFrame:
        rows = self.layers.rows().drop(f"__l{POSITION[2:]}", f"__r{POSITION[2:]}")
        for tracker, side in ((self.left, "l"), (self.right, "r")):
            rows = rows.join(tracker.places("__i", f"__{side}{POSITION[2:]}"), F.col(f"__{side}rid") == F.col("__i"), "left").drop("__i", f"__{side}rid")
        return rows

    def to_df(self) -> DataFrame:
        rows = self.layers.rows()
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if not c.startswith("__")])
