"""The six view operators as functions from DataFrames to DataFrames, without state.

Hidden columns whose names begin with ``__`` carry the order of rows; callers
that don't care for order never see them and pay nothing for them.
"""

from __future__ import annotations

import dis
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.aggregates import specs, usable
from ..functions.predicate import compile_predicate
from ..sources.storage import materialise

HIDDEN = "__"


class JoinType(Enum):
    LEFT = "left"
    INNER = "inner"
    RIGHT = "right"
    FULL = "full"

    @classmethod
    def parse(cls, how: str | JoinType) -> JoinType:
        if isinstance(how, JoinType):
            return how
        low = how.strip().lower()
        low = {"outer": "full", "full_outer": "full"}.get(low, low)
        try:
            return cls(low)
        except ValueError:
            raise ValueError(f"unknown join '{how}'") from None


class SortOrder(Enum):
    ASCENDING = "asc"
    DESCENDING = "desc"


@dataclass(frozen=True)
class SortKey:
    """Null placement doesn't depend on the direction; by default nulls come last."""

    column: str
    order: SortOrder = SortOrder.ASCENDING
    nulls_first: bool = False

    @classmethod
    def ascending(cls, column: str, nulls_first: bool = False) -> SortKey:
        return cls(column, SortOrder.ASCENDING, nulls_first)

    @classmethod
    def descending(cls, column: str, nulls_first: bool = False) -> SortKey:
        return cls(column, SortOrder.DESCENDING, nulls_first)

    def to_column(self) -> Column:
        c = F.col(f"`{self.column}`")
        way = "asc" if self.order is SortOrder.ASCENDING else "desc"
        return getattr(c, f"{way}_nulls_{'first' if self.nulls_first else 'last'}")()


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def hidden(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def _q(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def row_udf(fn: Callable[[dict], Any], df: DataFrame, kind: T.DataType, then: Callable[[Any], Any] = lambda v: v) -> Column:
    """A Python callable on row dicts, by Arrow batches. Opaque to Catalyst: a Column or an expression string is the fast path.

    Only the columns that the callable can name are sent: where its code, and
    that of the functions inside it, holds no name but constant ones.
    """
    names = _named(fn, visible(df))

    def call(*values):
        return then(fn(dict(zip(names, values))))

    return F.udf(call, kind, useArrow=True)(*_q(names))


def _named(fn: Callable, names: list[str]) -> list[str]:
    """The columns that occur in the code as constants of ``row["name"]``; all of them where the row is used in any other way."""
    code = getattr(fn, "__code__", None)
    if code is None or code.co_argcount != 1 or code.co_flags & 0x0C or code.co_cellvars or code.co_freevars and any(callable(c.cell_contents) for c in fn.__closure__):
        return names
    row, said, steps = code.co_varnames[0], set(), list(dis.get_instructions(code))
    for a, b, c in zip(steps, [*steps[1:], None], [*steps[2:], None, None]):
        loads = a.argval if isinstance(a.argval, tuple) else (a.argval,)
        if not a.opname.startswith(("LOAD_FAST", "STORE_FAST", "DELETE_FAST")) or row not in loads:
            continue
        plain = a.opname in ("LOAD_FAST", "LOAD_FAST_BORROW") and b is not None and b.opname == "LOAD_CONST" and b.argval in names
        if not plain or c is None or not (c.opname == "BINARY_SUBSCR" or c.opname == "BINARY_OP" and c.argrepr == "[]"):
            return names
        said.add(b.argval)
    return [n for n in names if n in said] or names[:1]


def filter_rows(df: DataFrame, predicate: str | Column | Callable[[dict], bool]) -> DataFrame:
    if isinstance(predicate, str):
        return df.where(compile_predicate(predicate, df.schema))
    if isinstance(predicate, Column):
        return df.where(predicate)
    return df.where(row_udf(predicate, df, T.BooleanType(), bool))


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        if c not in visible(df):
            raise ValueError(f"unknown column '{c}'")
    return df.select(*_q(dict.fromkeys(columns)), *_q(hidden(df)))


def add_column(df: DataFrame, name: str, compute: Column | Callable[[dict], Any], kind: T.DataType | None = None) -> DataFrame:
    """One more column; one of the same name is replaced. A callable's type is given, or taken from the first row's value."""
    if isinstance(compute, Column):
        return df.withColumn(name, compute)
    if kind is None:
        kind = _kind_of(compute, df)
    return df.withColumn(name, row_udf(compute, df, kind))


def _kind_of(fn: Callable[[dict], Any], df: DataFrame) -> T.DataType:
    import datetime as dt

    first = df.select(*_q(visible(df))).first()
    value = fn(first.asDict()) if first is not None else None
    for python, kind in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (dt.datetime, T.TimestampNTZType()), (dt.date, T.DateType())):
        if isinstance(value, python):
            return kind
    return T.StringType()


def join_keys(on=None, left_on=None, right_on=None) -> tuple[list[str], list[str]]:
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    if on is not None:
        if left_on is not None or right_on is not None:
            raise ValueError("either on, or left_on and right_on")
        left_on = right_on = on
    if left_on is None or right_on is None:
        raise ValueError("join keys are missing")
    left, right = as_list(left_on), as_list(right_on)
    if not left or len(left) != len(right):
        raise ValueError("both sides need the same number of keys, one at least")
    return left, right


def join_rows(
    left: DataFrame, right: DataFrame, on=None, how: str | JoinType = "left", left_on=None, right_on=None, strict_types: bool = True, many: bool = False
) -> DataFrame:
    """Equi-join. Every right column gets the prefix ``right_``; null and NaN keys never match.

    Keys of different types never match in a typed table, so they are refused
    unless ``strict_types`` is false, when Spark's rules apply. -0.0 and +0.0
    match. Which side is broadcast, if any, is Catalyst's choice by size.
    A full join is a left join and the right rows without a partner, as Spark's
    own holds all pairs of a key in memory at once. ``many``: for keys that
    many rows of both sides have; their pairs are then made by all tasks.
    """
    lk, rk = join_keys(on, left_on, right_on)
    how = JoinType.parse(how)
    for keys, df in ((lk, left), (rk, right)):
        for k in keys:
            if k not in visible(df):
                raise ValueError(f"unknown join column '{k}'")
    clash = {f"right_{c}" for c in visible(right)} & set(visible(left))
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be hidden by the right side's")
    if how is JoinType.FULL:  # both sides are read twice
        left, right = (df if df._jdf.queryExecution().analyzed().deterministic() else materialise(df, "joined") for df in (left, right))
    a = left.select(*_q(visible(left)), *[F.col(f"`{c}`").alias(f"__l{c[2:]}") for c in hidden(left)])
    b = right.select(*[F.col(f"`{c}`").alias(f"right_{c}") for c in visible(right)], *[F.col(f"`{c}`").alias(f"__r{c[2:]}") for c in hidden(right)])
    for x, y in zip(lk, rk):
        kinds = left.schema[x].dataType, right.schema[y].dataType
        if strict_types and kinds[0] != kinds[1]:
            raise ValueError(f"join keys '{x}' and '{y}' have different types: {kinds[0].simpleString()}, {kinds[1].simpleString()}")
    rk = [f"right_{y}" for y in rk]
    if how is not JoinType.FULL:
        return _paired(a, b, lk, rk, how.value) if many else a.join(b, _equal(a, lk, rk), how.value)
    both = _paired(a, b, lk, rk, "left") if many else a.join(b, _equal(a, lk, rk), "left")
    keys = a.select(*[F.col(f"`{x}`").alias(f"__k{i}") for i, x in enumerate(lk)]).dropna().distinct()
    alone = b.join(keys, _equal(keys, keys.columns, rk), "left_anti")
    return both.unionByName(alone.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in a.schema.fields], *_q(b.columns)))


def _equal(left: DataFrame, lk: Sequence[str], rk: Sequence[str]) -> Column:
    """Whether the keys match: nulls and NaN never do."""
    condition = None
    for x, y in zip(lk, rk):
        part = F.col(f"`{x}`") == F.col(f"`{y}`")
        if isinstance(left.schema[x].dataType, (T.FloatType, T.DoubleType)):
            part = part & ~F.isnan(F.col(f"`{x}`"))
        condition = part if condition is None else condition & part
    return condition


def _blocks(df: DataFrame, keys: Sequence[str], side: str, bits: int) -> DataFrame:
    """At most ``2 ** bits`` rows of one key as an array. The sort fills the blocks, and makes them the same when a task runs again."""
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    sorted_ = df.sortWithinPartitions(*_q(keys), *_q([c for c in plain if c not in keys]))
    number = F.shiftright(F.monotonically_increasing_id(), bits).alias(f"__b{side}")
    rows = sorted_.select(*[F.col(f"`{k}`").alias(f"__k{side}{i}") for i, k in enumerate(keys)], number, F.struct(*_q(df.columns)).alias("__row"))
    return rows.groupBy(*[c for c in rows.columns if c != "__row"]).agg(F.collect_list("__row").alias(f"__rows{side}"))


def _paired(a: DataFrame, b: DataFrame, lk: Sequence[str], rk: Sequence[str], how: str) -> DataFrame:
    """A join by blocks: only they meet by key; pairs of blocks are dealt over all tasks, and there make at most 2 ** 18 rows at a time."""
    x, y = _blocks(a, lk, "l", 10), _blocks(b, rk, "r", 8)
    pairs = x.join(y, _equal(x, [f"__kl{i}" for i in range(len(lk))], [f"__kr{i}" for i in range(len(rk))]), how)
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = pairs.repartition(tasks, "__bl", "__br").select("__rowsl", "__rowsr")
    rows = dealt.select(F.explode_outer("__rowsl").alias("__l"), "__rowsr").select("__l", F.explode_outer("__rowsr").alias("__r"))
    return rows.select(*[F.col(f"__l.`{c}`").alias(c) for c in a.columns], *[F.col(f"__r.`{c}`").alias(c) for c in b.columns])


def order_of(df: DataFrame) -> list[Column]:
    """By which columns a frame with hidden order columns is read."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in hidden(df)]


def sort_keys(by: str | SortKey | Sequence, descending: bool | Sequence[bool] | None = None) -> list[SortKey]:
    """``sort()``'s keys: nulls first in both directions, other than ``SortKey``'s own default."""
    names = [by] if isinstance(by, (str, SortKey)) else list(by)
    if not names:
        raise ValueError("at least one sort key is needed")
    flags = [bool(descending)] * len(names) if descending is None or isinstance(descending, bool) else list(descending)
    if len(flags) != len(names):
        raise ValueError("descending needs one entry for each key")
    return [n if isinstance(n, SortKey) else SortKey(n, SortOrder.DESCENDING if d else SortOrder.ASCENDING, True) for n, d in zip(names, flags)]


def sort_rows(df: DataFrame, keys: Sequence[SortKey]) -> DataFrame:
    """Sorted; ties keep the order that the hidden columns give."""
    if not keys:
        raise ValueError("at least one sort key is needed")
    for k in keys:
        if k.column not in visible(df):
            raise ValueError(f"unknown sort column '{k.column}'")
    return df.orderBy(*[k.to_column() for k in keys], *order_of(df))


def group_rows(df: DataFrame, by: Sequence[str], agg: Sequence[tuple], order: bool = False) -> DataFrame:
    """Group columns, then the aggregates in the given order. No keys: one row, none for an empty input.

    ``order``: with the first row's place in a hidden column. Null, and all NaN, are groups of their own.
    """
    by = [by] if isinstance(by, str) else list(by)
    for c in by:
        if c not in visible(df):
            raise ValueError(f"unknown group column '{c}'")
    wanted = specs(agg, df.schema)
    ranks: dict[str, list[float]] = {}  # all percentiles of a column share one buffer
    for _, s, f in wanted:
        if f.rank is not None and f.rank not in ranks.setdefault(s, []):
            ranks[s].append(f.rank)
    outs = [f.column(usable(df.schema, s)).alias(f"__a{i}") for i, (_, s, f) in enumerate(wanted) if f.rank is None]
    outs += [F.percentile(usable(df.schema, s), F.array(*map(F.lit, ps))).alias(f"__p{k}") for k, (s, ps) in enumerate(ranks.items())]
    place = {s: k for k, s in enumerate(ranks)}
    final = [
        (F.col(f"__a{i}") if f.rank is None else F.col(f"__p{place[s]}")[ranks[s].index(f.rank)]).alias(o) for i, (o, s, f) in enumerate(wanted)
    ]
    if order and hidden(df):
        outs.append(F.min(F.struct(*_q(hidden(df)))).alias("__first"))
        final.append(F.col("__first"))
    if by:
        return df.groupBy(*_q(by)).agg(*outs).select(*_q(by), *final)
    return df.agg(*outs, F.count("*").alias("__n")).where("__n > 0").select(*final)
