"""Aggregate functions: names, their Columns, and the whole-column aggregates.

Grouped aggregates see numbers only, as doubles, without nulls and NaN; a
column that isn't numeric has none, so its count is 0 and the rest null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_NAMES = {
    "sum": "sum", "count": "count", "avg": "avg", "average": "avg", "mean": "avg", "min": "min", "minimum": "min",
    "max": "max", "maximum": "max", "median": "median", "med": "median",
}


@dataclass(frozen=True)
class AggregateFunction:
    kind: str
    p: float | None = None

    @staticmethod
    def PERCENTILE(p: float) -> AggregateFunction:
        if not 0 <= p <= 1:
            raise ValueError(f"a percentile lies between 0 and 1, not {p}")
        return AggregateFunction("percentile", float(p))

    @classmethod
    def parse(cls, name: str | AggregateFunction) -> AggregateFunction:
        if isinstance(name, AggregateFunction):
            return name
        low = name.strip().lower()
        if low in _NAMES:
            return cls(_NAMES[low])
        if m := re.fullmatch(r"p(\d+(?:\.\d+)?)", low):
            return cls.PERCENTILE(float(m[1]) / 100)
        if m := re.fullmatch(r"percentile\(\s*([0-9.]+)\s*\)", low):
            return cls.PERCENTILE(float(m[1]))
        raise ValueError(f"unknown aggregate '{name}'")

    @property
    def rank(self) -> float | None:
        """The share of a percentile; None for other aggregates."""
        return {"median": 0.5, "percentile": self.p}.get(self.kind)

    def column(self, value: Column) -> Column:
        """``value``: a double that is null where it doesn't count."""
        if self.kind == "count":
            return F.count(value)
        if self.kind in ("median", "percentile"):
            return F.percentile(value, self.rank)
        return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.kind](value)


for _n in ("SUM", "COUNT", "AVG", "MIN", "MAX", "MEDIAN"):
    setattr(AggregateFunction, _n, AggregateFunction(_n.lower()))


def usable(schema: T.StructType, name: str) -> Column:
    """A number that counts, as a double; else null."""
    kind = schema[name].dataType
    if not isinstance(kind, NUMERIC):
        return F.lit(None).cast("double")
    value = F.col(f"`{name}`").cast("double")
    return F.nanvl(value, F.lit(None).cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


def specs(agg, schema: T.StructType) -> list[tuple[str, str, AggregateFunction]]:
    """Checked (output, source, function) triples."""
    out = [(o, s, AggregateFunction.parse(f)) for o, s, f in agg]
    if not out:
        raise ValueError("at least one aggregate is needed")
    for _, source, _ in out:
        if source not in schema.names:
            raise ValueError(f"unknown column '{source}'")
    return out


def whole_column(df: DataFrame, kind: str, name: str) -> Column:
    """``sum``, ``count_non_null``, ``avg``, ``min`` or ``max`` of a whole column (not as in groups: NaN counts)."""
    if name not in df.schema.names:
        raise KeyError(name)
    if kind == "count_non_null":
        return F.count(F.col(f"`{name}`"))
    if not isinstance(df.schema[name].dataType, NUMERIC):
        return F.lit(0.0) if kind == "sum" else F.lit(None).cast("double")
    value = F.col(f"`{name}`").cast("double")
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if kind == "avg":
        return F.avg(value)
    known = F.nanvl(value, F.lit(None).cast("double"))
    return F.coalesce({"min": F.min, "max": F.max}[kind](known), F.max(value))
