"""View pipelines from JSON node specs, and the small browser language for filters, sorts and groups."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.aggregates import NUMERIC
from ..operators.relational import SortKey, SortOrder
from ..operators.table import Table
from ..operators.views import AggregateView, FilterView, SortedView, View

#: Aggregate names on the wire; ``pNN`` and ``percentile(x)`` besides.
WIRE = {"sum", "count", "avg", "average", "mean", "min", "max", "median"}


class SpecError(ValueError):
    def __init__(self, node: str, message: str):
        super().__init__(f"{node}: {message}")
        self.node = node


def _wire_function(name: str) -> str:
    low = name.strip().lower()
    if low in WIRE or re.fullmatch(r"percentile\(\s*[0-9.]+\s*\)", low):
        return low
    if (m := re.fullmatch(r"p(\d+(?:\.\d+)?)", low)) and float(m[1]) <= 100:
        return low
    raise ValueError(f"unknown aggregate '{name}'")


def build_node(spec: dict[str, Any], parent: Table | View) -> View:
    """One node of the wire format.

    ``{"kind": "filter", "predicate"}``, ``{"kind": "sort", "keys": [{"column", "descending"}]}`` or
    ``{"kind": "group", "group_by", "aggs": [{"alias", "op", "column"}]}``; a count may go without a column.
    """
    kind = spec["kind"]
    if kind == "filter":
        return FilterView(parent, spec["predicate"])
    if kind == "sort":
        keys = [SortKey(k["column"], SortOrder.DESCENDING if k["descending"] else SortOrder.ASCENDING) for k in spec["keys"]]
        return SortedView(spec["id"], parent, keys)
    if kind == "group":
        if not spec["group_by"]:
            raise ValueError("group_by is empty")
        agg = []
        for a in spec["aggs"]:
            op, column = _wire_function(a["op"]), a.get("column")
            if column is None and op != "count":
                raise ValueError(f"the aggregate '{a['alias']}' needs a column")
            agg.append((a["alias"], spec["group_by"][0] if column is None else column, op))
        return AggregateView(spec["id"], parent, spec["group_by"], agg)
    raise ValueError(f"unknown node kind '{kind}'")


def build_pipeline(root: Table | View, nodes: Sequence[dict[str, Any]]) -> dict[str, View]:
    """The views by node id. ``source_id`` is "base" or an earlier node; SpecError names the node that fails."""
    made: dict[str, Table | View] = {"base": root}
    for spec in nodes:
        node = str(spec.get("id", "?"))
        try:
            source = spec.get("source_id", "base")
            if source not in made:
                raise ValueError(f"unknown source '{source}'")
            if node in made:
                raise ValueError("the id is taken")
            made[node] = build_node(spec, made[source])
        except (ValueError, KeyError, TypeError) as e:
            raise SpecError(node, str(e)) from e
    return {k: v for k, v in made.items() if k != "base"}


_CLAUSE = re.compile(r"""\s*(\w+)\s*(>=|<=|!=|==|=|>|<|\bcontains\b|\bstartsWith\b|\bendsWith\b)\s*('[^']*'|"[^"]*"|\S+)\s*""", re.I)


def mini_filter(text: str, schema: T.StructType) -> Column:
    """``field op literal`` joined by AND and OR strictly from left to right; equality compares as text where kinds differ."""
    if not text.strip():
        return F.lit(True)
    out, at, join = None, 0, "and"
    while True:
        m = _CLAUSE.match(text, at)
        if not m:
            raise ValueError(f"malformed filter at {at}")
        test = _clause(m[1], m[2].lower(), m[3], schema)
        out = test if out is None else (out & test if join == "and" else out | test)
        at = m.end()
        if at >= len(text):
            return out
        word = re.compile(r"(and|or)\b", re.I).match(text, at)
        if not word:
            raise ValueError(f"AND or OR expected at {at}")
        join, at = word[1].lower(), word.end()


def _clause(name: str, op: str, said: str, schema: T.StructType) -> Column:
    if name not in schema.names:
        return F.lit(False)
    quoted = said[0] in "'\""
    value = said[1:-1] if quoted else said
    col, kind = F.col(f"`{name}`"), schema[name].dataType
    if op in ("contains", "startswith", "endswith"):
        low = F.lower(col.cast("string"))
        return F.coalesce(getattr(low, op)(value.lower()), F.lit(False))
    number = None
    if isinstance(kind, NUMERIC):
        try:
            number = float(value)
        except ValueError:
            number = None
    left, right = (col.cast("double"), F.lit(number)) if number is not None else (col.cast("string"), F.lit(value))
    test = {"=": left == right, "==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.coalesce(test, F.lit(op == "!="))


def mini_sort(text: str) -> list[Column]:
    """``"f1 desc, f2"``; nulls last when ascending, first when descending."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, _, way = part.partition(" ")
        out.append(F.col(f"`{name}`").desc_nulls_first() if way.strip().lower() == "desc" else F.col(f"`{name}`").asc_nulls_last())
    return out


def mini_group(df: DataFrame, text: str) -> DataFrame:
    """``"key | a=sum(x), n=count()"``: sorted by key, a null key shown as ``-``, empty numbers as 0."""
    key, bar, rest = text.partition("|")
    key = key.strip()
    if not bar or key not in df.columns:
        raise ValueError(f"unknown group key '{key}'")
    outs = []
    for part in filter(None, (p.strip() for p in rest.split(","))):
        m = re.fullmatch(r"(\w+)\s*=\s*(\w+)\(\s*(\w*|\*)\s*\)", part)
        if not m:
            raise ValueError(f"malformed aggregate '{part}'")
        name, fn, source = m[1], m[2].lower(), m[3]
        if fn == "count":
            outs.append(F.count("*" if source in ("", "*") else F.col(f"`{source}`")).alias(name))
        elif fn in ("sum", "avg", "min", "max") and source in df.columns and isinstance(df.schema[source].dataType, NUMERIC):
            outs.append(F.coalesce(getattr(F, fn)(F.col(f"`{source}`").cast("double")), F.lit(0.0)).alias(name))
        else:
            raise ValueError(f"malformed aggregate '{part}'")
    if not outs:
        raise ValueError("at least one aggregate is needed")
    shown = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-"))
    return df.groupBy(shown.alias(key)).agg(*outs).orderBy(key)
