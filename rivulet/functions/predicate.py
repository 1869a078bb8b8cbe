"""The predicate language: ``score > 90 AND NOT name = 'Bob'``.

Logic is two-valued: a comparison with null, with an unknown column or between
kinds that don't compare is false, and NOT of it true. NOT is pushed to the
leaves before Columns are built, so that comparisons stay bare and reach the
Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


class PredicateError(ValueError):
    pass


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Any


@dataclass(frozen=True)
class IsNull:
    column: str
    wanted: bool = True


@dataclass(frozen=True)
class Not:
    inner: Any


@dataclass(frozen=True)
class Both:
    """AND if ``every``, else OR."""

    every: bool
    left: Any
    right: Any


_TOKEN = re.compile(
    r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
    r"""|(?P<op><=|>=|==|!=|=|<|>|!)|(?P<paren>[()])|(?P<word>[^\W\d]\w*))""", re.S)
_KEYWORDS = {"and", "or", "not", "is", "null", "true", "false"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, Any]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise PredicateError(f"unexpected character at {at}: {text[at:].strip()[:1]!r}")
        kind, said, at = m.lastgroup, m[m.lastgroup], m.end()
        if kind == "number":
            if "." in said:
                out.append(("value", float(said)))
            else:
                value = int(said)
                if abs(value) > (1 << 63) - 1:
                    raise PredicateError(f"{said} is out of range")
                out.append(("value", value))
        elif kind == "string":
            out.append(("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), said[1:-1], flags=re.S)))
        elif kind == "word" and said.lower() in _KEYWORDS:
            low = said.lower()
            out.append(("value", {"true": True, "false": False}[low]) if low in ("true", "false") else (low, low))
        else:
            out.append((kind, said))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, *wanted: tuple[str, Any] | str) -> tuple[str, Any] | None:
        token = self.peek()
        if token[0] in wanted or token in wanted:
            self.at += 1
            return token
        return None

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Both(False, left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Both(True, left, self.negated())
        return left

    def negated(self):
        if self.take("not", ("op", "!")):
            return Not(self.negated())
        if self.take(("paren", "(")):
            inner = self.either()
            if not self.take(("paren", ")")):
                raise PredicateError("a closing parenthesis is missing")
            return inner
        return self.leaf()

    def leaf(self):
        name = self.take("word")
        if not name:
            raise PredicateError(f"expected a column, found {self.peek()[1]!r}")
        if self.take("is"):
            wanted = not self.take("not")
            if not self.take("null"):
                raise PredicateError("expected NULL after IS")
            return IsNull(name[1], wanted)
        op = self.take("op")
        if not op or op[1] == "!":
            raise PredicateError(f"expected an operator after '{name[1]}'")
        value = self.take("value") or (self.take("null") and ("value", None))
        if not value:
            raise PredicateError(f"expected a literal, found {self.peek()[1]!r}")
        return Compare(name[1], "=" if op[1] == "==" else op[1], value[1])


def parse(text: str):
    """The expression's tree; PredicateError where it is malformed."""
    p = _Parser(text)
    tree = p.either()
    if p.peek()[0] != "end":
        raise PredicateError(f"unexpected {p.peek()[1]!r}")
    return tree


def columns(tree) -> list[str]:
    """Referenced columns, sorted, each once."""
    if isinstance(tree, (Compare, IsNull)):
        return [tree.column]
    parts = [tree.inner] if isinstance(tree, Not) else [tree.left, tree.right]
    return sorted({c for p in parts for c in columns(p)})


_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_APPLY = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
}


def _comparable(kind: T.DataType | None, op: str, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType) and op in ("=", "!=")
    if isinstance(value, (int, float)):
        return isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType))
    return isinstance(value, str) and isinstance(kind, T.StringType)


def compile_predicate(tree, schema: T.StructType, negated: bool = False) -> Column:
    """The tree as a Column that is true exactly where the predicate holds (null counts as not)."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Not):
        return compile_predicate(tree.inner, schema, not negated)
    if isinstance(tree, Both):
        left, right = (compile_predicate(t, schema, negated) for t in (tree.left, tree.right))
        return left & right if tree.every != negated else left | right
    kind = schema[tree.column].dataType if tree.column in schema.names else None
    col = F.col(f"`{tree.column}`")
    if isinstance(tree, IsNull):
        wanted = tree.wanted != negated
        if kind is None:
            return F.lit(wanted)
        return col.isNull() if wanted else col.isNotNull()
    if not _comparable(kind, tree.op, tree.value):
        return F.lit(negated)
    real = isinstance(kind, (T.FloatType, T.DoubleType))
    if isinstance(kind, T.FloatType) or isinstance(tree.value, float) and not real:
        col = col.cast("double")
    value = F.lit(float(tree.value) if real else tree.value)
    above = real and tree.op in (">", ">=")
    if not negated:
        test = _APPLY[tree.op](col, value)
        return test & ~F.isnan(col) if above else test
    test = _APPLY[_OPPOSITE[tree.op]](col, value)
    if above:
        test = test | F.isnan(col)
    return test | col.isNull()


def evaluate(tree, row: dict[str, Any]) -> bool:
    """The same semantics on one row of Python values."""
    if isinstance(tree, Not):
        return not evaluate(tree.inner, row)
    if isinstance(tree, Both):
        return evaluate(tree.left, row) and evaluate(tree.right, row) if tree.every else evaluate(tree.left, row) or evaluate(tree.right, row)
    value = row.get(tree.column)
    if isinstance(tree, IsNull):
        return (value is None) == tree.wanted
    said = tree.value
    if value is None or said is None:
        return False
    if isinstance(said, bool) or isinstance(value, bool):
        if not (isinstance(said, bool) and isinstance(value, bool)) or tree.op not in ("=", "!="):
            return False
    elif isinstance(said, str) != isinstance(value, str) or not isinstance(value, (str, int, float)):
        return False
    return bool(_APPLY[tree.op](value, said))
