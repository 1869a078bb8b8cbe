"""Column types, schemas and the strict value rules of root tables."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from enum import Enum
from typing import Any

from pyspark.sql import types as T


class ColumnType(Enum):
    INT32 = "int32"
    INT64 = "int64"
    FLOAT32 = "float32"
    FLOAT64 = "float64"
    STRING = "string"
    BOOL = "bool"
    DATE = "date"
    DATETIME = "datetime"

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self]

    @property
    def numeric(self) -> bool:
        return self in (ColumnType.INT32, ColumnType.INT64, ColumnType.FLOAT32, ColumnType.FLOAT64)

    @classmethod
    def of(cls, kind: T.DataType) -> ColumnType | None:
        """The column type that a Spark type stands for; None for those that a root table can't hold."""
        return next((c for c, s in _SPARK.items() if type(s) is type(kind)), None)


_SPARK = {
    ColumnType.INT32: T.IntegerType(), ColumnType.INT64: T.LongType(), ColumnType.FLOAT32: T.FloatType(), ColumnType.FLOAT64: T.DoubleType(),
    ColumnType.STRING: T.StringType(), ColumnType.BOOL: T.BooleanType(), ColumnType.DATE: T.DateType(), ColumnType.DATETIME: T.TimestampNTZType(),
}
_EPOCH = dt.datetime(1970, 1, 1)


class Schema:
    """An ordered list of (name, type, nullable), fixed once made."""

    def __init__(self, columns: Sequence[tuple[str, ColumnType, bool]]):
        self._columns = [(str(n), t, bool(null)) for n, t, null in columns]
        names = [n for n, _, _ in self._columns]
        if len(set(names)) != len(names):
            raise ValueError("column names have to differ")

    def __len__(self) -> int:
        return len(self._columns)

    def __iter__(self):
        return iter(self._columns)

    def __repr__(self) -> str:
        return "Schema(" + ", ".join(f"{n}: {t.name}{'?' if null else ''}" for n, t, null in self._columns) + ")"

    def get_column_names(self) -> list[str]:
        return [n for n, _, _ in self._columns]

    def get_column_index(self, name: str) -> int | None:
        names = self.get_column_names()
        return names.index(name) if name in names else None

    def get_column_info(self, index: int) -> tuple[str, ColumnType, bool] | None:
        return self._columns[index] if 0 <= index < len(self._columns) else None

    def to_spark(self) -> T.StructType:
        return T.StructType([T.StructField(n, t.spark, null) for n, t, null in self._columns])

    @classmethod
    def from_spark(cls, schema: T.StructType) -> Schema:
        out = []
        for f in schema.fields:
            kind = ColumnType.of(f.dataType)
            if kind is None:
                raise ValueError(f"column '{f.name}': a root table can't hold {f.dataType.simpleString()}")
            out.append((f.name, kind, f.nullable))
        return cls(out)


def convert(value: Any, name: str, kind: ColumnType, nullable: bool) -> Any:
    """The value as the column stores it; ValueError or TypeError where it doesn't fit. No coercion between kinds."""
    if value is None:
        if not nullable:
            raise ValueError(f"column '{name}' isn't nullable")
        return None
    if kind in (ColumnType.INT32, ColumnType.INT64):
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"column '{name}': expected int, got {type(value).__name__}")
        bits = 32 if kind is ColumnType.INT32 else 64
        if not -(1 << bits - 1) <= value < 1 << bits - 1:
            raise ValueError(f"column '{name}': {value} is out of range for {kind.name}")
        return value
    if kind in (ColumnType.FLOAT32, ColumnType.FLOAT64):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise TypeError(f"column '{name}': expected float, got {type(value).__name__}")
        return float(value)
    if kind is ColumnType.STRING:
        if not isinstance(value, str):
            raise TypeError(f"column '{name}': expected str, got {type(value).__name__}")
        return value
    if kind is ColumnType.BOOL:
        if not isinstance(value, bool):
            raise TypeError(f"column '{name}': expected bool, got {type(value).__name__}")
        return value
    if kind is ColumnType.DATE:
        if isinstance(value, dt.datetime):
            return value.date()
        if isinstance(value, dt.date):
            return value
        if isinstance(value, int) and not isinstance(value, bool):
            return (_EPOCH + dt.timedelta(days=value)).date()
        raise TypeError(f"column '{name}': expected date, got {type(value).__name__}")
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            raise ValueError(f"column '{name}': a datetime with a time zone isn't taken")
        return value.replace(microsecond=value.microsecond // 1000 * 1000)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, int) and not isinstance(value, bool):
        return _EPOCH + dt.timedelta(milliseconds=value)
    raise TypeError(f"column '{name}': expected datetime, got {type(value).__name__}")


def is_nan(value: Any) -> bool:
    return isinstance(value, float) and math.isnan(value)
