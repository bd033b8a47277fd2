"""Time series tables: columns, error bounds, generated columns and the three schemas of a table."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

import numpy as np
from pyspark.sql import types as T

from tidemill.errors import InvalidArgument

MAX_COLUMNS = 32_767


@dataclass(frozen=True)
class ErrorBound:
    """How far a stored value may be off: `value` itself, or percent of the value if `relative`. 0 is lossless."""

    value: float = 0.0
    relative: bool = False

    @classmethod
    def lossless(cls) -> ErrorBound:
        return cls()

    @classmethod
    def absolute(cls, value: float) -> ErrorBound:
        if not math.isfinite(value) or value <= 0:
            raise InvalidArgument("An absolute error bound must be a positive finite value.")
        return cls(float(value))

    @classmethod
    def percent(cls, value: float) -> ErrorBound:
        if not 0 < value <= 100:
            raise InvalidArgument("A relative error bound must be above 0 % and at most 100 %.")
        return cls(float(value), True)

    @property
    def is_lossless(self) -> bool:
        return self.value == 0

    def __str__(self) -> str:
        return f"{self.value:g}%" if self.relative else f"{self.value:g}"

    def holds(self, real: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Which stored values are within the bound; equal values and two NaN always are."""
        real, stored = np.asarray(real, np.float32), np.asarray(stored, np.float32)
        same = (real == stored) | (np.isnan(real) & np.isnan(stored))
        if self.is_lossless:
            return same
        with np.errstate(all="ignore"):
            off = np.abs(real.astype(np.float64) - stored)
            within = off <= self.value if not self.relative else 100 * off / np.abs(real.astype(np.float64)) <= self.value
        return same | within

    def slack(self, real: np.ndarray) -> np.ndarray:
        """How far a model may aim off a value; a little less than the bound, for rounding."""
        real = np.asarray(real, np.float64)
        if self.is_lossless:
            return np.zeros(len(real))
        return np.full(len(real), 0.99 * self.value) if not self.relative else np.abs(real) * self.value / 100.1


class Kind(Enum):
    TIMESTAMP = "TIMESTAMP"
    FIELD = "FIELD"
    TAG = "TAG"


@dataclass(frozen=True)
class Column:
    """A column of a time series table. A field with an expression is computed when it is read."""

    name: str
    kind: Kind
    bound: ErrorBound = ErrorBound()
    expression: str | None = None


@dataclass(frozen=True)
class TimeSeriesTable:
    """A table's columns in their order. Names are in lower case.

    Exactly one timestamp, at least one stored field; an expression uses stored columns only, which is checked
    against the schema when the table is created.
    """

    name: str
    columns: tuple[Column, ...]

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(names) > MAX_COLUMNS:
            raise InvalidArgument(f"There cannot be more than {MAX_COLUMNS} columns in a time series table.")
        if len(set(names)) != len(names):
            raise InvalidArgument("The columns of a time series table must have different names.")
        if sum(c.kind is Kind.TIMESTAMP for c in self.columns) != 1:
            raise InvalidArgument("A time series table must have exactly one timestamp column.")
        if not self.fields:
            raise InvalidArgument("There must be at least one stored field column in a time series table.")
        for c in self.columns:
            if c.kind is not Kind.FIELD and (c.expression is not None or not c.bound.is_lossless):
                raise InvalidArgument("Only field columns have an error bound or an expression.")
            if c.expression is not None and not c.bound.is_lossless:
                raise InvalidArgument("A generated column has no error bound.")

    @property
    def timestamp(self) -> str:
        return next(c.name for c in self.columns if c.kind is Kind.TIMESTAMP)

    @property
    def stored(self) -> list[Column]:
        return [c for c in self.columns if c.expression is None]

    @property
    def fields(self) -> list[Column]:
        return [c for c in self.stored if c.kind is Kind.FIELD]

    @property
    def generated(self) -> list[Column]:
        return [c for c in self.columns if c.expression is not None]

    @property
    def tags(self) -> list[str]:
        return [c.name for c in self.columns if c.kind is Kind.TAG]

    def index(self, field: str) -> int:
        """Where a stored column stands among the stored ones; the value of `field_column`."""
        return next(i for i, c in enumerate(self.stored) if c.name == field)

    @staticmethod
    def _struct(columns: list[Column]) -> T.StructType:
        types = {Kind.TIMESTAMP: T.TimestampNTZType(), Kind.FIELD: T.FloatType(), Kind.TAG: T.StringType()}
        return T.StructType([T.StructField(c.name, types[c.kind], False) for c in columns])

    @property
    def schema(self) -> T.StructType:
        """The columns that are written."""
        return self._struct(self.stored)

    @property
    def query_schema(self) -> T.StructType:
        """The columns that are read, generated ones included."""
        return self._struct(list(self.columns))

    @property
    def segment_schema(self) -> T.StructType:
        """The columns on disk: one row per segment."""
        return T.StructType([*SEGMENT.fields, *[T.StructField(t, T.StringType()) for t in self.tags], T.StructField("field_column", T.ShortType())])

    def to_json(self) -> dict:
        return {
            "kind": "time series",
            "name": self.name,
            "columns": [{"name": c.name, "kind": c.kind.value, "bound": c.bound.value, "relative": c.bound.relative, "expression": c.expression} for c in self.columns],
        }

    @classmethod
    def from_json(cls, data: dict) -> TimeSeriesTable:
        columns = (Column(c["name"], Kind(c["kind"]), ErrorBound(c["bound"], c["relative"]), c["expression"]) for c in data["columns"])
        return cls(data["name"], tuple(columns))


@dataclass(frozen=True)
class NormalTable:
    """An ordinary table."""

    name: str
    schema: T.StructType

    def __post_init__(self) -> None:
        if len(self.schema.fields) > MAX_COLUMNS:
            raise InvalidArgument(f"There cannot be more than {MAX_COLUMNS} columns in a table.")

    @property
    def query_schema(self) -> T.StructType:
        return self.schema

    def to_json(self) -> dict:
        return {"kind": "normal", "name": self.name, "schema": self.schema.jsonValue()}

    @classmethod
    def from_json(cls, data: dict) -> NormalTable:
        return cls(data["name"], T.StructType.fromJson(data["schema"]))


#: A segment without its tags and field. `chunk` and `first_point` say which points it holds: all fields of a chunk
#: have the same points, so they are put together by position. Times are microseconds since 1970-01-01: predicates on
#: whole numbers reach the row groups of Parquet files, those on timestamps without zone don't (Spark 4.1).
SEGMENT = T.StructType(
    [
        T.StructField("model_type", T.ByteType()),
        T.StructField("start_us", T.LongType()),
        T.StructField("end_us", T.LongType()),
        T.StructField("n_points", T.IntegerType()),
        T.StructField("model_points", T.IntegerType()),
        T.StructField("interval_us", T.LongType()),
        T.StructField("times", T.BinaryType()),
        T.StructField("min_value", T.FloatType()),
        T.StructField("max_value", T.FloatType()),
        T.StructField("sum_value", T.DoubleType()),
        T.StructField("first_value", T.FloatType()),
        T.StructField("last_value", T.FloatType()),
        T.StructField("residuals", T.BinaryType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("first_point", T.IntegerType()),
    ]
)

#: Values of model_type.
CONSTANT, LINEAR, XOR = 0, 1, 2
