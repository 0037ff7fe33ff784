"""Dimensions inferred from column types; bucket expressions of time dimensions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from gnomon.errors import MetricsError
from gnomon.model import BoolDim, Dim, StringDim, TimeDim


class Mappers:
    """Spark type to dimension. Numeric, binary and nested types have none."""

    def __init__(self):
        self._known: dict[type, Callable[[str], Dim]] = {}
        for kind in (S.TimestampType, S.TimestampNTZType):
            self.register(kind, TimeDim)
        self.register(S.DateType, lambda c: TimeDim(c, precision="date"))
        self.register(S.BooleanType, BoolDim)
        for kind in (S.StringType, S.CharType, S.VarcharType):
            self.register(kind, StringDim)

    def register(self, kind: type, make: Callable[[str], Dim]) -> None:
        if kind in self._known:
            raise MetricsError(f"{kind.__name__} has a mapper")
        self._known[kind] = make

    def infer(self, schema: S.StructType) -> tuple[Dim, ...]:
        return tuple(self._known[type(f.dataType)](f.name) for f in schema.fields if type(f.dataType) in self._known)

    def times(self, schema: S.StructType) -> dict[str, str]:
        """Temporal columns and their precision."""
        return {d.column: d.precision for d in self.infer(schema) if isinstance(d, TimeDim)}


def bucket(dim: Dim, column: Column) -> Column:
    """The group key. Weeks begin on Monday; buckets have no time zone."""
    if not isinstance(dim, TimeDim):
        return column
    dim.checked()
    start = F.date_trunc(dim.granularity, column)
    return start.cast("date") if dim.precision == "date" else start.cast("timestamp_ntz")
