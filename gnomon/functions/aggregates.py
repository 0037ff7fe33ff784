"""Aggregates by name; users add their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gnomon.errors import UnknownAggregate

_BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "count_distinct": F.count_distinct,
}
#: Aggregates that can be taken of their own partial results, and how.
REAGGREGATE = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


class Aggregates:
    def __init__(self):
        self._known = dict(_BUILT_IN)

    def register(self, name: str, make: Callable[[Column], Column]) -> None:
        """make: Column to aggregate Column; a grouped-aggregate pandas_udf will do. Replaces one of the same name."""
        if not callable(make):
            raise UnknownAggregate(f"{name}: not callable")
        self._known[name] = make

    def compile(self, name: str, column: Column) -> Column:
        if name not in self._known:
            raise UnknownAggregate(f"no aggregate {name!r}; there are {', '.join(sorted(self._known))}")
        return self._known[name](column)

    def names(self) -> tuple[str, ...]:
        return tuple(self._known)

    def reset(self) -> None:
        self._known = dict(_BUILT_IN)
