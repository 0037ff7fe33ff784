"""Filters as Columns."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gnomon.errors import MetricsError

_OPS = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(column: Column, op: str, value) -> Column:
    op = op.strip().lower()
    if op in ("in", "not in"):
        values = list(value)
        if not values:
            return F.lit(op == "not in")
        return column.isin(values) if op == "in" else ~column.isin(values)
    if value is None and op in ("=", "==", "!=", "<>"):
        return column.isNull() if op in ("=", "==") else column.isNotNull()
    if op not in _OPS or value is None:
        raise MetricsError(f"no comparison {op!r} with {value!r}; there are {', '.join(_OPS)}, in, not in; null goes with = and != only")
    return _OPS[op](column, F.lit(value))


def spec(value) -> tuple[str, object]:
    """A filter's value: plain for equality, [operator, value], or any other list for "in". None asks for nulls."""
    if isinstance(value, list | tuple) and len(value) == 2 and isinstance(value[0], str) and (value[0] in _OPS or value[0].lower() in ("in", "not in")):
        return value[0], value[1]
    if isinstance(value, list | tuple | set | frozenset):
        return "in", tuple(value)
    return "=", value


def every(columns: list[Column]) -> Column:
    return reduce(operator.and_, columns, F.lit(True))
