"""What users declare: tables, relations, dimensions, metrics. All values are immutable."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from gnomon.errors import BadGranularity, MetricsError

#: A granularity and those that it is finer than.
COARSER = {
    "hour": ("day", "week", "month", "quarter", "year"),
    "day": ("week", "month", "quarter", "year"),
    "week": (),
    "month": ("quarter", "year"),
    "quarter": ("year",),
    "year": (),
}


@dataclass(frozen=True)
class PrimaryKey:
    columns: tuple[str, ...]
    auto_increment: bool = True

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if self.is_composite:
            object.__setattr__(self, "auto_increment", False)

    @property
    def is_single(self) -> bool:
        return len(self.columns) == 1

    @property
    def is_composite(self) -> bool:
        return len(self.columns) > 1

    @property
    def column(self) -> str | None:
        return self.columns[0] if self.is_single else None


@dataclass(frozen=True)
class Relation:
    """An edge from the table that declares it. kind: belongs_to (N:1), has_one (1:1), has_many (1:N), many_to_many
    (over `bridge`: its table, column of this side, column of the other), morph_many and morph_to (with `type_is`:
    the column that names the owner's kind, and the name)."""

    name: str
    kind: str
    target: str
    local: str
    remote: str
    bridge: tuple[str, str, str] | None = None
    type_is: tuple[str, str] | None = None

    @property
    def is_one(self) -> bool:
        return self.kind in ("belongs_to", "has_one", "morph_to")

    @property
    def is_many(self) -> bool:
        return not self.is_one

    @property
    def is_pivot(self) -> bool:
        return self.kind == "many_to_many"


@dataclass(frozen=True)
class Dim:
    """A grouping: `table.column`, or a bare column that every branch finds on its own fact table."""

    ref: str
    named: str | None = None
    conditions: tuple[tuple[str, Any], ...] = ()
    kind = "any"

    @property
    def name(self) -> str:
        return self.named or self.column

    @property
    def column(self) -> str:
        return self.ref.rsplit(".", 1)[-1]

    def alias(self, name: str):
        return replace(self, named=name)

    with_name = alias

    def only(self, values):
        return replace(self, conditions=(*self.conditions, ("in", tuple(values))))

    def except_(self, values):
        return replace(self, conditions=(*self.conditions, ("not in", tuple(values))))

    def where(self, op: str, value):
        return replace(self, conditions=(*self.conditions, (op, value)))


@dataclass(frozen=True)
class StringDim(Dim):
    values: tuple[str, ...] = ()
    kind = "string"

    def with_values(self, values):
        return replace(self, values=tuple(values))

    def add_value(self, value: str):
        return replace(self, values=(*self.values, value))


@dataclass(frozen=True)
class BoolDim(Dim):
    kind = "boolean"


@dataclass(frozen=True)
class EnumDim(Dim):
    """A dimension with a known domain. Conditions on values outside it are refused; `strict` leaves out rows whose
    value is outside it."""

    enum: type[Enum] | None = None
    listed: tuple = ()
    kind = "enum"

    @property
    def cases(self) -> tuple:
        return self.listed or (tuple(e.value for e in self.enum) if self.enum else ())

    def with_enum(self, enum: type[Enum]):
        return replace(self, enum=enum)

    def with_cases(self, values):
        return replace(self, listed=tuple(values))

    def _known(self, values):
        values = tuple(getattr(v, "value", v) for v in values)
        if self.cases and (odd := [v for v in values if v not in self.cases]):
            raise MetricsError(f"{self.ref} has no case {odd[0]!r}; there are {', '.join(map(repr, self.cases))}")
        return values

    def only(self, values):
        return super().only(self._known(values))

    def except_(self, values):
        return super().except_(self._known(values))

    def strict(self):
        return super().only(self.cases)


@dataclass(frozen=True)
class TimeDim(Dim):
    granularity: str = "day"
    precision: str = "timestamp"
    least: str | None = None
    kind = "time"

    def at(self, granularity: str):
        if granularity not in COARSER:
            raise BadGranularity(f"no granularity {granularity!r}; there are {', '.join(COARSER)}")
        return replace(self, granularity=granularity)

    def hourly(self):
        return self.at("hour")

    def daily(self):
        return self.at("day")

    def weekly(self):
        return self.at("week")

    def monthly(self):
        return self.at("month")

    def quarterly(self):
        return self.at("quarter")

    def yearly(self):
        return self.at("year")

    def as_date(self):
        return replace(self, precision="date")

    def as_timestamp(self):
        return replace(self, precision="timestamp")

    def min_granularity(self, granularity: str):
        return replace(self, least=self.at(granularity).granularity)

    def checked(self):
        if self.precision == "date" and self.granularity == "hour":
            raise BadGranularity(f"{self.ref} holds dates; it has no hours")
        if self.least and self.granularity != self.least and self.granularity not in COARSER[self.least]:
            raise BadGranularity(f"{self.ref} can't be finer than {self.least}: {self.granularity}")
        return self


@dataclass(frozen=True)
class Measure:
    """An aggregate over `table.column`. Presentation (label, currency, decimals) is column metadata only."""

    func: str
    ref: str
    named: str | None = None
    conditions: tuple[tuple[str, Any], ...] = ()
    shown: tuple[tuple[str, Any], ...] = ()

    def alias(self, name: str):
        return replace(self, named=name)

    def where(self, column: str, op: str, value):
        """Count only rows for which the column of the same table compares so."""
        return replace(self, conditions=(*self.conditions, (column, op, value)))

    def distinct(self):
        return replace(self, func="count_distinct")

    def label(self, text: str):
        return replace(self, shown=(*self.shown, ("label", text)))

    def currency(self, code: str):
        return replace(self, shown=(*self.shown, ("currency", code)))

    def decimals(self, n: int):
        return replace(self, shown=(*self.shown, ("decimals", n)))


def _maker(func: str):
    def make(ref: str) -> Measure:
        return Measure(func, ref)

    make.__name__ = func
    return make


Sum, Count, Avg, Min, Max, CountDistinct = (_maker(f) for f in ("sum", "count", "avg", "min", "max", "count_distinct"))


@dataclass(frozen=True)
class Derived:
    """A metric computed from other metrics' aliases: `formula` is arithmetic in text, or a function of Columns."""

    formula: str | Callable
    named: str
    needs: tuple[str, ...] = ()

    def depends_on(self, *aliases: str):
        return replace(self, needs=aliases)


def Computed(formula: str, alias: str) -> Derived:  # noqa: N802
    return Derived(formula, alias)


def Calculated(formula: Callable, alias: str, needs=()) -> Derived:  # noqa: N802
    return Derived(formula, alias, tuple(needs))


class Named:
    """Read-only operations over named things, in order: a table's dimensions or relations."""

    def __init__(self, items):
        self._items = {i.name: i for i in items}

    def get(self, name: str):
        return self._items.get(name)

    def has(self, name: str) -> bool:
        return name in self._items

    def all(self) -> dict:
        return dict(self._items)

    def names(self) -> tuple[str, ...]:
        return tuple(self._items)

    def of_type(self, kind: str) -> Named:
        """Those of a kind: "time" and the like, or "belongs_to" and the like."""
        return type(self)(i for i in self._items.values() if i.kind == kind)

    def for_each(self, run: Callable) -> None:
        for name, item in self._items.items():
            run(name, item)

    def add(self, item) -> Named:
        return self.merge(type(self)([item]))

    def merge(self, other: Named) -> Named:
        """Both; of two with one name, the other's."""
        return type(self)((self._items | other._items).values())

    def count(self) -> int:
        return len(self._items)

    __len__ = count

    def __iter__(self):
        return iter(self._items.values())

    def is_empty(self) -> bool:
        return not self._items


@dataclass(frozen=True)
class Table:
    """`dimensions` and `relations` may be functions without arguments, which are called when first asked for."""

    name: str
    load: Callable = field(compare=False)
    provider: str = ""
    connection: str | None = None
    primary_key: PrimaryKey | None = None
    relations: tuple[Relation, ...] | Callable = ()
    dimensions: tuple[Dim, ...] | Callable = ()
    sql: str | None = None
    meta: tuple[tuple[str, Any], ...] = ()

    @property
    def identifier(self) -> str:
        return f"{self.provider}:{self.connection or 'null'}:{self.name}"

    def catalog(self) -> Named:
        return Named(self.dimensions() if callable(self.dimensions) else self.dimensions)

    def graph(self) -> Named:
        return Named(self.relations() if callable(self.relations) else self.relations)

    def relation(self, name: str) -> Relation | None:
        return self.graph().get(name)

    def dimension(self, name: str) -> Dim | None:
        return self.catalog().get(name)

    def about(self, name: str, default=None):
        """A note of the table's, from `meta`."""
        return dict(self.meta).get(name, default)
