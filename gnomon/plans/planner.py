"""From what was asked to branches, each of one fact table, so that no to-many step multiplies a measure's rows.

Conditions on one to-many table must hold together for one of its rows; conditions on two to-many tables each for some
row of theirs, even where one path leads over both. A base table decides which groups there are: those of its rows."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

from gnomon.errors import AmbiguousColumn, DuplicateAlias, FanOut, MetricsError, MixedConnections, NoJoinPath, UnknownColumn
from gnomon.model import Derived, Dim, Measure, TimeDim
from gnomon.operators import formula
from gnomon.plans.registry import Edge, Registry, Source


@dataclass(frozen=True)
class PlannedMeasure:
    measure: Measure
    source: Source
    alias: str


@dataclass(frozen=True)
class PlannedDim:
    dim: Dim  # as asked: its granularity counts, not the catalog's
    source: Source
    alias: str


@dataclass
class Branch:
    root: str
    measures: list[PlannedMeasure]
    dims: list[PlannedDim] = field(default_factory=list)
    joins: list[Edge] = field(default_factory=list)  # in order; every table once
    filters: list[tuple[Source, str, object]] = field(default_factory=list)
    semi: list[tuple[list[Edge], list[tuple[Source, str, object]]]] = field(default_factory=list)

    @property
    def tables(self) -> list[str]:
        return [self.root, *(e.target for e in self.joins)]


@dataclass
class Plan:
    branches: list[Branch]
    aliases: list[str]  # of groupings
    derived: list[Derived]
    outputs: list[str]
    base: str | None = None  # identifier of the table that decides which groups there are
    rollup: object = None

    @property
    def primary_table(self) -> str:
        return self.base or self.branches[0].root

    @property
    def tables(self) -> list[str]:
        return list(dict.fromkeys(t for b in self.branches for t in b.tables))

    @property
    def measures(self) -> list[PlannedMeasure]:
        return [m for b in self.branches for m in b.measures]

    def describe(self) -> str:
        out = []
        for b in self.branches:
            out.append(f"fact {b.root}: {', '.join(f'{m.measure.func}({m.source.key}) as {m.alias}' for m in b.measures)}")
            out += [f"  left join {e.target} on {e.left} = {e.right}" + " (to-many)" * e.many for e in b.joins]
            out += [f"  where {s.key} {op} {v!r}" for s, op, v in b.filters]
            out += [f"  having some {path[-1].target} with {', '.join(f'{s.column} {op} {v!r}' for s, op, v in fs)}" for path, fs in b.semi]
        return "\n".join(out + [f"group by {', '.join(self.aliases)}"] * bool(self.aliases) + [f"{d.named} = {d.formula}" for d in self.derived])


def path(registry: Registry, start: str, goal: str, to_one: bool = False, prefer: tuple[str, ...] = (), policy: bool = False) -> list[Edge] | None:
    """Shortest path; of equals, one over preferred relations or tables, then the one declared first. Edges are
    walked both ways. policy: only within a provider and connection."""
    if start == goal:
        return []
    schema, seen, queue = registry.schema, {start}, deque([(start, [])])
    liked = lambda e: e.name.lstrip("~") in prefer or schema.by_id[e.target].name in prefer
    home = lambda i: (schema.by_id[i].provider, schema.by_id[i].connection)
    while queue:
        at, way = queue.popleft()
        for e in sorted(schema.edges[at], key=lambda e: (not liked(e), e.name.startswith("~"))):
            if e.target in seen or to_one and e.many or policy and home(e.target) != home(start):
                continue
            if e.target == goal:
                return [*way, e]
            seen.add(e.target)
            queue.append((e.target, [*way, e]))
    return None


def _preferred(registry: Registry, start: str, goal: str, to_one: bool, prefer, policy) -> list[Edge] | None:
    """The shortest path through every preferred table that is on some to-one path, else the shortest."""
    for via in prefer:
        mid = next((i for i, t in registry.schema.by_id.items() if t.name == via and i not in (start, goal)), None)
        if mid:
            a, b = path(registry, start, mid, to_one, prefer, policy), path(registry, mid, goal, to_one, prefer, policy)
            if a and b:
                return a + b
    return path(registry, start, goal, to_one, prefer, policy)


def plan(registry: Registry, metrics, dims, where, fanout: str | None = None, prefer: tuple[str, ...] = (), single_connection: bool = False, base: str | None = None) -> Plan:
    asked = [m for m in metrics if isinstance(m, Measure)]
    derived = [m for m in metrics if isinstance(m, Derived)]
    if not asked:
        raise MetricsError("a query needs a metric")
    measures, taken = [], {}
    for m in asked:
        source = registry.source(m.ref)
        for c, _, _ in m.conditions:
            registry.source(f"{source.table.identifier}.{c}") if c in source.table.load(registry.spark).columns else _unknown(source, c)
        alias = m.named or f"{m.func}_{source.table.name}_{source.column}".lower()
        same = (m.func, source.key, m.conditions)
        if alias in taken:
            if taken[alias] == same:
                continue
            raise DuplicateAlias(f"two metrics are called {alias!r}")
        taken[alias] = same
        measures.append(PlannedMeasure(m, source, alias))
    if single_connection and len(registry.connections_of([m.source for m in measures])) > 1:
        raise MixedConnections(f"tables of different connections: {', '.join(registry.connections_of([m.source for m in measures]))}")
    groups: dict[str, list[PlannedMeasure]] = {}
    for m in measures:
        groups.setdefault(m.source.table.identifier, []).append(m)
    if base is not None:
        base = registry.table(base).identifier
        for root in groups:
            if root != base and path(registry, root, base, False, prefer, single_connection) is None:
                raise NoJoinPath(f"no path from {root} to the base table {base}")
        groups = {base: groups.get(base, []), **{r: g for r, g in groups.items() if r != base}}
    names = _names(dims)
    if clash := set(names) & set(taken):
        raise DuplicateAlias(f"a metric and a dimension are called {sorted(clash)[0]!r}")
    branches = []
    for root, own in groups.items():
        b = Branch(root, own)
        to_one = lambda goal, root=root: _preferred(registry, root, goal, True, prefer, single_connection)
        for d, name in zip(dims, names, strict=True):
            source = _place(registry, root, d, to_one)
            _reach(registry, b, source, to_one, fanout, prefer)
            if isinstance(d, TimeDim):
                d = _precise(registry, source, d).checked()
            b.dims.append(PlannedDim(d, source, name))
            for op, value in d.conditions:
                b.filters.append((source, op, value))
        far: dict[str, list] = {}
        for source, op, value in where:
            goal = source.table.identifier
            if goal in b.tables or to_one(goal) is not None:
                _reach(registry, b, source, to_one, fanout, prefer)
                b.filters.append((source, op, value))
            else:
                far.setdefault(goal, []).append((source, op, value))
        for goal, fs in far.items():
            way = path(registry, root, goal, False, prefer, single_connection)
            if way is None:
                raise NoJoinPath(f"no path from {root} to {goal}")
            b.semi.append((way, fs))
        branches.append(b)
    known = {m.alias for m in measures}
    for d in derived:
        needs = d.needs or (formula.names(d.formula) if isinstance(d.formula, str) else ())
        if missing := [n for n in needs if n not in known]:
            raise UnknownColumn(f"{d.named} needs metrics {', '.join(missing)}")
        if d.named in known or d.named in names:
            raise DuplicateAlias(f"two metrics are called {d.named!r}")
        known.add(d.named)
    outputs = [*names, *(m.alias for m in measures), *(d.named for d in derived)]
    return Plan(branches, names, derived, outputs, base)


def _unknown(source: Source, column: str):
    raise UnknownColumn(f"{source.table.name} has no column {column!r}")


def _names(dims) -> list[str]:
    """Output names: the alias or name; a time column asked for twice gets its granularity, other clashes the table."""
    base = [d.name for d in dims]
    out = []
    for d, name in zip(dims, base, strict=True):
        if base.count(name) > 1 and not d.named:
            twice = [o for o in dims if o.name == name and o.ref == d.ref]
            if isinstance(d, TimeDim) and len(twice) > 1:
                name = f"{name}_{d.granularity}"
            elif "." in d.ref:
                name = d.ref.replace(":", "_").replace(".", "_")
        out.append(name)
    if len(set(out)) < len(out):
        raise DuplicateAlias(f"dimensions share a name: {', '.join(out)}")
    return out


def _precise(registry: Registry, source: Source, d: TimeDim) -> TimeDim:
    kind = dict(source.table.load(registry.spark).dtypes)[source.column]
    return replace(d, precision="date") if kind == "date" else d


def _place(registry: Registry, root: str, d: Dim, to_one) -> Source:
    """A qualified dimension is where it says; a bare one is on the branch's own table, by its catalog or columns, else
    on the one nearest table that has it."""
    if "." in d.ref or "::" in d.ref:
        return registry.source(d.ref)
    table = registry.schema.by_id[root]
    declared = table.dimension(d.ref)
    if declared:
        return Source(table, declared.column)
    if d.ref in table.load(registry.spark).columns:
        return Source(table, d.ref)
    far: dict[int, list[Source]] = {}
    for i, t in registry.schema.by_id.items():
        way = to_one(i) if i != root else None
        if way:
            declared = t.dimension(d.ref)
            own = declared.column if declared else d.ref if d.ref in t.load(registry.spark).columns else None
            if own:
                far.setdefault(len(way), []).append(Source(t, own))
    if not far:
        raise UnknownColumn(f"no dimension {d.ref!r} within reach of {table.name}")
    near = far[min(far)]
    if len(near) > 1:
        raise AmbiguousColumn(f"{d.ref!r} is in {', '.join(s.table.name for s in near)}")
    return near[0]


def _reach(registry: Registry, b: Branch, source: Source, to_one, fanout: str | None, prefer) -> None:
    goal = source.table.identifier
    if goal in b.tables:
        return
    way = to_one(goal)
    if way is None:
        way = path(registry, b.root, goal, False, prefer)
        if way is None:
            raise NoJoinPath(f"no path from {b.root} to {goal}")
        if fanout not in ("flat", "bridge") or fanout == "bridge" and any(e.many and not e.bridge for e in way):
            raise FanOut(f"{goal} is to-many from {b.root}; rows of {b.root} would count several times")
    for e in way:
        if e.target not in b.tables:
            b.joins.append(e)
