"""Engine and the immutable query builder."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.errors import FanOut, MetricsError, NoJoinPath
from gnomon.functions.aggregates import REAGGREGATE, Aggregates
from gnomon.functions.dimensions import bucket
from gnomon.model import COARSER, Table, TimeDim
from gnomon.operators.predicates import compare, every, spec
from gnomon.plans import lower
from gnomon.plans.planner import Branch, Plan, plan
from gnomon.plans.registry import Registry, Source


@dataclass(frozen=True)
class Rollup:
    """A materialised query: Parquet at `path`, one row for each group."""

    path: str
    query: Query
    root: str
    measures: tuple[tuple[str, str, str], ...]  # function, source key, column
    dims: tuple[tuple[str, str | None, str], ...]  # source key, granularity, column
    ways: dict[str, tuple]  # edges from the fact table to each table that a dimension is of


class Engine:
    """Tables, aggregates, metrics and segments of one session.

    single_connection: refuse metrics of several connections. schema_ttl: seconds after which providers are asked whether
    their tables have changed. result_dir, result_ttl: where results that queries ask to keep go, and for how many seconds
    they hold. timing: a function of (what, seconds), called after planning and lowering; debug: print plans."""

    def __init__(self, spark: SparkSession, *providers, single_connection: bool = False, schema_ttl: float | None = None, result_dir: str | None = None,
                 result_ttl: float = 300.0, timing: Callable[[str, float], None] | None = None, debug: bool = False):
        self.spark, self.registry, self.aggregates = spark, Registry(spark, schema_ttl), Aggregates()
        self.single_connection, self.timing, self.debug = single_connection, timing, debug
        self.results = Results(spark, result_dir, result_ttl)
        self.metrics: dict[str, object] = {}
        self.segments: dict[str, dict] = {}
        self.rollups: list[Rollup] = []
        for p in providers:
            self.register(p)

    def timed(self, what: str, run):
        began = time.perf_counter()
        out = run()
        if self.timing:
            self.timing(what, time.perf_counter() - began)
        return out

    def register(self, provider) -> Engine:
        self.registry.register(provider)
        return self

    def define(self, name: str, metric) -> Engine:
        """A metric that queries may ask for by name."""
        self.metrics[name] = metric
        return self

    def segment(self, name: str, where: dict) -> Engine:
        self.segments[name] = where
        return self

    def query(self) -> Query:
        return Query(self)

    def view(self, name: str, root: str, *tables: str) -> DataFrame:
        """A pre-joined model: root left-joined to tables that are to-one from it; also a temporary view `name`."""
        from gnomon.plans.planner import path

        start = self.registry.table(root).identifier
        df, met = lower.frame(self.registry, start), [start]
        for t in tables:
            way = path(self.registry, start, self.registry.table(t).identifier, to_one=True)
            if way is None:
                raise NoJoinPath(f"{t} is not to-one from {root}")
            for e in way:
                if e.target not in met:
                    df, met = lower._step(self.registry, df, e, "left"), [*met, e.target]
        names = [(i, c) for i in met for c in self.registry.schema.by_id[i].load(self.spark).columns]
        plain = [c for _, c in names]
        df = df.select(*[F.col(f"`{i}.{c}`").alias(c if plain.count(c) == 1 else f"{self.registry.schema.by_id[i].name}_{c}") for i, c in names])
        df.createOrReplaceTempView(name)
        return df

    def roll_up(self, query: Query, path: str) -> Rollup:
        """Write a query's result; later queries that it can answer read it instead. See `refresh`."""
        p = query.plan()
        b = p.branches[0]
        if len(p.branches) > 1 or p.base or b.filters or b.semi or p.derived or query._page or any(m.measure.func not in REAGGREGATE or m.measure.conditions for m in b.measures):
            raise MetricsError("a roll-up has one fact table, no filters, and aggregates that can be taken again")
        if any(e.many for e in b.joins):
            raise FanOut("a roll-up over a to-many relation would count rows of the fact table several times")
        query.frame().write.mode("overwrite").parquet(path)
        dims = tuple((d.source.key, d.dim.granularity if isinstance(d.dim, TimeDim) else None, d.alias) for d in b.dims)
        ways = {d.source.key: way(b, d.source.table.identifier) for d in b.dims}
        made = Rollup(path, query, b.root, tuple((m.measure.func, m.source.key, m.alias) for m in b.measures), dims, ways)
        self.rollups.append(made)
        return made

    def refresh(self, rollup: Rollup) -> None:
        """Write a roll-up anew from the tables as they are now. Queries made before must not be running."""
        self.registry.refresh()
        replace(rollup.query, _raw=True).frame().write.mode("overwrite").parquet(rollup.path)
        self.spark.catalog.refreshByPath(rollup.path)

    def _substitute(self, p: Plan) -> DataFrame | None:
        """The plan's result from a roll-up with its measures, and with its dimensions and filtered columns reached over
        the same relations, no coarser than asked for."""
        b = p.branches[0]
        if len(p.branches) > 1 or p.base or b.semi or any(e.many for e in b.joins):
            return None
        for r in self.rollups:
            held = {(f, k): c for f, k, c in r.measures}
            dims = {k: (g, c) for k, g, c in r.dims}
            same = lambda s, r=r: r.ways.get(s.key) == way(b, s.table.identifier)
            if r.root != b.root or any((m.measure.func, m.source.key) not in held or m.measure.conditions for m in b.measures):
                continue
            fits = lambda d, dims=dims, same=same: d.source.key in dims and same(d.source) and (
                d.dim.granularity == dims[d.source.key][0] or d.dim.granularity in COARSER.get(dims[d.source.key][0], ()) if isinstance(d.dim, TimeDim) else dims[d.source.key][0] is None
            )
            if not all(fits(d) for d in b.dims) or any(s.key not in dims or dims[s.key][0] or not same(s) for s, _, _ in b.filters):
                continue
            df = self.spark.read.parquet(r.path)
            if b.filters:
                df = df.where(every([compare(F.col(f"`{dims[s.key][1]}`"), op, v) for s, op, v in b.filters]))
            keys = [bucket(d.dim, F.col(f"`{dims[d.source.key][1]}`")).alias(d.alias) for d in b.dims]
            outputs = []
            for m in b.measures:
                again = self.aggregates.compile(REAGGREGATE[m.measure.func], F.col(f"`{held[m.measure.func, m.source.key]}`"))
                outputs.append((F.coalesce(again, F.lit(0)) if m.measure.func == "count" else again).alias(m.alias))
            return df.groupBy(*keys).agg(*outputs) if keys else df.agg(*outputs)
        return None


def way(b: Branch, table: str) -> tuple:
    """Edges over which a branch reaches a table."""
    out = []
    while table != b.root:
        edge = next(e for e in b.joins if e.target == table)
        out.append(edge)
        table = edge.source
    return tuple(reversed(out))


class Results:
    """Results that queries asked to keep, as Parquet, each for a time. One that has run out may be given once more
    while `stale` is true, and is written anew then."""

    def __init__(self, spark: SparkSession, folder: str | None, ttl: float):
        self.spark, self.folder, self.ttl, self._held = spark, folder, ttl, {}

    def get(self, key: str, make: Callable[[], DataFrame], ttl: float | None, stale: bool) -> DataFrame:
        ttl = self.ttl if ttl is None else ttl
        held, now = self._held.get(key), time.monotonic()
        if held and now - held[0] < ttl:
            return self.spark.read.parquet(held[1])
        folder = self.folder or self.spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise MetricsError("kept results need result_dir or spark.checkpoint.dir")
        path = f"{folder.rstrip('/')}/gnomon-result-{uuid.uuid4().hex}"
        make().write.parquet(path)
        self._held[key] = (now, path)
        return self.spark.read.parquet(held[1] if held and stale else path)

    def forget(self, key: str) -> None:
        self._held.pop(key, None)

    def flush(self) -> None:
        self._held.clear()

    def size(self) -> int:
        return len(self._held)


@dataclass(frozen=True)
class Query:
    engine: Engine
    _metrics: tuple = ()
    _dims: tuple = ()
    _where: tuple = ()
    _fanout: str | None = None
    _prefer: tuple[str, ...] = ()
    _page: tuple[int, int] | None = None
    _base: str | None = None
    _keep: tuple[float | None, bool] | None = None
    _raw: bool = False  # without roll-ups

    def metrics(self, *metrics) -> Query:
        """Metrics, or names of those that the engine has defined."""
        found = []
        for m in metrics:
            if isinstance(m, str):
                if m not in self.engine.metrics:
                    raise MetricsError(f"no metric {m!r}")
                m = self.engine.metrics[m]
            found.append(getattr(m, "value", m))  # members of an Enum of metrics will do
        return replace(self, _metrics=(*self._metrics, *found))

    def dimensions(self, *dims) -> Query:
        return replace(self, _dims=(*self._dims, *dims))

    def where(self, conditions: dict) -> Query:
        """{table.column: value or [operator, value]}; relation names may lead to the table: {root.relation.column: ...}."""
        return replace(self, _where=(*self._where, *((ref, *spec(v)) for ref, v in conditions.items())))

    def apply(self, *segments: str) -> Query:
        q = self
        for s in segments:
            if s not in self.engine.segments:
                raise MetricsError(f"no segment {s!r}")
            q = q.where(self.engine.segments[s])
        return q

    def fan_out(self, mode: str) -> Query:
        """"flat": join to-many tables as they are; "bridge": only over many-to-many relations, each pair once."""
        return replace(self, _fanout=mode)

    def prefer(self, *names: str) -> Query:
        """Relations or tables that join paths go over where they can."""
        return replace(self, _prefer=(*self._prefer, *names))

    def base(self, table: str) -> Query:
        """The table whose rows decide which groups there are: a group that no row of it has is left out, one that no
        row of a metric's table has is there with nulls, and with 0 for counts. Every metric's table must be joined to it."""
        return replace(self, _base=table)

    def keep(self, ttl: float | None = None, stale: bool = False) -> Query:
        """Keep the result for `ttl` seconds (the engine's, if none are given); queries alike read it meanwhile. With
        `stale`, the query that finds it too old still gets the old one while it writes a new one for the next."""
        return replace(self, _keep=(ttl, stale))

    def page(self, size: int, number: int = 1) -> Query:
        """Rows in the order of the dimensions; pages count from 1."""
        return replace(self, _page=(size, number))

    def _source(self, ref: str) -> Source:
        registry, parts = self.engine.registry, ref.split(".")
        if len(parts) > 2 and registry.can_resolve(parts[0]):
            table: Table = registry.table(parts[0])
            for name in parts[1:-1]:
                relation = table.relation(name)
                if relation is None:
                    return registry.source(ref)
                table = registry.table(relation.target)
            return Source(table, parts[-1])
        return registry.source(ref)

    def plan(self) -> Plan:
        where = [(self._source(ref), op, v) for ref, op, v in self._where]
        e = self.engine
        made = e.timed("plan", lambda: plan(e.registry, self._metrics, self._dims, where, self._fanout, self._prefer, e.single_connection, self._base))
        if e.debug:
            print(made.describe())
        return made

    def frame(self) -> DataFrame:
        if self._keep:
            plain = replace(self, _keep=None)
            return self.engine.results.get(repr((plain._metrics, plain._dims, plain._where, plain._fanout, plain._prefer, plain._page, plain._base)), plain.frame, *self._keep)
        p = self.plan()
        p.rollup = None if self._raw else self.engine._substitute(p)
        df = self.engine.timed("lower", lambda: lower.lower(self.engine.registry, self.engine.aggregates, p))
        if self._page:
            size, number = self._page
            df = df.orderBy(*[F.col(f"`{a}`") for a in p.aliases]).offset(size * (number - 1)).limit(size)
        return df

    get = frame

    def explain(self) -> str:
        return self.plan().describe()

    def format(self, kind: str, path: str | None = None):
        """rows as "json", "csv" or "parquet" files at `path`, as an "excel" file there (small results only; they pass
        through the driver), or a "pandas" frame."""
        df = self.frame()
        if kind == "pandas":
            return df.toPandas()
        if kind not in ("json", "csv", "parquet", "excel") or path is None:
            raise MetricsError("json, csv, parquet or excel with a path, or pandas")
        if kind == "excel":
            try:
                import openpyxl  # noqa: F401
            except ImportError as e:
                raise MetricsError("excel needs openpyxl") from e
            df.toPandas().to_excel(path, index=False)
            return path
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
        return path


__all__ = ["Engine", "Query", "Rollup"]
