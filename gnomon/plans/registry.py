"""Registered providers and the compiled index over their tables: names, identifiers, edges in both directions."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from pyspark.sql import SparkSession

from gnomon.errors import AmbiguousTable, BadReference, MetricsError, UnknownColumn, UnknownTable
from gnomon.model import Named, Relation, Table


@dataclass(frozen=True)
class Edge:
    """A step from one table to another. `many`: one row may meet several."""

    source: str  # identifiers
    target: str
    left: str
    right: str
    many: bool
    name: str
    bridge: tuple[str, str, str] | None = None  # table name, column of the source, column of the target
    type_is: tuple[str, str, str] | None = None  # "source" or "target", column, value


@dataclass(frozen=True)
class Source:
    """A column of a table."""

    table: Table
    column: str

    @property
    def key(self) -> str:
        return f"{self.table.identifier}.{self.column}"


class Compiled:
    """Immutable index; a name that several providers have is ambiguous however many they are."""

    def __init__(self, tables: list[Table], resolve):
        self.by_id = {t.identifier: t for t in tables}
        self.by_name: dict[str, list[Table]] = {}
        self.by_connection: dict[str, list[Table]] = {}
        self.edges: dict[str, list[Edge]] = {i: [] for i in self.by_id}
        for t in tables:
            self.by_name.setdefault(t.name, []).append(t)
            self.by_connection.setdefault(f"{t.provider}:{t.connection or 'null'}", []).append(t)
        for t in tables:
            for r in t.graph():
                self._tie(t, r, resolve(r.target, t.provider))

    def _tie(self, t: Table, r: Relation, other: Table) -> None:
        back = r.bridge and (r.bridge[0], r.bridge[2], r.bridge[1])
        # The column that names the owner's kind is on the side that holds the reference.
        there = r.type_is and (("source" if r.kind == "morph_to" else "target"), *r.type_is)
        home = r.type_is and (("target" if r.kind == "morph_to" else "source"), *r.type_is)
        many = r.kind in ("has_many", "many_to_many", "morph_many")
        back_many = r.kind in ("belongs_to", "many_to_many", "morph_to")
        self.edges[t.identifier].append(Edge(t.identifier, other.identifier, r.local, r.remote, many, r.name, r.bridge, there))
        self.edges[other.identifier].append(Edge(other.identifier, t.identifier, r.remote, r.local, back_many, f"~{r.name}", back, home))

    def relations(self, table: Table) -> Named:
        return self._own(table).graph()

    def dimensions(self, table: Table) -> Named:
        return self._own(table).catalog()

    def _own(self, table: Table) -> Table:
        if table.identifier not in self.by_id:
            raise UnknownTable(table.name)
        return table

    def connections(self) -> tuple[str, ...]:
        return tuple(self.by_connection)


class Registry:
    """ttl: seconds after which the providers are asked again whether their tables have changed; None: only when
    `refresh` is called."""

    def __init__(self, spark: SparkSession, ttl: float | None = None):
        self.spark, self._providers, self._compiled, self._stamp, self.version = spark, {}, None, None, 0
        self.ttl, self._seen = ttl, 0.0

    def register(self, provider) -> None:
        """A provider of the same name is replaced."""
        provider.boot(self.spark)
        self._providers[provider.name] = provider
        self.clear()

    def clear(self) -> None:
        self._compiled, self.version = None, self.version + 1

    def refresh(self) -> bool:
        """Drop the compiled schema if a provider's tables have changed."""
        changed = self.stale()
        if changed:
            for p in self._providers.values():
                p.boot(self.spark)
            self.clear()
        return changed

    def providers(self) -> tuple[str, ...]:
        return tuple(self._providers)

    def provider(self, name: str):
        return self._providers[name]

    @property
    def schema(self) -> Compiled:
        if self._compiled is not None and self.ttl is not None and time.monotonic() - self._seen >= self.ttl:
            self._seen = time.monotonic()
            self.refresh()
        if self._compiled is None:
            tables = [t for p in self._providers.values() for t in p.tables()]
            named: dict[str, list[Table]] = {}
            for t in tables:
                named.setdefault(t.name, []).append(t)

            def target(name: str, home: str) -> Table:
                own = [t for t in named.get(name, []) if t.provider == home] or named.get(name, [])
                if len(own) != 1:
                    raise UnknownTable(name, self.providers()) if not own else AmbiguousTable(name, [t.provider for t in own])
                return own[0]

            self._compiled = Compiled(tables, target)
            self._seen = time.monotonic()
            if self.ttl is not None:
                self._stamp = self._prints()
        return self._compiled

    def _prints(self) -> dict:
        return {n: p.fingerprint() for n, p in self._providers.items()}

    def stale(self) -> bool:
        """Whether tables have changed since the schema was compiled or, without a ttl, since this was last asked."""
        if self._compiled is None:
            return False
        now = self._prints()
        was, self._stamp = self._stamp, now
        return was != now

    def table(self, name: str) -> Table:
        """By identifier (provider:connection:name), provider:name, or bare name."""
        schema = self.schema
        if name in schema.by_id:
            return schema.by_id[name]
        provider, _, bare = name.rpartition(":")
        if provider and provider not in self._providers:
            raise BadReference(f"{provider!r} is no provider; there are {', '.join(self._providers) or 'none'}")
        found = [t for t in schema.by_name.get(bare, []) if not provider or t.provider == provider]
        if not found:
            raise UnknownTable(name, self.providers())
        if len(found) > 1:
            raise AmbiguousTable(bare, [t.provider for t in found])
        return found[0]

    def can_resolve(self, name: str) -> bool:
        try:
            self.table(name)
        except MetricsError:
            return False
        return True

    def all_tables(self) -> dict[str, Table]:
        """By bare name where that is unique, else by provider:name."""
        return {(n if len(ts) == 1 else f"{t.provider}:{n}"): t for n, ts in self.schema.by_name.items() for t in ts}

    def source(self, ref: str) -> Source:
        """table.column, provider:table.column or table::column; the column may hold dots."""
        head, sep, column = ref.partition("::") if "::" in ref else ref.partition(".")
        if not sep or not head or not column:
            raise BadReference(f"{ref!r} is not table.column")
        table = self.table(head)
        if column not in table.load(self.spark).columns:
            raise UnknownColumn(f"{table.name} has no column {column!r}")
        return Source(table, column)

    def tables_of(self, provider: str) -> tuple[str, ...]:
        """Names of a provider's tables."""
        return tuple(t.name for t in self.schema.by_id.values() if t.provider == provider)

    def provides(self, name: str) -> tuple[str, ...]:
        """Names of the providers that have a table of this name."""
        return tuple(t.provider for t in self.schema.by_name.get(name, ()))

    def tables_on(self, connection: str) -> tuple[Table, ...]:
        return tuple(self.schema.by_connection.get(connection, ()))

    def connections_of(self, sources) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f"{s.table.provider}:{s.table.connection or 'null'}" for s in sources))

    def dump(self) -> str:
        """The schema as JSON."""
        out = {}
        for name, t in self.all_tables().items():
            out[name] = {
                "identifier": t.identifier, "primary_key": list(t.primary_key.columns) if t.primary_key else None,
                "columns": json.loads(t.load(self.spark).schema.json())["fields"],
                "dimensions": {d.name: d.kind for d in t.catalog()},
                "relations": {r.name: {"kind": r.kind, "target": r.target, "keys": [r.local, r.remote], "bridge": r.bridge} for r in t.graph()},
            }
        return json.dumps(out, indent=1, sort_keys=True)
