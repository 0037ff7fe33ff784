"""Where tables come from. A provider has a name and gives tables; frames are loaded lazily and once a session."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from gnomon.functions.dimensions import Mappers
from gnomon.model import Named, PrimaryKey, Relation, Table
from gnomon.sources.cache import SHARED, SchemaCache


class Provider(Protocol):
    name: str

    def boot(self, spark: SparkSession) -> None: ...

    def tables(self) -> Iterable[Table]: ...

    def fingerprint(self) -> object:
        """Changes when the tables may have changed; `Registry.refresh` then drops what it compiled."""


class Lookups:
    """What may be asked of a provider's tables. Names that it doesn't have give nothing."""

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables() if t.name == name), None)

    def provides(self, name: str) -> bool:
        return self.table(name) is not None

    def relations(self, name: str) -> Named:
        t = self.table(name)
        return t.graph() if t else Named([])

    def dimensions(self, name: str) -> Named:
        t = self.table(name)
        return t.catalog() if t else Named([])


class ManualProvider(Lookups):
    """Tables declared by hand."""

    def __init__(self, name: str, tables: Iterable[Table], connection: str | None = None):
        self.name, self._tables = name, tuple(replace(t, provider=name, connection=t.connection or connection) for t in tables)

    def boot(self, spark: SparkSession) -> None:
        pass

    def tables(self) -> tuple[Table, ...]:
        return self._tables

    def fingerprint(self) -> object:
        return self._tables


def frame_table(name: str, load: Callable[[SparkSession], DataFrame] | DataFrame, **more) -> Table:
    return Table(name, load if not isinstance(load, DataFrame) else (lambda _, f=load: f), **more)


def sql_table(name: str, text: str, **more) -> Table:
    """A table that is a query over the session's catalog; Catalyst inlines it."""
    return Table(name, lambda spark: spark.sql(text), sql=text, **more)


def catalog_table(name: str, source: str | None = None, **more) -> Table:
    return Table(name, lambda spark: spark.table(source or name), **more)


def source_table(name: str, source, path: str | None = None, options: dict | None = None, **more) -> Table:
    """A table of any Spark data source: the name of its format, or a Python `DataSource` class (an HTTP service, a
    queue, a database without a JDBC driver), which is registered with the session."""

    def load(spark: SparkSession) -> DataFrame:
        kind = source
        if not isinstance(source, str):
            spark.dataSource.register(source)
            kind = source.name()
        reader = spark.read.format(kind).options(**(options or {}))
        return reader.load(path) if path else reader.load()

    return Table(name, load, **more)


def jdbc_table(name: str, url: str, dbtable: str | None = None, options: dict | None = None, **more) -> Table:
    """A table of an SQL database; `options` as Spark's JDBC reader takes them (partitionColumn and bounds to read in parallel)."""
    return source_table(name, "jdbc", None, {"url": url, "dbtable": dbtable or name, **(options or {})}, connection=more.pop("connection", url), **more)


class FilesProvider(Lookups):
    """Every *.parquet (or other format) below a folder, at any depth, is a table; dimensions are inferred from column
    types. A table is opened when a query first asks for it, with its schema from the cache if its files are as they were.

    A folder that isn't there gives no tables. Of two of one name the one nearer the folder counts. Relations and keys
    are declared by table; with `infer`, a table also belongs to every table whose single key column has the same
    ending: o_custkey to c_custkey. Declared relations come first."""

    def __init__(self, name: str, path: str, tables: Iterable[str] | None = None, relations: dict[str, Iterable[Relation]] | None = None,
                 keys: dict[str, Iterable[str]] | None = None, format: str = "parquet", mappers: Mappers | None = None,
                 infer: bool = False, cache: SchemaCache = SHARED, options: dict | None = None):
        self.name, self.path, self.format, self.options = name, path, format, options or {}
        self._names, self._relations, self._keys = tables, relations or {}, keys or {}
        self._mappers, self._infer, self._cache = mappers or Mappers(), infer, cache
        self._spark: SparkSession | None = None
        self._made: tuple[Table, ...] | None = None

    def boot(self, spark: SparkSession) -> None:
        self._spark, self._made = spark, None

    def _fs(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._spark._jsc.hadoopConfiguration()), at

    def _found(self) -> dict[str, str]:
        """Paths of tables by name."""
        if self._names is not None:
            return {n: f"{self.path}/{n}.{self.format}" for n in self._names}
        out: dict[str, str] = {}
        level = [self.path]
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return out
        while level:
            deeper = []
            for folder in level:
                for s in sorted(fs.listStatus(self._fs(folder)[1]), key=lambda s: s.getPath().getName()):
                    base = s.getPath().getName()
                    if base.endswith(f".{self.format}"):
                        out.setdefault(base[: -len(self.format) - 1], f"{folder}/{base}")
                    elif s.isDirectory() and not base.startswith(("_", ".")):
                        deeper.append(f"{folder}/{base}")
            level = deeper
        return dict(sorted(out.items()))

    def _stamp(self, path: str) -> str:
        """Names, times and sizes of a table's files."""
        fs, at = self._fs(path)
        if not fs.exists(at):
            return ""
        own = fs.getFileStatus(at)
        files = fs.listStatus(at) if own.isDirectory() else [own]
        return json.dumps(sorted((s.getPath().getName(), s.getModificationTime(), s.getLen()) for s in files))

    def _table(self, name: str, path: str) -> Table:
        @functools.cache
        def opened() -> DataFrame:
            reader = self._spark.read.format(self.format).options(**self.options)
            key, stamp = f"{self.format}:{path}:{json.dumps(self.options, sort_keys=True)}", self._stamp(path)
            known = self._cache.get(key, stamp)
            if known is not None:
                return reader.schema(StructType.fromJson(known)).load(path)
            df = reader.load(path)
            self._cache.put(key, df.schema.jsonValue(), stamp)
            return df

        key = self._keys.get(name)
        declared = tuple(self._relations.get(name, ()))
        relations = functools.cache(lambda: declared + self._inferred(name, declared)) if self._infer else declared
        dims = functools.cache(lambda: self._mappers.infer(opened().schema))
        return Table(name, lambda _: opened(), self.name, None, PrimaryKey(tuple(key)) if key else None, relations, dims)

    def _inferred(self, name: str, declared: tuple[Relation, ...]) -> tuple[Relation, ...]:
        ends = {t.primary_key.column.split("_", 1)[-1]: t for t in self.tables() if t.primary_key and t.primary_key.column and "_" in t.primary_key.column}
        out, own = [], self.table(name)
        for c in own.load(self._spark).columns:
            goal = ends.get(c.split("_", 1)[-1]) if "_" in c else None
            if goal and goal.name != name and not any(r.local == c for r in declared):
                out.append(Relation(goal.name, "belongs_to", goal.name, c, goal.primary_key.column))
        return tuple(out)

    def tables(self) -> tuple[Table, ...]:
        if self._made is None:
            self._made = tuple(self._table(n, p) for n, p in self._found().items())
        return self._made

    def fingerprint(self) -> object:
        """Paths, times and sizes of all files."""
        return tuple((n, self._stamp(p)) for n, p in self._found().items())
