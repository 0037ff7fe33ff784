"""Planner, registry, errors and edge cases on inline rows."""

import json
from decimal import Decimal
from enum import Enum

import pytest

from gnomon import Avg, Computed, Count, Dim, Engine, EnumDim, PrimaryKey, Relation, StringDim, Sum, TimeDim
from gnomon import errors as X
from gnomon.functions.dimensions import Mappers
from gnomon.model import BoolDim, Named
from gnomon.plans.planner import path
from gnomon.sources.cache import SchemaCache
from gnomon.sources.providers import FilesProvider, ManualProvider, frame_table, source_table


@pytest.fixture(scope="module")
def shop(spark):
    d = lambda x: None if x is None else Decimal(x)
    orders = spark.createDataFrame(
        [(1, 1, "new", d(100), True), (2, 1, "done", d(200), False), (3, None, None, d(150), None), (4, 9, "new", None, True)],
        "id long, customer_id long, status string, total decimal(12,2), paid boolean",
    )
    items = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 2, 5), (4, 8, 7)], "id long, order_id long, quantity int")
    customers = spark.createDataFrame([(1, "vip"), (2, "general")], "id long, segment string")
    spend = spark.sql("SELECT date'2024-01-01' AS date, 'web' AS channel, 5 AS clicks, 0 AS conversions")
    tables = [
        frame_table("orders", orders, primary_key=PrimaryKey(("id",)), relations=(Relation("customer", "belongs_to", "customers", "customer_id", "id"), Relation("items", "has_many", "items", "id", "order_id"))),
        frame_table("items", items, relations=(Relation("order", "belongs_to", "orders", "order_id", "id"),)),
        frame_table("customers", customers),
        frame_table("spend", spend),
    ]
    return Engine(spark, ManualProvider("shop", tables))


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_goldens(spark):
    for values, metric, want in (((100, 200, 150), Sum, 450.0), ((100, 200, 300), Avg, 200.0), ((7, 8, 9), Count, 3)):
        df = spark.createDataFrame([(Decimal(v),) for v in values], "total decimal(12,2)")
        e = Engine(spark, ManualProvider("p", [frame_table("orders", df)]))
        assert float(e.query().metrics(metric("orders.total")).frame().first()[0]) == want


def test_nulls_and_orphans(shop):
    q = shop.query().metrics(Sum("orders.total"), Count("orders.total").alias("n")).dimensions(Dim("customers.segment"))
    assert q.frame().columns == ["segment", "sum_orders_total", "n"]
    assert {r["segment"]: (r[1], r["n"]) for r in q.frame().collect()} == {"vip": (300, 2), None: (150, 1)}
    total = shop.query().metrics(Sum("orders.total").alias("t")).frame().first()["t"]
    assert sum(r[1] for r in q.frame().collect()) == total
    none = shop.query().metrics(Sum("orders.total").alias("s"), Count("orders.total").alias("n")).where({"orders.status": "absent"}).frame().first()
    assert (none["s"], none["n"]) == (None, 0)
    assert shop.query().metrics(Count("orders.id").alias("n")).dimensions(Dim("orders.status").only([])).frame().count() == 0
    assert {r["status"] for r in shop.query().metrics(Count("orders.id").alias("n")).dimensions(Dim("orders.status").except_(["new"])).frame().collect()} == {"done"}
    assert {r["paid"]: r["n"] for r in shop.query().metrics(Count("orders.id").alias("n")).dimensions(BoolDim("orders.paid")).frame().collect()} == {True: 2, False: 1, None: 1}


def test_grain(shop):
    both = shop.query().metrics(Sum("orders.total").alias("t"), Sum("items.quantity").alias("q")).dimensions(Dim("customers.segment"))
    assert {r["segment"]: (r["t"], r["q"]) for r in both.frame().collect()} == {"vip": (300, 10), None: (150, 7)}
    with pytest.raises(X.FanOut):
        shop.query().metrics(Sum("orders.total")).dimensions(Dim("items.quantity")).plan()
    flat = shop.query().metrics(Sum("orders.total").alias("t")).dimensions(Dim("items.quantity")).fan_out("flat").frame()
    assert sum(r["t"] or 0 for r in flat.collect()) == 550
    some = shop.query().metrics(Sum("orders.total").alias("t")).where({"items.quantity": [">", 1]}).frame().first()
    assert some["t"] == 300


def test_paths(shop):
    r = shop.registry
    ident = lambda n: r.table(n).identifier
    assert [e.name for e in path(r, ident("items"), ident("customers"))] == ["order", "customer"]
    assert path(r, ident("orders"), ident("orders")) == []
    assert path(r, ident("orders"), ident("spend")) is None
    assert [e.many for e in path(r, ident("customers"), ident("orders"))] == [True]
    plan = shop.query().metrics(Sum("items.quantity")).dimensions(Dim("customers.segment")).plan()
    assert plan.primary_table == ident("items") and plan.tables == [ident(n) for n in ("items", "orders", "customers")]
    assert "left join" in plan.describe()


def test_errors(shop):
    q = shop.query()
    for error, make in (
        (X.UnknownTable, lambda: q.metrics(Sum("nothing.x")).plan()),
        (X.UnknownColumn, lambda: q.metrics(Sum("orders.nothing")).plan()),
        (X.BadReference, lambda: q.metrics(Sum("orders")).plan()),
        (X.BadReference, lambda: q.metrics(Sum("other:orders.total")).plan()),
        (X.NoJoinPath, lambda: q.metrics(Sum("orders.total")).dimensions(Dim("spend.channel")).plan()),
        (X.NoJoinPath, lambda: q.metrics(Sum("orders.total")).where({"spend.channel": "web"}).plan()),
        (X.BadGranularity, lambda: TimeDim("spend.date").at("minute")),
        (X.BadGranularity, lambda: q.metrics(Sum("spend.clicks")).dimensions(TimeDim("spend.date").hourly()).plan()),
        (X.BadGranularity, lambda: q.metrics(Sum("spend.clicks")).dimensions(TimeDim("spend.date").min_granularity("month").daily()).plan()),
        (X.DuplicateAlias, lambda: q.metrics(Sum("orders.total").alias("x"), Count("orders.id").alias("x")).plan()),
        (X.UnknownColumn, lambda: q.metrics(Sum("orders.total").alias("x"), Computed("x / y", "z")).plan()),
        (X.UnknownAggregate, lambda: q.metrics(__import__("gnomon").Measure("median_of_sorts", "orders.total")).frame()),
        (X.MetricsError, lambda: q.metrics("undefined").plan()),
        (X.MetricsError, lambda: q.plan()),
        (X.MetricsError, lambda: q.metrics(Sum("orders.total").alias("x"), Computed("__import__('os')", "z").depends_on("x")).frame()),
    ):
        with pytest.raises(error):
            make()
    assert len(q.metrics(Sum("orders.total"), Sum("orders.total")).plan().measures) == 1


def test_ambiguity(spark, shop):
    df = spark.range(1)
    e = Engine(spark, *[ManualProvider(n, [frame_table("t", df)]) for n in "ab"])
    with pytest.raises(X.AmbiguousTable, match="a:t, b:t"):
        e.registry.table("t")
    e.register(ManualProvider("c", [frame_table("t", df)]))
    with pytest.raises(X.AmbiguousTable):
        e.registry.table("t")
    assert e.registry.table("b:t").provider == "b" and set(e.registry.all_tables()) == {"a:t", "b:t", "c:t"}
    e.register(ManualProvider("c", []))
    assert not e.registry.can_resolve("c:t") and e.registry.can_resolve("a:null:t")
    with pytest.raises(X.MixedConnections):
        Engine(spark, ManualProvider("a", [frame_table("t", df)]), ManualProvider("b", [frame_table("u", df)]), single_connection=True).query().metrics(Count("t.id"), Count("u.id")).plan()
    assert json.loads(shop.registry.dump())["orders"]["relations"]["items"]["kind"] == "has_many"


def test_ratio_by_zero_and_morph(spark, shop):
    q = shop.query().metrics(Sum("spend.clicks").alias("c"), Sum("spend.conversions").alias("v"), Computed("c / v", "r"), Computed("(c - v) * 2", "d"))
    assert tuple(q.frame().first()) == (5, 0, None, 10)
    notes = spark.createDataFrame([(1, 1, "post"), (2, 1, "page"), (3, 2, "post")], "id long, owner long, kind string")
    posts = spark.createDataFrame([(1, "a"), (2, "b")], "id long, title string")
    e = Engine(spark, ManualProvider("m", [frame_table("posts", posts, relations=(Relation("notes", "morph_many", "notes", "id", "owner", type_is=("kind", "post")),)), frame_table("notes", notes)]))
    got = e.query().metrics(Count("notes.id").alias("n")).dimensions(Dim("posts.title")).frame()
    assert {r["title"]: r["n"] for r in got.collect()} == {"a": 1, "b": 1, None: 1}


def test_types_files_and_values(spark, tmp_path):
    class State(Enum):
        on, off = "on", "off"

    schema = spark.sql("SELECT timestamp'2024-01-01' a, date'2024-01-01' b, true c, 'x' d, 1 e, array(1) f, timestamp_ntz'2024-01-01' g").schema
    found = Mappers().infer(schema)
    assert [(d.name, d.kind) for d in found] == [("a", "time"), ("b", "time"), ("c", "boolean"), ("d", "string"), ("g", "time")]
    assert Mappers().times(schema) == {"a": "timestamp", "b": "date", "g": "timestamp"}
    assert EnumDim("t.s", enum=State).cases == ("on", "off") and StringDim("t.s").with_values("a").add_value("b").values == ("a", "b")
    assert PrimaryKey(("a", "b")).column is None and not PrimaryKey(("a", "b")).auto_increment
    assert FilesProvider("none", f"{tmp_path}/absent").name == "none"
    e = Engine(spark, FilesProvider("none", f"{tmp_path}/absent"))
    assert e.registry.all_tables() == {}
    e.register(FilesProvider("sf", "/root/testdata/sf0.001"))
    assert "lineitem" in e.registry.all_tables()


def test_plan_pushes_down(spark):
    from gnomon import catalogue

    text = catalogue.queries()["join_filter_remote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,ASIA)" in text and "o_orderpriority" not in text


def test_rollups_refused_and_refreshed(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id long, k string, v double").write.parquet(f"{tmp_path}/db/facts.parquet")
    spark.createDataFrame([(1, 1), (2, 1)], "id long, fact long").write.parquet(f"{tmp_path}/db/parts.parquet")
    cache = SchemaCache()
    files = FilesProvider("db", f"{tmp_path}/db", relations={"parts": [Relation("fact", "belongs_to", "facts", "fact", "id")]}, cache=cache)
    seen = []
    e = Engine(spark, files, timing=lambda what, s: seen.append(what))
    total = e.query().metrics(Sum("facts.v").alias("t"))
    with pytest.raises(X.FanOut):
        e.roll_up(total.dimensions(Dim("parts.id")).fan_out("flat"), f"{tmp_path}/r0")
    assert "plan" in seen
    with pytest.raises(X.MetricsError):
        e.roll_up(total.where({"facts.k": "a"}), f"{tmp_path}/r1")
    r = e.roll_up(total.dimensions(Dim("facts.k")), f"{tmp_path}/r2")
    assert total.frame().first()["t"] == 5
    spark.createDataFrame([(3, "c", 10.0)], "id long, k string, v double").write.mode("append").parquet(f"{tmp_path}/db/facts.parquet")
    assert total.frame().first()["t"] == 5  # the roll-up as it was made
    e.refresh(r)
    assert total.frame().first()["t"] == 15


def test_schema_cache(spark, tmp_path):
    cache = SchemaCache(f"{tmp_path}/cache")
    cache.put("a", {"x": 1}, "s1")
    assert cache.get("a", "s1") == {"x": 1} and cache.get("a", "s2") is None and cache.size() == 1
    assert SchemaCache(f"{tmp_path}/cache").get("a", "s1") == {"x": 1}
    cache.disable()
    cache.put("b", 1)
    assert not cache.is_enabled() and cache.get("a", "s1") is None and not cache.has("b") and cache.size() == 0
    cache.enable()
    cache.forget("a")
    assert not SchemaCache(f"{tmp_path}/cache").has("a", "s1")
    cache.put("c", 1)
    cache.flush()
    assert cache.all() == {}

    spark.range(3).write.parquet(f"{tmp_path}/db/deep/one.parquet")
    spark.range(2).write.parquet(f"{tmp_path}/db/two.parquet")
    files = FilesProvider("db", f"{tmp_path}/db", cache=cache)
    e = Engine(spark, files, schema_ttl=0)
    assert e.query().metrics(Count("one.id").alias("n")).frame().first()["n"] == 3
    assert cache.size() == 1  # two.parquet has not been opened
    assert e.registry.refresh() is False and e.registry.tables_of("db") == ("one", "two") and e.registry.provides("one") == ("db",)
    spark.range(4).selectExpr("id", "id * 2 AS twice").write.mode("overwrite").parquet(f"{tmp_path}/db/deep/one.parquet")
    assert e.query().metrics(Sum("one.twice").alias("n")).frame().first()["n"] == 12  # a changed file is seen
    assert files.provides("two") and not files.provides("three") and files.relations("three").is_empty() and files.dimensions("two").is_empty()


def test_catalogs_and_domains(spark, shop):
    t = shop.registry.table("orders")
    g = t.graph()
    assert g.names() == ("customer", "items") and g.of_type("has_many").names() == ("items",) and g.count() == 2 and g.has("items") and not g.is_empty()
    seen = []
    g.for_each(lambda name, r: seen.append((name, r.kind)))
    assert seen == [("customer", "belongs_to"), ("items", "has_many")]
    c = Named([TimeDim("a"), BoolDim("b")])
    assert c.merge(Named([StringDim("a")])).get("a").kind == "string" and c.add(StringDim("z")).names() == ("a", "b", "z") and c.of_type("time").names() == ("a",)
    with pytest.raises(X.MetricsError, match="no case"):
        EnumDim("orders.status").with_cases(["new", "done"]).only(["lost"])
    n = Count("orders.id").alias("n")
    assert {r["status"]: r["n"] for r in shop.query().metrics(n).dimensions(EnumDim("orders.status").with_cases(["new"]).strict()).frame().collect()} == {"new": 2}
    assert shop.query().metrics(n).where({"orders.status": None}).frame().first()["n"] == 1
    assert shop.query().metrics(n).where({"orders.status": ["!=", None]}).frame().first()["n"] == 3
    with pytest.raises(X.MetricsError):
        shop.query().metrics(n).where({"orders.status": ["<", None]}).frame()


def test_base_table(shop):
    q = shop.query().metrics(Sum("orders.total").alias("t"), Count("orders.id").alias("n")).dimensions(Dim("customers.segment"))
    assert {r["segment"]: (r["t"], r["n"]) for r in q.base("customers").frame().collect()} == {"vip": (300, 2), "general": (None, 0)}
    assert q.base("customers").plan().primary_table.endswith("customers") and q.plan().primary_table.endswith("orders")
    with pytest.raises(X.NoJoinPath):
        q.base("spend").plan()


def test_bare_dimension_in_two_tables(spark):
    d = spark.createDataFrame([(1, "x")], "id long, place string")
    f = spark.createDataFrame([(1, 1)], "a long, b long")
    rel = (Relation("a", "belongs_to", "left", "a", "id"), Relation("b", "belongs_to", "right", "b", "id"))
    e = Engine(spark, ManualProvider("p", [frame_table("facts", f, relations=rel), frame_table("left", d), frame_table("right", d)]))
    with pytest.raises(X.AmbiguousColumn):
        e.query().metrics(Count("facts.a")).dimensions(Dim("place")).plan()
    assert e.query().metrics(Count("facts.a").alias("n")).dimensions(Dim("left.place")).frame().first()["n"] == 1


def test_kept_results(spark, shop, tmp_path):
    e = Engine(spark, shop.registry.provider("shop"), result_dir=f"{tmp_path}/kept")
    q = e.query().metrics(Count("orders.id").alias("n"))
    assert q.keep(60).frame().first()["n"] == q.keep(60).frame().first()["n"] == 4 and e.results.size() == 1
    first = next(iter(e.results._held.values()))[1]
    q.keep(0).frame()
    assert next(iter(e.results._held.values()))[1] != first
    with pytest.raises(X.MetricsError):
        q.format("excel", f"{tmp_path}/x.xlsx") if __import__("importlib").util.find_spec("openpyxl") is None else q.format("none")
    q.format("csv", f"{tmp_path}/out.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out.csv").first()["n"] == "4"


def test_python_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Numbers(DataSource):
        @classmethod
        def name(cls):
            return "numbers"

        def schema(self):
            return "n int"

        def reader(self, schema):
            class Reader(DataSourceReader):
                def read(self, partition):
                    yield from ((i,) for i in range(5))

            return Reader()

    e = Engine(spark, ManualProvider("p", [source_table("numbers", Numbers)]))
    assert e.query().metrics(Sum("numbers.n").alias("s")).frame().first()["s"] == 10
