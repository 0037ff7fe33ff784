"""Named queries over the test tables and, for each, the SQL that gives the same rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.engine import Engine
from gnomon.errors import MetricsError
from gnomon.model import Avg, BoolDim, Calculated, Computed, Count, CountDistinct, Dim, EnumDim, Max, Measure, Min, Relation, StringDim, Sum, TimeDim
from gnomon.operators.formula import divide
from gnomon.sources.providers import FilesProvider, ManualProvider, sql_table

RELATIONS = {
    "lineitem": (
        Relation("order", "belongs_to", "orders", "l_orderkey", "o_orderkey"),
        Relation("part", "belongs_to", "part", "l_partkey", "p_partkey"),
        Relation("supplier", "belongs_to", "supplier", "l_suppkey", "s_suppkey"),
    ),
    "orders": (Relation("customer", "belongs_to", "customer", "o_custkey", "c_custkey"),),
    "customer": (Relation("nation", "belongs_to", "nation", "c_nationkey", "n_nationkey"),),
    "supplier": (Relation("nation", "belongs_to", "nation", "s_nationkey", "n_nationkey"),),
    "nation": (Relation("region", "belongs_to", "region", "n_regionkey", "r_regionkey"),),
    "part": (Relation("suppliers", "many_to_many", "supplier", "p_partkey", "s_suppkey", ("lineitem", "l_partkey", "l_suppkey")),),
}
KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "events": ["event_id"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return Engine(spark, FilesProvider("shop", sf_dir, TABLES, RELATIONS, KEYS))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


REVENUE = Sum("orders.o_totalprice").alias("revenue")
ORDERS = Count("orders.o_orderkey").alias("n_orders")
SEGMENT = Dim("customer.c_mktsegment").alias("segment")
PRICE = Sum("lineitem.l_extendedprice").alias("price")


def _totals(*metrics, dims=(), where=None, digits=None, then=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = engine(spark, sf_dir).query().metrics(*metrics).dimensions(*dims).where(where or {})
        return _rounded((then(q) if then else q).frame(), **(digits if digits is not None else {"revenue": 2}))

    return run


def _by(granularity: str):
    return _totals(REVENUE, ORDERS, dims=(TimeDim("orders.o_orderdate").alias("period").at(granularity),))


def _named(spark, sf_dir):
    e = engine(spark, sf_dir).define("revenue", REVENUE).define("orders", ORDERS)
    return _rounded(e.query().metrics("revenue", "orders").dimensions(Dim("orders.o_orderpriority").alias("priority")).frame(), revenue=2)


def _segment(spark, sf_dir):
    e = engine(spark, sf_dir).segment("big_open", {"orders.o_totalprice": [">", 200000], "orders.o_orderstatus": "O"})
    return _rounded(e.query().metrics(REVENUE, ORDERS).dimensions(SEGMENT).apply("big_open").frame(), revenue=2)


def _custom(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.aggregates.register("sum_of_squares", lambda c: F.sum(c * c))
    return _rounded(e.query().metrics(Measure("sum_of_squares", "lineitem.l_quantity").alias("squares")).dimensions(Dim("lineitem.l_returnflag").alias("flag")).frame(), squares=2)


def _view(spark, sf_dir):
    engine(spark, sf_dir).view("order_geography", "orders", "customer", "nation", "region")
    return spark.sql("SELECT r_name, CAST(count(o_orderkey) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM order_geography GROUP BY r_name")


def _sql_source(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("gnomon_orders")
    table = sql_table("yearly", "SELECT year(o_orderdate) AS y, o_orderstatus AS status, sum(o_totalprice) AS total FROM gnomon_orders GROUP BY 1, 2")
    e = Engine(spark, ManualProvider("manual", [table]))
    return _rounded(e.query().metrics(Max("yearly.total").alias("best"), Count("yearly.y").alias("n")).dimensions(Dim("yearly.status")).frame(), best=2)


def _scratch(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where none is set and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise MetricsError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="gnomon-"))
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/gnomon-{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}
DAY = TimeDim("orders.o_orderdate").alias("day").daily()


def _rollup(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.roll_up(e.query().metrics(REVENUE, ORDERS).dimensions(DAY, Dim("orders.o_orderstatus").alias("status")), _scratch(spark))
    q = e.query().metrics(ORDERS, REVENUE).dimensions(TimeDim("orders.o_orderdate").alias("month").monthly()).where({"orders.o_orderstatus": "F"})
    return _rounded(q.frame(), revenue=2)


def _rollup_path(spark, sf_dir):
    """A roll-up over suppliers' nations must not answer a query over customers' nations, and does answer its own."""
    e = engine(spark, sf_dir)
    e.roll_up(e.query().metrics(PRICE).dimensions(NATION).prefer("supplier"), _scratch(spark))
    parts = [e.query().metrics(PRICE).dimensions(NATION).prefer(side).frame().select(F.lit(side).alias("side"), "nation", "price") for side in ("supplier", "customer")]
    return _rounded(parts[0].unionByName(parts[1]), price=2)


def _rollup_empty(spark, sf_dir):
    e = engine(spark, sf_dir)
    e.roll_up(e.query().metrics(REVENUE, ORDERS).dimensions(Dim("orders.o_orderstatus").alias("status")), _scratch(spark))
    return _rounded(e.query().metrics(ORDERS, REVENUE).where({"orders.o_orderstatus": "none"}).frame(), revenue=2)


def _manual(spark: SparkSession, sf_dir: str, *tables) -> Engine:
    """Orders and customers as views, and tables over them."""
    for name in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"gnomon_{name}")
    return Engine(spark, ManualProvider("manual", tables))


def _has_one(spark, sf_dir):
    size = sql_table("order_size", "SELECT l_orderkey, count(*) AS n_items FROM gnomon_lineitem GROUP BY l_orderkey")
    orders = sql_table("orders", "SELECT * FROM gnomon_orders", relations=(Relation("size", "has_one", "order_size", "o_orderkey", "l_orderkey"),))
    return _rounded(_manual(spark, sf_dir, size, orders).query().metrics(REVENUE, ORDERS).dimensions(Dim("order_size.n_items")).frame(), revenue=2)


_NOTES = """SELECT o_orderkey AS owner, 'order' AS kind, o_totalprice AS weight FROM gnomon_orders
  UNION ALL SELECT c_custkey, 'customer', c_acctbal FROM gnomon_customer"""


def _morph_many(spark, sf_dir):
    notes = sql_table("notes", _NOTES)
    customer = sql_table("customer", "SELECT * FROM gnomon_customer", relations=(Relation("notes", "morph_many", "notes", "c_custkey", "owner", type_is=("kind", "customer")),))
    metrics = Count("notes.owner").alias("n"), Sum("notes.weight").alias("weight")
    return _rounded(_manual(spark, sf_dir, notes, customer).query().metrics(*metrics).dimensions(SEGMENT).frame(), weight=2)


def _morph_to(spark, sf_dir):
    notes = sql_table("notes", _NOTES, relations=(Relation("order", "morph_to", "orders", "owner", "o_orderkey", type_is=("kind", "order")),))
    orders = sql_table("orders", "SELECT * FROM gnomon_orders")
    return _manual(spark, sf_dir, notes, orders).query().metrics(Count("notes.owner").alias("n")).dimensions(Dim("orders.o_orderstatus").alias("status")).frame()


def _boolean(spark, sf_dir):
    orders = sql_table("orders", "SELECT *, o_totalprice > 150000 AS large FROM gnomon_orders")
    return _rounded(_manual(spark, sf_dir, orders).query().metrics(REVENUE, ORDERS).dimensions(BoolDim("orders.large")).frame(), revenue=2)


def _inferred(spark, sf_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = Engine(spark, FilesProvider("shop", sf_dir, TABLES, None, KEYS, infer=True))
    return _rounded(e.query().metrics(REVENUE).dimensions(Dim("region.r_name").alias("region")).frame(), revenue=2)


def _metadata(spark, sf_dir):
    """What a column carries for presentation, as rows."""
    shown = Sum("orders.o_totalprice").alias("sales").label("Sales").currency("USD").decimals(2)
    field = engine(spark, sf_dir).query().metrics(shown).frame().schema["sales"]
    return spark.createDataFrame([("sales", k, str(v)) for k, v in sorted(field.metadata.items())], "name string, key string, value string")


def _kept(spark, sf_dir):
    """Asked twice; the second time from the kept result."""
    e = engine(spark, sf_dir)
    e.results.folder = _scratch(spark)
    q = e.query().metrics(REVENUE, ORDERS).dimensions(Dim("orders.o_orderstatus").alias("status")).keep(60)
    q.frame()
    return _rounded(q.frame(), revenue=2)


def _json(spark, sf_dir):
    """A result written as JSON below a folder, found there as a table, and asked again."""
    root = _scratch(spark)
    engine(spark, sf_dir).query().metrics(REVENUE).dimensions(Dim("orders.o_orderstatus").alias("status")).format("json", f"{root}/deep/by_status.json")
    e = Engine(spark, FilesProvider("made", root, format="json"))
    return _rounded(e.query().metrics(Max("by_status.revenue").alias("most"), Count("by_status.status").alias("n")).frame(), most=2)


def _page(q):
    return q.page(10, 2)


SUPPLY = Sum("supplier.s_acctbal").alias("supplier_balance")
BALANCE = Sum("customer.c_acctbal").alias("customer_balance")
NATION = Dim("nation.n_name").alias("nation")

QUERIES = {
    "sum_total": _totals(REVENUE),
    "count_total": _totals(ORDERS, digits={}),
    "avg_total": _totals(Avg("orders.o_totalprice").alias("mean"), digits={"mean": 6}),
    "min_max_total": _totals(Min("orders.o_totalprice").alias("least"), Max("orders.o_totalprice").alias("most"), digits={}),
    "multi_agg_same_column": _totals(REVENUE, Avg("orders.o_totalprice").alias("mean"), Count("orders.o_totalprice").alias("n"), digits={"revenue": 2, "mean": 6}),
    "default_alias": _totals(Count("orders.o_orderkey"), dims=(Dim("orders.o_orderstatus"),), digits={}),
    "by_hour": _totals(Count("events.event_id").alias("n"), Sum("events.value").alias("total"), dims=(TimeDim("events.ts").alias("period").hourly(),), digits={"total": 2}),
    "by_day": _by("day"), "by_week": _by("week"), "by_month": _by("month"), "by_quarter": _by("quarter"), "by_year": _by("year"),
    "by_date": _totals(ORDERS, dims=(TimeDim("orders.o_orderdate").alias("day").as_date().daily(),), digits={}),
    "by_category": _totals(REVENUE, ORDERS, dims=(Dim("orders.o_orderstatus").alias("status"),)),
    "string_dim": _totals(ORDERS, dims=(StringDim("orders.o_orderpriority").with_name("priority"),), digits={}),
    "enum_dim": _totals(ORDERS, dims=(EnumDim("orders.o_orderstatus").alias("status").only(("F", "O")),), digits={}),
    "two_dims": _totals(REVENUE, dims=(Dim("orders.o_orderstatus").alias("status"), TimeDim("orders.o_orderdate").alias("month").monthly())),
    "two_granularities": _totals(ORDERS, dims=(TimeDim("orders.o_orderdate").monthly(), TimeDim("orders.o_orderdate").yearly()), digits={}),
    "metric_registry": _named,
    "filter_eq": _totals(REVENUE, ORDERS, where={"orders.o_orderstatus": "F"}),
    "filter_ops": _totals(REVENUE, ORDERS, where={"orders.o_totalprice": [">=", 150000], "orders.o_orderpriority": ["!=", "1-URGENT"]}),
    "filter_in": _totals(REVENUE, where={"orders.o_orderstatus": ["IN", ["F", "P"]]}),
    "filter_only": _totals(REVENUE, Avg("orders.o_totalprice").alias("mean"), dims=(SEGMENT.only(["BUILDING", "MACHINERY"]),), digits={"revenue": 2, "mean": 6}),
    "filter_except": _totals(ORDERS, dims=(SEGMENT.except_(["BUILDING"]),), digits={}),
    "filter_dim_where": _totals(ORDERS, dims=(Dim("orders.o_orderpriority").alias("priority").where("<", "3"),), digits={}),
    "filter_and": _totals(REVENUE, where={"orders.o_orderstatus": "O", "customer.c_mktsegment": "BUILDING"}),
    "filter_to_many": _totals(REVENUE, ORDERS, where={"lineitem.l_returnflag": "R", "lineitem.l_quantity": [">", 40]}),
    "join_one_hop": _totals(REVENUE, ORDERS, dims=(SEGMENT,)),
    "join_three_hop": _totals(REVENUE, dims=(Dim("region.r_name").alias("region"),)),
    "join_filter_remote": _totals(REVENUE, dims=(NATION,), where={"region.r_name": "ASIA"}),
    "multi_hop_filter": _totals(REVENUE, where={"orders.customer.nation.region.r_name": "EUROPE"}),
    "join_diamond": _totals(PRICE, dims=(NATION,), digits={"price": 2}, then=lambda q: q.prefer("supplier")),
    "join_diamond_customer": _totals(PRICE, dims=(NATION,), digits={"price": 2}, then=lambda q: q.prefer("customer")),
    "fanout_safe": _totals(REVENUE, PRICE, Count("customer.c_custkey").alias("customers"), dims=(SEGMENT,), digits={"revenue": 2, "price": 2}),
    "fanout_flat": _totals(REVENUE, dims=(Dim("lineitem.l_returnflag").alias("flag"),), then=lambda q: q.fan_out("flat")),
    "two_facts_total": _totals(REVENUE, PRICE, digits={"revenue": 2, "price": 2}),
    "chasm": _totals(BALANCE, SUPPLY, dims=(NATION,), digits={"customer_balance": 2, "supplier_balance": 2}),
    "conformed_time": None,
    "bridge_m2n": _totals(Count("part.p_partkey").alias("parts"), dims=(NATION,), digits={}, then=lambda q: q.fan_out("bridge")),
    "derived_sub": _totals(PRICE, Sum("lineitem.l_quantity").alias("quantity"), Computed("price - quantity", "rest").depends_on("price", "quantity"), dims=(Dim("lineitem.l_returnflag").alias("flag"),), digits={"price": 2, "quantity": 2, "rest": 2}),
    "derived_ratio": _totals(REVENUE, CountDistinct("orders.o_custkey").alias("buyers"), Calculated(lambda m: divide(m["revenue"], m["buyers"]), "per_buyer", ("revenue", "buyers")), dims=(TimeDim("orders.o_orderdate").alias("year").yearly(),), digits={"revenue": 2, "per_buyer": 4}),
    "count_distinct": _totals(Count("orders.o_custkey").distinct().alias("buyers"), dims=(Dim("orders.o_orderstatus").alias("status"),), digits={}),
    "metric_filter": _totals(Sum("orders.o_totalprice").where("o_orderstatus", "=", "F").alias("filled"), REVENUE, dims=(SEGMENT,), digits={"filled": 2, "revenue": 2}),
    "sql_source": _sql_source,
    "alias_metric_dim": _totals(Sum("orders.o_totalprice").alias("Total Sales").label("Sales").currency("USD").decimals(2), dims=(Dim("orders.o_orderstatus").alias("Order Status"),), digits={"Total Sales": 2}),
    "custom_aggregate": _custom,
    "segment": _segment,
    "view": _view,
    "preagg_hit": _rollup,
    "preagg_path": _rollup_path,
    "preagg_empty_count": _rollup_empty,
    "has_one": _has_one,
    "morph_many": _morph_many,
    "morph_to": _morph_to,
    "bool_dim": _boolean,
    "inferred_relations": _inferred,
    "metric_metadata": _metadata,
    "kept_result": _kept,
    "json_round_trip": _json,
    "min_granularity": _totals(ORDERS, dims=(TimeDim("orders.o_orderdate").as_timestamp().min_granularity("day").alias("month").monthly(),), digits={}),
    "ambiguous_qualified": _totals(Count("lineitem.l_orderkey").alias("n"), dims=(Dim("supplier.s_nationkey").alias("nation"),), digits={}),
    "enum_cases": _totals(ORDERS, dims=(EnumDim("orders.o_orderstatus").alias("status").with_cases(("F", "O")).strict(),), digits={}),
    "filter_list": _totals(REVENUE, where={"orders.o_orderstatus": ["F", "O"]}),
    "filter_null": _totals(ORDERS, where={"customer.c_mktsegment": None}, digits={}),
    "base_table": _totals(SUPPLY, Count("supplier.s_suppkey").alias("suppliers"), dims=(NATION,), digits={"supplier_balance": 2}, then=lambda q: q.base("nation")),
    "paginate": _totals(ORDERS, dims=(TimeDim("orders.o_orderdate").alias("month").monthly(),), digits={}, then=_page),
}


def _conformed(spark, sf_dir):
    """Orders by order date and items by ship date under one name that both tables' catalogs have."""
    from dataclasses import replace

    files = FilesProvider("shop", sf_dir, TABLES, RELATIONS, KEYS)
    files.boot(spark)
    date = {"orders": "o_orderdate", "lineitem": "l_shipdate"}
    tables = [replace(t, dimensions=(TimeDim(date[t.name]).alias("date"),)) if t.name in date else t for t in files.tables()]
    e = Engine(spark, ManualProvider("shop", tables))
    return _rounded(e.query().metrics(REVENUE, PRICE).dimensions(TimeDim("date").alias("date").monthly()).frame(), revenue=2, price=2)


QUERIES["conformed_time"] = _conformed


def _time(g: str) -> str:
    return f"SELECT CAST(date_trunc('{g}', o_orderdate) AS TIMESTAMP) AS period, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders GROUP BY 1"


_OC = "orders LEFT JOIN customer ON o_custkey = c_custkey"
_OCN = f"{_OC} LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"

ORACLE = {
    "sum_total": "SELECT round(sum(o_totalprice), 2) AS revenue FROM orders",
    "count_total": "SELECT count(o_orderkey) AS n_orders FROM orders",
    "avg_total": "SELECT round(avg(o_totalprice), 6) AS mean FROM orders",
    "min_max_total": "SELECT min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders",
    "multi_agg_same_column": "SELECT round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean, count(o_totalprice) AS n FROM orders",
    "default_alias": "SELECT o_orderstatus, count(o_orderkey) AS count_orders_o_orderkey FROM orders GROUP BY 1",
    "by_hour": "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, count(event_id) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    **{f"by_{g}": _time(g) for g in ("day", "week", "month", "quarter", "year")},
    "by_date": "SELECT CAST(date_trunc('day', o_orderdate) AS DATE) AS day, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "by_category": "SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "string_dim": "SELECT o_orderpriority AS priority, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "enum_dim": "SELECT o_orderstatus AS status, count(o_orderkey) AS n_orders FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "two_dims": "SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1, 2",
    "two_granularities": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS o_orderdate_month, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS o_orderdate_year, count(o_orderkey) AS n_orders FROM orders GROUP BY 1, 2",
    "metric_registry": "SELECT o_orderpriority AS priority, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "filter_eq": "SELECT round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders WHERE o_orderstatus = 'F'",
    "filter_ops": "SELECT round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders WHERE o_totalprice >= 150000 AND o_orderpriority <> '1-URGENT'",
    "filter_in": "SELECT round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus IN ('F', 'P')",
    "filter_only": f"SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean FROM {_OC} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "filter_except": f"SELECT c_mktsegment AS segment, count(o_orderkey) AS n_orders FROM {_OC} WHERE c_mktsegment NOT IN ('BUILDING') GROUP BY 1",
    "filter_dim_where": "SELECT o_orderpriority AS priority, count(o_orderkey) AS n_orders FROM orders WHERE o_orderpriority < '3' GROUP BY 1",
    "filter_and": f"SELECT round(sum(o_totalprice), 2) AS revenue FROM {_OC} WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'",
    "filter_to_many": "SELECT round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_quantity > 40)",
    "join_one_hop": f"SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM {_OC} GROUP BY 1",
    "join_three_hop": f"SELECT r_name AS region, round(sum(o_totalprice), 2) AS revenue FROM {_OCN} GROUP BY 1",
    "join_filter_remote": f"SELECT n_name AS nation, round(sum(o_totalprice), 2) AS revenue FROM {_OCN} WHERE r_name = 'ASIA' GROUP BY 1",
    "multi_hop_filter": f"SELECT round(sum(o_totalprice), 2) AS revenue FROM {_OCN} WHERE r_name = 'EUROPE'",
    "join_diamond": "SELECT n_name AS nation, round(sum(l_extendedprice), 2) AS price FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "join_diamond_customer": "SELECT n_name AS nation, round(sum(l_extendedprice), 2) AS price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "fanout_safe": f"""WITH a AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS revenue FROM {_OC} GROUP BY 1),
      b AS (SELECT c_mktsegment AS segment, sum(l_extendedprice) AS price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
      c AS (SELECT c_mktsegment AS segment, count(c_custkey) AS customers FROM customer GROUP BY 1)
      SELECT segment, round(revenue, 2) AS revenue, round(price, 2) AS price, customers FROM a FULL JOIN b USING (segment) FULL JOIN c USING (segment)""",
    "fanout_flat": "SELECT l_returnflag AS flag, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "two_facts_total": "SELECT (SELECT round(sum(o_totalprice), 2) FROM orders) AS revenue, (SELECT round(sum(l_extendedprice), 2) FROM lineitem) AS price",
    "chasm": """WITH a AS (SELECT n_name AS nation, sum(c_acctbal) AS x FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
      b AS (SELECT n_name AS nation, sum(s_acctbal) AS y FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
      SELECT nation, round(x, 2) AS customer_balance, round(y, 2) AS supplier_balance FROM a FULL JOIN b USING (nation)""",
    "conformed_time": """WITH a AS (SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS x FROM orders GROUP BY 1),
      b AS (SELECT date_trunc('month', l_shipdate) AS d, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1)
      SELECT CAST(d AS TIMESTAMP) AS date, round(x, 2) AS revenue, round(y, 2) AS price FROM a FULL JOIN b USING (d)""",
    "bridge_m2n": """SELECT n_name AS nation, count(p_partkey) AS parts FROM part
      LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey
      LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""",
    "derived_sub": "SELECT l_returnflag AS flag, round(sum(l_extendedprice), 2) AS price, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice) - sum(l_quantity), 2) AS rest FROM lineitem GROUP BY 1",
    "derived_ratio": "SELECT CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS year, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS buyers, round(sum(o_totalprice) / nullif(count(DISTINCT o_custkey), 0), 4) AS per_buyer FROM orders GROUP BY 1",
    "count_distinct": "SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1",
    "metric_filter": f"SELECT c_mktsegment AS segment, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS filled, round(sum(o_totalprice), 2) AS revenue FROM {_OC} GROUP BY 1",
    "sql_source": "SELECT status, round(max(total), 2) AS best, count(y) AS n FROM (SELECT year(o_orderdate) AS y, o_orderstatus AS status, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) GROUP BY 1",
    "alias_metric_dim": 'SELECT o_orderstatus AS "Order Status", round(sum(o_totalprice), 2) AS "Total Sales" FROM orders GROUP BY 1',
    "custom_aggregate": "SELECT l_returnflag AS flag, round(sum(l_quantity * l_quantity), 2) AS squares FROM lineitem GROUP BY 1",
    "segment": f"SELECT c_mktsegment AS segment, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM {_OC} WHERE o_totalprice > 200000 AND o_orderstatus = 'O' GROUP BY 1",
    "view": f"SELECT r_name, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM {_OCN} GROUP BY 1",
    "preagg_hit": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
    "preagg_path": """SELECT 'supplier' AS side, n_name AS nation, round(sum(l_extendedprice), 2) AS price
      FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 2
      UNION ALL SELECT 'customer', n_name, round(sum(l_extendedprice), 2)
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 2""",
    "preagg_empty_count": "SELECT count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'none'",
    "has_one": """SELECT n_items, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders
      LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1""",
    "morph_many": """SELECT c_mktsegment AS segment, count(owner) AS n, round(sum(weight), 2) AS weight FROM
      (SELECT o_orderkey AS owner, 'order' AS kind, o_totalprice AS weight FROM orders UNION ALL SELECT c_custkey, 'customer', c_acctbal FROM customer)
      LEFT JOIN customer ON c_custkey = owner AND kind = 'customer' GROUP BY 1""",
    "morph_to": """SELECT o_orderstatus AS status, count(owner) AS n FROM
      (SELECT o_orderkey AS owner, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer)
      LEFT JOIN orders ON o_orderkey = owner AND kind = 'order' GROUP BY 1""",
    "bool_dim": "SELECT o_totalprice > 150000 AS large, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "inferred_relations": f"SELECT r_name AS region, round(sum(o_totalprice), 2) AS revenue FROM {_OCN} GROUP BY 1",
    "metric_metadata": "SELECT * FROM (VALUES ('sales', 'currency', 'USD'), ('sales', 'decimals', '2'), ('sales', 'label', 'Sales')) AS t(name, key, value)",
    "kept_result": "SELECT o_orderstatus AS status, round(sum(o_totalprice), 2) AS revenue, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "json_round_trip": "SELECT round(max(revenue), 2) AS most, count(status) AS n FROM (SELECT o_orderstatus AS status, sum(o_totalprice) AS revenue FROM orders GROUP BY 1)",
    "min_granularity": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(o_orderkey) AS n_orders FROM orders GROUP BY 1",
    "ambiguous_qualified": "SELECT s_nationkey AS nation, count(l_orderkey) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "enum_cases": "SELECT o_orderstatus AS status, count(o_orderkey) AS n_orders FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1",
    "filter_list": "SELECT round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "filter_null": f"SELECT count(o_orderkey) AS n_orders FROM {_OC} WHERE c_mktsegment IS NULL",
    "base_table": """SELECT n_name AS nation, round(sum(s_acctbal), 2) AS supplier_balance, count(s_suppkey) AS suppliers
      FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
    "paginate": "SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(o_orderkey) AS n_orders FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 10",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
