"""Relational shapes: projections, filters, joins, aggregates, windows, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import dates
from quarry.operators import relational as rel
from quarry.operators.metrics import Metric, Metrics
from quarry.operators.scope import Scope, scoped_session
from quarry.plans.query import Condition, Item, Plan, Relationship, compiled
from quarry.queries.registry import Tables, query
from quarry.streaming.events import windowed_counts

EDGES = [
    Relationship("orders", "o_custkey", "customer", "c_custkey"),
    Relationship("customer", "c_nationkey", "nation", "n_nationkey"),
    Relationship("nation", "n_regionkey", "region", "r_regionkey"),
    Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Relationship("lineitem", "l_partkey", "part", "p_partkey"),
    Relationship("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Relationship("supplier", "s_nationkey", "nation", "n_nationkey"),
]
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def planned(t: Tables, plan: Plan) -> DataFrame:
    return compiled(plan, {n: getattr(t, n) for n in NAMES}, EDGES)



@query("""SELECT r_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'
GROUP BY r_name ORDER BY revenue DESC LIMIT 5""")
def top_regions_by_revenue(t: Tables) -> DataFrame:
    plan = Plan(
        base="orders", items=(Item("orders", "o_totalprice", "sum", "revenue"),), group=(Item("region", "r_name"),),
        where=(Condition("orders", "o_orderstatus", "=", ("F",)),), order=(("revenue", True),), limit=5,
    )
    return planned(t, plan).withColumn("revenue", F.round("revenue", 2))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount,
strftime(min(l_shipdate), '%Y-%m-%d') AS first_ship, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL""")
def several_measures(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first_ship"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last_ship"), F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW')
AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate IS NOT NULL AND o_orderpriority NOT LIKE '3%' GROUP BY ALL""")
def membership_and_range_filters(t: Tables) -> DataFrame:
    where = (
        Condition("orders", "o_orderstatus", "in", ("F", "O")), Condition("orders", "o_orderpriority", "not in", ("5-LOW",)),
        Condition("orders", "o_totalprice", "between", (1000, 200000)), Condition("orders", "o_orderdate", "is not null"),
        Condition("orders", "o_orderpriority", "not like", ("3%",)),
    )
    return planned(t, Plan(items=(Item("orders", None, "count", "n"),), group=(Item("orders", "o_orderpriority"),), where=where))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000.5 AND o_orderdate >= TIMESTAMP '1996-02-01' AND o_custkey <> 7 AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def operands_given_as_text(t: Tables) -> DataFrame:
    where = (
        Condition("orders", "o_totalprice", "BETWEEN", ("1000 to 200000.5",)), Condition("orders", "o_orderdate", "gte", ("1996-02-01",)),
        Condition("orders", "o_custkey", "!=", ("7",)), Condition("orders", "o_orderstatus", "one of", ("F", "O")),
    )
    plan = Plan(items=(Item("orders", None, "count", "n"),), group=(Item("orders", "o_orderpriority"),), where=where, base="orders")
    return compiled(plan, {"orders": t.orders}, [])


@query("""SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_name LIKE '%99'""")
def any_of_filters(t: Tables) -> DataFrame:
    any_of = (Condition("customer", "c_mktsegment", "=", ("BUILDING",)), Condition("customer", "c_acctbal", "<", (0,)), Condition("customer", "c_name", "like", ("%99",)))
    return planned(t, Plan(items=(Item("customer", None, "count", "n"),), any_of=any_of))


@query("""SELECT count(*) AS n FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE 'brand#1%'""")
def pattern_without_case(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").ilike("%RED%") | F.col("p_brand").ilike("brand#1%")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_orderstatus <> 'P' AND o_custkey > 5""")
def bound_parameters(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("bound_orders")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM bound_orders WHERE o_totalprice >= :low AND o_orderstatus <> :status AND o_custkey > :customer", args={"low": 1000, "status": "P", "customer": 5})


@query("""SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 50""")
def having_an_aggregate(t: Tables) -> DataFrame:
    return planned(t, Plan(items=(Item("customer", None, "count", "customers"),), group=(Item("nation", "n_name"),), base="customer", having=(("customers", ">", 50),)))


@query("""SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY ALL LIMIT 1000""")
def distinct_rows_over_a_join(t: Tables) -> DataFrame:
    plan = Plan(items=(Item("customer", "c_mktsegment"), Item("nation", "n_name")), distinct=True, order=(("c_mktsegment", False), ("n_name", False)), limit=1000)
    return planned(t, plan)


@query("""SELECT count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders""")
def distinct_count(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_distinct("o_custkey").alias("customers"), F.count("*").alias("orders"))


@query("""SELECT c_mktsegment, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 6) AS finished_percent
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def conditional_rate(t: Tables) -> DataFrame:
    share = Item("orders", "o_orderkey", "rate", "finished_percent", Condition("orders", "o_orderstatus", "=", ("F",)), 100.0)
    return planned(t, Plan(items=(share,), group=(Item("customer", "c_mktsegment"),), base="orders")).withColumn("finished_percent", F.round("finished_percent", 6))


@query("""SELECT CAST(NULL AS DOUBLE) AS rate, 0 AS total, count(*) AS n FROM orders WHERE o_totalprice < -1""")
def aggregates_of_nothing(t: Tables) -> DataFrame:
    none = t.orders.filter("o_totalprice < -1")
    return none.agg(rel.rate(F.col("o_orderstatus") == "F").alias("rate"), F.coalesce(F.sum("o_totalprice"), F.lit(0)).cast("int").alias("total"), F.count("*").alias("n"))


@query("""SELECT p_brand, round(sum(CAST(l_extendedprice AS DOUBLE)) / nullif(sum(l_quantity), 0), 6) AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""")
def ratio_of_aggregates(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return both.groupBy("p_brand").agg(F.round(F.try_divide(F.sum(F.col("l_extendedprice").cast("double")), F.sum("l_quantity")), 6).alias("unit_price"))


@query("""SELECT o_orderpriority, round(avg((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0), 6) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority""")
def average_duration(t: Tables) -> DataFrame:
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("o_orderpriority").agg(F.round(F.avg(dates.days_between(F.col("o_orderdate"), F.col("l_shipdate"))), 6).alias("days"))


@query("""SELECT n_name, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def path_through_a_shared_table(t: Tables) -> DataFrame:
    per = lambda df, key, n: df.groupBy(F.col(key).alias("n_nationkey")).agg(F.count("*").alias(n))
    # counted before they meet: the join does not multiply rows
    both = per(t.customer, "c_nationkey", "c").join(per(t.supplier, "s_nationkey", "s"), "n_nationkey").join(t.nation, "n_nationkey")
    return both.select("n_name", (F.col("c") * F.col("s")).alias("pairs"))


@query("""SELECT a.n_name AS nation, b.n_name AS neighbour FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def self_join(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return a.join(b, on).select(F.col("a.n_name").alias("nation"), F.col("b.n_name").alias("neighbour"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_join(t: Tables) -> DataFrame:
    return rel.with_both(t.customer, "c_custkey", (t.orders.filter("o_orderpriority = '1-URGENT'"), "o_custkey")).select("c_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')""")
def no_order_since(t: Tables) -> DataFrame:
    since = t.orders.filter(F.col("o_orderdate") >= dates.day("2000-01-01"))
    return rel.without(t.customer, "c_custkey", since, "o_custkey").select("c_custkey", "c_name")


@query("""SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def in_two_facts(t: Tables) -> DataFrame:
    back, large = t.lineitem.filter("l_returnflag = 'R'"), t.lineitem.filter("l_quantity > 45")
    return rel.with_both(t.part, "p_partkey", (back, "l_partkey"), (large, "l_partkey")).select("p_partkey")


@query("""SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def correlated_count(t: Tables) -> DataFrame:
    n = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return t.nation.join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


@query("""SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)""")
def above_own_average(t: Tables) -> DataFrame:
    mean = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return t.customer.join(mean, "c_nationkey").filter("c_acctbal > mean").select("c_custkey", "c_acctbal")


@query("""SELECT n_name, c_name, c_acctbal FROM nation, LATERAL (SELECT c_name, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_name LIMIT 2)""")
def lateral_top_two(t: Tables) -> DataFrame:
    top = rel.top_k(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_name")], 2)
    return top.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_name", "c_acctbal")


@query("""SELECT n_name, customers, rank() OVER (ORDER BY customers DESC) AS rank FROM (SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)""")
def rank_window(t: Tables) -> DataFrame:
    totals = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"))
    return rel.ranked(totals, F.desc("customers"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 3""")
def top_k_per_group(t: Tables) -> DataFrame:
    return rel.top_k(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("""SELECT p_brand, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand ORDER BY price DESC LIMIT 3""")
def top_groups(t: Tables) -> DataFrame:
    plan = Plan(items=(Item("lineitem", "l_extendedprice", "sum", "price"),), group=(Item("part", "p_brand"),), base="lineitem", order=(("price", True),), limit=3)
    return planned(t, plan).withColumn("price", F.round("price", 2))


@query("""SELECT s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 10 OFFSET 5""")
def ordered_page(t: Tables) -> DataFrame:
    return planned(t, Plan(items=(Item("supplier", "s_name"), Item("supplier", "s_acctbal")), order=(("s_acctbal", True), ("s_name", False)), limit=10, offset=5))


@query("""SELECT arg_max(c_name, (c_acctbal, -c_custkey)) AS richest, max(c_acctbal) AS balance FROM customer""")
def superlative(t: Tables) -> DataFrame:
    return t.customer.agg(F.max_by("c_name", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"), F.max("c_acctbal").alias("balance"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def series_by_segment(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def tumbling_windows(t: Tables) -> DataFrame:
    return windowed_counts(t.events).withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd"), "total": F.round("total", 4)})


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-04-01' AND o_orderdate < TIMESTAMP '1997-07-01' GROUP BY ALL""")
def quarter_window(t: Tables) -> DataFrame:
    inside = dates.within(F.col("o_orderdate"), *dates.quarter_window(1997, 2))
    return t.orders.filter(inside).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (year(o_orderdate) >= 1998) AS since, count(*) FILTER (month(o_orderdate) = 3) AS march FROM orders""")
def year_and_month(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.year("o_orderdate") >= 1998).alias("since"), F.count_if(F.month("o_orderdate") == 3).alias("march"))


@query("""WITH m AS (SELECT max(ts) AS x FROM events) SELECT
count(*) FILTER (ts >= date_trunc('day', x) - INTERVAL 6 DAY AND ts < date_trunc('day', x) + INTERVAL 1 DAY) AS last_7_days,
count(*) FILTER (ts >= date_trunc('day', x) - INTERVAL 1 DAY AND ts < date_trunc('day', x)) AS yesterday,
count(*) FILTER (ts >= date_trunc('month', x) AND ts < date_trunc('month', x) + INTERVAL 1 MONTH) AS this_month,
count(*) FILTER (ts >= date_trunc('month', x) - INTERVAL 1 MONTH AND ts < date_trunc('month', x)) AS last_month FROM events, m""")
def windows_relative_to_the_data(t: Tables) -> DataFrame:
    latest = t.events.agg(F.max("ts").alias("x")).first()["x"]
    now = F.lit(latest).cast("timestamp_ntz")
    count = lambda name, alias: F.count_if(dates.within(F.col("ts"), *dates.relative_window(now, name))).alias(alias)
    return t.events.agg(count("last 7 days", "last_7_days"), count("yesterday", "yesterday"), count("this month", "this_month"), count("last month", "last_month"))


@query("""SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer""")
def union_of_keys(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("nationkey")).union(t.customer.select("c_nationkey")).distinct()


@query("""SELECT s_nationkey AS nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation""")
def union_with_repeats(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_nationkey").alias("nationkey")).union(t.nation.select("n_nationkey"))


@query("""SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def intersection(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("key")).intersect(t.customer.filter("c_acctbal > 5000").select("c_custkey"))


@query("""SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders""")
def difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("key")).subtract(t.orders.select("o_custkey"))


@query("""SELECT o_orderstatus AS c0, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1 HAVING urgent <> low""")
def multiset_differences(t: Tables) -> DataFrame:
    side = lambda p: t.orders.filter(F.col("o_orderpriority") == p).select("o_orderstatus")
    counts = t.orders.groupBy(F.col("o_orderstatus").alias("c0")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
    differ = rel.differences(side("1-URGENT"), side("5-LOW"))
    return counts.join(differ.select("c0"), "c0", "left_semi")


@query("""WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), by_customer AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1)
SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS big_orders FROM by_customer JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def common_table_expressions(t: Tables) -> DataFrame:
    by_customer = t.orders.filter("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return by_customer.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.sum("n").alias("big_orders"))


@query("""WITH RECURSIVE r(n, days) AS (SELECT 1, 1 UNION ALL SELECT n + 1, days * 2 FROM r WHERE n < 10) SELECT n, days FROM r""")
def recursive_expression(t: Tables) -> DataFrame:
    return t.spark.sql("WITH RECURSIVE r(n, days) AS (SELECT 1, 1 UNION ALL SELECT n + 1, days * 2 FROM r WHERE n < 10) SELECT n, days FROM r")


@query("""SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1""")
def decoded_values(t: Tables) -> DataFrame:
    return rel.decoded(t.orders, "o_orderstatus", {"F": "finished", "O": "open"}, "status").groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, round(p_retailprice * 100, 4) AS cents FROM part""")
def unit_conversion(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") * 100, 4).alias("cents"))


@query("""SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'""")
def name_in_place_of_a_key(t: Tables) -> DataFrame:
    o, c = t.orders.filter("o_orderpriority = '1-URGENT'"), t.customer
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")


@query("""SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM orders JOIN customer c ON o_custkey = c_custkey WHERE c.c_nationkey = 3) AS own_orders
FROM customer WHERE c_nationkey = 3 GROUP BY c_mktsegment""")
def scoped_views(t: Tables) -> DataFrame:
    load = lambda name: lambda spark: spark.read.parquet(f"{t.folder}/{name}.parquet")
    own = scoped_session(t.spark, {n: load(n) for n in ("customer", "orders")}, [Scope("customer", "c_nationkey", "nation")], {"nation": 3})
    return own.sql("""SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM orders JOIN customer c ON o_custkey = c.c_custkey) AS own_orders
        FROM customer GROUP BY c_mktsegment""")


@query("""SELECT event_type, get_k AS k, count(*) AS n FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS get_k FROM events) GROUP BY ALL""")
def json_field(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("""SELECT c_mktsegment, quantile_disc(c_acctbal, 0.5) AS median, quantile_disc(c_acctbal, 0.9) AS high FROM customer GROUP BY 1""")
def percentiles(t: Tables) -> DataFrame:
    p = lambda x: F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY c_acctbal)")
    return t.customer.groupBy("c_mktsegment").agg(p(0.5).alias("median"), p(0.9).alias("high"))




METRICS = Metrics(
    Metric("revenue", "orders", "aggregate", "sum", "o_totalprice"), Metric("customers", "orders", "aggregate", "count_distinct", "o_custkey"),
    Metric("urgent_percent", "orders", "conditional_rate", column="o_orderkey", condition=("o_orderpriority", "=", ("1-URGENT",)), scale=100.0),
    Metric("large_orders", "orders", "aggregate", "count", where=("o_totalprice", ">", (200000,))),
)


@query("""SELECT o_orderstatus, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers, round(100.0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(o_orderkey), 6) AS urgent_percent,
nullif(count(*) FILTER (o_totalprice > 200000), 0) AS large_orders FROM orders GROUP BY 1""")
def governed_metrics(t: Tables) -> DataFrame:
    out = METRICS.computed(["revenue", "customers", "urgent_percent", "large_orders"], {"orders": t.orders}, ["o_orderstatus"])
    return out.withColumns({"revenue": F.round("revenue", 2), "urgent_percent": F.round("urgent_percent", 6)})
