"""Catalog jobs over the test tables' own columns and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import questions
from quarry.jobs import catalog
from quarry.queries.registry import Tables, query
from quarry.sources.store import upserted
from quarry.sources.tables import columns, distinct_values

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
TABLES = (*KEYS, "lineitem")


def all_columns(t: Tables) -> DataFrame:
    return columns({n: getattr(t, n) for n in TABLES})


@query("""SELECT * FROM (VALUES ('nation', 'n_regionkey', 'region', 'r_regionkey'), ('customer', 'c_nationkey', 'nation', 'n_nationkey'), ('supplier', 's_nationkey', 'nation', 'n_nationkey'),
('orders', 'o_custkey', 'customer', 'c_custkey'), ('lineitem', 'l_orderkey', 'orders', 'o_orderkey'), ('lineitem', 'l_partkey', 'part', 'p_partkey'), ('lineitem', 'l_suppkey', 'supplier', 's_suppkey'))
AS v("table", "column", target, target_column)""")
def inferred_foreign_keys(t: Tables) -> DataFrame:
    primary = t.spark.createDataFrame(sorted(KEYS.items()), "table string, column string")
    return catalog.inferred_keys(all_columns(t).select("table", "column"), primary)


@query("""SELECT o_custkey AS value, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1""")
def key_orphans(t: Tables) -> DataFrame:
    return catalog.orphans(t.orders, "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey")


INCLUSION = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("lineitem", "l_partkey", "customer", "c_custkey")]


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", '{g}' AS target, '{k}' AS target_column, count(DISTINCT {c}) AS n_values, count(DISTINCT {c}) FILTER ({c} IN (SELECT {k} FROM {g})) AS n_found FROM {t}"""
    for t, c, g, k in INCLUSION))
def key_inclusion(t: Tables) -> DataFrame:
    return catalog.key_inclusion({n: getattr(t, n) for n in TABLES}, INCLUSION)


COLUMNS = f"""c AS (SELECT table_name AS t, column_name AS c, regexp_replace(column_name, '^[a-z]{{1,2}}_', '') AS name FROM information_schema.columns WHERE table_name IN {TABLES})"""


@query(rf"""WITH {COLUMNS}, k AS (SELECT * FROM c WHERE regexp_matches(name, '(id|key|code)$') AND name NOT IN ('id', 'key', 'code'))
SELECT a.name, a.t AS "left", a.c AS left_column, b.t AS "right", b.c AS right_column FROM k a JOIN k b ON a.name = b.name AND a.t < b.t""")
def shared_keys(t: Tables) -> DataFrame:
    return catalog.shared_keys(all_columns(t).select("table", "column"))


@query(f"""WITH {COLUMNS}, v AS (SELECT 'customer.c_mktsegment' AS name, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS "values" FROM customer
UNION ALL SELECT 'region.r_name', array_to_string(list_sort(list(DISTINCT r_name)), ',') FROM region)
SELECT c.t AS "table", c.c AS "column", coalesce(v."values", '') AS "values", c.c IN {tuple(KEYS.values())} AS is_key FROM c LEFT JOIN v ON v.name = c.t || '.' || c.c""")
def described_fields(t: Tables) -> DataFrame:
    sample = lambda n, c: getattr(t, n).select(F.lit(n).alias("table"), F.lit(c).alias("column"), F.col(c).alias("value"))
    primary = t.spark.createDataFrame(sorted(KEYS.items()), "table string, column string")
    out = catalog.described_fields(all_columns(t), sample("customer", "c_mktsegment").unionByName(sample("region", "r_name")), primary)
    return out.select("table", "column", F.array_join("values", ",").alias("values"), "is_key")


RANKING = r"""w AS (SELECT p_partkey AS question, unnest(list_distinct(string_split(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), ' '))) AS word FROM part),
l AS (SELECT DISTINCT p_type AS target, list_distinct(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' ')) AS ws FROM part),
s AS (SELECT w.question, l.target, count(*)::DOUBLE / len(l.ws) AS score FROM w JOIN (SELECT target, ws, unnest(ws) AS word FROM l) l USING (word) GROUP BY w.question, l.target, l.ws),
r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, target) AS place FROM s)"""


@query(f"""WITH {RANKING} SELECT question, target, round(score, 6) AS score, place FROM r WHERE place <= 3""")
def label_overlap(t: Tables) -> DataFrame:
    asked = t.part.select(F.col("p_partkey").alias("question"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    labels = t.part.select(F.col("p_type").alias("target"), F.col("p_type").alias("label")).distinct()
    return catalog.overlap_ranking(asked, labels, 3).withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey AS question, CASE o_orderstatus WHEN 'O' THEN 'orders.ordered' WHEN 'F' THEN 'orders.shipped' END AS target, o_orderstatus NOT IN ('O', 'F') AS ambiguous FROM orders""")
def date_anchors(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderstatus") == "O", "orders ordered last month").when(F.col("o_orderstatus") == "F", "what was shipped on a date?").otherwise("any date this year")
    fields = [("orders.ordered", "ordered date", "date"), ("orders.shipped", "shipped date", "timestamp"), ("orders.note", "date ordered shipped year", "string")]
    out = catalog.anchors(t.orders.select(F.col("o_orderkey").alias("question"), said.alias("text")), t.spark.createDataFrame(fields, "target string, label string, type string"))
    return out.select("question", "target", "ambiguous")


@query("""SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL ORDER BY lower(p_brand), p_brand LIMIT 50""")
def sample_distinct_values(t: Tables) -> DataFrame:
    return distinct_values(t.part, "p_brand", 50)


@query(r"""WITH v AS (SELECT DISTINCT trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS norm, f FROM (
SELECT r_name AS x, 'region.r_name' AS f FROM region UNION ALL SELECT n_name, 'nation.n_name' FROM nation UNION ALL SELECT c_mktsegment, 'customer.c_mktsegment' FROM customer
UNION ALL SELECT o_orderstatus, 'orders.o_orderstatus' FROM orders UNION ALL SELECT o_orderpriority, 'orders.o_orderpriority' FROM orders UNION ALL SELECT p_type, 'part.p_type' FROM part))
SELECT norm, array_to_string(list_sort(list(f)), ',') AS fields FROM v WHERE length(norm) BETWEEN 2 AND 100 GROUP BY norm""")
def value_index(t: Tables) -> DataFrame:
    fields = [("region", "r_name"), ("nation", "n_name"), ("customer", "c_mktsegment"), ("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("part", "p_type")]
    return catalog.value_index({n: getattr(t, n) for n in TABLES}, fields).withColumn("fields", F.array_join("fields", ","))


@query(r"""SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS norm, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS refs, count(DISTINCT p_brand) > 1 AS ambiguous FROM part GROUP BY 1""")
def ambiguous_labels(t: Tables) -> DataFrame:
    return catalog.label_index(t.part.select(F.col("p_type").alias("label"), F.col("p_brand").alias("ref"))).withColumn("refs", F.array_join("refs", ","))


@query("""WITH e AS (SELECT p_type AS term, p_brand AS target, p_size % 3 AS layer, p_retailprice AS confidence, p_partkey AS source FROM part),
w AS (SELECT *, row_number() OVER (PARTITION BY term, target ORDER BY layer DESC, confidence DESC, source) = 1 AS won, max(layer) OVER (PARTITION BY term) AS top FROM e),
c AS (SELECT term, count(DISTINCT target) > 1 AS conflict FROM w WHERE won AND layer = top GROUP BY term)
SELECT term, target, layer, confidence, source, won, conflict FROM w JOIN c USING (term)""")
def vocabulary_merge(t: Tables) -> DataFrame:
    entries = t.part.select(F.col("p_type").alias("term"), F.col("p_brand").alias("target"), (F.col("p_size") % 3).alias("layer"), F.col("p_retailprice").alias("confidence"), F.col("p_partkey").alias("source"))
    return catalog.merged_vocabulary(entries)


@query("""SELECT 'sales' AS base, 'year' AS anchor, array_to_string(['sales_year_' || y FOR y IN [1995, 1996, 1997, 1998, 1999, 2000, 2001]], ',') AS members, 7 AS n""")
def table_families(t: Tables) -> DataFrame:
    years = t.orders.select(F.concat(F.lit("sales_year_"), F.year("o_orderdate").cast("string")).alias("table")).distinct()
    names = years.unionByName(t.spark.createDataFrame([("orders",), ("sales_half_1",)], "table string"))
    return catalog.families(names).withColumn("members", F.array_join("members", ","))


@query("""WITH s AS (SELECT 'sales_' || CASE WHEN o_orderpriority < '3' THEN 'year_' ELSE 'day_' END || year(o_orderdate) AS t, CASE WHEN o_orderpriority < '3' THEN 'year' ELSE 'day' END AS anchor,
count(*) FILTER (o_orderstatus = 'P' AND year(o_orderdate) % 2 = 1) AS n FROM orders GROUP BY ALL)
SELECT 'sales' AS base, anchor, true AS base_exists, (SELECT count(*) FROM customer) AS base_rows, sum(n)::BIGINT AS shard_rows,
'sales' || coalesce(',' || string_agg(t, ',' ORDER BY t) FILTER (n > 0), '') AS active, count(*) FILTER (n > 0) > 0 AS ambiguous FROM s GROUP BY anchor""")
def shard_activity(t: Tables) -> DataFrame:
    anchor = F.when(F.col("o_orderpriority") < "3", "year").otherwise("day")
    year = F.year("o_orderdate")
    shards = t.orders.groupBy(F.concat(F.lit("sales_"), anchor, F.lit("_"), year.cast("string")).alias("table"))
    shards = shards.agg(F.count_if((F.col("o_orderstatus") == "P") & (year % 2 == 1)).alias("rows"))
    rows = shards.unionByName(t.customer.agg(F.lit("sales").alias("table"), F.count("*").alias("rows")))
    return catalog.shard_activity(catalog.families(shards.select("table")), rows).withColumn("active", F.array_join("active", ","))


@query("""SELECT * FROM (VALUES ('supplier', 'custkey', 'missing'), ('supplier', 'mktsegment', 'missing'), ('supplier', 'suppkey', 'extra'),
('orders', 'acctbal', 'missing'), ('orders', 'mktsegment', 'missing'), ('orders', 'name', 'missing'), ('orders', 'nationkey', 'missing'),
('orders', 'orderkey', 'extra'), ('orders', 'orderstatus', 'extra'), ('orders', 'totalprice', 'extra'), ('orders', 'orderdate', 'extra'), ('orders', 'orderpriority', 'extra')) AS v("table", "column", drift)""")
def shard_drift(t: Tables) -> DataFrame:
    shards = columns({"customer": t.customer, "supplier": t.supplier, "orders": t.orders})
    return catalog.shard_drift(shards.select("table", F.regexp_replace("column", "^[a-z]_", "").alias("column"), "type"), "customer")


@query("""SELECT n_name AS entity FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""")
def uncovered_entities(t: Tables) -> DataFrame:
    named = t.customer.filter("c_acctbal > 9900").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.coverage(t.nation.select(F.col("n_name").alias("entity")), named.select(F.col("n_name").alias("target")))


@query("""WITH k AS (SELECT user_id, event_type, least(sum(value) / 1000, 1.0) AS a FROM events GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS "table", round(least(sum(a * CASE event_type WHEN 'click' THEN 0.2 WHEN 'purchase' THEN 0.5 WHEN 'view' THEN 0.1 ELSE 0 END), 1.0), 6) AS score FROM k GROUP BY 1""")
def activity_scores(t: Tables) -> DataFrame:
    evidence = t.events.select(F.col("user_id").cast("string").alias("table"), F.col("event_type").alias("kind"), (F.col("value") / 1000).alias("amount"))
    return catalog.activity(evidence, {"click": 0.2, "purchase": 0.5, "view": 0.1}).withColumn("score", F.round("score", 6))


@query("""WITH b AS (SELECT c_nationkey AS question, c_name AS target, c_acctbal AS score, round(c_acctbal + CASE WHEN contains(lower(c_name), '7') THEN 500.0 ELSE 0 END, 4) AS biased FROM customer)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY biased DESC, target) AS place FROM b) WHERE place <= 3""")
def biased_ranking(t: Tables) -> DataFrame:
    candidates = t.customer.select(F.col("c_nationkey").alias("question"), F.col("c_name").alias("target"), F.col("c_acctbal").alias("score"))
    return catalog.biased_ranking(candidates, {"7": 500.0}, 3).withColumn("biased", F.round("biased", 4))


#: Names of question patterns and what they match.
PATTERNS = {"count": r"\b(how many|count of|number of)\b", "list": r"\b(list|show|give) (me|all)?", "top": r"\b(top|best|highest|most)\b", "missing": r"\b(without|missing|no)\b"}


@query(r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)\b(how many|count of|number of)\b') THEN 'count' END, CASE WHEN regexp_matches(text, '(?i)\b(list|show|give) (me|all)?') THEN 'list' END,
CASE WHEN regexp_matches(text, '(?i)\b(without|missing|no)\b') THEN 'missing' END, CASE WHEN regexp_matches(text, '(?i)\b(top|best|highest|most)\b') THEN 'top' END], lambda x: x IS NOT NULL), ',') AS intents FROM conversations""")
def question_intents(t: Tables) -> DataFrame:
    return catalog.matched_intents(t.conversations, PATTERNS).select("conv_id", "turn", F.array_join("intents", ",").alias("intents"))


@query("""SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal <= 0 UNION ALL SELECT c_custkey, 'PREFERRED', round(c_acctbal * 2, 4) FROM customer WHERE c_acctbal > 0""")
def upsert_last_write_wins(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.filter("c_acctbal > 0").withColumns({"c_mktsegment": F.lit("PREFERRED"), "c_acctbal": F.round(F.col("c_acctbal") * 2, 4)})
    return upserted(old, new, ["c_custkey"])


@query("""SELECT 'region' AS "table", sha256('r_name:string,r_regionkey:int') AS hash UNION ALL SELECT 'nation', sha256('n_name:string,n_nationkey:int,n_regionkey:int')""")
def schema_hashes(t: Tables) -> DataFrame:
    return catalog.schema_hash(columns({"region": t.region, "nation": t.nation}))


@query(r"""WITH q AS (SELECT c_custkey, 'customers of ' || n_name || ' in the ' || c_mktsegment || ' segment' AS text, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, array_to_string(list_sort([trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), lower(c_mktsegment)]), ',') AS found FROM q""")
def values_in_questions(t: Tables) -> DataFrame:
    index = catalog.value_index({n: getattr(t, n) for n in TABLES}, [("nation", "n_name"), ("customer", "c_mktsegment")])
    both = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = both.select("c_custkey", F.concat(F.lit("customers of "), "n_name", F.lit(" in the "), "c_mktsegment", F.lit(" segment")).alias("text"))
    found = catalog.matched_values(asked, index)
    return found.select("c_custkey", F.array_join(F.array_sort(F.transform("matches", lambda m: m["norm"])), ",").alias("found"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'lt' ELSE 'gt' END AS op, CAST(o_custkey AS DOUBLE) AS low, CAST(o_custkey % 20 + 1 AS INTEGER) AS n,
strftime(make_timestamp(year(o_orderdate), quarter(o_orderdate) * 3 - 2, 1, 0, 0, 0), '%Y-%m-%d') AS start FROM orders""")
def phrases_in_questions(t: Tables) -> DataFrame:
    word = F.when(F.col("o_orderpriority") == "5-LOW", "fewer than").otherwise("more than")
    asked = F.concat_ws(" ", F.lit("Top"), F.col("o_custkey") % 20 + 1, F.lit("customers with"), word, F.col("o_custkey"), F.lit("orders in"), F.concat(F.lit("Q"), F.quarter("o_orderdate")), F.year("o_orderdate"))
    rows = t.orders.select("o_orderkey", asked.alias("text"))
    said, when = questions.comparison(F.col("text")), questions.window(F.col("text"))
    return rows.select("o_orderkey", said["op"].alias("op"), said["low"].alias("low"), questions.row_limit(F.col("text")).alias("n"), F.date_format(when["start"], "yyyy-MM-dd").alias("start"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS start,
CAST(CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE) WHEN 'P' THEN CAST(o_orderdate AS DATE) + 1 END AS VARCHAR) AS "end" FROM orders""")
def days_in_questions(t: Tables) -> DataFrame:
    named = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("orders before "), F.date_format("o_orderdate", "MMMM d, yyyy")))
    named = named.when(F.col("o_orderstatus") == "P", F.concat(F.lit("orders on "), F.date_format("o_orderdate", "M/d/yyyy"))).otherwise(F.concat(F.lit("orders since "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    when = questions.day_window(F.col("text"))
    rows = t.orders.select("o_orderkey", named.alias("text")).select("o_orderkey", when.alias("w"))
    return rows.select("o_orderkey", F.col("w.start").cast("string").alias("start"), F.col("w.end").cast("string").alias("end"))
