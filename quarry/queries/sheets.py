"""Spreadsheet shapes over the test tables, whose columns are read as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import sheet
from quarry.operators.sheet import Filter
from quarry.queries.registry import Tables, query


def parts(t: Tables) -> DataFrame:
    """part as a sheet; its keys give the rows' order."""
    return t.part.select(F.col("p_partkey").alias("row_index"), *(F.col(c).cast("string").alias(c) for c in ("p_name", "p_brand", "p_type", "p_size")))


def orders(t: Tables) -> DataFrame:
    price = F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    day = F.date_format("o_orderdate", "M/d/yyyy")
    flag = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return t.orders.select(F.col("o_orderkey").alias("row_index"), price.alias("order_value"), day.alias("order_date"), flag.alias("order_status"), F.col("o_orderpriority").alias("priority"))


KINDS = {"p_name": "text", "p_brand": "text", "p_type": "text", "p_size": "number", "order_value": "number", "order_date": "date", "order_status": "text", "priority": "text"}


@query(r"""WITH c AS (SELECT unnest(['p_name', 'p_brand', 'p_type', 'p_size']) AS "column", unnest([p_name, p_brand, p_type, CAST(p_size AS VARCHAR)]) AS raw FROM part)
SELECT "column", count(*)::BIGINT AS filled, count(DISTINCT trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g'))) AS distinct_values,
count(*) FILTER (regexp_matches(raw, '^[0-9]+$'))::BIGINT AS numbers FROM c GROUP BY 1""")
def sheet_profile(t: Tables) -> DataFrame:
    return sheet.profile(parts(t)).select("column", "filled", "distinct_values", "numbers")


@query("""SELECT * FROM (VALUES ('order_value', 'number'), ('order_date', 'date'), ('order_status', 'text'), ('priority', 'text')) AS v("column", kind)""")
def sheet_column_kinds(t: Tables) -> DataFrame:
    found = sheet.kinds(sheet.column_counts(orders(t)))
    return t.spark.createDataFrame(sorted(found.items()), "column string, kind string")


@query("""SELECT count(*) AS n FROM part WHERE lower(p_brand) = 'brand#12' AND p_size >= 10 AND p_size BETWEEN 5 AND 40 AND p_type IS NOT NULL""")
def sheet_filters(t: Tables) -> DataFrame:
    filters = [Filter("p_brand", "equals", "BRAND #12"), Filter("p_size", "gte", 10), Filter("p_size", "between", 5, 40), Filter("p_type", "present"), Filter("p_size", "gte", 10)]
    return sheet.filtered(parts(t), filters, KINDS).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderstatus <> 'F' AND month(o_orderdate) = 5 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'""")
def sheet_date_filters(t: Tables) -> DataFrame:
    filters = [Filter("order_status", "not_equals", "f"), Filter("order_date", "month", 5), Filter("order_date", "between", "1996-01-01", "1999-01-01")]
    return sheet.filtered(orders(t), filters, KINDS).agg(F.count("*").alias("n"))


@query("""SELECT CASE o_orderstatus WHEN 'P' THEN '(blank)' ELSE o_orderstatus END AS group_key, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS total,
round(avg(CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE), 4) AS mean, count(*) AS n FROM orders GROUP BY 1""")
def sheet_groups(t: Tables) -> DataFrame:
    rows = orders(t)
    out = sheet.grouped(rows, "order_status", {"total": sheet.aggregate("sum", "order_value"), "mean": sheet.aggregate("avg", "order_value"), "n": sheet.aggregate("count", None)}, "total")
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


@query("""SELECT 0.0::DOUBLE AS total, 0.0::DOUBLE AS mean, 0 AS n, 0 AS kinds""")
def sheet_aggregates_of_nothing(t: Tables) -> DataFrame:
    none = sheet.filtered(parts(t), [Filter("p_size", "gt", 1_000_000)], KINDS)
    return none.agg(*(sheet.aggregate(op, c).alias(n) for op, c, n in (("sum", "p_size", "total"), ("avg", "p_size", "mean"), ("count", None, "n"), ("count_distinct", "p_brand", "kinds"))))


@query("""SELECT p_name, p_size FROM (SELECT p_name, CAST(p_size AS VARCHAR) AS p_size, p_partkey, p_size AS s FROM part) ORDER BY s DESC, p_partkey LIMIT 50""")
def sheet_ordered_list(t: Tables) -> DataFrame:
    return sheet.listed(parts(t), ["p_name", "p_size"], "p_size", "number", descending=True)


@query("""SELECT p_brand, p_type FROM part GROUP BY ALL ORDER BY min(p_partkey) LIMIT 50""")
def sheet_distinct_list(t: Tables) -> DataFrame:
    return sheet.distinct_list(parts(t), ["p_brand", "p_type"])


@query(r"""SELECT DISTINCT source, lang, trim(regexp_replace(replace(lower(source || ' & ' || lang), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def normalized_text(t: Tables) -> DataFrame:
    pairs = t.documents.select("source", "lang").distinct()
    return pairs.withColumn("norm", text.normalized(F.concat_ws(" & ", "source", "lang")))


@query(r"""SELECT count(*) AS n FROM part WHERE contains(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', ' red ')""")
def phrase_in_text(t: Tables) -> DataFrame:
    return t.part.filter(text.has_phrase(text.normalized(F.col("p_name")), F.lit("red"))).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'BRASS') THEN 'p_brand,p_size' WHEN contains(p_type, 'STEEL') THEN 'p_type' ELSE 'p_name' END AS columns FROM part""")
def sheet_columns_asked(t: Tables) -> DataFrame:
    said = F.when(F.contains("p_type", F.lit("BRASS")), "Brand and P-size of each?").when(F.contains("p_type", F.lit("STEEL")), "every type, by size").otherwise("what is there")
    asked = t.part.select("p_partkey", said.alias("text"))
    out = sheet.asked_columns(asked, ["p_name", "p_brand", "p_type", "p_size"], KINDS, ["p_name"])
    return out.select("p_partkey", F.array_join("columns", ",").alias("columns"))
