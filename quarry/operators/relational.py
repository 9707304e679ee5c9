"""Joins, rates, ranks and sets that plain DataFrame methods do not name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate(hit: Column, of: Column | None = None, scale: float = 1.0) -> Column:
    """Share of rows with hit among those where of is not null, times scale; null if
    there are none. A null hit counts as no hit."""
    n = F.count(of) if of is not None else F.count("*")
    return F.count_if(F.coalesce(hit, F.lit(False))).cast("double") * scale / F.nullif(n, F.lit(0))


def with_both(base: DataFrame, key: str, *facts: tuple[DataFrame, str]) -> DataFrame:
    """Rows of base whose key is in every fact (frame, its key column), each once,
    however many facts there are: semi joins do not multiply rows."""
    for fact, fact_key in facts:
        base = base.join(fact.select(F.col(fact_key).alias(key)), key, "left_semi")
    return base


def without(base: DataFrame, key: str, fact: DataFrame, fact_key: str) -> DataFrame:
    """Rows of base whose key is not in fact."""
    return base.join(fact.select(F.col(fact_key).alias(key)), key, "left_anti")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Each group's rows are ranked where they meet;
    Spark cuts them to k before the shuffle as well."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__n", n).filter(F.col("__n") <= k).drop("__n")


def ranked(totals: DataFrame, by: Column, name: str = "rank") -> DataFrame:
    """totals with rank by, ties sharing one. Meant for aggregated rows: a rank over
    all rows is one ordered sequence."""
    return totals.withColumn(name, F.rank().over(Window.orderBy(by)))


def capped(df: DataFrame, n: int | None, default: int = 100, most: int = 1000) -> DataFrame:
    """A row list of at most n rows: default if none is asked for, most at most."""
    return df.limit(min(default if n is None else n, most))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with how often: left_only
    and right_only. Empty exactly if both hold the same rows as often. Columns are
    matched by place; counts are added up before the sides meet."""
    if len(left.columns) != len(right.columns):
        raise ValueError("the sides have different numbers of columns")
    names = [f"c{k}" for k in range(len(left.columns))]
    both = left.toDF(*names).withColumn("__n", F.lit(1)).union(right.toDF(*names).withColumn("__n", F.lit(-1)))
    n = both.groupBy(*names).agg(F.sum("__n").alias("n")).filter("n <> 0")
    return n.select(*names, F.greatest("n", F.lit(0)).alias("left_only"), F.greatest(-F.col("n"), F.lit(0)).alias("right_only"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    return len(left.columns) == len(right.columns) and differences(left, right).isEmpty()


def decoded(df: DataFrame, column: str, labels: dict[str, str], name: str) -> DataFrame:
    """df with name, the label of column's value, or the value itself."""
    pairs = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    text = F.col(column).cast("string")
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, text), text))
