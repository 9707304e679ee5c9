"""Tables as DataFrames, and small looks at their values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table; with an integer key, read in parts side by side."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, nullable) of every column of tables."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, k, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for k, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


def distinct_values(df: DataFrame, column: str, limit: int) -> DataFrame:
    """(value): the first limit distinct non-null values, without regard to case and
    then by case, so that the cut is the same in every run."""
    c = F.col(column)
    return df.select(c.alias("value")).filter(c.isNotNull()).distinct().orderBy(F.lower(F.col("value").cast("string")), "value").limit(limit)


#: How many sample values a column gets, by what its name says.
SAMPLES = {"private": 0, "place": 200, "name": 5000, "code": 500, "text": 50, "other": 10}
PRIVATE = r"(?i)(^|_)(password|passwd|secret|token|ssn|email|phone|iban|passport|address)(_|$)"
PLACE, NAME, CODE = r"(?i)(country|region|city|state|county|zip|postal)", r"(?i)(name|title|label)", r"(?i)(code|type|status|category|kind|segment|priority)"


def sample_kind(column: str, kind: str) -> str:
    import re

    for pattern, what in ((PRIVATE, "private"), (PLACE, "place"), (NAME, "name"), (CODE, "code")):
        if re.search(pattern, column):
            return what
    return "text" if kind == "string" else "other"


def sample_values(df: DataFrame, table_name: str) -> DataFrame:
    """(table, column, value): sample values of every column, as text, as many as its
    name allows; none of private ones."""
    parts = []
    for f in df.schema:
        n = SAMPLES[sample_kind(f.name, f.dataType.simpleString())]
        if n:
            parts.append(distinct_values(df, f.name, n).select(F.lit(table_name).alias("table"), F.lit(f.name).alias("column"), F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, parts)
