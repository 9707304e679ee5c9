"""Vocabulary and descriptions from files, kept where they are grounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "term string, target string, kind string, layer int, confidence double, source string, _corrupt string"


def read_vocabulary(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Entries of JSON lines (term, target, kind, layer, confidence, source) that
    parse, have a term, and name a target of known (target)."""
    rows = spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = rows.filter(F.col("_corrupt").isNull() & (F.trim(F.coalesce("term", F.lit(""))) != "")).drop("_corrupt")
    return good.join(known.select("target").distinct(), "target", "left_semi").select("term", "target", "kind", "layer", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), "source")


def read_descriptions(spark: SparkSession, path: str, table: str, known: DataFrame) -> DataFrame:
    """Entries of a CSV of column descriptions (original_column_name, column_name,
    column_description): each readable name or short description of a known column."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    target = F.concat_ws(".", F.lit(table), F.trim("original_column_name"))
    terms = F.explode(F.array_distinct(F.array(*(F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in ("column_name", "column_description"))))).alias("term")
    named = rows.select(target.alias("target"), terms).filter((F.col("term") != "") & (F.length("term") <= 80))
    return named.join(known.select("target").distinct(), "target", "left_semi").select("term", "target")
