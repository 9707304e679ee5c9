"""Helpers that the corpus operators have in common."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What separates words: ASCII white space only.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Texts that Python holds as words or tokens at a time, in characters.
CHUNK_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    of our own where the session has none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines see")
        found = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later jobs neither repeat
    its work nor depend on the executors that did it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_quarry_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def per_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], dict]], fields: str) -> DataFrame:
    """keep columns plus what make()'s function makes of each batch of texts.

    The function gets a list of whole texts (null: empty) and returns a list or
    array of the same length for each of fields (a DDL string). make runs once a
    task, so that a task can hold state of its own.
    """
    added = T.StructType.fromDDL(fields)
    # kept columns pass under names of their own, so none can clash
    source = df.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keep)), F.col(text).cast("string").alias("__text"))
    schema = T.StructType([T.StructField(k, source.schema[i].dataType) for i, k in enumerate(keep)] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in split(batch):
                out = fn([x or "" for x in part.column(part.num_columns - 1).to_pylist()])
                cols = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                cols += [pa.array(out[f.name], type=arrow.field(f.name).type) for f in added.fields]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return source.mapInArrow(run, schema)


def split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column holds about CHUNK_CHARS bytes at most,
    or one row."""
    last = batch.column(batch.num_columns - 1)
    if last.nbytes <= CHUNK_CHARS or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from split(batch.slice(0, half))
    yield from split(batch.slice(half))
