"""A corpus pipeline of five stages: each works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, quality_rules, secret_scans, simhash_dedup, source_mixing
from quarry.llm.shared import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts go, repeated rows
    stay or go together, an empty table gives none, other columns are carried along."""
    return quality_rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the
    document with the smallest doc_id, and of those with one doc_id, or with none
    where no other has one, that whose text has the smallest hash. Rows that repeat
    both doc_id and text are one document; rows that share only the doc_id are two.
    Rows without words stay; an empty table gives none; other columns are carried."""
    group = materialize(simhash_dedup.similar_documents(docs), "groups")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    # written, so that the join with it may split a large group's rows
    first = materialize(group.groupBy("root").agg(F.min(own).alias("first")).select(F.col("root").alias("__root"), "first"), "first")
    own = group.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("rows"))
    own = materialize(own.join(first, F.col("root") == F.col("__root")), "members")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("hash") == F.col("first.hash"))
    named = [F.col("doc_id").alias("__doc_id"), F.col("hash").alias("__hash")]
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.xxhash64("text") == F.col("__hash"))
    again = materialize(own.filter(stays & (F.col("rows") > 1)).select(*named), "again")
    gone = own.filter(~stays).select(*named)
    if again.isEmpty():
        return docs.join(gone, same, "left_anti").select(*docs.columns)
    kept = docs.join(gone.unionByName(again), same, "left_anti")
    return kept.unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item. A text is judged by itself,
    whatever its doc_id: repeated rows stay or go together, and so do null ids. Null
    and empty texts stay; an empty table on either side removes nothing; other columns
    are carried along."""
    texts = docs.select(F.xxhash64("text").alias("hash"), "text")
    found = decontamination.contaminated(texts, read(spark, sf_dir, "benchmark"), doc="hash")
    gone = materialize(found.select(F.col("doc_id").alias("__hash")).distinct(), "contaminated")
    return docs.join(gone, F.xxhash64("text") == F.col("__hash"), "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret's span replaced; n_chars follows the text. Every
    row stays, repeated ones too; a null text becomes empty; an empty table gives
    none; other columns are carried along."""
    redacted = secret_scans.redact(docs, keep=[c for c in docs.columns if c not in ("text", "n_chars")])
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast("long"))
    return redacted.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: what each slot of each output shard takes of which document.
    A null source is a source of its own; texts without words take no part; repeated
    rows are packed one after the other; an empty table gives none; columns other
    than doc_id, source and text are left out."""
    return source_mixing.mixed_text(docs)


STAGES = [
    ("quality rules", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", without_secrets),
    ("source mixing", mix),
]

#: SimHash groups, alignments and pseudorandom draws are not for SQL; tests/llm
#: compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written before the next reads them. Nulls,
    repeated rows, empty tables and other columns are as each stage says."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
