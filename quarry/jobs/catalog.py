"""Jobs over catalogs: keys, values, vocabularies, table families, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import matches, normalized


def key_stem(column: Column) -> Column:
    """What a key column refers to: its name without id, key or code at the end, and
    without the one-letter prefixes of its table; null for other columns."""
    bare = F.regexp_replace(F.lower(column), "^[a-z]{1,2}_", "")
    stem = F.regexp_extract(bare, "^([a-z0-9]+?)_?(?:id|key|code)$", 1)
    return F.nullif(stem, F.lit(""))


def inferred_keys(columns: DataFrame, primary: DataFrame) -> DataFrame:
    """(table, column, target, target_column): foreign keys by name.

    columns: (table, column); primary: (table, column) of each table's own key. A
    column refers to the table whose own key has its stem, or whose name starts
    with it, if there is exactly one such and it is another table."""
    own = primary.select(F.col("table").alias("target"), F.col("column").alias("target_column"))
    wanted = columns.withColumn("stem", key_stem(F.col("column"))).filter(F.col("stem").isNotNull() & (F.length("stem") > 2))
    own = own.withColumn("stem", key_stem(F.col("target_column")))
    found = wanted.join(own, "stem").filter(F.col("table") != F.col("target"))
    n = F.count("*").over(Window.partitionBy("table", "column"))
    return found.withColumn("n", n).filter("n = 1").select("table", "column", "target", "target_column")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Values of child's column, nulls apart, that parent's key does not have."""
    have = child.select(F.col(column).alias("value")).filter("value IS NOT NULL")
    return have.join(parent.select(F.col(key).alias("value")), "value", "left_anti").groupBy("value").agg(F.count("*").alias("n_rows"))


def key_inclusion(tables: dict[str, DataFrame], candidates: list[tuple[str, str, str, str]]) -> DataFrame:
    """(table, column, target, target_column, n_values, n_found) of candidates for
    foreign keys: a column's distinct values, nulls apart, and those the target has.
    A key holds if both are equal. Candidates are rows of a catalog, each a join by value."""
    parts = []
    for t, c, target, key in candidates:
        have = tables[t].select(F.col(c).alias("value")).filter("value IS NOT NULL").distinct()
        known = tables[target].select(F.col(key).alias("value")).filter("value IS NOT NULL").distinct().withColumn("there", F.lit(True))
        n = have.join(known, "value", "left").agg(F.count("*").alias("n_values"), F.count("there").alias("n_found"))
        parts.append(n.select(*(F.lit(x).alias(k) for k, x in zip(("table", "column", "target", "target_column"), (t, c, target, key))), "n_values", "n_found"))
    return reduce(DataFrame.unionByName, parts)


#: Fixed value: a key name that more tables share joins none of them.
MOST_SHARING = 8


def shared_keys(columns: DataFrame) -> DataFrame:
    """(name, left, left_column, right, right_column): pairs of tables that hold a key
    of one name (prefixes of a table apart), of names that at most MOST_SHARING share."""
    bare = F.regexp_replace(F.lower("column"), "^[a-z]{1,2}_", "")
    keys = columns.select("table", "column", bare.alias("name")).filter(F.col("name").rlike("(id|key|code)$") & ~F.col("name").isin("id", "key", "code"))
    tables = F.size(F.collect_set("table").over(Window.partitionBy("name")))
    keys = keys.withColumn("n", tables).filter(F.col("n").between(2, MOST_SHARING))
    side = lambda s: keys.select("name", F.col("table").alias(s), F.col("column").alias(f"{s}_column"))
    return side("left").join(side("right"), "name").filter(F.col("left") < F.col("right"))


def declared_keys(usage: DataFrame, references: DataFrame) -> DataFrame:
    """(table, column, target, target_column) of the keys a database declares.

    usage: (schema, constraint, table, column, position), the columns of each
    constraint; references: (schema, constraint, target_schema, target_constraint).
    A key of several columns gives one row per column, matched by position."""
    own = usage.select("schema", "constraint", "table", "column", "position")
    target = usage.select(
        F.col("schema").alias("target_schema"), F.col("constraint").alias("target_constraint"), F.col("table").alias("target"), F.col("column").alias("target_column"), "position"
    )
    return own.join(references, ["schema", "constraint"]).join(target, ["target_schema", "target_constraint", "position"]).select("table", "column", "target", "target_column")


def described_fields(fields: DataFrame, samples: DataFrame, keys: DataFrame) -> DataFrame:
    """fields (table, column, type) with values, the sorted sample values of each
    (table, column, value; none: empty), and is_key, whether keys has the column."""
    name = F.concat_ws(".", "table", "column").alias("name")
    values = samples.groupBy(name).agg(F.array_sort(F.collect_set("value")).alias("values"))
    known = keys.select(name).distinct().withColumn("there", F.lit(True))
    met = fields.withColumn("name", name).join(values, "name", "left").join(known, "name", "left")
    return met.select("table", "column", "type", F.coalesce("values", F.array().cast("array<string>")).alias("values"), F.col("there").isNotNull().alias("is_key"))


#: Questions, about, that a task ranks, and tasks at most: to more of them Spark would
#: write only what it has held and sorted.
DEALT, TASKS = 30_000, 200


def shares(questions: DataFrame) -> int:
    """Tasks that questions are dealt to, and so the rows of a frequent word."""
    return min(TASKS, max(1, -(-questions.count() // DEALT)))


def overlap_ranking(questions: DataFrame, labels: DataFrame, k: int, parts: int | None = None) -> DataFrame:
    """(question, target, score, place): the k targets whose labels share most words
    with a question, of questions (question, text) and labels (target, label). score is
    the share of a label's distinct words that the text has; ties go by target. The
    result is dealt by question to parts tasks, as many as shares() says by default."""
    parts = parts or shares(questions)
    words = lambda c: F.array_distinct(F.filter(F.split(normalized(F.coalesce(F.col(c), F.lit(""))), " "), lambda w: w != ""))
    # by word and part, so that a frequent word is no large group; then by question before
    # anything is counted. Numbers are given, as Spark would put small rows by the million together
    asked = questions.select("question", F.explode(words("text")).alias("word"), F.pmod(F.xxhash64("question"), F.lit(parts)).alias("part"))
    known = labels.select("target", words("label").alias("w")).select("target", F.size("w").alias("size"), F.explode("w").alias("word"))
    known = known.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    met = asked.repartition(parts, "word", "part").join(known.repartition(parts, "word", "part"), ["word", "part"])
    shared = met.select("question", "target", "size").repartition(parts, "question").groupBy("question", "target", "size").agg(F.count("*").alias("n"))
    scored = shared.select("question", "target", (F.col("n") / F.col("size")).alias("score"))
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "target"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def anchors(questions: DataFrame, fields: DataFrame) -> DataFrame:
    """questions (question, text) with target, the date field of fields (target, label,
    type) whose label fits best, and ambiguous: if several fit alike there is none. With
    one date field alone, that is the one."""
    dated = fields.filter(F.col("type").isin("date", "timestamp", "timestamp_ntz"))
    only = dated.agg(F.when(F.count("*") == 1, F.first("target")).alias("only"))
    parts = shares(questions)
    best = overlap_ranking(questions, dated, 2, parts).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("place", "target", "score"))).alias("b"))
    met = questions.repartition(parts, "question").join(best, "question", "left").crossJoin(F.broadcast(only))  # one row
    tied = F.coalesce(F.get("b", F.lit(0))["score"] == F.get("b", F.lit(1))["score"], F.lit(False))
    target = F.coalesce(F.when(~tied, F.get("b", F.lit(0))["target"]), F.when(F.col("b").isNull(), F.col("only")))
    return met.select(*questions.columns, target.alias("target"), tied.alias("ambiguous"))


def value_index(tables: dict[str, DataFrame], fields: list[tuple[str, str]], longest: int = 100) -> DataFrame:
    """(norm, fields): in which table.column each normalized text value occurs, of
    values of 2 to longest characters."""
    parts = None
    for t, c in fields:
        v = normalized(F.col(c).cast("string")).alias("norm")
        own = tables[t].select(F.col(c)).distinct().select(v, F.lit(f"{t}.{c}").alias("field"))
        parts = own if parts is None else parts.unionByName(own)
    kept = parts.filter(F.length("norm").between(2, longest)).distinct()
    return kept.groupBy("norm").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def label_index(labels: DataFrame) -> DataFrame:
    """(norm, refs, ambiguous) of labels (label, ref): what a label stands for; more
    than one ref is ambiguous and not resolved."""
    own = labels.select(normalized(F.col("label")).alias("norm"), "ref").filter("norm <> ''")
    refs = own.groupBy("norm").agg(F.array_sort(F.collect_set("ref")).alias("refs"))
    return refs.withColumn("ambiguous", F.size("refs") > 1)


def merged_vocabulary(entries: DataFrame) -> DataFrame:
    """entries (term, target, layer, confidence, source) with won and conflict.

    Of each term and target the entry of the highest layer wins, then of the
    highest confidence, then the first source. A term conflicts if winners of its
    highest layer name several targets."""
    best = Window.partitionBy("term", "target").orderBy(F.desc("layer"), F.desc("confidence"), "source")
    out = entries.withColumn("won", F.row_number().over(best) == 1)
    term = Window.partitionBy("term")
    top = F.max("layer").over(term)
    at_top = F.size(F.collect_set(F.when(F.col("won") & (F.col("layer") == F.col("top")), F.col("target"))).over(term))
    return out.withColumn("top", top).withColumn("conflict", at_top > 1).drop("top")


#: A shard's name: base, anchor and number.
SHARD = r"^(.+)_([a-z]+)_(\d+)$"


def families(tables: DataFrame) -> DataFrame:
    """(base, anchor, members, n) of tables (table): names base_anchor_N of which at
    least two share base and anchor."""
    part = lambda k: F.regexp_extract("table", SHARD, k)
    own = tables.filter(F.col("table").rlike(SHARD)).select("table", part(1).alias("base"), part(2).alias("anchor"))
    return own.groupBy("base", "anchor").agg(F.array_sort(F.collect_set("table")).alias("members"), F.count_distinct("table").alias("n")).filter("n > 1")


def shard_activity(families: DataFrame, rows: DataFrame) -> DataFrame:
    """families (base, anchor, members) with what rows (table, rows) says of them:
    base_exists, base_rows, shard_rows (of all shards), active (tables of the family
    that have rows, the base too) and ambiguous (more than one has)."""
    shards = families.select("base", "anchor", F.explode("members").alias("table")).join(rows, "table", "left")
    some = F.coalesce("rows", F.lit(0)) > 0
    per = shards.groupBy("base", "anchor").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("shard_rows"), F.count_if(some).alias("n"), F.array_sort(F.collect_list(F.when(some, F.col("table")))).alias("own"))
    met = per.join(rows.select(F.col("table").alias("base"), F.col("rows").alias("base_rows"), F.lit(True).alias("there")), "base", "left")
    base_active = F.coalesce("base_rows", F.lit(0)) > 0
    active = F.concat(F.when(base_active, F.array("base")).otherwise(F.array().cast("array<string>")), "own")
    return met.select("base", "anchor", F.coalesce("there", F.lit(False)).alias("base_exists"), "base_rows", "shard_rows", active.alias("active"), ((F.col("n") + base_active.cast("int")) > 1).alias("ambiguous"))


def shard_drift(columns: DataFrame, reference: str) -> DataFrame:
    """(table, column, drift): missing, extra or type, of columns (table, column, type)
    of shards against those of the reference table."""
    base = columns.filter(F.col("table") == reference).select("column", F.col("type").alias("base_type"))
    shards = columns.filter(F.col("table") != reference)
    one = lambda df: df.withColumn("__k", F.lit(1))
    expected = one(shards.select("table").distinct()).join(one(base), "__k").drop("__k")
    met = expected.join(shards, ["table", "column"], "full_outer")
    drift = F.when(F.col("type").isNull(), "missing").when(F.col("base_type").isNull(), "extra").when(F.col("type") != F.col("base_type"), "type")
    return met.select("table", "column", drift.alias("drift")).filter("drift IS NOT NULL")


def coverage(entities: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Entities (entity) that no entry of vocabulary (target) names."""
    return entities.join(vocabulary.select(F.col("target").alias("entity")), "entity", "left_anti")


def activity(evidence: DataFrame, weights: dict[str, float], most: float = 1.0) -> DataFrame:
    """(table, score) of evidence (table, kind, amount): weighted amounts, each kind
    counting up to 1, the sum up to most."""
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    by_kind = evidence.groupBy("table", "kind").agg(F.least(F.sum("amount"), F.lit(1.0)).alias("a"))
    score = F.sum(F.col("a") * F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(0.0)))
    return by_kind.groupBy("table").agg(F.least(score, F.lit(most)).alias("score"))


def schema_hash(columns: DataFrame) -> DataFrame:
    """(table, hash): sha2 over a table's columns and types in order of name."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "column", "type")))
    return columns.groupBy("table").agg(F.sha2(F.concat_ws(",", parts), 256).alias("hash"))


def biased_ranking(candidates: DataFrame, hints: dict[str, float], k: int) -> DataFrame:
    """candidates (question, target, score) with hints' bonus for every hint that the
    target holds; the k best of each question, ties by target."""
    bonus = sum((F.when(F.contains(F.lower("target"), F.lit(h)), F.lit(b)).otherwise(0.0) for h, b in hints.items()), F.lit(0.0))
    n = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("biased"), "target"))
    return candidates.withColumn("biased", F.col("score") + bonus).withColumn("place", n).filter(F.col("place") <= k)


def matched_intents(questions: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """questions with intents: the names of patterns (regular expressions without
    regard to case, \\b at ASCII words) that the text matches, in order of name."""
    hits = [F.when(matches(F.coalesce(F.col(text), F.lit("")), p), F.lit(n)) for n, p in sorted(patterns.items())]
    return questions.withColumn("intents", F.array_compact(F.array(*hits)))


def matched_values(questions: DataFrame, index: DataFrame, longest: int = 4, text: str = "text") -> DataFrame:
    """questions with matches: (norm, fields) of the indexed values that a question
    holds as a phrase of up to longest words. Phrases meet values by equality."""
    words = F.filter(F.split(normalized(F.coalesce(F.col(text), F.lit(""))), " "), lambda w: w != "")
    ends = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(w, lambda _, i: F.when(i + n <= F.size(w), F.array_join(F.slice(w, i + 1, n), " ")))))
    rows = questions.withColumn("__id", F.monotonically_increasing_id())
    phrases = rows.select("__id", words.alias("w")).select("__id", F.explode(F.array_distinct(F.array_compact(ends(F.col("w"))))).alias("norm"))
    found = phrases.join(index, "norm").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("norm", "fields"))).alias("matches"))
    return rows.join(found, "__id", "left").drop("__id")
