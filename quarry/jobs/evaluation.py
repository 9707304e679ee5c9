"""Jobs over evaluation results: ranking metrics, rates, buckets, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import ascii_edges, collapsed, matches

#: Gold from which a target is relevant.
RELEVANT = 0.5


def places(ranked: DataFrame) -> DataFrame:
    """ranked (question, target, score, gold) with place, by score and then target,
    and ideal, the place by gold."""
    by_score = Window.partitionBy("question").orderBy(F.desc("score"), "target")
    by_gold = Window.partitionBy("question").orderBy(F.desc("gold"), "target")
    return ranked.withColumns({"place": F.row_number().over(by_score), "ideal": F.row_number().over(by_gold)})


def relevant_targets(vectors: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, relevant): how many targets have a question's label, itself apart, of
    vectors (target, label) and questions (question, label); counted without pairs."""
    targets = vectors.filter("target IS NOT NULL")
    n = targets.groupBy("label").agg(F.count("*").alias("n"))
    own = targets.groupBy(F.col("target").alias("question"), "label").agg(F.count("*").alias("own"))
    met = questions.select("question", "label").join(n, "label").join(own, ["question", "label"], "left")
    return met.groupBy("question").agg(F.sum(F.col("n") - F.coalesce("own", F.lit(0))).alias("relevant"))


def recall_at(ranked: DataFrame, k: int, relevant: DataFrame | None = None) -> DataFrame:
    """(question, recall): share of a question's relevant targets among its first k;
    questions without relevant targets are left out. With relevant (question, relevant),
    the numbers of them, ranked needs to hold no more than the first k."""
    hit = F.col("gold") >= RELEVANT
    out = places(ranked).groupBy("question").agg(F.count_if(hit).alias("relevant"), F.count_if(hit & (F.col("place") <= k)).alias("found"))
    out = out if relevant is None else out.drop("relevant").join(relevant, "question")
    return out.filter("relevant > 0").select("question", (F.col("found") / F.col("relevant")).alias("recall"))


def ndcg_at(ranked: DataFrame, k: int, relevant: DataFrame | None = None) -> DataFrame:
    """(question, ndcg): discounted gain of the first k over that of the best order;
    questions whose best order gains nothing are left out. With relevant (question,
    relevant), the numbers of targets of gold 1 where others have 0, ranked needs to
    hold no more than the first k."""
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col("gold") / F.log2(F.col(at) + 1)).otherwise(0.0))
    out = places(ranked).groupBy("question").agg(gain("place").alias("own"), gain("ideal").alias("best"))
    if relevant is not None:
        first = F.when(F.col("relevant") > 0, F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")))
        best = F.aggregate(first, F.lit(0.0), lambda s, n: s + 1 / F.log2(n + 1))
        out = out.select("question", "own").join(relevant, "question").withColumn("best", best)
    return out.filter("best > 0").select("question", (F.col("own") / F.col("best")).alias("ndcg"))


def exact_match(pairs: DataFrame, left: str, right: str) -> Column:
    """Share of pairs whose texts are equal but for white space."""
    return F.avg((collapsed(F.col(left)) == collapsed(F.col(right))).cast("double"))


def top_choice(slots: DataFrame) -> Column:
    """Share of slots (candidates array, gold place from 0) whose first candidate is
    the gold one."""
    return F.avg(F.coalesce(F.get("candidates", F.lit(0)) == F.get("candidates", F.col("gold")), F.lit(False)).cast("double"))


def outcome(r: str = "status", match: str = "matches") -> Column:
    """Bucket of an example: error, timeout, bail, correct or wrong."""
    return F.when(F.col(r).isin("error", "timeout", "bail"), F.col(r)).when(F.coalesce(F.col(match), F.lit(False)), "correct").otherwise("wrong")


def bucket_counts(examples: DataFrame, by: str) -> DataFrame:
    """(by, bucket, n) and whether it is the group's largest bucket (ties by name)."""
    n = examples.groupBy(by, "bucket").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "bucket"))
    return n.withColumn("largest", first == 1)


def ablation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, n) of examples (key, correct) in either run: kept, lost, gained,
    still wrong, only before, only after."""
    b, a = before.select(key, F.col("correct").alias("b")), after.select(key, F.col("correct").alias("a"))
    both = b.join(a, key, "full_outer")
    change = (
        F.when(F.col("a").isNull(), "only before").when(F.col("b").isNull(), "only after").when(F.col("b") & F.col("a"), "kept")
        .when(F.col("b"), "lost").when(F.col("a"), "gained").otherwise("still wrong")
    )
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def text_features(texts: DataFrame, text: str = "text") -> list[Column]:
    """Features of statements: clause flags, numbers, quoted literals, tokens."""
    t = F.coalesce(F.col(text), F.lit(""))
    flag = lambda word: matches(t, rf"\b{word}\b")
    return [
        *(flag(w).alias(f"has_{w}") for w in ("join", "where", "order", "limit", "group", "having")),
        F.size(F.regexp_extract_all(t, F.lit(ascii_edges(r"\b\d+(?:\.\d+)?\b")), F.lit(0))).alias("numbers"),
        F.size(F.regexp_extract_all(t, F.lit(r"'[^']*'"), F.lit(0))).alias("literals"),
        F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")).alias("tokens"),
    ]


#: Names after FROM and JOIN, and an operator between two operands outside quotes.
TABLE, ARITHMETIC = r"(?i)\b(?:from|join)\s+([a-z_][a-z0-9_.]*)", r"(?i)[a-z0-9_)]\s*[-+*/%]\s*[a-z0-9_(]"
#: The star that stands for all columns.
STAR = r"(?i)\b(?:select|distinct)\s+\*"
QUOTED = r"'(?:[^']|'')*'"


def structure_features(text: str = "text") -> list[Column]:
    """What statements read and select: tables (sorted, in lower case), projections
    (items before FROM, commas within brackets apart) and has_arithmetic."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), QUOTED, "''")
    # innermost brackets first, three deep; what they hold is no item of its own
    selected = F.regexp_extract(bare, r"(?is)\bselect\s+(.*?)\s+from\b", 1)
    for _ in range(3):
        selected = F.regexp_replace(selected, r"\([^()]*\)", "")
    items = F.when(F.trim(selected) == "", 0).otherwise(F.size(F.split(selected, ",")))
    return [
        F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(TABLE), F.lit(1)), F.lower))).alias("tables"),
        items.alias("projections"), F.regexp_replace(bare, STAR, "").rlike(ARITHMETIC).alias("has_arithmetic"),
    ]


#: Fixed value: inner joins that a skeleton may hold.
MOST_JOINS = 3


def skeletons(statements: DataFrame, text: str = "text") -> DataFrame:
    """statements with skip, why one has no skeleton (set_op, cte, join, subquery or
    other, the first that applies; null: none), and skeleton, its text with every
    quoted text and number as ?, white space collapsed; null if skipped."""
    t = collapsed(F.coalesce(F.col(text), F.lit("")))
    bare = F.regexp_replace(t, QUOTED, "?")
    count = lambda p: F.size(F.regexp_extract_all(bare, F.lit(p), F.lit(0)))
    skip = (
        F.when(bare.rlike(r"(?i)\b(?:union|intersect|except)\b"), "set_op").when(bare.rlike(r"(?i)^with\b"), "cte")
        .when((count(r"(?i)\bjoin\b") > MOST_JOINS) | bare.rlike(r"(?i)\b(?:left|right|full|cross)\s+(?:outer\s+)?join\b"), "join")
        .when(count(r"(?i)\bselect\b") > 1, "subquery").when(~bare.rlike(r"(?i)^select\b"), "other")
    )
    made = F.regexp_replace(bare, r"\b\d+(?:\.\d+)?\b", "?")
    return statements.withColumns({"skip": skip, "skeleton": F.when(skip.isNull(), made)})


def corpus_stats(texts: DataFrame, seen: DataFrame, text: str = "text") -> DataFrame:
    """One row: texts, shares with each clause, mean tokens, and texts that seen has
    too, but for white space and case."""
    key = F.lower(collapsed(F.col(text))).alias("key")
    rows = texts.select(key, *text_features(texts, text))
    known = seen.select(key).distinct().withColumn("known", F.lit(True))
    share = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c[4:]}_share")
    return rows.join(known, "key", "left").agg(
        F.count("*").alias("texts"), *(share(f"has_{w}") for w in ("join", "where", "order", "limit", "group", "having")),
        F.avg("tokens").alias("mean_tokens"), F.count("known").alias("overlap"),
    )


def stride_subset(df: DataFrame, order: str, k: int, range_rows: int = 200_000) -> DataFrame:
    """About k rows at even distances in the order of a column, ties in the order of a
    hash of the row. Places are counted per range of the column first, so no task holds
    all rows; a row's range follows from its value and bounds found on a sample."""
    n = df.count()
    step, ranges = max(1, n // max(1, k)), min(1000, -(-n // range_rows))
    bounds = []
    if ranges > 1:
        some = df.select(order).filter(F.col(order).isNotNull()).sample(min(1.0, 40 * ranges / n), seed=42)
        values = sorted(r[0] for r in some.limit(80 * ranges).collect())
        bounds = sorted({values[i * len(values) // ranges] for i in range(1, ranges)}) if values else []
    # how many bounds are not above the value; a null has none
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(order).alias("order"), part.alias("part"))
    sizes = df.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("order", F.xxhash64("row"))) - 1
    placed = rows.withColumn("own", own).join(sizes, "part")
    return placed.filter((F.col("before") + F.col("own")) % step == 0).select("row.*")


def diverse_subset(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """(cluster, key): of each of k clusters the row nearest to the cluster's centre,
    ties by key."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, F.col(vector).alias("__v"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = F.array(*(F.array(*map(F.lit, c.tolist())) for c in model.clusterCenters()))
    placed = model.transform(rows).withColumn("__c", F.element_at(centres, F.col("prediction") + 1))
    apart = F.aggregate(F.zip_with("__v", "__c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    nearest = placed.groupBy("prediction").agg(F.min(F.struct(apart.alias("d"), F.col(key).alias(key))).alias("m"))
    return nearest.select(F.col("prediction").alias("cluster"), F.col(f"m.{key}").alias(key))


def coverage(examples: DataFrame) -> DataFrame:
    """examples with recall of gold in found (arrays of names): null without gold."""
    n = F.size(F.array_distinct("gold"))
    return examples.withColumn("recall", F.size(F.array_intersect("gold", "found")) / F.nullif(n, F.lit(0)))
