"""Mixing sources to target weights, in DataFrame functions only.

Each source's words are packed, document after document, into blocks of a fixed
length. Output shards draw a source for each of their slots (so the counts of a
shard are a multinomial draw), slots of a source are numbered through all shards,
and slot j takes the block that a pseudorandom permutation of the source's block
numbers gives for j. Blocks and documents meet by block number.

The draws of whole shards miss a source's target by chance; slots beyond a
source's quota are left out and the missing ones follow in closing shards, so a
source takes exactly its target, rounded to words. A pass over a source uses each
of its blocks once before the next pass starts, in another order; so no document
is taken more often than there are passes, three at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.shared import SPACE, WORD, bucket, let, materialize, word_count

#: Words in a block, slots in a shard, rounds of the permutation, most passes.
BLOCK, SLOTS, ROUNDS, PASSES = 256, 1024, 20, 3
#: A word and the white space after it.
SPACED_WORD = WORD + r"[\x20\x09-\x0D]*"


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """One row per source: source, source_size, rank (from 0), weight, target.

    Sources by code point, null last, weigh weights, repeating. Targets share
    the sum of all sizes; with r = passes * size / weight, sources in the order
    of r reach their cap before any of higher r does, so the first level that no
    remaining source's cap is below is where sharing ends.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = own.withColumn("rank", (F.row_number().over(every) - 1).cast("int"))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("double"))
    own = own.withColumn("cap", (F.lit(passes) * F.col("source_size")).cast("double"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    own = own.select(
        "*", F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("taken"), F.sum("weight").over(after).alias("left"),
    )
    own = own.withColumn("level", (F.col("total") - F.col("taken")) / F.col("left"))
    own = own.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("taken", "level"))).over(Window.partitionBy())["level"])
    return own.select("source", F.col("source_size"), "rank", "weight", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def permuted(x: Column, n: Column, *key: Column, back: bool = False) -> Column:
    """Place of x in a pseudorandom permutation of 0 .. n - 1 (swap or not: each
    round mirrors x about a point of its own, or not, by a bit of the hash of the
    pair; a round is its own inverse, so back runs them from the last)."""
    rounds = [*range(ROUNDS)][:: -1 if back else 1]

    def step(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("mirror"), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(at, other), *key).bitwiseAND(1) == 1, other).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, rounds)), x.cast("long"), step)


def with_offsets(docs: DataFrame, runs: int) -> DataFrame:
    """docs with offset, the words of its source before the row.

    Rows of a source are dealt to runs by hash; a window orders and adds up each
    run, and a second window adds up the runs' totals. With as many runs as the
    square root of the rows, neither has to hold more than about that many rows
    of even the largest source."""
    docs = docs.withColumn("run", bucket(runs, F.lit("run"), F.col("doc_id"), F.col("nth")))
    run = Window.partitionBy("rank", "run").orderBy("doc_id", "nth")
    docs = docs.withColumn("within", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    totals = docs.groupBy("rank", "run").agg(F.sum("size").alias("run_size"))
    before = F.sum("run_size").over(Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("run_size")
    totals = totals.select("rank", "run", before.alias("base"))
    return docs.join(totals, ["rank", "run"]).withColumn("offset", F.col("base") + F.col("within")).drop("run", "within", "base")


def quotas(plan: DataFrame, block: int = BLOCK) -> DataFrame:
    """plan with what the source's slots come to: blocks, words of the last block,
    whole passes, slots in all, and words of the last slot (that may be cut)."""
    want = F.round("target").cast("long")
    p = plan.filter("source_size > 0").withColumn("want", want).filter("want > 0")
    p = p.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    p = p.withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
    p = p.withColumn("passes", F.expr("want div source_size")).withColumn("rest", F.col("want") % F.col("source_size"))
    # the short block's place in the pass that is cut
    p = p.withColumn("at", permuted(F.col("blocks") - 1, F.col("blocks"), F.col("rank"), F.col("passes"), back=True))
    # so many slots hold rest words, if the short block is not or is among them
    plain = F.expr(f"(rest + {block - 1}) div {block}")
    with_short = F.expr(f"(rest + ({block} - short) + {block - 1}) div {block}")
    p = p.withColumn("more", F.when(plain <= F.col("at"), plain).otherwise(F.greatest(F.col("at") + 1, with_short)))
    before = (F.col("more") - 1) * block - F.when(F.col("more") - 1 > F.col("at"), block - F.col("short")).otherwise(0)
    p = p.withColumn("cut", F.when(F.col("more") > 0, F.col("rest") - before))
    return p.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("more"))


def draw(quota: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(shard, slot, rank, j): a source for each slot, j numbering its slots.

    A slot's uniform number falls into one of cells of equal width, and meets the
    one or few sources whose share of (0, 1) overlaps that cell.
    """
    spark = quota.sparkSession
    totals = quota.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    shards, cells = -(-totals["n"] // slots), 4096 + totals["k"]
    by_rank = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = quota.select("rank", "slots", (F.sum("slots").over(by_rank) / F.lit(float(max(totals["n"], 1)))).alias("high"), (F.col("slots") / F.lit(float(max(totals["n"], 1)))).alias("width"))
    share = share.withColumn("low", F.lag("high", 1, 0.0).over(Window.orderBy("rank")))
    share = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    # a slot's place in (0, 1) depends on the shard and the slot alone
    tried = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    u = F.pmod(F.xxhash64(F.lit("slot"), "shard", "slot"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    tried = tried.withColumn("u", u).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = tried.join(share, "cell").filter((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    counts = materialize(drawn.groupBy("shard", "rank").agg(F.count("*").alias("n")), "mix-draw")
    # groups of shards, then shards: no window holds all shards of a source
    span = 1 + math.isqrt(shards)
    run = Window.partitionBy("rank", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("group", F.expr(f"shard div {span}")).withColumn("within", F.sum("n").over(run) - F.col("n"))
    groups = counts.groupBy("rank", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("rank", "group", (F.sum("n").over(Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("base"))
    counts = counts.join(groups, ["rank", "group"]).select("shard", "rank", "n", (F.col("base") + F.col("within")).alias("first"))
    kept = counts.join(quota.select("rank", "slots"), "rank").withColumn("n", F.least("n", F.col("slots") - F.col("first"))).filter("n > 0")
    # what chance left of a source's quota follows in closing shards, numbered on
    drawn_n = counts.groupBy("rank").agg(F.sum("n").alias("drawn"))
    left = quota.select("rank", "slots").join(drawn_n, "rank", "left").withColumn("first", F.coalesce("drawn", F.lit(0))).filter("slots > first")
    left = left.select("rank", "first", (F.col("slots") - F.col("first")).alias("n"))
    ahead = F.sum("n").over(by_rank) - F.col("n")
    left = left.withColumn("ahead", ahead).select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"), "first", "ahead")
    closing = left.select((F.lit(shards) + F.expr(f"(ahead + k) div {slots}")).alias("shard"), "rank", (F.col("first") + F.col("k")).alias("j"))
    body = kept.select("shard", "rank", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    return body.unionByName(closing)


def prepared(docs: DataFrame, source: str, text: str) -> DataFrame:
    """doc_id, source, size, nth: rows of one doc_id and source are told apart by nth,
    in the order of size and then of a hash of the text."""
    rows = docs.select("doc_id", F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("h"))
    same = Window.partitionBy("doc_id", "source").orderBy("size", "h")
    return materialize(rows.withColumn("nth", F.row_number().over(same)).drop("h"), "mix-sizes")


def mix(docs: DataFrame, *, source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), block: int = BLOCK, slots: int = SLOTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pieces, slots) of the mix of docs; their size is in words.

    documents: doc_id, source, size, nth, rank, source_size, target, offset;
    pieces: the part of a document in a block: doc_id, source, nth, rank, block,
    start (word of the document), length, at (word of the block); slots: shard,
    rank, j, block, words (of the block from its start, that the slot takes).

    A null source is a source of its own, last; a document of no words takes no
    part but stays in documents; repeated rows are packed one after the other; an
    empty table gives three empty frames; other columns are left out.
    """
    sized = prepared(docs, source, text)
    plan = materialize(source_plan(sized, weights), "mix-plan")
    n = sized.count()
    joined = sized.join(plan.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    placed = materialize(with_offsets(joined.drop("__source", "weight"), 1 + math.isqrt(n)), "mix-placed")
    quota = materialize(quotas(plan, block), "mix-quota")
    length = quota.select("rank", "blocks", "short", "passes", F.col("slots").alias("last"), "cut")
    taken = draw(quota, slots).join(length, "rank")
    taken = taken.withColumn("pass", F.expr("j div blocks")).withColumn("block", permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("rank"), F.col("pass")))
    whole = F.when(F.col("block") == F.col("blocks") - 1, F.col("short")).otherwise(block)
    taken = taken.select("shard", "rank", "j", "block", F.when(F.col("j") == F.col("last") - 1, F.coalesce("cut", whole)).otherwise(whole).alias("words"))
    first, last = F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}")
    pieces = placed.filter("size > 0").select("doc_id", "source", "nth", "rank", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest("offset", F.col("block") * block)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("doc_id", "source", "nth", "rank", "block", (begin - F.col("offset")).alias("start"), (end - begin).alias("length"), (begin - F.col("block") * block).alias("at"))
    return placed, pieces, taken


def taken_words(pieces: DataFrame, taken: DataFrame) -> DataFrame:
    """(rank, doc_id, nth, taken): words of each document that the mix takes, with
    repeats. Slots of a block are counted by length before they meet documents."""
    counts = taken.groupBy("rank", "block", "words").agg(F.count("*").alias("times"))
    per = counts.join(pieces, ["rank", "block"])
    words = F.greatest(F.lit(0), F.least(F.col("length"), F.col("words") - F.col("at"))) * F.col("times")
    return per.groupBy("rank", "doc_id", "nth").agg(F.sum(words).alias("taken"))


def shares(docs: DataFrame, *, source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs."""
    placed, pieces, slots = mix(docs, source=source, text=text, weights=weights)
    got = taken_words(pieces, slots).select(*(F.col(c).alias(f"__{c}") for c in ("rank", "doc_id", "nth", "taken")))
    same = (F.col("rank") == F.col("__rank")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("nth") == F.col("__nth"))
    return placed.join(got, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).alias("taken"))


def mixed_text(docs: DataFrame, *, source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixed corpus: shard, rank, j (slot of the source), at, doc_id, source,
    and text: of that document from its first to its last word in that place, with
    what stands between them (line breaks, indents) as it is in the document.

    Nulls, repeated rows and empty tables are as in mix(); other columns are left out.

    Each document meets its offset once and is cut there into the pieces that fall
    into blocks; pieces then meet the slots by block number."""
    placed, _, slots = mix(docs, source=source, text=text, weights=weights)
    rows = docs.select("doc_id", F.col(source).alias("source"), F.col(text).alias("text"))
    key = [F.col("doc_id").eqNullSafe(F.col("__doc_id")), F.col("source").eqNullSafe(F.col("__source"))]
    side = placed.filter("size > 0").select(F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"), "nth", "rank", "offset", "size")
    again = materialize(placed.filter("nth > 1").select(F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source")).distinct(), "mix-repeats")
    if again.isEmpty():
        whole = rows.join(side, key)
    else:
        # only rows that share doc_id and source are numbered once more
        same = Window.partitionBy("doc_id", "source").orderBy(word_count(F.col("text")), F.xxhash64("text"))
        several = rows.join(again, key, "left_semi").withColumn("__nth", F.row_number().over(same))
        several = several.join(side, [*key, F.col("nth") == F.col("__nth")]).drop("__nth")
        whole = rows.join(again, key, "left_anti").join(side, key).unionByName(several)
    first, last = F.expr(f"offset div {BLOCK}"), F.expr(f"(offset + size - 1) div {BLOCK}")

    def cut(w: Column) -> Column:
        def piece(b: Column) -> Column:
            begin = F.greatest(F.col("offset"), b * BLOCK)
            end = F.least(F.col("offset") + F.col("size"), (b + 1) * BLOCK)
            part = F.slice(w, (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
            return F.struct(b.alias("block"), (begin - b * BLOCK).alias("at"), (end - begin).alias("length"), F.array_join(part, "").alias("part"))

        return F.transform(F.sequence(first, last), piece)

    words = F.regexp_extract_all(F.col("text"), F.lit(SPACED_WORD), F.lit(0))
    pieces = whole.select("doc_id", "source", "rank", F.explode(let(words, cut)).alias("x")).select("doc_id", "source", "rank", "x.*")
    met = slots.join(pieces, ["rank", "block"]).filter("words > at")
    room = (F.col("words") - F.col("at")).cast("int")
    some = F.array_join(F.slice(F.regexp_extract_all(F.col("part"), F.lit(SPACED_WORD), F.lit(0)), F.lit(1), room), "")
    taken = F.rtrim(F.when(room < F.col("length"), some).otherwise(F.col("part")), F.lit(SPACE))
    return met.select("shard", "rank", "j", F.col("at").cast("long"), "doc_id", "source", taken.alias("text"))
