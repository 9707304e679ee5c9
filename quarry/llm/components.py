"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import materialize, release


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b), root the smallest node reachable.

    Rounds alternate two steps on edges directed from larger to smaller nodes: a
    node hands the smallest of all its neighbours to its larger neighbours, then
    the smallest of its smaller neighbours to the others of these. Both keep the
    components and shrink them to stars in few rounds. Minima are aggregated
    before they are shuffled, and no step lists a node's neighbours in one row.
    Each round is written to the shared folder, so a lost executor costs a task.

    Null ends and loops add nothing; repeated edges count once.
    """
    clean = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = materialize(clean.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large step: for each node u, larger neighbours v get (v, m)
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small step: for each node u, smaller neighbours v and u itself get (v, m)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        done = digest(then) == digest(now)
        release(now)
        now = then
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def digest(edges: DataFrame) -> tuple:
    """Count and order-free sums of hashes of an edge table."""
    part = F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))
    return tuple(edges.agg(F.count("*"), F.sum(part), F.bit_xor(F.xxhash64("v", "u"))).first())
