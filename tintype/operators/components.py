"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.plans.worktables import drop_table, write_table


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round on edges (u, v), u > v: every node's neighbours are hung on its least neighbour."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = both.join(least, "u")
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component), component being the least node reachable, for every node of an edge.

    Edges may repeat and run either way; loops and edges with a null end count as no edge.
    Every round joins edges with one row per node, is pre-aggregated before each shuffle, and is
    written to the shared work folder, so a lost executor costs a round at most. Rounds go on until
    the edge set no longer changes; the number grows with the logarithm of the longest chain.
    """
    now = write_table(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct(),
        "edges",
    )

    def digest(t: DataFrame):
        return t.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    seen = digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        then = write_table(_stars(_stars(now, True), False), "edges")
        drop_table(now)
        now, old, seen = then, seen, digest(then)
        if old == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
