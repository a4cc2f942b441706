"""Splits that no relation crosses: groups over several relations, and whole groups dealt by size."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.functions.scalars import seeded_order
from tintype.operators.components import connected_components
from tintype.operators.near import hash_links
from tintype.plans.worktables import write_table

#: Groups of more than one part in LARGE of all rows are dealt one by one; there are fewer than LARGE of them.
LARGE = 1000


class Near(NamedTuple):
    """A column of perceptual hashes, their bits, and how many may differ."""

    hash: str
    bits: int
    distance: int


def leak_free_groups(df: DataFrame, id: str, same: list[str], near: Near | None = None) -> DataFrame:
    """(id, group): rows that are related, be it over others, have one group, named by its least id.

    Rows are related that are equal in a column of ``same``, or near in the hash; nulls relate
    nothing. Every value is a star about its least id, so a value that a third of the rows share
    gives a link a row; near hashes hand on stars too.
    """
    rows = write_table(df.select(id, *same, *([near.hash] if near else [])), "related-rows")

    def stars(column: str) -> tuple[DataFrame, DataFrame]:
        least = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(id).alias("b"))
        return rows.join(least, column).select(F.col(id).alias("a"), "b"), least

    edges = [stars(c)[0] for c in same]
    if near:
        own, least = stars(near.hash)
        least = write_table(least, "least-ids")
        links = hash_links(rows, near.hash, near.bits, near.distance)
        ends = [least.select(F.col(near.hash).alias(k), F.col("b").alias(f"{k}_id")) for k in ("a", "b")]
        edges += [own, links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))]
    every = edges[0]
    for e in edges[1:]:
        every = every.unionAll(e)
    found = connected_components(every)
    return rows.select(id).join(found, F.col(id) == F.col("node"), "left").select(id, F.coalesce("component", id).alias("group"))


def split_by_size(df: DataFrame, group: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Adds split: whole groups, so dealt that each split has its share of the rows as nearly as the groups' sizes allow.

    Groups over one LARGE-th of all rows go, largest first, to the split that lacks most. The others
    are put in a seeded order and cut where the splits are full. The order is of 65,536 slices by
    hash, whose sums are all that is put in line, so no task sees all groups. A null group is a group.
    """
    spark, names = df.sparkSession, list(shares)
    sizes = write_table(df.groupBy(group).agg(F.count("*").alias("n")), "group-sizes")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lack = {s: shares[s] / sum(shares.values()) * total for s in names}
    large = sizes.where(F.col("n") * LARGE > total)
    dealt = []
    for r in large.orderBy(F.desc("n"), group).collect():
        to = max(names, key=lambda s: lack[s])
        lack[to] -= r["n"]
        dealt.append((r[group], to))
    first = spark.createDataFrame(dealt, f"`{group}` {sizes.schema[group].dataType.simpleString()}, split string")
    small = sizes.where(F.col("n") * LARGE <= total).withColumn("_s", F.substring(seeded_order(F.col(group).cast("string"), F.lit(str(seed))), 1, 4))
    slices = small.groupBy("_s").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    middle = before + F.col("n") / 2
    room = {s: max(0.0, lack[s]) for s in names}
    rest = total - sum(shares[s] / sum(shares.values()) * total - lack[s] for s in names)
    scale = rest / sum(room.values()) if sum(room.values()) else 0.0
    to, end = F.lit(names[-1]), sum(room.values()) * scale
    for s in reversed(names):
        to = F.when(middle < end, s).otherwise(to) if room[s] else to
        end -= room[s] * scale
    places = slices.select("_s", to.alias("split"))
    second = small.join(F.broadcast(places), "_s").select(group, "split")  # 65,536 slices at most
    by_group = first.unionByName(second).withColumnRenamed(group, "_group")
    return df.join(by_group, F.col(group).eqNullSafe(F.col("_group"))).select(*df.columns, "split")


def crossing(df: DataFrame, relation: str, split: str = "split") -> DataFrame:
    """(relation, crossing): how many values of a column stand in more than one split."""
    per = df.where(F.col(relation).isNotNull()).groupBy(relation).agg(F.count_distinct(split).alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("crossing")).select(F.lit(relation).alias("relation"), "crossing")
