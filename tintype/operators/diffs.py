"""Two releases compared branch by branch over trees of hashes, so that only what differs is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_hashed(df: DataFrame, path: str, key: str, digits: int = 2) -> None:
    """Writes rows by the first ``digits`` digits of their key's hash (256 branches for two), and beside them the tree.

    The tree has a row a leaf (twice the digits): how many rows it has and sums of two hashes of them,
    which depend on neither order nor files. A branch is the sum of its leaves.
    """
    spread = F.sha2(F.coalesce(F.col(key).cast("string"), F.lit("")), 256)
    hashes = [F.xxhash64(F.lit(i), *[F.col(c) for c in sorted(df.columns)]) for i in (1, 2)]
    rows = df.withColumns({"_leaf": F.substring(spread, 1, 2 * digits), "_h1": hashes[0], "_h2": hashes[1]}).withColumn("_branch", F.substring("_leaf", 1, digits))
    rows.repartition("_branch").sortWithinPartitions("_branch", "_leaf").write.partitionBy("_branch").parquet(f"{path}/rows")
    done = df.sparkSession.read.parquet(f"{path}/rows")
    sums = [F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("_h1", "_h2")]
    done.groupBy(F.substring("_leaf", 1, digits).alias("branch"), F.col("_leaf").alias("leaf")).agg(F.count("*").alias("n"), *sums).repartition(1).sortWithinPartitions("leaf").write.parquet(f"{path}/tree")  # 65,536 rows at most for two digits


def _unequal(a: DataFrame, b: DataFrame, level: str) -> list[str]:
    """The places of a level of two trees whose sums differ: a bounded list."""
    sums = [t.groupBy(level).agg(F.sum("n").alias("n"), F.sum("_h1").alias("x"), F.sum("_h2").alias("y")) for t in (a, b)]
    both = sums[0].alias("a").join(sums[1].alias("b"), level, "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.y").eqNullSafe(F.col("b.y"))
    return [r[0] for r in both.where(~same).select(level).collect()]


def differing(spark: SparkSession, before: str, after: str) -> tuple[list[str], list[str]]:
    """(branches, leaves) that two hashed releases don't share; leaves are compared in differing branches only."""
    trees = [spark.read.parquet(f"{p}/tree") for p in (before, after)]
    branches = _unequal(*trees, "branch")
    return branches, _unequal(*[t.where(F.col("branch").isin(branches)) for t in trees], "leaf") if branches else []


def compare_releases(spark: SparkSession, before: str, after: str, key: str) -> DataFrame:
    """(key, change): the keys of added, removed and changed rows; rows of one key are compared as a whole.

    Reads the trees, and of the rows only the differing leaves of the differing branches. Both
    releases were written with the same number of digits.
    """
    branches, leaves = differing(spark, before, after)
    digits = max(map(len, branches), default=1)

    def part(path: str) -> DataFrame:
        rows = spark.read.parquet(f"{path}/rows")
        rows = rows.withColumn("_branch", F.col("_branch").cast("string")).where(F.lpad("_branch", digits, "0").isin(branches) & F.col("_leaf").isin(leaves))
        return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("_h1").cast("decimal(38,0)")).alias("x"), F.sum(F.col("_h2").cast("decimal(38,0)")).alias("y"))

    a, b = part(before).alias("a"), part(after).alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.x").eqNullSafe(F.col("b.x")) & F.col("a.y").eqNullSafe(F.col("b.y"))
    change = F.when(F.col("a.n").isNull(), "added").when(F.col("b.n").isNull(), "removed").otherwise("changed")
    return both.where(~same).select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), change.alias("change"))
