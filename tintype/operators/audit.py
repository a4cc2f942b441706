"""Audit of image tables: summaries, duplicate groups, flags and pair reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.functions.scalars import rounded, stem, variant_base
from tintype.plans.worktables import write_table


def quantiles(df: DataFrame, value: str, fractions: list[float], by: list[str]) -> DataFrame:
    """(by…, p): the exact quantiles of each group, interpolated between neighbours, as an array in the order of ``fractions``; nulls don't count.

    Distinct values are counted by partial sums, dealt by range of group and value, and numbered
    within a range; the ranges' sums give the offsets. So no task holds a group, however large.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parts = write_table(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()), "values")
    group = [F.col(c) for c in by]
    sums = parts.groupBy(*by, "_part").agg(F.sum("_c").alias("_s"))
    before = F.coalesce(F.sum("_s").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), before.alias("_before"), F.sum("_s").over(W.partitionBy(*group)).alias("_n"))  # a row a range
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    upto = F.sum("_c").over(W.partitionBy("_part", *group).orderBy("_v"))
    placed = parts.withColumn("_to", upto).join(offsets, same).withColumn("_last", F.col("_before") + F.col("_to") - 1).withColumn("_first", F.col("_last") - F.col("_c") + 1)
    at = [F.lit(float(f)) * (F.col("_n") - 1) for f in fractions]
    part = lambda place, weight: F.sum(F.when(place.between(F.col("_first"), F.col("_last")), F.col("_v").cast("double") * weight))
    lower, upper = [F.floor(x) for x in at], [F.ceil(x) for x in at]
    hit = F.lit(False)
    for place in (*lower, *upper):
        hit |= place.between(F.col("_first"), F.col("_last"))
    p = [part(lo, F.when(lo == hi, F.lit(1.0)).otherwise(hi - x)) + F.coalesce(part(hi, F.when(lo == hi, F.lit(0.0)).otherwise(x - lo)), F.lit(0.0)) for x, lo, hi in zip(at, lower, upper, strict=True)]
    return placed.where(hit).groupBy(*by).agg(F.array(*p).alias("p"))


def describe(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """(by…, column, min, median, max, mean), three digits; exact medians by interpolation."""
    stacked = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select(*by, "x.*")
    keys = [*by, "column"]
    ends = stacked.groupBy(*keys).agg(rounded(F.min("v")).alias("min"), rounded(F.max("v")).alias("max"), rounded(F.avg("v")).alias("mean"))
    return with_quantiles(ends, stacked, "v", [0.5], keys).select(*keys, "min", rounded(F.col("p")[0]).alias("median"), "max", "mean")


def with_quantiles(groups: DataFrame, df: DataFrame, value: str, fractions: list[float], by: list[str]) -> DataFrame:
    """``groups`` with p, the quantiles of their values in ``df``; null for a group without values."""
    q = quantiles(df, value, fractions, by).select(*[F.col(c).alias(f"_q_{c}") for c in by], "p")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return groups.join(q, same, "left").drop(*[f"_q_{c}" for c in by])


def percentiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, min, p10, median, p90, max, mean), three digits."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    ends = stacked.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    return with_quantiles(ends, stacked, "v", [0.1, 0.5, 0.9], ["column"]).select(
        "column", rounded(F.col("lo")).alias("min"), *[rounded(F.col("p")[i]).alias(n) for i, n in enumerate(("p10", "median", "p90"))], rounded(F.col("hi")).alias("max"), rounded(F.col("mean")).alias("mean")
    )


def duplicate_groups(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """(key, copies, first_name) of every value held by two rows or more; members are found by joining on the key, so no group is gathered."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("copies"), F.min(name).alias("first_name")).where("copies > 1")


def duplicate_members(df: DataFrame, key: str, name: str = "id") -> DataFrame:
    """One row a member of each duplicate group: key, name."""
    return df.select(key, name).join(duplicate_groups(df, key, name).select(key), key, "left_semi")


def flag_geometry(df: DataFrame) -> DataFrame:
    """Adds the size and aspect flags; aspects are judged as rounded to four digits."""
    aspect = rounded(F.try_divide("width", "height"), 4)
    return df.withColumns(
        {f"under_{n}": (F.col("width") < n) | (F.col("height") < n) for n in (256, 512)} | {"extreme_aspect": (aspect < 0.45) | (aspect > 2.2)}
    )


def flag_masks(df: DataFrame, coverage: str = "coverage") -> DataFrame:
    """(empty, under_1, over_20, in_window, masks): how many masks have which coverage (a fraction)."""
    c = F.col(coverage)
    return df.agg(F.count_if(c == 0).alias("empty"), F.count_if(c < 0.01).alias("under_1"), F.count_if(c > 0.20).alias("over_20"), F.count_if(c.between(0.01, 0.35)).alias("in_window"), F.count("*").alias("masks"))


def top_counts(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def variant_pairing(clean: DataFrame, damaged: DataFrame, degraded: DataFrame) -> DataFrame:
    """(check, name): clean names without damaged, damaged without clean, clean without degraded variant."""
    c, d = clean.select(stem(F.col("filename")).alias("name")).distinct(), damaged.select(stem(F.col("filename")).alias("name")).distinct()
    v = degraded.select(variant_base(F.col("filename")).alias("name")).distinct()
    parts = [("clean_without_damaged", c, d), ("damaged_without_clean", d, c), ("clean_without_degraded", c, v)]
    out = [a.join(b, "name", "left_anti").select(F.lit(label).alias("check"), "name") for label, a, b in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def variant_histogram(degraded: DataFrame) -> DataFrame:
    """(variants, bases): how many base names have how many variants."""
    per = degraded.groupBy(variant_base(F.col("filename")).alias("base")).agg(F.count("*").alias("variants"))
    return per.groupBy("variants").agg(F.count("*").alias("bases"))


def compare_content(main: DataFrame, other: DataFrame, key: str = "sha256") -> DataFrame:
    """One row: distinct contents on both sides, how many are only in one, whether ``other`` is a subset."""
    m, o = main.where(F.col(key).isNotNull()).select(key).distinct(), other.where(F.col(key).isNotNull()).select(key).distinct()
    both = m.withColumn("m", F.lit(1)).join(o.withColumn("o", F.lit(1)), key, "full")
    return both.agg(
        F.count("m").alias("main_distinct"), F.count("o").alias("other_distinct"), F.count_if(F.col("o").isNull()).alias("only_main"), F.count_if(F.col("m").isNull()).alias("only_other")
    ).withColumn("other_is_subset", F.col("only_other") == 0)


def run_report(df: DataFrame) -> DataFrame:
    """Total, successes and errors of a batch run; every failure has its row."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("success"), F.count_if(F.col("status") == "error").alias("errors"))
