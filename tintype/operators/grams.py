"""Substring search by equality joins: grams of texts, and the least names that hold fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.functions.scalars import let

#: Characters of a gram.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of ``size`` characters of a text; none for a shorter one."""
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return let(text, lambda t: F.array_distinct(F.transform(spots, lambda i: F.substr(t, i, F.lit(size)))))


def least_containing(fragments: DataFrame, names: DataFrame, fragment: str = "fragment", name: str = "name") -> DataFrame:
    """(fragment, name): for each distinct fragment the least name that holds it; fragments that none holds are missing.

    A fragment of length n has the size s, the largest power of two up to n, and is in a name if a
    window of 2s - 1 characters of that name starts with it. So names are cut into their windows of
    the sizes asked for, equal windows keep their least name, and the windows whose first s characters
    are those of a fragment give their beginnings of the lengths of such fragments. All joins are of
    equal strings with one row a key on one side: no fragment meets a name that doesn't hold its
    head, and the work grows with the names' characters however common these are. The empty fragment
    (size 0) is in every name, a null one in none.

    A string is several times as large as Spark thinks after an explode, so the joins are told to
    sort and merge: a broadcast would bring all windows to the driver.
    """
    size = F.when(F.length("fragment") > 0, F.pow(F.lit(2), F.length(F.bin(F.length("fragment"))) - 1)).otherwise(0).cast("int")
    asked = fragments.select(F.col(fragment).alias("fragment")).where("fragment is not null").distinct().withColumn("size", size)
    heads = asked.groupBy("size", F.expr("left(fragment, size)").alias("head")).agg(F.collect_set(F.length("fragment")).alias("lengths"))
    sizes = F.broadcast(asked.agg(F.collect_set("size").alias("sizes")))  # one row of 32 numbers at most
    known = names.select(F.col(name).alias("name")).where("name is not null").crossJoin(sizes).select("name", F.explode("sizes").alias("size"))
    starts = F.when(F.col("size") == 0, F.array(F.lit(1))).when(F.length("name") >= F.col("size"), F.sequence(F.lit(1), F.length("name") - F.col("size") + 1))
    windows = known.select("name", "size", F.explode(starts).alias("at")).groupBy("size", F.expr("substr(name, at, greatest(2 * size - 1, 0))").alias("window")).agg(F.min("name").alias("name"))
    met = windows.withColumn("head", F.expr("left(window, size)")).join(heads.hint("merge"), ["size", "head"])
    runs = met.select("name", "window", F.explode(F.filter("lengths", lambda n: n <= F.length("window"))).alias("length"))
    least = runs.groupBy(F.expr("left(window, length)").alias("fragment")).agg(F.min("name").alias("name"))
    return asked.select("fragment").join(least.hint("merge"), "fragment")
