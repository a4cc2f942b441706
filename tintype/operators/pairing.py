"""Joins of files, pairs, masks and configurations, and the train/test splits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.functions.scalars import group_bucket, seeded_order, stem
from tintype.operators.grams import least_containing
from tintype.operators.intake import ranked
from tintype.plans.worktables import spread

#: Rows of a table that is broadcast without looking at its size: a configuration grid, a texture list.
SMALL = 10_000


def _small(df: DataFrame, what: str) -> DataFrame:
    """``df`` for a broadcast, after its size has been checked."""
    if len(df.limit(SMALL + 1).toArrow()) > SMALL:
        raise ValueError(f"{what}: more than {SMALL} rows")
    return F.broadcast(df)


def attach_files(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifest rows with a file, and those without."""
    names = files.select("filename").distinct()
    return manifest.join(names, "filename", "left_semi"), manifest.join(names, "filename", "left_anti")


def pair_images(clean: DataFrame, degraded: DataFrame) -> DataFrame:
    """(name, clean_key, degraded_key) of equal file names."""
    return clean.select(F.col("filename").alias("name"), F.col("p_partkey").alias("clean_key")).join(degraded.select(F.col("filename").alias("name"), F.col("p_partkey").alias("degraded_key")), "name")


def attach_masks(pairs: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds mask: the least mask name of the same stem, null for none."""
    by = masks.groupBy(stem(F.col("filename")).alias("_stem")).agg(F.min("filename").alias("mask"))
    return pairs.join(by, stem(pairs["name"]) == by["_stem"], "left").drop("_stem")


def new_items(items: DataFrame, known: DataFrame, id: str = "id", content: str = "sha256") -> DataFrame:
    """Items whose id and content are both unknown."""
    return items.join(known.select(id), id, "left_anti").join(known.select(content), content, "left_anti").select(*items.columns)


def pending(inputs: DataFrame, outputs: DataFrame, key: str = "filename", seed: int | None = None) -> DataFrame:
    """Inputs without output, with the number (from 1) and seed they had among all inputs."""
    numbered = item_seed(inputs, seed, key)
    return numbered.join(outputs.select(key).distinct(), key, "left_anti")


def addressed(inputs: DataFrame, params: dict, content: str = "sha256") -> DataFrame:
    """Adds address: the hash of an input's content and of all parameters of its job, by which its output is named."""
    known = json.dumps(params, sort_keys=True, ensure_ascii=True)
    return inputs.withColumn("address", F.sha2(F.concat_ws("|", F.coalesce(content, F.lit("")), F.lit(known)), 256))


def pending_by_content(inputs: DataFrame, outputs: DataFrame, params: dict, content: str = "sha256") -> DataFrame:
    """Inputs, with their addresses, that have no output of this content under these parameters.

    Existence of a name can't tell that a parameter or a file has changed; an address can, so only
    what has changed is done again. ``outputs`` has the addresses of what is there.
    """
    return addressed(inputs, params, content).join(outputs.select("address").distinct(), "address", "left_anti").select(*inputs.columns, "address")


def item_seed(df: DataFrame, seed: int | None, key: str = "filename") -> DataFrame:
    """Adds seq (from 1, by name) and item_seed (seq + seed; null without seed)."""
    return ranked(df, key).withColumn("seq", F.col("row") + 1).withColumn("item_seed", F.col("seq") + F.lit(seed).cast("long")).drop("row")


def leak_exact(df: DataFrame, key: str = "sha256") -> DataFrame:
    """(key, splits, rows) of contents that stand in more than one split."""
    return df.groupBy(key).agg(F.count_distinct("split").alias("splits"), F.count("*").alias("rows")).where("splits > 1")


def training_samples(pairs: DataFrame, conditions: DataFrame, masks: DataFrame) -> DataFrame:
    """(name, has_condition, has_mask) of all pairs, joined by name."""
    c, m = conditions.select("name").distinct().withColumn("c", F.lit(True)), masks.select("name").distinct().withColumn("m", F.lit(True))
    return pairs.join(c, "name", "left").join(m, "name", "left").select("name", F.coalesce("c", F.lit(False)).alias("has_condition"), F.coalesce("m", F.lit(False)).alias("has_mask"))


def sweep_grid(images: DataFrame, configs: DataFrame) -> DataFrame:
    """Every image under every configuration."""
    return images.crossJoin(_small(configs, "configurations"))


def match_reference(damaged: DataFrame, clean: DataFrame, extension: bool = False) -> DataFrame:
    """(damaged, reference): the least clean name of a known collection that holds the damaged file's base name; null for none.

    The base is what stands after the first ``_dmg_`` (up to a second one), or the whole name without
    one; with ``extension`` the file's extension belongs to it. The match is by windows of the names,
    see ``least_containing``: joins of equal strings, none of which is broadcast.
    """
    name = F.col("filename") if extension else stem(F.col("filename"))
    parts = F.split(name, "_dmg_")
    asked = damaged.select(F.col("filename").alias("damaged"), F.coalesce(F.get(parts, F.lit(1)), name).alias("base"))
    known = clean.where(F.startswith("filename", F.lit("europ_9")) | F.startswith("filename", F.lit("met_")))
    least = least_containing(asked, known, "base", "filename").select(F.col("fragment").alias("base"), F.col("name").alias("reference"))
    return asked.join(least.hint("merge"), "base", "left").groupBy("damaged").agg(F.min("reference").alias("reference"))


def assign_textures(images: DataFrame, textures: DataFrame, k: int, seed: int) -> DataFrame:
    """(filename, slot, texture): k textures for each image (or all there are), in an order seeded by image, texture and seed.

    Every texture is hashed for every image, so the images' names, which a few tasks read, are dealt over many.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    every = F.broadcast(_small(textures, "textures").agg(F.sort_array(F.collect_list("texture")).alias("all")))  # one row, of as many textures as were counted
    order = F.array_sort(F.transform("all", lambda t: F.struct(seeded_order("filename", t, F.lit(str(seed))).alias("o"), t.alias("texture"))))
    return spread(images).crossJoin(every).select("filename", F.posexplode(F.slice(order, 1, k)).alias("slot", "x")).select("filename", "slot", "x.texture")


def split_linspace(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds split: ``n`` evenly spaced rows (in order, the first and last among them) are test."""
    rows = ranked(df, order)
    total = rows.agg(F.count("*").alias("N"))
    many = F.least(F.greatest(F.lit(1), F.lit(n)), F.col("N") - 1)
    # int(i * step) for some i; the candidates next to row / step are tried
    step = (F.col("N") - 1) / F.greatest(many - 1, F.lit(1))
    guess = F.floor(F.col("row") / step)
    hit = F.array(guess, guess + 1)
    picked = F.exists(hit, lambda i: (i < many) & (F.when(i == many - 1, F.col("N") - 1).otherwise(F.floor(i * step)) == F.col("row")))
    test = F.when(many == 1, F.col("row") == 0).otherwise(picked)
    return rows.crossJoin(F.broadcast(total)).withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def split_stride(df: DataFrame, n: int, order: str) -> DataFrame:
    """Adds split: every k-th row is test until there are ``n``; k = max(1, rows div n)."""
    rows = ranked(df, order).crossJoin(F.broadcast(df.agg(F.greatest(F.lit(1), F.floor(F.count("*") / n)).alias("k"))))
    test = (F.col("row") % F.col("k") == 0) & (F.floor(F.col("row") / F.col("k")) < n)
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def split_random(df: DataFrame, key: str, seed: int, most: int = 10) -> DataFrame:
    """Adds split: the first min(``most``, rows div 10) by seeded hash are test."""
    total = df.count()
    chosen = df.select(key).orderBy(seeded_order(key, F.lit(str(seed))), key).limit(min(most, total // 10)).withColumn("_test", F.lit(True))
    return df.join(F.broadcast(chosen), key, "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def split_by_group(df: DataFrame, group: str = "source_id", seed: int = 42) -> DataFrame:
    """Adds split: 80/10/10 by a bucket of the group, so all rows of a group stay together."""
    b = group_bucket(F.col(group), seed)
    return df.withColumn("split", F.when(b < 80, "train").when(b < 90, "validation").otherwise("test"))


def split_named(df: DataFrame, names: DataFrame, key: str = "filename") -> DataFrame:
    """Adds split: rows of the named files are test."""
    chosen = names.select(key).distinct().withColumn("_test", F.lit(True))
    return df.join(chosen, key, "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).select(*df.columns, "split")


def review_sample(df: DataFrame, stratum: str, key: str, rate: float, least: int, seed: int) -> DataFrame:
    """A seeded sample of each stratum: max(``least``, ceil(rate * rows)) rows, the first by hash and key.

    Hashes are counted by their leading 16 bits; the counts tell in which slice of a stratum the
    sample ends. Rows of the slices before it are taken as they are, and only that slice is ranked,
    so a stratum with a third of all rows is never sorted in one task.
    """
    order = seeded_order(key, F.lit(str(seed)))
    rows = df.withColumns({"_o": order, "_b": F.substring(order, 1, 4)})
    slices = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    upto = W.partitionBy(stratum).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = slices.withColumns({"_to": F.sum("_c").over(upto), "_n": F.sum("_c").over(W.partitionBy(stratum))})
    ends = ends.withColumn("_left", F.greatest(F.lit(least), F.ceil(F.col("_n") * rate)) - (F.col("_to") - F.col("_c")))
    taken = ends.where("_left > 0").select(F.col(stratum).alias("_s"), F.col("_b").alias("_sb"), "_left", (F.col("_left") >= F.col("_c")).alias("_whole"))
    near = rows.join(taken, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    place = F.row_number().over(W.partitionBy(stratum, "_b").orderBy("_o", key))
    last = near.where("not _whole").withColumn("_r", place).where("_r <= _left")
    return near.where("_whole").select(*df.columns).unionByName(last.select(*df.columns))


def head_sorted(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)
