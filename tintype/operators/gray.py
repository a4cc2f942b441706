"""Pixel statistics of small gray images as column expressions over arrays of pixels (row-major)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.functions.scalars import let, rounded


def total(px: Column, of=lambda x: x) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + of(x.cast("double")))


def mean(px: Column) -> Column:
    return F.try_divide(total(px), F.size(px))


def variance(px: Column) -> Column:
    """Population variance of whole numbers, from their exact sums."""
    n = F.size(px).cast("double")
    return F.try_divide(total(px, lambda x: x * x) * n - total(px) * total(px), n * n)


def laplacian(px: Column, width: int, height: int) -> Column:
    """4-neighbour Laplacian with reflected borders (-1 is 1, n is n - 2)."""

    def at(px: Column, y: Column, x: Column) -> Column:
        r = F.when(y < 0, -y).when(y >= height, 2 * height - 2 - y).otherwise(y)
        c = F.when(x < 0, -x).when(x >= width, 2 * width - 2 - x).otherwise(x)
        return F.get(px, (r * width + c).cast("int"))

    def cell(p: Column, i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        return at(p, y - 1, x) + at(p, y + 1, x) + at(p, y, x - 1) + at(p, y, x + 1) - 4 * at(p, y, x)

    return let(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: cell(p, i)))


def dhash(px: Column, width: int, height: int) -> Column:
    """Bits "right brighter than left", row-major, first bit highest."""
    cells = F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: i % width < width - 1)
    bits = let(px, lambda p: F.transform(cells, lambda i: (F.get(p, i + 1) > F.get(p, i)).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a * 2 + b)


def gray8(embeddings: DataFrame) -> DataFrame:
    """Embeddings as 8x8 gray images: (img_id, label, px)."""
    px = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.55) * 230))).cast("int"))
    return embeddings.select(F.col("vec_id").alias("img_id"), "label", px.alias("px"))


def image_stats(images: DataFrame, width: int = 8, height: int = 8) -> DataFrame:
    """(img_id, brightness, contrast, sharpness) of gray images, three digits."""
    lap = images.withColumn("lap", laplacian(F.col("px"), width, height))
    return lap.select("img_id", rounded(mean(F.col("px"))).alias("brightness"), rounded(F.sqrt(variance(F.col("px")))).alias("contrast"), rounded(variance(F.col("lap"))).alias("sharpness"))


def noref_quality(images: DataFrame) -> DataFrame:
    """(img_id, contrast, snr, proxy): standard deviation, 20 log10(mean / std) (40 for a flat image), max(0, 20 - std / 2)."""
    std = F.sqrt(variance(F.col("px")))
    snr = F.when(std == 0, 40.0).otherwise(20 * F.log10(F.try_divide(mean(F.col("px")), std)))
    return images.select("img_id", rounded(std).alias("contrast"), rounded(snr).alias("snr"), rounded(F.greatest(F.lit(0.0), 20 - std / 2)).alias("proxy"))


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """(img_id, mae, psnr, shift, size_match) of pairs (img_id, a, b); PSNR is 99 for equal images, metrics are null for unequal sizes."""
    same = F.size("a") == F.size("b")
    d = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    n = F.size("a")
    mse = total(d, lambda x: x * x) / n
    psnr = F.when(mse == 0, 99.0).otherwise(20 * F.log10(255 / F.sqrt(mse)))
    return pairs.select(
        "img_id", F.when(same, rounded(total(d) / n)).alias("mae"), F.when(same, rounded(psnr)).alias("psnr"), F.when(same, rounded(F.abs(mean(F.col("a")) - mean(F.col("b"))))).alias("shift"), same.alias("size_match")
    )


def mask_coverage(masks: DataFrame) -> DataFrame:
    """(img_id, soft, hard): mean / 255 in percent, and the fraction of pixels over 127."""
    over = F.size(F.filter("px", lambda x: x > 127))
    return masks.select("img_id", rounded(mean(F.col("px")) / 255 * 100).alias("soft"), rounded(over / F.size("px"), 6).alias("hard"))


def difference_mask(pairs: DataFrame, threshold: int = 20) -> DataFrame:
    """(img_id, masked): how many pixels of a pair differ by more than the threshold."""
    return pairs.select("img_id", F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda d: d > threshold)).alias("masked"))


def blend(pairs: DataFrame, alpha: float) -> DataFrame:
    """(img_id, px): the restored image ``b`` over the original ``a``; alpha of 1 or more is b, 0 or less is a."""
    if alpha >= 1:
        return pairs.select("img_id", F.col("b").alias("px"))
    if alpha <= 0:
        return pairs.select("img_id", F.col("a").alias("px"))
    return pairs.select("img_id", F.zip_with("a", "b", lambda x, y: F.floor(x * (1 - alpha) + y * alpha).cast("int")).alias("px"))


def sliding_windows(images: DataFrame, size: int, stride: int, width: int = 8, height: int = 8) -> DataFrame:
    """(img_id, y, x, patch): windows whose corner is a multiple of the stride and that lie inside the image."""
    ys, xs = (F.sequence(F.lit(0), F.lit(n - size), F.lit(stride)) for n in (height, width))
    at = images.select("img_id", "px", F.explode(ys).alias("y")).select("img_id", "px", "y", F.explode(xs).alias("x"))
    rows = F.sequence(F.lit(0), F.lit(size - 1))
    patch = let(F.col("px"), lambda p: F.flatten(F.transform(rows, lambda r: F.slice(p, ((F.col("y") + r) * width + F.col("x") + 1).cast("int"), F.lit(size)))))
    return at.select("img_id", "y", "x", patch.alias("patch"))


def stitch_windows(scored: DataFrame, size: int, threshold: float) -> DataFrame:
    """(img_id, y, x, prob, hit): the mean probability of the windows over each pixel, and whether it is over the threshold."""
    inside = F.sequence(F.lit(0), F.lit(size - 1))
    cells = scored.select("img_id", F.explode(F.transform(inside, lambda i: F.col("y") + i)).alias("y"), "x", "prob")
    cells = cells.select("img_id", "y", F.explode(F.transform(inside, lambda i: F.col("x") + i)).alias("x"), "prob")
    return cells.groupBy("img_id", "y", "x").agg(F.avg("prob").alias("p")).select("img_id", "y", "x", rounded(F.col("p"), 6).alias("prob"), (F.col("p") > threshold).alias("hit"))


def threshold_mask(scored: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Adds mask: 255 where the probability reaches the threshold, else 0."""
    return scored.withColumn("mask", F.when(F.col("prob") >= threshold, 255).otherwise(0))


def patch_statistics(patches: DataFrame) -> DataFrame:
    """Adds mean, std, lo, hi of a patch, and its entropy over 16 equal bins of 0 to 255."""
    px = F.col("patch")
    share = let(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(p, lambda x: F.floor(x / 16) == b)) / F.size(p)))
    entropy = -F.aggregate(share, F.lit(0.0), lambda a, p: a + p * F.log2(p + 1e-7))
    return patches.withColumns(
        {"mean": rounded(mean(px)), "std": rounded(F.sqrt(variance(px)) + 1e-7), "lo": F.array_min(px), "hi": F.array_max(px), "entropy": rounded(entropy)}
    )


def texture_stats(images: DataFrame, by: str) -> DataFrame:
    """(by, images, brightness, brightness_std, contrast): means over images, with the population deviation."""
    rows = images.select(by, mean(F.col("px")).alias("m"), F.sqrt(variance(F.col("px"))).alias("s"))
    return rows.groupBy(by).agg(F.count("*").alias("images"), rounded(F.avg("m")).alias("brightness"), rounded(F.stddev_pop("m")).alias("brightness_std"), rounded(F.avg("s")).alias("contrast"))


def labelled_patches(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.withColumn("target", F.lit(1)).unionByName(negative.withColumn("target", F.lit(0)))
