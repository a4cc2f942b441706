"""A classifier of image patches: texture features, a random forest, scoring."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.functions.scalars import seeded_order
from tintype.operators import kernels
from tintype.operators.images import pixels
from tintype.plans.worktables import spread, write_table

SIZE = 32

#: Rows of a task that trains, and forests that are trained at once.
TASK_ROWS, AT_ONCE = 100_000, 8


def gabor_bank(size: int) -> np.ndarray:
    """Kernels (72, n, n) of eight directions, three widths and three wavelengths; n is the odd number from ``size`` on."""
    half = size // 2
    y, x = np.mgrid[-half : half + 1, -half : half + 1].astype(np.float64)
    out = []
    for theta in np.arange(8) * np.pi / 8:
        u, v = x * np.cos(theta) + y * np.sin(theta), y * np.cos(theta) - x * np.sin(theta)
        for sigma in (1.0, 2.0, 3.0):  # fixed values, as are the wavelengths
            for wavelength in (3.0, 5.0, 8.0):
                out.append(np.exp(-(u * u + 0.25 * v * v) / (2 * sigma * sigma)) * np.cos(2 * np.pi * u / wavelength))
    return np.array(out)


@cache
def spectra_of(size: int) -> np.ndarray:
    """Conjugate spectra of the bank, for patches of ``size`` grown by the kernels' reach on all sides."""
    n = size + 2 * (size // 2)
    return np.conj(np.fft.rfft2(gabor_bank(size), s=(n, n)))


def gabor_responses(p: np.ndarray) -> np.ndarray:
    """Correlation of a patch (size, size), or of each of an array of patches, with each kernel, borders mirrored about the edge pixels."""
    size = p.shape[-1]
    grown = np.pad(p.astype(np.float64), [(0, 0)] * (p.ndim - 2) + [(size // 2, size // 2)] * 2, mode="reflect")
    return np.fft.irfft2(np.fft.rfft2(grown)[..., None, :, :] * spectra_of(size), s=grown.shape[-2:])[..., :size, :size]


def local_patterns(p: np.ndarray) -> np.ndarray:
    """Codes of the first eight of twenty-four neighbours on a circle of radius three, taken against the angle's direction; those outside count as 0."""
    h, w = p.shape[-2:]
    wide = np.pad(p, [(0, 0)] * (p.ndim - 2) + [(3, 3)] * 2)
    code = np.zeros(p.shape, np.uint8)
    for n in range(8):
        dy, dx = (int(np.rint(3 * f(2 * np.pi * n / 24))) for f in (np.sin, np.cos))
        code |= (wide[..., 3 - dy : 3 - dy + h, 3 - dx : 3 - dx + w] >= p).astype(np.uint8) << n
    return code


def gradients(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along x and y, borders mirrored about the edge pixels."""
    g = np.pad(p.astype(np.float32), [(0, 0)] * (p.ndim - 2) + [(1, 1)] * 2, mode="reflect")
    x, y = g[..., 2:] - g[..., :-2], g[..., 2:, :] - g[..., :-2, :]
    return x[..., :-2, :] + 2 * x[..., 1:-1, :] + x[..., 2:, :], y[..., :-2] + 2 * y[..., 1:-1] + y[..., 2:]


def shares(bin_of: np.ndarray, bins: int) -> np.ndarray:
    """Share of each bin among the values of a row, whose bins are given."""
    n = len(bin_of)
    counts = np.bincount((bin_of + bins * np.arange(n)[:, None]).ravel(), minlength=n * bins).reshape(n, bins)
    return counts / (counts.sum(axis=1, keepdims=True) + 1e-7)


def block_features(x: np.ndarray, side: int = 8) -> list[float]:
    """Spread of the means of 8x8 blocks, and mean and largest of their deviations."""
    h, w = (n // side * side for n in x.shape)
    blocks = x[:h, :w].reshape(h // side, side, w // side, side).swapaxes(1, 2).reshape(-1, side * side)
    return [blocks.mean(axis=1).std(), blocks.std(axis=1).mean(), blocks.std(axis=1).max()]


def features(p: np.ndarray, version: int = 2) -> np.ndarray:
    """144 Gabor, 256 pattern, 5 statistics and 11 gradient features of a patch; version 1 has 3 of blocks besides."""
    return features_of(p[None], version)[0]


def features_of(patches: np.ndarray, version: int = 2) -> np.ndarray:
    """The features of each of an array of patches, taken together in parts of a few megabytes."""
    size = patches.shape[-1]
    part = max(1, 2**12 // size**2)
    made = [_features(patches[at : at + part], version) for at in range(0, len(patches), part)]
    return np.concatenate(made) if made else np.zeros((0, 416 + 3 * (version == 1)), np.float32)


def _features(p: np.ndarray, version: int) -> np.ndarray:
    n = len(p)
    x = p.reshape(n, -1).astype(np.float64)
    responses = gabor_responses(p)
    gabor = np.stack([np.abs(responses).mean(axis=(-2, -1)), responses.std(axis=(-2, -1))], axis=-1).reshape(n, -1)
    mean, std = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
    z = (x - mean) / (std + 1e-7)
    grays = shares(p.reshape(n, -1) // 16, 16)
    stats = np.concatenate([mean, std, *(v[:, None] for v in ((z**3).mean(axis=1), (z**4).mean(axis=1), -(grays * np.log2(grays + 1e-7)).sum(axis=1)))], axis=1)
    gx, gy = (g.reshape(n, -1) for g in gradients(p))
    edges = np.linspace(-np.pi, np.pi, 9, dtype=np.float32)[1:-1]  # an angle of exactly pi is in the last bin
    size, turned = np.hypot(gx, gy), shares(np.searchsorted(edges, np.arctan2(gy, gx), side="right"), 8)
    more = [np.array([block_features(q.astype(np.float64)) for q in p])] if version == 1 else []
    sizes = [size.mean(axis=1)[:, None], size.std(axis=1)[:, None], turned.max(axis=1)[:, None]]
    return np.concatenate([gabor, shares(local_patterns(p).reshape(n, -1), 256), stats, *sizes, turned, *more], axis=1).astype(np.float32)


def patch_features(patches: DataFrame, patch: str = "patch", size: int = SIZE, version: int = 2) -> DataFrame:
    """Adds features: the 416 numbers (419 of version 1) of a patch (array of size² pixels); null for a patch of another size."""

    @F.pandas_udf("array<float>")
    def of(column):
        import pandas as pd

        fits = np.array([v is not None and len(v) == size * size for v in column], bool)
        done = iter(features_of(np.array([np.asarray(v, np.uint8) for v in column[fits]], np.uint8).reshape(-1, size, size), version))
        return pd.Series([next(done) if fit else None for fit in fits], dtype=object)

    return patches.withColumn("features", of(patch))


def train_patch_classifier(df: DataFrame, trees: int = 200, depth: int = 15, folds: int = 5, seed: int = 42, key: str = "patch_id", label: str = "target") -> tuple[PipelineModel, list[float]]:
    """(model, accuracies): the forest on all rows, and its accuracy on each fold left out.

    Scaling is fitted inside each fold, so nothing of a left-out row reaches its model; folds go by a
    hash of the key; classes are weighted to count alike. With fewer than two folds there are no
    accuracies.

    Spark grows all trees of a forest level by level, and every task sends a histogram of 21 features
    for each node, however few rows it has of it. So that work grows with tasks times nodes, and more
    tasks are no help: rows stay in few tasks, and the trees are trained as several forests at once.
    """
    df = write_table(df.select(key, label, "features"), "patches")
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weight = F.coalesce(*[F.when(F.col(label) == c, total / (len(counts) * n)) for c, n in counts.items()])
    fold = F.conv(F.substring(seeded_order(F.col(key).cast("string"), F.lit(str(seed))), 1, 8), 16, 10).cast("long") % max(folds, 1)
    rows = df.select(key, label, array_to_vector(F.col("features").cast("array<double>")).alias("raw"), weight.alias("weight"), fold.alias("fold"))
    rows = write_table(rows, "labelled-patches").coalesce(-(-total // TASK_ROWS) or 1)  # read once a tree level
    pieces = min(trees, 1 if total < 1000 else 4 if total < 20_000 else AT_ONCE)
    parts = [trees // pieces + (k < trees % pieces) for k in range(pieces)]

    def fitted(some: DataFrame, pool: ThreadPool) -> PipelineModel:
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(some)
        scaled = scaler.transform(some)

        def grow(k: int) -> RandomForestClassificationModel:
            forest = RandomForestClassifier(featuresCol="scaled", labelCol=label, weightCol="weight", numTrees=parts[k], maxDepth=depth, minInstancesPerNode=2, seed=seed + 1000 * k)
            return forest.setPredictionCol(f"prediction{k}").setRawPredictionCol(f"raw{k}").setProbabilityCol(f"probability{k}").fit(scaled)

        return PipelineModel([scaler, *pool.map(inheritable_thread_target(df.sparkSession)(grow), range(pieces), 1)])

    def accuracy(k: int, pool: ThreadPool) -> float:
        tested = fitted(rows.where(F.col("fold") != k), pool)
        scored = tested.transform(rows.where(F.col("fold") == k)).withColumn("votes", _votes(tested))
        hit = F.array_position("votes", F.array_max("votes")) - 1 == F.col(label)
        return scored.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(float("nan")))).first()[0]

    with ThreadPool(AT_ONCE) as growing, ThreadPool(AT_ONCE // pieces if pieces > 1 else 2) as leaving:  # no more models at once than keep the executors busy
        measured = inheritable_thread_target(df.sparkSession)(lambda k: accuracy(k, growing))
        accuracies = leaving.map(measured, range(folds), 1) if folds > 1 else []
        return fitted(rows, growing), accuracies


def _forests(model: PipelineModel) -> list[RandomForestClassificationModel]:
    return [s for s in model.stages if isinstance(s, RandomForestClassificationModel)]


def _votes(model: PipelineModel) -> Column:
    """The probability of each class over all trees of a transformed row: the mean of the forests', by their trees."""
    forests = _forests(model)
    trees = sum(f.getNumTrees for f in forests)
    each = [(vector_to_array(F.col(f.getProbabilityCol())), f.getNumTrees / trees) for f in forests]
    return F.array(*[sum((p[i] * w for p, w in each[1:]), each[0][0][i] * each[0][1]) for i in range(forests[0].numClasses)])


def score_patches(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds prob: the probability of damage."""
    rows = df.withColumn("raw", array_to_vector(F.col("features").cast("array<double>")))
    return model.transform(rows).withColumn("prob", _votes(model)[1]).select(*df.columns, "prob")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def top_importances(model: PipelineModel, n: int = 10) -> list[tuple[int, float]]:
    """(feature, importance) of the most important features."""
    values = sum(f.featureImportances.toArray() * f.getNumTrees for f in _forests(model)) / sum(f.getNumTrees for f in _forests(model))
    return [(int(i), float(values[i])) for i in np.lexsort((np.arange(len(values)), -values))[:n]]


def window_features(images: DataFrame, size: int = SIZE, stride: int = 4, side: int | None = 512, version: int = 2) -> DataFrame:
    """(origin, height, width, y, x, features) of every window of each decodable image, at ``side``² or (None) at its own size.

    ``images`` has origin, width, height, nChannels and data. Images are dealt evenly over the tasks,
    as a small file of them is one task but hours of work; features are made where the image is and
    leave in small batches, so no window's pixels are shuffled.
    """
    kinds = [("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("features", pa.list_(pa.float32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                r = b.slice(i, 1).to_pylist()[0]
                g = kernels.gray(pixels(r["width"], r["height"], r["nChannels"], r["data"]))
                g = kernels.resized(g, side, side, "linear") if side else g
                places = [(y, x) for y in range(0, g.shape[0] - size + 1, stride) for x in range(0, g.shape[1] - size + 1, stride)]
                for at in range(0, len(places), 256):
                    part = places[at : at + 256]
                    made = features_of(np.array([g[y : y + size, x : x + size] for y, x in part]), version)
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * made.shape[1], made.ravel())
                    same = [[v] * len(part) for v in (r["origin"], *g.shape)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, (_, t) in zip([*same, *zip(*part)], kinds, strict=False)), lists.cast(kinds[-1][1])], schema=pa.schema(kinds))

    good = images.where("height > 0 and data is not null").select("origin", "width", "height", "nChannels", "data")
    return spread(good).mapInArrow(run, "origin string, height int, width int, y int, x int, features array<float>")


def stitched_mask(height: int, width: int, ys: np.ndarray, xs: np.ndarray, probs: np.ndarray, size: int, threshold: float) -> np.ndarray:
    """255 where the mean probability of the windows over a pixel is above the threshold; gaps of a pixel closed, edges blurred."""
    total, seen = np.zeros((2, height, width))
    for y, x, p in zip(ys, xs, probs, strict=True):
        total[y : y + size, x : x + size] += p
        seen[y : y + size, x : x + size] += 1
    hit = (total / np.maximum(seen, 1) > threshold).astype(np.uint8) * 255
    return kernels.gaussian(kernels.closed(hit), 5)


def learned_mask(images: DataFrame, model: PipelineModel, size: int = SIZE, stride: int = 4, threshold: float = 0.3, side: int | None = 512, version: int = 2) -> DataFrame:
    """(origin, height, width, mask, coverage): the damage mask by the classifier's probabilities of all windows of an image.

    Probabilities, not pixels, are brought together by image; their number is bounded by an image's
    windows. An image too small for a window has no row.
    """
    import pandas as pd

    scored = score_patches(model, window_features(images, size, stride, side, version)).select("origin", "height", "width", "y", "x", "prob")

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows.height.iloc[0]), int(rows.width.iloc[0])
        m = stitched_mask(h, w, rows.y.to_numpy(), rows.x.to_numpy(), rows.prob.to_numpy(), size, threshold)
        return pd.DataFrame({"origin": [rows.origin.iloc[0]], "height": [h], "width": [w], "mask": [m.tobytes()], "coverage": [float(m.mean() / 255)]})

    return scored.groupBy("origin").applyInPandas(stitch, "origin string, height int, width int, mask binary, coverage double")


def cut_patches(windows: DataFrame) -> DataFrame:
    """(origin, y, x, patch) of planned corners: windows has origin, y, x, size, gray (a byte a pixel) and width; patch is the bytes of its rows."""
    row = lambda k: F.substring("gray", (F.col("y") + k) * F.col("width") + F.col("x") + 1, F.col("size"))
    rows = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.hex(row(k)))
    return windows.select("origin", "y", "x", F.unhex(F.array_join(rows, "")).alias("patch"))
