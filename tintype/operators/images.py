"""Plans of synthetic variants and patches, and jobs over decoded images that carry status and error by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintype.operators import kernels

#: Rows of an Arrow batch of images, so that a batch stays small whatever an image's size.
BATCH = 16

#: Textures that are broadcast, in bytes.
TEXTURE_BYTES = 64 << 20


def _hash(*parts: Column | str) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256), 1, 8), 16, 10).cast("long")


#: What a synthetic variant does at full severity (fixed values): global steps, then those that leave a local mask.
FULL_STRENGTH = {"sepia": 0.5, "fade": 0.3, "vignette": 0.8, "grain": 40.0, "scratches": 12.0, "stains": 4.0}


def plan_variants(targets: DataFrame, name: str, seed: int) -> DataFrame:
    """Three variants (light, medium, heavy) of each target: size, severity, seed, and params, a struct of the strength of every step (marks as whole numbers)."""
    levels = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(s).alias("severity")) for n, s in (("light", 0.3), ("medium", 0.6), ("heavy", 0.9))])
    rows = targets.select(name, "width", "height", F.explode(levels).alias("v")).select(name, "width", "height", "v.*")
    steps = [((F.rint(F.col("severity") * v)).cast("int") if k in ("scratches", "stains") else F.rint(F.col("severity") * v * 1000) / 1000).alias(k) for k, v in FULL_STRENGTH.items()]
    return rows.withColumn("seed", _hash(name, "level", F.lit(str(seed))) % 1_000_000).withColumn("params", F.struct(*steps))


def make_variants(images: DataFrame, seed: int) -> DataFrame:
    """(origin, …, level, height, width, data, mask, coverage, local): the planned variants of every image, and the mask of what was put on it.

    The mask is the opacity of the damage layer itself, not a detection. A variant without local
    damage has ``local`` false, so that it needn't stand in a set for local repair.
    """
    plan = plan_variants(images, "origin", seed).select(F.col("origin").alias("_of"), "level", "seed", "params")
    rows = images.join(plan, F.col("origin") == F.col("_of"))

    def make(rgb: np.ndarray, row: dict) -> dict:
        out, mask = kernels.degraded(rgb, row["params"], row["seed"])
        return {"level": row["level"], "height": out.shape[0], "width": out.shape[1], "data": out.tobytes(), "mask": mask.tobytes(), "coverage": float((mask > 127).mean()), "local": bool(mask.any())}

    return image_job(rows, make, "level string, height int, width int, data binary, mask binary, coverage double, local boolean", ["level", "seed", "params"])


def random_patches(images: DataFrame, name: str, each: int, size: int, seed: int) -> DataFrame:
    """``each`` patch corners (y, x) of every image that holds one, seeded by image and number."""
    rows = images.where((F.col("width") >= size) & (F.col("height") >= size)).select(name, "width", "height", F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k"))
    h = _hash(name, "k", F.lit(str(seed)))
    tall, wide = F.col("height") - size + 1, F.col("width") - size + 1
    return rows.withColumn("_h", h).select(name, "k", (F.col("_h") % tall).cast("int").alias("y"), (F.floor(F.col("_h") / tall) % wide).cast("int").alias("x"))


def pixels(width: int, height: int, channels: int, data: bytes) -> np.ndarray:
    """An image row's bytes (BGR or gray) as RGB, with alpha dropped and gray made three channels."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def image_job(images: DataFrame, make: Callable[[np.ndarray, dict], dict], schema: str, extra: list[str] = ()) -> DataFrame:
    """(origin, status, error, …) of every image row: ``make`` of its RGB pixels and extra columns; a row that fails keeps its error.

    ``images`` has origin, width, height, nChannels, data and the extra columns; undecodable rows
    (height of -1) are reported as decode_error. Rows are taken one by one, so memory is one image.
    """
    names = ["origin", "width", "height", "nChannels", "data", *extra]
    out = f"origin string, status string, error string, {schema}"
    fields = [x.split()[0] for x in _split_fields(schema)]
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BATCH):
                done = []
                for row in b.slice(at, BATCH).to_pylist():
                    result = {"origin": row["origin"], "status": "ok", "error": None}
                    if row["height"] is None or row["height"] < 0 or row["data"] is None:
                        result |= {"status": "error", "error": "decode_error"}
                    else:
                        try:
                            result |= make(pixels(row["width"], row["height"], row["nChannels"], row["data"]), row)
                        except Exception as e:  # one bad image must not end the job
                            result |= {"status": "error", "error": f"{type(e).__name__}: {e}"}
                    done.append({k: result.get(k) for k in ("origin", "status", "error", *fields)})
                yield pa.RecordBatch.from_pylist(done, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(out))
    return images.select(*names).mapInArrow(run, out)


def _split_fields(schema: str) -> list[str]:
    """Top-level fields of a schema string."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


def full_image_stats(images: DataFrame) -> DataFrame:
    """Brightness, contrast, saturation and sharpness of a preview of at most 768 on the long side."""
    return image_job(
        images,
        lambda rgb, row: kernels.statistics(kernels.preview(rgb, 768)) | {"width": rgb.shape[1], "height": rgb.shape[0]},
        "width int, height int, brightness double, contrast double, saturation double, sharpness double",
    )


def full_dhash(images: DataFrame, resample: str = "area") -> DataFrame:
    """(origin, …, resample, dhash): the 144-bit difference hash, by area from the preview or by Lanczos from the whole image.

    Hashes of different kinds mustn't be compared, so the kind is part of the row.
    """

    def make(rgb: np.ndarray, row: dict) -> dict:
        g = kernels.gray(kernels.preview(rgb, 768) if resample == "area" else rgb)
        return {"resample": resample, "dhash": kernels.dhash_hex(g, resample)}

    return image_job(images, make, "resample string, dhash string")


def normalise_images(images: DataFrame) -> DataFrame:
    """(origin, …, height, width, data): working copies, upright by the column ``orientation``, RGB, without alpha."""

    def make(rgb: np.ndarray, row: dict) -> dict:
        out = kernels.upright(rgb, row["orientation"] or 1)
        return {"height": out.shape[0], "width": out.shape[1], "data": out.tobytes()}

    return image_job(images, make, "height int, width int, data binary", ["orientation"])


def scratch_patches(images: DataFrame, size: int, jitter: int, seed: int, limit: int | None = None, side: int = 512) -> DataFrame:
    """(origin, k, y, x, patch): patches around strong line responses of the image at ``side``², each moved by up to ``jitter`` pixels; at most ``limit`` by seeded hash."""

    def make(rgb: np.ndarray, row: dict) -> dict:
        g = kernels.resized(kernels.gray(rgb), side, side, "linear")
        rng = np.random.default_rng(row["_seed"])
        out = []
        for y, x, h, w in kernels.line_boxes(g):
            dy, dx = rng.integers(-jitter, jitter, 2)
            top, left = (int(np.clip(a + n // 2 - size // 2 + d, 0, side - size)) for a, n, d in ((y, h, dy), (x, w, dx)))
            out.append({"y": top, "x": left, "patch": g[top : top + size, left : left + size].ravel().tolist()})
        return {"found": out}

    seeds = images.withColumn("_seed", _hash("origin", F.lit(str(seed))))
    found = image_job(seeds, make, "found array<struct<y:int,x:int,patch:array<int>>>", ["_seed"])
    rows = found.where("status = 'ok'").select("origin", F.posexplode("found").alias("k", "p")).select("origin", "k", "p.*")
    return rows if limit is None else rows.orderBy(_hash("origin", "k", F.lit(str(seed))), "origin", "k").limit(limit)


def full_noref_quality(images: DataFrame) -> DataFrame:
    return image_job(images, lambda rgb, row: kernels.noref(rgb), "sharpness double, contrast double, color double, snr double, proxy double")


def damage_mask(images: DataFrame, method: str = "morph", sensitivity: float = 0.5) -> DataFrame:
    """(origin, …, height, width, mask, coverage): the damage mask of each image by one of the detectors."""
    detect = kernels.DETECTORS[method]

    def make(rgb: np.ndarray, row: dict) -> dict:
        m = detect(rgb, sensitivity)
        return {"height": m.shape[0], "width": m.shape[1], "mask": m.tobytes(), "coverage": float(m.mean() / 255)}

    return image_job(images, make, "height int, width int, mask binary, coverage double")


def age_images(images: DataFrame, seed: int, textures: DataFrame | None = None) -> DataFrame:
    """(origin, …, data): synthetically aged images, seeded by origin; two of the textures (width, height, data, gray) wear each.

    Textures are sent to all executors, so all of them may have TEXTURE_BYTES at most.
    """
    covers: list[np.ndarray] = []
    if textures is not None:
        if (textures.agg(F.sum(F.length("data"))).first()[0] or 0) > TEXTURE_BYTES:
            raise ValueError(f"textures of more than {TEXTURE_BYTES} bytes")
        covers = [np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in textures.select("width", "height", "data").orderBy("data").collect()]
    shared = images.sparkSession.sparkContext.broadcast(covers)
    seeds = images.withColumn("_seed", _hash("origin", F.lit(str(seed))))
    return image_job(seeds, lambda rgb, row: {"height": rgb.shape[0], "width": rgb.shape[1], "data": kernels.age(rgb, row["_seed"], shared.value).tobytes()}, "height int, width int, data binary", ["_seed"])


def colour_correct(images: DataFrame) -> DataFrame:
    return image_job(images, lambda rgb, row: {"height": rgb.shape[0], "width": rgb.shape[1], "data": kernels.colour_correct(rgb).tobytes()}, "height int, width int, data binary")


def full_pair_metrics(pairs: DataFrame, metrics: dict[str, Callable[[np.ndarray, np.ndarray], float]] | None = None) -> DataFrame:
    """PSNR and SSIM (or the given metrics) of pairs: image columns and other_width, other_height, other_channels, other_data."""
    use = metrics or {"psnr": kernels.psnr, "ssim": kernels.ssim}

    def make(rgb: np.ndarray, row: dict) -> dict:
        other = pixels(row["other_width"], row["other_height"], row["other_channels"], row["other_data"])
        if other.shape != rgb.shape:
            return {"size_match": False}
        return {"size_match": True} | {k: float(f(rgb, other)) for k, f in use.items()}

    return image_job(pairs, make, "size_match boolean, " + ", ".join(f"{k} double" for k in use), ["other_width", "other_height", "other_channels", "other_data"])


def pair_audit(pairs: DataFrame) -> DataFrame:
    """(origin, …, size_match, mae, psnr, shift) over all channels: mean absolute error, PSNR (99 for equal images) and mean shift of the channels' means; null where sizes differ."""

    def make(rgb: np.ndarray, row: dict) -> dict:
        other = pixels(row["other_width"], row["other_height"], row["other_channels"], row["other_data"])
        return {"size_match": True} | kernels.pair_difference(rgb, other) if other.shape == rgb.shape else {"size_match": False}

    return image_job(pairs, make, "size_match boolean, mae double, psnr double, shift double", ["other_width", "other_height", "other_channels", "other_data"])


def training_patches(pairs: DataFrame, each: int, size: int, seed: int) -> DataFrame:
    """(origin, …, k, degraded, clean): ``each`` crops of a pair, flipped and turned alike on both sides, seeded by origin and number."""
    rows = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(each - 1)))).withColumn("_seed", _hash("origin", "k", F.lit(str(seed))))

    def make(rgb: np.ndarray, row: dict) -> dict:
        other = pixels(row["other_width"], row["other_height"], row["other_channels"], row["other_data"])
        a, b = kernels.paired_crop(rgb, other, size, row["_seed"])
        return {"k": row["k"], "degraded": a.tobytes(), "clean": b.tobytes()}

    return image_job(rows, make, "k int, degraded binary, clean binary", ["k", "_seed", "other_width", "other_height", "other_channels", "other_data"])


def restore_batch(images: DataFrame, models: Callable[[], tuple[Callable, Callable]], method: str = "morph", sensitivity: float = 0.5) -> DataFrame:
    """(origin, …, coverage, repaired, data): mask, repair where more than 1 % is damaged, enhance, and resize back.

    ``models`` gives (repair(rgb, mask), enhance(rgb)); it is called once for each task.
    """
    detect = kernels.DETECTORS[method]
    loaded: list = []

    def make(rgb: np.ndarray, row: dict) -> dict:
        if not loaded:
            loaded.append(models())
        repair, enhance = loaded[0]
        mask = detect(rgb, sensitivity)
        coverage = float(mask.mean() / 255)
        out = repair(rgb, mask) if coverage > 0.01 else rgb
        out = kernels.resized(enhance(out), rgb.shape[1], rgb.shape[0])
        return {"coverage": coverage, "repaired": coverage > 0.01, "height": out.shape[0], "width": out.shape[1], "data": out.astype(np.uint8).tobytes()}

    return image_job(images, make, "coverage double, repaired boolean, height int, width int, data binary")
