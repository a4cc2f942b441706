"""Registered queries of the image jobs, the patch classifier and the streams, over the given tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintype.functions.scalars import let
from tintype.operators import diffs, images, kernels, near, patchml, sketches, tasks
from tintype.plans.catalog import _OK, ORACLES, query, r
from tintype.plans.image_catalog import _GRAY, _MEAN, _VAR, _gray
from tintype.plans.views import sql as V
from tintype.plans.views import VIEWS, view
from tintype.plans.worktables import spread, work_folder
from tintype.streaming import jobs


def _bytes(px: Column) -> Column:
    """Pixels as a binary value."""
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def _small(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as rows of the image source, 8x8 gray."""
    return _gray(spark, d).select(F.col("img_id").cast("string").alias("origin"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(1).alias("nChannels"), _bytes(F.col("px")).alias("data"))


def _large(spark: SparkSession, d: str) -> DataFrame:
    """The same images with each pixel as a block of 4x4."""
    wide = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: (F.floor(i / 128) * 8 + F.floor((i % 32) / 4)).cast("int"))
    rows = _gray(spark, d).select(F.col("img_id").cast("string").alias("origin"), "px", wide.alias("at"))
    large = let(F.col("px"), lambda px: F.transform("at", lambda i: F.get(px, i)))  # the pixels are made once a row, not once a place
    return rows.select("origin", F.lit(32).alias("width"), F.lit(32).alias("height"), F.lit(1).alias("nChannels"), _bytes(large).alias("data"))


def _pairs(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    other = rows.select((F.col("origin").cast("long") - 1).cast("string").alias("origin"), F.col("width").alias("other_width"), F.col("height").alias("other_height"), F.col("nChannels").alias("other_channels"), F.col("data").alias("other_data"))
    return rows.where("origin % 2 = 0").join(other, "origin")


@query("select img_id::varchar as origin, brightness, contrast, 0.0::double as saturation, sharpness from (" + ORACLES["image_stats"] + ")")
def image_stats_job(spark, d):
    return images.full_image_stats(_small(spark, d)).select("origin", "brightness", "contrast", "saturation", "sharpness")


# CIE lightness of a gray value; the other two channels of Lab are constant
_LIGHT = "list_transform(list_transform(px, lambda v: case when v / 255 > 0.04045 then pow((v / 255 + 0.055) / 1.055, 2.4) else v / 255 / 12.92 end), lambda y: (116 * case when y > 0.008856 then cbrt(y) else 7.787 * y + 16 / 116 end - 16) * 2.55)"


@query(
    f"""with {_GRAY}, l as (select img_id, {_LIGHT} as px from gray8), s as ({ORACLES["image_stats"]}), n as ({ORACLES["noref_quality"]})
    select n.img_id::varchar as origin, contrast, snr, proxy, sharpness, {r(f'sqrt({_VAR("px")})')} as color from n join (select img_id, sharpness from s) using (img_id) join l using (img_id)"""
)
def noref_quality_job(spark, d):
    done = images.full_noref_quality(_small(spark, d))
    return done.select("origin", *[(F.rint(F.col(c) * 1000) / 1000).alias(c) for c in ("contrast", "snr", "proxy", "sharpness", "color")])


@query("select img_id::varchar as origin, mae, psnr, shift, size_match from (" + ORACLES["pair_metrics"] + ")")
def pair_audit(spark, d):
    done = images.pair_audit(_pairs(spark, d, _small(spark, d)))
    return done.select("origin", *[(F.rint(F.col(c) * 1000) / 1000).alias(c) for c in ("mae", "psnr", "shift")], "size_match")


@query()
def quality_metrics(spark, d):
    return images.full_pair_metrics(_pairs(spark, d, _large(spark, d)), {"psnr": kernels.psnr, "ssim": kernels.ssim, "ssim_loss": kernels.ssim_loss})


@query()
def dhash_area(spark, d):
    return images.full_dhash(_large(spark, d), "area")


@query()
def dhash_lanczos(spark, d):
    return images.full_dhash(_large(spark, d), "lanczos")


@query()
def near_images(spark, d):
    """Every image and a copy of it (its name ends in v) in which one row of blocks is a little lighter."""
    rows = _large(spark, d)
    row = F.col("origin").cast("int") % 8 * 128
    lighter = F.concat(F.substring("data", F.lit(1), row), F.unhex(F.array_join(F.transform(F.sequence(row + 1, row + 128), lambda i: F.lpad(F.hex(F.least(F.lit(255), F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int") + 3)), 2, "0")), "")), F.substring("data", row + 129, F.lit(1024)))
    copies = rows.withColumns({"data": lighter, "origin": F.concat("origin", F.lit("v"))})
    return near.near_dup_components(images.full_dhash(rows.unionByName(copies)), "origin", "dhash", 144, 6)


# row and column (0 to 7) of the pixel that an upright image shows at (y, x), by orientation
_SOURCE = "case o when 1 then y * 8 + x when 2 then y * 8 + 7 - x when 3 then (7 - y) * 8 + 7 - x when 4 then (7 - y) * 8 + x when 5 then x * 8 + y when 6 then (7 - x) * 8 + y when 7 then (7 - x) * 8 + 7 - y else x * 8 + 7 - y end"
_AT = _SOURCE.replace("y", "(i // 128)").replace("x", "(i % 32 // 4)")


@query(f"with {_GRAY}, p as (select img_id, px, img_id % 8 + 1 as o from gray8) select img_id::varchar as origin, 'ok' as status, 32 as height, 32 as width, sha256(unhex(array_to_string(list_transform(range(1024), lambda i: repeat(printf('%02x', px[{_AT} + 1]::int), 3)), ''))) as content from p")
def normalise_images(spark, d):
    rows = _large(spark, d).withColumn("orientation", (F.col("origin").cast("int") % 8 + 1))
    return images.normalise_images(rows).select("origin", "status", "height", "width", F.sha2("data", 256).alias("content"))


@query()
def scratch_patches(spark, d):
    return images.scratch_patches(_large(spark, d), 16, 4, 42, side=32).select("origin", "k", "y", "x", F.size("patch").alias("pixels"))


@query()
def damage_mask_morph(spark, d):
    return images.damage_mask(_large(spark, d), "morph").select("origin", "status", "coverage")


@query()
def damage_mask_texture(spark, d):
    return images.damage_mask(_large(spark, d), "texture").select("origin", "status", "coverage")


@query()
def damage_mask_adaptive(spark, d):
    return images.damage_mask(_large(spark, d), "adaptive").select("origin", "status", "coverage")


@query()
def age_images(spark, d):
    textures = _large(spark, d).orderBy("origin").limit(8)  # a handful of textures is the feature
    return images.age_images(_large(spark, d), 42, textures).select("origin", "status", F.sha2("data", 256).alias("content"))


@query()
def make_variants(spark, d):
    return images.make_variants(_large(spark, d), 11).select("origin", "status", "level", "coverage", "local", F.sha2("data", 256).alias("content"))


@query()
def colour_correct(spark, d):
    return images.colour_correct(_large(spark, d)).select("origin", "status", F.sha2("data", 256).alias("content"))


@query()
def training_patches(spark, d):
    return images.training_patches(_pairs(spark, d, _large(spark, d)), 2, 16, 42).select("origin", "status", "k", F.sha2("degraded", 256).alias("degraded"), F.sha2("clean", 256).alias("clean"))


def _filled(rgb: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A stand-in model: the mean of what isn't damaged, where it is."""
    whole = mask < 128
    mean = rgb[whole].mean(axis=0) if whole.any() else rgb.reshape(-1, 3).mean(axis=0)
    return np.where(whole[..., None], rgb, np.rint(mean)).astype(np.uint8)


def _models():
    return _filled, lambda rgb: rgb


@query()
def restore_batch(spark, d):
    return images.restore_batch(_large(spark, d), _models).select("origin", "status", "repaired", "coverage", F.sha2("data", 256).alias("content"))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    rows = _gray(spark, d).select(F.col("img_id").alias("patch_id"), "px", (F.col("label") < 5).cast("int").alias("target"))
    return patchml.patch_features(spread(rows), "px", 8)


# the eight neighbours of a pattern code as (rows, columns) to go back, and the code of pixel i of an 8x8 patch
_NEIGHBOURS = [(0, 3), (1, 3), (1, 3), (2, 2), (3, 2), (3, 1), (3, 0), (3, -1)]
_CODE = " + ".join(f"case when case when i // 8 - {dy} >= 0 and i % 8 - ({dx}) between 0 and 7 then px[i - {dy * 8 + dx} + 1] else 0 end >= px[i + 1] then {1 << n} else 0 end" for n, (dy, dx) in enumerate(_NEIGHBOURS))


@query(f"with {_GRAY}, c as (select img_id, px, list_transform(range(64), lambda i: {_CODE}) as codes from gray8) select img_id as patch_id, 416 as n, {_MEAN('px')} as mean, len(list_filter(codes, lambda v: v = 0))::int as none_brighter, len(list_filter(codes, lambda v: v = 255))::int as all_brighter, len(list_filter(codes, lambda v: v = 127))::int as seven_brighter from c")
def patch_features(spark, d):
    f = lambda i: F.get("features", F.lit(i))
    share = lambda code: F.rint(f(144 + code) * 64).cast("int")
    return _patches(spark, d).select("patch_id", F.size("features").alias("n"), f(400).cast("double").alias("mean"), share(0).alias("none_brighter"), share(255).alias("all_brighter"), share(127).alias("seven_brighter"))


_CUT = "list_transform(range(64), lambda i: printf('%02x', px[(y + i // 8) // 4 * 8 + (x + i % 8) // 4 + 1]))"


@query(f"with {_GRAY}, corner as (select * from (values (0), (12), (24)) t(c)), w as (select img_id, px, a.c as y, b.c as x from gray8, corner a, corner b where px is not null) select img_id::varchar as origin, y::int as y, x::int as x, sha256(unhex(array_to_string({_CUT}, ''))) as patch from w")
def cut_patches(spark, d):
    """Nine patches of 8x8 of every image."""
    corners = F.array(*[F.lit(c) for c in (0, 12, 24)])
    images = _large(spark, d).where("data is not null").select("origin", "width", F.lit(8).alias("size"), F.col("data").alias("gray"))
    windows = images.withColumn("y", F.explode(corners)).withColumn("x", F.explode(corners))
    return patchml.cut_patches(windows).select("origin", "y", "x", F.sha2("patch", 256).alias("patch"))


@query()
def score_patches(spark, d):
    rows = _patches(spark, d)
    model, _ = patchml.train_patch_classifier(rows, folds=0)
    return patchml.score_patches(model, rows.select("patch_id", "target", "features")).select("patch_id", "target", "prob")


@query()
def top_importances(spark, d):
    model, accuracies = patchml.train_patch_classifier(_patches(spark, d))
    return spark.createDataFrame([(i, v, float(np.mean(accuracies))) for i, v in patchml.top_importances(model)], "feature int, importance double, accuracy double")


@query()
def damage_mask_learned(spark, d):
    model, _ = patchml.train_patch_classifier(_patches(spark, d), folds=0)
    return patchml.learned_mask(_large(spark, d), model, 8, 8, 0.5, side=None).select("origin", "height", "width", "coverage")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream's plain path has to be a folder
    text = VIEWS["task_events"].replace("from events", "from {events}")
    return spark.sql(text, events=rows)


@query(ORACLES["latest_per_task"])
def task_state_stream(spark, d):
    columns, at = ["status", "mode"], f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.task_state_table(_event_stream(spark, d), columns, f"{at}/states", f"{at}/checkpoint").awaitTermination()
    return jobs.read_task_states(spark, f"{at}/states", columns).select("task_id", "event_id", "status", "mode")


@query(ORACLES["recent_tasks"].replace("limit 50", "limit 100"))
def newest_tasks_stream(spark, d):
    at = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.newest_tasks(_event_stream(spark, d), ["status"], f"{at}/newest", f"{at}/checkpoint").awaitTermination()
    return jobs.read_newest_tasks(spark, f"{at}/newest").select("task_id", "event_id")


@query(f"with {V('task_events')}, s as (select task_id, arg_max(status, (ts, event_id)) as status from task_events group by 1) select status, count(*) as n from s group by 1")
def live_status_counts(spark, d):
    """Counts by status that four batches of events, the newest first, have brought up to date."""
    events = view(spark, d, "task_events")
    counts = jobs.StatusCounts(spark, f"{work_folder(spark)}/counts-{uuid.uuid4().hex}")
    for number in range(4):
        counts.update(tasks.latest_per_task(events.where(F.pmod("event_id", F.lit(4)) == 3 - number), ["status"]), number)
    return counts.read()


@query(f"with {V('manifest')} select pos, case when pos % 97 = 5 then 'removed' when pos % 97 = 6 then 'changed' else 'added' end as change from manifest where pos % 97 in (5, 6, 7)")
def compare_releases(spark, d):
    """Two releases of the manifest, of which the second lacks some rows, has some others and changed ones."""
    rows = view(spark, d, "manifest").select("pos", "source_id", "license", "width", "height", "sha256")
    at = f"{work_folder(spark)}/releases-{uuid.uuid4().hex}"
    diffs.write_hashed(rows.where("pos % 97 <> 7"), f"{at}/a", "pos", 1)
    diffs.write_hashed(rows.where("pos % 97 <> 5").withColumn("width", F.col("width") + F.when(F.col("pos") % 97 == 6, 1).otherwise(0)), f"{at}/b", "pos", 1)
    return diffs.compare_releases(spark, f"{at}/a", f"{at}/b", "pos")


@query("select 'rank off by over 1 %' as found, 0 as n union all select 'merged apart from whole', 0")
def sketch_quantiles(spark, d):
    """Quantiles of line prices by part size from sketches of each year's lines: how many are off in rank, or apart from a sketch of all lines."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_quantity") % 5).cast("int").alias("g"), F.year("l_shipdate").alias("y"), F.col("l_extendedprice").cast("double").alias("v"))
    fractions = [0.1, 0.25, 0.5, 0.9]
    merged = sketches.merged_sketches(sketches.quantile_sketches(lines, "v", ["g", "y"]), ["g"])
    both = [sketches.sketched_quantiles(s, ["g"], fractions).select("g", F.posexplode("p").alias("i", q)) for s, q in ((merged, "m"), (sketches.quantile_sketches(lines, "v", ["g"]), "w"))]
    asked = F.broadcast(both[0].join(both[1], ["g", "i"]))  # a row a group and fraction, five groups
    ranks = lines.join(asked, "g").groupBy("g", "i").agg(*[F.avg((F.col("v") < F.col(q)).cast("double")).alias(f"{q}_lo") for q in "mw"], *[F.avg((F.col("v") <= F.col(q)).cast("double")).alias(f"{q}_hi") for q in "mw"])
    at = F.element_at(F.array(*[F.lit(f) for f in fractions]), F.col("i") + 1)
    off = lambda q: (F.col(f"{q}_lo") > at + 0.01) | (F.col(f"{q}_hi") < at - 0.01)
    apart = (F.col("m_lo") > F.col("w_hi") + 0.01) | (F.col("w_lo") > F.col("m_hi") + 0.01)
    return ranks.agg(F.count_if(off("m") | off("w")).alias("a"), F.count_if(apart).alias("b")).select(F.explode(F.array(F.struct(F.lit("rank off by over 1 %").alias("found"), F.col("a").alias("n")), F.struct(F.lit("merged apart from whole").alias("found"), F.col("b").alias("n")))).alias("x")).select("x.*")


@query(ORACLES["search_history"])
def search_index(spark, d):
    """The search of the history by its index, which is filled in four batches of events."""
    events, columns = view(spark, d, "task_events"), ["status", "filename"]
    index = jobs.HistoryIndex(spark, f"{work_folder(spark)}/history-{uuid.uuid4().hex}", columns)
    for number in range(4):
        index.add(tasks.latest_per_task(events.where(F.pmod("event_id", F.lit(4)) == number), columns), number)
    return index.search("1.PNG").select("task_id", "filename")


@query(f"with {V('manifest')}, f as (select *, row_number() over (partition by sha256 order by id) as k from manifest where {_OK}) select id from f where k = 1")
def intake_stream(spark, d):
    """The manifest taken in as a stream of the documents' files."""
    rows = view(spark, d, "manifest").select("id", "license", "sha256")
    at = f"{work_folder(spark)}/intake-{uuid.uuid4().hex}"
    rows.write.option("maxRecordsPerFile", 100_000).parquet(f"{at}/in")
    jobs.intake_stream(spark, f"{at}/in", rows.schema, f"{at}/accepted", f"{at}/checkpoint", "parquet").awaitTermination()
    return spark.read.parquet(f"{at}/accepted").select("id")


@query(f"with {V('task_events')} select ts::date::varchar as day, status, count(*) as n from task_events group by 1, 2")
def event_windows(spark, d):
    at = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/windows/batch={number}")

    stream = _event_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.event_windows(stream, "1 day", "60 days").writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", f"{at}/windows").parquet(f"{at}/windows/batch=*")
    return rows.groupBy(F.to_date("start").cast("string").alias("day"), "status").agg(F.max("n").alias("n"))
