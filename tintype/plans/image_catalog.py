"""Registered queries of the image operators, over embeddings as 8x8 gray images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintype.functions import scalars as S
from tintype.operators import audit, gray, near, pairing, release, splits, tasks
from tintype.plans.catalog import query, r
from tintype.plans.worktables import write_table

_GRAY = "gray8 as (select vec_id as img_id, label, list_transform(embedding, lambda e: least(255, greatest(0, floor((e::double + 0.55) * 230)))::int) as px from embeddings)"
_SUM = lambda p: f"list_sum(list_transform({p}, lambda v: v::double))"
_SQ = lambda p: f"list_sum(list_transform({p}, lambda v: v::double * v))"
_MEAN = lambda p: f"({_SUM(p)} / len({p}))"
_VAR = lambda p: f"(({_SQ(p)} * len({p}) - {_SUM(p)} * {_SUM(p)}) / (len({p})::double * len({p})))"
_R = lambda n: f"(case when {n} < 0 then -({n}) when {n} > 7 then 14 - ({n}) else {n} end)"
_AT = lambda y, x: f"px[{_R(y)} * 8 + {_R(x)} + 1]"
_LAP = f"list_transform(range(64), lambda i: {_AT('i // 8 - 1', 'i % 8')} + {_AT('i // 8 + 1', 'i % 8')} + {_AT('i // 8', 'i % 8 - 1')} + {_AT('i // 8', 'i % 8 + 1')} - 4 * px[i + 1])"
_HASH = " + ".join(f"(px[{8 * y + x + 2}] > px[{8 * y + x + 1}])::bigint * {1 << (55 - (7 * y + x))}" for y in range(8) for x in range(7))
_PAIRS = "pairs as (select a.img_id, a.px as a, b.px as b from gray8 a join gray8 b on b.img_id = a.img_id + 1 where a.img_id % 2 = 0)"
_DIFF = "list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))"


def _gray(spark: SparkSession, d: str) -> DataFrame:
    return gray.gray8(spark.read.parquet(f"{d}/embeddings.parquet"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    g = _gray(spark, d)
    return g.where("img_id % 2 = 0").select("img_id", F.col("px").alias("a")).join(g.select((F.col("img_id") - 1).alias("img_id"), F.col("px").alias("b")), "img_id")


@query(f"with {_GRAY}, l as (select *, {_LAP} as lap from gray8) select img_id, {r(_MEAN('px'))} as brightness, {r(f'sqrt({_VAR("px")})')} as contrast, {r(_VAR('lap'))} as sharpness from l")
def image_stats(spark, d):
    return gray.image_stats(_gray(spark, d))


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    return _gray(spark, d).select("img_id", "label", gray.dhash(F.col("px"), 8, 8).alias("hash"))


@query(f"with {_GRAY} select img_id, {_HASH} as hash from gray8")
def dhash(spark, d):
    return _hashed(spark, d).select("img_id", "hash")


@query(f"with {_GRAY}, u as (select img_id, px from gray8 union all select img_id + 1000000, px from gray8 where img_id % 3 = 0), h as (select img_id, {_HASH} as hash from u) select hash, count(*) as copies, min(img_id) as first_name from h group by 1 having count(*) > 1")
def hash_groups(spark, d):
    once = _hashed(spark, d)
    again = once.where("img_id % 3 = 0").withColumn("img_id", F.col("img_id") + 1_000_000)  # a third of the images stand there twice
    return audit.duplicate_groups(once.unionByName(again), "hash", "img_id")


@query(f"with {_GRAY} select img_id, {r(f'sqrt({_VAR("px")})')} as contrast, {r(f'case when {_VAR("px")} = 0 then 40.0 else 20 * log10({_MEAN("px")} / sqrt({_VAR("px")})) end')} as snr, {r(f'greatest(0.0, 20 - sqrt({_VAR("px")}) / 2)')} as proxy from gray8")
def noref_quality(spark, d):
    return gray.noref_quality(_gray(spark, d))


@query(
    f"with {_GRAY}, {_PAIRS}, d as (select *, {_DIFF} as d from pairs) select img_id, {r(_MEAN('d'))} as mae, {r(f'case when {_SQ("d")} = 0 then 99.0 else 20 * log10(255 / sqrt({_SQ("d")} / 64)) end')} as psnr, {r(f'abs({_MEAN("a")} - {_MEAN("b")})')} as shift, true as size_match from d"
)
def pair_metrics(spark, d):
    return gray.pair_metrics(_pairs(spark, d))


@query(f"with {_GRAY} select img_id, {r(_MEAN('px') + ' / 255 * 100')} as soft, {r('len(list_filter(px, lambda v: v > 127)) / 64', 6)} as hard from gray8")
def mask_coverage(spark, d):
    return gray.mask_coverage(_gray(spark, d))


@query(f"with {_GRAY}, c as (select {r('len(list_filter(px, lambda v: v > 170)) / 64', 6)} as coverage from gray8) select count(*) filter (where coverage = 0) as empty, count(*) filter (where coverage < 0.01) as under_1, count(*) filter (where coverage > 0.20) as over_20, count(*) filter (where coverage between 0.01 and 0.35) as in_window, count(*) as masks from c")
def flag_masks(spark, d):
    masks = _gray(spark, d).select("img_id", F.transform("px", lambda v: F.when(v > 170, 255).otherwise(0)).alias("px"))
    return audit.flag_masks(gray.mask_coverage(masks).withColumnRenamed("hard", "coverage"))


@query(f"with {_GRAY}, {_PAIRS}, m as (select *, {_DIFF} as d from pairs), l as (select 'mae' as \"column\", {r(_MEAN('d'))} as v from m union all select 'psnr', {r(f'case when {_SQ("d")} = 0 then 99.0 else 20 * log10(255 / sqrt({_SQ("d")} / 64)) end')} from m) select \"column\", {r('min(v)')} as min, {r('quantile_cont(v, 0.1)')} as p10, {r('quantile_cont(v, 0.5)')} as median, {r('quantile_cont(v, 0.9)')} as p90, {r('max(v)')} as max, {r('avg(v)')} as mean from l group by 1")
def pair_quality(spark, d):
    return audit.percentiles(gray.pair_metrics(_pairs(spark, d)), ["mae", "psnr"])


@query(f"with {_GRAY}, {_PAIRS} select img_id, len(list_filter({_DIFF}, lambda v: v > 20)) as masked from pairs")
def difference_mask(spark, d):
    return gray.difference_mask(_pairs(spark, d))


@query(f"with {_GRAY}, {_PAIRS} select img_id, array_to_string(list_transform(list_zip(a, b), lambda z: floor(z[1] * 0.75::double + z[2] * 0.25::double)::int), ',') as px from pairs")
def blend(spark, d):
    return gray.blend(_pairs(spark, d), 0.25).select("img_id", F.array_join("px", ",").alias("px"))


_WINDOWS = "windows as (select img_id, y, x, flatten(list_transform(range(4), lambda k: px[((y + k) * 8 + x + 1)::bigint : ((y + k) * 8 + x + 4)::bigint])) as patch from gray8, (values (0), (2), (4)) ty(y), (values (0), (2), (4)) tx(x))"


@query(f"with {_GRAY}, {_WINDOWS} select img_id, y, x, array_to_string(patch, ',') as patch from windows")
def sliding_windows(spark, d):
    return gray.sliding_windows(_gray(spark, d), 4, 2).withColumn("patch", F.array_join("patch", ","))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return gray.sliding_windows(_gray(spark, d), 4, 2).select("img_id", "y", "x", (gray.total(F.col("patch")) / 16 / 255).alias("prob"))


_SCORED = f"scored as (select img_id, y, x, {_SUM('patch')} / 16 / 255 as prob from windows)"


@query(f"with {_GRAY}, {_WINDOWS}, {_SCORED}, c as (select img_id, y + a as y, x + b as x, avg(prob) as p from scored, (values (0), (1), (2), (3)) ta(a), (values (0), (1), (2), (3)) tb(b) group by 1, 2, 3) select img_id, y, x, {r('p', 6)} as prob, {r('p', 6)} > 0.5 as hit from c")
def stitch_windows(spark, d):
    return gray.stitch_windows(_scored(spark, d), 4, 0.5)


@query(f"with {_GRAY}, {_WINDOWS}, {_SCORED} select img_id, y, x, case when prob >= 0.4 then 255 else 0 end as mask from scored")
def threshold_mask(spark, d):
    return gray.threshold_mask(_scored(spark, d)).select("img_id", "y", "x", "mask")


_ENTROPY = "-list_sum(list_transform(range(16), lambda b: (len(list_filter(patch, lambda v: v // 16 = b)) / 16) * log2(len(list_filter(patch, lambda v: v // 16 = b)) / 16 + 1e-7::double)))"


@query(f"with {_GRAY}, {_WINDOWS} select img_id, y, x, {r(_MEAN('patch'))} as mean, {r(f'sqrt({_VAR("patch")}) + 1e-7::double')} as std, list_min(patch) as lo, list_max(patch) as hi, {r(_ENTROPY)} as entropy from windows")
def patch_statistics(spark, d):
    return gray.patch_statistics(gray.sliding_windows(_gray(spark, d), 4, 2)).drop("patch")


@query(f"with {_GRAY}, s as (select label, {_MEAN('px')} as m, sqrt({_VAR('px')}) as s from gray8) select label, count(*) as images, {r('avg(m)')} as brightness, {r('stddev_pop(m)')} as brightness_std, {r('avg(s)')} as contrast from s group by 1")
def texture_stats(spark, d):
    return gray.texture_stats(_gray(spark, d), "label")


@query(f"with {_GRAY}, {_WINDOWS}, {_SCORED} select img_id, y, x, (prob > 0.55)::int as target from scored where prob > 0.55 or prob < 0.45")
def labelled_patches(spark, d):
    s = _scored(spark, d)
    return gray.labelled_patches(s.where("prob > 0.55"), s.where("prob < 0.45")).select("img_id", "y", "x", "target")


# --- near duplicates of perceptual hashes ---

_VARIANTS = "variants as (select img_id * 2 as img_id, px from gray8 union all select img_id * 2 + 1, list_transform(range(64), lambda i: case when i = img_id % 64 then least(255, px[i + 1] + 60) else px[i + 1] end) from gray8)"
_VHASH = f"vh as (select img_id, {_HASH} as hash from variants)"


def _variants(spark: SparkSession, d: str) -> DataFrame:
    g = _gray(spark, d)
    raised = F.transform("px", lambda v, i: F.when(i == F.col("img_id") % 64, F.least(F.lit(255), v + 60)).otherwise(v))
    changed = g.select(F.col("img_id").alias("of"), raised.alias("px"))  # apart, as a name that is both read and given anew in one select is ambiguous inside a lambda
    both = g.select((F.col("img_id") * 2).alias("img_id"), "px").unionAll(changed.select((F.col("of") * 2 + 1).alias("img_id"), "px"))
    return both.select("img_id", gray.dhash(F.col("px"), 8, 8).alias("hash"), F.when(F.col("img_id") % 3 == 0, "test").otherwise("train").alias("split"))


@query(f"with {_GRAY}, {_VARIANTS}, {_VHASH}, u as (select distinct hash from vh) select a.hash as a, b.hash as b, bit_count(xor(a.hash, b.hash))::int as dist from u a join u b on a.hash < b.hash and bit_count(xor(a.hash, b.hash)) <= 6")
def near_duplicates(spark, d):
    return near.hash_pairs(_variants(spark, d), "hash", 56, 6)


@query(
    f"""with {_GRAY}, {_VARIANTS}, {_VHASH}, s as (select hash as h, case when img_id % 3 = 0 then 'test' else 'train' end as s from vh group by 1, 2)
    select a.h as a, b.h as b, bit_count(xor(a.h, b.h))::int as dist, a.s as split_a, b.s as split_b from s a join s b on (a.h < b.h or (a.h = b.h and a.s < b.s)) and a.s <> b.s and bit_count(xor(a.h, b.h)) <= 6"""
)
def leak_near(spark, d):
    return near.leak_near(_variants(spark, d), "hash", 56, 6)


@query(
    f"""with recursive {_GRAY}, {_VARIANTS}, {_VHASH}, e as (select a.img_id as a, b.img_id as b from vh a join vh b on bit_count(xor(a.hash, b.hash)) <= 6),
    reach as (select img_id as n, img_id as m from vh union select r.n, e.b from reach r join e on r.m = e.a) select n as img_id, min(m) as component from reach group by 1"""
)
def near_dup_components(spark, d):
    return near.near_dup_components(_variants(spark, d), "img_id", "hash", 56, 6)


_RELATED = "related as (select img_id, hash, 's' || (img_id // 10)::varchar as source_id, case when img_id % 60 = 0 then 'c' || (img_id // 240)::varchar else 'u' || img_id::varchar end as content from vh)"


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Images and their variants with a source of ten of them and a content that a few share across sources."""
    k = F.col("img_id")
    content = F.when(k % 60 == 0, F.concat(F.lit("c"), F.floor(k / 240).cast("string"))).otherwise(F.concat(F.lit("u"), k.cast("string")))
    return _variants(spark, d).select("img_id", "hash", F.concat(F.lit("s"), F.floor(k / 10).cast("string")).alias("source_id"), content.alias("content"))


_NEAR = splits.Near("hash", 56, 6)


@query(
    f"""with recursive {_GRAY}, {_VARIANTS}, {_VHASH}, {_RELATED},
    e as (select a.img_id as a, b.img_id as b from related a join related b on bit_count(xor(a.hash, b.hash)) <= 6 union select a.img_id, b.img_id from related a join related b using (source_id) union select a.img_id, b.img_id from related a join related b using (content)),
    reach as (select img_id as n, img_id as m from related union select r.n, e.b from reach r join e on r.m = e.a) select n as img_id, min(m) as "group" from reach group by 1"""
)
def leak_free_groups(spark, d):
    return splits.leak_free_groups(_related(spark, d), "img_id", ["source_id", "content"], _NEAR)


@query(
    """select * from (values ('content', 0), ('near', 0), ('source_id', 0), ('test over 1 % off', 0), ('train over 1 % off', 0), ('validation over 1 % off', 0)) t(relation, crossing)"""
)
def leak_free_split(spark, d):
    """What crosses the splits of whole groups, by relation, and which splits are off their share; nothing should."""
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    rows = write_table(_related(spark, d), "related")
    grouped = write_table(splits.leak_free_groups(rows, "img_id", ["source_id", "content"], _NEAR).join(rows, "img_id"), "grouped")
    done = write_table(splits.split_by_size(grouped, "group", shares), "splits")
    pairs = near.leak_near(done, *_NEAR)
    found = splits.crossing(done, "source_id").unionAll(splits.crossing(done, "content")).unionAll(pairs.agg(F.lit("near").alias("relation"), F.count("*").alias("crossing")))
    total = done.agg(F.count("*").alias("total"))
    wanted = spark.createDataFrame(list(shares.items()), "split string, share double")
    off = wanted.join(done.groupBy("split").count(), "split", "left").crossJoin(F.broadcast(total)).select(F.concat("split", F.lit(" over 1 % off")).alias("relation"), (F.abs(F.coalesce("count", F.lit(0)) / F.col("total") - F.col("share")) > 0.01).cast("long").alias("crossing"))
    return found.unionAll(off)


# --- evaluation ---

_CONTRAST = lambda p: f"sqrt({_VAR(p)})"
_SNR = lambda p: f"case when {_VAR(p)} = 0 then 40.0 else 20 * log10({_MEAN(p)} / sqrt({_VAR(p)})) end"


def _before_after(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    both = [gray.noref_quality(p.select("img_id", F.col(c).alias("px"))).select("img_id", F.col("contrast").alias(f"contrast_{n}"), F.col("snr").alias(f"snr_{n}")) for c, n in (("b", "before"), ("a", "after"))]
    return both[0].join(both[1], "img_id")


_BA = f"ba as (select img_id, {r(_CONTRAST('b'))} as cb, {r(_CONTRAST('a'))} as ca, {r(_SNR('b'))} as sb, {r(_SNR('a'))} as sa from pairs)"


@query(f"with {_GRAY}, {_PAIRS}, {_BA} select img_id, {r('ca - cb')} as contrast_change, {r('sa - sb')} as snr_change from ba")
def metric_deltas(spark, d):
    rows = tasks.metric_deltas(_before_after(spark, d), ["contrast", "snr"])
    return rows.select("img_id", S.rounded(F.col("contrast_change")).alias("contrast_change"), S.rounded(F.col("snr_change")).alias("snr_change"))


@query(
    f"with {_GRAY}, {_PAIRS}, {_BA} " + " union all ".join(f"select '{m}' as metric, {r(f'avg({k}b)')} as before, {r(f'avg({k}a)')} as after, {r(f'avg({k}a - {k}b)')} as change, {r(f'avg(({k}a - {k}b > 0)::int) * 100')} as rate from ba" for m, k in (("contrast", "c"), ("snr", "s")))
)
def improvement_report(spark, d):
    return tasks.improvement_report(_before_after(spark, d), ["contrast", "snr"])


_CONFIGS = [(1, 0.1, 5.0), (2, 0.1, 7.5), (3, 0.3, 5.0), (4, 0.3, 7.5), (5, 0.5, 5.0), (6, 0.5, 7.5)]
_SWEEP = (
    f"{_GRAY}, {_PAIRS}, m as (select img_id, {r(f'case when {_SQ(_DIFF)} = 0 then 99.0 else 20 * log10(255 / sqrt({_SQ(_DIFF)} / 64)) end')} as psnr from pairs), "
    f"sweep as (select config, strength, guidance, case when img_id % 10 <> 0 then psnr - strength * (img_id % 5) + guidance / 10 end as score from m, (values {', '.join(f'({c}, {a}::double, {b}::double)' for c, a, b in _CONFIGS)}) t(config, strength, guidance)), scores as (select config, strength, {r('avg(score)', 6)} as score, count(score) as n from sweep where score is not null group by 1, 2)"
)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    grid = pairing.sweep_grid(gray.pair_metrics(_pairs(spark, d)), spark.createDataFrame(_CONFIGS, "config int, strength double, guidance double"))
    score = F.when(F.col("img_id") % 10 != 0, F.col("psnr") - F.col("strength") * (F.col("img_id") % 5) + F.col("guidance") / 10)
    return tasks.sweep_scores(grid.withColumn("score", score), ["config", "strength"], "score")


@query(f"with {_SWEEP} select config, strength, score, n from scores")
def sweep_scores(spark, d):
    return _scores(spark, d)


@query(f"with {_SWEEP} select config, score, row_number() over (order by score desc, config) as place from scores")
def leaderboard(spark, d):
    return tasks.leaderboard(_scores(spark, d), "config").select("config", "score", "place")


@query(f"with {_SWEEP}, b as (select strength, config, score, row_number() over (partition by strength order by score desc, config) as k from scores) select strength, config, score, {r('score - (select max(score) from scores)', 6)} as gain from b where k = 1")
def best_config(spark, d):
    return tasks.best_config(_scores(spark, d), "strength", "config")


@query(f"with w as (select label as ckpt, i as idx, {r('avg(embedding[i + 1]::double)', 6)} as val from embeddings, range(64) t(i) group by 1, 2), c as (select *, abs(val - lag(val) over (partition by idx order by ckpt)) as d from w) select ckpt, {r('avg(d)', 6)} as mean_change, {r('max(d)', 6)} as max_change, {r('avg(val)', 6)} as mean, {r('stddev_pop(val)', 6)} as std, {r('min(val)', 6)} as lo, {r('max(val)', 6)} as hi from c group by 1")
def checkpoint_drift(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("ckpt"), F.posexplode("embedding").alias("idx", "v"))
    return tasks.checkpoint_drift(e.groupBy("ckpt", "idx").agg(S.rounded(F.avg(F.col("v").cast("double")), 6).alias("val")))


_PLAN_SQL = "('0x' || substr(sha256(img_id::varchar || '|' || level || '|11'), 1, 8))::bigint"


@query(f"with {_GRAY} select img_id, level, {_PLAN_SQL} % 1000000 as seed, severity, 8 as width, 8 as height, {r('severity * 0.5')} as sepia, {r('severity * 0.3')} as fade, {r('severity * 0.8')} as vignette, {r('severity * 40')} as grain, round_even(severity * 12, 0)::int as scratches, round_even(severity * 4, 0)::int as stains from gray8, (values ('light', 0.3::double), ('medium', 0.6::double), ('heavy', 0.9::double)) t(level, severity)")
def plan_variants(spark, d):
    from tintype.operators.images import plan_variants as plan

    return plan(_gray(spark, d).select("img_id", F.lit(8).alias("width"), F.lit(8).alias("height")), "img_id", 11).select("img_id", "level", "seed", "severity", "width", "height", "params.*")


@query(f"with {_GRAY}, p as (select img_id, k, ('0x' || substr(sha256(img_id::varchar || '|' || k::varchar || '|9'), 1, 8))::bigint as h from gray8, range(3) t(k)) select img_id, k::int as k, (h % 5)::int as y, ((h // 5) % 5)::int as x from p")
def random_patches(spark, d):
    from tintype.operators.images import random_patches as plan

    return plan(_gray(spark, d).select("img_id", F.lit(8).alias("width"), F.lit(8).alias("height")), "img_id", 3, 4, 9).select("img_id", "k", "y", "x")
