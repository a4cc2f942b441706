"""Registered queries of the dataset operators, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintype.functions import scalars as S
from tintype.operators import audit, intake, near, pairing, release, tasks
from tintype.plans.views import sql as V
from tintype.plans.views import view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r(x: str, digits: int = 3) -> str:
    """The oracle's form of ``rounded``."""
    return f"round_even(({x}) * {10**digits}, 0) / {10**digits}"


_NORM = "trim(regexp_replace(lower(replace(license, '-', ' ')), '\\s+', ' ', 'g'))"
_OK = f"coalesce({_NORM} in ('public domain', 'cc0', 'cc0 1.0', 'cc0 1.0 universal', 'cc by 3.0', 'cc by 4.0'), false)"
_STEM = "regexp_replace(filename, '[.][^.]*$', '')"
_BASE = "regexp_replace(regexp_replace(filename, '[.][^.]*$', ''), '_\\([^)]*\\)$', '')"
_SPLIT = "case when b < 80 then 'train' when b < 90 then 'validation' else 'test' end"
_BUCKET = "('0x' || substr(sha256(source_id || '|42'), 1, 8))::bigint % 100"
_MSPLIT = f"ms as (select *, {_SPLIT} as split from (select *, {_BUCKET} as b from manifest))"
_CLEAN = """fit as (select *, decode_ok and least(width, height) >= 768 as fit from manifest),
 firsts as (select sha256 as k, min(pos) as p, arg_min(source_id, pos) as n from fit where fit group by 1),
 cleaned as (select fit.*, case when not decode_ok then 'decode_error' when not fit then 'low_resolution' when pos <> p then 'duplicate_of:' || n end as reason from fit left join firsts on sha256 = k)"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "manifest")


def _split(spark: SparkSession, d: str) -> DataFrame:
    return pairing.split_by_group(_manifest(spark, d))


# --- scalar functions ---


@query(f"with {V('manifest')} select pos, {_NORM} as norm, {_OK} as ok from manifest")
def license_ok(spark, d):
    return _manifest(spark, d).select("pos", S.license_norm(F.col("license")).alias("norm"), S.license_ok(F.col("license")).alias("ok"))


@query("select page_id, regexp_replace(url, '#.*$', '') as url from pages")
def clean_url(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.clean_url(F.col("url")).alias("url"))


_URLS = "[url || '#h=100&w=' || page_id::varchar, url || '#h=200&w=' || (page_id % 50)::varchar, url]"


def _items(spark: SparkSession, d: str) -> DataFrame:
    u, p = F.col("url"), F.col("page_id")
    bare = S.clean_url(u)
    urls = F.array(F.concat(bare, F.lit("#h=100&w="), p.cast("string")), F.concat(bare, F.lit("#h=200&w="), (p % 50).cast("string")), bare)
    return view(spark, d, "catalog_items").withColumn("image_urls", urls)


@query("select page_id, 100 * page_id as area1, 200 * (page_id % 50) as area2 from pages")
def image_area(spark, d):
    return _items(spark, d).select("page_id", S.image_area(F.col("image_urls")[0]).alias("area1"), S.image_area(F.col("image_urls")[1]).alias("area2"))


@query("select page_id, regexp_replace(url, '#.*$', '') as url, case when 100 * page_id >= 200 * (page_id % 50) then 1 else 2 end as place from pages")
def select_image_url(spark, d):
    urls = F.col("image_urls")
    marked = F.transform(urls, lambda u: F.replace(u, F.lit("#"), F.concat(F.lit("?k="), F.substring(F.regexp_extract(u, "h=([0-9])", 1), 1, 1), F.lit("#"))))
    place = F.regexp_extract(S.select_image_url(marked), r"\?k=([0-9])$", 1).cast("int")
    return _items(spark, d).select("page_id", S.select_image_url(urls).alias("url"), place.alias("place"))


@query(f"with {V('catalog_items')} select pos, case when page_id % 2 = 0 then contributor else 'A ' || page_id::varchar || '|B' end as contributors from catalog_items")
def scalar_or_list(spark, d):
    return view(spark, d, "catalog_items").select("pos", F.array_join(S.scalar_or_list(F.col("contributor")), "|").alias("contributors"))


@query("select page_id, coalesce(nullif(trim(regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown') as id from pages")
def item_identifier(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", S.item_identifier(F.lit(""), F.lit(None).cast("string"), F.col("url")).alias("id"))


@query(f"with {V('manifest')} select pos, case format when 'JPEG' then '.jpg' when 'PNG' then '.png' when 'TIFF' then '.tif' when 'WEBP' then '.webp' else '.img' end as ext from manifest")
def image_extension(spark, d):
    return _manifest(spark, d).select("pos", S.image_extension(F.col("format")).alias("ext"))


@query(f"with {V('manifest')} select pos, regexp_matches(filename, '^[A-Za-z0-9_.-]+[.][A-Za-z0-9]+$') as name_ok, regexp_matches(filename, '^[A-Za-z0-9_-]+$') as batch_ok, regexp_matches(source_id, '^[A-Za-z0-9_-]+$') as source_ok from manifest")
def valid_names(spark, d):
    return _manifest(spark, d).select("pos", S.valid_filename(F.col("filename")).alias("name_ok"), S.valid_batch_id(F.col("filename")).alias("batch_ok"), S.valid_batch_id(F.col("source_id")).alias("source_ok"))


@query(f"with {V('degraded_files')} select filename, {_BASE} as base from degraded_files")
def variant_base(spark, d):
    return view(spark, d, "degraded_files").select("filename", S.variant_base(F.col("filename")).alias("base"))


@query(f"with {V('manifest')} select pos, least(width, height) as short_side, {r('width / height', 4)} as aspect_ratio, width::varchar || 'x' || height::varchar as resolution from manifest")
def geometry(spark, d):
    return intake.geometry(_manifest(spark, d)).select("pos", "short_side", "aspect_ratio", "resolution")


@query(
    f"""with {V('task_events')}, s as (select event_id, mode, coalesce(strength, 0.35) as s from task_events),
    m as (select event_id, case mode when 'quick' then 0.6 when 'fine' then greatest(0.3, least(1.0, s + 0.2)) else 0.5 end as detect, case mode when 'quick' then 0.1 when 'fine' then s else 0.05 end as restore from s)
    select event_id, {r('detect', 6)} as detect, {r('restore', 6)} as restore from m"""
)
def mode_strengths(spark, d):
    s = S.mode_strengths(F.col("mode"), F.col("strength"))
    return view(spark, d, "task_events").select("event_id", S.rounded(s["detect"], 6).alias("detect"), S.rounded(s["restore"], 6).alias("restore"))


@query("select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(
    f"""with {V('catalog_items')}, i as (select *, case when pos % 3 = 0 then '' when pos % 3 = 1 then 'T ' || pos end as title, 'N ' || pos as item_title, case when pos % 4 = 0 then '["x","y"]' when pos % 4 = 1 then '' else 'z' end as subject, case pos % 5 when 0 then 'JPEG' when 1 then 'png' when 2 then 'TIFF' when 3 then 'GIF' end as format from catalog_items)
    select pos, id, id || ext as filename, 'P' as provider, 'C' as collection, coalesce(nullif(title, ''), item_title) as title, null::varchar as date, case when page_id % 2 = 0 then contributor else 'A ' || page_id::varchar || '|B' end as contributors,
    case when pos % 4 = 0 then 'x|y' when pos % 4 = 1 then '' else 'z' end as subjects, '' as description, url as item_url, regexp_replace(url, '#.*$', '') as image_url, 'CC0' as license, null::varchar as rights_statement, 'R' as rights_url, size::bigint as width, null::bigint as height, null::varchar as mode, sha256, null::varchar as dhash, null::varchar as downloaded_at, ext as extension
    from (select *, coalesce(nullif(trim(regexp_replace(string_split(rtrim(url, '/'), '/')[-1], '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'unknown') as id, case format when 'JPEG' then '.jpg' when 'png' then '.png' when 'TIFF' then '.tif' else '.img' end as ext from i)"""
)
def build_records(spark, d):
    fresh = {"title": "case when pos % 3 = 0 then '' when pos % 3 = 1 then 'T ' || pos end", "item_title": "'N ' || pos", "subject": """case when pos % 4 = 0 then '["x","y"]' when pos % 4 = 1 then '' else 'z' end""", "format": "case pos % 5 when 0 then 'JPEG' when 1 then 'png' when 2 then 'TIFF' when 3 then 'GIF' end", "width": "cast(size as bigint)"}
    items = _items(spark, d).withColumns({k: F.expr(x) for k, x in fresh.items()})
    made = intake.build_records(items, {"provider": "P", "collection": "C", "license": "CC0", "rights_url": "R"})
    return made.withColumns({c: F.array_join(c, "|") for c in ("contributors", "subjects", "description")}).withColumn("height", F.col("height").cast("long"))


# --- intake and cleaning ---


@query(f"with {V('manifest')} select pos, case when least(width, height) < 768 then 'low_resolution' end as reason from manifest")
def screen_resolution(spark, d):
    return intake.screen_resolution(_manifest(spark, d)).select("pos", "reason")


@query(f"with {V('manifest')} select pos, source_id from manifest where {_OK}")
def rights_gate(spark, d):
    return intake.rights_gate(_manifest(spark, d)).select("pos", "source_id")


@query(f"with {V('catalog_items')} select pos, access_restricted is distinct from true and unrestricted is distinct from false as ok from catalog_items")
def access_ok(spark, d):
    return view(spark, d, "catalog_items").select("pos", intake.access_ok().alias("ok"))


@query(f"with {V('manifest')}, f as (select sha256 as k, min(pos) as p, arg_min(source_id, pos) as n from manifest group by 1) select pos, case when pos <> p then n end as keeper from manifest join f on sha256 = k")
def dedupe_first(spark, d):
    return intake.dedupe_first(_manifest(spark, d)).select("pos", "keeper")


@query(
    f"with {V('manifest')}, {_CLEAN} select pos, source_id, reason, case when reason is null then 'CLEANED' else 'REJECTED' end as status, case when reason = 'decode_error' then 0 else width end as work_width, case when reason = 'decode_error' then 0 else height end as work_height, case when reason is null then 'RGB' end as color_mode from cleaned"
)
def clean_batch(spark, d):
    return intake.clean_batch(_manifest(spark, d)).select("pos", "source_id", "reason", "status", "work_width", "work_height", "color_mode")


@query(f"with {V('manifest')}, {_CLEAN} select string_split(reason, ':')[1] as reason, count(*) as n from cleaned where reason is not null group by 1")
def reject_reasons(spark, d):
    return intake.reject_reasons(intake.clean_batch(_manifest(spark, d)))


@query(f"with {V('manifest')}, {_CLEAN} select provider, case when reason is null then 'CLEANED' else 'REJECTED' end as status, count(*) as n from cleaned group by 1, 2")
def status_counts(spark, d):
    return intake.status_counts(intake.clean_batch(_manifest(spark, d)), "provider")


_RAW = {"collection": "'c' || pos % 3", "title": "case when pos % 4 = 0 then null else 'T ' || pos end", "item_url": "'http://x/' || pos", "rights_url": "'http://r/' || pos % 5", "downloaded_at": "'2024-01-0' || (1 + pos % 9)", "mode": "case when pos % 2 = 0 then 'RGB' else 'L' end"}


@query(
    f"""with {V('manifest')}, raw as (select * replace (case when pos % 7 = 0 then '' else sha256 end as sha256), sha256 as file_sha256, {', '.join(f'{x} as {k}' for k, x in _RAW.items())} from manifest)
    select 'loc_' || id as id, 'loc_' || id as source_id, filename, case when {_OK} then 'RIGHTS_OK' else 'NEW' end as status, 'real_damaged' as dataset_kind, provider, item_url as source_url, case when pos % 3 = 0 then '' when pos % 3 = 1 then 'A ' || pos else 'A ' || pos || '; B' end as author,
    coalesce(license, '') as license, rights_url, downloaded_at, file_sha256 as sha256, width, height, content_type, mode as color_mode, 'existing_damage' as quality_label, '' as split, 'op' as annotator, '' as reviewer, coalesce(title, '') as notes from raw"""
)
def intake_project(spark, d):
    raw = _manifest(spark, d).withColumns({k: F.expr(x) for k, x in _RAW.items()}).withColumn("file_sha256", F.col("sha256")).withColumn("sha256", F.when(F.col("pos") % 7 == 0, "").otherwise(F.col("sha256")))
    people = F.slice(F.array(F.concat(F.lit("A "), F.col("pos").cast("string")), F.lit("B")), F.lit(1), (F.col("pos") % 3).cast("int"))
    return intake.intake_project(raw.withColumn("contributors", people), "op")


@query(
    f"with {V('manifest')}, f as (select * from manifest where pos % 11 <> 0) select 'imported' as \"check\", count(*) as n from f union all select 'missing', (select count(*) from manifest) - (select count(*) from f) union all select 'status:' || case when {_OK} then 'RIGHTS_OK' else 'NEW' end, count(*) from f group by 1"
)
def intake_report(spark, d):
    m = _manifest(spark, d)
    return intake.intake_report(m, m.where("pos % 11 <> 0").select("filename"))


@query(
    f"""with {V('catalog_items')}, i as (select *, 'p' || page_id::varchar as id, 300 + size % 1200 as short_side, size % 13 <> 0 as decode_ok, case when page_id % 10 = 9 then null else url end as image_url from catalog_items),
    j as (select *, {_OK} as lic, access_restricted is distinct from true and unrestricted is distinct from false as acc from i), fit as (select sha256 as k, min(pos) as p from j where lic and acc and image_url is not null and decode_ok and short_side >= 768 group by 1)
    select pos, case when not lic then 'license' when not acc then 'access' when image_url is null then 'no_image_url' when not decode_ok then 'decode_error' when short_side < 768 then 'short_side_' || short_side::varchar when pos <> p then 'duplicate_content' else 'accepted' end as verdict from j left join fit on sha256 = k"""
)
def classify_intake(spark, d):
    items = view(spark, d, "catalog_items").withColumns(
        {"id": F.concat(F.lit("p"), F.col("page_id").cast("string")), "short_side": 300 + F.col("size") % 1200, "decode_ok": F.col("size") % 13 != 0, "image_url": F.when(F.col("page_id") % 10 != 9, F.col("url"))}
    )
    return intake.classify_intake(items).select("pos", "verdict")


@query(f"with {V('manifest')}, {_CLEAN} select pos, source_id from cleaned where reason is null order by pos limit 25")
def take_accepted(spark, d):
    return intake.take_accepted(intake.clean_batch(_manifest(spark, d)), 25, F.col("reason").isNull()).select("pos", "source_id")


@query(
    f"with {V('manifest')}, k as (select sha256, count(*) as n from manifest group by 1) select (select count(*) from manifest) as items, arg_min(provider, pos) as provider, (select license from manifest order by pos limit 1) as license, min(least(width, height)) as min_short, max(least(width, height)) as max_short, (select sum(n - 1) from k)::bigint as surplus, (select count(*) from k where n > 1) as shared_hashes from manifest"
)
def collection_summary(spark, d):
    return intake.collection_summary(_manifest(spark, d))


@query(f"with {V('manifest')}, {_CLEAN} select pos, source_id, '' as scratch, '0' as uncertain, 'ann' as annotator, '' as reviewer, 'PENDING_MANUAL' as status from cleaned where reason is null")
def annotation_task(spark, d):
    return intake.annotation_task(intake.clean_batch(_manifest(spark, d)), "ann").select("pos", "source_id", "scratch", "uncertain", "annotator", "reviewer", "status")


@query(
    f"""with {V('manifest')}, {_CLEAN}, c as (select case when pos % 2 = 0 then 'cleaned' else 'imported' end as stage, case when reason is null then 'CLEANED' else 'REJECTED' end as status from cleaned where pos % 2 = 0 or reason is null),
    s as (select * from (values (0, 'imported'), (1, 'cleaned'), (2, 'annotated')) t(ord, stage)), g as (select stage, count(*) as n, count(*) filter (where status = 'REJECTED') as blocked from c group by 1)
    select stage, ord, coalesce(n, 0) as "rows", coalesce(blocked, 0) as blocked, case when n is null then 'NOT_STARTED' when blocked > 0 then 'BLOCKED' else 'PASS' end as state from s left join g using (stage)"""
)
def batch_status(spark, d):
    c = intake.clean_batch(_manifest(spark, d)).where("pos % 2 = 0 or reason is null").withColumn("stage", F.when(F.col("pos") % 2 == 0, "cleaned").otherwise("imported"))
    return intake.batch_status(intake.status_counts(c, "stage"), ["imported", "cleaned", "annotated"])


# --- audit ---


def _stats(column: str, by: str = "") -> str:
    return f"select {by + ', ' if by else ''}'{column}' as \"column\", {r(f'min({column})')} as min, {r(f'quantile_cont({column}::double, 0.5)')} as median, {r(f'max({column})')} as max, {r(f'avg({column})')} as mean from manifest{' group by 1' if by else ''}"


@query(f"with {V('manifest')} {_stats('width', 'provider')} union all {_stats('height', 'provider')}")
def describe(spark, d):
    return audit.describe(_manifest(spark, d), ["width", "height"], ["provider"])


@query(
    f"with {V('manifest')}, l as (select 'width' as \"column\", width::double as v from manifest union all select 'n_chars', n_chars::double from manifest) select \"column\", {r('min(v)')} as min, {r('quantile_cont(v, 0.1)')} as p10, {r('quantile_cont(v, 0.5)')} as median, {r('quantile_cont(v, 0.9)')} as p90, {r('max(v)')} as max, {r('avg(v)')} as mean from l group by 1"
)
def percentiles(spark, d):
    return audit.percentiles(_manifest(spark, d), ["width", "n_chars"])


@query(f"with {V('manifest')} select sha256, count(*) as copies, min(id) as first_name from manifest group by 1 having count(*) > 1")
def duplicate_groups(spark, d):
    return audit.duplicate_groups(_manifest(spark, d), "sha256")


@query(f"with {V('manifest')} select sha256, id from manifest where sha256 in (select sha256 from manifest group by 1 having count(*) > 1)")
def duplicate_members(spark, d):
    return audit.duplicate_members(_manifest(spark, d), "sha256")


@query(f"with {V('manifest')} select pos, width < 256 or height < 256 as under_256, width < 512 or height < 512 as under_512, {r('width / height', 4)} < 0.45 or {r('width / height', 4)} > 2.2 as extreme_aspect from manifest")
def flag_geometry(spark, d):
    return audit.flag_geometry(_manifest(spark, d)).select("pos", "under_256", "under_512", "extreme_aspect")


@query(f"with {V('manifest')} select width, count(*) as n from manifest group by 1 order by n desc, width limit 10")
def top_counts(spark, d):
    return audit.top_counts(_manifest(spark, d), "width", 10)


@query(
    f"with {V('clean_files')}, {V('damaged_files')}, {V('degraded_files')}, c as (select {_STEM} as name from clean_files), a as (select {_STEM} as name from damaged_files), v as (select {_BASE} as name from degraded_files) "
    "select 'clean_without_damaged' as \"check\", name from (select name from c except select name from a) union all select 'damaged_without_clean', name from (select name from a except select name from c) union all select 'clean_without_degraded', name from (select name from c except select name from v)"
)
def variant_pairing(spark, d):
    return audit.variant_pairing(view(spark, d, "clean_files"), view(spark, d, "damaged_files"), view(spark, d, "degraded_files"))


@query(f"with {V('degraded_files')}, g as (select {_BASE} as base, count(*) as variants from degraded_files group by 1) select variants, count(*) as bases from g group by 1")
def variant_histogram(spark, d):
    return audit.variant_histogram(view(spark, d, "degraded_files"))


@query(
    f"with {V('manifest')}, m as (select distinct sha256 from manifest where pos % 3 <> 0), o as (select distinct sha256 from manifest where pos % 5 = 0) select (select count(*) from m) as main_distinct, (select count(*) from o) as other_distinct, (select count(*) from m where sha256 not in (select sha256 from o)) as only_main, (select count(*) from o where sha256 not in (select sha256 from m)) as only_other, (select count(*) from o where sha256 not in (select sha256 from m)) = 0 as other_is_subset"
)
def compare_content(spark, d):
    m = _manifest(spark, d)
    return audit.compare_content(m.where("pos % 3 <> 0"), m.where("pos % 5 = 0"))


# --- joins and splits ---


@query(f"with {V('manifest')} select pos, filename, pos % 11 = 0 as missing from manifest")
def attach_files(spark, d):
    m = _manifest(spark, d)
    found, missing = pairing.attach_files(m, m.where("pos % 11 <> 0").select("filename"))
    return found.select("pos", "filename", F.lit(False).alias("missing")).unionByName(missing.select("pos", "filename", F.lit(True).alias("missing")))


@query(f"with {V('clean_files')}, {V('damaged_files')} select c.filename as name, c.p_partkey as clean_key, d.p_partkey as degraded_key from clean_files c join damaged_files d on c.filename = d.filename")
def pair_images(spark, d):
    return pairing.pair_images(view(spark, d, "clean_files"), view(spark, d, "damaged_files"))


@query(f"with {V('clean_files')} select filename as name, case when p_partkey % 3 <> 0 then 'p_' || p_partkey::varchar || case when p_partkey % 3 = 1 then '.jpg' else '.png' end end as mask from clean_files")
def attach_masks(spark, d):
    c = view(spark, d, "clean_files")
    masks = c.where("p_partkey % 3 <> 0").select(F.concat(F.lit("p_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 1, ".jpg").otherwise(".png")).alias("filename"))
    return pairing.attach_masks(c.select(F.col("filename").alias("name")), masks)


@query(f"with {V('manifest')}, k as (select * from manifest where pos % 4 = 0) select id, pos from manifest where id not in (select id from k) and sha256 not in (select sha256 from k)")
def new_items(spark, d):
    m = _manifest(spark, d)
    return pairing.new_items(m, m.where("pos % 4 = 0")).select("id", "pos")


@query(f"with {V('clean_files')}, n as (select filename, row_number() over (order by filename) as seq, p_partkey from clean_files) select filename, seq, seq + 42 as item_seed from n where p_partkey % 10 = 0")
def pending(spark, d):
    return pairing.pending(view(spark, d, "clean_files"), view(spark, d, "damaged_files"), seed=42).select("filename", "seq", "item_seed")


_ADDRESS = lambda p: f"sha256(coalesce(sha256, '') || '|{p}')"


@query(
    f"""with {V('manifest')}, done as (select {_ADDRESS('{"size": 512, "strength": 0.5}')} as address from manifest where pos % 3 <> 0 union select {_ADDRESS('{"size": 768, "strength": 0.5}')} from manifest where pos % 4 = 0)
    select pos, {_ADDRESS('{"size": 768, "strength": 0.5}')} as address from manifest where {_ADDRESS('{"size": 768, "strength": 0.5}')} not in (select address from done)"""
)
def pending_by_content(spark, d):
    """What is left to do after the size was raised: outputs of the former size are there, and a quarter of those of the new one."""
    m = _manifest(spark, d)
    before, now = {"strength": 0.5, "size": 512}, {"strength": 0.5, "size": 768}
    outputs = pairing.addressed(m.where("pos % 3 <> 0"), before).unionByName(pairing.addressed(m.where("pos % 4 = 0"), now))
    return pairing.pending_by_content(m, outputs, now).select("pos", "address")


@query(f"with {V('clean_files')} select filename, row_number() over (order by filename) as seq, row_number() over (order by filename) + 7 as item_seed from clean_files")
def item_seed(spark, d):
    return pairing.item_seed(view(spark, d, "clean_files"), 7).select("filename", "seq", "item_seed")


@query(f"with {V('manifest')}, {_MSPLIT} select sha256, count(distinct split) as splits, count(*) as \"rows\" from ms group by 1 having count(distinct split) > 1")
def leak_exact(spark, d):
    return pairing.leak_exact(_split(spark, d))


@query(f"with {V('clean_files')} select filename as name, p_partkey % 2 = 0 as has_condition, p_partkey % 5 <> 0 as has_mask from clean_files")
def training_samples(spark, d):
    c = view(spark, d, "clean_files").withColumnRenamed("filename", "name")
    return pairing.training_samples(c, c.where("p_partkey % 2 = 0"), c.where("p_partkey % 5 <> 0"))


_CONFIGS = [(0.1, 5.0), (0.1, 7.5), (0.3, 5.0), (0.3, 7.5), (0.5, 5.0), (0.5, 7.5)]


@query(f"with {V('clean_files')} select filename, strength, guidance from clean_files cross join (values {', '.join(f'({a}::double, {b}::double)' for a, b in _CONFIGS)}) t(strength, guidance)")
def sweep_grid(spark, d):
    return pairing.sweep_grid(view(spark, d, "clean_files").select("filename"), spark.createDataFrame(_CONFIGS, "strength double, guidance double"))


# clean names hold the part's number at their end or in their middle; of the damaged ones every third has no _dmg_ and is itself the fragment
_REFERENCES = """c as (select case p_partkey % 3 when 0 then 'met_' when 1 then 'europ_9_' else 'other_' end || (p_partkey % 400)::varchar || '_' || p_partkey::varchar || case when p_partkey % 2 = 0 then '_v2.jpg' else '.jpg' end as filename from part),
    d as (select case when p_partkey % 9 = 0 then p_partkey::varchar || '_v2' when p_partkey % 27 = 3 then 'x_dmg_' || left(p_partkey::varchar, 2) || '_dmg_y' else 'x_dmg_' || p_partkey::varchar end || '.png' as filename from part where p_partkey % 3 = 0),
    b as (select filename as damaged, regexp_replace(filename, '[.]png$', '') as s from d)"""


@query(f"with {_REFERENCES} select damaged, min(filename) as reference from b left join c on (starts_with(filename, 'met_') or starts_with(filename, 'europ_9')) and contains(filename, case when contains(s, '_dmg_') then split_part(s, '_dmg_', 2) else s end) group by 1")
def match_reference(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    key = k.cast("string")
    kind = F.when(k % 3 == 0, "met_").when(k % 3 == 1, "europ_9_").otherwise("other_")
    clean = part.select(F.concat(kind, (k % 400).cast("string"), F.lit("_"), key, F.when(k % 2 == 0, "_v2.jpg").otherwise(".jpg")).alias("filename"))
    name = F.when(k % 9 == 0, F.concat(key, F.lit("_v2"))).when(k % 27 == 3, F.concat(F.lit("x_dmg_"), F.left(key, F.lit(2)), F.lit("_dmg_y"))).otherwise(F.concat(F.lit("x_dmg_"), key))
    damaged = part.where("p_partkey % 3 = 0").select(F.concat(name, F.lit(".png")).alias("filename"))
    return pairing.match_reference(damaged, clean)


@query(
    f"with {V('clean_files')}, t as (select 'tex_' || n_nationkey::varchar as texture from nation), o as (select filename, texture, row_number() over (partition by filename order by sha256(filename || '|' || texture || '|5')) - 1 as slot from clean_files cross join t) select filename, slot, texture from o where slot < 3"
)
def assign_textures(spark, d):
    textures = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("tex_"), F.col("n_nationkey").cast("string")).alias("texture"))
    return pairing.assign_textures(view(spark, d, "clean_files").select("filename"), textures, 3, 5)


@query(
    f"with {V('clean_files')}, n as (select filename, row_number() over (order by filename) - 1 as i, count(*) over () as c from clean_files), p as (select case when k = 19 then c - 1 else floor(k * ((c - 1) / 19.0::double))::bigint end as i from range(20) t(k), (select max(c) as c from n)) select filename, case when i in (select i from p) then 'test' else 'train' end as split from n"
)
def split_linspace(spark, d):
    return pairing.split_linspace(view(spark, d, "clean_files"), 20, "filename").select("filename", "split")


@query(
    f"with {V('clean_files')}, n as (select filename, row_number() over (order by filename) - 1 as i, greatest(1, count(*) over () // 30) as k from clean_files) select filename, case when i % k = 0 and i // k < 30 then 'test' else 'train' end as split from n"
)
def split_stride(spark, d):
    return pairing.split_stride(view(spark, d, "clean_files"), 30, "filename").select("filename", "split")


@query(
    f"with {V('clean_files')}, n as (select filename, row_number() over (order by sha256(filename || '|42'), filename) as i, count(*) over () as c from clean_files) select filename, case when i <= least(10, c // 10) then 'test' else 'train' end as split from n"
)
def split_random(spark, d):
    return pairing.split_random(view(spark, d, "clean_files"), "filename", 42).select("filename", "split")


@query(f"with {V('manifest')}, {_MSPLIT} select pos, source_id, split from ms")
def split_by_group(spark, d):
    return _split(spark, d).select("pos", "source_id", "split")


@query(f"with {V('clean_files')} select filename, case when p_partkey % 40 = 0 then 'test' else 'train' end as split from clean_files")
def split_named(spark, d):
    c = view(spark, d, "clean_files")
    return pairing.split_named(c, c.where("p_partkey % 40 = 0")).select("filename", "split")


@query(
    f"with {V('manifest')}, n as (select provider, id, row_number() over (partition by provider order by sha256(id || '|20260719'), id) as i, count(*) over (partition by provider) as c from manifest) select provider, id from n where i <= greatest(10, ceil(c * 0.1::double))"
)
def review_sample(spark, d):
    return pairing.review_sample(_manifest(spark, d), "provider", "id", 0.1, 10, 20260719).select("provider", "id")


@query(f"with {V('clean_files')} select filename from clean_files order by filename limit 20")
def head_sorted(spark, d):
    return pairing.head_sorted(view(spark, d, "clean_files").select("filename"), 20, "filename")


# --- annotations and releases ---

_LABELS = release.DAMAGE_LABELS
_ERRORS = " union all ".join(
    [f"select pos, source_id, 'wrong_status' as error from annotations where status not in ('ANNOTATED', 'REVIEWED')"]
    + [f"select pos, source_id, 'invalid_{c}' from annotations where status in ('ANNOTATED', 'REVIEWED') and {c} not in ('0', '1', '2', '3')" for c in _LABELS]
    + ["select pos, source_id, 'no_damage' from annotations where status in ('ANNOTATED', 'REVIEWED') and not (" + " or ".join(f"{c} in ('1', '2', '3')" for c in _LABELS) + ")"]
    + ["select pos, source_id, 'no_annotator' from annotations where status in ('ANNOTATED', 'REVIEWED') and annotator = ''"]
)
_LONG = lambda t: " union all ".join(f"select source_id, '{c}' as label, {c} as severity from {t}" for c in _LABELS)


@query(f"with {V('annotations')} {_ERRORS}")
def validate_annotations(spark, d):
    return release.validate_annotations(view(spark, d, "annotations"))


@query(f"with {V('annotations')}, e as ({_ERRORS}) select (select count(*) from annotations) as \"rows\", (select count(*) from annotations where status in ('ANNOTATED', 'REVIEWED')) as completed, (select count(*) from e) as errors, (select count(*) from e) = 0 as valid")
def annotation_report(spark, d):
    return release.annotation_report(view(spark, d, "annotations"))


@query(f"with {V('annotations')}, l as ({_LONG('annotations')}) select label, severity, count(*) as n from l group by 1, 2")
def severity_distribution(spark, d):
    return release.severity_distribution(view(spark, d, "annotations"))


@query(
    f"with {V('annotations')}, {V('annotations_b')}, x as ({_LONG('annotations')}), y as ({_LONG('annotations_b')}) select x.source_id, x.label, try_cast(x.severity as int) as a, try_cast(y.severity as int) as b, abs(try_cast(x.severity as int) - try_cast(y.severity as int)) as gap from x join y on x.source_id = y.source_id and x.label = y.label where abs(try_cast(x.severity as int) - try_cast(y.severity as int)) >= 2"
)
def annotator_conflicts(spark, d):
    return release.annotator_conflicts(view(spark, d, "annotations"), view(spark, d, "annotations_b"))


@query(
    f"""with {V('manifest')}, {_CLEAN}, v as (select *, case when pos % 29 = 0 then null else reason end as given from cleaned)
    select pos, 'content_type' as violation from v where content_type = '' union all select pos, 'quality_label' from v where quality_label = 'bad_value'
    union all select pos, 'accepted_unlabelled' from v where reason is null and content_type = '' union all select pos, 'rejected_without_reason' from v where reason is not null and given is null"""
)
def check_labels(spark, d):
    cleaned = intake.clean_batch(_manifest(spark, d))
    return release.check_labels(cleaned.withColumn("reason", F.when(F.col("pos") % 29 != 0, F.col("reason"))))


@query(f"with {V('manifest')} select pos, source_id from manifest where quality_label = 'clean_target_ok'")
def clean_targets(spark, d):
    return release.clean_targets(_manifest(spark, d)).select("pos", "source_id")


@query(
    f"""with {V('manifest')}, c as (select 'rows_equal_files' as "check", count(*) filter (where pos % 11 = 0) as value from manifest union all select 'duplicate_source_id', count(*) - count(distinct source_id) from manifest union all select 'no_license', count(*) filter (where trim(coalesce(license, '')) = '') from manifest
    union all select 'no_provider', count(*) filter (where trim(coalesce(provider, '')) = '') from manifest union all select 'no_sha256', count(*) filter (where trim(coalesce(sha256, '')) = '') from manifest) select "check", value, value = 0 as ok from c"""
)
def handoff_checks(spark, d):
    m = _manifest(spark, d)
    return release.handoff_checks(m, m.where("pos % 11 <> 0"))


@query(
    f"""with {V('annotations')}, m as (select source_id, pos % 13 as k, uncertain, notes from annotations)
    select source_id, 'size_mismatch' as failure from m where k = 1 union all select source_id, 'all_0' from m where k = 2 union all select source_id, 'all_255' from m where k = 3 union all select source_id, 'not_binary' from m where k = 4 union all select source_id, 'name_mismatch' from m where k = 5 union all select source_id, 'uncertain_without_notes' from m where uncertain = '1' and notes = ''"""
)
def mask_checks(spark, d):
    a = view(spark, d, "annotations")
    k = F.col("pos") % 13
    masks = a.select("source_id", F.when(k == 5, F.lit("other.png")).otherwise(F.concat("source_id", F.lit(".png"))).alias("mask_name"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.when(k == 1, 7).otherwise(8).alias("mask_width"), F.lit(8).alias("mask_height"), F.when(k == 2, 0).otherwise(255).alias("max_value"), F.when(k == 3, 255).otherwise(0).alias("min_value"), F.when(k == 4, 5).otherwise(0).alias("other_values"))
    return release.mask_checks(masks, a)


_CARD = ["provider", "license", "content_type", "quality_label", "split"]


@query(f"with {V('manifest')}, {_MSPLIT} select 'all' as dimension, null::varchar as value, count(*) as n from ms " + " ".join(f"union all select '{c}', {c}, count(*) from ms group by 2" for c in _CARD))
def dataset_card(spark, d):
    return release.dataset_card(_split(spark, d), _CARD)


_MIX = {"single_portrait": 0.35, "group_portrait": 0.20, "indoor_scene": 0.25, "architecture": 0.15, "document": 0.05}


@query(
    f"with {V('manifest')}, t as (select * from (values {', '.join(f"('{k}', {v}::double)" for k, v in _MIX.items())}) t(value, target)), s as (select value, target, {r('(select count(*) from manifest where content_type = value) / (select count(*) from manifest)', 4)} as share from t) select value, share, target, {r('share - target', 4)} as gap from s"
)
def mix_check(spark, d):
    return release.mix_check(_manifest(spark, d), "content_type", _MIX)


@query(
    f"""with {V('manifest')}, {_MSPLIT}, k as (select count(*) as n, count(distinct split) as s from ms group by sha256), g as (
    select 'decode_errors' as gate, (select count(*) from ms where not decode_ok)::double as value, 'eq' as op, 0::double as lim union all
    select 'share_short_768', {r('(select avg((least(width, height) >= 768)::int) from ms)', 4)}, 'ge', 0.9 union all select 'min_short', (select min(least(width, height)) from ms), 'ge', 512 union all
    select 'validation_rows', (select count(*) from ms where split = 'validation'), 'ge', 100 union all select 'test_rows', (select count(*) from ms where split = 'test'), 'ge', 150 union all
    select 'providers', (select count(distinct provider) from ms), 'ge', 2 union all select 'without_license', (select count(*) from ms where trim(coalesce(license, '')) = ''), 'eq', 0 union all
    select 'unfinished_rows', (select count(*) from ms where pos % 50 = 0), 'eq', 0 union all select 'exact_duplicates', (select sum(n - 1) from k), 'eq', 0 union all select 'cross_split_contents', (select count(*) from k where s > 1), 'eq', 0)
    select gate, value, case op when 'eq' then value = lim else value >= lim end as passed from g"""
)
def release_gate(spark, d):
    return release.release_gate(_split(spark, d).withColumn("status", F.when(F.col("pos") % 50 == 0, "REJECTED").otherwise("QA_PASS")))


_ROWHASH = "sha256(coalesce(id, chr(0)) || chr(31) || coalesce(sha256, chr(0)) || chr(31) || coalesce(width::varchar, chr(0)))"


@query(
    f"with {V('manifest')}, h as (select {_ROWHASH} as h from manifest), s as (select count(*) as \"rows\", "
    + ", ".join(f"(sum(('0x' || substr(h, {8 * i + 1}, 8))::bigint) % 2147483648)::bigint as s{i}" for i in range(8))
    + " from h) select \"rows\", sha256("
    + " || '-' || ".join(['"rows"::varchar', *(f"s{i}::varchar" for i in range(8))])
    + ") as fingerprint from s"
)
def release_fingerprint(spark, d):
    return release.release_fingerprint(_manifest(spark, d), ["id", "sha256", "width"])


@query(
    f"with {V('manifest')}, s as (select *, (license is not null)::int + (content_type <> '')::int as filled, (width * 31) % 97 as sharp from manifest), k as (select *, first_value(pos) over (partition by sha256 order by sharp desc, filled desc, pos) as keeper, count(*) over (partition by sha256) as c from s) select pos, keeper, case when c > 1 and keeper <> pos then 'possible_duplicate' end as proposal from k"
)
def choose_keeper(spark, d):
    rows = _manifest(spark, d).withColumns({"filled": F.col("license").isNotNull().cast("int") + (F.col("content_type") != "").cast("int"), "sharp": (F.col("width") * 31) % 97})
    return release.choose_keeper(rows, "sha256", "pos", "sharp", "filled").select("pos", "keeper", "proposal")


@query(f"with {V('manifest')}, q as (select pos, sha256, case when pos % 2 = 0 then 'extra' end as note from manifest where pos % 5 <> 0) select pos, sha256, note from q where pos in (select min(pos) from q group by sha256)")
def merge_batches(spark, d):
    m = _manifest(spark, d).select("pos", "sha256", F.when(F.col("pos") % 5 == 0, "REJECTED").otherwise("QA_PASS").alias("status"))
    return release.merge_batches([m.where("pos % 2 = 0").withColumn("note", F.lit("extra")), m.where("pos % 2 = 1")]).select("pos", "sha256", "note")


_STATES = ["NEW", "RIGHTS_OK", "CLEANED", "ANNOTATED", "QA_PASS"]


@query(f"with {V('status_log')} select (ts::date)::varchar as day, " + ", ".join(f"count(*) filter (where status = '{s}') as \"{s}\"" for s in _STATES) + " from status_log group by 1")
def daily_report(spark, d):
    return release.daily_report(view(spark, d, "status_log"), _STATES)


# --- tasks and logs ---

_LATEST = "latest as (select * from (select *, row_number() over (partition by task_id order by ts desc, event_id desc) as rn from task_events) where rn = 1)"


def _states(spark: SparkSession, d: str) -> DataFrame:
    return tasks.latest_per_task(view(spark, d, "task_events"), ["status", "mode", "filename", "restored_url", "result_url"])


@query(f"with {V('task_events')}, {_LATEST} select task_id, event_id, status, mode from latest")
def latest_per_task(spark, d):
    return _states(spark, d).select("task_id", "event_id", "status", "mode")


@query(f"with {V('task_events')}, {_LATEST} select count(*) filter (where status in ('detecting', 'processing')) as active from latest")
def active_tasks(spark, d):
    return tasks.active_tasks(_states(spark, d))


@query(f"with {V('task_events')}, {_LATEST} select task_id, status not in ('detecting', 'processing') as can_restart from latest")
def can_restart(spark, d):
    return tasks.can_restart(_states(spark, d))


@query(f"with {V('task_events')}, {_LATEST} select task_id, filename from latest where contains(lower(filename), '1.png')")
def search_history(spark, d):
    return tasks.search_history(_states(spark, d), "1.PNG").select("task_id", "filename")


@query(f"with {V('task_events')}, {_LATEST} select task_id, filename, coalesce(restored_url, result_url) as result, mode, status from latest")
def history_view(spark, d):
    return tasks.history_view(_states(spark, d))


@query(f"with {V('task_events')}, {_LATEST} select task_id, case when status in ('completed', 'error') then status else 'idle' end as recovered, case when status in ('completed', 'error') then 100 else 0 end as progress from latest")
def recover_history(spark, d):
    return tasks.recover_history(_states(spark, d)).select("task_id", "recovered", "progress")


@query(f"with {V('task_events')}, {_LATEST} select task_id, status from latest where task_id <> '7'")
def delete_task(spark, d):
    return tasks.delete_task(_states(spark, d), "7").select("task_id", "status")


@query(f"with {V('task_events')}, {_LATEST} select task_id, event_id from latest order by ts desc, event_id desc limit 50")
def recent_tasks(spark, d):
    return tasks.recent_tasks(_states(spark, d)).select("task_id", "event_id")


@query(
    f"with {V('task_events')}, {_LATEST}, n as (select task_id, status, task_id::bigint % 3 as k from latest) select task_id, case when k = 1 then status else 'stored' end as listed, case when k = 0 then 'stored' else status end as looked_up from n"
)
def merge_history(spark, d):
    s = _states(spark, d).select("task_id", "status", (F.col("task_id").cast("long") % 3).alias("k"))
    live, stored = s.where("k <> 0").select("task_id", "status"), s.where("k <> 1").select("task_id", F.lit("stored").alias("status"))
    listed = tasks.merge_history(live, stored).withColumnRenamed("status", "listed")
    return listed.join(tasks.merge_history(live, stored, prefer_live=True).withColumnRenamed("status", "looked_up"), "task_id")


@query(
    f"""with {V('task_events')}, f as (select task_id, arg_min(mode, (ts, event_id)) as mode, arg_max(status, (ts, event_id)) as status, min(ts) as a, max(ts) as b from task_events group by 1)
    select mode, count(*) as tasks, {r("avg((status = 'error')::int)")} as error_rate, {r("quantile_cont(case when status = 'completed' then epoch_us(b) / 1e6 - epoch_us(a) / 1e6 end, 0.5)")} as median_seconds from f group by 1"""
)
def task_durations(spark, d):
    return tasks.task_durations(view(spark, d, "task_events"))


@query(f"with {V('task_events')} select count(*) as total, count(*) filter (where status = 'completed') as success, count(*) filter (where status = 'error') as errors from task_events")
def run_report(spark, d):
    return audit.run_report(view(spark, d, "task_events"))


@query(
    f"""with {V('status_log')}, p as (select *, list_position(['NEW', 'RIGHTS_OK', 'CLEANED', 'ANNOTATED', 'QA_PASS'], status) as p from status_log), l as (select *, lag(p) over w as b, lag(status) over w as f from p window w as (partition by source_id order by ts, event_id))
    select source_id, event_id, coalesce(f, '') as from_status, status as to_status from l where not (p - coalesce(b, 0) in (0, 1) or (b is not null and p - b = -1))"""
)
def check_transitions(spark, d):
    return tasks.check_transitions(view(spark, d, "status_log"))


def _epochs(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("epoch", F.datediff(F.col("ts"), F.lit("2000-01-01")))
    return e.groupBy("epoch").agg(S.rounded(F.avg("value"), 6).alias("metric"), F.count("*").alias("steps"))


@query(
    f"""with e as (select date_diff('day', date '2000-01-01', ts::date) as epoch, {r('avg(value)', 6)} as metric, count(*) as steps from events group by 1),
    a as (select *, row_number() over (order by epoch) as i, max(metric) over (order by epoch rows between unbounded preceding and 1 preceding) as before from e),
    b as (select *, max(metric) over w as best, max(case when before is null or metric > before then epoch end) over w as best_epoch, i - max(case when before is null or metric > before then i end) over w as since from a window w as (order by epoch rows unbounded preceding))
    select epoch, metric, steps, best, best_epoch, since, coalesce(i >= (select min(i) from b where since >= 4), false) as stopped from b"""
)
def early_stop(spark, d):
    return tasks.early_stop(_epochs(spark, d), 4)


@query(f"select date_diff('day', date '2000-01-01', ts::date) as epoch, {r('avg(case when event_id % 7 <> 0 then value end)', 6)} as loss, count(*) filter (where event_id % 7 <> 0) as steps from events group by 1")
def epoch_loss(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.datediff(F.col("ts"), F.lit("2000-01-01")).alias("epoch"), "value", (F.col("event_id") % 7 != 0).alias("ok"))
    return tasks.epoch_loss(e, "ok")


@query(f"with {V('ratings')} select dim, count(*) as n, {r('avg(score)')} as mean, {r('stddev_samp(score)')} as std from ratings group by 1")
def rater_summary(spark, d):
    return tasks.rater_summary(view(spark, d, "ratings"))


def queries() -> dict[str, Query]:
    from tintype.plans import file_catalog, image_catalog, job_catalog  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
