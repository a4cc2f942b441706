"""Registered queries of the readers and writers: each writes files made of the given tables to the work folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintype.functions import scalars as S
from tintype.plans.catalog import _LATEST, _MSPLIT, ORACLES, QUERIES, query
from tintype.plans.image_catalog import _GRAY
from tintype.plans.views import sql as V
from tintype.plans.views import view
from tintype.plans.worktables import work_folder
from tintype.operators import gray, pairing, tasks
from tintype.schemas import MANIFEST_FIELDS
from tintype.sources import files


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# sheets of 64 images below each other; the names' endings are of every kind that a listing meets
_NAMES = "case sheet % 7 when 0 then '.dat' when 1 then '.PNG' when 2 then '.png.part' else '.png' end"
_SHEETS = f"""{_GRAY}, whole as (select *, img_id // 64 as sheet from gray8 where len(px) = 64 and len(list_filter(px, lambda v: v is null)) = 0),
 sheets as (select sheet, 'sheet_' || sheet || {_NAMES} as filename, count(*)::int as height, 64 as width, sha256(unhex(string_agg(array_to_string(list_transform(px, lambda v: printf('%02x', v)), ''), '' order by img_id, px))) as pixels from whole group by 1)"""


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as gray images of 64 columns, one row a vector and 64 vectors a sheet."""
    rows = gray.gray8(spark.read.parquet(f"{d}/embeddings.parquet")).where((F.size("px") == 64) & F.forall("px", lambda v: v.isNotNull()))
    sheets = rows.groupBy(F.floor(F.col("img_id") / 64).alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("img_id", "px"))).alias("rows"))
    pixels = F.flatten(F.col("rows.px"))
    data = F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))
    name = F.concat(F.lit("sheet_"), F.col("sheet").cast("string"), F.expr(_NAMES))
    return sheets.select("sheet", name.alias("filename"), F.size("rows").alias("height"), F.lit(64).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))


@query(f"with {_SHEETS} select filename from sheets where sheet % 7 not in (0, 2)")
def list_images(spark, d):
    at = _new_folder(spark, "images")
    files.write_images(_sheets(spark, d), at)
    return files.list_images(spark, at).select("filename")


@query(f"with {_SHEETS} select filename, height, width, pixels, true as decode_ok from sheets where sheet % 7 not in (0, 2)")
def decode_images(spark, d):
    at = _new_folder(spark, "images")
    files.write_images(_sheets(spark, d), at)
    return files.decode_images(spark, at).select("filename", "height", "width", F.sha2("data", 256).alias("pixels"), "decode_ok")


@query(f"with {V('manifest')} select id, source_id, filename, null::varchar as status, provider, nullif(license, '') as license, sha256, width::int as width, height::int as height, nullif(content_type, '') as content_type, quality_label, 'a \"' || id || '\",' || chr(10) || '  b ' as notes from manifest")
def manifest_csv(spark, d):
    """The manifest with notes that hold quotes, commas, line breaks and outer spaces, as CSV and back."""
    at = _new_folder(spark, "manifest")
    notes = F.concat(F.lit('a "'), F.col("id"), F.lit('",\n  b '))
    files.write_manifest(view(spark, d, "manifest").withColumn("notes", notes), at, MANIFEST_FIELDS)
    return files.read_manifest(spark, at).select("id", "source_id", "filename", "status", "provider", "license", "sha256", "width", "height", "content_type", "quality_label", "notes")


@query(
    f"""with {V('manifest')} select 'record' as found, id, license, width::int as width, provider || '|' || quality_label as subjects from manifest
    union all select 'torn', '{{"id": "' || id || '", "licen', null, null, null from manifest where pos % 50 = 7"""
)
def record_lines(spark, d):
    """Accepted and rejected records appended to one file of JSON lines, some of them once more as lines that were torn, and read back."""
    at = _new_folder(spark, "records")
    rows = view(spark, d, "manifest")
    records = rows.select("id", "license", "width", F.array("provider", "quality_label").alias("subjects"))
    ok = S.license_ok(F.col("license"))
    files.append_records(records.where(ok), at)
    files.append_records(records.where(~ok), at)
    files.append_records(rows.where("pos % 50 = 7").select(F.concat(F.lit('{"id": "'), F.col("id"), F.lit('", "licen')).alias("value")), at, "text")
    good, torn = files.read_jsonl(spark, at)
    whole = good.select(F.lit("record").alias("found"), "id", "license", "width", F.array_join("subjects", "|").alias("subjects"))
    return whole.unionByName(torn.select(F.lit("torn").alias("found"), F.col("_corrupt_record").alias("id")), allowMissingColumns=True)


@query(ORACLES["reject_reasons"])
def json_report(spark, d):
    at = _new_folder(spark, "report")
    files.write_report(QUERIES["reject_reasons"](spark, d), at)
    return spark.read.schema("reason string, n bigint").json(at)


@query(f"with {V('manifest')}, {_MSPLIT} select pos, source_id, split, count(*) over (partition by split) as listed from ms")
def frozen_release(spark, d):
    """A release by split, and for each row how many its split's manifest entry names."""
    at = _new_folder(spark, "release")
    files.freeze_release(pairing.split_by_group(view(spark, d, "manifest")).select("pos", "source_id", "split"), at, "v1")
    splits = files.release_manifest(spark, at, "v1")["splits"]
    listed = spark.createDataFrame([(s["split"], s["rows"]) for s in splits], "split string, listed bigint")
    return spark.read.parquet(f"{at}/v1").join(F.broadcast(listed), "split").select("pos", "source_id", "split", "listed")


@query(f"with {V('task_events')}, {_LATEST} select task_id as id, status, mode from latest order by ts desc, event_id desc limit 100")
def read_history(spark, d):
    """The newest 100 tasks, which is what a history keeps, as one JSON array and back."""
    at = _new_folder(spark, "history")
    states = tasks.latest_per_task(view(spark, d, "task_events"), ["status", "mode"])
    kept = tasks.recent_tasks(states, 100).select(F.col("task_id").alias("id"), "status", "mode")
    kept.agg(F.to_json(F.collect_list(F.struct("id", "status", "mode"))).alias("value")).write.text(at)
    return files.read_history(spark, at).select("id", "status", "mode")


@query(
    f"""with {_SHEETS}, c as (select count(*) filter (where sheet % 7 = 2) as parts, count(*) filter (where sheet % 7 not in (0, 2)) as images, count(*) as lines, count(*) filter (where sheet % 3 = 1) as torn from sheets)
    select 'part_files' as "check", parts as value, parts = 0 as ok from c union all select 'torn_lines', torn, torn = 0 from c union all select 'images_less_rows', images - (lines - torn), images = lines - torn from c"""
)
def resume_preflight(spark, d):
    """A folder with leftovers of broken downloads, beside a manifest with torn lines."""
    images, manifest = _new_folder(spark, "images"), _new_folder(spark, "lines")
    sheets = _sheets(spark, d)
    files.write_images(sheets, images)
    line = F.to_json(F.struct(F.col("filename").alias("id"), "filename"))
    files.append_records(sheets.select(F.when(F.col("sheet") % 3 == 1, F.left(line, F.lit(9))).otherwise(line).alias("value")), manifest, "text")
    return files.resume_preflight(spark, images, manifest)
