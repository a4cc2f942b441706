"""Intake and cleaning of batches: verdicts, reports and the rows handed on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.functions.scalars import filled, image_extension, item_identifier, license_ok, rounded, scalar_or_list, select_image_url
from tintype.schemas import DAMAGE_LABELS, MANIFEST_FIELDS


def geometry(df: DataFrame) -> DataFrame:
    """Adds short_side, aspect_ratio (4 digits) and resolution."""
    return df.withColumns({"short_side": F.least("width", "height"), "aspect_ratio": rounded(F.try_divide("width", "height"), 4), "resolution": F.concat_ws("x", "width", "height")})


def screen_resolution(df: DataFrame, min_short: int = 768) -> DataFrame:
    """Adds ``reason``: low_resolution where the short side is under the limit."""
    return df.withColumn("reason", F.when(F.least("width", "height") < min_short, "low_resolution"))


def rights_gate(df: DataFrame, enforce_rights: bool = True) -> DataFrame:
    """Rows whose licence is accepted; without ``enforce_rights`` all rows."""
    return df.where(license_ok(F.col("license"))) if enforce_rights else df


def access_ok() -> Column:
    """Not restricted, not "not unrestricted"; null passes."""
    return ~(F.col("access_restricted").eqNullSafe(True) | F.col("unrestricted").eqNullSafe(False))


def dedupe_first(df: DataFrame, key: str = "sha256", order: str = "pos", name: str = "source_id", eligible: Column | None = None) -> DataFrame:
    """Adds ``keeper``: the name of the first eligible row of the key, null for that row itself, for a null key and for rows that aren't eligible.

    The firsts are an aggregate (summed in part before the shuffle) that the rows are joined with, so
    a key with a third of the rows needn't fit into one task, as it would under a window.
    """
    open = F.lit(True) if eligible is None else eligible
    first = df.where(open & F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("_first"))
    joined = df.join(first, key, "left")
    return joined.withColumn("keeper", F.when(open & (F.col(order) != F.col("_first.o")), F.col("_first.n"))).select(*df.columns, "keeper")


def clean_batch(df: DataFrame, min_short: int = 768, enforce_rights: bool = False) -> DataFrame:
    """Adds status, quality and the work copy's size: decode errors first, then low resolution, then copies of an accepted row.

    Only accepted rows can be the original of a duplicate, so a small first copy rejects nothing.
    """
    rows = rights_gate(df, enforce_rights)
    short = F.least("width", "height") < min_short
    fit = F.coalesce(F.col("decode_ok"), F.lit(False)) & ~F.coalesce(short, F.lit(True))
    rows = dedupe_first(rows, eligible=fit)
    reason = F.when(~F.coalesce("decode_ok", F.lit(False)), "decode_error").when(~fit, "low_resolution").when(F.col("keeper").isNotNull(), F.concat(F.lit("duplicate_of:"), "keeper"))
    rows = rows.withColumn("reason", reason)
    broken = F.col("reason").eqNullSafe("decode_error")
    return rows.drop("keeper").withColumns(
        {
            "status": F.when(F.col("reason").isNull(), "CLEANED").otherwise("REJECTED"),
            "work_width": F.when(broken, 0).otherwise(F.col("width")),
            "work_height": F.when(broken, 0).otherwise(F.col("height")),
            "color_mode": F.when(F.col("reason").isNull(), "RGB"),
        }
    )


def reject_reasons(cleaned: DataFrame) -> DataFrame:
    return cleaned.where("reason is not null").groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


def status_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by, F.coalesce("status", F.lit("")).alias("status")).agg(F.count("*").alias("n"))


def _given(df: DataFrame, name: str, default: str | None = "") -> Column:
    """A column of ``df``, the default where it is null or missing."""
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def intake_project(df: DataFrame, operator: str = "", provider: str = "Library of Congress") -> DataFrame:
    """Manifest rows (all columns of MANIFEST_FIELDS) of raw records.

    Columns that the records lack are empty; contributors (a list) are joined as author; a missing
    content hash is that of the file (file_sha256, if there).
    """
    own = F.concat(F.lit("loc_"), "id")
    people = F.array_join(F.coalesce("contributors", F.array().cast("array<string>")), "; ") if "contributors" in df.columns else F.lit("")
    fields = {
        "id": own,
        "source_id": own,
        "status": F.when(license_ok(F.col("license")), "RIGHTS_OK").otherwise("NEW"),
        "dataset_kind": F.lit("real_damaged"),
        "provider": _given(df, "provider", provider),
        "source_url": _given(df, "item_url"),
        "author": people,
        "sha256": F.coalesce(filled(_given(df, "sha256")), _given(df, "file_sha256", None)),
        "width": F.col("width"),
        "height": F.col("height"),
        "color_mode": _given(df, "mode"),
        "quality_label": F.lit("existing_damage"),
        "split": F.lit(""),
        "annotator": F.lit(operator),
        "reviewer": F.lit(""),
        "notes": _given(df, "title"),
    }
    return df.select(*[fields.get(c, _given(df, c)).alias(c) for c in MANIFEST_FIELDS])


def intake_report(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(check, n): imported rows, rows without file, and rows of each status."""
    found = manifest.join(files.select("filename").distinct(), "filename", "left_semi")
    rows = intake_project(found)
    parts = [
        found.agg(F.lit("imported").alias("check"), F.count("*").alias("n")),
        manifest.join(files, "filename", "left_anti").agg(F.lit("missing").alias("check"), F.count("*").alias("n")),
        rows.groupBy(F.concat(F.lit("status:"), "status").alias("check")).agg(F.count("*").alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def build_records(items: DataFrame, config: dict[str, str] | None = None) -> DataFrame:
    """Raw records of catalogue items (pos, url, image_urls and whatever else is there), with what ``config`` fixes: provider, collection, license, rights_url.

    A field takes the first of its sources that isn't empty; ``item_…`` are those of the nested
    item. Lists may come as JSON lists or scalars.
    """
    config = config or {}

    def first(*names: str) -> Column:
        return F.coalesce(*[filled(F.col(n).cast("string")) for n in names if n in items.columns], F.lit(None).cast("string"))

    def listed(*names: str) -> Column:
        return scalar_or_list(first(*names))

    own, extension = item_identifier(F.col("url"), first("id")), image_extension(first("format"))
    fixed = {k: F.lit(config[k]) if k in config else F.coalesce(first(k), F.lit("")) for k in ("provider", "collection", "license", "rights_url")}
    fields = {
        "id": own,
        "filename": F.concat(own, extension),
        **{k: fixed[k] for k in ("provider", "collection")},
        "title": first("title", "item_title"),
        "date": first("date", "item_date"),
        "contributors": listed("contributor", "item_contributors"),
        "subjects": listed("subject", "item_subjects"),
        "description": listed("description", "item_medium"),
        "item_url": first("url", "id"),
        "image_url": select_image_url(F.col("image_urls")),
        "license": fixed["license"],
        "rights_statement": first("item_rights_information", "item_rights_advisory"),
        "rights_url": fixed["rights_url"],
        **{k: F.col(k) if k in items.columns else F.lit(None).cast("int") for k in ("width", "height")},
        **{k: first(k) for k in ("mode", "sha256", "dhash", "downloaded_at")},
        "extension": extension,
    }
    return items.select("pos", *[v.alias(k) for k, v in fields.items()])


def classify_intake(items: DataFrame, min_short: int = 768) -> DataFrame:
    """Adds ``verdict``: the first rule that fails (license, access, url, decode, size, duplicate), or accepted."""
    small = F.col("short_side") < min_short
    fit = license_ok(F.col("license")) & access_ok() & F.col("image_url").isNotNull() & F.col("decode_ok") & ~small
    rows = dedupe_first(items, "sha256", "pos", "id", eligible=fit)
    verdict = (
        F.when(~license_ok(F.col("license")), "license")
        .when(~access_ok(), "access")
        .when(F.col("image_url").isNull(), "no_image_url")
        .when(~F.col("decode_ok"), "decode_error")
        .when(small, F.concat(F.lit("short_side_"), "short_side"))
        .when(F.col("keeper").isNotNull(), "duplicate_content")
        .otherwise("accepted")
    )
    return rows.withColumn("verdict", verdict).drop("keeper")


def take_accepted(df: DataFrame, limit: int, accepted: Column, order: str = "pos") -> DataFrame:
    """The first ``limit`` accepted rows beyond those already taken."""
    return df.where(accepted).orderBy(order).limit(limit)


def collection_summary(df: DataFrame) -> DataFrame:
    """One row: number, provider and licence of the first row, short sides, surplus copies, shared hashes."""
    short = F.least("width", "height")
    per_key = df.groupBy("sha256").agg(
        F.count("*").alias("n"), F.min(F.struct("pos", "provider", "license")).alias("first"), F.min(short).alias("lo"), F.max(short).alias("hi"), F.sum(short).alias("sum")
    )
    first = F.min("first")
    return per_key.agg(
        F.sum("n").alias("items"), first["provider"].alias("provider"), first["license"].alias("license"), F.min("lo").alias("min_short"), F.max("hi").alias("max_short"), F.sum(F.col("n") - 1).alias("surplus"), F.count_if(F.col("n") > 1).alias("shared_hashes")
    )


def annotation_task(cleaned: DataFrame, annotator: str) -> DataFrame:
    """Blank annotation rows for the accepted images; labels are left for people to fill."""
    blank = [F.lit("").alias(c) for c in DAMAGE_LABELS]
    return cleaned.where("status = 'CLEANED'").select(
        "pos", "source_id", *blank, F.lit("").alias("mask_path"), F.lit("0").alias("uncertain"), F.lit(annotator).alias("annotator"), F.lit("").alias("reviewer"), F.lit("PENDING_MANUAL").alias("status"), F.lit("").alias("notes")
    )


def batch_status(counts: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, ord, rows, blocked, state) of every stage in order: NOT_STARTED without rows, BLOCKED with rejected ones, else PASS."""
    spark = counts.sparkSession
    order = spark.createDataFrame(list(enumerate(stages)), "ord int, stage string")
    by = counts.groupBy("stage").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("status") == "REJECTED", F.col("n")).otherwise(0)).alias("blocked"))
    return order.join(by, "stage", "left").select(
        "stage", "ord", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("blocked", F.lit(0)).alias("blocked"), F.when(F.col("rows").isNull(), "NOT_STARTED").when(F.col("blocked") > 0, "BLOCKED").otherwise("PASS").alias("state")
    )


def ranked(df: DataFrame, order: str) -> DataFrame:
    """Adds ``row``: the 0-based place of each row in the order of a unique column, without one task that sees all rows.

    Rows are dealt by range and numbered within it; the ranges' sizes give the offsets.
    """
    from tintype.plans.worktables import write_table

    parts = write_table(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return parts.withColumn("_in", inner).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_in") + F.col("_off")).alias("row"))


def previous(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """Adds ``name``: ``column`` of the row before within the key, in order; null for a key's first row.

    Rows are dealt by range of key and order, so a key with a third of all rows is spread over many
    tasks; the last row of each range is handed to the next one.
    """
    from tintype.plans.worktables import write_table

    parts = write_table(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    last = parts.groupBy("_part").agg(F.max(F.struct(F.col(key).alias("k"), *order, F.col(column).alias("v"))).alias("_e"))
    before = last.select("_part", F.lag("_e").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("_e"))
    over = W.partitionBy("_part", key).orderBy(*order)
    inside = parts.withColumns({name: F.lag(column).over(over), "_i": F.row_number().over(over)})
    handed = F.when((F.col("_i") == 1) & F.col("_e.k").eqNullSafe(F.col(key)), F.col("_e.v"))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.when(F.col("_i") == 1, handed).otherwise(F.col(name))).select(*df.columns, name)
