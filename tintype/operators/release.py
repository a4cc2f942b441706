"""Annotation checks, label rules, release gates, cards and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintype.functions.scalars import rounded, stem
from tintype.schemas import CONTENT_LABELS, DAMAGE_LABELS, QUALITY_LABELS


def validate_annotations(df: DataFrame) -> DataFrame:
    """(pos, source_id, error): a row for every broken rule; a row not annotated has that one error only."""
    done = F.col("status").isin("ANNOTATED", "REVIEWED")
    values = [F.coalesce(c, F.lit("")) for c in DAMAGE_LABELS]
    bad = [F.when(~v.isin("0", "1", "2", "3"), F.lit(f"invalid_{c}")) for c, v in zip(DAMAGE_LABELS, values, strict=True)]
    none = F.when(~F.exists(F.array(*values), lambda v: v.isin("1", "2", "3")), F.lit("no_damage"))
    who = F.when(F.coalesce("annotator", F.lit("")) == "", F.lit("no_annotator"))
    errors = F.when(done, F.array(*bad, none, who)).otherwise(F.array(F.lit("wrong_status")))
    return df.select("pos", "source_id", F.explode(F.filter(errors, lambda e: e.isNotNull())).alias("error"))


def annotation_report(df: DataFrame) -> DataFrame:
    """One row: rows, completed, errors, valid (no rows are valid)."""
    done = F.count_if(F.col("status").isin("ANNOTATED", "REVIEWED"))
    errors = validate_annotations(df).agg(F.count("*").alias("errors"))
    return df.agg(F.count("*").alias("rows"), done.alias("completed")).crossJoin(errors).withColumn("valid", F.col("errors") == 0)


def long_labels(df: DataFrame) -> DataFrame:
    """(source_id, label, severity), a row a label."""
    return df.unpivot(["source_id"], DAMAGE_LABELS, "label", "severity")


def severity_distribution(df: DataFrame) -> DataFrame:
    return long_labels(df).groupBy("label", "severity").agg(F.count("*").alias("n"))


def annotator_conflicts(a: DataFrame, b: DataFrame, min_gap: int = 2) -> DataFrame:
    """(source_id, label, a, b, gap) where two annotators differ by ``min_gap`` or more; blanks differ from nothing."""
    value = F.expr("try_cast(severity as int)")
    left, right = (long_labels(x).select("source_id", "label", value.alias(n)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, ["source_id", "label"]).withColumn("gap", F.abs(F.col("a") - F.col("b"))).where(F.col("gap") >= min_gap)


def check_labels(df: DataFrame) -> DataFrame:
    """(pos, violation): content or quality label outside its list; where df has status and reason, accepted rows without label and rejected ones without reason too."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rules = []
    if {"status", "reason"} <= set(df.columns):
        rejected = F.col("status").eqNullSafe("REJECTED")
        rules = [
            F.when(~rejected & (empty("content_type") | empty("quality_label")), F.lit("accepted_unlabelled")),
            F.when(rejected & empty("reason"), F.lit("rejected_without_reason")),
        ]
    bad = F.array(
        *rules,
        F.when(~F.coalesce("content_type", F.lit("")).isin(CONTENT_LABELS), F.lit("content_type")),
        F.when(~F.coalesce("quality_label", F.lit("")).isin(QUALITY_LABELS), F.lit("quality_label")),
    )
    return df.select("pos", F.explode(F.filter(bad, lambda x: x.isNotNull())).alias("violation"))


def clean_targets(df: DataFrame) -> DataFrame:
    return df.where("quality_label = 'clean_target_ok'")


def handoff_checks(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(check, value, ok): file count, unique source ids, licence, provider and content hash present."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    m = manifest.agg(
        F.count("*").alias("rows"), F.count_distinct("source_id").alias("ids"), F.count_if(empty("license")).alias("no_license"), F.count_if(empty("provider")).alias("no_provider"), F.count_if(empty("sha256")).alias("no_sha256")
    )
    both = m.crossJoin(files.agg(F.count("*").alias("files")))
    checks = [
        F.struct(F.lit("rows_equal_files").alias("check"), (F.col("rows") - F.col("files")).alias("value")),
        F.struct(F.lit("duplicate_source_id").alias("check"), (F.col("rows") - F.col("ids")).alias("value")),
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in ("no_license", "no_provider", "no_sha256")],
    ]
    return both.select(F.explode(F.array(*checks)).alias("x")).select("x.check", "x.value", (F.col("x.value") == 0).alias("ok"))


def mask_checks(masks: DataFrame, annotations: DataFrame) -> DataFrame:
    """(source_id, failure): masks of another size, all 0, all 255, with other values, without annotation, uncertain without notes, or (where masks has mask_name) named unlike their source."""
    named = [F.when(stem(F.col("mask_name")) != F.col("source_id"), F.lit("name_mismatch"))] if "mask_name" in masks.columns else []
    rows = masks.join(annotations.select("source_id", "uncertain", "notes", F.lit(True).alias("annotated")), "source_id", "left")
    fails = F.array(
        F.when((F.col("width") != F.col("mask_width")) | (F.col("height") != F.col("mask_height")), F.lit("size_mismatch")),
        F.when(F.col("max_value") == 0, F.lit("all_0")),
        F.when(F.col("min_value") == 255, F.lit("all_255")),
        F.when(F.col("other_values") > 0, F.lit("not_binary")),
        F.when(F.col("annotated").isNull(), F.lit("no_annotation")),
        *named,
        F.when((F.col("uncertain") == "1") & (F.coalesce("notes", F.lit("")) == ""), F.lit("uncertain_without_notes")),
    )
    return rows.select("source_id", F.explode(F.filter(fails, lambda x: x.isNotNull())).alias("failure"))


def dataset_card(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, value, n): counts by each column, and of all rows, in one pass over grouping sets."""
    frame = df.select(*columns)
    spark = df.sparkSession
    names = ", ".join(f"`{c}`" for c in columns)
    sets = ", ".join(["()", *(f"(`{c}`)" for c in columns)])
    flags = " ".join(f"when grouping(`{c}`) = 0 then '{c}'" for c in columns)
    value = " ".join(f"when grouping(`{c}`) = 0 then cast(`{c}` as string)" for c in columns)
    return spark.sql(f"select case {flags} else 'all' end as dimension, case {value} end as value, count(*) as n from {{t}} group by grouping sets ({sets})", t=frame.select(*columns)) if names else frame


def mix_check(df: DataFrame, column: str, targets: dict[str, float]) -> DataFrame:
    """(value, share, target, gap) of the named values, four digits."""
    spark = df.sparkSession
    goal = spark.createDataFrame(list(targets.items()), "value string, target double")
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    share = rounded(F.try_divide(F.coalesce("n", F.lit(0)), F.col("total")), 4)
    return goal.join(counts, "value", "left").crossJoin(F.broadcast(total)).select("value", share.alias("share"), "target", rounded(share - F.col("target"), 4).alias("gap"))


def release_gate(manifest: DataFrame, min_validation: int = 100, min_test: int = 150) -> DataFrame:
    """(gate, value, passed) of every acceptance threshold of a release; ``manifest`` has split, status, decode_ok and sha256."""
    short = F.least("width", "height")
    kept = manifest.groupBy("sha256").agg(F.count("*").alias("copies"), F.count_distinct("split").alias("splits"))
    leaks = kept.agg(F.sum(F.col("copies") - 1).alias("exact_duplicates"), F.count_if(F.col("splits") > 1).alias("cross_split_contents"))
    m = manifest.agg(
        F.count_if(~F.col("decode_ok")).alias("decode_errors"),
        rounded(F.avg((short >= 768).cast("double")), 4).alias("share_short_768"),
        F.min(short).alias("min_short"),
        F.count_if(F.col("split") == "validation").alias("validation_rows"),
        F.count_if(F.col("split") == "test").alias("test_rows"),
        F.count_distinct("provider").alias("providers"),
        F.count_if(F.coalesce(F.trim("license"), F.lit("")) == "").alias("without_license"),
        F.count_if(F.col("status").isin("NEW", "RIGHTS_OK", "REJECTED")).alias("unfinished_rows"),
    ).crossJoin(leaks)
    limits = [
        ("decode_errors", "eq", 0), ("share_short_768", "ge", 0.9), ("min_short", "ge", 512), ("validation_rows", "ge", min_validation), ("test_rows", "ge", min_test), ("providers", "ge", 2),
        ("without_license", "eq", 0), ("unfinished_rows", "eq", 0), ("exact_duplicates", "eq", 0), ("cross_split_contents", "eq", 0),
    ]
    rows = [F.struct(F.lit(g).alias("gate"), F.col(g).cast("double").alias("value"), F.coalesce(F.col(g) == t if op == "eq" else F.col(g) >= t, F.lit(False)).alias("passed")) for g, op, t in limits]
    return m.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def release_fingerprint(df: DataFrame, columns: list[str], buckets: int = 4096) -> DataFrame:
    """(rows, fingerprint): a hash of all rows that depends on neither their order nor the files they are in.

    Row hashes are cut into eight numbers that are summed modulo 2**31 by bucket and then over all,
    so no list of rows is gathered; the last hash is of the sums.
    """
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    parts = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    bucket = F.pmod(F.conv(F.substring(h, 1, 4), 16, 10).cast("int"), F.lit(buckets))
    by = df.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), *[(F.sum(p) % (1 << 31)).alias(f"s{i}") for i, p in enumerate(parts)])
    whole = by.agg(F.sum("n").alias("rows"), *[(F.sum(f"s{i}") % (1 << 31)).alias(f"s{i}") for i in range(8)])
    return whole.select("rows", F.sha2(F.concat_ws("-", "rows", *[f"s{i}" for i in range(8)]), 256).alias("fingerprint"))


def choose_keeper(df: DataFrame, group: str, name: str, sharpness: str, filled_fields: str) -> DataFrame:
    """Adds keeper and proposal: the sharpest of a group, then the one with most fields; the others are possible_duplicate."""
    best = df.groupBy(group).agg(F.max(F.struct(F.col(sharpness), F.col(filled_fields), (-F.col(name)).alias("neg"))).alias("_b"), F.count("*").alias("_n"))
    rows = df.join(best, group).withColumn("keeper", -F.col("_b.neg"))
    return rows.withColumn("proposal", F.when((F.col("_n") > 1) & (F.col("keeper") != F.col(name)), "possible_duplicate")).select(*df.columns, "keeper", "proposal")


def merge_batches(batches: list[DataFrame], key: str = "sha256", order: str = "pos") -> DataFrame:
    """The QA-passed rows of all batches, the first of each content; columns that a batch lacks are null."""
    every = batches[0].where("status = 'QA_PASS'")
    for b in batches[1:]:
        every = every.unionByName(b.where("status = 'QA_PASS'"), allowMissingColumns=True)
    first = every.groupBy(key).agg(F.min(order).alias(order))
    return every.join(first, [key, order], "left_semi")


def daily_report(log: DataFrame, outcomes: list[str]) -> DataFrame:
    """(day, one column an outcome): events of each day by outcome."""
    return log.groupBy(F.to_date("ts").cast("string").alias("day")).pivot("status", outcomes).count().na.fill(0)
