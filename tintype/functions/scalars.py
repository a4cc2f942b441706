"""Column functions of intake, cleaning and the task service; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintype.schemas import LICENSES


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once per row however often ``body`` names it, inside functions of arrays too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(x: Column, digits: int = 3) -> Column:
    """Rounded half to even at ``digits``, by scaling, as the oracles do."""
    return F.rint(x * 10**digits) / 10**digits


def filled(x: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(x, F.lit(""))


def license_norm(license: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.replace(license, F.lit("-"), F.lit(" "))), r"\s+", " "))


def license_ok(license: Column, allowed: list[str] = LICENSES) -> Column:
    """Whether the normal form is on the list; null and empty aren't."""
    return F.coalesce(license_norm(license).isin(allowed), F.lit(False))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def image_area(url: Column) -> Column:
    """Width times height of the fragment's ``w`` and ``h``; 0 unless both are there."""
    fragment = F.regexp_extract(url, "#(.*)$", 1)

    def side(name: str) -> Column:
        return F.try_to_number(F.concat(F.lit("0"), F.regexp_extract(fragment, rf"(?:^|&){name}=([0-9]+)", 1)), F.lit("9999999999")).cast("long")

    return side("w") * side("h")


def select_image_url(urls: Column) -> Column:
    """The URL of largest area, the first of equals, without its fragment; null for none."""
    start = F.struct(F.lit(-1).cast("long").alias("area"), F.lit(None).cast("string").alias("url"))
    best = F.aggregate(urls, start, lambda a, u: F.when(image_area(u) > a["area"], F.struct(image_area(u).alias("area"), u.alias("url"))).otherwise(a))
    return clean_url(best["url"])


def scalar_or_list(json: Column) -> Column:
    """A JSON value that is a list or a scalar, as an array of strings; null gives an empty one."""
    return F.when(json.isNull(), F.array().cast("array<string>")).when(F.startswith(json, F.lit("[")), F.from_json(json, "array<string>")).otherwise(F.array(json))


def item_identifier(*candidates: Column) -> Column:
    """The last path part of the first candidate that isn't empty, with odd characters as ``_``; ``unknown`` for none."""
    raw = F.coalesce(*[filled(c) for c in candidates], F.lit("unknown"))
    last = F.element_at(F.split(F.rtrim(raw, F.lit("/")), "/"), -1)
    return F.coalesce(filled(F.trim(F.regexp_replace(last, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))), F.lit("unknown"))


def image_extension(format: Column) -> Column:
    known = {"JPEG": ".jpg", "PNG": ".png", "TIFF": ".tif", "WEBP": ".webp"}
    return F.coalesce(reduce(lambda c, kv: c.when(F.upper(format) == kv[0], kv[1]), list(known.items())[1:], F.when(F.upper(format) == "JPEG", ".jpg")), F.lit(".img"))


def valid_batch_id(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z0-9_-]+$"), F.lit(False))


def valid_filename(name: Column) -> Column:
    """Letters, digits, dot, hyphen and underscore only, with a suffix."""
    return F.coalesce(name.rlike("^[A-Za-z0-9_.-]+[.][A-Za-z0-9]+$"), F.lit(False))


def stem(filename: Column) -> Column:
    return F.regexp_replace(filename, "[.][^.]*$", "")


def variant_base(filename: Column) -> Column:
    """The stem without a trailing ``_(...)``."""
    return F.regexp_replace(stem(filename), r"_\([^)]*\)$", "")


def mode_strengths(mode: Column, strength: Column) -> Column:
    """Detection and restoration strength of a task's mode."""
    s = F.coalesce(strength, F.lit(0.35))
    fine = F.greatest(F.lit(0.3), F.least(F.lit(1.0), s + 0.2))
    return F.struct(
        F.when(mode == "quick", 0.6).when(mode == "fine", fine).otherwise(0.5).alias("detect"),
        F.when(mode == "quick", 0.1).when(mode == "fine", s).otherwise(0.05).alias("restore"),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def group_bucket(group: Column, seed: int, buckets: int = 100) -> Column:
    """A bucket that depends on the group and the seed only."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", group, F.lit(str(seed))), 256), 1, 8), 16, 10).cast("long") % buckets


def seeded_order(*parts: Column | str) -> Column:
    """A reproducible random order: the hash of the parts."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def register(spark) -> None:
    """The functions that SQL users call, as session functions."""
    spark.sql(r"create or replace temporary function license_norm(x string) returns string return trim(regexp_replace(lower(replace(x, '-', ' ')), '\\s+', ' '))")
    spark.sql("create or replace temporary function clean_url(x string) returns string return regexp_replace(x, '#.*$', '')")
    spark.sql("create or replace temporary function hamming(a bigint, b bigint) returns int return bit_count(a ^ b)")
