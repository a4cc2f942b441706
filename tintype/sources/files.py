"""Readers and writers of images, manifests, reports, releases and task histories."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tintype.functions.scalars import filled
from tintype.schemas import IMAGE_SUFFIXES, MANIFEST, RAW_RECORD, TASK


#: Most rows of a report, which is written by one task.
REPORT_ROWS = 10_000


def _suffix_pattern(suffixes: list[str]) -> str:
    return "(?i)(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"


def list_images(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, filename, length, modificationTime) of the image files in a folder; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "modificationTime")
    return files.where(F.col("filename").rlike(_suffix_pattern(suffixes)))


def decode_images(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(origin, filename, height, width, nChannels, data, sha256, decode_ok) of every image file; one that can't be read has decode_ok false."""
    images = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    images = images.withColumn("key", F.regexp_replace("origin", "^file:/+", "/"))
    hashes = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("key"), F.sha2("content", 256).alias("sha256"))
    rows = images.join(hashes, "key").withColumn("filename", F.element_at(F.split("key", "/"), -1)).where(F.col("filename").rlike(_suffix_pattern(suffixes)))
    return rows.select("origin", "filename", "height", "width", "nChannels", "data", "sha256", (F.col("height") > 0).alias("decode_ok"))


def _png(height: int, width: int, channels: int, data: bytes) -> bytes:
    """A PNG of gray or of blue, green and red pixels, as the image source has them."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)[..., ::-1]
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * channels)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_images(df: DataFrame, path: str) -> None:
    """Writes rows (filename, height, width, nChannels, data) of the image source as PNG files of their names to a folder.

    Tasks write their own files, each aside and moved to its name at the end, so that a task that
    runs again leaves whole files. Rows without a name or pixels write nothing; of rows that share a
    name one stays. Pixels that don't fill the height, width and one or three channels are an error.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder)
        for batch in batches:
            for r in batch.to_pylist():
                aside = f"{folder}/_{uuid.uuid4().hex}"
                with fs.open_output_stream(aside) as out:
                    out.write(_png(r["height"], r["width"], r["nChannels"], r["data"]))
                fs.move(aside, f"{folder}/{r['filename']}")
            yield pa.RecordBatch.from_arrays([batch.column("filename")], ["filename"])

    rows = df.select("filename", "height", "width", "nChannels", "data").where("filename is not null and data is not null and height * width > 0")
    rows.mapInArrow(put, "filename string").write.format("noop").mode("overwrite").save()


def read_manifest(spark: SparkSession, path: str, schema: T.StructType = MANIFEST) -> DataFrame:
    """A CSV manifest (UTF-8, with or without mark): columns by name, values cast to the schema's types, null where they are empty or don't fit; missing columns are null."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return raw.select(*[(F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def write_manifest(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists") -> None:
    """CSV with the given columns in order; others are dropped, missing ones are empty."""
    df.select(*[F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in fields]).write.mode(mode).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW_RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, broken): JSON lines by the schema, and lines that can't be read (a torn last line, say)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select(parsed.alias("r")).select("r.*")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def append_records(df: DataFrame, path: str, format: str = "json") -> None:
    """Appends under the commit protocol, so that readers see whole batches and two writers don't mix lines."""
    df.write.mode("append").format(format).save(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report, which has few rows, as one JSON file; more than REPORT_ROWS are an error."""
    if df.limit(REPORT_ROWS + 1).count() > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    df.coalesce(1).write.mode(mode).json(path)


def freeze_release(df: DataFrame, path: str, version: str, force: bool = False) -> None:
    """Writes a release by split under its version; an existing version is an error unless ``force``.

    The files are written aside and published by one rename, together with a manifest of them and
    their rows, so a release is there whole or not at all, and a rewrite that fails leaves the one
    before. Of two writers of a version one succeeds: whose manifest stands there afterwards.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    target, aside, old = at(version), at(f"_new-{version}-{token}"), at(f"_old-{version}-{token}")
    fs = target.getFileSystem(conf)
    if fs.exists(target) and not force:
        raise AnalysisException(f"{path}/{version} exists already")
    try:
        df.write.partitionBy("split").parquet(aside.toString())
        _write_manifest_of(spark, aside, token)
        if force and fs.exists(target):
            fs.rename(target, old)
        if not fs.exists(target):
            fs.rename(aside, target)
        if (release_manifest(spark, path, version) or {}).get("token") != token:
            raise AnalysisException(f"{path}/{version} exists already")
        fs.delete(old, True)
    finally:
        if fs.exists(old):  # the new one isn't in its place
            fs.rename(old, target)
        for left in (aside, at(f"{version}/{aside.getName()}")):  # a folder that is renamed to one that exists lands in it
            fs.delete(left, True)


def _write_manifest_of(spark: SparkSession, folder, token: str) -> None:
    """A file ``_manifest`` in a release: its token, and the files and rows of each split."""
    rows = spark.read.parquet(folder.toString()).groupBy("split", F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"))
    splits = rows.groupBy("split").agg(F.count("*").alias("files"), F.sum("rows").alias("rows")).orderBy("split").collect()
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, "_manifest"))
    out.write(bytearray(json.dumps({"token": token, "splits": [r.asDict() for r in splits]}).encode()))
    out.close()


def release_manifest(spark: SparkSession, path: str, version: str) -> dict | None:
    """The manifest of a release: its token, and files and rows of each split; None where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{version}/_manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The task history (one JSON array); a missing or damaged file has no rows."""
    fields = [f.name for f in TASK.fields if f.name != "_corrupt_record"]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], TASK).select(*fields)
    rows = spark.read.schema(TASK).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where(F.col("_corrupt_record").isNull() & filled(F.col("id")).isNotNull()).select(*fields)


def resume_preflight(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """(check, value, ok): leftover .part files, torn manifest lines, files less manifest rows."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    counts = files.agg(F.count_if(F.col("filename").endswith(".part")).alias("part_files"), F.count_if(F.col("filename").rlike(_suffix_pattern(IMAGE_SUFFIXES))).alias("images"))
    records, broken = read_jsonl(spark, manifest)
    both = counts.crossJoin(records.agg(F.count("*").alias("rows"))).crossJoin(broken.agg(F.count("*").alias("torn_lines")))
    checks = [("part_files", F.col("part_files")), ("torn_lines", F.col("torn_lines")), ("images_less_rows", F.col("images") - F.col("rows"))]
    return both.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value"), (v == 0).alias("ok")) for k, v in checks])).alias("x")).select("x.*")


def orientation(content: bytes) -> int:
    """The EXIF orientation (1 to 8) of a JPEG's bytes; 1 where there is none."""
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 < len(content) and content[at] == 0xFF:
        size = int.from_bytes(content[at + 2 : at + 4], "big")
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            tiff = content[at + 10 : at + 2 + size]
            order = "little" if tiff[:2] == b"II" else "big"
            start = int.from_bytes(tiff[4:8], order)
            for k in range(int.from_bytes(tiff[start : start + 2], order)):
                entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
                if int.from_bytes(entry[:2], order) == 0x0112:
                    value = int.from_bytes(entry[8:10], order)
                    return value if 1 <= value <= 8 else 1
        if content[at + 1] == 0xDA:
            break
        at += 2 + size
    return 1


def read_orientation(spark: SparkSession, path: str) -> DataFrame:
    """(path, orientation) of the files in a folder."""

    @F.pandas_udf("int")
    def of(content):
        return content.map(orientation).astype("int32")

    return spark.read.format("binaryFile").load(path).select("path", of("content").alias("orientation"))
