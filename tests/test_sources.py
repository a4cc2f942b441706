import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintype.operators import images
from tintype.schemas import MANIFEST_FIELDS
from tintype.sources import files
from tintype.streaming import jobs


def png(path, pixels):
    """A PNG of a gray (h, w) or RGB (h, w, 3) array."""
    h, w = pixels.shape[:2]
    raw = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_are_listed_decoded_and_described(spark, tmp_path):
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    png(tmp_path / "a.png", rgb)
    png(tmp_path / "b.PNG", rgb[..., 0])
    (tmp_path / "c.jpg").write_bytes(b"not an image")
    (tmp_path / "d.txt").write_bytes(b"x")
    assert {r.filename for r in files.list_images(spark, str(tmp_path)).collect()} == {"a.png", "b.PNG", "c.jpg"}
    decoded = files.decode_images(spark, str(tmp_path))
    got = {r.filename: r for r in decoded.collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].decode_ok) == (30, 20, True) and not got["c.jpg"].decode_ok and got["c.jpg"].sha256
    stats = {r.origin.rsplit("/", 1)[1]: r for r in images.full_image_stats(decoded).collect()}
    assert stats["c.jpg"].error == "decode_error"
    gray = np.rint(rgb @ np.array([0.299, 0.587, 0.114]))
    assert abs(stats["a.png"].brightness - gray.mean()) < 1e-3
    assert {len(r.dhash) for r in images.full_dhash(decoded, "lanczos").where("status = 'ok'").collect()} == {36}


def test_written_images_are_read_alike(spark, tmp_path):
    rng = np.random.default_rng(3)
    shapes = {"a.png": (7, 5, 1), "b.png": (3, 9, 3), "c.PNG": (1, 1, 3)}
    rows = [(n, h, w, c, bytearray(rng.integers(0, 256, h * w * c).astype(np.uint8))) for n, (h, w, c) in shapes.items()]
    schema = "filename string, height int, width int, nChannels int, data binary, extra int"
    empty = [(None, 1, 1, 1, bytearray(b"x"), 0), ("d.png", 1, 1, 1, None, 0), ("e.png", 0, 1, 1, bytearray(), 0)]
    at = f"file://{tmp_path}/new/images"
    for _ in range(2):  # a task that runs again
        files.write_images(spark.createDataFrame([(*r, 0) for r in rows] + empty + [(*rows[0], 1)], schema), at)
    got = {r.filename: (r.height, r.width, r.nChannels, r.data) for r in files.decode_images(spark, at).collect()}
    assert got == {n: (h, w, c, data) for n, h, w, c, data in rows}
    assert sorted(p.name for p in (tmp_path / "new/images").iterdir()) == sorted(shapes)
    files.write_images(spark.createDataFrame([], schema), f"file://{tmp_path}/none")
    for wrong in [(2, 2, 1, bytearray(b"xyz")), (1, 1, 2, bytearray(b"xy"))]:
        with pytest.raises(Exception, match="(?i)reshape|KeyError"):
            files.write_images(spark.createDataFrame([("x.png", *wrong, 0)], schema), f"file://{tmp_path}/wrong")


def test_manifest_keeps_outer_spaces(spark, tmp_path):
    rows = spark.createDataFrame([("1", "  a "), ("2", ""), ("3", None), ("4", '\n"b",')], "id string, notes string")
    files.write_manifest(rows, str(tmp_path / "m"), MANIFEST_FIELDS)
    assert {r.id: r.notes for r in files.read_manifest(spark, str(tmp_path / "m")).collect()} == {"1": "  a ", "2": None, "3": None, "4": '\n"b",'}


def test_manifest_csv_round_trip_with_mark_quotes_and_breaks(spark, tmp_path):
    text = "﻿id,source_id,width,notes,extra\n1,s1,640,\"a \"\"quoted\"\"\nline\",x\n2,s2,many,,y\n"
    (tmp_path / "m.csv").write_text(text, encoding="utf-8")
    rows = files.read_manifest(spark, str(tmp_path / "m.csv"))
    got = {r.id: r for r in rows.collect()}
    assert got["1"].notes == 'a "quoted"\nline' and got["1"].width == 640 and got["2"].width is None and rows.columns == MANIFEST_FIELDS
    files.write_manifest(rows, str(tmp_path / "out"), MANIFEST_FIELDS)
    again = files.read_manifest(spark, str(tmp_path / "out"))
    assert {(r.id, r.notes) for r in again.collect()} == {("1", 'a "quoted"\nline'), ("2", None)}


def test_json_lines_with_torn_end_and_preflight(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    png(folder / "a.png", np.zeros((4, 4), np.uint8))
    (folder / "b.png.part").write_bytes(b"x")
    (tmp_path / "m.jsonl").write_text('{"id": "1", "subjects": ["a", "b"]}\n\n{"id": "2"}\n{"id": "3", "fil')
    records, broken = files.read_jsonl(spark, str(tmp_path / "m.jsonl"))
    assert sorted(r.id for r in records.collect()) == ["1", "2"] and broken.count() == 1
    got = {r.check: (r.value, r.ok) for r in files.resume_preflight(spark, str(folder), str(tmp_path / "m.jsonl")).collect()}
    assert got == {"part_files": (1, False), "torn_lines": (1, False), "images_less_rows": (-1, False)}


def test_release_is_frozen_and_history_survives_damage(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    df = spark.range(10).select("id", F.when(F.col("id") < 8, "train").otherwise("test").alias("split"))
    files.freeze_release(df, str(tmp_path / "rel"), "v1")
    with pytest.raises(AnalysisException):
        files.freeze_release(df, str(tmp_path / "rel"), "v1")
    assert spark.read.parquet(str(tmp_path / "rel/v1")).where("split = 'test'").count() == 2
    assert files.read_history(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text('[{"id": "a"')
    assert files.read_history(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "good.json").write_text(json.dumps([{"id": "a", "progress": 10}, {"id": "b", "status": "idle"}]))
    assert {r.id for r in files.read_history(spark, str(tmp_path / "good.json")).collect()} == {"a", "b"}


def test_orientation_of_a_jpeg():
    entry = struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 1) + entry
    body = b"Exif\0\0" + tiff
    assert files.orientation(b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\0") == 6
    assert files.orientation(b"\xff\xd8\xff\xda\0\0\0") == 1 and files.orientation(b"") == 1


def test_intake_stream_is_the_same_when_run_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "id string, license string, sha256 string"
    from pyspark.sql.types import _parse_datatype_string

    s = _parse_datatype_string(schema)
    (source / "1.json").write_text('{"id":"a","license":"CC0","sha256":"x"}\n{"id":"b","license":"CC0","sha256":"x"}\n{"id":"c","license":"no","sha256":"y"}\n')
    jobs.intake_stream(spark, str(source), s, str(tmp_path / "ok"), str(tmp_path / "cp")).awaitTermination()
    (source / "2.json").write_text('{"id":"a","license":"CC0","sha256":"z"}\n{"id":"d","license":"CC0","sha256":"x"}\n{"id":"e","license":"CC0","sha256":"w"}\n')
    for _ in range(2):
        jobs.intake_stream(spark, str(source), s, str(tmp_path / "ok"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "ok")).collect()) == ["a", "e"]


def test_a_cluster_has_to_name_the_work_folder():
    from types import SimpleNamespace as Fake

    from tintype.plans.worktables import work_folder

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://x"):
        nothing = Fake(get=lambda *a: None)
        with pytest.raises(ValueError):
            work_folder(Fake(conf=nothing, sparkContext=Fake(getConf=lambda: nothing, master=master, applicationId="a")))


def test_scratch_tables_go_and_results_stay(spark):
    from tintype.plans.worktables import scratch_tables, write_table

    with scratch_tables(spark):
        with scratch_tables(spark):
            inner = write_table(spark.range(3), "inner")
            kept = write_table(inner, "kept", scratch=False)
        assert kept.count() == 3
        outer = write_table(kept, "outer")
        assert outer.count() == 3
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.*exist|not_exist|FILE_NOT"):
        outer.collect()


def test_reports_are_whole_and_records_are_appended(spark, tmp_path):
    rows = spark.range(1500).withColumnRenamed("id", "n")
    files.write_report(rows, f"file://{tmp_path}/report")
    parts = [p for p in (tmp_path / "report").iterdir() if p.suffix == ".json"]
    assert len(parts) == 1 and sorted(json.loads(x)["n"] for x in parts[0].read_text().splitlines()) == list(range(1500))
    with pytest.raises(ValueError):
        files.write_report(spark.range(files.REPORT_ROWS + 1), f"file://{tmp_path}/long")
    for k in range(2):
        files.append_records(rows.where(f"n % 2 = {k}"), f"file://{tmp_path}/records")
    assert spark.read.json(f"file://{tmp_path}/records").count() == 1500
