"""Properties and edge cases that the SQL comparison doesn't reach."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tintype.operators import images, intake, kernels, near, pairing, release
from tintype.operators.components import connected_components


def test_dedupe_keeps_one_row_a_key_and_survives_nulls(spark):
    rows = [(1, "a", "s1"), (2, "a", "s2"), (3, None, "s3"), (4, None, "s4"), (5, "b", "s5")]
    got = {r.pos: r.keeper for r in intake.dedupe_first(spark.createDataFrame(rows, "pos long, sha256 string, source_id string")).collect()}
    assert got == {1: None, 2: "s1", 3: None, 4: None, 5: None}


def test_small_first_copy_is_no_original(spark):
    rows = [(1, "s1", "x", 100, 900, True, "CC0"), (2, "s2", "x", 900, 900, True, "CC0"), (3, "s3", "x", 900, 900, True, "CC0"), (4, "s4", "y", 900, 900, None, "CC0")]
    df = spark.createDataFrame(rows, "pos long, source_id string, sha256 string, width int, height int, decode_ok boolean, license string")
    assert {r.pos: r.reason for r in intake.clean_batch(df).collect()} == {1: "low_resolution", 2: None, 3: "duplicate_of:s2", 4: "decode_error"}


def test_ranked_numbers_rows_by_order_whatever_the_partitions(spark):
    ids = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    assert [r.id for r in sorted(intake.ranked(df, "id").collect(), key=lambda r: r.row)] == sorted(ids)


def test_group_split_never_divides_a_group(spark):
    df = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") % 300).cast("string").alias("source_id"))
    assert pairing.split_by_group(df).groupBy("source_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 99, 500])
def test_linspace_split_equals_loop(spark, n):
    df = spark.range(100).withColumnRenamed("id", "k")
    many = min(max(1, n), 99)
    want = {0} if many == 1 else {99 if i == many - 1 else int(i * (99 / (many - 1))) for i in range(many)}
    assert {r.k for r in pairing.split_linspace(df, n, "k").where("split = 'test'").collect()} == want


def test_review_sample_has_the_wanted_size_for_uneven_strata(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4900, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("s"), F.col("id").cast("string").alias("k"))
    sizes = {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    got = {r.s: r["count"] for r in pairing.review_sample(df, "s", "k", 0.1, 10, 3).groupBy("s").count().collect()}
    assert got == {s: min(n, max(10, -(-n // 10))) for s, n in sizes.items()}


def test_components_of_a_long_chain_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def test_hash_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(56) for _ in range(40)]
    values = base + [b ^ (1 << rng.randrange(56)) ^ (1 << rng.randrange(56)) for b in base for _ in range(4)]
    df = spark.createDataFrame([(v,) for v in values + values[:10]], "h long")
    want = {(a, b) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= 4}
    assert {(r.a, r.b) for r in near.hash_pairs(df, "h", 56, 4).collect()} == want


def test_long_hashes_and_cut_buckets(spark, monkeypatch):
    monkeypatch.setattr(near, "PIECE", 7)  # so that buckets are cut
    rng = random.Random(5)
    base = [rng.getrandbits(144) for _ in range(12)]
    values = list(base)
    for b in [*base, *[base[0]] * 60]:
        for k in range(rng.randrange(12)):
            b ^= 1 << rng.randrange(144)
        values.append(b)
    df = spark.createDataFrame([(i, f"{v:036x}", "ab"[i % 2]) for i, v in enumerate(values)] + [(-1, None, "a")], "name long, h string, split string")
    for most in (3, 6, 10):
        want = {(f"{a:036x}", f"{b:036x}", (a ^ b).bit_count()) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= most}
        assert {tuple(r) for r in near.hash_pairs(df, "h", 144, most).collect()} == want
    across = {(r.a, r.b) for r in near.leak_near(df, "h", 144, 6).collect()}
    splits = {v: {"ab"[i % 2] for i, w in enumerate(values) if w == v} for v in values}
    assert across == {(f"{a:036x}", f"{b:036x}") for a in splits for b in splits if (a < b and (a ^ b).bit_count() <= 6 and (splits[a] | splits[b] == {"a", "b"})) or (a == b and len(splits[a]) == 2)}
    reach = list(range(len(values)))
    while True:
        new = [min(reach[j] for j in range(len(values)) if (values[i] ^ values[j]).bit_count() <= 6) for i in range(len(values))]
        if new == reach:
            break
        reach = new
    assert {r.name: r.component for r in near.near_dup_components(df, "name", "h", 144, 6).collect()} == dict(enumerate(reach)) | {-1: -1}
    small = spark.createDataFrame([(v,) for v in {rng.getrandbits(30) & 0x3F3F for _ in range(300)}], "h long")
    got = {(r.a, r.b) for r in near.hash_pairs(small, "h", 30, 2).collect()}
    known = [r.h for r in small.collect()]
    assert got == {(a, b) for a in known for b in known if a < b and (a ^ b).bit_count() <= 2}


def test_hashes_of_images_fit_the_near_operators(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (3, 60, 80)).astype(np.uint8)
    rows = [(f"{i}{k}", 80, 60, 1, np.clip(b.astype(int) + k, 0, 255).astype(np.uint8).tobytes()) for i, b in enumerate(base) for k in (0, 1)]
    hashes = images.full_dhash(spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary"))
    got = {r.origin: r.component for r in near.near_dup_components(hashes, "origin", "dhash", 144, 6).collect()}
    assert got == {f"{i}{k}": f"{i}0" for i in range(3) for k in (0, 1)}


def test_fingerprint_ignores_order_and_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7).alias("v"))
    one, other = (release.release_fingerprint(x, ["id", "v"]).collect() for x in (df, df.orderBy(F.desc("v")).repartition(7)))
    assert one == other
    assert release.release_fingerprint(df.withColumn("v", F.col("v") + (F.col("id") == 5).cast("int")), ["id", "v"]).collect() != one


def test_image_job_reports_bad_rows(spark):
    rows = [("a", 2, 2, 3, bytes(12)), ("b", 0, -1, -1, b""), ("c", 9, 9, 1, b"short"), ("d", 2, 2, 1, None)]
    df = spark.createDataFrame(rows, "origin string, width int, height int, nChannels int, data binary")
    got = {r.origin: (r.status, r.error) for r in images.full_image_stats(df).collect()}
    assert got["a"] == ("ok", None) and got["b"] == ("error", "decode_error") and got["d"] == ("error", "decode_error") and got["c"][0] == "error"


def test_kernels_against_plain_loops():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (9, 11)).astype(np.uint8)
    lap = np.zeros(g.shape)
    at = lambda y, x: float(g[abs(y) if y < 9 else 16 - y, abs(x) if x < 11 else 20 - x])
    for y in range(9):
        for x in range(11):
            lap[y, x] = at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x)
    assert np.array_equal(kernels.laplacian(g), lap)
    a = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert kernels.ssim(a, a) == pytest.approx(1) and kernels.psnr(a, a) == float("inf")
    x, y = a[..., 0].astype(float), rng.integers(0, 256, (20, 20)).astype(float)
    wx, wy = x[3:10, 5:12], y[3:10, 5:12]
    assert kernels.box(x * y, 7)[3, 5] == pytest.approx((wx * wy).sum())
    m = rng.random((15, 15)) < 0.4
    seen, parts = np.zeros(m.shape, int), 0
    for sy, sx in zip(*np.nonzero(m), strict=True):
        if not seen[sy, sx]:
            parts += 1
            todo = [(sy, sx)]
            while todo:
                y0, x0 = todo.pop()
                if 0 <= y0 < 15 and 0 <= x0 < 15 and m[y0, x0] and not seen[y0, x0]:
                    seen[y0, x0] = parts
                    todo += [(y0 + i, x0 + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    label = kernels.components(m)
    assert len(set(zip(seen[m].tolist(), label[m].tolist(), strict=True))) == parts == len(set(label[m].tolist()))


def test_damage_masks_hit_a_line_and_a_blob():
    g = np.full((64, 64), 150, np.uint8)
    g[30, 5:60] = 20
    g[10:14, 40:44] = 255
    for detect in (kernels.morph_mask, kernels.texture_mask):
        m = detect(g, 0.5)
        assert m[30, 20:50].min() > 200 and m[11:13, 41:43].min() > 200 and m[50, 10] == 0


def test_previous_row_within_a_hot_key(spark):
    rows = [(("hot" if i % 3 else f"k{i % 5}"), i // 2, i, i * 10) for i in range(3000)]
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, e long, v long")
    want, last = {}, {}
    for k, t, e, v in sorted(rows):
        want[e] = last.get(k)
        last[k] = v
    assert {r.e: r.p for r in intake.previous(df, "k", ["t", "e"], "v", "p").collect()} == want


def test_upright_undoes_every_orientation():
    a = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    stored = {1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.transpose(1, 0, 2), 6: np.rot90(a, 1), 7: a[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(a, -1)}
    for orientation, image in stored.items():
        assert np.array_equal(kernels.upright(np.ascontiguousarray(image), orientation), a), orientation


def test_loss_of_equal_images_is_zero():
    a = np.random.default_rng(0).integers(0, 256, (16, 16, 3)).astype(np.uint8)
    dark, light = np.zeros((64, 64, 3), np.uint8), np.full((64, 64, 3), 255, np.uint8)  # means of -1 and 1, no variance but at the borders
    assert abs(kernels.ssim_loss(a, a)) < 1e-12 and kernels.ssim_loss(dark, light) > 1.5


def test_ageing_is_seeded_and_wears_by_textures():
    rgb = np.full((30, 40, 3), 120, np.uint8)
    scratch = np.zeros((60, 60), np.uint8)
    scratch[::6] = 255
    assert np.array_equal(kernels.age(rgb, 5, [scratch]), kernels.age(rgb, 5, [scratch])) and not np.array_equal(kernels.age(rgb, 5), kernels.age(rgb, 6))
    cover = np.zeros((30, 40))
    cover[10, 10] = 1
    out = kernels.worn(rgb, [cover, cover * 0])
    assert out[10, 10].tolist() == [int((240 * 0.8) + c * 0.2) for c in (60, 50, 40)] and (out[0] == 120).all()


def test_session_functions(spark):
    from tintype.functions import scalars

    scalars.register(spark)
    got = spark.sql("select license_norm('  CC-BY   4.0 ') a, clean_url('http://x/#w=1') b, hamming(5L, 6L) c").first()
    assert tuple(got) == ("cc by 4.0", "http://x/", 2)


def test_empty_tables_give_empty_results(spark):
    from tintype.operators import audit, tasks

    m = spark.createDataFrame([], "pos long, id string, source_id string, sha256 string, width int, height int, decode_ok boolean, license string, provider string, split string, status string")
    assert intake.clean_batch(m).count() == 0 and audit.duplicate_groups(m, "sha256").count() == 0 and near.hash_pairs(m.select("pos"), "pos", 56, 4).count() == 0
    assert pairing.review_sample(m, "provider", "id", 0.1, 5, 1).count() == 0 and pairing.split_linspace(m, 5, "pos").count() == 0
    gates = {r.gate: r.passed for r in release.release_gate(m).collect()}
    assert gates["decode_errors"] and not gates["test_rows"] and release.release_fingerprint(m, ["id"]).count() == 1
    e = spark.createDataFrame([], "task_id string, ts timestamp, event_id long, status string, mode string")
    assert tasks.latest_per_task(e, ["status"]).count() == 0 and tasks.task_durations(e).count() == 0


def test_textures_of_one_file_of_images_are_drawn_by_many_tasks(spark):
    from pyspark.sql import functions as F

    from tintype.operators import pairing

    images = spark.range(400).coalesce(1).selectExpr("concat('p_', id) as filename")
    textures = spark.range(7).selectExpr("concat('t_', id) as texture")
    rows = pairing.assign_textures(images, textures, 3, 5).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 1200 and len({r.task for r in rows}) > 8
