"""Patch features, masks and the classifier against plain loops and known answers."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tintype.operators import images, kernels, patchml

RNG = np.random.default_rng(3)


def mirrored(i, n):
    while not 0 <= i < n:
        i = -i if i < 0 else 2 * n - 2 - i
    return i


def at(p, y, x):
    return float(p[mirrored(y, p.shape[0]), mirrored(x, p.shape[1])])


def test_gabor_responses_equal_plain_sums():
    p = RNG.integers(0, 256, (10, 10)).astype(np.uint8)
    got, k = patchml.gabor_responses(p), 0
    assert len(got) == 72
    for theta in range(8):
        c, s = np.cos(theta * np.pi / 8), np.sin(theta * np.pi / 8)
        for sigma in (1, 2, 3):
            for wave in (3, 5, 8):
                for y, x in ((0, 0), (9, 4), (5, 5)):
                    total = 0.0
                    for dy in range(-5, 6):
                        for dx in range(-5, 6):
                            u, v = dx * c + dy * s, dy * c - dx * s
                            total += at(p, y + dy, x + dx) * np.exp(-u * u / (2 * sigma**2) - v * v / (2 * (sigma / 0.5) ** 2)) * np.cos(2 * np.pi * u / wave)
                    assert got[k, y, x] == pytest.approx(total, abs=1e-6)
                k += 1


def test_patterns_statistics_and_gradients_equal_plain_loops():
    p = RNG.integers(0, 256, (12, 12)).astype(np.uint8)
    f = patchml.features(p)
    codes, sizes, angles = np.zeros(256), [], []
    for y in range(12):
        for x in range(12):
            code = 0
            for i in range(8):
                dx, dy = round(3 * np.cos(2 * np.pi * i / 24)), round(3 * np.sin(2 * np.pi * i / 24))
                inside = 0 <= y - dy < 12 and 0 <= x - dx < 12
                code += ((float(p[y - dy, x - dx]) if inside else 0) >= p[y, x]) << i
            codes[code] += 1
            gx = sum(w * (at(p, y + j, x + 1) - at(p, y + j, x - 1)) for j, w in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(w * (at(p, y + 1, x + j) - at(p, y - 1, x + j)) for j, w in ((-1, 1), (0, 2), (1, 1)))
            sizes.append(np.hypot(gx, gy))
            angles.append(np.float32(np.arctan2(np.float32(gy), np.float32(gx))))
    turned = np.histogram(np.array(angles), 8, (-np.pi, np.pi))[0] / 144
    assert f[144:400] == pytest.approx(codes / 144, abs=1e-6)
    assert f[405:] == pytest.approx([np.mean(sizes), np.std(sizes), turned.max(), *turned], rel=1e-5, abs=1e-6)
    x = p.astype(float)
    z = (x - x.mean()) / x.std()
    share = np.histogram(x, 16, (0, 256))[0] / 144
    assert f[400:405] == pytest.approx([x.mean(), x.std(), (z**3).mean(), (z**4).mean(), -sum(s * np.log2(s + 1e-7) for s in share)], rel=1e-4)
    assert f[:144:2] == pytest.approx(np.abs(patchml.gabor_responses(p)).mean(axis=(1, 2)), rel=1e-5) and len(f) == 416


def test_version_one_adds_blocks():
    p = RNG.integers(0, 256, (19, 17)).astype(np.uint8)
    blocks = [p[y : y + 8, x : x + 8].astype(float) for y in (0, 8) for x in (0, 8)]
    assert patchml.block_features(p.astype(float)) == pytest.approx([np.std([b.mean() for b in blocks]), np.mean([b.std() for b in blocks]), max(b.std() for b in blocks)])
    q = RNG.integers(0, 256, (16, 16)).astype(np.uint8)
    assert len(patchml.features(q, 1)) == 419 and np.array_equal(patchml.features(q, 1)[:416], patchml.features(q))


def test_ellipses_and_blurs():
    cross = {(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)}
    assert set(kernels._ellipse(3)) == cross and set(kernels._ellipse(2)) == {(0, 0), (-1, 0), (0, -1)} and len(kernels._ellipse(5)) == 17
    g = RNG.integers(0, 256, (7, 9)).astype(np.uint8)
    for k, w in ((3, [1, 2, 1]), (5, [1, 4, 6, 4, 1])):
        out = kernels.gaussian(g, k)
        for y, x in ((0, 0), (3, 4), (6, 8)):
            total = sum(w[i] * w[j] * at(g, y + i - k // 2, x + j - k // 2) for i in range(k) for j in range(k))
            assert out[y, x] == int(total / sum(w) ** 2 + 0.5)
    for pick, name in ((max, kernels.dilate), (min, kernels.erode)):
        assert all(name(g)[y, x] == pick(g[y + j, x + i] for j, i in cross if 0 <= y + j < 7 and 0 <= x + i < 9) for y in range(7) for x in range(9))


def test_holes_are_filled_but_not_bays():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[3:6, 3:6] = False
    assert kernels.filled(ring)[4, 4] and kernels.filled(ring).sum() == 25
    ring[4, 6] = False
    assert not kernels.filled(ring)[4, 4]


def test_area_limits_are_those_of_bright_spots():
    def marked(value, side, ground=150):
        g = np.full((96, 96), ground, np.uint8)
        g[40 : 40 + side, 40 : 40 + side] = value
        return kernels.morph_mask(g, 1.0)[40 + side // 2, 40 + side // 2]

    assert marked(0, 8) == 255 and marked(255, 8, ground=230) == 255  # a dark spot; a bright one of fitting area
    assert marked(255, 40, ground=230) == 0  # a bright one too large
    assert marked(0, 40) == 255  # dark ones have no limit


def test_line_boxes_take_each_direction_by_itself():
    g = np.full((64, 64), 200, np.uint8)
    g[20:25, 10:50] = 0  # wide: seen along columns only
    assert (20, 10, 5, 40) in kernels.line_boxes(g)


def test_stitching_closes_and_blurs():
    m = patchml.stitched_mask(12, 12, np.array([2, 2]), np.array([2, 7]), np.array([0.9, 0.9]), 4, 0.5)
    hit = np.zeros((12, 12), np.uint8)
    hit[2:6, 2:6] = hit[2:6, 7:11] = 255
    assert np.array_equal(m, kernels.gaussian(kernels.closed(hit), 5)) and m[3, 6] > 200
    twice = patchml.stitched_mask(8, 8, np.array([0, 0]), np.array([0, 0]), np.array([1.0, 0.0]), 8, 0.5)
    assert twice.max() == 0  # a mean of exactly the threshold isn't above it


@pytest.fixture(scope="module")
def striped(spark):
    rows = []
    for i in range(120):
        p = RNG.integers(90, 110, (8, 8))
        if i % 2:
            p[:, i % 8] = 250
        rows.append((i, i % 2, [int(v) for v in p.ravel()]))
    return spark.createDataFrame(rows, "patch_id long, target int, px array<int>")


def test_classifier_learns_and_finds_damage(spark, striped, tmp_path):
    df = patchml.patch_features(striped, "px", 8)
    model, accuracies = patchml.train_patch_classifier(df, trees=15, depth=5, folds=3)
    assert len(accuracies) == 3 and min(accuracies) > 0.9
    alone, none = patchml.train_patch_classifier(df, trees=15, depth=5, folds=0)
    assert none == []
    patchml.save(alone, f"file://{tmp_path}/model")
    again = patchml.load(f"file://{tmp_path}/model")
    one, two = ({r.patch_id: r.prob for r in patchml.score_patches(m, df).collect()} for m in (alone, again))
    assert one == two and all((p > 0.5) == bool(i % 2) for i, p in one.items())
    top = patchml.top_importances(alone)
    assert len(top) == 10 and [v for _, v in top] == sorted((v for _, v in top), reverse=True)
    g = RNG.integers(90, 110, (32, 32)).astype(np.uint8)
    g[:, 19] = 250
    image = spark.createDataFrame([("a", 32, 32, 1, g.tobytes()), ("bad", -1, -1, -1, None), ("small", 4, 4, 1, bytes(16))], "origin string, width int, height int, nChannels int, data binary")
    got = patchml.learned_mask(image, alone, 8, 4, 0.5, side=None).collect()
    assert [r.origin for r in got] == ["a"]
    m = np.frombuffer(got[0].mask, np.uint8).reshape(32, 32)
    assert m[16, 18] > 200 and m[16, 2] == 0 and got[0].coverage == pytest.approx(m.mean() / 255)
    assert patchml.score_patches(alone, df.limit(0)).count() == 0 and patchml.patch_features(striped.withColumn("px", F.slice("px", 1, 5)), "px", 8).where("features is not null").count() == 0


def test_patches_stay_inside_the_image(spark):
    g = np.full((40, 40), 200, np.uint8)
    g[18:22, :] = 0
    rows = spark.createDataFrame([("a", 40, 40, 1, g.tobytes())], "origin string, width int, height int, nChannels int, data binary")
    found = images.scratch_patches(rows, 32, 10, 1, side=128).collect()
    assert found and all(len(r.patch) == 1024 and 0 <= r.y <= 96 and 0 <= r.x <= 96 for r in found)


def lab_of(r, g, b):
    linear = [((c / 255 + 0.055) / 1.055) ** 2.4 if c / 255 > 0.04045 else c / 255 / 12.92 for c in (r, g, b)]
    x = (0.412453 * linear[0] + 0.357580 * linear[1] + 0.180423 * linear[2]) / 0.950456
    y = 0.212671 * linear[0] + 0.715160 * linear[1] + 0.072169 * linear[2]
    z = (0.019334 * linear[0] + 0.119193 * linear[1] + 0.950227 * linear[2]) / 1.088754
    f = [v ** (1 / 3) if v > 0.008856 else 7.787 * v + 16 / 116 for v in (x, y, z)]
    return (116 * f[1] - 16) * 255 / 100, 500 * (f[0] - f[1]) + 128, 200 * (f[1] - f[2]) + 128


def test_colour_statistics_equal_plain_loops():
    rgb = RNG.integers(0, 256, (6, 7, 3)).astype(np.uint8)
    rgb[0, 0] = 0
    pixels = [tuple(int(v) for v in rgb[y, x]) for y in range(6) for x in range(7)]
    gray = [round(0.299 * r + 0.587 * g + 0.114 * b) for r, g, b in pixels]
    saturation = [round((max(p) - min(p)) * 255 / max(p)) if max(p) else 0 for p in pixels]
    got = kernels.statistics(rgb)
    assert got["brightness"] == pytest.approx(np.mean(gray), abs=6e-4) and got["contrast"] == pytest.approx(np.std(gray), abs=6e-4) and got["saturation"] == pytest.approx(np.mean(saturation), abs=6e-4)
    lab = np.array([lab_of(*p) for p in pixels])
    assert kernels.noref(rgb)["color"] == pytest.approx(lab.std(axis=0).sum(), rel=1e-9)
    other = RNG.integers(0, 256, (6, 7, 3)).astype(np.uint8)
    d = rgb.astype(float) - other
    want = {"mae": np.abs(d).mean(), "psnr": 20 * np.log10(255 / np.sqrt((d**2).mean())), "shift": np.mean([abs(rgb[..., c].mean() - other[..., c].mean()) for c in range(3)])}
    assert kernels.pair_difference(rgb, other) == pytest.approx(want) and kernels.pair_difference(rgb, rgb) == {"mae": 0.0, "psnr": 99.0, "shift": 0.0}


def test_colour_correction_and_similarity_equal_plain_loops():
    rgb = RNG.integers(0, 256, (9, 10, 3)).astype(np.uint8)
    means = [rgb[..., c].mean() for c in range(3)]
    out = kernels.colour_correct(rgb)
    for y, x in ((0, 0), (4, 7), (8, 9)):
        p = [min(255.0, rgb[y, x, c] * np.mean(means) / means[c]) for c in range(3)]
        assert out[y, x].tolist() == [int(min(255.0, max(0.0, (np.mean(p) + (v - np.mean(p)) * 1.1) * 1.05))) for v in p]
    other = RNG.integers(0, 256, (9, 10, 3)).astype(np.uint8)
    scores = []
    for c in range(3):
        for y in range(3):
            for x in range(4):
                a, b = (i[y : y + 7, x : x + 7, c].astype(float).ravel() for i in (rgb, other))
                cov = np.cov(a, b)
                scores.append((2 * a.mean() * b.mean() + 6.5025) * (2 * cov[0, 1] + 58.5225) / ((a.mean() ** 2 + b.mean() ** 2 + 6.5025) * (cov[0, 0] + cov[1, 1] + 58.5225)))
    assert kernels.ssim(rgb, other) == pytest.approx(np.mean(scores))


def test_otsu_and_adaptive_mask():
    values = np.r_[RNG.integers(20, 60, 300), RNG.integers(180, 220, 100)].astype(np.uint8)
    spread = []
    for t in range(256):
        low, high = values[values <= t], values[values > t]
        spread.append(len(low) * len(high) * (low.mean() - high.mean()) ** 2 if len(low) and len(high) else 0)
    assert kernels.otsu(values) == int(np.argmax(spread))
    g = np.full((64, 64), 128, np.uint8)
    assert (kernels.adaptive_mask(g, 0.5) == 64).all()  # nothing found: flat
    g[20:30, 20:30] = RNG.integers(0, 256, (10, 10))
    m = kernels.adaptive_mask(g, 0.5)
    assert m[25, 25] == 255 and m[50, 50] == 0


def test_variants_are_seeded_and_their_mask_is_what_was_put_on():
    rgb = np.full((40, 60, 3), 128, np.uint8)
    params = {"sepia": 0.0, "fade": 0.0, "vignette": 0.0, "grain": 0.0, "scratches": 3, "stains": 1}
    out, mask = kernels.degraded(rgb, params, 4)
    assert np.array_equal(out, kernels.degraded(rgb, params, 4)[0]) and not np.array_equal(out, kernels.degraded(rgb, params, 5)[0])
    assert mask.any() and ((out != 128).any(axis=2) <= (mask > 0)).all()
    faded, none = kernels.degraded(rgb, params | {"scratches": 0, "stains": 0, "fade": 0.5}, 4)
    assert not none.any() and (faded == 191).all()


def test_training_crops_are_alike_on_both_sides(spark):
    rgb = RNG.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    for seed in range(6):
        a, b = kernels.paired_crop(rgb, 255 - rgb, 24, seed)
        assert np.array_equal(255 - a, b) and a.shape == (24, 24, 3)
        options = [np.rot90(o, k) for k in range(4) for o in (rgb, rgb[:, ::-1])]
        assert any(np.array_equal(a, o[y : y + 24, x : x + 24]) for o in options for y in range(o.shape[0] - 23) for x in range(o.shape[1] - 23))
    small = kernels.paired_crop(rgb[:10], rgb[:10], 24, 1)[0]
    assert small.shape == (24, 24, 3)


def test_features_of_many_patches_are_those_of_each():
    for size, version in ((8, 2), (8, 1), (32, 2)):
        some = RNG.integers(0, 256, (70, size, size)).astype(np.uint8)
        some[:4] = np.array([0, 15, 128, 255])[:, None, None]
        assert np.array_equal(patchml.features_of(some, version), [patchml.features(p, version) for p in some])
        gray = np.histogram(some[9], bins=16, range=(0, 256))[0] / size**2
        gx, gy = patchml.gradients(some[9])
        turned = np.histogram(np.arctan2(gy, gx), bins=8, range=(-np.pi, np.pi))[0] / size**2
        got = patchml.features(some[9])
        assert got[404] == pytest.approx(-(gray * np.log2(gray + 1e-7)).sum(), rel=1e-5) and got[408:416] == pytest.approx(turned, rel=1e-5)


def test_windows_of_one_file_are_made_by_many_tasks(spark):
    image = spark.range(64).coalesce(1).selectExpr("cast(id as string) as origin", "8 as width", "8 as height", "1 as nChannels", "unhex(repeat(hex(cast(id % 8 as int) + 16), 64)) as data")
    made = patchml.window_features(image, 8, 8, None)
    at = made.select("origin", F.spark_partition_id().alias("task")).collect()
    assert len(at) == 64 and len({r.task for r in at}) > 8


def test_trees_are_trained_as_several_forests(spark):
    rows = spark.range(1200).selectExpr("id as patch_id", "cast(id % 2 as int) as target", "transform(sequence(0, 5), i -> cast(id % 2 * 3 + (id * 7 + i) % 5 as float)) as features")
    model, accuracies = patchml.train_patch_classifier(rows, trees=10, depth=4, folds=2)
    forests = model.stages[1:]
    assert [f.getNumTrees for f in forests] == [3, 3, 2, 2] and len({f.trees[0].toDebugString for f in forests}) > 1
    assert len(accuracies) == 2 and min(accuracies) > 0.9
    scored = model.transform(rows.limit(50).withColumn("raw", array_to_vector(F.col("features").cast("array<double>")))).collect()
    want = {r.patch_id: sum(t.predictProbability(r.scaled)[1] for f in forests for t in f.trees) / 10 for r in scored[:8]}
    got = {r.patch_id: r.prob for r in patchml.score_patches(model, rows.where(F.col("patch_id").isin(list(want)))).collect()}
    assert got == pytest.approx(want)
    assert sum(v for _, v in patchml.top_importances(model)) == pytest.approx(1)
