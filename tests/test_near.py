"""Near hashes: crowded buckets, components by stars, and the planted copies of the query."""

import random

from pyspark.sql import functions as F

from tintype.operators import images, near
from tintype.plans import job_catalog


def plain_components(values, distance):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= distance:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(values))]


def test_components_of_crowded_buckets(spark, monkeypatch):
    """Hashes that share blocks, more than a piece of them, some in chains of near ones; long and hex hashes."""
    monkeypatch.setattr(near, "PIECE", 20)
    rng = random.Random(1)
    for bits, distance in ((56, 6), (144, 6)):
        base = rng.getrandbits(bits)
        values = [base ^ (rng.getrandbits(40) << bits - 40) for _ in range(150)] + [rng.getrandbits(bits) for _ in range(50)]
        for v in list(values[:40]):
            for _ in range(3):
                v ^= sum(1 << b for b in rng.sample(range(bits), 4))
                values.append(v)
        values += values[:5]
        rows = [(f"i{i:03d}", v if bits < 63 else f"{v:036x}") for i, v in enumerate(values)]
        df = spark.createDataFrame([*rows, ("none", None)], f"name string, h {'long' if bits < 63 else 'string'}")
        got = {r.name: r.component for r in near.near_dup_components(df, "name", "h", bits, distance).collect()}
        want = plain_components(values, distance)
        assert got == {f"i{i:03d}": f"i{want[i]:03d}" for i in range(len(values))} | {"none": "none"}
        pairs = {tuple(sorted((a, b))) for a in set(values) for b in set(values) if a < b and (a ^ b).bit_count() <= distance}
        found = near.hash_pairs(df, "h", bits, distance).collect()
        assert {tuple(sorted((r.a, r.b) if bits < 63 else (int(r.a, 16), int(r.b, 16)))) for r in found} == pairs and len(found) == len(pairs)


def test_one_crowded_block_emits_no_pairs(spark):
    """5000 hashes that agree on a block: what is compared and what is handed on grows with them, not with their square."""
    rng = random.Random(2)
    rows = [(f"{(0xABCDE << 124) | rng.getrandbits(124):036x}",) for _ in range(5000)]
    df = spark.createDataFrame(rows, "h string")
    met, _ = near._meetings(df, "h", 144, 6)
    largest = met.groupBy("t", "key", "g", "f").count().agg(F.max("count")).first()[0]
    keys = 7 + 84
    assert largest <= 2 * near.PIECE and met.count() <= 5000 * keys
    assert near.hash_links(df, "h", 144, 6).count() <= 5000 * keys
    same = spark.createDataFrame([(f"{0xABCDE << 124 | 1 << i | 1 << j:036x}",) for i in range(60) for j in range(60)], "h string")
    assert near.hash_links(same, "h", 144, 6).count() <= 1830 * keys * 3  # 1830 hashes, near each other, in two pieces of each bucket: some 1.6 million pairs


def test_planted_images_are_found(spark, sf_dir):
    got = {r.origin: r.component for r in job_catalog.near_images(spark, sf_dir).collect()}
    originals = [k for k in got if not k.endswith("v")]
    assert len(got) == 2 * len(originals)
    assert sum(got[k] == got[k + "v"] for k in originals) >= 0.9 * len(originals)
    hashes = {r.origin: int(r.dhash, 16) for r in images.full_dhash(job_catalog._large(spark, sf_dir)).collect()}
    assert all((got[a] == got[b]) or (hashes[a] ^ hashes[b]).bit_count() > 6 for a in originals for b in originals if a < b)
