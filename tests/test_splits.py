"""Groups over several relations, splits by size, releases and resumption."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tintype.operators import pairing, splits
from tintype.sources import files


def test_groups_over_relations(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, f"s{rng.randrange(60)}"]), rng.choice([None, f"c{rng.randrange(90)}"]), rng.choice([None, rng.getrandbits(56)])) for i in range(120)]
    rows += [(200 + i, None, None, r[3] ^ 0b1011) for i, r in enumerate(rows) if r[3] is not None and i % 3 == 0]
    df = spark.createDataFrame(rows, "id long, source string, content string, h long")
    got = {r.id: r.group for r in splits.leak_free_groups(df, "id", ["source", "content"], splits.Near("h", 56, 6)).collect()}
    group = {r[0]: r[0] for r in rows}
    related = lambda a, b: any(a[k] is not None and a[k] == b[k] for k in (1, 2)) or (a[3] is not None and b[3] is not None and (a[3] ^ b[3]).bit_count() <= 6)
    while True:
        new = {a[0]: min(group[b[0]] for b in rows if a[0] == b[0] or related(a, b)) for a in rows}
        if new == group:
            break
        group = new
    assert got == group
    assert {r.id: r.group for r in splits.leak_free_groups(df, "id", ["source"]).collect()}[rows[0][0]] <= rows[0][0]


def test_whole_groups_by_size(spark):
    rng = random.Random(2)
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    for sizes in ([2500, 900, 300, *[rng.randrange(1, 4) for _ in range(3000)]], [1] * 5000, [5, 4, 1]):
        rows = [(g if g else None,) for g, n in enumerate(sizes) for _ in range(n)]
        df = spark.createDataFrame(rows, "g long")
        done = splits.split_by_size(df, "g", shares)
        assert done.count() == len(rows) and done.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
        counts = {r.split: r["count"] for r in done.groupBy("split").count().collect()}
        if len(sizes) > 3:
            assert all(abs(counts[s] / len(rows) - shares[s]) < 0.01 for s in shares)
        again = splits.split_by_size(df.repartition(7), "g", shares)
        assert {(r.g, r.split) for r in again.collect()} == {(r.g, r.split) for r in done.collect()}
    assert splits.split_by_size(df.limit(0), "g", shares).count() == 0


def test_resume_sees_changed_parameters_and_contents(spark):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "filename string, sha256 string")
    one, two = {"size": 512, "mode": "fine"}, {"size": 768, "mode": "fine"}
    left = lambda d, outputs, p: sorted(r.filename for r in pairing.pending_by_content(d, outputs, p).collect())
    outputs = pairing.addressed(df, one)
    assert left(df, outputs, {"mode": "fine", "size": 512}) == [] and left(df, outputs, two) == ["a", "b", "c"]
    changed = df.withColumn("sha256", F.when(F.col("filename") == "b", "9").otherwise(F.col("sha256")))
    assert left(changed, outputs, one) == ["b"]
    assert left(df, outputs.unionByName(pairing.addressed(df.where("filename = 'a'"), two)), two) == ["b", "c"]


def test_a_release_is_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/rel"
    rows = lambda n, tag: spark.range(n).select("id", F.lit(tag).alias("tag"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    files.freeze_release(rows(50, "first"), path, "v1")
    assert {(s["split"], s["rows"]) for s in files.release_manifest(spark, path, "v1")["splits"]} == {("test", 10), ("train", 40)}
    with pytest.raises(AnalysisException):
        files.freeze_release(rows(5, "other"), path, "v1")
    broken = rows(50, "broken").withColumn("id", F.when(F.col("id") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        files.freeze_release(broken, path, "v1", force=True)
    held = lambda v: spark.read.parquet(f"{path}/{v}")
    assert held("v1").count() == 50 and held("v1").where("tag = 'first'").count() == 50
    files.freeze_release(rows(7, "second"), path, "v1", force=True)
    assert held("v1").count() == 7

    def write(k):
        try:
            files.freeze_release(rows(20 + k, f"w{k}"), path, "v2")
            return k
        except AnalysisException:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [k for k in pool.map(write, range(4)) if k is not None]
    assert len(won) == 1 and held("v2").count() == 20 + won[0] and held("v2").select("tag").distinct().count() == 1
    assert sorted(p.name for p in (tmp_path / "rel").iterdir()) == ["v1", "v2"]
