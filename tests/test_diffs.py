"""Release comparison and mergeable quantiles."""

import random

from pyspark.sql import functions as F

from tintype.operators import diffs, sketches


def test_comparison_equals_a_full_outer_join_and_reads_what_differs(spark, tmp_path):
    rng = random.Random(1)
    a = {f"k{i}": (i % 7, None if i % 11 == 0 else f"v{i}") for i in range(3000)}
    b = dict(a)
    gone, changed = rng.sample(sorted(a), 4), rng.sample(sorted(a), 5)
    for k in gone:
        del b[k]
    for k in changed:
        if k in b:
            b[k] = (b[k][0], "other" if b[k][1] is None else None)
    b |= {"new1": (1, "x"), "new2": (2, None)}
    want = {(k, "removed") for k in a.keys() - b.keys()} | {(k, "added") for k in b.keys() - a.keys()} | {(k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    for name, rows in (("a", a), ("b", b), ("c", a)):
        df = spark.createDataFrame([(k, *v) for k, v in rows.items()], "key string, n int, v string")
        diffs.write_hashed(df.repartition(3 if name == "c" else 5), f"file://{tmp_path}/{name}", "key", 1)
    found = diffs.compare_releases(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b", "key")
    assert {(r.key, r.change) for r in found.collect()} == want
    branches, leaves = diffs.differing(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b")
    assert len(branches) <= len(leaves) <= len(want)
    assert diffs.differing(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c") == ([], [])
    assert diffs.compare_releases(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/c", "key").count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_branch" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_merged_sketches_are_those_of_all_values(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(9), rng.choice([rng.gauss(0, 1), rng.expovariate(1), 3.0])) for _ in range(40_000)] + [("c", 1, None), ("a", 2, float("nan")), ("d", 1, 5.0)]
    df = spark.createDataFrame(rows, "g string, part int, v double")
    merged = sketches.merged_sketches(sketches.quantile_sketches(df, "v", ["g", "part"]), ["g"])
    got = {r.g: r.p for r in sketches.sketched_quantiles(merged, ["g"], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert set(got) == {"a", "b", "d"} and got["d"] == [5.0] * 5
    for g in "ab":
        v = sorted(x for k, _, x in rows if k == g and x is not None and x == x)
        assert got[g][0] == v[0] and got[g][-1] == v[-1]
        for f, x in zip((0.1, 0.5, 0.9), got[g][1:4], strict=True):
            assert sum(y < x for y in v) / len(v) - 0.01 <= f <= sum(y <= x for y in v) / len(v) + 0.01
    assert merged.agg(F.sum("n")).first()[0] == sum(x is not None and x == x for *_, x in rows)
