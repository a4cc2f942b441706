"""Tables that streams write: runs, look-ups, retention, the newest tasks, intake and the search index over many batches."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from tintype.operators import tasks
from tintype.streaming import jobs
from tintype.streaming.runs import Runs

EVENT = "task_id string, ts timestamp, event_id long, status string, filename string"


def events_of(rng, n, n_tasks=60, start=1_700_000_000):
    out = []
    for i in range(n):
        k = rng.randrange(n_tasks)
        out.append((f"t{k}", start + 60 * i + rng.randrange(-600, 600), i, rng.choice(["pending", "processing", "completed", "error"]), f"Photo_{k * 37}_{rng.randrange(3)}.JPG"))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "task_id string, ts long, event_id long, status string, filename string").withColumn("ts", F.timestamp_seconds("ts"))


def newest(rows):
    best = {}
    for r in rows:
        if r[0] not in best or (r[1], r[2]) > (best[r[0]][1], best[r[0]][2]):
            best[r[0]] = r
    return best


def test_runs_stay_few_and_hold_every_key(spark, tmp_path):
    """28 batches at a fan of 3: the number of runs stays within fan * levels, look-ups read their buckets only, a replay changes nothing."""
    merge = lambda rows: rows.groupBy("key").agg(F.max("v").alias("v"))
    runs = Runs(spark, f"file://{tmp_path}/r", "key", merge, F.col("v") < 0, fan=3, bucket_rows=50)
    assert runs.read() is None and runs.lookup(spark.range(1).select(F.lit("a").alias("key"))) is None
    rng, want = random.Random(1), {}
    for n in range(28):
        rows = [(f"k{rng.randrange(900)}", rng.randrange(10**6)) for _ in range(60)]
        for k, v in rows:
            want[k] = max(v, want.get(k, v))
        df = spark.createDataFrame(rows, "key string, v long")
        runs.add(df, n)
        if n in (7, 8, 26):  # the last batch comes again, alone or after it has been merged
            runs.add(df, n)
        assert len(runs.runs()) <= 3 * 4
    assert {r.key: r.v for r in runs.read().collect()} == want
    asked = spark.createDataFrame([("k7",), ("k8",), ("nothing",), ("k7",)], "key string")
    assert {r.key: r.v for r in runs.lookup(asked).collect()} == {k: want[k] for k in ("k7", "k8") if k in want}
    assert runs.candidates(asked).count() < 0.25 * sum(runs._read(r).count() for r in runs.runs())
    largest = max(runs.runs(), key=lambda r: r.last - r.first)
    one = runs.candidates(asked.limit(1))
    assert largest.buckets > 4 and one.select(F.input_file_name()).distinct().count() <= len(runs.runs())
    (tmp_path / "r" / "run-000000000028-000000000028-0-1").mkdir()  # a batch whose writer died
    assert {r.key: r.v for r in runs.read().collect()} == want


def test_deletions_hide_rows_and_go_with_the_oldest_run(spark, tmp_path):
    merge = lambda rows: rows.groupBy("key").agg(F.max(F.struct("t", "dead")).alias("x")).select("key", "x.*")
    runs = Runs(spark, f"file://{tmp_path}/d", "key", merge, F.col("dead"), fan=2, bucket_rows=10)
    for n in range(7):
        runs.add(spark.createDataFrame([("a", n, n % 2 == 1), (f"b{n}", n, False)], "key string, t long, dead boolean"), n)
        assert {r.key for r in runs.read().collect()} == {f"b{i}" for i in range(n + 1)} | ({"a"} if n % 2 == 0 else set())
    first = runs.runs()[0]
    assert first.first == 0 and runs._read(first).where("dead").count() == 0


def stream_of(spark, folder, per_trigger=1):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", per_trigger).parquet(str(folder))


def put_files(spark, rng, folder, n, size, start=0):
    """n files of events, one a micro-batch, written in order."""
    import time

    rows = []
    for i in range(n):
        some = events_of(rng, size, start=1_700_000_000 + 3600 * (start + i))
        some = [(t, s, e + (start + i) * size, st, f) for t, s, e, st, f in some]
        rows.append(some)
        frame(spark, some).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)
    return rows


def test_task_states_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    columns = ["status", "filename"]
    seen = [r for some in put_files(spark, rng, tmp_path / "in", 8, 15) for r in some]
    for _ in range(2):  # the second start has nothing new
        jobs.task_state_table(stream_of(spark, tmp_path / "in"), columns, f"file://{tmp_path}/s", str(tmp_path / "cp"), fan=3, bucket_rows=20).awaitTermination()
    got = {r.task_id: (r.event_id, r.status, r.filename) for r in jobs.read_task_states(spark, f"file://{tmp_path}/s", columns).collect()}
    assert got == {k: r[2:] for k, r in newest(seen).items()}
    assert len(jobs.task_states(spark, f"file://{tmp_path}/s", columns).runs()) <= 6


def test_finished_tasks_go_by_timers(spark, tmp_path):
    columns = ["status", "filename"]
    hour = 3600
    batches = [
        [("done", 0, 1, "completed", "a"), ("open", 0, 2, "processing", "b"), ("again", 0, 3, "error", "c")],
        [("again", hour, 4, "processing", "c"), ("done", -hour, 0, "pending", "old")],
        [("tick", 60 * hour, 5, "pending", "d")],
        [("tick", 61 * hour, 6, "completed", "d")],
    ]
    for i, rows in enumerate(batches):
        frame(spark, [(t, 1_700_000_000 + s, e, st, f) for t, s, e, st, f in rows]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.task_state_table(stream_of(spark, tmp_path / "in"), columns, f"file://{tmp_path}/s", str(tmp_path / "cp"), keep="'1' day", late="1 hour").awaitTermination()
        got = {r.task_id: r.event_id for r in jobs.read_task_states(spark, f"file://{tmp_path}/s", columns).collect()}
        if i == 1:
            assert got == {"done": 1, "open": 2, "again": 4}  # the older event of done changes nothing
    assert got == {"open": 2, "again": 4, "tick": 6}


def test_newest_tasks_equal_the_batch_form_after_every_batch(spark, tmp_path):
    rng = random.Random(3)
    seen, out = [], set()
    for i in range(5):
        seen += [r for some in put_files(spark, rng, tmp_path / "in", 1, 12, i) for r in some]
        jobs.newest_tasks(stream_of(spark, tmp_path / "in"), ["status"], f"file://{tmp_path}/n", str(tmp_path / "cp"), n=10).awaitTermination()
        kept = jobs.read_newest_tasks(spark, f"file://{tmp_path}/n").collect()
        want = {r.task_id for r in tasks.recent_tasks(frame(spark, list(newest(seen).values())), 10).collect()}
        assert {r.task_id for r in kept} == want and all(newest(seen)[r.task_id][2] == r.event_id for r in kept)
    assert len([p for p in (tmp_path / "n").iterdir() if p.name.startswith("kept")]) <= 2
    out = {r.task_id for r in spark.read.parquet(f"file://{tmp_path}/n/dropped=*").collect()}
    assert out and {r[0] for r in seen} == want | out


def test_intake_reads_only_what_its_keys_hit(spark, tmp_path):
    schema = _parse_datatype_string("id string, license string, sha256 string")
    rng, rows, known_id, known_sha, accepted = random.Random(4), [], set(), set(), []
    read = []
    for n in range(12):
        batch = sorted((f"i{rng.randrange(3000)}", rng.choice(["CC0", "CC0", "no"]), f"h{rng.randrange(3000)}") for _ in range(40))
        df = spark.createDataFrame(batch, schema)
        keys = jobs.known_keys(spark, f"file://{tmp_path}/ok_keys", fan=3, bucket_rows=8)
        found = keys.candidates(jobs._keys_of(df.limit(2)), before=n)
        read.append(found.count() if found is not None else 0)
        for _ in range(2 if n % 4 == 3 else 1):  # some batches run twice
            jobs.take_in(df, n, f"file://{tmp_path}/ok", fan=3, bucket_rows=8)
        new = [r for r in dict((r[0], r) for r in reversed(batch) if r[1] == "CC0").values() if r[0] not in known_id and r[2] not in known_sha]
        got = spark.read.parquet(f"file://{tmp_path}/ok/batch={n}").collect()
        assert {r.sha256 for r in got} <= {r[2] for r in new} and not {r.id for r in got} & known_id and not {r.sha256 for r in got} & known_sha
        assert len({r.id for r in got}) == len({r.sha256 for r in got}) == len(got)
        known_id |= {r.id for r in got}
        known_sha |= {r.sha256 for r in got}
        accepted += got
        rows += batch
    every = spark.read.parquet(f"file://{tmp_path}/ok").count()
    assert every == len(accepted) == len(known_id)
    assert max(read[6:]) <= 4 * 8 * 8 and every > 200  # four keys, some eight runs, buckets of some eight rows
    assert {r[2] for r in rows if r[1] == "CC0" and r[0] not in known_id} <= known_sha | {r[2] for r in rows}


def test_search_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(5)
    index = jobs.HistoryIndex(spark, f"file://{tmp_path}/h", ["status", "filename"], fan=3, bucket_rows=20)
    with pytest.raises(ValueError):
        index.search("abc")
    seen = []
    for n in range(5):
        some = events_of(rng, 40, 400)
        some = [(t, s + 9999 * n, e + 1000 * n, st, f) for t, s, e, st, f in some]
        seen += some
        index.add(tasks.latest_per_task(frame(spark, some), ["status", "filename"]), n)
        if n == 3:
            index.add(tasks.latest_per_task(frame(spark, some), ["status", "filename"]), n)
    now = newest(seen)
    for term in ("photo_3", "37_1", ".jpg", "_0.J", "10", "7", "", "zzz", "PHOTO_111_2.jpg"):
        want = {(k, r[4]) for k, r in now.items() if term.lower() in r[4].lower()}
        assert {(r.task_id, r.filename) for r in index.search(term).collect()} == want, term
    asked = spark.range(1).select(F.explode(jobs.grams(F.lit("111_2"))).alias("gram"))
    assert index.postings.candidates(asked).count() < 0.5 * index.postings.read().count()


def test_counts_equal_a_recount_after_any_order_and_a_replay(spark, tmp_path):
    rng = random.Random(6)
    counts = jobs.StatusCounts(spark, f"file://{tmp_path}/c", fan=3, bucket_rows=20)
    assert counts.read() is None
    batches = [events_of(rng, 30, 25) for _ in range(5)]
    batches = [[(t, s + 3600 * k, e + 1000 * k, st, f) for t, s, e, st, f in rows] for k, rows in enumerate(batches)]
    rng.shuffle(batches)
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        for _ in range(2 if n in (1, 3) else 1):
            counts.update(frame(spark, rows), n)
        want = {}
        for r in newest(seen).values():
            want[r[3]] = want.get(r[3], 0) + 1
        assert {r.status: r.n for r in counts.read().collect()} == want
    # a batch that died after its counts and before its states
    rows = [("t1", 1_900_000_000, 10**6, "completed", "x"), ("new", 1_900_000_000, 10**6 + 1, "pending", "x")]
    states_add, counts.states.add = counts.states.add, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        counts.update(frame(spark, rows), len(batches))
    counts.states.add = states_add
    counts.update(frame(spark, rows), len(batches))
    seen += rows
    assert sum(r.n for r in counts.read().collect()) == len(newest(seen)) and {r.status: r.n for r in counts.read().collect()}["completed"] == sum(r[3] == "completed" for r in newest(seen).values())
