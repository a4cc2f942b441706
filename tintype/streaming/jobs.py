"""Streaming forms of task state and catalogue intake."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tintype.functions.scalars import license_ok
from tintype.operators.grams import grams
from tintype.operators.intake import dedupe_first
from tintype.operators.tasks import recent_tasks, search_history
from tintype.streaming.runs import Runs

#: States that a task doesn't leave by itself.
FINISHED = ("completed", "error")


def task_state_stream(events: DataFrame, columns: list[str], retain: str | None = None) -> DataFrame:
    """The newest state of each task, in update mode: an older event never replaces a newer one.

    State is one row a task. With ``retain`` (a watermark delay on ts) late events are dropped.
    """
    source = events.withWatermark("ts", retain) if retain else events
    newest = source.groupBy("task_id").agg(F.max(F.struct("ts", "event_id", *columns)).alias("x"))
    return newest.select("task_id", "x.ts", "x.event_id", *[f"x.{c}" for c in columns])


def _newest(columns: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Of each task the newest row; a deletion hides the state that it deletes."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = F.max(F.struct("ts", "event_id", "deleted", *columns)).alias("x")
        return rows.groupBy("task_id").agg(newest).select("task_id", "x.*")

    return merge


def task_states(spark: SparkSession, path: str, columns: list[str], **sizes: int) -> Runs:
    """The table of task states: a row a task with ts, event_id, deleted and the columns, in runs by a hash of the task."""
    return Runs(spark, path, "task_id", _newest(columns), F.col("deleted"), **sizes)


def task_state_table(events: DataFrame, columns: list[str], path: str, checkpoint: str, keep: str | None = None, late: str = "1 hour", **sizes: int) -> StreamingQuery:
    """Puts changed states of each micro-batch into the table at ``path``.

    The runs of batches are merged as they gather, so a reader opens a number of files that grows
    with the logarithm of the batches; a batch that is replayed changes nothing. With ``keep`` (an
    interval) finished tasks are deleted so long after their last event, by timers of their state.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch if keep else batch.withColumn("deleted", F.lit(False))
        task_states(batch.sparkSession, path, columns, **sizes).add(rows, number)

    changed = retained_states(events, columns, keep, late) if keep else task_state_stream(events, columns)
    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_task_states(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The newest state of each task that isn't deleted, over all batches so far."""
    rows = task_states(spark, path, columns).read()
    if rows is None:
        raise ValueError(f"no batch has been written to {path}")
    return rows.drop("deleted")


def retained_states(events: DataFrame, columns: list[str], keep: str, late: str = "1 hour") -> DataFrame:
    """Changed states with the column ``deleted``: true once, ``keep`` after the last event of a finished task.

    ``events`` have ts as a timestamp and a status among ``columns``. The state is a row a task and
    goes with the task; events that are later than ``late`` are dropped.
    """
    seconds = events.sparkSession.sql(f"select cast(interval {keep} as interval day to second) as i").first()["i"].total_seconds()
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    fields = ["ts", "event_id", *columns]
    state_schema = "at bigint, " + ", ".join(f"`{c}` {kinds[c]}" for c in fields)
    schema = f"task_id {kinds['task_id']}, " + ", ".join(f"`{c}` {kinds[c]}" for c in fields) + ", deleted boolean"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(values: tuple, deleted: bool) -> pd.DataFrame:
            return pd.DataFrame([(*key, *values[1:], deleted)], columns=["task_id", *fields, "deleted"])

        if state.hasTimedOut:
            gone = state.get
            state.remove()
            yield row(gone, True)
            return
        held = state.get if state.exists else None
        best = held
        for rows in batches:
            for values in rows[["at", *fields]].itertuples(index=False, name=None):
                if best is None or (values[0], values[2]) > (best[0], best[2]):
                    best = values
        if best is not held:
            state.update(best)
            yield row(best, False)
        if best[1 + fields.index("status")] in FINISHED:
            state.setTimeoutTimestamp(max(best[0] // 1000 + int(seconds * 1000), state.getCurrentWatermarkMs() + 1))

    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("task_id").applyInPandasWithState(step, schema, state_schema, "update", GroupStateTimeout.EventTimeTimeout)


def newest_tasks(events: DataFrame, columns: list[str], path: str, checkpoint: str, n: int = 100) -> StreamingQuery:
    """Keeps the ``n`` tasks with the newest events, and writes which ones each micro-batch put out or didn't keep.

    A task that isn't kept comes back with its next event, and a kept one only gets newer, so the
    newest of all are always among those kept and those in the batch: what is read and held is
    bounded. A replayed batch starts from what was kept before it and gives the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _kept(spark, path, number)
        new = batch.groupBy("task_id").agg(F.max(F.struct("ts", "event_id", *columns)).alias("x")).select("task_id", "x.*")
        both = new.unionByName(before) if before is not None else new
        newest = both.groupBy("task_id").agg(F.max(F.struct("ts", "event_id", *columns)).alias("x")).select("task_id", "x.*")
        recent_tasks(newest, n).write.mode("overwrite").parquet(f"{path}/kept={number}")
        now = spark.read.parquet(f"{path}/kept={number}")
        newest.join(now, "task_id", "left_anti").select("task_id", "event_id").write.mode("overwrite").parquet(f"{path}/dropped={number}")
        _forget(spark, path, number)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return sorted(int(x.split("=")[1]) for x in names if x.startswith("kept=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}/_SUCCESS")))


def _kept(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """What was kept before a batch; the newest without one."""
    known = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/kept={known[-1]}") if known else None


def _forget(spark: SparkSession, path: str, number: int) -> None:
    """Deletes what was kept two batches ago and earlier; the last batch may be replayed from the one before."""
    for old in [v for v in _versions(spark, path) if v < number][:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kept={old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_newest_tasks(spark: SparkSession, path: str) -> DataFrame:
    rows = _kept(spark, path)
    if rows is None:
        raise ValueError(f"no batch has been written to {path}")
    return rows


def event_windows(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, status, n): events by tumbling window and status, under a watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "status").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def known_keys(spark: SparkSession, path: str, **sizes: int) -> Runs:
    """Ids and contents that were taken in, as (key, batch): ``i`` or ``c`` and the value, and the first batch that had it."""
    return Runs(spark, path, "key", lambda rows: rows.groupBy("key").agg(F.min("batch").alias("batch")), **sizes)


def _keys_of(rows: DataFrame) -> DataFrame:
    both = F.array(F.concat(F.lit("i"), F.col("id")), F.concat(F.lit("c"), F.col("sha256")))
    return rows.select(F.explode(both).alias("key")).where("key is not null").distinct()


def intake_stream(spark: SparkSession, source: str, schema: StructType, accepted: str, checkpoint: str, format: str = "json", **sizes: int) -> StreamingQuery:
    """Takes in new catalogue files: accepted licences, unknown ids and contents, the first of each content.

    What is known is looked up in a key table beside the accepted rows, of which a batch reads only
    the buckets that its own keys fall into, not the accepted table. A batch is written to its own
    folder, and a replayed one replaces it and doesn't meet itself, so the accepted table is the same
    however often a batch runs.
    """

    def put(batch: DataFrame, number: int) -> None:
        take_in(batch, number, accepted, **sizes)

    stream = spark.readStream.schema(schema).format(format).load(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def take_in(batch: DataFrame, number: int, accepted: str, **sizes: int) -> None:
    """One batch of ``intake_stream``: its new rows go to ``accepted``/batch=number, their keys to ``accepted``_keys."""
    keys = known_keys(batch.sparkSession, f"{accepted}_keys", **sizes)
    rows = batch.where(license_ok(F.col("license"))).persist()
    try:
        asked = _keys_of(rows)
        found = keys.candidates(asked, before=number)
        new = rows
        if found is not None:
            known = asked.join(found.where(F.col("batch") != number), "key", "left_semi").select(F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 2)").alias("value"))
            ids, contents = (known.where(F.col("kind") == k).select(F.col("value").alias(c)) for k, c in (("i", "id"), ("c", "sha256")))
            new = rows.join(ids, "id", "left_anti").join(contents, "sha256", "left_anti").select(*batch.columns)
        first = dedupe_first(new.dropDuplicates(["id"]), "sha256", "id", "id").where("keeper is null").drop("keeper")
        first.write.mode("overwrite").parquet(f"{accepted}/batch={number}")
        own = batch.sparkSession.read.schema(batch.schema).parquet(f"{accepted}/batch={number}")
        keys.add(_keys_of(own).withColumn("batch", F.lit(number)), number)
    finally:
        rows.unpersist()


class HistoryIndex:
    """Task states and the grams of their file names, both in runs, to be searched by fragments of names."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str], **sizes: int):
        self.spark, self.columns = spark, columns
        self.states = task_states(spark, f"{path}/states", columns, **sizes)
        self.postings = Runs(spark, f"{path}/grams", "gram", lambda rows: rows.distinct(), **sizes)

    def add(self, states: DataFrame, number: int) -> None:
        """Adds changed states (task_id, ts, event_id, columns, filename among them, and perhaps deleted)."""
        rows = states if "deleted" in states.columns else states.withColumn("deleted", F.lit(False))
        self.postings.add(rows.select("task_id", F.explode(grams(F.lower("filename"))).alias("gram")), number)
        self.states.add(rows, number)

    def search(self, term: str) -> DataFrame:
        """The states whose file names hold the term, in either case: what ``search_history`` finds in all states.

        Tasks with all grams of the term are candidates and looked up; their names of now decide. A
        term shorter than a gram is looked for in all states.
        """
        asked = self.spark.range(1).select(F.explode(grams(F.lit(term.lower()))).alias("gram"))
        many = asked.count()
        posted = self.postings.lookup(asked) if many else None
        if posted is None:
            states = self.states.read()
            if states is None:
                raise ValueError("the index is empty")
        else:
            tasks = posted.groupBy("task_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == many).select("task_id")
            states = self.states.lookup(tasks)
        return search_history(states.drop("deleted"), term)


class StatusCounts:
    """How many tasks have each status, kept up to date by what changes: a new status adds one, and takes one from the task's old."""

    def __init__(self, spark: SparkSession, path: str, **sizes: int):
        self.states = task_states(spark, f"{path}/states", ["status"], **sizes)
        self.counts = Runs(spark, f"{path}/counts", "status", lambda rows: rows.groupBy("status").agg(F.sum("n").alias("n")), **sizes)

    def update(self, changed: DataFrame, number: int) -> None:
        """Takes in a batch of states (task_id, ts, event_id, status), in any order of their times; a batch that comes again changes nothing.

        The states are written last, so that a batch that failed midway finds the old states again.
        """
        if self.states.has(number):
            return
        new = _newest(["status"])(changed.select("task_id", "ts", "event_id", F.lit(False).alias("deleted"), "status")).persist()
        try:
            old = self.states.lookup(new)
            moves = new.select(F.col("status").alias("to"), F.lit(None).cast("string").alias("from"))
            if old is not None:
                before = old.select("task_id", F.struct("ts", "event_id").alias("was"), F.col("status").alias("from"))
                later = F.col("was").isNull() | (F.struct("ts", "event_id") > F.col("was"))
                moves = new.join(before, "task_id", "left").where(later).select(F.col("status").alias("to"), "from")
            steps = F.explode(F.array(F.struct(F.col("to").alias("status"), F.lit(1).cast("long").alias("n")), F.struct(F.col("from").alias("status"), F.lit(-1).cast("long").alias("n"))))
            self.counts.add(moves.select(steps.alias("s")).select("s.*").where("status is not null").groupBy("status").agg(F.sum("n").alias("n")), number)
            self.states.add(new, number)
        finally:
            new.unpersist()

    def read(self) -> DataFrame | None:
        """(status, n) of the statuses that tasks have now."""
        rows = self.counts.read()
        return None if rows is None else rows.where("n > 0")
