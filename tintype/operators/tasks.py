"""Task state from progress events, history listings, and logs of statuses and epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tintype.functions.scalars import rounded
from tintype.operators.audit import with_quantiles
from tintype.operators.intake import previous
from tintype.schemas import STATUS_ORDER


def latest_per_task(events: DataFrame, columns: list[str], task: str = "task_id") -> DataFrame:
    """The newest state of each task by (ts, event_id): an aggregate, so a task's events never meet in one list."""
    newest = F.max(F.struct("ts", "event_id", *columns)).alias("x")
    return events.groupBy(task).agg(newest).select(task, "x.ts", "x.event_id", *[f"x.{c}" for c in columns])


def active_tasks(states: DataFrame) -> DataFrame:
    """(active): tasks that are detecting or processing; pending ones aren't active."""
    return states.agg(F.count_if(F.col("status").isin("detecting", "processing")).alias("active"))


def can_restart(states: DataFrame) -> DataFrame:
    return states.select("task_id", (~F.col("status").isin("detecting", "processing")).alias("can_restart"))


def search_history(df: DataFrame, query: str) -> DataFrame:
    return df.where(F.contains(F.lower("filename"), F.lit(query.lower())))


def history_view(df: DataFrame) -> DataFrame:
    """Listing rows: result link, mode and status with their defaults."""
    return df.select("task_id", "filename", F.coalesce("restored_url", "result_url").alias("result"), F.coalesce("mode", F.lit("quick")).alias("mode"), F.coalesce("status", F.lit("idle")).alias("status"))


def recover_history(df: DataFrame, all_tasks: bool = False) -> DataFrame:
    """Tasks after a restart: unfinished ones (or all) are idle again, with progress 0."""
    reset = F.lit(True) if all_tasks else ~F.coalesce(F.col("status").isin("completed", "error"), F.lit(False))
    return df.withColumns({"recovered": F.when(reset, "idle").otherwise(F.col("status")), "progress": F.when(reset, 0).otherwise(100)})


def delete_task(df: DataFrame, task_id: str) -> DataFrame:
    return df.where(~F.col("task_id").eqNullSafe(task_id))


def recent_tasks(df: DataFrame, n: int = 50) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def merge_history(live: DataFrame, stored: DataFrame, prefer_live: bool = False, key: str = "task_id") -> DataFrame:
    """Stored and live tasks, one row an id: the stored row hides the live one in a listing, the live one wins in a lookup."""
    a, b = (live, stored) if prefer_live else (stored, live)
    return a.unionByName(b.join(a.select(key), key, "left_anti").select(*a.columns))


def task_durations(events: DataFrame) -> DataFrame:
    """(mode, tasks, error_rate, median_seconds): by the mode of a task's first event; seconds from first to last event of completed tasks."""
    per = events.groupBy("task_id").agg(
        F.min(F.struct("ts", "event_id", "mode")).alias("first"), F.max(F.struct("ts", "event_id", "status")).alias("last")
    )
    seconds = F.when(F.col("last.status") == "completed", F.unix_micros(F.col("last.ts").cast("timestamp")) / 1e6 - F.unix_micros(F.col("first.ts").cast("timestamp")) / 1e6)
    rows = per.select(F.col("first.mode").alias("mode"), (F.col("last.status") == "error").cast("double").alias("failed"), seconds.alias("seconds"))
    by_mode = rows.groupBy("mode").agg(F.count("*").alias("tasks"), rounded(F.avg("failed")).alias("error_rate"))
    return with_quantiles(by_mode, rows, "seconds", [0.5], ["mode"]).select("mode", "tasks", "error_rate", rounded(F.col("p")[0]).alias("median_seconds"))


def check_transitions(log: DataFrame) -> DataFrame:
    """(source_id, event_id, from_status, to_status) of changes that are neither the next step nor a return to the one before."""
    place = lambda status: F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), status)
    rows = previous(log, "source_id", ["ts", "event_id"], "status", "from_status")
    rows = rows.withColumns({"_p": place(F.col("status")), "_b": place(F.col("from_status"))})
    step = F.col("_p") - F.coalesce("_b", F.lit(0))
    allowed = (step == 0) | (step == 1) | (F.col("_b").isNotNull() & (step == -1))
    return rows.where(~allowed).select("source_id", "event_id", F.coalesce("from_status", F.lit("")).alias("from_status"), F.col("status").alias("to_status"))


def early_stop(log: DataFrame, patience: int, epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Adds best, best_epoch, since and stopped to an epoch log; a strictly larger metric is an improvement.

    A log has a row an evaluation of one training, so one ordered window over it is small.
    """
    over = W.partitionBy(F.lit(0)).orderBy(epoch)
    upto = over.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.max(metric).over(over.rowsBetween(W.unboundedPreceding, -1))
    rows = log.withColumn("_up", before.isNull() | (F.col(metric) > before)).withColumn("_i", F.row_number().over(over))
    rows = rows.withColumns({"best": F.max(metric).over(upto), "best_epoch": F.last(F.when(F.col("_up"), F.col(epoch)), True).over(upto), "_last": F.last(F.when(F.col("_up"), F.col("_i")), True).over(upto)})
    rows = rows.withColumn("since", F.col("_i") - F.col("_last"))
    first = F.min(F.when(F.col("since") >= patience, F.col("_i"))).over(W.partitionBy(F.lit(0)))
    return rows.withColumn("stopped", F.coalesce(F.col("_i") >= first, F.lit(False))).select(*log.columns, "best", "best_epoch", "since", "stopped")


def epoch_loss(steps: DataFrame, ok: str) -> DataFrame:
    """(epoch, loss, steps) over successful steps; an epoch with none has null loss and 0 steps."""
    return steps.groupBy("epoch").agg(rounded(F.avg(F.when(F.col(ok), F.col("value"))), 6).alias("loss"), F.count_if(F.col(ok)).alias("steps"))


def rater_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("dim").agg(F.count("*").alias("n"), rounded(F.avg("score")).alias("mean"), rounded(F.stddev_samp("score")).alias("std"))


def checkpoint_drift(weights: DataFrame) -> DataFrame:
    """(ckpt, mean_change, max_change, mean, std, lo, hi): changes of each value from the checkpoint before, and its own statistics."""
    over = W.partitionBy("idx").orderBy("ckpt")
    rows = weights.withColumn("d", F.abs(F.col("val") - F.lag("val").over(over)))
    return rows.groupBy("ckpt").agg(
        rounded(F.avg("d"), 6).alias("mean_change"), rounded(F.max("d"), 6).alias("max_change"), rounded(F.avg("val"), 6).alias("mean"), rounded(F.stddev_pop("val"), 6).alias("std"), rounded(F.min("val"), 6).alias("lo"), rounded(F.max("val"), 6).alias("hi")
    )


def metric_deltas(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Adds <metric>_change = after − before."""
    return df.withColumns({f"{m}_change": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})


def improvement_report(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, before, after, change, rate): means, and the percentage of rows with a change above 0."""
    rows = metric_deltas(df, metrics)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_before").alias("b"), F.col(f"{m}_after").alias("a"), F.col(f"{m}_change").alias("c")) for m in metrics])).alias("x")).select("x.*")
    return long.groupBy("metric").agg(rounded(F.avg("b")).alias("before"), rounded(F.avg("a")).alias("after"), rounded(F.avg("c")).alias("change"), rounded(F.avg((F.col("c") > 0).cast("double")) * 100).alias("rate"))


def sweep_scores(df: DataFrame, config: list[str], metric: str) -> DataFrame:
    """Mean metric of each configuration; configurations without a score vanish."""
    return df.where(F.col(metric).isNotNull()).groupBy(*config).agg(rounded(F.avg(metric), 6).alias("score"), F.count("*").alias("n"))


def leaderboard(scores: DataFrame, *config: str) -> DataFrame:
    """Adds place. ``scores`` has a row a configuration of a sweep, so one ordered window over it is small."""
    return scores.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), *config)))


def best_config(scores: DataFrame, family: str, config: str) -> DataFrame:
    """(family, config, score, gain): the best of each family, and its lead over the best of all."""
    best = scores.groupBy(family).agg(F.max(F.struct("score", (-F.col(config)).alias("neg"))).alias("b"))
    top = scores.agg(F.max("score").alias("top"))
    return best.crossJoin(F.broadcast(top)).select(family, (-F.col("b.neg")).alias(config), F.col("b.score").alias("score"), rounded(F.col("b.score") - F.col("top"), 6).alias("gain"))
