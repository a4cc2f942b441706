"""A table of keyed rows that grows by batches and is read by key: runs of batches that are merged as they gather.

Each batch is a run. Once there are ``fan`` runs of a level, they are merged into one of the next
level, so that after n batches there are at most ``fan`` times log(n) runs, and every row is written
log(n) times. A run lies in buckets of about ``bucket_rows`` rows by a hash of the key; whoever asks
for keys reads only their buckets. A run is in force once its job has committed (``_SUCCESS``), and
one that holds another's batches replaces it, so a run that is written half, or again, does no harm.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs have a power of two of buckets, up to this.
MOST_BUCKETS = 4096


class Run(NamedTuple):
    first: int
    last: int
    level: int
    buckets: int

    @property
    def folder(self) -> str:
        return f"run-{self.first:012d}-{self.last:012d}-{self.level}-{self.buckets}"


class Runs:
    """Keyed rows under ``path``. ``merge`` makes of rows those that count (one a key, say); it has to give the same in whatever order it is applied to parts.

    Rows for which ``gone`` is true (deletions) are dropped when nothing older is left that they hide.
    One writer at a time; readers need none to wait.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, merge: Callable[[DataFrame], DataFrame], gone: Column | None = None, fan: int = 8, bucket_rows: int = 200_000):
        self.spark, self.path, self.key, self.merge, self.gone, self.fan, self.bucket_rows = spark, path.rstrip("/"), key, merge, gone, fan, bucket_rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _committed(self) -> list[Run]:
        root, fs = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [Run(*map(int, n.split("-")[1:])) for n in names if n.startswith("run-") and fs.exists(self._fs(f"{self.path}/{n}/_SUCCESS")[0])]

    def runs(self) -> list[Run]:
        """The runs in force, oldest first: of nested ones the outermost."""
        out: list[Run] = []
        for run in sorted(self._committed(), key=lambda r: (r.first, -r.last, -r.level)):
            if not out or run.first > out[-1].last:
                out.append(run)
        return out

    def _with_rows(self) -> list[Run]:
        """The runs in force that aren't empty; merging may leave nothing but deletions, which go."""
        return [r for r in self.runs() if any(s.getPath().getName().startswith("_bucket=") for s in self._fs(self.path)[1].listStatus(self._fs(f"{self.path}/{r.folder}")[0]))]

    def _read(self, run: Run, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{run.folder}")
        return (rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))).drop("_bucket")

    def _write(self, rows: DataFrame, run: Run) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(run.buckets)).cast("int")
        rows.withColumn("_bucket", bucket).repartition(min(run.buckets, 200), "_bucket").sortWithinPartitions("_bucket", self.key).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{run.folder}")

    def _buckets(self, rows: int) -> int:
        return min(MOST_BUCKETS, 1 << max(0, -(-rows // self.bucket_rows) - 1).bit_length())

    def _drop(self, run: Run) -> None:
        path, fs = self._fs(f"{self.path}/{run.folder}")
        fs.delete(path, True)

    def has(self, number: int) -> bool:
        """Whether a batch is part of the table."""
        return any(r.first <= number <= r.last for r in self.runs())

    def add(self, rows: DataFrame, number: int) -> None:
        """Adds a batch. A batch that is given again replaces itself, and changes nothing once it is part of a merged run."""
        now = self.runs()
        for old in set(self._committed()) - set(now):  # what a run before this one replaced; readers of then are done
            self._drop(old)
        if any(r.first <= number <= r.last and r.level for r in now):
            return
        merged = self.merge(rows).persist()
        try:
            for same in [r for r in now if r.first == r.last == number]:
                self._drop(same)
            if n := merged.count():
                self._write(merged, Run(number, number, 0, self._buckets(n)))
        finally:
            merged.unpersist()
        self._gather()

    def _gather(self) -> None:
        while True:
            now = self.runs()
            full = [level for level in {r.level for r in now} if sum(r.level == level for r in now) >= self.fan]
            if not full:
                return
            some = [r for r in now if r.level == min(full)]
            whole = [r for r in some if r in self._with_rows()]
            if not whole:  # nothing but deletions that went
                for r in some:
                    self._drop(r)
                continue
            rows = self.merge(self._union([self._read(r) for r in whole]))
            if self.gone is not None and some[0] == now[0]:
                rows = rows.where(~F.coalesce(self.gone, F.lit(False)))
            most = sum(self.spark.read.parquet(f"{self.path}/{r.folder}").count() for r in whole)
            self._write(rows, Run(some[0].first, some[-1].last, min(full) + 1, self._buckets(most)))

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame | None:
        """All rows that count; None before the first batch."""
        now = self._with_rows()
        if not now:
            return None
        rows = self.merge(self._union([self._read(r) for r in now]))
        return rows if self.gone is None else rows.where(~F.coalesce(self.gone, F.lit(False)))

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets of MOST_BUCKETS in which the keys are: a bounded list."""
        return [r[0] for r in keys.select(F.pmod(F.xxhash64(self.key), F.lit(MOST_BUCKETS)).cast("int")).distinct().collect()]

    def candidates(self, keys: DataFrame, before: int | None = None) -> DataFrame | None:
        """What lies in the keys' buckets, as it was written (of batches under ``before``, if given): the only rows a look-up reads."""
        now = [r for r in self._with_rows() if before is None or r.first < before]
        wanted = self.buckets_of(keys)
        return self._union([self._read(r, sorted({b % r.buckets for b in wanted})) for r in now]) if now else None

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows that count of the given keys (a column named as the key)."""
        found = self.candidates(keys)
        if found is None:
            return None
        rows = self.merge(found.join(keys.select(self.key).distinct(), self.key, "left_semi"))
        return rows if self.gone is None else rows.where(~F.coalesce(self.gone, F.lit(False)))
