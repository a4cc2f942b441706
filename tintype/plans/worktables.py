"""Tables that cut lineage: written once to the folder that all executors share, then read again.

A written table survives the loss of the executors that made it, which a cached or locally
checkpointed one doesn't, and it carries exact sizes for the plans that follow.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders made for applications that name none; paths of tables written since the outermost ``scratch_tables`` began.
_own: dict[str, str] = {}
_written: list[list[str]] = []

#: Applications whose workers have the package.
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the session's Python workers, once an application, so that the operators' functions can be read there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="tintype-"), "tintype.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "tintype")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; on one machine, where none is named, a new local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return _own[app]


def write_table(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Writes ``df`` as Parquet under the work folder and returns the table as read from there; ``scratch_tables`` spares it if ``scratch`` is false."""
    spark = df.sparkSession
    path = f"{work_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for held in _written if scratch else ():
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over many tasks, for rows that are few bytes but much work: Spark cuts files into tasks by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside once it is left; what is made of them has to be written elsewhere before that."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            _delete(spark, path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table made by ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    marker = f"{work_folder(spark).rstrip('/').removeprefix('file://')}/tables/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if marker in parent:
            _delete(spark, parent)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the files of a query's shuffles go when it ends, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
