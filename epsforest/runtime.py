"""Session helpers shared by the operators: materialised cuts of lineage in a shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session in local mode (tests) may lack that setting; it gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        folder = tempfile.TemporaryDirectory(prefix="epsforest-")
        atexit.register(folder.cleanup)
        _LOCAL[app] = "file://" + folder.name
    return _LOCAL[app]


def _cuts(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/epsforest-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut", by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there and survives lost executors.

    by: columns by which the table is laid out, so that a filter on them reads its part only; they come last.
    """
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, name: str, column: str, n: int) -> list[DataFrame]:
    """``cut`` to tables of their own, without ``column``, for its values 0 to n - 1: each can be discarded alone."""
    spark = df.sparkSession
    path = f"{_cuts(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [spark.read.schema(schema).parquet(x) if fs.exists(of(x)) else spark.createDataFrame([], schema) for x in (f"{path}/{column}={k}" for k in range(n))]


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def brief_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of the queries inside are deleted as each query ends; only for queries whose plans do not run again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """What queries inside send to Python goes in batches of about 4 MB (a larger row alone): else a task holds thousands of whole texts outside the heap."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def discard(table: DataFrame) -> None:
    """Deletes a table that ``cut`` has written, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {path(f).getParent().toString() for f in table.inputFiles()}:
        path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(folder), True)


def clear(spark: SparkSession) -> bool:
    """Deletes all that this application has cut, for whoever owns a finished run: results that read it must be written before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_cuts(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
