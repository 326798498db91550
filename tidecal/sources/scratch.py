"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (one machine) gets a temporary folder and a cluster the warehouse if that lies in a
    shared file system; a cluster without either is an error, as each machine would see files of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if "://" not in shared or shared.startswith("file:"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        return shared
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tidecal-")
    return _own_dirs[app]


def run_dir(spark: SparkSession) -> str:
    """This application's folder inside the shared one; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/tidecal-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, **options: str) -> DataFrame:
    """Write a table to the run's folder and read it back: computed once, lineage cut, safe when executors go.

    options are those of Spark's Parquet writer.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidecal_path = path
    return out


#: Jobs that run beside each other: small ones leave most cores idle.
BESIDE = 4


def together(spark: SparkSession, makers: Iterable[Callable]) -> list:
    """What each maker returns, in their order; their Spark jobs run beside each other, from as many threads as BESIDE."""
    tasks = [inheritable_thread_target(spark)(make) for make in makers]
    if len(tasks) < 2:
        return [task() for task in tasks]
    with ThreadPool(min(BESIDE, len(tasks))) as pool:
        return pool.map(lambda task: task(), tasks, 1)


def drop_table(df: DataFrame) -> None:
    """Remove a table made by materialise() that nothing reads any more."""
    path = getattr(df, "_tidecal_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
