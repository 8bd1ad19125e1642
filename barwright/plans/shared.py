"""Where intermediate tables live, and how they are written.

Executors can be lost at any time, so lineage is cut by writing a table to the folder that the
cluster names in ``spark.checkpoint.dir`` and reading it back. Only where that setting is absent and
Spark runs on one machine (tests, a laptop) is a temporary folder used. ``clear`` deletes what a session has written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the tables that ``stage`` has written in this process; results that read them are of no use after it."""
    jvm = spark._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            named = tempfile.mkdtemp(prefix="barwright-")
            spark.sparkContext.setCheckpointDir(named)
            named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, which ``clear`` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
