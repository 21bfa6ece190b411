"""Intermediate tables in the folder that driver and executors share, removed when the process ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else a folder under the warehouse where that is shared: set in this session, or on one machine.

    Nothing is set. A cluster that names neither is refused, as executors would write where others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and spark.sparkContext.getConf().get("spark.sql.warehouse.dir") is None:
        raise ValueError("no folder is shared by driver and executors: set spark.checkpoint.dir")
    return f"{warehouse.rstrip('/')}/_scratch"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/fieldloom/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and an executor's loss costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written() -> None:
    """Deletes the tables that this process wrote. Results that still read them must have been consumed."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder's owner cleans up
            return


atexit.register(remove_written)
