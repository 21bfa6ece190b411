"""What the training-data operators share: tables, Arrow batches, rows as one column, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows in an Arrow batch; texts of a few kilobytes then keep a batch at a few megabytes.
BATCH_ROWS = 500
#: Keys that hold more than the HEAVY-th part of all rows; there can't be more than HEAVY of them.
HEAVY = 1000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Smaller Arrow batches than Spark's default, so that batches of long texts stay small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def as_rows(df: DataFrame) -> DataFrame:
    """df's columns as one struct column `row`, beside which an operator's own columns can have any name."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def heavy_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys with more than a thousandth of all rows, written. counts: one row per key, with its rows n."""
    total = counts.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return written(counts.where(F.col(n) > total / HEAVY).select(*keys), "heavy-keys")


def join_heavy(rows: DataFrame, labels: DataFrame, keys: list[str], heavy: DataFrame, how: str = "left") -> DataFrame:
    """rows joined to labels (narrow, one row per key) on keys without nulls: rows of heavy keys meet their labels, HEAVY
    at most, where they lie; the others are dealt by key, of which none has more than a thousandth of the rows."""
    few = F.broadcast(heavy)
    hot = rows.join(few, keys, "left_semi").join(F.broadcast(labels.join(few, keys, "left_semi")), keys, how)
    return hot.unionByName(rows.join(few, keys, "left_anti").join(labels, keys, how))
