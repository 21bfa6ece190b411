"""Running totals over a whole order, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running_totals(counts: DataFrame, by: list[str], order: list[str], n: str, name: str) -> DataFrame:
    """counts with `name`: the sum of n over the rows of the same `by` before this one in the ascending order.

    Rows are dealt by ranges; each range's sum, one row a range and group, says where the next one begins. Rows of equal
    `by` and `order` are in no order, so that counts should hold each once.
    """
    laid = written(counts.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = laid.groupBy(*by, "_part").agg(F.sum(n).alias(n))
    bases = sums.withColumn("_base", before(Window.partitionBy(*by).orderBy("_part"))).drop(n)
    inside = laid.withColumn("_own", before(Window.partitionBy(*by, "_part").orderBy(*order)))
    same: Column = inside["_part"] == bases["_part"]
    for b in by:
        same &= inside[b].eqNullSafe(bases[b])
    return inside.join(bases, same).select(*(inside[c] for c in counts.columns), (F.col("_base") + F.col("_own")).alias(name))
