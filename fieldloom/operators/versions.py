"""Two states of a keyed table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require, require_columns, stable_id


@dataclass
class Update:
    table: DataFrame
    changes: DataFrame
    unmatched_left: DataFrame


def update(left: DataFrame, right: DataFrame, key: str, fields: list[str], append: bool = False) -> Update:
    """left with the fields of equal ids overwritten (null overwrites too), new rows appended if asked for.

    changes: id, field, before, after, adopted; a new row is one change with field null, adopted or not.
    """
    stable_id(left, key)
    stable_id(right, key)
    require_columns(left, *fields)
    require_columns(right, *fields)
    require(key not in fields, "the id can't be updated")
    r = right.select(F.col(key).alias("_rid"), *(F.col(f).alias(f"_r_{f}") for f in fields))
    both = left.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), F.col(key).cast("string") == F.col("_rid").cast("string"), "full_outer")
    hit, new = F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.col("_l").isNull()
    kept = both if append else both.where("_l is not null")
    table = kept.select(*(
        (F.coalesce(F.col(key), F.col("_rid")) if c == key else F.when(F.col("_r").isNotNull(), F.col(f"_r_{c}")).otherwise(F.col(c)) if c in fields else F.col(c)).alias(c) for c in left.columns
    ))
    text = lambda c: F.col(c).cast("string")
    cells = [F.when(hit & ~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.struct(F.lit(f).alias("field"), text(f).alias("before"), text(f"_r_{f}").alias("after"), F.lit(True).alias("adopted"))) for f in fields]
    null = F.lit(None).cast("string")
    cells.append(F.when(new, F.struct(null.alias("field"), null.alias("before"), null.alias("after"), F.lit(append).alias("adopted"))))
    changes = both.select(F.coalesce(F.col(key), F.col("_rid")).cast("string").alias("id"), F.inline(F.array_compact(F.array(*cells))))
    return Update(table, changes, both.where("_r is null").select(key))


def compare(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """id, change (added, removed, modified, unchanged), changed (the fields whose values differ)."""
    stable_id(left, key)
    stable_id(right, key)
    a = left.select(F.col(key).cast("string").alias("id"), F.lit(True).alias("_l"), *(F.col(f).alias(f"a_{f}") for f in fields))
    b = right.select(F.col(key).cast("string").alias("id"), F.lit(True).alias("_r"), *(F.col(f).alias(f"b_{f}") for f in fields))
    both = a.join(b, "id", "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields)))
    inside = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(F.size(differ) > 0, "modified").otherwise("unchanged")
    return both.select("id", change.alias("change"), F.when(inside, differ).otherwise(F.array().cast("array<string>")).alias("changed"))


def transitions(left: DataFrame, right: DataFrame, key: str, category: str) -> DataFrame:
    """before, after, cnt of the category over ids in either state; null is a category."""
    a = left.select(F.col(key).alias("id"), F.col(category).cast("string").alias("before"))
    b = right.select(F.col(key).alias("id"), F.col(category).cast("string").alias("after"))
    return a.join(b, "id", "inner").groupBy("before", "after").agg(F.count("*").alias("cnt"))


def proposals(overlaps: DataFrame) -> DataFrame:
    """before_id, after_id, kind of positive-area overlaps between versions: match, split, merge or complex."""
    n_after = F.count("*").over(Window.partitionBy("before_id"))
    n_before = F.count("*").over(Window.partitionBy("after_id"))
    kind = F.when((F.col("na") == 1) & (F.col("nb") == 1), "match").when(F.col("nb") == 1, "split").when(F.col("na") == 1, "merge").otherwise("complex")
    return overlaps.withColumn("na", n_after).withColumn("nb", n_before).withColumn("kind", kind).drop("na", "nb")
