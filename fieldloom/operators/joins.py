"""Joins on keys, with the reports that go with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import missing, refuse_rows, require, require_columns, require_new, stable_id
from ..functions.text import normalize_id, number_key


def join_key(df: DataFrame, name: str, normalize: str) -> Column:
    require_columns(df, name)
    require(normalize in ("none", "id"), "normalize must be none or id")
    if normalize == "none":
        return F.col(name).cast("string")
    floating = df.schema[name].dataType.typeName() in ("float", "double")
    return number_key(F.col(name)) if floating else normalize_id(F.col(name))


def keyed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalize: str = "none", how: str = "left") -> DataFrame:
    """Equi-join on normalised keys; null keys never match; clashing right fields get the suffix _right."""
    require(how in ("left", "inner", "right"), "how must be inner, left or right")
    clash = {c: f"{c}_right" for c in right.columns if c in left.columns}
    require_new(left, *clash.values())
    r = right.select(*(F.col(c).alias(clash.get(c, c)) for c in right.columns), join_key(right, right_key, normalize).alias("_rk"))
    joined = left.withColumn("_lk", join_key(left, left_key, normalize)).join(r, F.col("_lk") == F.col("_rk"), how)
    return joined.drop("_lk", "_rk")


@dataclass
class KeyReport:
    """unmatched: side, key as written; duplicates: side, key, rows; collisions: side, key, spellings; without_key: side, rows."""

    unmatched: DataFrame
    duplicates: DataFrame
    collisions: DataFrame
    without_key: DataFrame
    normalised: DataFrame


def key_report(left: DataFrame, right: DataFrame, left_key: str, right_key: str, normalize: str = "none") -> KeyReport:
    sides = [df.select(F.lit(s).alias("side"), F.col(c).cast("string").alias("written"), join_key(df, c, normalize).alias("key")) for s, df, c in (("left", left, left_key), ("right", right, right_key))]
    both = sides[0].unionByName(sides[1])
    groups = both.where("key is not null").groupBy("side", "key", "written").agg(F.count("*").alias("n"))
    keys = groups.groupBy("side", "key").agg(F.sum("n").alias("rows"), F.count("*").alias("spellings"))
    other = F.when(F.col("side") == "left", "right").otherwise("left")
    lonely = keys.join(keys.select(other.alias("side"), "key"), ["side", "key"], "left_anti")
    return KeyReport(
        groups.join(lonely.select("side", "key"), ["side", "key"], "left_semi").select("side", "written"),
        keys.where("rows > 1").select("side", "key", "rows"),
        groups.join(keys.where("spellings > 1").select("side", "key"), ["side", "key"], "left_semi").groupBy("side", "key").agg(F.array_sort(F.collect_list("written")).alias("written")),
        both.groupBy("side").agg(F.count(F.when(F.col("key").isNull(), 1)).alias("rows")),
        groups.where("written <> key").select("side", "written", "key"),
    )


def attribute_join(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, fields: list[str] | None = None, prefix: str = "joined_", cardinality: str = "many_to_one") -> DataFrame:
    """Left outer join with prefixed right fields; null keys are refused, repeated right keys unless one_to_many."""
    right_key = right_key or key
    refuse_rows(left, **{"empty key left": missing(key)})
    refuse_rows(right, **{"empty key right": missing(right_key)})
    require(cardinality in ("many_to_one", "one_to_many"), "unknown cardinality")
    if cardinality == "many_to_one":
        stable_id(right, right_key)
    fields = fields or [c for c in right.columns if c != right_key]
    require_new(left, *(prefix + f for f in fields))
    r = right.select(F.col(right_key).cast("string").alias("_rk"), *(F.col(f).alias(prefix + f) for f in fields))
    return left.join(r, F.col(key).cast("string") == F.col("_rk"), "left").drop("_rk")


def unmatched(left: DataFrame, right: DataFrame, key: str, right_key: str) -> DataFrame:
    return left.join(right.select(F.col(right_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")


def semantic_check(before: DataFrame, after: DataFrame, key: str, fields: list[str], unknown: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """id, field, issue: protected values that a later table changed or lost. Null, blank and unknown words are one state."""
    def state(c: Column) -> Column:
        t = F.trim(c.cast("string"))
        return F.when(t.isNull() | (t == "") | F.lower(t).isin(*unknown), F.lit("\x00unknown")).otherwise(t)

    a = before.select(F.col(key).cast("string").alias("id"), *(state(F.col(f)).alias(f"a_{f}") for f in fields))
    b = after.select(F.col(key).cast("string").alias("id"), F.lit(True).alias("_there"), *(state(F.col(f)).alias(f"b_{f}") for f in fields))
    j = a.join(b, "id", "left")
    issue = lambda f: F.when(F.col("_there").isNull(), "missing_downstream").when(F.col(f"a_{f}") != F.col(f"b_{f}"), "changed")
    rows = j.select("id", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), issue(f).alias("issue")) for f in fields))))
    return rows.where("issue is not null")
