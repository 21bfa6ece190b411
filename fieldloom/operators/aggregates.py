"""Summaries of feature tables."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..contracts import finite, missing, refuse_rows, require
from .table import numeric_columns


def summarize(df: DataFrame, group: str, value: str) -> DataFrame:
    """count and sum of a total by group; an empty group or a value that isn't finite refuses the whole."""
    refuse_rows(df, **{"empty group": missing(group), "value not finite": finite(value).isNull()})
    return df.groupBy(group).agg(F.count("*").alias("count"), F.sum(finite(value)).alias("total"))


def weighted_ratio(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """sum(v w) / sum(w) by group, null with status zero_weight where the weights sum to nothing."""
    v, w = finite(value), finite(weight)
    refuse_rows(df, **{"empty group": missing(group), "weight not finite or negative": w.isNull() | (w < 0), "value not finite": v.isNull()})
    total = F.sum(w)
    return df.groupBy(group).agg(total.alias("weight_sum"), (F.sum(v * w) / F.nullif(total, F.lit(0.0))).alias("ratio"), F.when(total == 0, "zero_weight").otherwise("ok").alias("status"))


def weighted_category(df: DataFrame, group: str, category: str, weight: str) -> DataFrame:
    """weight_sum, count and the share of the group's weight, by group and category."""
    w = finite(weight)
    refuse_rows(df, **{"empty group": missing(group), "weight not finite or negative": w.isNull() | (w < 0)})
    parts = df.groupBy(group, category).agg(F.sum(w).alias("weight_sum"), F.count("*").alias("count"))
    total = F.sum("weight_sum").over(Window.partitionBy(group))
    return parts.withColumn("fraction", F.col("weight_sum") / F.nullif(total, F.lit(0.0)))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """field, count, mean, std (sample), min, q25, q50, q75, max of the numeric fields, in one pass."""
    columns = columns or numeric_columns(df)
    quarters = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    rows = []
    for c in columns:
        v = F.col(c).cast("double")
        q = quarters(v)
        rows.append(F.struct(F.lit(c).alias("field"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(v).alias("max")))
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def distribution(df: DataFrame, value: str) -> DataFrame:
    """count, missing, mean, std (population), min, q25, median, q75, max; infinities are refused."""
    raw = F.col(value).cast("double")
    refuse_rows(df, **{"infinite value": F.abs(raw) == float("inf")})
    v = F.when(~F.isnan(raw), raw)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(F.count(v).alias("count"), (F.count("*") - F.count(v)).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(v).alias("max"))


def frequency(df: DataFrame, field: str) -> DataFrame:
    """value, count, pct of the non-null values; pct to two places, halves to even."""
    counts = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total), how="left").select("value", "count", F.bround(100.0 * F.col("count") / F.col("total"), 2).alias("pct"))


def values(df: DataFrame, field: str, top: int | None = None) -> DataFrame:
    """value, count with null as a value; the most frequent `top`, ties by value."""
    counts = df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count"))
    return counts if top is None else counts.orderBy(F.desc("count"), F.asc_nulls_last("value")).limit(top)


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """field, missing, unique, duplicate_nonnull_rows (all rows of values that occur twice or more)."""
    columns = columns or df.columns
    long = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))))
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    present = F.col("value").isNotNull()
    return counts.groupBy("field").agg(
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("unique"),
        F.coalesce(F.sum(F.when(present & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_nonnull_rows"),
    )


def dissolve(df: DataFrame, by: list[str], order: list[str], first: list[str] = (), sums: list[str] = (), block: Column | None = None) -> DataFrame:
    """One row a group (null is a group): `first` as in the group's first row, null included; `sums` null if all are.

    With block, partial results by block, as a chunked run gives them.
    """
    keys = [F.col(b) for b in by] + ([block.alias("block")] if block is not None else [])
    least = F.min(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in first))) if first else None
    out = df.groupBy(*keys).agg(*([least.alias("_first")] if first else []), *(F.sum(c).alias(f"sum_{c}") for c in sums), F.count("*").alias("n"))
    return out.select(*by, *(["block"] if block is not None else []), *(F.col("_first")[f"_{c}"].alias(f"first_{c}") for c in first), *(f"sum_{c}" for c in sums), "n")


def breaks(df: DataFrame, value: str, method: str, classes: int | None = None, manual: list[float] | None = None) -> list[float]:
    """Class breaks: given, by linear quantiles or by equal intervals; breaks that collapse are refused."""
    v = finite(value)
    if method == "manual":
        require(bool(manual), "breaks must be finite numbers")
        found = [float(b) for b in manual]
    else:
        require(isinstance(classes, int) and 2 <= classes <= 64, "classes must be an integer from 2 to 64")
        if method == "quantile":
            shares = F.array(*(F.lit(k / classes) for k in range(1, classes)))
            found = df.agg(F.percentile(v, shares)).first()[0]
            require(found is not None, "quantile needs at least one valid value")
        else:
            require(method == "equal_interval", "unknown method")
            lo, hi = df.agg(F.min(v), F.max(v)).first()
            require(lo is not None and lo < hi, "equal_interval needs more than one distinct value")
            found = [lo + (hi - lo) * k / classes for k in range(1, classes)]
    require(all(a < b for a, b in zip(found, found[1:])), "breaks must be strictly increasing")
    return found


def class_index(value: Column, at: list[float]) -> Column:
    """Number of breaks that don't exceed the value: lower bounds inside, upper outside."""
    return F.size(F.filter(F.array(*(F.lit(float(b)) for b in at)), lambda b: b <= value))


def scheme_counts(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """class_id, lo, hi, cnt for every class, empty ones included; missing values are counted nowhere."""
    edges = [None, *at, None]
    classes = F.array(*(F.struct(F.lit(k).alias("class_id"), F.lit(edges[k]).cast("double").alias("lo"), F.lit(edges[k + 1]).cast("double").alias("hi")) for k in range(len(at) + 1)))
    table = df.sparkSession.range(1).select(F.inline(classes))
    v = finite(value)
    counts = df.where(v.isNotNull()).groupBy(class_index(v, at).alias("class_id")).agg(F.count("*").alias("n"))
    return table.join(F.broadcast(counts), "class_id", "left").select("class_id", "lo", "hi", F.coalesce("n", F.lit(0)).alias("cnt"))


def category_counts(df: DataFrame, value: str, categories: list | None = None, allow_unlisted: bool = False) -> DataFrame:
    """class_id, code, cnt; without a list the sorted distinct values are the categories."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("code")).agg(F.count("*").alias("cnt"))
    if categories is None:
        listed = [r["code"] for r in counts.select("code").orderBy("code").limit(4097).collect()]
        require(len(listed) <= 4096, "more than 4096 categories")
    else:
        require(len(set(map(repr, categories))) == len(categories), "category codes must be unique")
        listed = categories
    table = df.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(k).alias("class_id"), F.lit(c).alias("code")) for k, c in enumerate(listed)))))
    if not allow_unlisted:
        require(counts.join(F.broadcast(table), "code", "left_anti").isEmpty(), "values without a listed category")
    return table.join(counts, "code", "left").select("class_id", "code", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def layer_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """features and bounds."""
    return df.agg(F.count("*").alias("features"), F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def top_categories(df: DataFrame, category: str, value: str, top: int, other: str = "other") -> DataFrame:
    """Group sums, the largest `top` by name and the rest as one."""
    sums = df.groupBy(F.col(category).cast("string").alias("category")).agg(F.sum(value).alias("total"))
    first = sums.orderBy(F.desc("total"), "category").limit(top).select(F.col("category").alias("named"))
    label = F.when(F.col("named").isNotNull(), F.col("category")).otherwise(other)
    return sums.join(F.broadcast(first), F.col("category") == F.col("named"), "left").groupBy(label.alias("category")).agg(F.sum("total").alias("total"))


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, cnt of equal-width bins between minimum and maximum, the last closed; empty bins are absent."""
    v = finite(value)
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    require(lo is not None and lo < hi, "bins need more than one distinct value")
    return df.where(v.isNotNull()).groupBy(F.least(F.lit(bins - 1), F.floor((v - lo) / ((hi - lo) / bins))).cast("int").alias("bin")).agg(F.count("*").alias("cnt"))


def _to_float(exponents: list[int], sums: list[Decimal]) -> float:
    total = sum((Fraction(int(m)) * Fraction(2) ** e for e, m in zip(exponents, sums, strict=True)), Fraction(0))
    try:
        return float(total)
    except OverflowError:  # beyond the largest double
        return float("inf") if total > 0 else float("-inf")


@F.pandas_udf(DoubleType())
def _rounded_once(terms: pd.Series) -> pd.Series:
    return terms.map(lambda own: None if own is None or not len(own) else _to_float([t["e"] for t in own], [t["m"] for t in own]))


def exact_sum(df: DataFrame, by: list[str], value: str, name: str = "total") -> DataFrame:
    """by, name: the sum of finite doubles, rounded once, whatever their order; null if a group has none.

    A double is a whole number times a power of two; the whole numbers are summed by power, of which there are about two
    thousand, and only these sums of a group are added as fractions.
    """
    v = F.col(value).cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    power = F.greatest(F.floor(F.log2(F.abs(v))) - 54, F.lit(-1074)).cast("int")
    half = F.floor(power / 2).cast("int")
    whole = (v * F.pow(F.lit(2.0), (-half).cast("double")) * F.pow(F.lit(2.0), (half - power).cast("double"))).cast("decimal(20,0)")
    terms = df.where(usable & (v != 0)).select(*by, power.alias("e"), whole.alias("m")).groupBy(*by, "e").agg(F.sum("m").alias("m"))
    sums = terms.groupBy(*by).agg(F.collect_list(F.struct("e", "m")).alias("terms")).select(*by, _rounded_once("terms").alias("_sum"))
    groups = df.groupBy(*by).agg(F.count(F.when(usable, 1)).alias("_n"))
    if not by:
        return groups.join(sums, how="left").select(F.when(F.col("_n") > 0, F.coalesce("_sum", F.lit(0.0))).alias(name))
    same = [groups[b].eqNullSafe(sums[b]) for b in by]
    joined = groups.join(sums, same, "left")
    return joined.select(*(groups[b] for b in by), F.when(F.col("_n") > 0, F.coalesce("_sum", F.lit(0.0))).alias(name))
