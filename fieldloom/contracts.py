"""Refusals. An operator that can't give a right answer raises ContractError before anything is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """The input or the parameters don't meet an operator's contract."""


def require(condition: bool, message: str) -> None:
    if not condition:
        raise ContractError(message)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    require(not missing, f"missing fields: {', '.join(missing)}")


def require_new(df: DataFrame, *names: str) -> None:
    taken = [n for n in names if n in df.columns]
    require(not taken, f"fields exist already: {', '.join(taken)}")


def refuse_rows(df: DataFrame, **conditions: Column) -> None:
    """Raises if any row meets any of the named conditions; all are counted in one pass with partial sums."""
    counts = df.agg(*(F.count(F.when(c, 1)).alias(n) for n, c in conditions.items())).first()
    found = {n: counts[n] for n in conditions if counts[n]}
    require(not found, "; ".join(f"{n}: {k} rows" for n, k in found.items()))


def missing(column: str | Column) -> Column:
    """Null or empty as text."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (c.cast("string") == "")


def stable_id(df: DataFrame, key: str) -> DataFrame:
    """df, if every row has a non-empty id that is unique as text."""
    require_columns(df, key)
    refuse_rows(df, **{f"empty id {key}": missing(key)})
    twice = df.groupBy(F.col(key).cast("string").alias("id")).count().where("count > 1")
    require(twice.isEmpty(), f"duplicate id {key}")
    return df


def finite(column: str | Column) -> Column:
    """The value as a double, NaN and infinities as null."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def at_most(df: DataFrame, limit: int | None, what: str) -> DataFrame:
    """df, unless it has more rows than an optional limit. The limit refuses, it never cuts."""
    if limit is not None:
        require(len(df.select(F.lit(1)).take(limit + 1)) <= limit, f"more than {limit} {what}")
    return df
