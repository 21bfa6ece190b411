"""Row and column operations on feature tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import ContractError, finite, missing, refuse_rows, require, require_columns, require_new
from ..functions.text import bool_word, coordinate, looks_garbled

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    require_columns(df, old)
    require_new(df, new)
    return df.withColumnRenamed(old, new)


def drop(df: DataFrame, *names: str) -> DataFrame:
    require_columns(df, *names)
    return df.drop(*names)


def select(df: DataFrame, *names: str) -> DataFrame:
    require_columns(df, *names)
    return df.select(*names)


def cast(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Strict cast of a column to int, float, str or bool: nulls stay, any value that doesn't parse refuses the whole."""
    require_columns(df, name)
    c = F.col(name)
    text = F.trim(c.cast("string"))
    new = {"int": F.expr(f"try_cast(trim(cast(`{name}` as string)) as bigint)"), "float": F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)"), "str": c.cast("string"), "bool": bool_word(c)}.get(kind)
    require(new is not None, f"unknown type {kind}")
    if kind == "int":  # 3.0 is integral, 3.5 is not
        real = F.expr(f"try_cast(trim(cast(`{name}` as string)) as double)")
        new = F.coalesce(new, F.when(real == F.floor(real), real.cast("bigint")))
    refuse_rows(df, **{f"not {kind}: {name}": text.isNotNull() & new.isNull()})
    return df.withColumn(name, new)


def field_list(df: DataFrame) -> DataFrame:
    """field, dtype, has_null, samples (up to three distinct values as text)."""
    parts = [F.struct(F.lit(f.name).alias("field"), F.lit(f.dataType.simpleString()).alias("dtype"), F.coalesce(F.max(F.col(f.name).isNull()), F.lit(False)).alias("has_null"),
                      F.slice(F.array_sort(F.collect_set(F.when(F.col("_n") <= 3, F.col(f.name).cast("string")))), 1, 3).alias("samples")) for f in df.schema.fields]
    numbered = df.withColumn("_n", F.monotonically_increasing_id() + 1)
    return numbered.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def drop_null_fields(df: DataFrame) -> DataFrame:
    """Without the columns that have no value in any row."""
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).first()
    return df.drop(*(c for c in df.columns if counts[c] == 0))


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row by order of each combination of keys; nulls are equal to each other."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def repair_encoding(df: DataFrame, name: str, encoding: str = "GBK") -> DataFrame:
    """A column whose bytes were read as Latin-1: decoded anew if every non-ASCII value decodes and one looks garbled."""
    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return v.encode("latin-1").decode(encoding)
            except (AttributeError, UnicodeError):
                return None

        return values.map(one)

    c = F.col(name)
    high = c.rlike("[^\\x00-\\x7f]")
    work = df.withColumn("_fixed", decoded(F.when(high, c)))
    able = F.col("_fixed").isNotNull()
    seen = work.agg(F.count(F.when(high & ~able, 1)).alias("unable"), F.count(F.when(high & able & looks_garbled(c), 1)).alias("garbled")).first()
    if not seen["garbled"] or seen["unable"]:
        return df
    return work.withColumn(name, F.when(high, F.col("_fixed")).otherwise(c)).drop("_fixed")


@dataclass
class Normalized:
    accepted: DataFrame
    failures: DataFrame
    counts: DataFrame = field(repr=False)


def _typed(spec: dict[str, Any]) -> tuple[Column, Column]:
    """(value, failed) of one new field."""
    raw = F.col(spec["source"])
    absent = missing(raw)
    value, unknown = raw, F.lit(False)
    if "codes" in spec:
        table = F.create_map(*(F.lit(x) for kv in spec["codes"].items() for x in kv))
        value = F.try_element_at(table, raw.cast("string"))
        unknown = value.isNull()
    text = value.cast("string")
    kind = spec.get("type", "string")
    real = F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).cast("double"))
    if kind == "string":
        out = text
    elif kind == "float":
        out = finite(real)
    elif kind == "int":
        out = F.when(real == F.floor(real), real.cast("bigint"))
    elif kind == "date":
        out = F.date_format(F.try_to_timestamp(text, F.lit(spec["format"])), "yyyy-MM-dd")
    elif kind == "bool":
        word = F.lower(text)
        out = F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)
    else:
        raise ContractError(f"unknown type {kind}")
    return F.when(~absent, out), ~absent & (unknown | out.isNull())


def normalize(df: DataFrame, key: str, fields: dict[str, dict[str, Any]], x: str | None = None, y: str | None = None, geographic: bool = False) -> Normalized:
    """Typed new fields (and a point from x and y). Rows that fail are listed with the reason, as are both rows of a key
    that occurs twice among the others; nothing of a failed row goes on."""
    require_columns(df, key, *(s["source"] for s in fields.values()), *(c for c in (x, y) if c))
    require_new(df, *fields)
    work, reasons = df.withColumn("_row", F.monotonically_increasing_id()), []
    for target, spec in fields.items():
        value, failed = _typed(spec)
        work = work.withColumn(target, value)
        reasons.append(F.when(failed, F.struct(F.lit(spec["source"]).alias("field"), F.lit(f"not a {spec.get('type', 'string')}").alias("reason"))))
    if x and y:
        px, py = coordinate(F.col(x)), coordinate(F.col(y))
        wrong = px.isNull() | py.isNull() | (((F.abs(px) > 180) | (F.abs(py) > 90)) if geographic else F.lit(False))
        work = work.withColumn("x_out", F.when(~wrong, px)).withColumn("y_out", F.when(~wrong, py))
        reasons.append(F.when(wrong, F.struct(F.lit("geometry").alias("field"), F.lit("illegal coordinates").alias("reason"))))
    work = work.withColumn("_failed", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<struct<field:string,reason:string>>"))
    clean = F.size("_failed") == 0
    same = F.count(F.when(clean, 1)).over(Window.partitionBy(F.when(clean, F.col(key).cast("string"))))
    bad_key = clean & (missing(key) | (same > 1))
    work = work.withColumn("_key", F.when(bad_key, F.array(F.struct(F.lit(key).alias("field"), F.lit("missing or duplicate key").alias("reason")))))
    work = work.withColumn("_failed", F.coalesce("_key", "_failed")).drop("_key")
    original = F.to_json(F.struct(*df.columns))
    accepted = work.where("size(_failed) = 0").drop("_failed", "_row")
    failures = work.where("size(_failed) > 0").select(F.col("_row").alias("row"), original.alias("original"), F.inline("_failed"))
    counts = work.agg(F.count("*").alias("input_rows"), F.count(F.when(F.size("_failed") == 0, 1)).alias("accepted_rows"), F.count(F.when(F.size("_failed") > 0, 1)).alias("rejected_rows"))
    return Normalized(accepted, failures, counts)


_LATTICE = {"bigint": 1, "double": 2}


def _merged_type(kinds: set[str]) -> str:
    """One type for a field that inputs type differently: integers widen to bigint, with fractions double, else text."""
    whole = {"tinyint", "smallint", "int", "bigint"}
    if len(kinds) == 1 and not kinds & whole:
        return next(iter(kinds))
    if kinds <= whole:
        return "bigint"
    if kinds <= whole | {"float", "double"}:
        return "double"
    return "timestamp" if kinds <= {"date", "timestamp"} else "string"


def merge(named: list[tuple[str, DataFrame]], fields: str = "union", source: str = "source_file") -> DataFrame:
    """Rows of all inputs, one type a field, missing fields null; with fields='intersection' only the common fields."""
    require(fields in ("union", "intersection"), "fields must be union or intersection")
    kinds: dict[str, set[str]] = {}
    for _, df in named:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    names = list(kinds) if fields == "union" else [c for c in named[0][1].columns if all(c in df.columns for _, df in named)]
    require(source not in names, f"fields exist already: {source}")
    out = None
    for label, df in named:
        part = df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(_merged_type(kinds[n])).alias(n) for n in names), F.lit(label).alias(source))
        out = part if out is None else out.unionByName(part)
    return out


def time_slice(df: DataFrame, start: str, end: str, at: str, unknown: str = "hold") -> DataFrame:
    """Rows valid at an instant: start inside, end outside. Null ends are open with unknown='open', else left out."""
    require(unknown in ("hold", "open"), "unknown must be hold or open")
    s, e, t = F.col(start).cast("timestamp"), F.col(end).cast("timestamp"), F.lit(at).cast("timestamp")
    refuse_rows(df, **{"start not before end": s >= e})
    if unknown == "open":
        return df.where((s.isNull() | (s <= t)) & (e.isNull() | (t < e)))
    return df.where((s <= t) & (t < e))


def interval_breaks(df: DataFrame, group: str, at: str) -> DataFrame:
    """group, start, end of consecutive distinct measures."""
    w = Window.partitionBy(group).orderBy(at)
    return df.select(group, at).distinct().withColumn("end", F.lead(at).over(w)).where("end is not null").withColumnRenamed(at, "start")


def core_outlier(df: DataFrame, x: str, y: str, factor: float = 20.0) -> DataFrame:
    """is_core: within `factor` median distances of the median centre."""
    centre = df.agg(F.percentile(x, F.lit(0.5)).alias("cx"), F.percentile(y, F.lit(0.5)).alias("cy")).first()
    d = F.sqrt(F.pow(F.col(x) - centre["cx"], 2) + F.pow(F.col(y) - centre["cy"], 2))
    median = df.agg(F.percentile(d, F.lit(0.5))).first()[0]
    return df.withColumn("is_core", d <= factor * median)
