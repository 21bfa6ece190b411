"""Sinks. A result is staged beside its target, read back, compared and renamed; an existing target is refused."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError, require, require_columns
from ..functions.text import sanitize


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order: count and sums of row hashes, by column names and types."""
    row = F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    text = F.to_json(row, {"ignoreNullFields": "false"})
    parts = df.select(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b")).agg(
        F.count("*"), *(F.sum(F.shiftright(c, 32).cast("decimal(38,0)")) for c in "ab"), *(F.sum(F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")) for c in "ab"),
    ).first()
    kinds = sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields)
    return hashlib.sha256(json.dumps([kinds, [str(p) for p in parts]]).encode()).hexdigest()


def publish(df: DataFrame, path: str, record: dict[str, Any] | None = None, overwrite: bool = False, required: list[str] = (), **options) -> dict[str, Any]:
    """Parquet under path, with record.json beside the parts. The staged copy must have the rows and columns written."""
    spark = df.sparkSession
    require(overwrite or not exists(spark, path), f"{path} exists")
    require_columns(df, *required)
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    fs, staged = _fs(spark, stage)
    try:
        df.write.options(**options).parquet(stage)
        back = spark.read.parquet(stage)
        require([(f.name, f.dataType) for f in back.schema.fields] == [(f.name, f.dataType) for f in df.schema.fields], "the copy read back has another schema")
        facts = {**(record or {}), "rows": back.count(), "sha256": content_hash(back), "columns": back.columns}
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stage}/record.json"))
        out.write(bytearray(json.dumps(facts, sort_keys=True, default=str).encode()))
        out.close()
        _, target = _fs(spark, path)
        if overwrite and fs.exists(target):
            fs.delete(target, True)
        require(fs.rename(staged, target), f"{path} can't be published")
        return facts
    except Exception:
        fs.delete(staged, True)
        raise


def split(df: DataFrame, by: str, path: str, prefix: str = "part") -> list[str]:
    """A folder for each value, null included, by sanitised names; names that would be one file are refused before any write."""
    name = F.concat(F.lit(f"{prefix}_"), F.coalesce(sanitize(F.col(by)), F.lit("NULL")))
    groups = df.select(F.col(by).alias("v"), name.alias("name")).distinct()
    clash = groups.groupBy(F.lower("name").alias("n")).count().where("count > 1")
    require(clash.isEmpty(), "two values would be written under one name")
    require(not exists(df.sparkSession, path), f"{path} exists")
    df.withColumn("_name", name).write.partitionBy("_name").parquet(path)
    return sorted(r["name"] for r in groups.select("name").collect())


def export_table(df: DataFrame, path: str, fields: list[str] | None = None, where: str | None = None, x: str | None = None, y: str | None = None) -> list[str]:
    """CSV with a header; unknown fields are left out and returned."""
    if where:
        from ..functions.filters import where as compiled

        df = df.where(compiled(where))
    wanted = fields or df.columns
    kept = [f for f in wanted if f in df.columns]
    columns = [F.col(f) for f in kept] + ([F.col(x).alias("X"), F.col(y).alias("Y")] if x and y else [])
    df.select(*columns).write.option("header", "true").csv(path)
    return [f for f in wanted if f not in df.columns]


def to_geojson(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """feature: one GeoJSON point feature a row."""
    rest = [c for c in df.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))).alias("feature"))


class Layers:
    """Named tables in one database: list, import, copy, rename, drop. An existing name is refused, the last one stays."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")

    def _name(self, layer: str) -> str:
        if "`" in layer:
            raise ContractError("bad layer name")
        return f"`{self.database}`.`{layer}`"

    def list(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary)

    def has(self, layer: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.database}.{layer}")

    def put(self, layer: str, df: DataFrame) -> None:
        require(not self.has(layer), f"layer {layer} exists")
        df.write.format("parquet").saveAsTable(self._name(layer), mode="error")

    def get(self, layer: str) -> DataFrame:
        require(self.has(layer), f"no layer {layer}")
        return self.spark.table(self._name(layer))

    def copy(self, layer: str, new: str) -> None:
        self.put(new, self.get(layer))

    def rename(self, layer: str, new: str) -> None:
        require(self.has(layer) and not self.has(new), f"can't rename {layer} to {new}")
        self.spark.sql(f"ALTER TABLE {self._name(layer)} RENAME TO {self._name(new)}")

    def drop(self, layer: str) -> None:
        require(self.has(layer), f"no layer {layer}")
        require(len(self.list()) > 1, "the last layer can't be dropped")
        self.spark.sql(f"DROP TABLE {self._name(layer)}")
