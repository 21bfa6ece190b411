"""Recipes: steps in order, each over earlier results, kept by a hash of what they depend on."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..contracts import ContractError, require

Operation = Callable[..., DataFrame]


@dataclass
class Step:
    id: str
    operation: str
    inputs: list[str] = field(default_factory=list)
    params: dict[str, Any] = field(default_factory=dict)
    min_rows: int | None = None
    max_rows: int | None = None
    columns: list[str] | None = None


@dataclass
class Run:
    results: dict[str, DataFrame]
    record: list[dict[str, Any]]


class Recipe:
    """operations: name to function(*inputs, **params). Inputs name sources or earlier steps only."""

    def __init__(self, operations: dict[str, Operation], steps: list[Step], version: str = "1"):
        self.operations, self.steps, self.version = operations, steps, version
        ids = [s.id for s in steps]
        require(len(set(ids)) == len(ids), "duplicate step ids")
        for s in steps:
            require(s.operation in operations, f"unknown operation {s.operation}")

    def variants(self, changes: dict[str, dict[str, dict[str, Any]]]) -> dict[str, Recipe]:
        """Recipes by name with some steps' parameters replaced."""
        out = {}
        for name, by_step in changes.items():
            require(set(by_step) <= {s.id for s in self.steps}, "a variant names an unknown step")
            out[name] = Recipe(self.operations, [Step(**{**s.__dict__, "params": {**s.params, **by_step.get(s.id, {})}}) for s in self.steps], self.version)
        return out

    def run(self, spark: SparkSession, sources: dict[str, tuple[DataFrame, str]], cache: str | None = None) -> Run:
        """sources: name to (table, content hash). With a cache folder each step's result is written under its signature
        and read from there when nothing that it depends on has changed; row and column checks hold either way."""
        results = {n: df for n, (df, _) in sources.items()}
        signatures = {n: h for n, (_, h) in sources.items()}
        record = []
        for s in self.steps:
            unknown = [i for i in s.inputs if i not in results]
            require(not unknown, f"step {s.id} refers to {', '.join(unknown)}, which is no source or earlier step")
            require(s.id not in results, f"step {s.id} has the name of a source")
            signature = hashlib.sha256(json.dumps([self.version, s.operation, s.params, [signatures[i] for i in s.inputs]], sort_keys=True, default=str).encode()).hexdigest()
            hit = False
            if cache:
                path = f"{cache.rstrip('/')}/{signature}"
                hit = _exists(spark, f"{path}/_SUCCESS")
                if not hit:
                    self.operations[s.operation](*(results[i] for i in s.inputs), **s.params).write.mode("overwrite").parquet(path)
                df = spark.read.parquet(path)
            else:
                df = self.operations[s.operation](*(results[i] for i in s.inputs), **s.params)
            n = self._checked(s, df)
            results[s.id], signatures[s.id] = df, signature
            record.append({"id": s.id, "operation": s.operation, "signature": signature, "cached": hit, "rows": n})
        return Run(results, record)

    @staticmethod
    def _checked(s: Step, df: DataFrame) -> int | None:
        if s.columns is not None:
            require(df.columns == s.columns, f"step {s.id} has the columns {df.columns}")
        if s.min_rows is None and s.max_rows is None:
            return None
        n = df.count()
        if (s.min_rows is not None and n < s.min_rows) or (s.max_rows is not None and n > s.max_rows):
            raise ContractError(f"step {s.id} has {n} rows")
        return n


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
