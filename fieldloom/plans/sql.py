"""One validated SELECT over named inputs."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import missing, refuse_rows, require

_BLANKED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


@dataclass
class Answer:
    df: DataFrame
    plan: str
    schema: str


def run_select(spark: SparkSession, sql: str, inputs: dict[str, DataFrame], key: str | None = None, schema: str | None = None) -> Answer:
    """Exactly one SELECT or WITH; duplicate output names and any other schema than an asserted one are refused, as is an
    id that is null or repeated. The inputs are visible under their names for this statement only."""
    bare = _BLANKED.sub(" ", sql).strip().rstrip(";").strip()
    require(";" not in bare, "one statement only")
    require(re.match(r"(?i)(select|with)\b", bare) is not None, "only SELECT is allowed")
    require(re.search(r"(?i)\b(insert|update|delete|merge|create|drop|alter|load|cache|set)\s", bare) is None, "only SELECT is allowed")
    suffix = uuid.uuid4().hex[:8]
    names = {}
    for name, df in inputs.items():
        require(re.fullmatch(r"[A-Za-z_]\w*", name) is not None, f"bad input name {name}")
        names[name] = f"{name}_{suffix}"
        df.createOrReplaceTempView(names[name])
    # WITH clauses give the inputs their names
    head = ", ".join(f"{n} AS (SELECT * FROM {v})" for n, v in names.items())
    text = sql.strip().rstrip(";")
    if re.match(r"(?i)with\s+recursive\b", bare):
        text = re.sub(r"(?i)^\s*with\s+recursive\b", f"WITH RECURSIVE {head}," if head else "WITH RECURSIVE", text, count=1)
    elif re.match(r"(?i)with\b", bare):
        text = re.sub(r"(?i)^\s*with\b", f"WITH {head}," if head else "WITH", text, count=1)
    elif head:
        text = f"WITH {head} {text}"
    out = spark.sql(text)
    lower = [c.lower() for c in out.columns]
    require(len(set(lower)) == len(lower), "duplicate output names")
    found = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema.fields)
    if schema is not None:
        require(found == schema, f"the schema is {found}")
    if key is not None:
        refuse_rows(out, **{f"empty id {key}": missing(key)})
        require(out.groupBy(key).count().where(F.col("count") > 1).isEmpty(), f"duplicate id {key}")
    return Answer(out, out._jdf.queryExecution().toString(), found)
