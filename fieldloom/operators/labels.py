"""Labels read from texts by rules, and classes of codes by their longest known beginning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require, require_columns, require_new
from ..functions.text import drawing_text, label_field, landuse_major


@dataclass(frozen=True)
class Rule:
    """A pattern for texts on the layers or with the tags named; its field, or none if its named groups are the fields."""

    pattern: str
    field: str | None = None
    layers: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


def classify(df: DataFrame, rules: list[Rule], text: str = "text", layer: str = "layer", tag: str = "tag") -> DataFrame:
    """df with `relevant` (a rule covers its layer or tag) and the rules' fields: the first rule that gives one wins."""
    require(bool(rules), "rules define no fields")
    require_columns(df, text, layer, tag)
    clean, found = drawing_text(F.coalesce(F.col(text), F.lit(""))), {}
    covers = [F.coalesce(F.col(layer).isin(*r.layers), F.lit(False)) | F.coalesce(F.col(tag).isin(*r.tags), F.lit(False)) for r in rules]
    for rule, applies in zip(rules, covers, strict=True):
        for name, value in label_field(clean, rule.pattern, rule.field).items():
            found.setdefault(name, []).append(F.when(applies, value))
    require(bool(found), "a combined pattern needs named groups")
    require_new(df, "relevant", *found)
    relevant = covers[0]
    for c in covers[1:]:
        relevant = relevant | c
    return df.select("*", relevant.alias("relevant"), *(F.coalesce(*own).alias(name) for name, own in found.items()))


def by_longest_prefix(df: DataFrame, code: str, classes: DataFrame, prefix: str = "prefix", name: str = "name") -> DataFrame:
    """df with `class`: the name of the longest prefix that the first of its land-use codes begins with, null if none.

    Every code is looked up by its own beginnings, an equi-join; codes are looked up once each.
    """
    require_new(df, "class")
    codes = df.select(F.col(code).alias("_code")).where("_code is not null").distinct().withColumn("_first", landuse_major(F.col("_code")))
    starts = codes.select("_code", F.explode(F.transform(F.sequence(F.lit(0), F.length("_first")), lambda n: F.substring("_first", F.lit(1), n))).alias("_prefix"))
    found = starts.join(classes.select(F.col(prefix).alias("_prefix"), F.col(name).alias("_name")), "_prefix")
    best = found.groupBy("_code").agg(F.max_by("_name", F.length("_prefix")).alias("class"))
    return df.join(best, F.col(code) == F.col("_code"), "left").drop("_code")
