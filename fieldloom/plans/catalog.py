"""All queries of the operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog_features, catalog_graph, catalog_polygons, catalog_raster, catalog_review, catalog_sources, catalog_spatial, catalog_tables

_MODULES = (catalog_spatial, catalog_tables, catalog_raster, catalog_graph, catalog_sources, catalog_features, catalog_polygons, catalog_review)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.ORACLE_SQL.items()}


def discovery(spark: SparkSession) -> DataFrame:
    """name, module, summary, with_sql of every registered query of the library."""
    told = lambda f: (f.__doc__ or "").strip().split("\n")[0]
    rows = [(name, m.__name__.rsplit(".", 1)[-1].removeprefix("catalog_"), told(f), name in m.ORACLE_SQL) for m in _MODULES for name, f in sorted(m.QUERIES.items())]
    return spark.createDataFrame(rows, "name string, module string, summary string, with_sql boolean")
