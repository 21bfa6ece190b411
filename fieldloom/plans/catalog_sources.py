"""Queries that go through sources and geometry kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shapes
from ..operators import spatial
from ..sources import readers, sinks
from . import inputs as i
from .inputs import load, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@query("scan_window", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 20")
def scan_window(spark, sf):
    return load(spark, sf, "events").where("value between 10 and 20").select("event_id", "value")


@query("promote_numbers", "SELECT p_partkey::DOUBLE AS p_partkey, p_size::DOUBLE AS p_size, p_name FROM part")
def promote_numbers(spark, sf):
    p = load(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.col("p_size").cast("string").alias("p_size"), "p_name")
    return readers.promote_numbers(p)


@query("geojson_points", sql("SELECT '{\"type\":\"Feature\",\"properties\":{\"s_suppkey\":' || s_suppkey || '},\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || x || ',' || y || ']}}' AS feature FROM supp", "supp"))
def geojson_points(spark, sf):
    return sinks.to_geojson(i.suppliers(spark, sf).select("s_suppkey", "x", "y"))


def _rings(spark, sf):
    b = i.part_boxes(spark, sf)
    return b.select("p_partkey", "p_size", shapes.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("ring"))


@query("ring_measures", sql("SELECT p_partkey, (xmax - xmin) * (ymax - ymin) AS area, 2 * ((xmax - xmin) + (ymax - ymin)) AS length, round((xmin + xmax) / 2, 6) AS cx, round((ymin + ymax) / 2, 6) AS cy FROM box", "box"))
def ring_measures(spark, sf):
    r = F.col("ring")
    c = shapes.centroid(r)
    return _rings(spark, sf).select("p_partkey", shapes.signed_area(r).alias("area"), shapes.length(r, True).alias("length"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


@query("point_in_polygon", sql("SELECT p_partkey, c_custkey FROM box b JOIN cust ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax", "box", "cust"))
def point_in_polygon(spark, sf):
    boxes = i.parts(spark, sf)
    near = spatial.pairs(boxes, i.customer_points(spark, sf), "intersects").select(F.col("left_id").alias("p_partkey"), F.col("right_id").alias("c_custkey"), F.col("right_x0").alias("x"), F.col("right_y0").alias("y"))
    return near.join(_rings(spark, sf), "p_partkey").where(shapes.contains(F.col("ring"), F.col("x"), F.col("y"))).select("p_partkey", "c_custkey")


@query("clip_polygon_area", sql("SELECT p_partkey, greatest(0, least(xmax, 500) - greatest(xmin, 200)) * greatest(0, least(ymax, 600) - greatest(ymin, 100)) AS area FROM box WHERE xmin < 500 AND xmax > 200 AND ymin < 600 AND ymax > 100", "box"))
def clip_polygon_area(spark, sf):
    window = shapes.box_ring(F.lit(200.0), F.lit(100.0), F.lit(500.0), F.lit(600.0))
    boxes = i.part_boxes(spark, sf).where("xmin < 500 and xmax > 200 and ymin < 600 and ymax > 100").select("p_partkey", shapes.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")).alias("ring"))
    return boxes.select("p_partkey", shapes.signed_area(shapes.clip_udf()("ring", window)).alias("area"))


@query("rectangle_metrics", sql("SELECT p_partkey, greatest(xmax - xmin, ymax - ymin) AS long_m, least(xmax - xmin, ymax - ymin) AS short_m FROM box", "box"))
def rectangle_metrics(spark, sf):
    out = _rings(spark, sf).select("p_partkey", shapes.rectangle_udf()("ring").alias("m"))
    return out.select("p_partkey", F.round("m.long_m", 6).alias("long_m"), F.round("m.short_m", 6).alias("short_m"))


@query("sample_lines", sql("SELECT p_partkey, k * 5.0::DOUBLE AS m, xmin + k * 5.0::DOUBLE AS x FROM box, range(5) t(k) WHERE k * 5 <= xmax - xmin UNION ALL SELECT p_partkey, xmax - xmin, xmax FROM box WHERE CAST(xmax - xmin AS BIGINT) % 5 <> 0", "box"))
def sample_lines(spark, sf):
    b = i.part_boxes(spark, sf)
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    lines = b.select("p_partkey", F.array(pt("xmin", "ymin"), pt("xmax", "ymin")).alias("line"))
    at = lines.select("p_partkey", "line", F.explode(shapes.measures(shapes.length(F.col("line")), 5.0)).alias("m"))
    return at.select("p_partkey", "m", shapes.locate(F.col("line"), F.col("m"))["x"].alias("x"))
