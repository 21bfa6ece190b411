"""Queries on feature operators: rings, grids, restrictions, labels, generalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import projection
from ..operators import analysis, conflation, features, raster, table
from ..operators.raster import Grid
from ..operators.spatial import Boxes
from . import catalog_tables
from . import inputs as i
from .inputs import sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_W, _H = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))", "(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"


@query("concentric_rings", sql("SELECT n_nationkey, CAST(ring AS INTEGER) AS ring, lo, hi, xmin - hi AS xmin, ymin - hi AS ymin, xmax + hi AS xmax, ymax + hi AS ymax FROM zone, (VALUES (1, 0::DOUBLE, 10::DOUBLE), (2, 10, 25)) r(ring, lo, hi)", "zone"))
def concentric_rings(spark, sf):
    return features.concentric(i.zones(spark, sf), [10.0, 25.0], "n_nationkey")


@query("grid_square", "SELECT c || ':' || r AS cell_id, c * 125.0::DOUBLE AS xmin, r * 125.0::DOUBLE AS ymin, c * 125.0::DOUBLE + 125 AS xmax, r * 125.0::DOUBLE + 125 AS ymax FROM range(8) a(c), range(8) b(r)")
def grid_square(spark, sf):
    return features.square_grid(spark, 0.0, 0.0, 1000.0, 1000.0, 125.0)


_RES = "(SELECT 10.0::DOUBLE + 200 * (n_nationkey % 5) AS xmin, 10.0::DOUBLE + 200 * (n_nationkey // 5) AS ymin, 150.0::DOUBLE + 200 * (n_nationkey % 5) AS xmax, 110.0::DOUBLE + 200 * (n_nationkey // 5) AS ymax FROM nation)"


@query("select_free", sql(f"SELECT p_partkey AS id, area, area - coalesce(t, 0) AS free_area, CASE WHEN area - coalesce(t, 0) <= 0 THEN 'fully_restricted' WHEN area - coalesce(t, 0) < 40 THEN 'below_min_area' END AS reason FROM (SELECT p_partkey, (xmax - xmin) * (ymax - ymin) AS area FROM box) o LEFT JOIN (SELECT a.p_partkey AS k, sum({_W} * {_H}) AS t FROM box a JOIN {_RES} b ON {_W} > 0 AND {_H} > 0 GROUP BY 1) ON k = p_partkey", "box"))
def select_free(spark, sf):
    return features.select_free(i.parts(spark, sf), Boxes(i.inner_boxes(spark, sf), "n_nationkey"), 40.0)


@query("aggregate_points", sql("""SELECT "group", count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (SELECT s.id, s.x, s.y, min(r.root) AS "group" FROM s JOIN r ON r.id = s.id GROUP BY ALL) GROUP BY 1""", "supp").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT \"group\"", ", s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, x, y FROM supp), l AS (SELECT a.id AS p, b.id AS q FROM s a JOIN s b ON a.id <> b.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600), r(id, root) AS (SELECT id, id FROM s UNION SELECT l.q, r.root FROM r JOIN l ON l.p = r.id) SELECT \"group\"", 1))
def aggregate_points(spark, sf):
    out = features.aggregate_points(i.supplier_points(spark, sf), 60.0)
    return out.select("group", "n", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("face_labels", sql("""SELECT z.n_nationkey AS face_id, CASE WHEN NOT coalesce(edge, false) AND k = 1 THEN v END AS label, CASE WHEN coalesce(edge, false) THEN 'on_boundary' WHEN coalesce(k, 0) = 0 THEN 'unassigned' WHEN k > 1 THEN 'conflict' ELSE 'labelled' END AS status FROM zone z LEFT JOIN
    (SELECT f, bool_or(n > 1) AS edge, count(DISTINCT CASE WHEN n = 1 THEN c_mktsegment END) AS k, min(CASE WHEN n = 1 THEN c_mktsegment END) AS v FROM (SELECT z.n_nationkey AS f, c_mktsegment, count(*) OVER (PARTITION BY c_custkey) AS n FROM cust c JOIN zone z ON c.x >= z.xmin AND c.x <= z.xmax AND c.y >= z.ymin AND c.y <= z.ymax) GROUP BY 1) ON f = z.n_nationkey""", "zone", "cust"))
def face_labels(spark, sf):
    return features.labels(i.zone_boxes(spark, sf), i.customer_points(spark, sf), "c_mktsegment")


@query("best_iou", sql(f"SELECT left_id, right_id, round(iou, 9) AS iou FROM (SELECT a.p_partkey AS left_id, b.n_nationkey AS right_id, {_W} * {_H} / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - {_W} * {_H}) AS iou, row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_W} * {_H} / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - {_W} * {_H}) DESC, b.n_nationkey) AS r FROM box a JOIN zone b ON {_W} > 0 AND {_H} > 0) WHERE r = 1", "box", "zone"))
def best_iou(spark, sf):
    out = features.best_iou(i.parts(spark, sf), i.zone_boxes(spark, sf))
    return out.select("left_id", "right_id", F.round("iou", 9).alias("iou"))


@query("near_duplicate_boxes", sql("SELECT a.p_partkey AS a, b.p_partkey AS b FROM box a JOIN box b ON a.p_partkey < b.p_partkey AND power(greatest(abs(a.xmin - b.xmin), abs(a.xmax - b.xmax)), 2) + power(greatest(abs(a.ymin - b.ymin), abs(a.ymax - b.ymax)), 2) <= 25", "box"))
def near_duplicate_boxes(spark, sf):
    return features.near_duplicates(i.parts(spark, sf), 5.0)


@query("map_extent_clip", sql("SELECT p_partkey, greatest(xmin, 200) AS xmin, least(xmax, 400) AS xmax, xmin < 200 OR xmax > 400 OR ymin < 100 OR ymax > 300 AS clipped FROM box WHERE xmin <= 400 AND xmax >= 200 AND ymin <= 300 AND ymax >= 100", "box"))
def map_extent_clip(spark, sf):
    return features.map_extent(i.parts(spark, sf), (200.0, 100.0, 400.0, 300.0), "clip").select("p_partkey", "xmin", "xmax", "clipped")


@query("exclusion_rules", "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'brand' WHEN p_type LIKE '%BRASS' THEN 'brass' END AS excluded_by FROM part")
def exclusion_rules(spark, sf):
    p = i.load(spark, sf, "part").withColumnsRenamed({"p_brand": "layer", "p_type": "block"})
    return features.exclusions(p, [{"id": "brand", "layer": "Brand#1*"}, {"id": "brass", "block": "*BRASS"}]).select("p_partkey", "excluded_by")


@query("web_mercator", sql("SELECT c_custkey, round(radians(x / 6) * 6378137, 4) AS mx, round(ln(tan(pi() / 4 + radians(y / 12) / 2)) * 6378137, 4) + 0.0 AS my FROM cust", "cust"))
def web_mercator(spark, sf):
    x, y = projection.to_web_mercator(F.col("x") / 6, F.col("y") / 12)
    return i.customers(spark, sf).select("c_custkey", F.round(x, 4).alias("mx"), (F.round(y, 4) + 0.0).alias("my"))


@query("interval_breaks", "SELECT l_orderkey, l_quantity AS start, e AS \"end\" FROM (SELECT l_orderkey, l_quantity, lead(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS e FROM (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)) WHERE e IS NOT NULL")
def interval_breaks(spark, sf):
    return table.interval_breaks(i.load(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "start", "end")


@query("helmert_fit", sql("SELECT round(regr, 6) AS a FROM (SELECT (sum((x - mx) * (u - mu) + (y - my) * (v - mv))) / sum((x - mx) * (x - mx) + (y - my) * (y - my)) AS regr FROM (SELECT x, y, 2 * x - y + 5 AS u, x + 2 * y - 3 AS v FROM supp), (SELECT avg(x) AS mx, avg(y) AS my, avg(2 * x - y + 5) AS mu, avg(x + 2 * y - 3) AS mv FROM supp))", "supp"))
def helmert_fit(spark, sf):
    s = i.suppliers(spark, sf).select("x", "y", (2 * F.col("x") - F.col("y") + 5).alias("u"), (F.col("x") + 2 * F.col("y") - 3).alias("v"))
    fit = conflation.helmert(s)
    return spark.range(1).select(F.round(F.lit(fit["a"]), 6).alias("a"))


@query("scenario_changes", f"{catalog_tables._SCORE} SELECT a.scenario, id, CASE WHEN a.selected THEN 'newly_selected' ELSE 'lost_selected' END AS change FROM t a JOIN t b USING (id) WHERE a.scenario = 'other' AND b.scenario = 'base' AND a.selected <> b.selected")
def scenario_changes(spark, sf):
    return analysis.scenario_changes(catalog_tables._scores(spark, sf), "base")


@query("points_match", sql("SELECT left_id, right_id, dist2, CASE WHEN count(*) OVER (PARTITION BY left_id) > 1 OR count(*) OVER (PARTITION BY right_id) > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM (SELECT s_suppkey AS left_id, c_custkey AS right_id, CAST((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS BIGINT) AS dist2 FROM supp s JOIN cust c ON (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 225)", "supp", "cust"))
def points_match(spark, sf):
    return conflation.match_points(i.supplier_points(spark, sf), i.customer_points(spark, sf), 15.0).withColumn("dist2", F.col("dist2").cast("bigint"))


@query("raster_profile_line", sql('SELECT d * 2.0::DOUBLE AS distance, value FROM range(31) t(d) LEFT JOIN cell ON col = floor(0.5 + d * 2) AND "row" = 63', "cell"))
def raster_profile_line(spark, sf):
    return raster.profile_line(i.cells(spark, sf), Grid(64, 64, 0.0, 64.0), 0.5, 0.5, 60.5, 0.5, 2.0)


@query("raster_seed_region")
def raster_seed_region(spark, sf):
    from .catalog_raster import _patches

    return raster.seed_region(_patches(spark, sf), [(3, 3)])


@query("coverage_ratio", sql("SELECT z.n_nationkey AS left_id, coalesce(n, 0)::DOUBLE AS covered, round(coalesce(n, 0) / 40000, 9) AS ratio FROM zone z LEFT JOIN (SELECT 5 * (y // 200) + x // 200 AS k, count(*) AS n FROM (SELECT DISTINCT CAST(xmin AS BIGINT) + i AS x, CAST(ymin AS BIGINT) + j AS y FROM box, range(20) a(i), range(20) b(j) WHERE i < xmax - xmin AND j < ymax - ymin) GROUP BY 1) ON k = z.n_nationkey", "zone", "box"))
def coverage_ratio(spark, sf):
    out = features.union_area(i.zone_boxes(spark, sf), i.parts(spark, sf))
    return out.select("left_id", F.round("covered", 6).alias("covered"), F.round("ratio", 9).alias("ratio"))


@query("pointer_trace", "WITH RECURSIVE p AS (SELECT o_orderkey AS cell, CASE WHEN o_orderkey > 0 THEN o_orderkey // 3 END AS nxt FROM orders), t(start, cell, step) AS (SELECT cell, cell, 0::BIGINT FROM p UNION ALL SELECT start, nxt, step + 1 FROM t JOIN p USING (cell) WHERE nxt IS NOT NULL) SELECT start, cell, step FROM t")
def pointer_trace(spark, sf):
    k = F.col("o_orderkey")
    cells = i.load(spark, sf, "orders").select(k.alias("cell"), F.when(k > 0, F.floor(k / 3)).alias("next"))
    return features.trace_pointers(cells, cells)
