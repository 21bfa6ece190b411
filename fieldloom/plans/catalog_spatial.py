"""Queries on points and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, spatial
from ..operators.spatial import Boxes
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


IN_ZONE = "c.x >= z.xmin AND c.x <= z.xmax AND c.y >= z.ymin AND c.y <= z.ymax"
INSIDE = "c.x > z.xmin AND c.x < z.xmax AND c.y > z.ymin AND c.y < z.ymax"


@query("zone_cross", sql(f"SELECT z.n_nationkey AS zone_id, count(c.c_custkey) AS cnt, round(sum(c.c_acctbal), 4) AS sum_bal FROM zone z LEFT JOIN cust c ON {INSIDE} GROUP BY 1", "cust", "zone"))
def zone_cross(spark, sf):
    out = spatial.zone_cross(i.zone_boxes(spark, sf), i.customer_points(spark, sf), "c_acctbal", "within")
    return out.select("zone_id", "cnt", F.round("total", 4).alias("sum_bal"))


@query("zone_cross_intersects", sql(f"SELECT z.n_nationkey AS zone_id, count(c.c_custkey) AS cnt FROM zone z LEFT JOIN cust c ON {IN_ZONE} GROUP BY 1", "cust", "zone"))
def zone_cross_intersects(spark, sf):
    return spatial.zone_cross(i.zone_boxes(spark, sf), i.customer_points(spark, sf), "c_acctbal", "intersects").select("zone_id", "cnt")


_SJ = "FROM zone z LEFT JOIN cust c ON " + IN_ZONE
for _agg, _expr in {
    "first": "min_by(c.c_acctbal, c.c_custkey)", "count": "count(c.c_acctbal)", "sum": "round(sum(c.c_acctbal), 4)", "mean": "round(avg(c.c_acctbal), 4)",
}.items():
    def _run(spark, sf, agg=_agg):
        out = spatial.spatial_join(i.zone_boxes(spark, sf), i.customer_points(spark, sf), "c_acctbal", agg)
        v = {"sum": F.round("value", 4), "mean": F.round("value", 4)}.get(agg, F.col("value"))
        return out.select("left_id", "match_count", v.alias("value"))

    query(f"sjoin_{_agg}", sql(f"SELECT z.n_nationkey AS left_id, count(c.c_custkey) AS match_count, {_expr} AS value {_SJ} GROUP BY 1", "cust", "zone"))(_run)


@query("sjoin_all", sql(f"SELECT z.n_nationkey AS left_id, c.c_custkey AS matched_id, c.c_acctbal AS value {_SJ}", "cust", "zone"))
def sjoin_all(spark, sf):
    return spatial.spatial_join(i.zone_boxes(spark, sf), i.customer_points(spark, sf), "c_acctbal", "all")


@query("sjoin_inner_contains", sql("SELECT z.n_nationkey AS left_id, count(*) AS match_count, round(sum(b.p_retailprice), 4) AS value FROM zone z JOIN box b ON b.xmin >= z.xmin AND b.xmax <= z.xmax AND b.ymin >= z.ymin AND b.ymax <= z.ymax GROUP BY 1", "zone", "box"))
def sjoin_inner_contains(spark, sf):
    out = spatial.spatial_join(i.zone_boxes(spark, sf), i.parts(spark, sf), "p_retailprice", "sum", "contains", "inner")
    return out.select("left_id", "match_count", F.round("value", 4).alias("value"))


@query("sjoin_right_within", sql(f"SELECT z.n_nationkey AS right_id, count(c.c_custkey) AS match_count, count(c.c_acctbal) AS value FROM zone z LEFT JOIN cust c ON {INSIDE} GROUP BY 1", "cust", "zone"))
def sjoin_right_within(spark, sf):
    return spatial.spatial_join(i.customer_points(spark, sf), i.zone_boxes(spark, sf), "c_acctbal", "count", "within", "right")


_D2 = "CAST((s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) AS BIGINT)"


@query("sjoin_nearest", sql(f"SELECT left_id, right_id, dist2 FROM (SELECT s.s_suppkey AS left_id, c.c_custkey AS right_id, {_D2} AS dist2, rank() OVER (PARTITION BY s.s_suppkey ORDER BY {_D2}) AS r FROM supp s JOIN cust c ON {_D2} <= 900) WHERE r = 1", "supp", "cust"))
def sjoin_nearest(spark, sf):
    out = spatial.nearest(i.supplier_points(spark, sf), i.customer_points(spark, sf), 30.0)
    return out.withColumn("dist2", F.col("dist2").cast("bigint"))


@query("sjoin_right_nearest", sql(f"SELECT right_id, left_id, dist2 FROM (SELECT c.c_custkey AS right_id, s.s_suppkey AS left_id, {_D2} AS dist2, rank() OVER (PARTITION BY c.c_custkey ORDER BY {_D2}) AS r FROM supp s JOIN cust c ON {_D2} <= 900) WHERE r = 1", "supp", "cust"))
def sjoin_right_nearest(spark, sf):
    out = spatial.nearest(i.customer_points(spark, sf), i.supplier_points(spark, sf), 30.0)
    return out.select(F.col("left_id").alias("right_id"), F.col("right_id").alias("left_id"), F.col("dist2").cast("bigint").alias("dist2"))


def _knn_sql(limit: str) -> str:
    return sql(f"SELECT source_id, target_id, dist2, CAST(r AS INTEGER) AS rank FROM (SELECT s.s_suppkey AS source_id, c.c_custkey AS target_id, {_D2} AS dist2, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY {_D2}, CAST(c.c_custkey AS VARCHAR)) AS r FROM supp s, cust c {limit}) WHERE r <= 2", "supp", "cust")


def _knn(out):
    return out.select(F.col("left_id").alias("source_id"), F.col("right_id").alias("target_id"), F.col("dist2").cast("bigint").alias("dist2"), F.col("rank").cast("int").alias("rank"))


@query("knn_k2_radius", _knn_sql(f"WHERE {_D2} <= 900"))
def knn_k2_radius(spark, sf):
    return _knn(spatial.knn(i.supplier_points(spark, sf), i.customer_points(spark, sf), 2, 30.0))


@query("knn_k2_all", _knn_sql(""))
def knn_k2_all(spark, sf):
    return _knn(spatial.knn(i.supplier_points(spark, sf), i.customer_points(spark, sf), 2))


for _kind, _test in {"ring": f"{_D2} <= hi * hi AND ({_D2} > lo * lo OR band = 1)", "cumulative": f"{_D2} <= hi * hi"}.items():
    def _run(spark, sf, cumulative=_kind == "cumulative"):
        return spatial.bands(i.supplier_points(spark, sf), i.customer_points(spark, sf), [10.0, 20.0, 40.0], cumulative)

    query(f"bands_{_kind}", sql(f"SELECT s.s_suppkey AS source_id, b.band, count(c.c_custkey) AS cnt FROM supp s CROSS JOIN (VALUES (1, 0, 10), (2, 10, 20), (3, 20, 40)) b(band, lo, hi) LEFT JOIN cust c ON {_test} GROUP BY 1, 2", "supp", "cust"))(_run)


@query("adjacency", sql("""SELECT a, b, CASE WHEN w > 0 AND h > 0 THEN 'overlap' WHEN w > 0 OR h > 0 THEN 'edge' ELSE 'point' END AS contact, greatest(w, 0) + greatest(h, 0) AS shared_len
    FROM (SELECT a.n_nationkey AS a, b.n_nationkey AS b, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS w, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) AS h FROM zone a JOIN zone b ON a.n_nationkey < b.n_nationkey) WHERE w >= 0 AND h >= 0""", "zone"))
def adjacency(spark, sf):
    return spatial.adjacency(i.zone_boxes(spark, sf)).select("a", "b", "contact", "shared_len")


_W, _H = "(least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin))", "(least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"


@query("overlay_intersection", sql(f"SELECT a.p_partkey AS left_id, b.n_nationkey AS right_id, {_W} * {_H} AS area FROM box a JOIN zone b ON {_W} > 0 AND {_H} > 0", "box", "zone"))
def overlay_intersection(spark, sf):
    return spatial.overlay(i.parts(spark, sf), i.zone_boxes(spark, sf))


_SHARED = f"shared AS (SELECT a.p_partkey AS k, sum({_W} * {_H}) AS s FROM box a JOIN few b ON {_W} > 0 AND {_H} > 0 GROUP BY 1)"
_FEW = i.SQL["inner"].replace("inner_ AS", "few AS")


def _few(spark, sf):
    return Boxes(i.inner_boxes(spark, sf), "n_nationkey")


def _overlay_sql(body: str) -> str:
    return sql(body, "box", "zone").replace(" SELECT a.p_partkey AS left_id", f", {_FEW}, {_SHARED} SELECT a.p_partkey AS left_id", 1)


@query("overlay_difference_area", _overlay_sql("SELECT a.p_partkey AS left_id, (a.xmax - a.xmin) * (a.ymax - a.ymin) - coalesce(s, 0) AS area FROM box a LEFT JOIN shared ON k = p_partkey"))
def overlay_difference_area(spark, sf):
    return spatial.overlay_areas(i.parts(spark, sf), _few(spark, sf)).select("left_id", F.col("rest").alias("area"))


@query("overlay_identity_area", _overlay_sql("SELECT a.p_partkey AS left_id, coalesce(s, 0) AS inside, (a.xmax - a.xmin) * (a.ymax - a.ymin) - coalesce(s, 0) AS outside FROM box a LEFT JOIN shared ON k = p_partkey"))
def overlay_identity_area(spark, sf):
    return spatial.overlay_areas(i.parts(spark, sf), _few(spark, sf)).select("left_id", F.col("shared").alias("inside"), F.col("rest").alias("outside"))


_QUAD = "quad AS (SELECT CAST(q AS INTEGER) AS q, 250.0::DOUBLE * (q % 4) AS xmin, 250.0::DOUBLE * (q // 4) AS ymin, 250.0::DOUBLE * (q % 4) + 250 AS xmax, 250.0::DOUBLE * (q // 4) + 250 AS ymax FROM range(16) t(q))"


def _quads(spark):
    q = F.col("id")
    x, y = (q % 4 * 250).cast("double"), (F.floor(q / 4) * 250).cast("double")
    return Boxes(spark.range(16).select(q.cast("int").alias("q"), x.alias("xmin"), y.alias("ymin"), (x + 250).alias("xmax"), (y + 250).alias("ymax")), "q")


_ALLOC = f"SELECT a.n_nationkey AS source, b.q AS target, {_W} * {_H} AS area, round(a.total * {_W} * {_H} / 40000, 6) AS allocated FROM zone a JOIN quad b ON {_W} > 0 AND {_H} > 0"


@query("allocate_area", f"WITH {i.SQL['zone']}, {_QUAD} {_ALLOC}")
def allocate_area(spark, sf):
    out = spatial.allocate(i.zone_boxes(spark, sf), _quads(spark), "total")
    return out.withColumn("allocated", F.round("allocated", 6))


@query("allocate_balances", f"WITH {i.SQL['zone']}, {_QUAD}, al AS ({_ALLOC}) SELECT z.n_nationkey AS source, round(coalesce(sum(allocated), 0), 4) AS allocated, abs(round(z.total - coalesce(sum(allocated), 0), 4)) AS unallocated, arg_min(target, (-area, target)) AS max_target FROM zone z LEFT JOIN al ON source = n_nationkey GROUP BY z.n_nationkey, z.total")
def allocate_balances(spark, sf):
    z = i.zone_boxes(spark, sf)
    out = spatial.balances(z, spatial.allocate(z, _quads(spark), "total"), "total")
    return out.select("source", F.round("allocated", 4).alias("allocated"), F.abs(F.round("unallocated", 4)).alias("unallocated"), "max_target")


@query("grid_owner_density", sql(f"""SELECT z.n_nationkey AS cell_id, count(o.c_custkey) AS cnt, count(o.c_custkey) * 1e6 / 40000 AS density FROM zone z LEFT JOIN
    (SELECT c.c_custkey, min(CAST(z.n_nationkey AS VARCHAR)) AS k FROM cust c JOIN zone z ON {IN_ZONE} GROUP BY 1) o ON o.k = CAST(z.n_nationkey AS VARCHAR) GROUP BY 1""", "cust", "zone"))
def grid_owner_density(spark, sf):
    return spatial.grid_owner(i.zone_boxes(spark, sf), i.customer_points(spark, sf))


_PB = f"SELECT a.n_nationkey AS parcel, b.p_partkey AS bldg, {_W} * {_H} AS part, (b.xmax - b.xmin) * (b.ymax - b.ymin) AS whole, 1 + b.p_size % 5 AS floors FROM zone a JOIN box b ON {_W} > 0 AND {_H} > 0"


def _buildings(spark, sf):
    return Boxes(i.part_boxes(spark, sf).withColumn("floors", F.col("p_size") % 5 + 1), "p_partkey")


@query("indicators_area", sql(f"SELECT z.n_nationkey AS parcel, coalesce(sum(part), 0) AS bldg_area, coalesce(sum(part * floors), 0) AS floor_area, coalesce(sum(part * floors), 0) / 40000 AS far FROM zone z LEFT JOIN ({_PB}) ON parcel = n_nationkey GROUP BY 1", "zone", "box"))
def indicators_area(spark, sf):
    return spatial.buildings_by_parcel(i.zone_boxes(spark, sf), _buildings(spark, sf), "floors", "area")


@query("indicators_unique", sql(f"SELECT z.n_nationkey AS parcel, coalesce(sum(whole), 0) AS bldg_area, coalesce(sum(whole * floors), 0) AS floor_area, coalesce(sum(whole * floors), 0) / 40000 AS far FROM zone z LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY bldg ORDER BY part DESC, parcel) AS r FROM ({_PB})) ON parcel = n_nationkey AND r = 1 GROUP BY 1", "zone", "box"))
def indicators_unique(spark, sf):
    return spatial.buildings_by_parcel(i.zone_boxes(spark, sf), _buildings(spark, sf), "floors", "unique")


_PAIR = f"SELECT a.p_partkey AS a, b.p_partkey AS b, a.xmin = b.xmin AND a.ymin = b.ymin AND a.xmax = b.xmax AND a.ymax = b.ymax AS same, {_W} * {_H} AS area FROM box a JOIN box b ON a.p_partkey < b.p_partkey AND {_W} > 0 AND {_H} > 0"


@query("topo_overlaps", sql(f"SELECT a, b, CASE WHEN same THEN 'duplicate' ELSE 'overlap' END AS kind, area FROM ({_PAIR}) WHERE same OR area > 5", "box"))
def topo_overlaps(spark, sf):
    return spatial.topology(i.parts(spark, sf), 5.0)


@query("topo_slivers", sql("SELECT p_partkey, (xmax - xmin) * (ymax - ymin) AS area FROM box WHERE (xmax - xmin) * (ymax - ymin) <= 3", "box"))
def topo_slivers(spark, sf):
    area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
    return i.part_boxes(spark, sf).select("p_partkey", area.alias("area")).where(F.col("area") <= 3)


@query("bbox_filter", sql("SELECT p_partkey FROM box WHERE xmin <= 300 AND xmax >= 100 AND ymin <= 500 AND ymax >= 250", "box"))
def bbox_filter(spark, sf):
    return i.part_boxes(spark, sf).where("xmin <= 300 and xmax >= 100 and ymin <= 500 and ymax >= 250").select("p_partkey")


@query("clip_boxes", sql("SELECT p_partkey, greatest(xmin, 100) AS xmin, greatest(ymin, 250) AS ymin, least(xmax, 300) AS xmax, least(ymax, 500) AS ymax FROM box WHERE xmin < 300 AND xmax > 100 AND ymin < 500 AND ymax > 250", "box"))
def clip_boxes(spark, sf):
    kept = i.part_boxes(spark, sf).where("xmin < 300 and xmax > 100 and ymin < 500 and ymax > 250")
    return kept.select("p_partkey", F.greatest("xmin", F.lit(100.0)).alias("xmin"), F.greatest("ymin", F.lit(250.0)).alias("ymin"), F.least("xmax", F.lit(300.0)).alias("xmax"), F.least("ymax", F.lit(500.0)).alias("ymax"))


@query("spatial_filter_invert", sql(f"SELECT c_custkey FROM cust c WHERE NOT EXISTS (SELECT 1 FROM inner_ z WHERE {IN_ZONE})", "cust", "inner"))
def spatial_filter_invert(spark, sf):
    mask = Boxes(i.inner_boxes(spark, sf), "n_nationkey")
    hit = spatial.pairs(i.customer_points(spark, sf), mask, "intersects").select(F.col("left_id").alias("c_custkey")).distinct()
    return i.customers(spark, sf).select("c_custkey").join(hit, "c_custkey", "left_anti")


@query("nni", sql("""SELECT count(*) AS n, round(avg(d), 6) AS mean_distance, round(avg(d) / (0.5 / sqrt(count(*) / ((max(x) - min(x)) * (max(y) - min(y))))), 6) AS nni
    FROM (SELECT a.s_suppkey, any_value(a.x) AS x, any_value(a.y) AS y, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM supp a JOIN supp b ON a.s_suppkey <> b.s_suppkey GROUP BY 1)""", "supp"))
def nni(spark, sf):
    out = spatial.nearest_neighbour_index(i.supplier_points(spark, sf))
    return out.select("n", F.round("mean_distance", 6).alias("mean_distance"), F.round("nni", 6).alias("nni"))


_NEAR = "near AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supp a JOIN supp b ON a.s_suppkey <> b.s_suppkey AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000)"
_Z = "z AS (SELECT s_suppkey AS id, s_acctbal - (SELECT avg(s_acctbal) FROM supplier) AS z FROM supplier)"


@query("moran_global", f"WITH {i.SQL['supp']}, {_NEAR}, {_Z} SELECT (SELECT count(*) FROM z) AS n, (SELECT count(*) FROM near) AS weights, round((SELECT count(*) FROM z) / (SELECT count(*) FROM near) * (SELECT sum(p.z * q.z) FROM near JOIN z p ON p.id = a JOIN z q ON q.id = b) / (SELECT sum(z * z) FROM z), 6) AS moran_i")
def moran_global(spark, sf):
    out = analysis.moran(i.supplier_points(spark, sf), "s_acctbal", 100.0)
    return out.select("n", "weights", F.round("moran_i", 6).alias("moran_i"))


@query("moran_local", f"WITH {i.SQL['supp']}, {_NEAR}, {_Z}, w AS (SELECT a, count(*) AS k, sum(z) AS wz FROM near JOIN z ON id = b GROUP BY 1) SELECT id, round(CASE WHEN k > 0 THEN ((SELECT count(*) FROM z) - 1) * z * wz / k / (SELECT sum(z * z) FROM z) ELSE 0 END, 6) + 0.0 AS local_i FROM z LEFT JOIN w ON a = id")
def moran_local(spark, sf):
    return analysis.local_moran(i.supplier_points(spark, sf), "s_acctbal", 100.0).select("id", (F.round("local_i", 6) + 0.0).alias("local_i"))


@query("getis_ord", f"""WITH {i.SQL['supp']}, near AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supp a JOIN supp b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 10000), {_Z},
    w AS (SELECT a, count(*) AS k, sum(z) AS wz FROM near JOIN z ON id = b GROUP BY 1), t AS (SELECT count(*) AS n, sqrt(avg(z * z)) AS s FROM z)
    SELECT a AS id, round(wz / (s * sqrt((n * k - k * k) / (n - 1))), 6) + 0.0 AS gi_star FROM w, t""")
def getis_ord(spark, sf):
    return analysis.getis_ord(i.supplier_points(spark, sf), "s_acctbal", 100.0).select("id", (F.round("gi_star", 6) + 0.0).alias("gi_star"))


@query("kde_grid", sql("""SELECT CAST(r AS INTEGER) AS "row", CAST(k AS INTEGER) AS col, round(sum(exp(-((100 * k + 50 - x) * (100 * k + 50 - x) + (100 * r + 50 - y) * (100 * r + 50 - y)) / (2 * 150.0 * 150.0))) / (2 * pi() * 150.0 * 150.0) * 1e6, 6) AS density
    FROM range(10) a(r), range(10) b(k), supp GROUP BY 1, 2""", "supp"))
def kde_grid(spark, sf):
    out = analysis.kde(i.supplier_points(spark, sf), 150.0, 100.0, (0.0, 0.0, 1000.0, 1000.0))
    return out.withColumn("density", F.round("density", 6))


@query("dbscan_labels", sql("""SELECT CAST(s.s_suppkey AS VARCHAR) AS id, coalesce('cluster:' || coalesce(o.root, min(n.root)), 'noise') AS cluster FROM supp s
    LEFT JOIN own o ON o.id = CAST(s.s_suppkey AS VARCHAR) LEFT JOIN (SELECT p.b AS id, own.root FROM pr p JOIN own ON own.id = p.a) n ON n.id = CAST(s.s_suppkey AS VARCHAR) GROUP BY s.s_suppkey, o.root""", "supp").replace(
    "WITH ", "WITH RECURSIVE ", 1).replace(" SELECT CAST(s.s_suppkey", """, pr AS (SELECT CAST(a.s_suppkey AS VARCHAR) AS a, CAST(b.s_suppkey AS VARCHAR) AS b FROM supp a JOIN supp b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4900),
    core AS (SELECT a AS id FROM pr GROUP BY 1 HAVING count(*) >= 3), link AS (SELECT pr.a, pr.b FROM pr JOIN core c ON c.id = pr.a JOIN core d ON d.id = pr.b),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id), own AS (SELECT id, min(root) AS root FROM reach GROUP BY 1) SELECT CAST(s.s_suppkey""", 1))
def dbscan_labels(spark, sf):
    return analysis.dbscan(i.supplier_points(spark, sf), 70.0, 3)
