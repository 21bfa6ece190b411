"""Queries on polygons with slanted sides, holes and several parts, derived from the driver's keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import polygons
from . import inputs as i

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


#: A zone's polygon, from the zone's corner: a shell that isn't convex and a hole, counter-clockwise.
SHELL, HOLE = [(20, 10), (190, 40), (170, 180), (90, 120), (30, 190)], [(80, 60), (120, 70), (100, 100)]


def _ring(x, y, offsets):
    return F.array(*(F.struct((x + a).cast("double").alias("x"), (y + b).cast("double").alias("y")) for a, b in offsets))


def zone_polygons(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("xmin"), F.col("ymin")
    return i.zones(spark, sf).select("n_nationkey", F.array(F.array(_ring(x, y, SHELL), _ring(x, y, HOLE))).alias("parts"))


def part_polygons(spark: SparkSession, sf: str) -> DataFrame:
    """A triangle, written clockwise; every seventh has a second one to the right of it."""
    x, y = F.col("xmin"), F.col("ymin")
    a, b = F.col("p_size") % 20 + 5, F.col("p_partkey") % 17 + 5
    ring = _ring(x, y, [(0, 0), (a - 3, b), (a, 2)])
    second = _ring(x + 30, y, [(0, 0), (a - 3, b), (a, 2)])
    return i.part_boxes(spark, sf).select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.array(F.array(ring), F.array(second))).otherwise(F.array(F.array(ring))).alias("parts"))


def mesh(spark: SparkSession, sf: str) -> DataFrame:
    """Slanted cells that share corners; the cells of odd columns end half-way up those beside them."""
    n = F.col("n_nationkey")
    c, r = n % 5, F.floor(n / 5)
    corner = lambda a, b: F.struct((200 * a + 30 * b).cast("double").alias("x"), (200 * b + 10 * a).cast("double").alias("y"))
    ring = F.array(corner(c, r), corner(c + 1, r), corner(c + 1, r + 1), corner(c, r + 1))
    middle = F.struct((200 * (c + 1) + 30 * r + 15).cast("double").alias("x"), (200 * r + 10 * (c + 1) + 100).cast("double").alias("y"))
    more = F.array(corner(c, r), corner(c + 1, r), middle, corner(c + 1, r + 1), corner(c, r + 1))
    return i.load(spark, sf, "nation").select("n_nationkey", "n_regionkey", F.array(F.array(F.when(c % 2 == 1, more).otherwise(ring))).alias("parts"))


def _loop(points: list[tuple[int, int]]) -> str:
    return ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(points, [*points[1:], points[0]], strict=True))


_ZE = f"ze AS (SELECT n_nationkey AS id, xmin + a AS x1, ymin + b AS y1, xmin + c AS x2, ymin + d AS y2 FROM zone, (VALUES {_loop(SHELL)}, {_loop(HOLE[::-1])}) o(a, b, c, d))"
_PE = """pe AS (SELECT p_partkey AS id, xmin + s + x1 AS x1, ymin + y1 AS y1, xmin + s + x2 AS x2, ymin + y2 AS y2 FROM
    (SELECT p_partkey, xmin, ymin, s, CASE k WHEN 0 THEN 0 WHEN 1 THEN a ELSE a - 3 END AS x1, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE b END AS y1, CASE k WHEN 0 THEN a WHEN 1 THEN a - 3 ELSE 0 END AS x2, CASE k WHEN 0 THEN 2 WHEN 1 THEN b ELSE 0 END AS y2
     FROM (SELECT *, p_size % 20 + 5 AS a, p_partkey % 17 + 5 AS b FROM box) JOIN (VALUES (0), (30)) v(s) ON s = 0 OR p_partkey % 7 = 0, (VALUES (0), (1), (2)) w(k)))"""
#: Signed area under two edges over their common stretch of x.
_UNDER = """both_ AS (SELECT l.id AS l, r.id AS r, sign(l.x1 - l.x2) * sign(r.x1 - r.x2) AS s, greatest(least(l.x1, l.x2), least(r.x1, r.x2)) AS lo, least(greatest(l.x1, l.x2), greatest(r.x1, r.x2)) AS hi,
        l.x1 AS a, l.y1 AS b, (l.y2 - l.y1) / (l.x2 - l.x1) AS m, r.x1 AS c, r.y1 AS d, (r.y2 - r.y1) / (r.x2 - r.x1) AS n
        FROM pe l JOIN ze r ON l.x1 <> l.x2 AND r.x1 <> r.x2 AND greatest(least(l.x1, l.x2), least(r.x1, r.x2)) < least(greatest(l.x1, l.x2), greatest(r.x1, r.x2))),
    under AS (SELECT l, r, s * (hi - lo) AS w, d + n * (lo - c) AS v0, d + n * (hi - c) AS v1, b + m * (lo - a) - (d + n * (lo - c)) AS d0, b + m * (hi - a) - (d + n * (hi - c)) AS d1 FROM both_),
    pair AS (SELECT l, r, sum(w * ((v0 + v1) / 2 + CASE WHEN d0 <= 0 AND d1 <= 0 THEN (d0 + d1) / 2 WHEN d0 >= 0 AND d1 >= 0 THEN 0 ELSE -least(d0, d1) * least(d0, d1) / (2 * abs(d1 - d0)) END)) AS area FROM under GROUP BY l, r),
    size AS (SELECT id, sum(x1 * y2 - x2 * y1) / 2 AS area FROM pe GROUP BY id)"""


def _sql(body: str, *ctes: str) -> str:
    return f"WITH {i.SQL['zone']}, {i.SQL['box']}, {i.SQL['cust']}, {', '.join([_ZE, _PE, *ctes])} {body}"


def _zones(spark, sf):
    return polygons.prepared(zone_polygons(spark, sf), "n_nationkey")


def _parts(spark, sf):
    return polygons.prepared(part_polygons(spark, sf), "p_partkey")


@query("poly_measures", _sql("""SELECT id, sum(x1 * y2 - x2 * y1) / 2 AS area, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS perimeter,
    round(sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cx, round(sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)), 6) AS cy FROM pe GROUP BY id"""))
def poly_measures(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return polygons.measures(part_polygons(spark, sf), "p_partkey").select("id", "area", r("perimeter"), r("cx"), r("cy"))


_CROSSED = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"
_ON = "(x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)"


@query("poly_points", _sql(f"SELECT id AS polygon_id, count(*) AS cnt, round(sum(c_acctbal), 4) AS total FROM (SELECT id, c_custkey, c_acctbal FROM ze JOIN cust ON y BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY ALL HAVING bool_or({_ON}) OR count(*) FILTER ({_CROSSED}) % 2 = 1) GROUP BY id"))
def poly_points(spark, sf):
    found = polygons.points_in(_zones(spark, sf), i.customer_points(spark, sf))
    balance = i.load(spark, sf, "customer").select(F.col("c_custkey").alias("point_id"), "c_acctbal")
    return found.join(balance, "point_id").groupBy("polygon_id").agg(F.count("*").alias("cnt"), F.round(F.sum("c_acctbal"), 4).alias("total"))


@query("poly_overlay", _sql("SELECT l AS left_id, r AS right_id, round(pair.area + 1e-7, 4) AS area FROM pair JOIN size ON id = l WHERE pair.area > 1e-6", _UNDER))
def poly_overlay(spark, sf):
    return polygons.overlay(_parts(spark, sf), _zones(spark, sf)).select("left_id", "right_id", F.round(F.col("area") + 1e-7, 4).alias("area"))  # off the ties of rounding


@query("poly_within", _sql("SELECT l AS left_id, r AS right_id FROM pair JOIN size ON id = l WHERE pair.area >= size.area - 1e-6", _UNDER))
def poly_within(spark, sf):
    return polygons.join_pairs(_parts(spark, sf), _zones(spark, sf), "within")


@query("poly_difference", _sql("SELECT left_id, area, round(area - coalesce(s, 0) + 1e-7, 4) AS rest FROM (SELECT id AS left_id, any_value(size.area) AS area, sum(pair.area) FILTER (pair.area > 1e-6) AS s FROM size LEFT JOIN pair ON id = l GROUP BY id)", _UNDER))
def poly_difference(spark, sf):
    return polygons.overlay_areas(_parts(spark, sf), _zones(spark, sf)).select("left_id", "area", F.round(F.col("rest") + 1e-7, 4).alias("rest"))


def _turn(e: str, p: str, k: int) -> str:
    return f"sign(({e}.x2 - {e}.x1) * ({p}.y{k} - {e}.y1) - ({e}.y2 - {e}.y1) * ({p}.x{k} - {e}.x1))"


_MEET = f"""SELECT DISTINCT p.id AS left_id, z.id AS right_id FROM pe p JOIN ze z ON greatest(p.x1, p.x2) >= least(z.x1, z.x2) AND greatest(z.x1, z.x2) >= least(p.x1, p.x2) AND greatest(p.y1, p.y2) >= least(z.y1, z.y2)
    AND greatest(z.y1, z.y2) >= least(p.y1, p.y2) AND {_turn('p', 'z', 1)} * {_turn('p', 'z', 2)} <= 0 AND {_turn('z', 'p', 1)} * {_turn('z', 'p', 2)} <= 0"""


@query("poly_intersects", _sql(f"{_MEET} UNION SELECT l, r FROM pair WHERE area > 1e-6", _UNDER))
def poly_intersects(spark, sf):
    return polygons.join_pairs(_parts(spark, sf), _zones(spark, sf), "intersects")


_MESH = """cell AS (SELECT n_regionkey, n_nationkey % 5 AS c, n_nationkey // 5 AS r FROM nation), corner AS (SELECT n_regionkey, unnest([0, 1, 1, 0]) AS a0, unnest([0, 0, 1, 1]) AS b0, unnest([1, 1, 0, 0]) AS a1, unnest([0, 1, 1, 0]) AS b1, c, r FROM cell),
    side AS (SELECT n_regionkey AS g, 200 * (c + a0) + 30 * (r + b0) AS x1, 200 * (r + b0) + 10 * (c + a0) AS y1, 200 * (c + a1) + 30 * (r + b1) AS x2, 200 * (r + b1) + 10 * (c + a1) AS y2 FROM corner)"""


@query("poly_dissolve", f"""WITH {_MESH} SELECT g AS n_regionkey, CAST(sum(x1 * y2 - x2 * y1) AS DOUBLE) / 2 AS area, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))
    FILTER (NOT EXISTS (SELECT 1 FROM side t WHERE t.g = s.g AND t.x1 = s.x2 AND t.y1 = s.y2 AND t.x2 = s.x1 AND t.y2 = s.y1)), 6) AS perimeter FROM side s GROUP BY g""")
def poly_dissolve(spark, sf):
    return polygons.dissolve(mesh(spark, sf), "n_regionkey").select("n_regionkey", "area", F.round("perimeter", 6).alias("perimeter"))


@query("poly_gaps", f"WITH {_MESH} SELECT sum(x1 * y2 - x2 * y1) / 2.0 AS area FROM (SELECT c, r, 200 * (c + a0) + 30 * (r + b0) AS x1, 200 * (r + b0) + 10 * (c + a0) AS y1, 200 * (c + a1) + 30 * (r + b1) AS x2, 200 * (r + b1) + 10 * (c + a1) AS y2 FROM corner WHERE (c, r) IN ((1, 1), (3, 2))) GROUP BY c, r")
def poly_gaps(spark, sf):
    """Two cells are left out of the mesh: nations 6 and 13."""
    return polygons.gaps(mesh(spark, sf).where("n_nationkey not in (6, 13)")).select("area")
