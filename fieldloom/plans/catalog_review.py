"""Queries on keys, labels, exact sums, seams, band stacks, surfaces and large derived layers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import _NARROW, _WIDE, pointer
from ..operators import aggregates, conflation, graph, joins, labels, raster, spatial
from ..operators.raster import Grid
from ..operators.spatial import points
from . import catalog_raster as r
from . import inputs as i
from .inputs import GRID, sql

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


@query("keys_floats_and_wide", "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def keys_floats_and_wide(spark, sf):
    """Floating-point keys against full-width digits with leading zeros."""
    left = i.load(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("c_custkey"))
    right = i.load(spark, sf, "supplier").select(F.translate(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), _NARROW, _WIDE).alias("key"), "s_name")
    return joins.keyed_join(left, right, "c_custkey", "key", "id", "inner").select("c_custkey", "s_name")


_RULES = [labels.Rule(r"Brand#(?P<maker>[1-3])(?P<line>\d)", layers=("s0", "s1")), labels.Rule(r"Brand#\d+", "other", layers=("s2",), tags=("t0",)), labels.Rule(r"Brand#(?P<line>\d)\d", tags=("t1",))]


@query("label_rules", r"""SELECT p_partkey, (p_size % 4 < 3 OR p_partkey % 3 < 2) AS relevant, CASE WHEN p_size % 4 < 2 THEN nullif(regexp_extract(p_brand, '^Brand#([1-3])(\d)$', 1), '') END AS maker,
    coalesce(CASE WHEN p_size % 4 < 2 THEN nullif(regexp_extract(p_brand, '^Brand#([1-3])(\d)$', 2), '') END, CASE WHEN p_partkey % 3 = 1 THEN nullif(regexp_extract(p_brand, '^Brand#(\d)\d$', 1), '') END) AS line,
    CASE WHEN (p_size % 4 = 2 OR p_partkey % 3 = 0) AND regexp_full_match(p_brand, 'Brand#\d+') THEN p_brand END AS other FROM part""")
def label_rules(spark, sf):
    rows = i.load(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), F.translate("p_brand", _NARROW, _WIDE), F.lit("　")).alias("text"), F.concat(F.lit("s"), F.col("p_size") % 4).alias("layer"), F.concat(F.lit("t"), F.col("p_partkey") % 3).alias("tag"))
    return labels.classify(rows, _RULES).select("p_partkey", "relevant", "maker", "line", "other")


@query("landuse_classes", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'homes' WHEN 1 THEN 'dense homes' WHEN 2 THEN 'homes' WHEN 3 THEN 'trade' END AS class FROM part")
def landuse_classes(spark, sf):
    kinds = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("prefix"), F.lit(n).alias("name")) for p, n in (("R", "homes"), ("R1", "dense homes"), ("C", "trade"))))))
    code = F.element_at(F.array(*map(F.lit, ("R0+C1", "R12/R", "R", "C3、R1", "X"))), F.col("p_size") % 5 + 1)
    return labels.by_longest_prefix(i.load(spark, sf, "part").select("p_partkey", code.alias("code")), "code", kinds).select("p_partkey", "class")


@query("exact_sums", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice * 1099511627776 AS HUGEINT)) AS DOUBLE) / 1099511627776 AS total FROM lineitem GROUP BY ALL")
def exact_sums(spark, sf):
    return aggregates.exact_sum(i.load(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


@query("json_pointer", "SELECT event_id, nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '') AS k, CAST(NULL AS VARCHAR) AS none FROM events")
def json_pointer(spark, sf):
    return i.load(spark, sf, "events").select("event_id", pointer(F.col("props"), "/k").alias("k"), pointer(F.col("props"), "/k~1x/0").alias("none"))


@query("raster_clip", sql(f'SELECT "row", col, CASE WHEN EXISTS (SELECT 1 FROM zone z WHERE n_nationkey % 2 = 0 AND {r._CELLS_IN}) THEN value END AS value FROM cell', "zone", "cell"))
def raster_clip(spark, sf):
    return raster.clip(i.cells(spark, sf), r._BIG, i.zones(spark, sf).where("n_nationkey % 2 = 0"), "n_nationkey")


@query("raster_stack", f'{r._AB} SELECT "row", col, p AS band_1, q AS band_2 FROM ab')
def raster_stack(spark, sf):
    return raster.stack([r._a(spark, sf), r._b(spark, sf)])


@query("raster_split", f'{r._AB} SELECT 1 AS band, "row", col, p AS value FROM ab UNION ALL SELECT 2, "row", col, q FROM ab')
def raster_split(spark, sf):
    return raster.split_bands(raster_stack(spark, sf))


@query("raster_calibrate", sql('SELECT "row", col, value * 0.5::DOUBLE + 3::DOUBLE AS value FROM cell', "cell"))
def raster_calibrate(spark, sf):
    return raster.calibrate(i.cells(spark, sf), 0.5, 3.0)


_NEAR = 'abs(n."row" - c."row") <= 1 AND abs(n.col - c.col) <= 1 AND (n."row" <> c."row" OR n.col <> c.col)'
_FAR = 'sqrt(power(n."row" - c."row", 2) + power(n.col - c.col, 2))'
_DOWN = f'down AS (SELECT c."row", c.col, n."row" AS to_row, n.col AS to_col, row_number() OVER (PARTITION BY c."row", c.col ORDER BY -((c.value - n.value) / {_FAR}), n."row", n.col) AS k FROM cell c JOIN cell n ON {_NEAR} AND n.value < c.value)'


@query("raster_flow", sql('SELECT c."row", c.col, to_row, to_col FROM cell c LEFT JOIN (SELECT * FROM down WHERE k = 1) d ON d."row" = c."row" AND d.col = c.col', "cell").replace(" SELECT c.", f", {_DOWN} SELECT c.", 1))
def raster_flow(spark, sf):
    return raster.flow_direction(i.cells(spark, sf), GRID)


@query("raster_accumulation", f"""WITH RECURSIVE {i.SQL['cell']}, {_DOWN}, way("row", col) AS (SELECT "row", col FROM cell UNION ALL SELECT to_row, to_col FROM way JOIN down USING ("row", col) WHERE k = 1)
    SELECT "row", col, count(*) AS cells FROM way GROUP BY ALL""")
def raster_accumulation(spark, sf):
    return raster.flow_accumulation(raster_flow(spark, sf))


_STEP = f"{_FAR} + CASE WHEN n.value >= c.value THEN 0.001::DOUBLE WHEN (n.value - c.value) / {_FAR} >= -50 THEN 0::DOUBLE ELSE -0.002::DOUBLE END * (n.value - c.value) + 0.5 * {_FAR}"
_WALK = f'step AS (SELECT c."row" * 64 + c.col AS u, n."row" * 64 + n.col AS v, {_STEP} AS w FROM cell c JOIN cell n ON {_NEAR})'


@query("walk_costs", f"""WITH RECURSIVE {i.SQL['cell']}, {_WALK}, way(origin, node, cost) AS (SELECT o, o, 0::DOUBLE FROM (VALUES (650), (2080), (3000)) t(o) UNION ALL SELECT origin, v, cost + w FROM way JOIN step ON u = node WHERE cost + w <= 5)
    SELECT CAST(origin AS BIGINT) AS origin, CAST(node AS BIGINT) AS node, round(min(cost), 6) AS cost FROM way GROUP BY ALL""")
def walk_costs(spark, sf):
    """Within 5 seconds of three cells, over ground of even friction."""
    heights = i.cells(spark, sf)
    arcs = raster.walk_arcs(heights, heights.withColumn("value", F.lit(0.5)), GRID, (1.0, 0.001, 0.0, -0.002), -50.0)
    origins = spark.createDataFrame([(650,), (2080,), (3000,)], "origin long")
    costs = graph.od_costs(arcs.select("arc", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "cost"), origins, budget=5.0)
    return costs.select("origin", "node", F.round("cost", 6).alias("cost"))


def _chain(spark, sf, shift: int):
    n = F.col("n_nationkey")
    c, row = n % 5, F.floor(n / 5)
    at = lambda a: F.struct((100 * a + shift).cast("double").alias("x"), (100 * row + 7 * a + shift).cast("double").alias("y"))
    return i.load(spark, sf, "nation").select(n.alias("id"), F.array(at(c), at(c + 1)).alias("line"))


@query("edge_match", "SELECT n AS id, 100.0::DOUBLE * c + s AS x1, 100.0::DOUBLE * r + 7 * c + s AS y1, 100.0::DOUBLE * (c + 1) + t AS x2, 100.0::DOUBLE * r + 7 * (c + 1) + t AS y2 FROM (SELECT n_nationkey AS n, n_nationkey % 5 AS c, n_nationkey // 5 AS r, CASE WHEN n_nationkey % 5 % 2 = 0 THEN 2 ELSE 0 END AS s, CASE WHEN n_nationkey % 5 IN (1, 3) THEN 2 ELSE 0 END AS t FROM nation)")
def edge_match(spark, sf):
    """Chains of lines: the first ends of every other line move, and the ends before them."""
    lines, reference = _chain(spark, sf, 0), _chain(spark, sf, 2)
    approved = lines.where("id % 5 % 2 = 0").select(F.col("id").alias("source_id"), F.lit(0).alias("source_end"), F.col("id").alias("target_id"), F.lit(0).alias("target_end"))
    out = conflation.edge_match(lines, reference, approved, 3.0)
    return out.select("id", F.col("line")[0]["x"].alias("x1"), F.col("line")[0]["y"].alias("y1"), F.col("line")[1]["x"].alias("x2"), F.col("line")[1]["y"].alias("y2"))


# --- tables of the size of lineitem and orders, and a raster of a million cells ---------------------------------------

_LX, _LY = "(l_orderkey * 7919 + l_linenumber * 13) % 1000", "(l_partkey * 104729 + l_linenumber) % 1000"


_PLACES = f"(SELECT {_LX} AS x, {_LY} AS y, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)"


def line_points(spark, sf):
    """The places of all line items, with their quantity."""
    place = lambda e, c: F.expr(e).cast("double").alias(c)
    rows = i.load(spark, sf, "lineitem").groupBy(place(_LX, "x"), place(_LY, "y")).agg(F.sum("l_quantity").alias("q"))
    return points(rows.withColumn("place", F.col("x") * 1000 + F.col("y")), "place")


@query("lineitem_zones", sql(f"SELECT n_nationkey AS zone_id, count(x) AS cnt, sum(q) AS total FROM zone LEFT JOIN {_PLACES} ON x > xmin AND x < xmax AND y > ymin AND y < ymax GROUP BY 1", "zone"))
def lineitem_zones(spark, sf):
    return spatial.zone_cross(i.zone_boxes(spark, sf), line_points(spark, sf), "q")


@query("lineitem_parts", sql(f"SELECT p_partkey AS left_id, count(x) AS match_count, sum(q) AS value FROM box JOIN {_PLACES} ON x >= xmin AND x <= xmax AND y >= ymin AND y <= ymax GROUP BY 1", "box"))
def lineitem_parts(spark, sf):
    """Places of all line items in the boxes of all parts."""
    return spatial.spatial_join(i.parts(spark, sf), line_points(spark, sf), "q", "sum", how="inner")


@query("orders_chains", "SELECT min(o_orderkey) AS root, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def orders_chains(spark, sf):
    """Components of the graph that links each order to its customer's next one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    links = i.load(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")
    return graph.connected_components(links, "a", "b").groupBy("root").agg(F.count("*").alias("n"))


_WIDE_GRID = Grid(1024, 1024, 0.0, 1024.0)
_WIDE_SQL = """got AS (SELECT l_orderkey % 1024 AS "row", (l_partkey * 7 + l_suppkey) % 1024 AS col, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
    cell AS (SELECT CAST(x.r AS INTEGER) AS "row", CAST(y.c AS INTEGER) AS col, CAST((x.r * 37 + y.c * 91) % 101 + coalesce(q, 0) AS DOUBLE) AS value FROM range(1024) x(r) CROSS JOIN range(1024) y(c) LEFT JOIN got ON got."row" = x.r AND got.col = y.c)"""


def wide_cells(spark, sf):
    got = i.load(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 1024).cast("int").alias("row"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 1024).cast("int").alias("col")).agg(F.sum("l_quantity").alias("q"))
    value = (F.col("row") * 37 + F.col("col") * 91) % 101 + F.coalesce("q", F.lit(0.0))
    return _WIDE_GRID.frame(spark).join(got, ["row", "col"], "left").select("row", "col", value.cast("double").alias("value"))


@query("raster_wide_relief", f"""WITH {_WIDE_SQL}, near AS (SELECT "row" + dr AS "row", col + dc AS col, max(value) - min(value) AS relief, count(*) AS k FROM cell, (VALUES (-1), (0), (1)) x(dr), (VALUES (-1), (0), (1)) y(dc) GROUP BY 1, 2)
    SELECT CAST("row" // 128 AS INTEGER) AS r, CAST(col // 128 AS INTEGER) AS c, count(*) FILTER (k = 9) AS n, sum(CASE WHEN k = 9 THEN relief END) AS relief FROM near WHERE "row" BETWEEN 0 AND 1023 AND col BETWEEN 0 AND 1023 GROUP BY ALL""")
def raster_wide_relief(spark, sf):
    """Relief of a million cells, summed by squares of 128."""
    out = raster.terrain(wide_cells(spark, sf), _WIDE_GRID)
    return out.groupBy(F.expr("cast(row div 128 as int)").alias("r"), F.expr("cast(col div 128 as int)").alias("c")).agg(F.count("relief").alias("n"), F.sum("relief").alias("relief"))
