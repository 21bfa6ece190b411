"""Queries on cell relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from ..operators.raster import Grid
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


#: Two partial grids from all rows: cells whose sum is a multiple of three are missing.
_A = "a AS (SELECT CAST(l_orderkey % 64 AS INTEGER) AS \"row\", CAST(l_partkey % 64 AS INTEGER) AS col, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS DOUBLE) AS value FROM lineitem GROUP BY ALL HAVING value % 3 > 0)"
_B = _A.replace("a AS", "b AS", 1).replace("'R'", "'A'")
_FRAME = "frame AS (SELECT CAST(r AS INTEGER) AS \"row\", CAST(c AS INTEGER) AS col FROM range(64) x(r), range(64) y(c))"
_AB = f"WITH {_A}, {_B}, ab AS (SELECT coalesce(a.\"row\", b.\"row\") AS \"row\", coalesce(a.col, b.col) AS col, a.value AS p, b.value AS q FROM a FULL JOIN b ON a.\"row\" = b.\"row\" AND a.col = b.col)"


def _a(spark, sf):
    return i.cells(spark, sf, value="case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end").where("value % 3 > 0")


def _b(spark, sf):
    return i.cells(spark, sf, value="case when l_returnflag = 'A' then cast(l_quantity as bigint) else 0 end").where("value % 3 > 0")


def _framed(spark, sf):
    return GRID.frame(spark).join(_a(spark, sf), ["row", "col"], "left")


_FA = f'WITH {_A}, {_FRAME}, f AS (SELECT frame."row", frame.col, value FROM frame LEFT JOIN a ON a."row" = frame."row" AND a.col = frame.col)'


@query("raster_histogram", sql("SELECT value, count(*) AS cnt FROM cell GROUP BY 1", "cell"))
def histogram(spark, sf):
    return raster.histogram(i.cells(spark, sf))


@query("raster_summary", f"{_FA} SELECT count(value) AS valid, count(*) - count(value) AS missing, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM f")
def summary(spark, sf):
    return raster.summary(_framed(spark, sf)).withColumn("mean", F.round("mean", 6))


_CELLS_IN = 'col + 0.5 >= z.xmin / 15.625 AND col + 0.5 < z.xmax / 15.625 AND (64 - "row" - 0.5) > z.ymin / 15.625 AND (64 - "row" - 0.5) <= z.ymax / 15.625'
_BIG = Grid(64, 64, 0.0, 1000.0, 15.625, 15.625)


@query("raster_zonal", sql(f"SELECT z.n_nationkey, count(value) AS valid_pixels, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM zone z LEFT JOIN cell ON {_CELLS_IN} GROUP BY 1", "zone", "cell"))
def zonal(spark, sf):
    out = raster.zonal(i.cells(spark, sf), _BIG, i.zones(spark, sf), "n_nationkey")
    return out.select("n_nationkey", "valid_pixels", F.round("sum", 4).alias("sum"), F.round("mean", 6).alias("mean"), "min", "max")


_SHARE = '((least(z.xmax, (col + 1) * 15.625) - greatest(z.xmin, col * 15.625)) * (least(z.ymax, 1000 - "row" * 15.625) - greatest(z.ymin, 1000 - ("row" + 1) * 15.625)) / (15.625 * 15.625))'
_TOUCH = 'z.xmax > col * 15.625 AND z.xmin < (col + 1) * 15.625 AND z.ymax > 1000 - ("row" + 1) * 15.625 AND z.ymin < 1000 - "row" * 15.625'


@query("raster_zonal_fractional", sql(f"SELECT z.n_nationkey, count(value) AS valid_pixels, round(sum({_SHARE}), 6) AS weight, round(sum(value * {_SHARE}), 4) AS sum FROM zone z LEFT JOIN cell ON {_TOUCH} GROUP BY 1", "zone", "cell"))
def zonal_fractional(spark, sf):
    out = raster.zonal(i.cells(spark, sf), _BIG, i.zones(spark, sf), "n_nationkey", "fractional")
    return out.select("n_nationkey", "valid_pixels", F.round("weight", 6).alias("weight"), F.round("sum", 4).alias("sum"))


@query("raster_transition", f"{_AB} SELECT p AS before, q AS after, count(*) AS pixels FROM ab GROUP BY 1, 2")
def transition(spark, sf):
    return raster.transition(_a(spark, sf), _b(spark, sf))


@query("raster_class_area", sql(f"SELECT z.n_nationkey, floor(value / 500) AS category, round(count(*) * 15.625 * 15.625, 4) AS area FROM zone z JOIN cell ON {_CELLS_IN} GROUP BY 1, 2", "zone", "cell"))
def class_area(spark, sf):
    classes = i.cells(spark, sf).withColumn("value", F.floor(F.col("value") / 500).cast("double"))
    return raster.class_area(classes, _BIG, i.zones(spark, sf), "n_nationkey").withColumn("area", F.round("area", 4))


@query("raster_zonal_fill", sql(f'SELECT "row", col, round(avg(value) OVER (PARTITION BY z.n_nationkey), 6) AS value FROM cell JOIN zone z ON {_CELLS_IN}', "zone", "cell"))
def zonal_fill(spark, sf):
    return raster.zonal_fill(i.cells(spark, sf), _BIG, i.zones(spark, sf), "n_nationkey").withColumn("value", F.round("value", 6))


@query("raster_aggregate_mean", f'{_FA} SELECT CAST("row" // 5 AS INTEGER) AS "row", CAST(col // 5 AS INTEGER) AS col, CASE WHEN count(value) / count(*) >= 0.5 THEN round(avg(value), 6) END AS value FROM f GROUP BY 1, 2')
def aggregate_mean(spark, sf):
    return raster.aggregate(_framed(spark, sf), GRID, 5, "mean", "partial", 0.5).select("row", "col", F.round("value", 6).alias("value"))


@query("raster_aggregate_mode", f"""{_FA}, g AS (SELECT "row" // 4 AS r, col // 4 AS c, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY ALL)
    SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, arg_min(value, (-n, value)) AS value FROM g GROUP BY 1, 2""")
def aggregate_mode(spark, sf):
    return raster.aggregate(_framed(spark, sf), GRID, 4, "mode", "truncate", 0.0).where("value is not null").select("row", "col", "value")


@query("raster_combine_ignore", f'{_AB} SELECT "row", col, (coalesce(p, 0) + coalesce(q, 0)) / ((p IS NOT NULL)::INT + (q IS NOT NULL)::INT) AS value FROM ab')
def combine_ignore(spark, sf):
    return raster.combine([_a(spark, sf), _b(spark, sf)], "mean", nodata="ignore")


@query("raster_combine_weighted", f'{_AB} SELECT "row", col, (coalesce(p, 0) + 3 * coalesce(q, 0)) / ((p IS NOT NULL)::INT + 3 * (q IS NOT NULL)::INT) AS value FROM ab')
def combine_weighted(spark, sf):
    return raster.combine([_a(spark, sf), _b(spark, sf)], "weighted_mean", [1.0, 3.0], "ignore")


@query("raster_combine_divide", f'{_AB} SELECT "row", col, CASE WHEN p IS NOT NULL AND q IS NOT NULL AND q <> 0 THEN p / q END AS value FROM ab')
def combine_divide(spark, sf):
    return raster.combine([_a(spark, sf), _b(spark, sf)], "divide", invalid="nodata")


@query("raster_combine_where", f'{_AB} SELECT "row", col, CASE WHEN p <> 40 THEN p WHEN p = 40 THEN q END AS value FROM ab')
def combine_where(spark, sf):
    a = _a(spark, sf)
    return raster.combine([a.withColumn("value", (F.col("value") != 40).cast("double")), a, _b(spark, sf)], "where")


@query("raster_class_combine", f'{_AB}, k AS (SELECT "row", col, p > 40 AS x, q > 40 AS y FROM ab), d AS (SELECT x, y, row_number() OVER (ORDER BY x, y) AS code FROM (SELECT DISTINCT x, y FROM k WHERE x IS NOT NULL AND y IS NOT NULL)) SELECT "row", col, CAST(code AS INTEGER) AS code FROM k LEFT JOIN d ON d.x = k.x AND d.y = k.y')
def class_combine(spark, sf):
    high = lambda g: g.withColumn("value", (F.col("value") > 40).cast("double"))
    return raster.class_combine([high(_a(spark, sf)), high(_b(spark, sf))])


@query("raster_classify", sql('SELECT "row", col, CASE WHEN value = 390 THEN 7 WHEN value >= 100 AND value < 300 THEN 1 WHEN value >= 300 AND value <= 500 THEN 2 WHEN value > 500 THEN value ELSE value END::DOUBLE AS value FROM cell', "cell"))
def classify(spark, sf):
    rules = [{"value": 390, "output": 7}, {"min": 100, "max": 300, "output": 1}, {"min": 300, "max": 500, "closed": "both", "output": 2}]
    return raster.classify(i.cells(spark, sf), rules, "keep", "first")


@query("raster_minmax", sql('SELECT "row", col, (value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()) AS value FROM cell', "cell"))
def minmax(spark, sf):
    return raster.transform(i.cells(spark, sf), "minmax")


@query("raster_zscore", sql('SELECT "row", col, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) + 0.0 AS value FROM cell', "cell"))
def zscore(spark, sf):
    return raster.transform(i.cells(spark, sf), "zscore").withColumn("value", F.round("value", 6) + 0.0)


@query("raster_clip_values", sql('SELECT "row", col, greatest(200, least(400, value)) AS value FROM cell', "cell"))
def clip_values(spark, sf):
    return raster.transform(i.cells(spark, sf), "clip", min=200, max=400)


@query("raster_auto_class", sql('SELECT "row", col, (1 + (value >= lo + (hi - lo) / 4)::INT + (value >= lo + (hi - lo) * 2 / 4)::INT + (value >= lo + (hi - lo) * 3 / 4)::INT)::DOUBLE AS value FROM cell, (SELECT min(value) AS lo, max(value) AS hi FROM cell)', "cell"))
def auto_class(spark, sf):
    return raster.transform(i.cells(spark, sf), "auto_class", classes=4, mode="equal")


@query("raster_calculate", sql('SELECT "row", col, CASE WHEN value * 2 + 1 >= 700 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM cell', "cell"))
def calculate(spark, sf):
    return raster.calculate(i.cells(spark, sf), 2, 1, 700)


@query("raster_sample", sql('SELECT c_custkey, value FROM cust LEFT JOIN cell ON col = floor(x / 15.625) AND "row" = floor((1000 - y) / 15.625)', "cust", "cell"))
def sample(spark, sf):
    return raster.sample(i.cells(spark, sf), _BIG, i.customers(spark, sf), "c_custkey")


@query("raster_mosaic_last", f'{_AB} SELECT "row", col, coalesce(q, p) AS value FROM ab')
def mosaic_last(spark, sf):
    return raster.mosaic([_a(spark, sf), _b(spark, sf)], "last")


@query("raster_mosaic_max", f'{_AB} SELECT "row", col, greatest(p, q) AS value FROM ab')
def mosaic_max(spark, sf):
    return raster.mosaic([_a(spark, sf), _b(spark, sf)], "max")


@query("raster_update_fill", f'{_FA}, {_B} SELECT f."row", f.col, coalesce(f.value, b.value) AS value FROM f LEFT JOIN b ON b."row" = f."row" AND b.col = f.col')
def update_fill(spark, sf):
    return raster.update(_framed(spark, sf), _b(spark, sf), "fill")


@query("raster_regrid", sql("""SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, round(sum(value * greatest(0, least(cell.col + 1, (c + 1) * 1.6) - greatest(cell.col, c * 1.6)) * greatest(0, least(cell."row" + 1, (r + 1) * 1.6) - greatest(cell."row", r * 1.6))), 4) AS value
    FROM cell JOIN range(40) a(r) ON (r + 1) * 1.6 > cell."row" AND r * 1.6 < cell."row" + 1 JOIN range(40) b(c) ON (c + 1) * 1.6 > cell.col AND c * 1.6 < cell.col + 1 GROUP BY 1, 2""", "cell"))
def regrid(spark, sf):
    return raster.regrid(i.cells(spark, sf), GRID, Grid(40, 40, 0.0, 64.0, 1.6, 1.6)).withColumn("value", F.round("value", 4))


@query("raster_resample_nearest", sql('SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, value FROM range(32) a(r), range(32) b(c) LEFT JOIN cell ON cell."row" = floor((r + 0.5) * 2) AND cell.col = floor((c + 0.5) * 2)', "cell"))
def resample_nearest(spark, sf):
    return raster.resample(i.cells(spark, sf), GRID, Grid(32, 32, 0.0, 64.0, 2.0, 2.0))


@query("raster_resample_bilinear", sql("""SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col, CASE WHEN count(value) = 4 THEN round(sum(value) / 4, 4) END AS value
    FROM range(32) a(r), range(32) b(c), range(2) d(p), range(2) e(q) LEFT JOIN cell ON cell."row" = r * 2 + p AND cell.col = c * 2 + q GROUP BY 1, 2""", "cell"))
def resample_bilinear(spark, sf):
    return raster.resample(i.cells(spark, sf), GRID, Grid(32, 32, 0.0, 64.0, 2.0, 2.0), "bilinear").withColumn("value", F.round("value", 4))


@query("raster_allocate_area", sql(f'SELECT z.n_nationkey, "row", col, round({_SHARE} / sum({_SHARE}) OVER (PARTITION BY z.n_nationkey) * total, 12) AS value FROM zone z JOIN cell ON {_TOUCH}', "zone", "cell"))
def allocate_area(spark, sf):
    return raster.allocate(i.cells(spark, sf), _BIG, i.zones(spark, sf), "n_nationkey", "total", "area").withColumn("value", F.round("value", 12))


@query("raster_allocate_integer", sql(f"""SELECT k AS n_nationkey, "row", col, (base + (rn <= total - sum(base) OVER (PARTITION BY k))::INT)::DOUBLE AS value FROM (
    SELECT *, floor(share) AS base, row_number() OVER (PARTITION BY k ORDER BY round(share - floor(share), 9) DESC, "row", col) AS rn FROM (
    SELECT z.n_nationkey AS k, z.total, "row", col, total / count(*) OVER (PARTITION BY z.n_nationkey) AS share FROM zone z JOIN cell ON {_TOUCH}))""", "zone", "cell"))
def allocate_integer(spark, sf):
    return raster.allocate(i.cells(spark, sf), _BIG, i.zones(spark, sf), "n_nationkey", "total", "uniform", integer=True)


@query("raster_focal_sum", f"""{_FA} SELECT f."row", f.col, CASE WHEN f.value IS NOT NULL AND count(n.value) >= 0.5 * count(n.col) THEN sum(n.value) END AS value
    FROM f JOIN f n ON abs(n."row" - f."row") <= 1 AND abs(n.col - f.col) <= 1 GROUP BY f."row", f.col, f.value""")
def focal_sum(spark, sf):
    return raster.focal(_framed(spark, sf), GRID, "sum", boundary="partial", min_coverage=0.5)


@query("raster_focal_median_pad", f"""{_FA} SELECT f."row", f.col, CASE WHEN count(n.value) >= 0.4 * 9 THEN quantile_cont(n.value, 0.5) END AS value
    FROM f JOIN f n ON abs(n."row" - f."row") <= 1 AND abs(n.col - f.col) <= 1 GROUP BY f."row", f.col""")
def focal_median_pad(spark, sf):
    return raster.focal(_framed(spark, sf), GRID, "median", boundary="pad", min_coverage=0.4, derive_missing=True)


_HORN = """g AS (SELECT f."row", f.col, count(n.value) AS k, sum(n.value * (n.col - f.col) * (2 - abs(n."row" - f."row"))) / 8 AS e, -sum(n.value * (n."row" - f."row") * (2 - abs(n.col - f.col))) / 8 AS o, max(n.value) - min(n.value) AS relief
    FROM cell f JOIN cell n ON abs(n."row" - f."row") <= 1 AND abs(n.col - f.col) <= 1 GROUP BY 1, 2)"""


@query("raster_slope", f"WITH {i.SQL['cell']}, {_HORN} SELECT \"row\", col, CASE WHEN k = 9 THEN round(degrees(atan(sqrt(e * e + o * o))), 6) END AS slope, CASE WHEN k = 9 AND (e <> 0 OR o <> 0) THEN round((degrees(atan2(-e, -o)) + 360) - 360 * floor((degrees(atan2(-e, -o)) + 360) / 360), 6) END AS aspect, CASE WHEN k = 9 THEN relief END AS relief FROM g")
def slope(spark, sf):
    out = raster.terrain(i.cells(spark, sf), GRID)
    return out.select("row", "col", F.round("slope", 6).alias("slope"), F.round("aspect", 6).alias("aspect"), "relief")


@query("raster_hillshade", f"WITH {i.SQL['cell']}, {_HORN} SELECT \"row\", col, CASE WHEN k = 9 THEN round(greatest(0, least(1, (-e * sin(radians(315)) * cos(radians(45)) - o * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(e * e + o * o + 1))), 6) END AS hillshade FROM g")
def hillshade(spark, sf):
    return raster.terrain(i.cells(spark, sf), GRID).select("row", "col", F.round("hillshade", 6).alias("hillshade"))


_LOW = "low AS (SELECT \"row\", col, CAST(\"row\" * 4294967296 + col AS BIGINT) AS id, floor(value / 60) AS value FROM cell)"
_BIT = "low AS (SELECT \"row\", col, CASE WHEN value > 370 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM cell)"


def _patches(spark, sf):
    return i.cells(spark, sf).withColumn("value", F.floor(F.col("value") / 60).cast("double"))


def _bits(spark, sf):
    return i.cells(spark, sf).withColumn("value", F.when(F.col("value") > 370, 1.0).otherwise(0.0))


for _k, _near in {4: "abs(a.\"row\" - b.\"row\") + abs(a.col - b.col) = 1", 8: "abs(a.\"row\" - b.\"row\") <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id"}.items():
    def _run(spark, sf, k=_k):
        return raster.regions(_patches(spark, sf), k)

    query(f"raster_regions_{_k}", f"WITH RECURSIVE {i.SQL['cell']}, {_LOW}, st AS (SELECT a.id AS p, b.id AS q FROM low a JOIN low b ON a.value = b.value AND {_near}), r(id, root) AS (SELECT id, id FROM low UNION SELECT st.q, r.root FROM r JOIN st ON st.p = r.id) SELECT \"row\", col, value, min(root) AS region FROM low JOIN r USING (id) GROUP BY 1, 2, 3")(_run)


@query("raster_sieve", f"""WITH RECURSIVE {i.SQL['cell']}, {_LOW}, st AS (SELECT a.id AS p, b.id AS q FROM low a JOIN low b ON a.value = b.value AND abs(a."row" - b."row") + abs(a.col - b.col) = 1), r(id, root) AS (SELECT id, id FROM low UNION SELECT st.q, r.root FROM r JOIN st ON st.p = r.id),
    m AS (SELECT id, min(root) AS region FROM r GROUP BY 1) SELECT "row", col, CASE WHEN count(*) OVER (PARTITION BY region) >= 3 THEN value END AS value FROM low JOIN m USING (id)""")
def sieve(spark, sf):
    return raster.sieve(_patches(spark, sf), GRID, 3.0)


@query("raster_morphology_dilate", f"""WITH {i.SQL['cell']}, {_BIT} SELECT a."row", a.col, max(b.value) AS value FROM low a JOIN low b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2""")
def morphology_dilate(spark, sf):
    return raster.morphology(_bits(spark, sf), 1.0, 0.0, "dilate")


@query("raster_morphology_erode", f"""WITH {i.SQL['cell']}, {_BIT} SELECT a."row", a.col, CASE WHEN sum(b.value) = 9 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM low a JOIN low b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2""")
def morphology_erode(spark, sf):
    return raster.morphology(_bits(spark, sf), 1.0, 0.0, "erode")


@query("raster_rasterize", sql('SELECT "row", col, arg_min(total, (n_nationkey)) AS value FROM zone z JOIN (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM range(64) a(r), range(64) b(c)) ON ' + _TOUCH + " GROUP BY 1, 2", "zone"))
def rasterize(spark, sf):
    return raster.rasterize(_BIG, i.zones(spark, sf), "n_nationkey", "total", "all_touched", "first")


@query("raster_fill_nearest", f"""WITH {_A}, {_FRAME}, f AS (SELECT frame."row", frame.col, CASE WHEN (frame."row" * 64 + frame.col) % 17 <> 0 OR frame."row" IN (0, 63) OR frame.col IN (0, 63) THEN CAST((frame."row" * 31 + frame.col * 17) % 101 AS DOUBLE) END AS value FROM frame)
    SELECT f."row", f.col, coalesce(f.value, arg_min(n.value, ((n."row" - f."row") * (n."row" - f."row") + (n.col - f.col) * (n.col - f.col), n."row", n.col))) AS value
    FROM f LEFT JOIN f n ON f.value IS NULL AND n.value IS NOT NULL AND (n."row" - f."row") * (n."row" - f."row") + (n.col - f.col) * (n.col - f.col) <= 4 GROUP BY f."row", f.col, f.value""")
def fill_nearest(spark, sf):
    r, c = F.col("row"), F.col("col")
    value = F.when(((r * 64 + c) % 17 != 0) | r.isin(0, 63) | c.isin(0, 63), ((r * 31 + c * 17) % 101).cast("double"))
    return raster.fill_holes(GRID.frame(spark).withColumn("value", value), GRID, 3, 2.0)


@query("raster_display_values", sql('SELECT "row", col, CAST(v // 65536 % 256 AS INTEGER) AS r, CAST(v // 256 % 256 AS INTEGER) AS g, CAST(v % 256 AS INTEGER) AS b, 255 AS a FROM (SELECT "row", col, CAST(floor(value / 0.01 + 0.5) AS BIGINT) AS v FROM cell)', "cell"))
def display_values(spark, sf):
    return raster.display_values(i.cells(spark, sf), 0.0, 0.01)


@query("raster_encode_nearest_even", sql('SELECT "row", col, CAST(CASE WHEN value / 4 - floor(value / 4) = 0.5 THEN 2 * round(value / 8) ELSE round(value / 4) END AS BIGINT) AS value FROM cell', "cell"))
def encode_nearest_even(spark, sf):
    return raster.encode(i.cells(spark, sf).withColumn("value", F.col("value") / 4), "int32", "nearest_even")


@query("raster_contours")
def contours(spark, sf):
    return raster.contours(i.cells(spark, sf), [300.0, 400.0])
