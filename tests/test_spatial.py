"""Hand-computed cases of spatial, raster and graph operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.contracts import ContractError
from fieldloom.functions import shapes
from fieldloom.operators import analysis, conflation, graph, raster, spatial
from fieldloom.operators.raster import Grid
from fieldloom.operators.spatial import Boxes, points


def boxes(spark, *rows):
    return Boxes(spark.createDataFrame([(str(k), *map(float, r)) for k, *r in rows], "id string, xmin double, ymin double, xmax double, ymax double"), "id")


def pts(spark, *rows, extra="v double"):
    return points(spark.createDataFrame([tuple(r) for r in rows], f"id string, x double, y double, {extra}"), "id")


def test_overlay_and_allocation(spark):
    a, b = boxes(spark, ("a", 0, 0, 2, 2)), boxes(spark, ("b", 1, 0, 3, 2))
    assert [r["area"] for r in spatial.overlay(a, b).collect()] == [2.0]
    assert [r["rest"] for r in spatial.overlay_areas(a, b).collect()] == [2.0]
    big = boxes(spark, ("a", 0, 0, 10, 10))
    big.df = big.df.withColumn("pop", F.lit(100.0))
    targets = boxes(spark, ("b", 0, 0, 4, 10), ("c", 4, 0, 8, 10))
    got = spatial.allocate(big, targets, "pop")
    row = spatial.balances(big, got, "pop").first()
    assert (row["allocated"], row["unallocated"], row["max_target"]) == (80.0, 20.0, "b")
    with pytest.raises(ContractError):
        spatial.allocate(big, boxes(spark, ("b", 0, 0, 5, 10), ("c", 4, 0, 8, 10)), "pop")


@pytest.mark.parametrize("size", [0.7, 3.0, 50.0])
def test_cell_size_changes_nothing(spark, size):
    a = boxes(spark, *[(k, k % 7 * 3, k % 5 * 4, k % 7 * 3 + k % 4, k % 5 * 4 + k % 3) for k in range(40)])
    found = {(r["left_id"], r["right_id"]) for r in spatial.pairs(a, a, "intersects", size).collect()}
    rows = a.df.collect()
    want = {(p["id"], q["id"]) for p in rows for q in rows if p["xmin"] <= q["xmax"] and q["xmin"] <= p["xmax"] and p["ymin"] <= q["ymax"] and q["ymin"] <= p["ymax"]}
    assert found == want and len(spatial.pairs(a, a, "intersects", size).collect()) == len(want)


def test_nearest(spark):
    left = pts(spark, ("a", 0.0, 0.0, None), ("missing", 20.0, 0.0, None))
    right = pts(spark, ("z", 1.0, 0.0, None), ("b", -1.0, 0.0, None), ("a", 0.0, 0.0, None))
    got = spatial.knn(left, right, 2, 1.0, exclude_self=True).orderBy("rank").collect()
    assert [(r["left_id"], r["right_id"], r["dist2"]) for r in got] == [("a", "b", 1.0), ("a", "z", 1.0)]
    assert spatial.knn(left, right, 2, exclude_self=True).count() == 4
    ties = spatial.nearest(pts(spark, ("p", 0.0, 0.0, None)), right.__class__(right.df.where("id <> 'a'"), "id", "x", "y", "x", "y"), 2.5)
    assert ties.count() == 2


def test_adjacency_and_bands(spark):
    b = boxes(spark, ("0a", 0, 0, 1, 1), ("edge", 1, 0, 2, 1), ("point", 1, 1, 2, 2), ("zover", 0.5, 0, 1.5, 1))
    found = {(r["a"], r["b"]): (r["contact"], r["shared_len"]) for r in spatial.adjacency(b).collect()}
    assert found[("0a", "edge")] == ("edge", 1.0) and found[("0a", "point")][0] == "point" and found[("0a", "zover")][0] == "overlap"
    p, q = pts(spark, ("o", 0.0, 0.0, None)), pts(spark, ("a", 1.0, 0.0, None), ("b", 2.0, 0.0, None))
    assert [r["cnt"] for r in spatial.bands(p, q, [1.0, 2.0]).orderBy("band").collect()] == [1, 1]
    assert [r["cnt"] for r in spatial.bands(p, q, [1.0, 2.0], True).orderBy("band").collect()] == [1, 2]


def test_boundary_policies(spark):
    p = pts(spark, ("p", 1.0, 0.5, 1.0), ("out", 3.0, 3.0, 1.0), ("in", 0.5, 0.5, 1.0))
    cells = boxes(spark, ("a", 0, 0, 1, 1), ("b", 1, 0, 2, 1))
    assert {r["cell_id"]: (r["cnt"], r["density"]) for r in spatial.grid_owner(cells, p).collect()} == {"a": (2, 2e6), "b": (0, 0.0)}
    assert {r["zone_id"]: r["cnt"] for r in spatial.zone_cross(cells, p, "v", "intersects").collect()} == {"a": 2, "b": 1}
    assert {r["zone_id"]: r["cnt"] for r in spatial.zone_cross(cells, p, "v", "within").collect()} == {"a": 1, "b": 0}


def test_clusters(spark):
    p = pts(spark, ("a", 0.01, 0.0, 1.0), ("b", 0.02, 0.0, 2.0), ("c", 10.0, 10.0, None))
    assert {r["id"]: r["cluster"] for r in analysis.dbscan(p, 1.0, 2).collect()} == {"a": "cluster:a", "b": "cluster:a", "c": "noise"}


def test_kde_and_moran(spark):
    k = {(r["row"], r["col"]): r["density"] for r in analysis.kde(pts(spark, ("a", 1.0, 1.0, None), ("b", 3.0, 1.0, None)), 2.0, 1.0, (0, 0, 4, 4)).collect()}
    want = sum(math.exp(-((0.5 - x) ** 2 + 0.25) / 8) for x in (1, 3)) / (8 * math.pi) * 1e6
    assert k[(0, 0)] == pytest.approx(want)
    v = [2, 3, 3.2, 5, 8, 7]
    p = pts(spark, *[(str(i), 10.0 * i, 0.0, float(x)) for i, x in enumerate(v)])
    z = np.array(v) - np.mean(v)
    w = np.array([[abs(i - j) == 1 for j in range(6)] for i in range(6)], float)
    assert analysis.moran(p, "v", 15.0).first()["moran_i"] == pytest.approx(6 / w.sum() * (z @ w @ z) / (z @ z))
    assert 0 < analysis.permutation_p(p, "v", 15.0, 49, 7).first()["p_value"] <= 1


def test_match_split(spark):
    line = spark.createDataFrame([("l", 0.0, 0.0, 10.0, 0.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([("x", 4.0, 1.0, 0.0, 1.0), ("y", 6.0, 1.0, 9.0, 1.0), ("z", 2.0, -1.0, 3.0, -1.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    found = conflation.match_segments(line, other, 2.0, 20.0, 0.5)
    parts = conflation.split_at_matches(line, found).collect()
    assert sum(r["source_end_m"] - r["source_start_m"] for r in parts) == pytest.approx(10)
    assert {r["status"] for r in parts} == {"matched", "ambiguous", "unmatched"}
    assert {r["right_id"]: r["end_m"] for r in found.collect()}["x"] == 4.0


def test_helmert(spark):
    fit = conflation.helmert(spark.createDataFrame([(0.0, 0.0, 5.0, 7.0), (1.0, 0.0, 5.0, 9.0), (0.0, 1.0, 3.0, 7.0)], "x double, y double, u double, v double"))
    assert fit["a"] == pytest.approx(0) and fit["b"] == pytest.approx(2) and fit["rms"] == pytest.approx(0, abs=1e-9)


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    r = F.col("ring")
    row = df.select(shapes.signed_area(r).alias("a"), shapes.compactness(r).alias("k"), shapes.contains(r, F.lit(1.0), F.lit(1.0)).alias("i"), shapes.rectangle_udf()("ring").alias("m"), shapes.signed_area(shapes.buffer_udf(1.0, 64)("ring")).alias("b")).first()
    assert (row["a"], row["i"], row["m"]["long_m"], row["m"]["short_m"], row["m"]["direction_deg"]) == (8.0, True, 4.0, 2.0, 0.0)
    assert row["k"] == pytest.approx(2 * math.pi / 9) and row["b"] == pytest.approx(8 + 12 + math.pi, rel=1e-3)


def cells(spark, rows):
    return spark.createDataFrame([(r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, value double")


def as_lists(df, shape):
    out = [[None] * shape[1] for _ in range(shape[0])]
    for r in df.collect():
        out[r["row"]][r["col"]] = r["value"]
    return out


def test_classify_and_transform(spark):
    c = cells(spark, [[0.0, 1.0, 2.0, 3.0, None]])
    rules = [{"min": 0, "max": 1, "output": 10}, {"min": 1, "max": 2, "closed": "both", "output": 20}]
    assert as_lists(raster.classify(c, rules, "keep"), (1, 5)) == [[10.0, 20.0, 20.0, 3.0, None]]
    both = [{"min": 0, "max": 1, "closed": "both", "output": 10}, {"min": 1, "max": 2, "closed": "both", "output": 20}]
    with pytest.raises(ContractError):
        raster.classify(c, both)
    assert as_lists(raster.classify(c, both, overlap="last"), (1, 5))[0][1] == 20.0
    flat = cells(spark, [[7.0, 7.0, None]])
    with pytest.raises(ContractError):
        raster.transform(flat, "minmax")
    assert as_lists(raster.transform(flat, "zscore", constant="zero"), (1, 3)) == [[0.0, 0.0, None]]
    assert as_lists(raster.transform(cells(spark, [[0.0, 1.0, 2.0, 3.0, 4.0, None]]), "auto_class", classes=2, mode="equal"), (1, 6)) == [[1.0, 1.0, 2.0, 2.0, 2.0, None]]


def test_combine(spark):
    a, b = cells(spark, [[0.0, 2.0, None]]), cells(spark, [[4.0, None, 6.0]])
    run = lambda *x, **k: as_lists(raster.combine([a, b], *x, **k), (1, 3))[0]
    assert run("sum") == [4.0, None, None] and run("mean", nodata="ignore") == [2.0, 2.0, 6.0]
    assert run("weighted_mean", [1.0, 3.0], "ignore") == [3.0, 2.0, 6.0] and run("std", nodata="ignore") == [2.0, 0.0, 0.0]
    with pytest.raises(ContractError):
        raster.combine([b, a], "divide")


def test_allocate(spark):
    grid, zone = Grid(2, 2, 0, 2), spark.createDataFrame([("z", 0.0, 0.0, 1.5, 2.0, 50.0)], "id string, xmin double, ymin double, xmax double, ymax double, t double")
    domain = cells(spark, [[0.0, 0.0], [0.0, None]])
    assert as_lists(raster.allocate(domain, grid, zone, "id", "t", "area"), (2, 2)) == [[20.0, 10.0], [20.0, None]]
    weights = cells(spark, [[1.0, 0.0], [3.0, 1.0]])
    assert as_lists(raster.allocate(domain, grid, zone, "id", "t", "weighted", weights), (2, 2)) == [[12.5, 0.0], [37.5, None]]
    five = zone.withColumn("t", F.lit(5.0))
    assert as_lists(raster.allocate(domain, grid, five, "id", "t", "uniform", integer=True), (2, 2)) == [[2.0, 2.0], [1.0, None]]


def test_regions(spark):
    c = cells(spark, [[1.0, None, None, None], [None, 1.0, None, None], [None, None, None, 1.0]])
    name = lambda k: {(r["row"], r["col"]): r["region"] for r in raster.regions(c, k).collect()}
    four, eight = name(4), name(8)
    assert four[(0, 0)] != four[(1, 1)] and eight[(0, 0)] == eight[(1, 1)] != eight[(2, 3)]


@pytest.mark.parametrize("stat", ["mean", "sum", "min", "max", "median", "std", "mode"])
def test_focal_against_loops(spark, stat):
    a = np.array([[float(v % 5) for v in range(r * 9, r * 9 + 9)] for r in range(7)])
    a[3, 3] = np.nan
    c = cells(spark, [[None if math.isnan(v) else v for v in line] for line in a.tolist()])
    reduce = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "median": np.median, "std": np.std, "mode": lambda v: min(set(v), key=lambda x: (-list(v).count(x), x))}[stat]
    for boundary in ("partial", "pad", "truncate"):
        got = as_lists(raster.focal(c, Grid(7, 9), stat, boundary=boundary, min_coverage=0.5), (7, 9))
        for r in range(7):
            for k in range(9):
                window = a[max(0, r - 1) : r + 2, max(0, k - 1) : k + 2]
                valid = window[~np.isnan(window)]
                size = window.size if boundary == "partial" else 9
                empty = np.isnan(a[r, k]) or len(valid) < 0.5 * size or (boundary == "truncate" and window.size < 9)
                assert (got[r][k] is None) == bool(empty)
                if not empty:
                    assert got[r][k] == pytest.approx(float(reduce(valid)))


@pytest.mark.parametrize("g,aspect", [((1, 0), 270), ((-1, 0), 90), ((0, 1), 180), ((0, -1), 0), ((1, 1), 225)])
def test_terrain_plane(spark, g, aspect):
    c = cells(spark, [[float(g[0] * 2 * k - g[1] * 3 * r) for k in range(5)] for r in range(5)])
    rows = raster.terrain(c, Grid(5, 5, dx=2.0, dy=3.0)).where("slope is not null").collect()
    assert len(rows) == 9
    for r in rows:
        assert r["slope"] == pytest.approx(math.degrees(math.atan(math.hypot(*g)))) and r["aspect"] % 360 == pytest.approx(aspect) and r["relief"] == pytest.approx(4 * abs(g[0]) + 6 * abs(g[1]))


def test_graph(spark):
    e = spark.createDataFrame([("ab", "a", "b", 12.0, "forward"), ("ac", "a", "c", 5.0, "both"), ("cb", "c", "b", 5.0, "both")], "id string, u string, v string, cost double, d string")
    arcs = graph.arcs(e, "id", "u", "v", F.col("cost"), "d")
    cost = {(r["origin"], r["node"]): r["cost"] for r in graph.od_costs(arcs, spark.createDataFrame([("a",), ("b",)], "origin string")).collect()}
    assert cost[("a", "b")] == 10.0 and cost[("b", "a")] == 10.0
    seg = {r["arc"]: r["fraction"] for r in graph.service_segments(arcs, graph.od_costs(arcs, spark.createDataFrame([("a",)], "origin string"), budget=3.0), 3.0).collect()}
    assert seg["ac:f"] == pytest.approx(0.6)
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a int, b int")
    roots = {r["node"]: r["root"] for r in graph.connected_components(chain).collect()}
    assert {roots[k] for k in range(61)} == {0} and roots[101] == 100


def test_order_and_partitions_change_nothing(spark):
    a = boxes(spark, *[(k, k % 9, k % 7, k % 9 + 1 + k % 3, k % 7 + 2) for k in range(60)])
    one = sorted(map(tuple, spatial.topology(a, 0.5).collect()))
    shuffled = Boxes(a.df.orderBy(F.rand(3)).repartition(7), "id")
    assert sorted(map(tuple, spatial.topology(shuffled, 0.5).collect())) == one
