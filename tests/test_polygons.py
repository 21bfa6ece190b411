"""Polygons against hand-computed cases and a sampling of points."""

import random

import pytest
from pyspark.sql import functions as F

from fieldloom.contracts import ContractError
from fieldloom.operators import polygons, spatial

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLED = [[SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)]]]
SCHEMA = "id string, parts array<array<array<struct<x:double,y:double>>>>"


def frame(spark, **shapes):
    rows = [(k, None if parts is None else [[[(float(x), float(y)) for x, y in ring] for ring in part] for part in parts]) for k, parts in shapes.items()]
    return spark.createDataFrame(rows, SCHEMA)


def box(a, b, c, d):
    return [[[(a, b), (c, b), (c, d), (a, d)]]]


def test_measures(spark):
    df = frame(spark, holed=HOLED, two=[*box(0, 0, 2, 2), *box(10, 0, 11, 1)], clockwise=[[SQUARE[::-1]]], none=None, empty=[])
    got = {r["id"]: r for r in polygons.measures(df, "id").collect()}
    assert set(got) == {"holed", "two", "clockwise"}
    assert (got["holed"]["area"], got["holed"]["perimeter"], got["holed"]["cx"]) == (12.0, 24.0, 2.0) and (got["two"]["area"], got["clockwise"]["area"]) == (5.0, 16.0)
    inside = polygons.prepared(df, "id").join(polygons.measures(df, "id").select("id", "px", "py"), "id").select(polygons.side(F.col("edges"), F.col("px"), F.col("py")).alias("s"))
    assert [r["s"] for r in inside.collect()] == [1, 1, 1]
    assert polygons.explode_parts(df).groupBy("id").count().where("id = 'two'").first()["count"] == 2
    assert polygons.boundaries(df, "id").where("id = 'holed'").count() == 2


def test_overlay_and_predicates(spark):
    left = polygons.prepared(frame(spark, a=box(0, 0, 2, 2), hole=HOLED, far=box(50, 50, 51, 51), big=box(-100, -100, 100, 100)), "id")
    right = polygons.prepared(frame(spark, b=box(1, 0, 3, 2), edge=box(2, 0, 4, 2), inhole=box(1, 1, 3, 3), tri=[[[(0, 0), (4, 0), (0, 4)]]]), "id")
    shared = {(r["left_id"], r["right_id"]): r["area"] for r in polygons.overlay(left, right).collect()}
    assert shared == {("a", "b"): 2.0, ("a", "inhole"): 1.0, ("a", "tri"): 4.0, ("hole", "b"): 2.0, ("hole", "edge"): 3.0, ("hole", "tri"): 6.0, ("big", "b"): 4.0, ("big", "edge"): 4.0, ("big", "inhole"): 4.0, ("big", "tri"): 8.0}
    names = lambda p: {(r["left_id"], r["right_id"]) for r in polygons.join_pairs(left, right, p).collect()}
    assert names("touches") == {("a", "edge"), ("hole", "inhole")} and names("contains") == {("big", k) for k in ("b", "edge", "inhole", "tri")}
    assert names("intersects") == set(shared) | names("touches") and names("overlaps") == set(shared) and names("within") == {("a", "tri")}
    pts = spatial.points(spark.createDataFrame([(1, 2.0, 2.0), (2, 0.5, 0.5), (3, 4.0, 1.0), (4, 1.0, 2.0)], "k long, x double, y double"), "k")
    found = lambda p: {(r["polygon_id"], r["point_id"]) for r in polygons.points_in(left, pts, p).collect() if r["polygon_id"] == "hole"}
    assert found("intersects") == {("hole", 2), ("hole", 3), ("hole", 4)} and found("within") == {("hole", 2)}


def test_shared_area_against_samples(spark):
    rng = random.Random(4)
    star = lambda x, y: [[[(x + r * a, y + r * b) for r, (a, b) in ((rng.uniform(3, 9), d) for d in ((1, 0), (0.7, 0.7), (0, 1), (-0.7, 0.7), (-1, 0), (-0.7, -0.7), (0, -1), (0.7, -0.7)))]]]
    one, two = {f"a{k}": star(rng.uniform(0, 20), rng.uniform(0, 20)) for k in range(12)}, {f"b{k}": star(rng.uniform(0, 20), rng.uniform(0, 20)) for k in range(12)}
    a, b = polygons.prepared(frame(spark, **one), "id"), polygons.prepared(frame(spark, **two), "id")
    grid = spark.createDataFrame([(k, x / 8 + 0.031, y / 8 + 0.047) for k, (x, y) in enumerate((x, y) for x in range(-80, 240) for y in range(-80, 240))], "k long, x double, y double")
    held = lambda p, name: polygons.points_in(p, spatial.points(grid, "k")).select(F.col("polygon_id").alias(name), "point_id")
    counts = {(r["l"], r["r"]): r["n"] / 64 for r in held(a, "l").join(held(b, "r"), "point_id").groupBy("l", "r").agg(F.count("*").alias("n")).collect()}
    got = {(r["left_id"], r["right_id"]): r["area"] for r in polygons.overlay(a, b).collect()}
    assert all(abs(got.get(k, 0) - counts.get(k, 0)) < 1.5 for k in got.keys() | counts.keys()) and len(got) > 20


def test_dissolve_and_gaps(spark):
    ring = [box(0, 0, 3, 1), box(0, 1, 1, 2), box(2, 1, 3, 2), box(0, 2, 3, 3)]
    df = frame(spark, **{f"g{k}": b for k, b in enumerate(ring)}, other=box(10, 0, 11, 1)).withColumn("zone", F.when(F.col("id") != "other", "ring"))
    got = {r["zone"]: (r["area"], r["perimeter"]) for r in polygons.dissolve(df, "zone").collect()}
    assert got == {"ring": (8.0, 16.0), None: (1.0, 4.0)}
    assert [r["area"] for r in polygons.gaps(df).collect()] == [1.0] and polygons.gaps(df, min_area=1.0).count() == 0
    with pytest.raises(ContractError):
        polygons.refuse_shared_areas(polygons.prepared(frame(spark, a=box(0, 0, 2, 2), b=box(1, 1, 3, 3)), "id"))


def test_problems_and_repair(spark):
    shapes = {"good": HOLED, "bow": [[[(0, 0), (2, 2), (2, 0), (0, 2)]]], "short": [[[(0, 0), (1, 1), (0, 0)]]], "flat": [[[(0, 0), (1, 1), (2, 2)]]], "out": [[SQUARE, [(5, 5), (6, 5), (6, 6)]]], "none": None, "twice": [[[(0, 0), (0, 0), (1, 0), (1, 1), (0, 0)]], []]}
    df = frame(spark, **shapes)
    assert {r["id"]: r["p"] for r in df.select("id", polygons.problem(F.col("parts")).alias("p")).collect()} == {"good": None, "bow": "no area", "short": "short ring", "flat": "no area", "out": "hole outside", "none": "empty", "twice": None}
    fixed = {r["id"]: r["p"] for r in df.select("id", polygons.repaired(F.col("parts")).alias("p")).collect()}
    assert len(fixed["twice"]) == 1 and len(fixed["twice"][0][0]) == 3 and fixed["short"] == [] and fixed["none"] is None


def test_boxes_of_many_sizes(spark):
    """Cells of several sizes give each pair once."""
    rng = random.Random(8)
    sized = lambda k: (k, x := rng.uniform(0, 1000), y := rng.uniform(0, 1000), x + (s := rng.choice([0.5, 1, 3, 40, 700])), y + s)
    one, two = [sized(k) for k in range(150)], [sized(k) for k in range(150)]
    schema = "id long, xmin double, ymin double, xmax double, ymax double"
    want = sorted((a[0], b[0]) for a in one for b in two if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4])
    for size in (None, 2.0):
        got = spatial.pairs(spatial.Boxes(spark.createDataFrame(one, schema), "id"), spatial.Boxes(spark.createDataFrame(two, schema), "id"), "intersects", size)
        assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == want
