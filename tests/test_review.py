"""Keys, labels, exact sums, seams, approvals and surfaces."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.contracts import ContractError
from fieldloom.functions import text
from fieldloom.operators import aggregates, conflation, graph, joins, labels, raster
from fieldloom.operators.raster import Grid
from fieldloom.plans import catalog
from fieldloom.sources import readers


def column(spark, kind, *values):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_compatible_keys(spark):
    rows = column(spark, "string", "１－３", "①２", "ﬁ-7", "é 9", "é9", " 0 6", None, "㎏01", "ｱ")
    assert [r[0] for r in rows.select(text.normalize_id(F.col("v"))).collect()] == ["1-3", "12", "FI-7", "É9", "É9", "6", None, "KG1", "ア"]
    left, right = column(spark, "double", 103.0, 1.5, None).withColumn("a", F.lit(1)), column(spark, "string", "１０３", "1.5", "").withColumn("b", F.lit(2))
    assert joins.keyed_join(left, right.withColumnRenamed("v", "k"), "v", "k", "id", "inner").count() == 2
    same = column(spark, "string", "Straße.GPKG", "STRASSE.gpkg", "é", "É").select(text.file_key(F.col("v")).alias("k")).distinct().count()
    assert same == 2


def test_drawing_texts_and_labels(spark):
    assert column(spark, "string", "　ＡＢ－１ \n  x　").select(text.drawing_text(F.col("v"))).first()[0] == "AB-1 x"
    rows = spark.createDataFrame([("Ｒ２-7", "lot", None), ("R2-7", "other", "id"), ("R2", "lot", None), (None, "lot", "x"), ("R2-7", "none", None)], "text string, layer string, tag string")
    rules = [labels.Rule(r"(?P<landuse>[A-Z]\d)(?:-(?P<number>\d+))?", layers=("lot",)), labels.Rule(r".*", "note", tags=("id",))]
    got = [tuple(r)[3:] for r in labels.classify(rows, rules).collect()]
    assert got == [(True, "R2", "7", None), (True, None, None, "R2-7"), (True, "R2", None, None), (True, None, None, None), (False, None, None, None)]
    kinds = spark.createDataFrame([("R", "homes"), ("R2", "dense"), ("", "other")], "prefix string, name string")
    codes = column(spark, "string", "R2+C1", "R1", "X", None, " R2、R")
    assert [r["class"] for r in labels.by_longest_prefix(codes, "v", kinds.where("prefix != ''")).orderBy("v").collect()] == [None, "dense", "homes", "dense", None]
    assert labels.by_longest_prefix(codes, "v", kinds).where("class = 'other'").count() == 1


def test_sums_are_rounded_once(spark):
    rng = random.Random(1)
    own = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(400)] + [5e307, 5e307, -5e307, 5e-324, -2.5e-310, 0.0, 1e16, 1.0, -1e16]
    rows = [("a", v) for v in own] + [("b", None), ("c", float("nan")), ("c", 0.1), ("c", 0.2), (None, 0.0), ("d", -0.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r["g"]: r["total"] for r in aggregates.exact_sum(df, ["g"], "v").collect()}
    assert got == {"a": math.fsum(own), "b": None, "c": math.fsum([0.1, 0.2]), None: 0.0, "d": 0.0}
    assert aggregates.exact_sum(df.where("g = 'c'"), [], "v").first()[0] == math.fsum([0.1, 0.2])
    assert aggregates.exact_sum(spark.createDataFrame([(1.7e308,)] * 2, "v double"), [], "v").first()[0] == math.inf
    assert aggregates.exact_sum(df.limit(0), [], "v").first()[0] is None


def test_pointer(spark):
    doc = column(spark, "string", '{"a": [{"b/c": 7}], "m~n": "x"}', "[1, 2]", None)
    read = lambda p: [r[0] for r in doc.select(text.pointer(F.col("v"), p)).collect()]
    assert read("/a/0/b~1c") == ["7", None, None] and read("/m~0n") == ["x", None, None] and read("/1") == [None, "2", None]


def cells(spark, rows):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, value double")


def table(df):
    out = {}
    for r in df.collect():
        out[(r["row"], r["col"])] = tuple(r)[2:] if len(r) > 3 else r[2]
    return out


def test_bands_and_clip(spark):
    a, b = cells(spark, [[1, 2], [3, None]]), cells(spark, [[5, None], [None, 8]])
    stacked = raster.stack([a, b])
    assert table(stacked) == {(0, 0): (1.0, 5.0), (0, 1): (2.0, None), (1, 0): (3.0, None), (1, 1): (None, 8.0)}
    assert raster.split_bands(stacked).where("band = 2 and value is not null").count() == 2
    assert table(raster.calibrate(a, 2, 1)) == {(0, 0): 3.0, (0, 1): 5.0, (1, 0): 7.0, (1, 1): None}
    with pytest.raises(ContractError):
        raster.calibrate(cells(spark, [[1e308]]), 10)
    zone = spark.createDataFrame([("z", 0.0, 1.0, 1.0, 2.0)], "id string, xmin double, ymin double, xmax double, ymax double")
    grid = Grid(2, 2, 0, 2)
    assert table(raster.clip(a, grid, zone, "id")) == {(0, 0): 1.0, (0, 1): None, (1, 0): None, (1, 1): None}
    assert table(raster.clip(a, grid, zone, "id", invert=True)) == {(0, 0): None, (0, 1): 2.0, (1, 0): 3.0, (1, 1): None}


def test_flow(spark):
    dem = cells(spark, [[9, 8, 7], [9, None, 3], [9, 5, 1]])
    flow = raster.flow_direction(dem, Grid(3, 3))
    assert table(flow) == {(0, 0): (0, 1), (0, 1): (1, 2), (0, 2): (1, 2), (1, 0): (2, 1), (1, 2): (2, 2), (2, 0): (2, 1), (2, 1): (2, 2), (2, 2): (None, None)}
    assert table(raster.flow_accumulation(flow)) == {(0, 0): 1, (0, 1): 2, (0, 2): 1, (1, 0): 1, (1, 2): 4, (2, 0): 1, (2, 1): 3, (2, 2): 8}
    assert raster.flow_accumulation(raster.flow_direction(dem.limit(0), Grid(3, 3))).count() == 0


def test_walking(spark):
    dem, ease = cells(spark, [[0, 1, 0], [0, 0, -2]]), cells(spark, [[1, 1, 1], [1, None, 3]])
    arcs = {(r["u"], r["v"]): r["cost"] for r in raster.walk_arcs(dem, ease, Grid(2, 3, dx=2.0, dy=1.0), (0.72, 6.0, 1.9998, -1.9998), -0.2125).collect()}
    assert len(arcs) == 12 and arcs[(0, 1)] == pytest.approx(0.72 * 2 + 6.0 + 2.0) and arcs[(1, 0)] == pytest.approx(0.72 * 2 + 1.9998 + 2.0)
    assert arcs[(2, 5)] == pytest.approx(0.72 + 2 * 1.9998 + 2.0)
    arc = spark.createDataFrame([(f"{u}>{v}", u, v, c) for (u, v), c in arcs.items()], "arc string, u long, v long, cost double")
    cost = {r["node"]: r["cost"] for r in graph.od_costs(arc, spark.createDataFrame([(0,)], "origin long")).collect()}
    assert cost[2] == pytest.approx(arcs[(0, 1)] + arcs[(1, 2)]) and set(cost) == {0, 1, 2, 3, 5}


LINES = "id string, line array<struct<x:double,y:double>>"


def test_seams(spark):
    lines = spark.createDataFrame([("a", [(0.0, 0.0), (5.0, 0.0)]), ("b", [(5.0, 0.0), (9.0, 0.0)]), ("c", [(5.0, 0.0), (5.0, 5.0), (7.0, 7.0)])], LINES)
    other = spark.createDataFrame([("r", [(5.0, 1.0), (20.0, 1.0)])], LINES)
    approve = lambda *rows: spark.createDataFrame(list(rows), "source_id string, source_end int, target_id string, target_end int")
    out = {r["id"]: [tuple(p) for p in r["line"]] for r in conflation.edge_match(lines, other, approve(("a", -1, "r", 0)), 1.0).collect()}
    assert out == {"a": [(0, 0), (5, 1)], "b": [(5, 1), (9, 0)], "c": [(5, 1), (5, 5), (7, 7)]}
    for bad, limit in ((("a", -1, "r", 0), 0.5), (("a", -1, "r", -1), 100.0), (("x", 0, "r", 0), 9.0)):
        with pytest.raises(ContractError):
            far = other.unionByName(lines) if bad[3] == 0 else spark.createDataFrame([("r", [(0.0, 9.0), (-3.0, 6.0)])], LINES)
            wall = lines.unionByName(spark.createDataFrame([("w", [(-1.0, 1.0), (4.0, 5.0)])], LINES))
            conflation.edge_match(wall, far, approve(bad), limit).collect()
    with pytest.raises(ContractError):
        conflation.edge_match(lines, other, approve(("a", -1, "r", 0), ("b", 0, "r", -1)), 100.0)


def test_approvals(spark):
    box = lambda x, s=2.0: [[[(x, 0.0), (x + s, 0.0), (x + s, 2.0), (x, 2.0)]]]
    frame = lambda *rows: spark.createDataFrame(list(rows), "id string, v int, parts array<array<array<struct<x:double,y:double>>>>")
    before, after = frame(("a", 1, box(0.0)), ("b", 2, box(5.0))), frame(("b", 9, box(5.1)), ("a", 9, box(0.0, 2.2)))
    prints = conflation.fingerprint(before), conflation.fingerprint(after)
    assert conflation.fingerprint(before.repartition(3).select("parts", "v", "id")) == prints[0] != conflation.fingerprint(before.unionByName(before))
    out = {r["id"]: (r["v"], r["parts"][0][0][0]["x"]) for r in conflation.adopt(before, after, "id", "me", *prints, 0.5, 0.3).collect()}
    assert out == {"a": (1, 0.0), "b": (2, 5.1)}
    for who, seen, area, move in (("", prints, 0.5, 0.3), ("me", prints[::-1], 0.5, 0.3), ("me", prints, 0.1, 0.3), ("me", prints, 0.5, 0.05)):
        with pytest.raises(ContractError):
            conflation.adopt(before, after, "id", who, *seen, area, move)
    left, right = before.drop("parts"), after.drop("parts")
    pairs = spark.createDataFrame([("a", "b", "matched")], "left_id string, right_id string, status string")
    seen = conflation.fingerprint(left), conflation.fingerprint(right)
    got = {r["id"]: r["transferred_v"] for r in conflation.approved_transfer(left, right, pairs, pairs.drop("status"), ["v"], "me", *seen).collect()}
    assert got == {"a": 9, "b": None}
    with pytest.raises(ContractError):
        conflation.approved_transfer(left, right, pairs, pairs.drop("status"), ["v"], "me", *seen[::-1])


def test_fingerprints_of_files(spark, tmp_path):
    one = tmp_path / "layer.gpkg"
    one.write_bytes(b"abc")
    assert readers.fingerprint(spark, str(one)) == hashlib.sha256(b"abc").hexdigest()
    (tmp_path / "layer.gpkg.ovr").write_bytes(b"")
    assert readers.fingerprint(spark, str(one))
    (tmp_path / "roads.shp").write_bytes(b"x")
    for path, raster in ((one, True), (tmp_path / "roads.shp", False), (tmp_path, False), (tmp_path / "none", False)):
        with pytest.raises(ContractError):
            readers.fingerprint(spark, str(path), raster)
    (tmp_path / "layer.gpkg-wal").write_bytes(b"")
    with pytest.raises(ContractError):
        readers.fingerprint(spark, str(one))


def test_discovery(spark):
    found = {r["name"]: r for r in catalog.discovery(spark).collect()}
    assert set(found) == set(catalog.QUERIES) and found["lineitem_parts"]["module"] == "review" and found["lineitem_parts"]["with_sql"]
    assert sum(r["with_sql"] for r in found.values()) == len(catalog.ORACLE_SQL)
