"""Features, projections, sources, sinks, recipes, SQL and streams."""

import io
import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldloom.contracts import ContractError
from fieldloom.functions import projection, text
from fieldloom.operators import features, table
from fieldloom.operators.spatial import Boxes, points
from fieldloom.plans.recipe import Recipe, Step
from fieldloom.plans.sql import run_select
from fieldloom.sources import readers, sinks
from fieldloom.streaming import events


def boxes(spark, *rows):
    return Boxes(spark.createDataFrame([(str(k), *map(float, r)) for k, *r in rows], "id string, xmin double, ymin double, xmax double, ymax double"), "id")


def test_grids_and_rings(spark):
    assert features.square_grid(spark, 0, 0, 10, 5, 2.5).count() == 8
    assert [r["ring"] for r in features.concentric(boxes(spark, ("a", 0, 0, 1, 1)).df, [1.0, 3.0]).collect()] == [1, 2]
    cell = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0), (10.0, 0.0)], "x double, y double").select(features.hex_cell(F.col("x"), F.col("y"), 2.0)).collect()
    assert cell[0][0] == "0:0" and len({r[0] for r in cell}) >= 2
    placed = features.stratified(features.square_grid(spark, 0, 0, 4, 4, 1.0)).where("x >= xmin and x < xmax and y >= ymin and y < ymax")
    assert placed.count() == 16


def test_restrictions_labels_and_matches(spark):
    got = {r["id"]: (r["free_area"], r["reason"]) for r in features.select_free(boxes(spark, ("a", 0, 0, 2, 2), ("b", 5, 5, 6, 6)), boxes(spark, ("r", 0, 0, 2, 1.5)), 2.0).collect()}
    assert got == {"a": (1.0, "below_min_area"), "b": (1.0, "below_min_area")}
    faces = boxes(spark, ("f", 0, 0, 2, 2), ("g", 2, 0, 4, 2), ("h", 8, 8, 9, 9))
    texts = points(spark.createDataFrame([("t", 1.0, 1.0, "A"), ("u", 3.0, 1.0, "B"), ("v", 3.5, 1.0, "C")], "id string, x double, y double, v string"), "id")
    assert {r["face_id"]: (r["label"], r["status"]) for r in features.labels(faces, texts, "v").collect()} == {"f": ("A", "labelled"), "g": (None, "conflict"), "h": (None, "unassigned")}
    best = features.best_iou(boxes(spark, ("a", 0, 0, 2, 2)), boxes(spark, ("p", 0, 0, 1, 2), ("q", 0, 0, 2, 3))).first()
    assert (best["right_id"], round(best["iou"], 6)) == ("q", round(4 / 6, 6))
    assert features.containment_chain((1.0, 1.0), [boxes(spark, ("w", 0, 0, 9, 9)), faces]) == ["w", "f"]
    with pytest.raises(ContractError):
        features.containment_chain((50.0, 1.0), [faces])
    pts = points(spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 9.0, 0.0), ("d", 1.5, 0.0)], "id string, x double, y double"), "id")
    assert {r["group"]: r["n"] for r in features.aggregate_points(pts, 1.0, ["d"]).collect()} == {"a": 2, "c": 1, "d": 1}
    drawn = spark.createDataFrame([("A-wall", "x", 0.0, 0.0, 1.0, 1.0), ("B", "blk1", 5.0, 5.0, 6.0, 6.0)], "layer string, block string, xmin double, ymin double, xmax double, ymax double")
    assert [r["excluded_by"] for r in features.exclusions(drawn, [{"id": "w", "layer": "A-*"}, {"id": "b", "block": "blk?"}]).collect()] == ["w", "b"]


def test_projections(spark):
    df = spark.createDataFrame([(3.0, 0.0), (2.294497, 48.858222)], "lon double, lat double")
    e, n = projection.to_utm(F.col("lon"), F.col("lat"), 31)
    rows = df.select(e.alias("e"), n.alias("n")).collect()
    assert (rows[0]["e"], rows[0]["n"]) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert rows[1]["e"] == pytest.approx(448252, abs=2) and rows[1]["n"] == pytest.approx(5411943, abs=15)
    x, y = projection.to_web_mercator(F.col("lon"), F.col("lat"))
    back = df.select(*[c.alias(k) for c, k in zip(projection.from_web_mercator(x, y), ("lon", "lat"))]).collect()
    assert back[1]["lat"] == pytest.approx(48.858222)
    with pytest.raises(ContractError):
        projection.utm_zone(0, 0, 10, 1)
    assert spark.range(1).select(text.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0))).first()[0] == pytest.approx(20015.1, abs=0.1)


def test_delimited_text(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("标题\nparcel,v\n007,2.5\n7,\n,\n".encode("gbk"))
    df = readers.read_text_table(spark, str(p), encoding="GBK", header_row=2, promote=True, keep_text=("parcel",))
    assert sorted((r["parcel"], r["v"]) for r in df.collect()) == [("007", 2.5), ("7", None)]
    q = tmp_path / "u.csv"
    q.write_text("a,a\n1,2\n")
    with pytest.raises(ContractError):
        readers.read_text_table(spark, str(q))


def test_spreadsheet(spark, tmp_path):
    buffer = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row><c r="B3" t="inlineStr"><is><t>y</t></is></c></row></sheetData></worksheet>')
    p = tmp_path / "t.xlsx"
    p.write_bytes(buffer.getvalue())
    assert [tuple(r) for r in readers.read_any(spark, str(p)).collect()] == [("7", "x"), (None, "y")]


def test_geopackage_and_geojson(spark, tmp_path):
    p = tmp_path / "t.gpkg"
    con = sqlite3.connect(p)
    con.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, srs_id INT)")
    con.execute("INSERT INTO gpkg_contents VALUES ('sites', 'features', 4326)")
    con.execute("CREATE TABLE sites (fid INTEGER PRIMARY KEY, name TEXT, geom BLOB)")
    con.execute("INSERT INTO sites VALUES (1, 'a', ?)", (b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 2.0, 3.0),))
    con.commit()
    con.close()
    assert [tuple(r) for r in readers.gpkg_layers(spark, str(p)).collect()] == [("sites", "features", 4326)]
    row = readers.read_gpkg(spark, str(p), "sites").first()
    assert (row["name"], row["x"], row["y"]) == ("a", 2.0, 3.0)
    with pytest.raises(ContractError):
        readers.read_any(spark, str(p))
    g = tmp_path / "t.geojson"
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [5.0, 6.0]}}]}))
    assert [(r["n"], r["x"], r["y"]) for r in readers.read_geojson(spark, str(g)).collect()] == [(1, 5.0, 6.0)]


def test_publication(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "id int, k string")
    facts = sinks.publish(df, str(tmp_path / "out"), {"tool": "test"})
    assert facts["rows"] == 3 and facts["sha256"] == sinks.content_hash(df.orderBy(F.desc("id")).repartition(3)) != sinks.content_hash(df.limit(2))
    assert json.loads((tmp_path / "out" / "record.json").read_text())["tool"] == "test" and not list(tmp_path.glob("*.staging-*"))
    with pytest.raises(ContractError):
        sinks.publish(df, str(tmp_path / "out"))
    with pytest.raises(ContractError):
        sinks.split(df, "k", str(tmp_path / "split"))
    assert sinks.split(df.where("id <> 2"), "k", str(tmp_path / "split")) == ["part_NULL", "part_a"]
    assert sinks.export_table(df, str(tmp_path / "csv"), ["id", "nope"], "id > 1") == ["nope"]
    layers = sinks.Layers(spark, "layer_test")
    layers.put("one", df)
    with pytest.raises(ContractError):
        layers.put("one", df)
    with pytest.raises(ContractError):
        layers.drop("one")
    layers.copy("one", "two")
    layers.rename("two", "three")
    layers.drop("one")
    assert layers.list() == ["three"] and layers.get("three").count() == 3
    spark.sql("DROP DATABASE layer_test CASCADE")


def test_select_only(spark):
    df = spark.createDataFrame([(1, 2), (3, 4)], "id int, v int")
    answer = run_select(spark, "WITH t AS (SELECT * FROM a WHERE v > 2) SELECT id, v FROM t", {"a": df}, key="id", schema="id int, v int")
    assert [tuple(r) for r in answer.df.collect()] == [(3, 4)] and "Physical Plan" in answer.plan
    for bad in ("SELECT 1; SELECT 2", "DROP TABLE a", "SELECT id, id FROM a"):
        with pytest.raises(ContractError):
            run_select(spark, bad, {"a": df})
    with pytest.raises(ContractError):
        run_select(spark, "SELECT 1 AS id FROM a", {"a": df}, key="id")


def test_recipe(spark, tmp_path):
    calls = []

    def keep(df, least):
        calls.append(least)
        return df.where(F.col("v") >= least)

    steps = [Step("kept", "keep", ["src"], {"least": 2}, min_rows=1), Step("twice", "union", ["kept", "kept"], columns=["id", "v"])]
    recipe = Recipe({"keep": keep, "union": lambda a, b: a.unionByName(b)}, steps)
    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, v int")
    first = recipe.run(spark, {"src": (df, "h1")}, str(tmp_path / "cache"))
    assert first.results["twice"].count() == 2 and not any(r["cached"] for r in first.record)
    again = recipe.run(spark, {"src": (df, "h1")}, str(tmp_path / "cache"))
    assert all(r["cached"] for r in again.record) and calls == [2]
    assert not any(r["cached"] for r in recipe.run(spark, {"src": (df, "h2")}, str(tmp_path / "cache")).record)
    with pytest.raises(ContractError):
        recipe.variants({"none": {"kept": {"least": 9}}})["none"].run(spark, {"src": (df, "h1")})
    with pytest.raises(ContractError):
        Recipe({"keep": keep}, [Step("a", "keep", ["b"]), Step("b", "keep", ["src"])]).run(spark, {"src": (df, "h")})


def test_encoding_repair(spark):
    bad = "北京".encode("gbk").decode("latin-1")
    df = spark.createDataFrame([(bad,), ("plain",), (None,)], "v string")
    assert [r[0] for r in table.repair_encoding(df, "v").collect()] == ["北京", "plain", None]
    fine = spark.createDataFrame([("Müller",), ("ÄÖ",)], "v string")
    assert [r[0] for r in table.repair_encoding(fine, "v").collect()] == ["Müller", "ÄÖ"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, f"2024-01-01 {k // 60:02d}:{k % 60:02d}:00", k % 3, "a" if k % 2 else "b", float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value")
    late = df.unionByName(df.limit(1).select(F.lit(999).cast("long").alias("event_id"), F.to_timestamp(F.lit("2024-01-09 00:00:00")).alias("ts"), "user_id", "event_type", "value"))
    late.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), late.schema)
    events.run_to_end(events.tumbling(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, events.tumbling(df, "1 hour").collect()))
