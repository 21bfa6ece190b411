"""Hand-computed cases of table, key, version and rule operators."""

import pytest
from pyspark.sql import functions as F

from fieldloom.contracts import ContractError
from fieldloom.functions import filters, text
from fieldloom.operators import aggregates, analysis, joins, order, rules, table, versions


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_identifiers(spark):
    rows = frame(spark, "v string", ("01-03",), ("１－３",), ("01—03",), (" dy 01 ",), ("03-03-02",), (None,), ("",), ("000",))
    assert [r[0] for r in rows.select(text.normalize_id(F.col("v"))).collect()] == ["1-3", "1-3", "1-3", "DY1", "3-3-2", None, None, "0"]
    assert frame(spark, "v double", (103.0,)).select(text.number_key(F.col("v"))).first()[0] == "103"


def test_coordinates(spark):
    rows = frame(spark, "v string", ("12",), ("12°30'00\"N",), ("12:30:0W",), ("-12°30'0\"",), ("12:60:0",), ("nan",), ("-12°30'0\"N",))
    assert [r[0] for r in rows.select(text.coordinate(F.col("v"))).collect()] == [12.0, 12.5, -12.5, -12.5, None, None, None]


def test_normalize(spark):
    src = frame(spark, "id string, x string, y string, value string, when string", ("001", "1", "1", "4", "2024-02-29"), ("002", "bad", "1", "4", "2024-02-29"), ("003", "2", "1", "1.1", "2024-02-29"), ("004", "3", "1", "4", "2024-02-29"), ("005", "4", "1", "4", "2024-02-29"), ("005", "5", "1", "4", "2024-02-29"))
    out = table.normalize(src, "id", {"n": {"source": "value", "type": "int"}, "day": {"source": "when", "type": "date", "format": "yyyy-MM-dd"}}, "x", "y")
    assert sorted(r["id"] for r in out.accepted.collect()) == ["001", "004"]
    assert sorted((r["field"], r["reason"]) for r in out.failures.collect()) == [("geometry", "illegal coordinates"), ("id", "missing or duplicate key"), ("id", "missing or duplicate key"), ("value", "not a int")]
    assert tuple(out.counts.first()) == (6, 2, 4)


def test_casts_refuse(spark):
    with pytest.raises(ContractError):
        table.cast(frame(spark, "v string", ("yes",), ("maybe",)), "v", "bool")
    assert [r[0] for r in table.cast(frame(spark, "v string", ("yes",), (None,), ("0",)), "v", "bool").collect()] == [True, None, False]
    with pytest.raises(ContractError):
        table.cast(frame(spark, "v string", ("1.5",)), "v", "int")


def test_merge_types(spark):
    out = table.merge([("a", frame(spark, "k int, v int", (1, 2))), ("b", frame(spark, "k long, w string", (3, "x")))])
    assert out.schema["v"].dataType.simpleString() == "bigint" and sorted(map(tuple, out.collect()))[0] == (1, 2, None, "a")


def test_update(spark):
    left, right = frame(spark, "id string, v int", ("01", 1), ("02", 2)), frame(spark, "id string, v int", ("01", 3), ("03", 4))
    out = versions.update(left, right, "id", ["v"], append=True)
    assert sorted(map(tuple, out.table.collect())) == [("01", 3), ("02", 2), ("03", 4)]
    assert [r[0] for r in out.unmatched_left.collect()] == ["02"]
    kept = versions.update(left, right, "id", ["v"])
    assert ("03", None, None, None, False) in [tuple(r) for r in kept.changes.collect()]
    with pytest.raises(ContractError):
        versions.update(left, right.union(right), "id", ["v"])


def test_rules(spark):
    df = frame(spark, "id string, v int, code string", ("a", None, "X"), ("a2", 2, "bad"))
    other = frame(spark, "code string", ("X",))
    asked = [{"id": "r", "kind": "required", "field": "v"}, {"id": "e", "kind": "enum", "field": "v", "values": [3]}, {"id": "c", "kind": "compare", "field": "v", "op": "ge", "value": 5}, {"id": "f", "kind": "foreign_key", "field": "code", "right_field": "code"}]
    found = rules.violations(df, "id", asked, other)
    assert sorted((r["rule_id"], r["source_id"]) for r in found.collect()) == [("c", "a"), ("c", "a2"), ("e", "a"), ("e", "a2"), ("f", "a2"), ("r", "a")]
    assert not rules.passed(found)
    excused = rules.violations(df, "id", asked[:1], None, [{"rule_id": "r", "source_id": "a", "approved_by": "me", "rules_sha256": rules.rules_hash(asked[:1]), "input_sha256": "h"}], "h")
    assert rules.passed(excused)


def test_filter_nulls(spark):
    df = frame(spark, "v int", (1,), (None,))
    keep = lambda t: [r[0] for r in df.where(filters.compile_filter(t, df.columns)).collect()]
    assert keep({"field": "v", "op": "!=", "value": 1}) == [None]
    assert keep({"field": "v", "op": "notIn", "value": [1]}) == [None]
    assert keep({"not": {"field": "v", "op": ">", "value": 5}}) == [1, None]
    with pytest.raises(ContractError):
        keep({"field": "w", "op": "==", "value": 1})


def test_weighted(spark):
    df = frame(spark, "g string, v double, w double, c string", ("a", 0.2, 1.0, "red"), ("a", 0.8, 3.0, "blue"), ("b", 0.5, 0.0, "red"))
    assert {r["g"]: (r["ratio"] and round(r["ratio"], 9), r["status"]) for r in aggregates.weighted_ratio(df, "g", "v", "w").collect()} == {"a": (0.65, "ok"), "b": (None, "zero_weight")}
    assert {(r["g"], r["c"]): r["fraction"] for r in aggregates.weighted_category(df, "g", "c", "w").collect()}[("a", "blue")] == 0.75
    with pytest.raises(ContractError):
        aggregates.weighted_ratio(df.withColumn("w", F.lit(-1.0)), "g", "v", "w")


def test_dissolve_keeps_nulls(spark):
    df = frame(spark, "g string, k int, s string, v double", (None, 1, None, None), (None, 2, "x", None), ("a", 1, "y", 2.0))
    out = {r["g"]: (r["first_s"], r["sum_v"], r["n"]) for r in aggregates.dissolve(df, ["g"], ["k"], ["s"], ["v"]).collect()}
    assert out == {None: (None, None, 2), "a": ("y", 2.0, 1)}


def test_collapsed_breaks(spark):
    with pytest.raises(ContractError):
        aggregates.breaks(frame(spark, "v double", *[(1.0,)] * 9, (2.0,)), "v", "quantile", 4)


def test_join_reports(spark):
    left = frame(spark, "pid string", ("01-01",), ("01-02",), ("01-03",), ("01-10",), (None,))
    right = frame(spark, "k string, v int", ("1-1", 1), ("０１－０２", 2), ("01—03", 3), ("01-03", 4), ("09-09", 5))
    report = joins.key_report(left, right, "pid", "k", "id")
    assert sorted(map(tuple, report.unmatched.collect())) == [("left", "01-10"), ("right", "09-09")]
    assert [tuple(r) for r in report.duplicates.collect()] == [("right", "1-3", 2)]
    assert {r["side"]: r["rows"] for r in report.without_key.collect()} == {"left": 1, "right": 0}
    assert joins.keyed_join(left, right, "pid", "k", "id").where("v is not null").count() == 4


def test_suitability(spark):
    df = frame(spark, "id string, a double, b double", ("b", 10.0, 0.0), ("a", 0.0, 10.0), ("c", float("nan"), 5.0))
    c = {"a": analysis.Criterion("a", 0, 10), "b": analysis.Criterion("b", 0, 10)}
    s = [{"id": "base", "weights": {"a": 3, "b": 1}, "threshold": 0.5}, {"id": "other", "weights": {"a": 1, "b": 3}, "threshold": 0.5}]
    out = analysis.suitability(df, "id", c, s)
    assert {r["id"]: r["score"] for r in out.where("scenario = 'base'").collect()} == {"a": 0.25, "b": 0.75, "c": None}
    assert not any(r["stable_selected"] for r in analysis.stability(out).collect())
    assert sorted(map(tuple, analysis.scenario_changes(out, "base").collect())) == [("other", "a", "newly_selected"), ("other", "b", "lost_selected")]
    assert {(r["scenario"], r["id"]): r["rank"] for r in out.collect()} == {("base", "b"): 1, ("base", "a"): 2, ("base", "c"): None, ("other", "a"): 1, ("other", "b"): 2, ("other", "c"): None}


def test_running_totals(spark):
    rows = [(g, k * 7 % 100, k % 4) for g in ("a", None) for k in range(100)]
    got = order.running_totals(frame(spark, "g string, v int, n int", *rows).repartition(5), ["g"], ["v"], "n", "before")
    for g in ("a", None):
        own = sorted((v, n) for h, v, n in rows if h == g)
        want = [sum(n for _, n in own[:k]) for k in range(100)]
        assert [r["before"] for r in got.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("v").collect()] == want
    assert order.running_totals(frame(spark, "v int, n int", (2, 5), (1, 3)), [], ["v"], "n", "before").orderBy("v").collect() == [(1, 3, 0), (2, 5, 3)]


def test_false_discovery(spark):
    p = [0.001, 0.001, 0.008, 0.03, 0.2, 0.9, 0.041]
    got = {r["k"]: r["significant"] for r in analysis.false_discovery(frame(spark, "k int, p double", *enumerate(p)), "k", "p").collect()}
    h = sum(1 / k for k in range(1, 8))
    cut = max((x for k, x in enumerate(sorted(p), 1) if x <= k * 0.05 / (7 * h)), default=-1)
    assert got == {k: x <= cut for k, x in enumerate(p)} and sum(got.values()) >= 2
