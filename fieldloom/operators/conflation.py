"""Matching of two line or point layers by evidence. Lines are segments (x0, y0, x1, y1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import refuse_rows, require
from ..sources.scratch import written
from .spatial import Boxes, candidates


def _point_segment2(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x0) * dx + (py - y0) * dy, dx * dx + dy * dy), F.lit(0.0))))
    ex, ey = px - (x0 + t * dx), py - (y0 + t * dy)
    return ex * ex + ey * ey


def match_points(left: Boxes, right: Boxes, radius: float) -> DataFrame:
    """left_id, right_id, dist2, status: matched, or ambiguous if either side has another candidate."""
    from .spatial import near

    found = near(left, right, radius)
    many = (F.count("*").over(Window.partitionBy("left_id")) > 1) | (F.count("*").over(Window.partitionBy("right_id")) > 1)
    return found.withColumn("status", F.when(many, "ambiguous").otherwise("matched"))


def match_segments(left: DataFrame, right: DataFrame, radius: float, max_angle: float, min_overlap: float, key: str = "id") -> DataFrame:
    """left_id, right_id, start_m, end_m (overlap along the left line), angle, hausdorff, status (matched or ambiguous).

    A candidate lies within the radius (both ends of the overlap and the Hausdorff distance of the overlap), turns by no
    more than the angle and overlaps by the least length. Ambiguous: another candidate's interval overlaps its own.
    """
    require(0 < max_angle <= 90, "the angle lies between 0 and 90")
    def box(df: DataFrame) -> Boxes:
        return Boxes(df.withColumns({"xmin": F.least("x0", "x1"), "xmax": F.greatest("x0", "x1"), "ymin": F.least("y0", "y1"), "ymax": F.greatest("y0", "y1")}), key)

    l = left.select(F.col(key).alias("left_id"), *(F.col(c).cast("double").alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")))
    r = right.select(F.col(key).alias("right_id"), *(F.col(c).cast("double").alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")))
    found = candidates(box(left), box(right), None, radius).select("left_id", "right_id").join(l, "left_id").join(r, "right_id")
    c = F.col
    dx, dy, ex, ey = c("lx1") - c("lx0"), c("ly1") - c("ly0"), c("rx1") - c("rx0"), c("ry1") - c("ry0")
    length, other = F.sqrt(dx * dx + dy * dy), F.sqrt(ex * ex + ey * ey)
    along = lambda x, y: ((c(x) - c("lx0")) * dx + (c(y) - c("ly0")) * dy) / length
    t0, t1 = along("rx0", "ry0"), along("rx1", "ry1")
    start, end = F.greatest(F.lit(0.0), F.least(t0, t1)), F.least(length, F.greatest(t0, t1))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(dx * ex + dy * ey) / (length * other))))
    at = lambda m, p, d: c(p) + d * m / length
    ends2 = [_point_segment2(at(m, "lx0", dx), at(m, "ly0", dy), c("rx0"), c("ry0"), c("rx1"), c("ry1")) for m in (start, end)]
    shaped = found.where((length > 0) & (other > 0)).withColumns({"start_m": start, "end_m": end, "angle": angle, "hausdorff": F.sqrt(F.greatest(*ends2))})
    good = shaped.where((F.col("end_m") - F.col("start_m") >= min_overlap) & (F.col("angle") <= max_angle) & (F.col("hausdorff") <= radius)).select("left_id", "right_id", "start_m", "end_m", "angle", "hausdorff")
    o = good.select("left_id", F.col("right_id").alias("_o"), F.col("start_m").alias("_s"), F.col("end_m").alias("_e"))
    rivals = good.join(o, "left_id").where((F.col("right_id") != F.col("_o")) & (F.col("_s") < F.col("end_m")) & (F.col("start_m") < F.col("_e"))).select("left_id", "right_id").distinct()
    return good.join(rivals.withColumn("_a", F.lit(True)), ["left_id", "right_id"], "left").withColumn("status", F.when(F.col("_a"), "ambiguous").otherwise("matched")).drop("_a")


def split_at_matches(left: DataFrame, matches: DataFrame, key: str = "id") -> DataFrame:
    """left_id, source_start_m, source_end_m, status, right_id: each line cut at all measures of its matches."""
    length = F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    base = left.select(F.col(key).alias("left_id"), length.alias("length"))
    marks = base.select("left_id", F.lit(0.0).alias("m")).unionByName(base.select("left_id", F.col("length").alias("m"))).unionByName(matches.select("left_id", F.col("start_m").alias("m"))).unionByName(matches.select("left_id", F.col("end_m").alias("m"))).distinct()
    w = Window.partitionBy("left_id").orderBy("m")
    parts = marks.withColumn("e", F.lead("m").over(w)).where("e is not null").select("left_id", F.col("m").alias("s"), "e")
    j = parts.join(matches.select("left_id", "right_id", "start_m", "end_m"), "left_id", "left")
    middle = (F.col("s") + F.col("e")) / 2
    inside = (F.col("start_m") <= middle) & (middle <= F.col("end_m"))
    g = j.groupBy("left_id", "s", "e").agg(F.count(F.when(inside, 1)).alias("n"), F.min(F.when(inside, F.col("right_id"))).alias("right_id"))
    return g.select("left_id", F.col("s").alias("source_start_m"), F.col("e").alias("source_end_m"), F.when(F.col("n") == 0, "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("right_id")).alias("right_id"))


def transfer(left: DataFrame, right: DataFrame, matches: DataFrame, selections: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """left with the fields of approved pairs (left_id, right_id); a pair that isn't a candidate any more is refused."""
    lost = selections.join(matches.where("status = 'matched'").select("left_id", "right_id"), ["left_id", "right_id"], "left_anti")
    require(lost.isEmpty(), "a selected pair is not a current candidate")
    values = selections.join(right.select(F.col(key).alias("right_id"), *(F.col(f).alias(f"transferred_{f}") for f in fields)), "right_id")
    return left.join(values.drop("right_id").withColumnRenamed("left_id", key), key, "left")


def bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Degrees counter-clockwise from east, modulo 180."""
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def helmert(pairs: DataFrame) -> dict[str, float]:
    """a, b, tx, ty of the similarity transform (x', y') = (a x - b y + tx, b x + a y + ty) that fits (x, y, u, v) best, and rms."""
    m = pairs.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("u").alias("u"), F.avg("v").alias("v"), F.count("*").alias("n")).first()
    require(m["n"] >= 2, "two control points are needed")
    x, y, u, v = F.col("x") - m["x"], F.col("y") - m["y"], F.col("u") - m["u"], F.col("v") - m["v"]
    s = pairs.agg(F.sum(x * u + y * v).alias("p"), F.sum(x * v - y * u).alias("q"), F.sum(x * x + y * y).alias("r"), F.sum(u * u + v * v).alias("t")).first()
    require(s["r"] > 0, "control points coincide")
    a, b = s["p"] / s["r"], s["q"] / s["r"]
    rms = math.sqrt(max(0.0, s["t"] - (a * a + b * b) * s["r"]) / m["n"])
    return {"a": a, "b": b, "tx": m["u"] - a * m["x"] + b * m["y"], "ty": m["v"] - b * m["x"] - a * m["y"], "rms": rms}


def fingerprint(df: DataFrame) -> str:
    """Content hash of a table: equal for equal rows in any order and partitions, repeated rows count."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    part = lambda salt: F.sum(F.xxhash64(row, F.lit(salt)).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(2).alias("b")).first()
    return f"{r['n']}:{int(r['a'] or 0) % (1 << 64):016x}{int(r['b'] or 0) % (1 << 64):016x}"


def approved_transfer(left: DataFrame, right: DataFrame, matches: DataFrame, selections: DataFrame, fields: list[str], approved_by: str, left_print: str, right_print: str, key: str = "id") -> DataFrame:
    """transfer() of pairs approved for just these two tables: a missing name or a stale fingerprint is refused."""
    require(bool(approved_by) and fingerprint(left) == left_print and fingerprint(right) == right_print, "missing or stale approval")
    return transfer(left, right, matches, selections, fields, key)


def edge_match(lines: DataFrame, reference: DataFrame, approved: DataFrame, max_move: float, key: str = "id", line: str = "line") -> DataFrame:
    """key, line: lines whose approved ends lie where the reference lines' ends do, and all ends that coincided with them.

    lines, reference: a line is ARRAY<STRUCT<x, y>>. approved: source_id, source_end, target_id, target_end (0: first, -1:
    last vertex). Refused: unknown ids, two targets for one place, moves beyond max_move, lines that collapse, and
    crossings that come or go.
    """
    at = lambda c, end: F.element_at(c, F.when(F.col(end) == 0, 1).otherwise(-1))
    a = lines.select(F.col(key).alias("source_id"), F.col(line).alias("_a"))
    b = reference.select(F.col(key).alias("target_id"), F.col(line).alias("_b"))
    pairs = approved.join(a, "source_id", "left").join(b, "target_id", "left").select(at(F.col("_a"), "source_end").alias("p"), at(F.col("_b"), "target_end").alias("q"))
    refuse_rows(pairs, **{"unknown seam id": F.col("p").isNull() | F.col("q").isNull(), "move beyond the limit": F.hypot(F.col("p.x") - F.col("q.x"), F.col("p.y") - F.col("q.y")) > max_move})
    moves = written(pairs.distinct(), "seams")
    require(moves.groupBy("p").count().where("count > 1").isEmpty(), "conflicting targets for one place")
    first, last = moves.select(F.col("p").alias("_p0"), F.col("q").alias("_q0")), moves.select(F.col("p").alias("_p1"), F.col("q").alias("_q1"))
    rows = lines.select(F.col(key).alias("_id"), F.col(line).alias("_l")).join(first, F.element_at("_l", 1) == F.col("_p0"), "left").join(last, F.element_at("_l", -1) == F.col("_p1"), "left")
    inner = F.slice("_l", F.lit(2), F.size("_l") - 2)
    moved = rows.select("_id", F.concat(F.array(F.coalesce("_q0", F.element_at("_l", 1))), inner, F.array(F.coalesce("_q1", F.element_at("_l", -1)))).alias("_l"))
    moved = written(moved, "seam-lines")
    refuse_rows(moved, **{"collapsed line": F.size(F.array_distinct("_l")) < 2})
    old = crossings(lines.select(F.col(key).alias("_id"), F.col(line).alias("_l")), "_id", "_l")
    new = crossings(moved, "_id", "_l")
    require(old.join(new, ["a", "b"], "left_anti").isEmpty() and new.join(old, ["a", "b"], "left_anti").isEmpty(), "the seam changes crossings")
    return moved.select(F.col("_id").alias(key), F.col("_l").alias(line))


def segments(lines: DataFrame, key: str, line: str) -> DataFrame:
    """id, segment, x1, y1, x2, y2 of every step of every line."""
    steps = F.zip_with(F.slice(F.col(line), F.lit(1), F.size(line) - 1), F.slice(F.col(line), F.lit(2), F.size(line)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    return lines.where(F.size(line) > 1).select(F.col(key).alias("id"), F.posexplode(steps).alias("segment", "s")).select("id", "segment", "s.*")


def crossings(lines: DataFrame, key: str, line: str) -> DataFrame:
    """a, b: pairs of lines (a < b) whose segments cross at a point within both."""
    from .polygons import _cross

    own = written(segments(lines, key, line).withColumn("_k", F.monotonically_increasing_id()), "segments")
    box = own.select("_k", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))
    near = candidates(Boxes(box, "_k"), Boxes(box, "_k")).where("left_id < right_id").select("left_id", "right_id")
    one = lambda name: own.select(F.col("_k").alias(f"{name}_id"), F.col("id").alias(f"{name}_line"), F.struct("x1", "y1", "x2", "y2").alias(f"{name}_e"))
    both = near.join(one("left"), "left_id").join(one("right"), "right_id").where("left_line != right_line").where(_cross(F.col("left_e"), F.col("right_e")))
    return both.select(F.least("left_line", "right_line").alias("a"), F.greatest("left_line", "right_line").alias("b")).distinct()


def adopt(before: DataFrame, after: DataFrame, key: str, approved_by: str, before_print: str, after_print: str, max_area_change: float, max_move: float, parts: str = "parts", allow_structure_change: bool = False) -> DataFrame:
    """before with the polygons of after, attributes unchanged, if the approval is for just these tables and the change small.

    Refused: stale fingerprints, other ids, a change of area or of any vertex's distance to the other boundary beyond the
    limits, and other numbers of parts or rings unless these are allowed.
    """
    from .polygons import area, edges

    require(bool(approved_by) and fingerprint(before) == before_print and fingerprint(after) == after_print, "missing or stale approval")
    a = before.select(F.col(key).alias("_id"), F.col(parts).alias("_a"))
    b = after.select(F.col(key).alias("_id"), F.col(parts).alias("_b"))
    both = a.join(b, "_id", "full_outer").withColumn("_ea", edges(F.col("_a"))).withColumn("_eb", edges(F.col("_b")))

    def far(own: str, other: str) -> Column:
        """The largest distance of a vertex to the other boundary, squared."""
        reach = lambda e: F.array_min(F.transform(other, lambda f: _point_segment2(e["x1"], e["y1"], f["x1"], f["y1"], f["x2"], f["y2"])))
        return F.array_max(F.transform(own, reach))

    rings = lambda c: F.transform(F.col(c), lambda part: F.size(part))
    refuse_rows(both, **{
        "other ids": F.col("_a").isNull() | F.col("_b").isNull(), "area change": F.abs(area(F.col("_ea")) - area(F.col("_eb"))) > max_area_change,
        "moved too far": F.greatest(far("_ea", "_eb"), far("_eb", "_ea")) > max_move * max_move, "structure change": (rings("_a") != rings("_b")) & F.lit(not allow_structure_change),
    })
    return before.drop(parts).join(after.select(key, parts), key).select(*before.columns)
