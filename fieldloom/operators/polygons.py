"""Polygons with holes and several parts: measures, predicates, overlay and dissolving, in built-in expressions.

A polygon is ARRAY<ARRAY<ARRAY<STRUCT<x, y>>>>: parts, the rings of a part (shell first, then holes), vertices; rings may
repeat their first vertex. Its edges are directed so that the inside lies to the left. A polygon's points are those that
have more of its edges to the left above them than to the right; hence the area that two polygons share is a sum, over
pairs of their edges, of the signed area under both edges, which has a closed form. Pairs come from the grid join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import require
from ..functions import shapes
from ..sources.scratch import written
from .graph import connected_components
from .spatial import Boxes, candidates

PREDICATES = ("intersects", "within", "contains", "overlaps", "touches")
#: Share of an area below which a difference is rounding.
ROUNDING = 1e-9


def _edge(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def edges(parts: Column) -> Column:
    """All edges, shells counter-clockwise and holes clockwise; edges without length are left out."""
    def directed(ring: Column, k: Column) -> Column:
        steps = F.filter(shapes._steps(ring, True), lambda s: s["p"] != s["q"])
        ahead = F.transform(steps, lambda s: _edge(s["p"]["x"], s["p"]["y"], s["q"]["x"], s["q"]["y"]))
        back = F.transform(steps, lambda s: _edge(s["q"]["x"], s["q"]["y"], s["p"]["x"], s["p"]["y"]))
        return F.when((shapes.signed_area(ring) > 0) == (k == 0), ahead).otherwise(back)

    return F.flatten(F.transform(parts, lambda part: F.flatten(F.transform(part, directed))))


def area(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda acc, e: acc + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def perimeter(own: Column) -> Column:
    return F.aggregate(own, F.lit(0.0), lambda acc, e: acc + F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def centroid(own: Column) -> Column:
    """Struct x, y, weighed by area."""
    axis = lambda a, b: F.aggregate(own, F.lit(0.0), lambda acc, e: acc + (e[a] + e[b]) * (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / (6 * area(own))
    return F.struct(axis("x1", "x2").alias("x"), axis("y1", "y2").alias("y"))


def side(own: Column, x: Column, y: Column) -> Column:
    """1 inside, 0 on the boundary, -1 outside."""
    def on(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (cross == 0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    crossed = F.filter(own, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.when(F.exists(own, on), 0).when(F.size(crossed) % 2 == 1, 1).otherwise(-1)


def representative_point(own: Column) -> Column:
    """Struct x, y inside the polygon: the middle of the widest stretch at a height between two vertices near the middle."""
    ys = F.sort_array(F.array_distinct(F.transform(own, lambda e: e["y1"])))
    at = F.floor(F.size(ys) / 2).cast("int")
    y = (F.element_at(ys, at) + F.element_at(ys, at + 1)) / 2

    def widest(height: Column) -> Column:
        across = F.filter(own, lambda e: (e["y1"] > height) != (e["y2"] > height))
        xs = F.sort_array(F.transform(across, lambda e: (e["x2"] - e["x1"]) * (height - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
        gaps = F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x")))
        inner = F.filter(gaps, lambda g, k: (k % 2 == 0) & g["w"].isNotNull())
        return F.struct(F.array_max(inner)["x"].alias("x"), height.alias("y"))

    return F.transform(F.array(y), widest)[0]


def shared_area(a: Column, b: Column, base: Column) -> Column:
    """Area that two polygons, given by their edges, have in common. base: a height near them, against rounding."""
    def under(e: Column, f: Column) -> Column:
        lo = F.greatest(F.least(e["x1"], e["x2"]), F.least(f["x1"], f["x2"]))
        hi = F.least(F.greatest(e["x1"], e["x2"]), F.greatest(f["x1"], f["x2"]))
        height = lambda s, x: s["y1"] - base + (s["y2"] - s["y1"]) * (x - s["x1"]) / (s["x2"] - s["x1"])
        v0, v1 = height(f, lo), height(f, hi)
        d0, d1 = height(e, lo) - v0, height(e, hi) - v1
        below = F.when((d0 <= 0) & (d1 <= 0), (d0 + d1) / 2).when((d0 >= 0) & (d1 >= 0), 0.0).otherwise(-F.pow(F.least(d0, d1), F.lit(2)) / (2 * F.abs(d1 - d0)))
        sign = F.signum(e["x1"] - e["x2"]) * F.signum(f["x1"] - f["x2"])
        return F.when(hi > lo, sign * (hi - lo) * ((v0 + v1) / 2 + below)).otherwise(0.0)

    level = lambda own: F.filter(own, lambda e: e["x1"] != e["x2"])  # noqa: E731  upright edges have nothing under them
    each = lambda e: F.aggregate(level(b), F.lit(0.0), lambda acc, f: acc + under(e, f))
    return F.aggregate(level(a), F.lit(0.0), lambda acc, e: acc + each(e))


def _turn(e: Column, x: Column, y: Column) -> Column:
    return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))


def _meet(e: Column, f: Column) -> Column:
    """Whether two edges have a point in common."""
    box = (F.greatest(e["x1"], e["x2"]) >= F.least(f["x1"], f["x2"])) & (F.greatest(f["x1"], f["x2"]) >= F.least(e["x1"], e["x2"]))
    box &= (F.greatest(e["y1"], e["y2"]) >= F.least(f["y1"], f["y2"])) & (F.greatest(f["y1"], f["y2"]) >= F.least(e["y1"], e["y2"]))
    return box & (_turn(e, f["x1"], f["y1"]) * _turn(e, f["x2"], f["y2"]) <= 0) & (_turn(f, e["x1"], e["y1"]) * _turn(f, e["x2"], e["y2"]) <= 0)


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges cross at a point within both."""
    return (_turn(e, f["x1"], f["y1"]) * _turn(e, f["x2"], f["y2"]) < 0) & (_turn(f, e["x1"], e["y1"]) * _turn(f, e["x2"], e["y2"]) < 0)


def meet(a: Column, b: Column) -> Column:
    """Whether two polygons have a point in common: edges meet, or one holds a vertex of the other."""
    touching = F.exists(a, lambda e: F.exists(b, lambda f: _meet(e, f)))
    holds = lambda outer, inner: F.exists(inner, lambda e: side(outer, e["x1"], e["y1"]) >= 0)
    return touching | holds(b, a) | holds(a, b)


def problem(parts: Column) -> Column:
    """Null for a valid polygon, else the first of: empty, short ring, no area, self crossing, hole outside."""
    rings, own = F.flatten(parts), edges(parts)
    short = F.exists(rings, lambda r: F.size(F.array_distinct(r)) < 3)
    flat = F.exists(rings, lambda r: shapes.signed_area(r) == 0)
    crossing = F.exists(own, lambda e: F.exists(own, lambda f: _cross(e, f)))
    shell = lambda part: edges(F.array(F.slice(part, 1, 1)))
    outside = F.exists(parts, lambda part: F.exists(F.slice(part, F.lit(2), F.size(part)), lambda hole: F.exists(hole, lambda p: side(shell(part), p["x"], p["y"]) < 0)))
    return (
        F.when(parts.isNull() | (F.size(parts) == 0) | (F.size(F.flatten(parts)) == 0), "empty").when(short, "short ring").when(flat, "no area")
        .when(crossing, "self crossing").when(outside, "hole outside")
    )


def repaired(parts: Column) -> Column:
    """Rings without vertices that repeat the one before, without rings that have no area; parts without a shell go."""
    def ring(r: Column) -> Column:
        kept = F.filter(r, lambda p, k: (k == 0) | (p != F.get(r, k - 1)))
        closed = (F.size(kept) > 1) & (F.element_at(kept, 1) == F.element_at(kept, -1))
        return F.when(closed, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept)

    whole = F.filter(parts, lambda part: (F.size(part) > 0) & (shapes.signed_area(part[0]) != 0))
    return F.transform(whole, lambda part: F.transform(F.filter(part, lambda r: shapes.signed_area(r) != 0), ring))


def prepared(df: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """id, edges, area, bounds of the polygons that have any area; null and empty ones are left out."""
    rows = df.select(F.col(key).alias("id"), edges(F.col(parts)).alias("edges")).where("size(edges) > 0")
    ends = lambda pick, axis: pick(F.transform("edges", lambda e: e[axis]))
    return rows.select(
        "id", "edges", area(F.col("edges")).alias("area"), ends(F.array_min, "x1").alias("xmin"), ends(F.array_min, "y1").alias("ymin"), ends(F.array_max, "x1").alias("xmax"), ends(F.array_max, "y1").alias("ymax")
    )


def measures(df: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """id, area, perimeter, cx, cy (centroid), px, py (a point inside)."""
    own = F.col("edges")
    rows = prepared(df, key, parts).select("id", "area", perimeter(own).alias("perimeter"), centroid(own).alias("c"), representative_point(own).alias("p"))
    return rows.select("id", "area", "perimeter", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def explode_parts(df: DataFrame, parts: str = "parts", place: str = "part") -> DataFrame:
    """One row a part, its number in `place`; null and empty polygons have none."""
    kept = [c for c in df.columns if c != parts]
    rows = df.select(*kept, F.posexplode(parts).alias(place, "_part"))
    return rows.select(*kept, place, F.array("_part").alias(parts))


def boundaries(df: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """id, part, ring (0: the shell), line: the closed rings as lines."""
    rings = df.select(F.col(key).alias("id"), F.posexplode(parts).alias("part", "_rings")).select("id", "part", F.posexplode("_rings").alias("ring", "_line"))
    closed = F.when(F.element_at("_line", 1) == F.element_at("_line", -1), F.col("_line")).otherwise(F.concat("_line", F.slice("_line", 1, 1)))
    return rings.where("size(_line) > 2").select("id", "part", "ring", closed.alias("line"))


def points_in(polygons: DataFrame, points: Boxes, predicate: str = "intersects") -> DataFrame:
    """polygon_id, point_id. polygons: prepared(); intersects: the boundary counts; within: it doesn't."""
    require(predicate in ("intersects", "within"), "unknown predicate")
    found = candidates(points, Boxes(polygons, "id")).select("left_id", "right_id", "left_x0", "left_y0")
    place = side(F.col("edges"), F.col("left_x0"), F.col("left_y0"))
    held = found.join(polygons.select(F.col("id").alias("right_id"), "edges"), "right_id")
    return held.where(place >= (0 if predicate == "intersects" else 1)).select(F.col("right_id").alias("polygon_id"), F.col("left_id").alias("point_id"))


def _both(left: DataFrame, right: DataFrame) -> DataFrame:
    """Candidate pairs with both sides' edges and areas."""
    half = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("edges").alias(f"{name}_edges"), F.col("area").alias(f"{name}_area"))
    found = candidates(Boxes(left, "id"), Boxes(right, "id")).select("left_id", "right_id", F.greatest("left_y0", "right_y0").alias("base"))
    return found.join(half(left, "left"), "left_id").join(half(right, "right"), "right_id")


def overlay(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, area, left_area, right_area of pairs of prepared() polygons that share an area."""
    pairs = _both(left, right).withColumn("area", shared_area(F.col("left_edges"), F.col("right_edges"), F.col("base")))
    return pairs.where(F.col("area") > ROUNDING * F.least("left_area", "right_area")).select("left_id", "right_id", "area", "left_area", "right_area")


def join_pairs(left: DataFrame, right: DataFrame, predicate: str = "intersects") -> DataFrame:
    """left_id, right_id of prepared() polygons. within, contains: up to rounding, all of the inner one's area; overlaps: an
    area in common; touches: points in common, but no area."""
    require(predicate in PREDICATES, "unknown predicate")
    shared = shared_area(F.col("left_edges"), F.col("right_edges"), F.col("base"))
    pairs, a, b = _both(left, right), F.col("left_edges"), F.col("right_edges")
    if predicate == "intersects":
        return pairs.where(meet(a, b)).select("left_id", "right_id")
    pairs = pairs.withColumn("shared", shared)
    some = F.col("shared") > ROUNDING * F.least("left_area", "right_area")
    whole: Callable[[str], Column] = lambda name: F.col("shared") >= (1 - ROUNDING) * F.col(f"{name}_area")
    test = {"overlaps": some, "within": whole("left"), "contains": whole("right"), "touches": ~some & meet(a, b)}[predicate]
    return pairs.where(test).select("left_id", "right_id")


def overlay_areas(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, area, shared, rest of each left polygon against right ones that don't overlap each other."""
    shared = overlay(left, right).groupBy("left_id").agg(F.sum("area").alias("shared"))
    s = F.coalesce("shared", F.lit(0.0))
    return left.select(F.col("id").alias("left_id"), "area").join(shared, "left_id", "left").select("left_id", "area", s.alias("shared"), (F.col("area") - s).alias("rest"))


def _noded(rows: DataFrame) -> DataFrame:
    """by, x1, y1, x2, y2: edges cut where a vertex of the same group lies on them."""
    rows = written(rows.withColumn("edge", F.monotonically_increasing_id()), "edges")
    box = rows.select("edge", "by", "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("xmin"), F.least("y1", "y2").alias("ymin"), F.greatest("x1", "x2").alias("xmax"), F.greatest("y1", "y2").alias("ymax"))
    corners = written(rows.select("by", F.col("x1").alias("x"), F.col("y1").alias("y")).distinct().withColumn("corner", F.monotonically_increasing_id()), "corners")
    near = candidates(Boxes(corners, "corner", "x", "y", "x", "y"), Boxes(box, "edge")).select(F.col("left_id").alias("corner"), F.col("right_id").alias("edge"))
    hits = near.join(corners.withColumnRenamed("by", "group"), "corner").join(rows, "edge").where(F.col("group").eqNullSafe(F.col("by")))
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    along = (F.col("x") - F.col("x1")) * (F.col("x2") - F.col("x1")) + (F.col("y") - F.col("y1")) * (F.col("y2") - F.col("y1"))
    inner = hits.where((cross == 0) & ((F.col("x") != F.col("x1")) | (F.col("y") != F.col("y1"))) & ((F.col("x") != F.col("x2")) | (F.col("y") != F.col("y2"))))
    cuts = inner.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct(along.alias("along"), "x", "y"))).alias("cuts"))
    ends = F.concat(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))), F.transform(F.coalesce("cuts", F.array().cast("array<struct<along:double,x:double,y:double>>")), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))), F.array(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))))
    steps = rows.join(cuts, "edge", "left").select("by", F.inline(F.filter(F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends)), lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda s: s["q"].isNotNull())))
    return steps.select("by", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))


def outlines(df: DataFrame, by: str, parts: str = "parts") -> DataFrame:
    """by, x1, y1, x2, y2: the directed edges of each group's union (null is a group).

    Polygons of a group may share borders, also where a vertex of one lies on an edge of the other, but no area: edges
    that two of them have in opposite directions cancel.
    """
    own = _noded(df.select(F.col(by).alias("by"), F.inline(edges(F.col(parts)))))
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    pick = lambda a, b: F.when(ahead, F.col(a)).otherwise(F.col(b))
    lines = own.select("by", pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by_"), F.when(ahead, 1).otherwise(-1).alias("way"))
    left = lines.groupBy("by", "ax", "ay", "bx", "by_").agg(F.sum("way").alias("way")).where("way != 0")
    pick = lambda a, b: F.when(F.col("way") > 0, F.col(a)).otherwise(F.col(b))
    return left.select("by", pick("ax", "bx").alias("x1"), pick("ay", "by_").alias("y1"), pick("bx", "ax").alias("x2"), pick("by_", "ay").alias("y2"))


def refuse_shared_areas(polygons: DataFrame, what: str = "polygons") -> None:
    require(overlay(polygons, polygons).where(F.col("left_id") < F.col("right_id")).isEmpty(), f"{what} overlap")


def dissolve(df: DataFrame, by: str, parts: str = "parts") -> DataFrame:
    """by, area, perimeter, n_edges of each group's union; see outlines()."""
    doubled = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return outlines(df, by, parts).groupBy("by").agg((F.sum(doubled) / 2).alias("area"), F.sum(length).alias("perimeter"), F.count("*").alias("n_edges")).withColumnRenamed("by", by)


def closed_outlines(df: DataFrame, by: str, parts: str = "parts") -> DataFrame:
    """by, outline, area, n_edges: the connected outlines of each group's union; an enclosed gap has a negative area."""
    lines = written(outlines(df, by, parts), "outlines")
    corner = lambda x, y: F.to_json(F.struct(F.col("by").alias("g"), F.col(x).alias("x"), F.col(y).alias("y")))
    named = lines.withColumn("a", corner("x1", "y1")).withColumn("b", corner("x2", "y2"))
    roots = connected_components(named, "a", "b").select(F.col("node").alias("a"), F.col("root").alias("outline"))
    doubled = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return named.join(roots, "a").groupBy("by", "outline").agg((F.sum(doubled) / 2).alias("area"), F.count("*").alias("n_edges")).withColumnRenamed("by", by)


def gaps(df: DataFrame, parts: str = "parts", min_area: float = 0.0) -> DataFrame:
    """area, n_edges of the gaps that a coverage encloses and that are larger than min_area."""
    found = closed_outlines(df.select(F.lit(0).alias("_all"), F.col(parts).alias("parts")), "_all")
    return found.where(F.col("area") < -min_area).select((-F.col("area")).alias("area"), "n_edges")
