"""Spatial joins of points and boxes by an equi-join on grid cells.

Both sides are dealt to the cells that they touch and joined on the cell; a pair that meets in several cells is emitted
in the one that holds the upper of the lower-left corners, so that nothing has to be made distinct afterwards. The cell
size changes the work, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require
from ..sources.scratch import written

PREDICATES = ("intersects", "within", "contains", "overlaps")


@dataclass
class Boxes:
    """A table with an id and bounds; a point has equal ones."""

    df: DataFrame
    id: str
    xmin: str = "xmin"
    ymin: str = "ymin"
    xmax: str = "xmax"
    ymax: str = "ymax"

    def bounds(self, side: str, grow: float = 0.0) -> DataFrame:
        g = F.lit(float(grow))
        c = lambda n: F.col(n).cast("double")
        return self.df.select(
            F.col(self.id).alias(f"{side}_id"), c(self.xmin).alias(f"{side}_x0"), c(self.ymin).alias(f"{side}_y0"), c(self.xmax).alias(f"{side}_x1"), c(self.ymax).alias(f"{side}_y1"),
            (c(self.xmin) - g).alias("gx0"), (c(self.ymin) - g).alias("gy0"), (c(self.xmax) + g).alias("gx1"), (c(self.ymax) + g).alias("gy1"),
        )


def points(df: DataFrame, key: str, x: str = "x", y: str = "y") -> Boxes:
    return Boxes(df, key, x, y, x, y)


#: Cells along a box's side beyond which boxes are dealt to cells of twice, four times ... the size.
WIDE = 4


def _cells(bounds: DataFrame, size: float, side: str, levels: list[int], others: list[int]) -> DataFrame:
    """A row for each cell that a box touches, at its own level and at the higher ones that the other side has.

    A cell of level l is size * 2^l wide; a box's level is the least at which it is at most WIDE cells wide.
    """
    own = _level(F.greatest(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0")), size)
    rows = bounds.withColumn("own", own)
    if max([*levels, *others], default=0) == 0:
        rows = rows.withColumn("level", F.lit(0))
    else:
        higher = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col("own"))
        rows = rows.withColumn("level", F.explode(F.concat(F.array("own"), higher)))
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c: F.floor(F.col(c) / width).cast("bigint")
    xs = rows.withColumn("cx", F.explode(F.sequence(cell("gx0"), cell("gx1"))))
    placed = xs.withColumn("cy", F.explode(F.sequence(cell("gy0"), cell("gy1")))).withColumnsRenamed({"gx0": f"{side}_gx0", "gy0": f"{side}_gy0"})
    return placed.withColumn(f"{side}_own", F.col("own") == F.col("level")).drop("gx1", "gy1", "own")


def _level(extent: Column, size: float) -> Column:
    return F.when(extent <= WIDE * size, 0).otherwise(F.ceil(F.log2(extent / (WIDE * size)))).cast("int")


def _extents(s: Boxes) -> tuple[float, float, float, float, int]:
    """Mean width and height, the whole extent, the largest side, the number of boxes."""
    w, h = F.col(s.xmax) - F.col(s.xmin), F.col(s.ymax) - F.col(s.ymin)
    r = s.df.agg(F.avg(w), F.avg(h), F.greatest(F.max(s.xmax) - F.min(s.xmin), F.max(s.ymax) - F.min(s.ymin)), F.max(F.greatest(w, h)), F.count(F.when(w.isNotNull() & h.isNotNull(), 1))).first()
    return tuple(r) if r[4] else (0.0, 0.0, 0.0, 0.0, 0)


def _fitting(extents: list[tuple], least: float) -> float:
    best = least
    for w, h, whole, _, n in extents:
        if n:
            best = max(best, 2.0 * max(w, h), whole / max(1.0, math.sqrt(n)))
    return float(best)


def cell_size(*sides: Boxes, least: float = 1.0) -> float:
    """Twice the mean extent of the larger boxes' side, or the extent over the square root of the count for points."""
    return _fitting([_extents(s) for s in sides], least)


def candidates(left: Boxes, right: Boxes, size: float | None = None, within: float = 0.0) -> DataFrame:
    """Pairs of ids and bounds whose boxes, the left ones grown by `within`, meet. Each pair once.

    A box much larger than the others is dealt to wider cells, where the small ones visit it, so that no box has many
    cells; a pair meets at the level of its larger box.
    """
    extents = [_extents(left), _extents(right)]
    size = size or _fitting(extents, max(within, 1e-9))
    sides = [left.bounds("left", within), right.bounds("right")]
    levels: list[list[int]] = [[0], [0]]
    if max(e[3] for e in extents) + 2 * within > WIDE * size:
        extent = F.greatest(F.col("gx1") - F.col("gx0"), F.col("gy1") - F.col("gy0"))
        levels = [sorted(r[0] for r in df.select(_level(extent, size).alias("k")).where("k is not null").distinct().collect()) for df in sides]  # a few dozen at most
    a, b = _cells(sides[0], size, "left", levels[0], levels[1]), _cells(sides[1], size, "right", levels[1], levels[0])
    width = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    here = (F.floor(F.greatest("left_gx0", "right_gx0") / width) == F.col("cx")) & (F.floor(F.greatest("left_gy0", "right_gy0") / width) == F.col("cy")) & (F.col("left_own") | F.col("right_own"))
    w = F.lit(float(within))
    meet = (F.col("left_x0") - w <= F.col("right_x1")) & (F.col("right_x0") <= F.col("left_x1") + w) & (F.col("left_y0") - w <= F.col("right_y1")) & (F.col("right_y0") <= F.col("left_y1") + w)
    return a.join(b, ["level", "cx", "cy"]).where(here & meet).drop("level", "cx", "cy", "left_own", "right_own", "left_gx0", "left_gy0", "right_gx0", "right_gy0")


def intersection_area() -> Column:
    w = F.least("left_x1", "right_x1") - F.greatest("left_x0", "right_x0")
    h = F.least("left_y1", "right_y1") - F.greatest("left_y0", "right_y0")
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def area(side: str) -> Column:
    return (F.col(f"{side}_x1") - F.col(f"{side}_x0")) * (F.col(f"{side}_y1") - F.col(f"{side}_y0"))


def distance2() -> Column:
    """Squared distance of two boxes or points."""
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"left_{a}0") - F.col(f"right_{a}1"), F.col(f"right_{a}0") - F.col(f"left_{a}1"))
    return gap("x") * gap("x") + gap("y") * gap("y")


def _inside(inner: str, outer: str) -> Column:
    """Inside, boundary included, but not on the boundary alone."""
    i, o = (lambda n: F.col(f"{inner}_{n}")), (lambda n: F.col(f"{outer}_{n}"))
    covered = (i("x0") >= o("x0")) & (i("x1") <= o("x1")) & (i("y0") >= o("y0")) & (i("y1") <= o("y1"))
    touches_only = ((i("x0") == i("x1")) & ((i("x0") == o("x0")) | (i("x0") == o("x1")))) | ((i("y0") == i("y1")) & ((i("y0") == o("y0")) | (i("y0") == o("y1"))))
    return covered & ~touches_only


def pairs(left: Boxes, right: Boxes, predicate: str = "intersects", size: float | None = None) -> DataFrame:
    """left_id, right_id and bounds. intersects: boundaries count; within, contains: a place on the boundary alone doesn't; overlaps: positive area."""
    require(predicate in PREDICATES, "unknown predicate")
    c = candidates(left, right, size)
    test = {"intersects": F.lit(True), "within": _inside("left", "right"), "contains": _inside("right", "left"), "overlaps": intersection_area() > 0}[predicate]
    return c.where(test)


def spatial_join(left: Boxes, right: Boxes, value: str, agg: str, predicate: str = "intersects", how: str = "left", order: str | None = None, size: float | None = None) -> DataFrame:
    """left_id, match_count, value by left row (right row with how='right').

    first: the value of the first match by order, null included; count: its non-null values; sum: null if all are null;
    mean; all: one row a match. Unmatched rows stay unless inner.
    """
    require(how in ("left", "inner", "right") and agg in ("first", "count", "sum", "mean", "all"), "unknown join")
    if how == "right":
        flipped = {"within": "contains", "contains": "within"}.get(predicate, predicate)
        return spatial_join(right, left, value, agg, flipped, "left", order, size).withColumnRenamed("left_id", "right_id").withColumnRenamed("matched_id", "left_matched_id")
    found = pairs(left, right, predicate, size).select("left_id", "right_id")
    attributes = right.df.select(F.col(right.id).alias("right_id"), F.col(value).alias("_value"), F.col(order or right.id).alias("_order"))
    matched = found.join(attributes, "right_id")
    base = left.df.select(F.col(left.id).alias("left_id"))
    kind = "left" if how == "left" else "inner"
    if agg == "all":
        return base.join(matched.select("left_id", F.col("right_id").alias("matched_id"), F.col("_value").alias("value")), "left_id", kind)
    by = {"first": F.min(F.struct("_order", "_value"))["_value"], "count": F.count("_value"), "sum": F.sum("_value"), "mean": F.avg("_value")}[agg]
    grouped = matched.groupBy("left_id").agg(F.count("*").alias("match_count"), by.alias("value"))
    out = base.join(grouped, "left_id", kind).withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    return out.withColumn("value", F.coalesce("value", F.lit(0))) if agg == "count" else out


def near(left: Boxes, right: Boxes, radius: float, size: float | None = None) -> DataFrame:
    """left_id, right_id, dist2 of all pairs no farther than the radius."""
    return candidates(left, right, size, radius).withColumn("dist2", distance2()).where(F.col("dist2") <= radius * radius).select("left_id", "right_id", "dist2")


def nearest(left: Boxes, right: Boxes, max_distance: float, size: float | None = None) -> DataFrame:
    """left_id, right_id, dist2 of the nearest within reach, every tie kept."""
    w = Window.partitionBy("left_id").orderBy("dist2")
    return near(left, right, max_distance, size).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("left_id").orderBy("dist2", F.col("right_id").cast("string"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(left: Boxes, right: Boxes, k: int, radius: float | None = None, exclude_self: bool = False) -> DataFrame:
    """left_id, right_id, dist2, rank: exactly the k nearest (fewer if there are fewer), ties by id as text.

    Without a radius the reach doubles until every left row has k neighbours inside it or the reach covers everything;
    each round only takes the rows that still lack some.
    """
    drop_self = lambda d: d.where(F.col("left_id") != F.col("right_id")) if exclude_self else d
    if radius is not None:
        return _ranked(drop_self(near(left, right, radius)), k)
    x0, y0, x1, y1 = right.df.agg(F.min(right.xmin), F.min(right.ymin), F.max(right.xmax), F.max(right.ymax)).first()
    lx0, ly0, lx1, ly1 = left.df.agg(F.min(left.xmin), F.min(left.ymin), F.max(left.xmax), F.max(left.ymax)).first()
    n = right.df.count()
    if not n or lx0 is None:
        return _ranked(near(left, right, 0.0), k).limit(0)
    far = math.hypot(max(x1, lx1) - min(x0, lx0), max(y1, ly1) - min(y0, ly0)) + 1e-9
    reach = max(far / math.sqrt(n) * math.sqrt(k + 1), far / 1024)
    todo, out = written(left.df, "knn-rows"), None
    while True:
        last = reach >= far
        found = written(_ranked(drop_self(near(Boxes(todo, left.id, left.xmin, left.ymin, left.xmax, left.ymax), right, min(reach, far))), k), "knn-found")
        full = found if last else found.join(found.where(F.col("rank") == k).select("left_id"), "left_id", "left_semi")
        out = full if out is None else out.unionByName(full)
        if last:
            return out
        todo = written(todo.join(full.select(F.col("left_id").alias(left.id)).distinct(), left.id, "left_anti"), "knn-rows")
        if todo.isEmpty():
            return out
        reach *= 2


def bands(left: Boxes, right: Boxes, limits: list[float], cumulative: bool = False) -> DataFrame:
    """source_id, band, cnt, zeros included: rings (lower, upper], the first with 0, or cumulative reaches."""
    require(all(a < b for a, b in zip([0.0, *limits], limits)), "bands must rise from above zero")
    edges = F.array(*(F.struct(F.lit(k + 1).alias("band"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(zip([0.0, *limits], limits))))
    found = near(left, right, limits[-1]).withColumn("e", F.explode(edges))
    inside = F.col("dist2") <= F.col("e.hi") * F.col("e.hi")
    if not cumulative:
        inside &= (F.col("dist2") > F.col("e.lo") * F.col("e.lo")) | (F.col("e.band") == 1)
    counts = found.where(inside).groupBy(F.col("left_id").alias("source_id"), F.col("e.band").alias("band")).agg(F.count("*").alias("n"))
    all_bands = left.df.select(F.col(left.id).alias("source_id"), F.explode(F.sequence(F.lit(1), F.lit(len(limits)))).alias("band"))
    return all_bands.join(counts, ["source_id", "band"], "left").select("source_id", "band", F.coalesce("n", F.lit(0)).alias("cnt"))


def adjacency(boxes: Boxes, size: float | None = None) -> DataFrame:
    """a, b (a < b), contact (overlap, edge, point), shared_len, overlap_area."""
    w = F.least("left_x1", "right_x1") - F.greatest("left_x0", "right_x0")
    h = F.least("left_y1", "right_y1") - F.greatest("left_y0", "right_y0")
    found = candidates(boxes, boxes, size).where(F.col("left_id") < F.col("right_id"))
    contact = F.when((w > 0) & (h > 0), "overlap").when((w > 0) | (h > 0), "edge").otherwise("point")
    # edges that coincide: of overlapping boxes, those of equal sides
    same = lambda p, q, along: F.when(F.col(f"left_{p}") == F.col(f"right_{q}"), F.greatest(F.lit(0.0), along)).otherwise(0.0)
    shared = same("x0", "x0", h) + same("x1", "x1", h) + same("y0", "y0", w) + same("y1", "y1", w) + same("x0", "x1", h) + same("x1", "x0", h) + same("y0", "y1", w) + same("y1", "y0", w)
    return found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), contact.alias("contact"), shared.alias("shared_len"), intersection_area().alias("overlap_area"))


def overlay(left: Boxes, right: Boxes, size: float | None = None) -> DataFrame:
    """left_id, right_id, area of every intersection of positive area."""
    return pairs(left, right, "overlaps", size).select("left_id", "right_id", intersection_area().alias("area"))


def overlay_areas(left: Boxes, right: Boxes) -> DataFrame:
    """left_id, area, shared, rest: each left box's area, what the right boxes (which don't overlap each other) share of it, and what is left."""
    shared = overlay(left, right).groupBy("left_id").agg(F.sum("area").alias("shared"))
    own = left.bounds("left").select("left_id", area("left").alias("area"))
    s = F.coalesce("shared", F.lit(0.0))
    return own.join(shared, "left_id", "left").select("left_id", "area", s.alias("shared"), (F.col("area") - s).alias("rest"))


def refuse_overlaps(boxes: Boxes, what: str = "boxes") -> None:
    found = pairs(boxes, boxes, "overlaps").where(F.col("left_id") < F.col("right_id"))
    require(found.isEmpty(), f"{what} overlap")


def allocate(left: Boxes, right: Boxes, total: str, check: bool = True) -> DataFrame:
    """source, target, area, allocated: each left total spread by area over the right boxes it meets."""
    if check:
        refuse_overlaps(right, "targets")
    found = overlay(left, right)
    own = left.bounds("left").select("left_id", area("left").alias("whole")).join(left.df.select(F.col(left.id).alias("left_id"), F.col(total).cast("double").alias("total")), "left_id")
    return found.join(own, "left_id").select(F.col("left_id").alias("source"), F.col("right_id").alias("target"), "area", (F.col("total") * F.col("area") / F.col("whole")).alias("allocated"))


def balances(left: Boxes, allocated: DataFrame, total: str) -> DataFrame:
    """source, allocated, unallocated, max_target (largest share, then least id)."""
    sums = allocated.groupBy("source").agg(F.sum("allocated").alias("got"), F.min_by("target", F.struct(-F.col("area"), F.col("target"))).alias("max_target"))
    base = left.df.select(F.col(left.id).alias("source"), F.col(total).cast("double").alias("total"))
    got = F.coalesce("got", F.lit(0.0))
    return base.join(sums, "source", "left").select("source", got.alias("allocated"), (F.col("total") - got).alias("unallocated"), "max_target")


def grid_owner(cells: Boxes, pts: Boxes) -> DataFrame:
    """cell_id, cnt, density (per square kilometre): a point on boundaries belongs to the least cell id as text."""
    owner = pairs(pts, cells, "intersects").groupBy("left_id").agg(F.min(F.col("right_id").cast("string")).alias("key"))
    counts = owner.groupBy("key").agg(F.count("*").alias("n"))
    own = cells.bounds("right").select("right_id", area("right").alias("area"))
    n = F.coalesce("n", F.lit(0))
    return own.join(counts, F.col("right_id").cast("string") == F.col("key"), "left").select(F.col("right_id").alias("cell_id"), n.alias("cnt"), (n * 1e6 / F.col("area")).alias("density"))


def zone_cross(zones: Boxes, pts: Boxes, value: str, predicate: str = "within") -> DataFrame:
    """zone_id, cnt, total of the points in every zone, zones without points included (total null)."""
    found = pairs(pts, zones, predicate).select("left_id", "right_id").join(pts.df.select(F.col(pts.id).alias("left_id"), F.col(value).alias("_v")), "left_id")
    sums = found.groupBy("right_id").agg(F.count("*").alias("n"), F.sum("_v").alias("total"))
    return zones.df.select(F.col(zones.id).alias("zone_id")).join(sums, F.col("zone_id") == F.col("right_id"), "left").select("zone_id", F.coalesce("n", F.lit(0)).alias("cnt"), "total")


def topology(boxes: Boxes, min_overlap: float = 0.0) -> DataFrame:
    """a, b, kind (duplicate or overlap), area of pairs that overlap by more than min_overlap."""
    same = (F.col("left_x0") == F.col("right_x0")) & (F.col("left_y0") == F.col("right_y0")) & (F.col("left_x1") == F.col("right_x1")) & (F.col("left_y1") == F.col("right_y1"))
    found = pairs(boxes, boxes, "overlaps").where(F.col("left_id") < F.col("right_id")).withColumn("area", intersection_area())
    return found.where(same | (F.col("area") > min_overlap)).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), F.when(same, "duplicate").otherwise("overlap").alias("kind"), "area")


def buildings_by_parcel(parcels: Boxes, buildings: Boxes, floors: str, assignment: str = "area") -> DataFrame:
    """parcel, bldg_area, floor_area, far. area: by overlap; unique: all of a building to the parcel with most of it, ties to the least id."""
    require(assignment in ("area", "unique"), "unknown assignment")
    attributes = buildings.df.select(F.col(buildings.id).alias("right_id"), F.col(floors).cast("double").alias("floors"))
    found = pairs(parcels, buildings, "overlaps").select("left_id", "right_id", intersection_area().alias("part"), area("right").alias("whole")).join(attributes, "right_id")
    if assignment == "unique":
        w = Window.partitionBy("right_id").orderBy(F.desc("part"), "left_id")
        found = found.withColumn("_r", F.row_number().over(w)).where("_r = 1").withColumn("part", F.col("whole"))
    sums = found.groupBy("left_id").agg(F.sum("part").alias("b"), F.sum(F.col("part") * F.col("floors")).alias("f"))
    own = parcels.bounds("left").select("left_id", area("left").alias("area"))
    b, f = F.coalesce("b", F.lit(0.0)), F.coalesce("f", F.lit(0.0))
    return own.join(sums, "left_id", "left").select(F.col("left_id").alias("parcel"), b.alias("bldg_area"), f.alias("floor_area"), (f / F.col("area")).alias("far"))


def nearest_neighbour_index(pts: Boxes) -> DataFrame:
    """n, extent_area, mean_distance, expected, nni."""
    mean = knn(pts, pts, 1, exclude_self=True).agg(F.avg(F.sqrt("dist2")).alias("mean_distance"))
    whole = pts.df.agg(F.count("*").alias("n"), ((F.max(pts.xmin) - F.min(pts.xmin)) * (F.max(pts.ymin) - F.min(pts.ymin))).alias("extent_area"))
    expected = 0.5 / F.sqrt(F.col("n") / F.col("extent_area"))
    return whole.join(F.broadcast(mean), how="left").select("n", "extent_area", "mean_distance", expected.alias("expected"), (F.col("mean_distance") / expected).alias("nni"))
