"""Feature layers: rings, grids, generalisation, restrictions, labels and drawings already extracted to tables."""

from __future__ import annotations

import fnmatch

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require
from ..sources.scratch import written
from .graph import connected_components
from .spatial import Boxes, area, candidates, cell_size, intersection_area, near, pairs


def concentric(df: DataFrame, distances: list[float], key: str = "id") -> DataFrame:
    """key, ring, lo, hi, xmin, ymin, xmax, ymax: the boxes grown by each distance, one row a ring."""
    require(all(a < b for a, b in zip([0.0, *distances], distances)), "distances must rise from above zero")
    rings = F.array(*(F.struct(F.lit(k + 1).alias("ring"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for k, (lo, hi) in enumerate(zip([0.0, *distances], distances))))
    r = df.withColumn("r", F.explode(rings))
    h = F.col("r.hi")
    return r.select(key, "r.ring", "r.lo", "r.hi", (F.col("xmin") - h).alias("xmin"), (F.col("ymin") - h).alias("ymin"), (F.col("xmax") + h).alias("xmax"), (F.col("ymax") + h).alias("ymax"))


def square_grid(spark, xmin: float, ymin: float, xmax: float, ymax: float, size: float) -> DataFrame:
    """cell_id "i:j", xmin, ymin, xmax, ymax of squares that cover an extent."""
    require(size > 0, "positive size needed")
    cols, rows = int(-((xmin - xmax) // size)), int(-((ymin - ymax) // size))
    g = spark.range(cols * rows).select((F.col("id") % cols).alias("i"), F.floor(F.col("id") / cols).alias("j"))
    x, y = F.lit(xmin) + F.col("i") * size, F.lit(ymin) + F.col("j") * size
    return g.select(F.concat_ws(":", F.col("i").cast("string"), F.col("j").cast("string")).alias("cell_id"), x.alias("xmin"), y.alias("ymin"), (x + size).alias("xmax"), (y + size).alias("ymax"))


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """"q:r" of the pointy-topped hexagon of a circumradius that holds a point (cube rounding)."""
    q = (x * (3**0.5 / 3) - y / 3) / size
    r = y * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return F.concat_ws(":", fq.cast("bigint").cast("string"), fr.cast("bigint").cast("string"))


def stratified(cells: DataFrame, seed: int = 0) -> DataFrame:
    """cells with one point each, placed by a hash of seed and cell."""
    share = lambda k: F.pmod(F.xxhash64("cell_id", F.lit(seed), F.lit(k)), F.lit(1_000_003)) / 1_000_003
    return cells.withColumn("x", F.col("xmin") + (F.col("xmax") - F.col("xmin")) * share(1)).withColumn("y", F.col("ymin") + (F.col("ymax") - F.col("ymin")) * share(2))


def select_free(boxes: Boxes, restrictions: Boxes, min_area: float = 0.0) -> DataFrame:
    """id, area, free_area, reason: what the restrictions (which don't overlap each other) leave of each box; too little gives a reason."""
    taken = pairs(boxes, restrictions, "overlaps").groupBy("left_id").agg(F.sum(intersection_area()).alias("taken"))
    own = boxes.bounds("left").select("left_id", area("left").alias("area")).join(taken, "left_id", "left")
    free = F.col("area") - F.coalesce("taken", F.lit(0.0))
    return own.select(F.col("left_id").alias("id"), "area", free.alias("free_area"), F.when(free <= 0, "fully_restricted").when(free < min_area, "below_min_area").alias("reason"))


def aggregate_points(pts: Boxes, distance: float, protected: list[str] = ()) -> DataFrame:
    """group, n, x, y: points linked within a distance as their centroid; protected ids stay alone."""
    ids = pts.df.select(F.col(pts.id).cast("string").alias("id"), F.col(pts.xmin).alias("x"), F.col(pts.ymin).alias("y"))
    free = ~F.col("id").isin(*protected) if protected else F.lit(True)
    links = near(pts, pts, distance).select(F.col("left_id").cast("string").alias("a"), F.col("right_id").cast("string").alias("b")).where("a < b")
    if protected:
        links = links.where(~F.col("a").isin(*protected) & ~F.col("b").isin(*protected))
    roots = connected_components(links)
    named = ids.join(roots, ids["id"] == roots["node"], "left").withColumn("group", F.when(free, F.coalesce("root", "id")).otherwise(F.col("id")))
    return named.groupBy("group").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def labels(faces: Boxes, texts: Boxes, value: str) -> DataFrame:
    """face_id, label, status: the texts inside a face. None: unassigned; several different: conflict; a text on two faces: on_boundary."""
    hits = pairs(texts, faces, "intersects").select(F.col("left_id").alias("text_id"), F.col("right_id").alias("face_id"))
    hits = hits.withColumn("n", F.count("*").over(Window.partitionBy("text_id"))).join(texts.df.select(F.col(texts.id).alias("text_id"), F.col(value).alias("v")), "text_id")
    g = hits.groupBy("face_id").agg(F.array_sort(F.collect_set(F.when(F.col("n") == 1, F.col("v")))).alias("vs"), F.bool_or(F.col("n") > 1).alias("edge"))
    all_faces = faces.df.select(F.col(faces.id).alias("face_id")).join(g, "face_id", "left")
    n = F.coalesce(F.size("vs"), F.lit(0))
    status = F.when(F.coalesce("edge", F.lit(False)), "on_boundary").when(F.col("vs").isNull() | (n == 0), "unassigned").when(n > 1, "conflict").otherwise("labelled")
    return all_faces.select("face_id", F.when(status == "labelled", F.get("vs", F.lit(0))).alias("label"), status.alias("status"))


def best_iou(left: Boxes, right: Boxes) -> DataFrame:
    """left_id, right_id, iou, covered: the best overlap by intersection over union, ties to the least id."""
    inter = intersection_area()
    found = pairs(left, right, "overlaps").select("left_id", "right_id", (inter / (area("left") + area("right") - inter)).alias("iou"), (inter / area("left")).alias("covered"))
    w = Window.partitionBy("left_id").orderBy(F.desc("iou"), "right_id")
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def overlay_shares(parcels: Boxes, references: Boxes) -> DataFrame:
    """left_id, right_id, area, left_share, right_share of every overlap."""
    inter = intersection_area()
    return pairs(parcels, references, "overlaps").select("left_id", "right_id", inter.alias("area"), (inter / area("left")).alias("left_share"), (inter / area("right")).alias("right_share"))


def containment_chain(probe: tuple[float, float], levels: list[Boxes]) -> list:
    """The id of the one unit at each level that holds a place; none or several are refused."""
    x, y = probe
    out = []
    for k, b in enumerate(levels):
        inside = b.df.where((F.col(b.xmin) <= x) & (F.col(b.xmax) > x) & (F.col(b.ymin) <= y) & (F.col(b.ymax) > y)).select(b.id).take(2)
        require(len(inside) == 1, f"level {k}: {len(inside)} units hold the place")
        out.append(inside[0][0])
    return out


def children(units: DataFrame, parent_field: str, parent, limit: int = 5000) -> DataFrame:
    out = units.where(F.col(parent_field) == parent)
    require(len(out.select(F.lit(1)).take(limit + 1)) <= limit, f"more than {limit} children")
    return out


def exclusions(df: DataFrame, rules: list[dict]) -> DataFrame:
    """df with excluded_by: the first rule that holds. Rules: id and one or more of layer (glob), block (glob), box."""
    hit = None
    for r in rules:
        tests = []
        for field in ("layer", "block"):
            if field in r:
                tests.append(F.col(field).rlike(fnmatch.translate(r[field]).replace("(?s:", "(?s)(?:", 1).replace(r"\Z", "$").replace(r"\z", "$")))
        if "box" in r:
            x0, y0, x1, y1 = r["box"]
            tests.append((F.col("xmin") >= x0) & (F.col("ymin") >= y0) & (F.col("xmax") <= x1) & (F.col("ymax") <= y1))
        require(bool(tests), "an exclusion rule needs a condition")
        both = tests[0]
        for t in tests[1:]:
            both &= t
        hit = F.when(both, F.lit(r["id"])) if hit is None else hit.when(both, F.lit(r["id"]))
    return df.withColumn("excluded_by", hit if hit is not None else F.lit(None).cast("string"))


def near_duplicates(boxes: Boxes, tolerance: float) -> DataFrame:
    """a, b (a < b) of boxes whose corners all lie within a tolerance: their Hausdorff distance is no larger."""
    d = [F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) for c in ("x0", "y0", "x1", "y1")]
    far = F.sqrt(F.pow(F.greatest(d[0], d[2]), 2) + F.pow(F.greatest(d[1], d[3]), 2))
    return candidates(boxes, boxes, None, tolerance).where((F.col("left_id") < F.col("right_id")) & (far <= tolerance)).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def snapped(df: DataFrame, step: float, *fields: str) -> DataFrame:
    """Coordinates on a lattice, halves to even."""
    return df.withColumns({f: F.rint(F.col(f) / step) * step for f in fields})


def map_extent(boxes: Boxes, extent: tuple[float, float, float, float], scope: str = "whole") -> DataFrame:
    """Features that meet an extent: whole, or clipped to it with a flag where that changed them; full keeps all."""
    require(scope in ("whole", "clip", "full"), "unknown scope")
    x0, y0, x1, y1 = extent
    if scope == "full":
        return boxes.df.withColumn("clipped", F.lit(False))
    met = boxes.df.where((F.col(boxes.xmin) <= x1) & (F.col(boxes.xmax) >= x0) & (F.col(boxes.ymin) <= y1) & (F.col(boxes.ymax) >= y0))
    if scope == "whole":
        return met.withColumn("clipped", F.lit(False))
    cut = (F.col(boxes.xmin) < x0) | (F.col(boxes.xmax) > x1) | (F.col(boxes.ymin) < y0) | (F.col(boxes.ymax) > y1)
    return met.withColumn("clipped", cut).withColumns({boxes.xmin: F.greatest(F.col(boxes.xmin), F.lit(x0)), boxes.xmax: F.least(F.col(boxes.xmax), F.lit(x1)), boxes.ymin: F.greatest(F.col(boxes.ymin), F.lit(y0)), boxes.ymax: F.least(F.col(boxes.ymax), F.lit(y1))})


def _union(rects) -> float:
    """Area of the union of (x0, y0, x1, y1): slabs between the distinct x, merged y intervals in each."""
    r = np.array([(v["x0"], v["y0"], v["x1"], v["y1"]) for v in rects], float)
    xs = np.unique(r[:, [0, 2]])
    order = r[np.argsort(r[:, 1], kind="stable")]
    total = 0.0
    for a, b in zip(xs[:-1], xs[1:]):
        end, covered = -np.inf, 0.0
        for _, lo, _, hi in order[(order[:, 0] <= a) & (order[:, 2] >= b)]:
            covered += max(0.0, hi - max(lo, end))
            end = max(end, hi)
        total += covered * (b - a)
    return total


def union_area(zones: Boxes, boxes: Boxes, size: float | None = None) -> DataFrame:
    """left_id, area, covered, ratio: how much of each zone the union of the boxes covers.

    Clipped boxes are cut at grid cells first, so that a dense zone is many small unions; equal pieces count once.
    """
    found = pairs(zones, boxes, "overlaps")
    clip = [F.greatest("left_x0", "right_x0"), F.greatest("left_y0", "right_y0"), F.least("left_x1", "right_x1"), F.least("left_y1", "right_y1")]
    c = found.select("left_id", *(v.alias(n) for v, n in zip(clip, ("x0", "y0", "x1", "y1"))))
    step = float(size or cell_size(boxes))
    last = lambda v: F.greatest(F.floor(F.col(f"{v}0") / step), F.ceil(F.col(f"{v}1") / step) - 1)
    cells = c.withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / step), last("x")))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y0") / step), last("y"))))
    cut = cells.select("left_id", "cx", "cy", F.struct(
        F.greatest("x0", F.col("cx") * step).alias("x0"), F.greatest("y0", F.col("cy") * step).alias("y0"), F.least("x1", (F.col("cx") + 1) * step).alias("x1"), F.least("y1", (F.col("cy") + 1) * step).alias("y1"),
    ).alias("r")).distinct()

    @F.pandas_udf("double")
    def union(groups: pd.Series) -> pd.Series:
        return groups.map(_union)

    parts = cut.groupBy("left_id", "cx", "cy").agg(F.collect_list("r").alias("rs")).select("left_id", union("rs").alias("u"))
    sums = parts.groupBy("left_id").agg(F.sum("u").alias("u"))
    own = zones.bounds("left").select("left_id", area("left").alias("area"))
    covered = F.coalesce("u", F.lit(0.0))
    return own.join(sums, "left_id", "left").select("left_id", "area", covered.alias("covered"), (covered / F.col("area")).alias("ratio"))


def trace_pointers(cells: DataFrame, starts: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """start, cell, step: chains of (cell, next) from start cells to where they end; a cycle is refused.

    Reach doubles each round: round r joins pointers of 2^r steps, so that a chain takes logarithmically many rounds.
    """
    jump = written(cells.select("cell", F.col("next").alias("to"), F.lit(1).cast("long").alias("d")).where("next is not null and next != cell"), "jumps")
    path = written(starts.select(F.col("cell").alias("start"), "cell", F.lit(0).cast("long").alias("step")).distinct(), "trace")
    reach = 1
    while True:
        j = jump.select(F.col("cell").alias("_c"), "to", "d")
        more = path.join(j, path["cell"] == j["_c"]).select("start", F.col("to").alias("cell"), (F.col("step") + F.col("d")).alias("step"))
        grown = written(path.unionByName(more).groupBy("start", "cell").agg(F.min("step").alias("step")), "trace")
        if grown.count() == path.count():
            return grown
        path, reach = grown, reach * 2
        require(reach <= 2 * max_steps, "a chain doesn't end")
        k = jump.select(F.col("cell").alias("to"), F.col("to").alias("far"), F.col("d").alias("d2"))
        jump = written(jump.join(k, "to").select("cell", F.col("far").alias("to"), (F.col("d") + F.col("d2")).alias("d")), "jumps")
