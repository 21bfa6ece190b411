"""Scores, clusters and spatial statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import finite, require, stable_id
from ..sources.scratch import written
from .graph import connected_components
from .order import running_totals
from .spatial import Boxes, near


@dataclass(frozen=True)
class Criterion:
    field: str
    low: float
    high: float
    prefer: str = "high"


def suitability(df: DataFrame, key: str, criteria: dict[str, Criterion], scenarios: list[dict[str, Any]], constraints: list[tuple[str, float, float]] = (), restricted: DataFrame | None = None) -> DataFrame:
    """id, scenario, score, rank, eligible, selected, reasons. scenarios: id, weights (by criterion), threshold.

    A missing criterion or a broken constraint excludes, whatever its weight; so does an id in `restricted`. Ranks are
    competition ranks among the eligible; those excluded have neither score nor rank.
    """
    stable_id(df, key)
    ids = [s["id"] for s in scenarios]
    require(1 <= len(ids) <= 100 and len(set(ids)) == len(ids), "unique scenario ids are needed")
    scaled, reasons = {}, []
    for name, c in criteria.items():
        require(c.low < c.high and c.prefer in ("high", "low"), "criterion high must exceed low")
        v = finite(c.field)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - c.low) / (c.high - c.low)))
        scaled[name] = F.when(v.isNotNull(), share if c.prefer == "high" else 1 - share)
        reasons.append(F.when(v.isNull(), F.lit(f"missing:{name}")))
    for name, lo, hi in constraints:
        require(lo <= hi, "constraint range reversed")
        v = finite(name)
        reasons.append(F.when(v.isNull() | (v < lo) | (v > hi), F.lit(f"constraint:{name}")))
    base = df
    if restricted is not None:
        base = base.join(restricted.select(F.col(key)).distinct().withColumn("_hit", F.lit(True)), key, "left")
        reasons.append(F.when(F.col("_hit"), F.lit("restricted_intersection")))
    base = base.select(F.col(key).cast("string").alias("id"), F.array_compact(F.array(*reasons)).alias("reasons"), *(s.alias(f"s_{n}") for n, s in scaled.items()))
    rows = []
    for s in scenarios:
        w = s["weights"]
        require(set(w) == set(criteria) and min(w.values()) >= 0 and sum(w.values()) > 0 and 0 <= s["threshold"] <= 1, "invalid weights or threshold")
        total = sum(w.values())
        score = sum((F.col(f"s_{n}") * (w[n] / total) for n in criteria), F.lit(0.0))
        rows.append(F.struct(F.lit(s["id"]).alias("scenario"), score.alias("score"), F.lit(float(s["threshold"])).alias("threshold")))
    long = base.select("id", "reasons", F.inline(F.array(*rows)))
    eligible = F.size("reasons") == 0
    # a rank is one more than the eligible with a higher score, counted over distinct scores
    counts = long.where(eligible).groupBy("scenario", (-F.col("score")).alias("_down")).agg(F.count("*").alias("n"))
    ranks = running_totals(counts, ["scenario"], ["_down"], "n", "above").select("scenario", "_down", (F.col("above") + 1).cast("int").alias("rank"))
    long = long.withColumn("_down", F.when(eligible, -F.col("score"))).join(ranks, ["scenario", "_down"], "left")
    low = F.when(eligible & (F.col("score") < F.col("threshold")), F.array(F.lit("below_threshold"))).otherwise(F.array().cast("array<string>"))
    return long.select(
        "id", "scenario", F.when(eligible, F.col("score")).alias("score"), "rank", eligible.alias("eligible"),
        (eligible & (F.col("score") >= F.col("threshold"))).alias("selected"), F.concat("reasons", low).alias("reasons"),
    )


def stability(scores: DataFrame) -> DataFrame:
    """id, selected_scenarios, stable_selected, never_selected, score_min, score_max, rank_min, rank_max."""
    return scores.groupBy("id").agg(
        F.count(F.when(F.col("selected"), 1)).alias("selected_scenarios"), F.bool_and("selected").alias("stable_selected"), (~F.bool_or("selected")).alias("never_selected"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"),
    )


def scenario_changes(scores: DataFrame, baseline: str) -> DataFrame:
    """scenario, id, change (newly_selected or lost_selected): the ids whose selection differs from the baseline's."""
    base = scores.where(F.col("scenario") == baseline).select("id", F.col("selected").alias("_b"))
    j = scores.where(F.col("scenario") != baseline).join(base, "id").where(F.col("selected") != F.col("_b"))
    return j.select("scenario", "id", F.when(F.col("selected"), "newly_selected").otherwise("lost_selected").alias("change"))


def dbscan(pts: Boxes, eps: float, min_samples: int) -> DataFrame:
    """id, cluster: "cluster:" and the least id (as text) of its core points, or noise.

    Cores have min_samples points, themselves included, in reach. A border point goes to the cluster whose least core
    id comes first, as a traversal in order of ids gives it.
    """
    ids = pts.df.select(F.col(pts.id).cast("string").alias("id"))
    found = written(near(pts, pts, eps).select(F.col("left_id").cast("string").alias("a"), F.col("right_id").cast("string").alias("b")), "dbscan-pairs")
    cores = found.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select(F.col("a").alias("core"))
    linked = found.join(cores, found["a"] == cores["core"]).select("a", "b")
    dense = linked.join(cores.withColumnRenamed("core", "b"), "b").select("a", "b")
    roots = connected_components(dense)
    owner = cores.join(roots, cores["core"] == roots["node"], "left").select("core", F.coalesce("root", "core").alias("cluster"))
    reach = linked.join(owner, linked["a"] == owner["core"]).groupBy(F.col("b").alias("id")).agg(F.min("cluster").alias("cluster"))
    own = owner.select(F.col("core").alias("id"), F.col("cluster").alias("own"))
    return ids.join(reach, "id", "left").join(own, "id", "left").select("id", F.coalesce(F.concat(F.lit("cluster:"), F.coalesce("own", "cluster")), F.lit("noise")).alias("cluster"))


def neighbour_sums(pts: Boxes, value: str, radius: float, include_self: bool = False) -> DataFrame:
    """id, z (deviation from the mean), k (neighbours), wz (their sum)."""
    mean = pts.df.agg(F.avg(F.col(value).cast("double"))).first()[0]
    z = pts.df.select(F.col(pts.id).alias("id"), (F.col(value).cast("double") - F.lit(mean)).alias("z"))
    found = near(pts, pts, radius)
    found = found if include_self else found.where("left_id != right_id")
    sums = found.join(z.select(F.col("id").alias("right_id"), F.col("z").alias("_z")), "right_id").groupBy("left_id").agg(F.count("*").alias("k"), F.sum("_z").alias("wz"))
    return z.join(sums, z["id"] == sums["left_id"], "left").select("id", "z", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("wz", F.lit(0.0)).alias("wz"))


def moran(pts: Boxes, value: str, radius: float) -> DataFrame:
    """n, weights, moran_i with binary weights of neighbours in reach."""
    s = neighbour_sums(pts, value, radius)
    return s.agg(F.count("*").alias("n"), F.sum("k").alias("weights"), (F.count("*") / F.sum("k") * F.sum(F.col("z") * F.col("wz")) / F.sum(F.col("z") * F.col("z"))).alias("moran_i"))


def local_moran(pts: Boxes, value: str, radius: float) -> DataFrame:
    """id, local_i with row-standardised weights; points without neighbours have 0."""
    s = written(neighbour_sums(pts, value, radius), "moran")
    zz = s.agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.count("*").alias("n"))
    return s.join(F.broadcast(zz), how="left").select("id", F.when(F.col("k") > 0, (F.col("n") - 1) * F.col("z") * F.col("wz") / F.col("k") / F.col("zz")).otherwise(0.0).alias("local_i"))


def getis_ord(pts: Boxes, value: str, radius: float) -> DataFrame:
    """id, gi_star: the standardised local sum, the point itself included."""
    s = written(neighbour_sums(pts, value, radius, include_self=True), "getis")
    whole = s.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("s"))
    spread = F.sqrt((F.col("n") * F.col("k") - F.col("k") * F.col("k")) / (F.col("n") - 1))
    return s.join(F.broadcast(whole), how="left").select("id", F.try_divide(F.col("wz"), F.col("s") * spread).alias("gi_star"))


def false_discovery(p_values: DataFrame, key: str, p: str, alpha: float = 0.05) -> DataFrame:
    """key, p, significant under Benjamini-Yekutieli."""
    n = p_values.count()
    harmonic = sum(1.0 / k for k in range(1, n + 1)) if n < 10_000_000 else math.log(n) + 0.5772156649015329
    counts = p_values.groupBy(p).agg(F.count("*").alias("c"))  # ranks by distinct value, summed over few rows
    ranks = running_totals(counts, [], [p], "c", "before").withColumn("rank", F.col("before") + F.col("c"))
    cut = ranks.where(F.col(p) <= F.col("rank") * alpha / (n * harmonic)).agg(F.max(p)).first()[0]
    return p_values.select(key, p, (F.col(p) <= F.lit(cut)).alias("significant") if cut is not None else F.lit(False).alias("significant"))


def permutation_p(pts: Boxes, value: str, radius: float, permutations: int, seed: int) -> DataFrame:
    """permutations, moran_i, p_value: values dealt anew over the places by a seeded hash order."""
    s = written(neighbour_sums(pts, value, radius).select("id", "z"), "permute")
    links = written(near(pts, pts, radius).where("left_id != right_id").select("left_id", "right_id"), "permute-links")
    n = s.count()
    require(n >= 4, "too few points")
    runs = s.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    place = F.row_number().over(Window.partitionBy("run").orderBy("id"))
    drawn = F.row_number().over(Window.partitionBy("run").orderBy(F.when(F.col("run") == 0, 0).otherwise(F.xxhash64("run", "id", F.lit(seed))), "id"))
    dealt = runs.select("run", "id", place.alias("k")).join(runs.select("run", "z", drawn.alias("k")), ["run", "k"])
    a, b = dealt.select("run", F.col("id").alias("left_id"), F.col("z").alias("za")), dealt.select("run", F.col("id").alias("right_id"), F.col("z").alias("zb"))
    sums = links.join(a, "left_id").join(b, ["run", "right_id"]).groupBy("run").agg(F.sum(F.col("za") * F.col("zb")).alias("q"), F.count("*").alias("w"))
    zz = s.agg(F.sum(F.col("z") * F.col("z"))).first()[0]
    stat = sums.select("run", (F.col("q") / F.col("w") * n / zz).alias("i"))
    observed = stat.where("run = 0").select(F.col("i").alias("moran_i"))
    hits = stat.where("run > 0").join(F.broadcast(observed), how="left").agg(F.count(F.when(F.col("i") >= F.col("moran_i"), 1)).alias("h"), F.first("moran_i").alias("moran_i"))
    return hits.select(F.lit(permutations).alias("permutations"), "moran_i", ((F.least("h", permutations - F.col("h")) + 1) / (permutations + 1)).alias("p_value"))


def kde(pts: Boxes, bandwidth: float, resolution: float, bounds: tuple[float, float, float, float], cut: float = 9.0) -> DataFrame:
    """row, col, density (per square kilometre) of Gaussian kernels at cell centres; rows go up from the lower edge.

    Each point adds to the cells within `cut` bandwidths of its row and column; at 9 what is left out of a cell is below
    3e-18 of a point's peak for each point, less than doubles hold.
    """
    x0, y0, x1, y1 = bounds
    cols, rows = round((x1 - x0) / resolution), round((y1 - y0) / resolution)
    require(rows * cols <= 1_000_000, "more than 1000000 cells")
    def span(c: str, lo: float, top: int) -> Column:
        first = F.greatest(F.lit(0), F.floor((F.col(c) - cut * bandwidth - lo) / resolution).cast("int"))
        last = F.least(F.lit(top - 1), F.floor((F.col(c) + cut * bandwidth - lo) / resolution).cast("int"))
        return F.when(first <= last, F.sequence(first, last))  # null: no cell in reach

    p = pts.df.select(F.col(pts.xmin).cast("double").alias("x"), F.col(pts.ymin).cast("double").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    hit = p.withColumn("row", F.explode(span("y", y0, rows))).withColumn("col", F.explode(span("x", x0, cols)))
    dx, dy = F.lit(x0) + (F.col("col") + 0.5) * resolution - F.col("x"), F.lit(y0) + (F.col("row") + 0.5) * resolution - F.col("y")
    return hit.groupBy("row", "col").agg((F.sum(F.col("n") * F.exp(-(dx * dx + dy * dy) / (2 * bandwidth**2))) / (2 * math.pi * bandwidth**2) * 1e6).alias("density"))


def greedy_colours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, colour: the least colour free among earlier neighbours, in order of degree (descending), then id.

    Every round colours all nodes whose earlier neighbours have colours; the result is that of the sequential walk.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    degree = nodes.select("node").join(both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("d")), "node", "left").select("node", F.coalesce("d", F.lit(0)).alias("d"))
    degree = written(degree, "degrees")
    before = F.struct(-F.col("db"), F.col("b")) < F.struct(-F.col("da"), F.col("a"))
    waits = both.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b").where(before).select("a", "b")
    waits = written(waits, "waits")
    done = written(degree.join(waits.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(0).alias("colour")), "colours")
    left = degree.select("node").join(done, "node", "left_anti")
    while not left.isEmpty():
        j = waits.join(left, waits["a"] == left["node"], "left_semi").join(done, waits["b"] == done["node"], "left")
        ready = j.groupBy("a").agg(F.count("*").alias("n"), F.collect_set("colour").alias("used"))
        counts = j.groupBy("a").agg(F.count(F.when(F.col("colour").isNull(), 1)).alias("open"))
        free = ready.join(counts.where("open = 0"), "a").select(F.col("a").alias("node"), F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used")).alias("colour"))
        done = written(done.unionByName(free), "colours")
        left = written(degree.select("node").join(done, "node", "left_anti"), "uncoloured")
    return done
