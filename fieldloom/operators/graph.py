"""Graphs as edge tables: components, costs, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import require
from ..sources.scratch import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component) for every node of the undirected edges.

    Nodes point to their least neighbour and that one's; edges between distinct targets go on to the next round. The
    least node of a component never points away, so that it ends as the root.
    """
    live = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct(), "edges")
    roots = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        to = written(to, "points")
        to = written(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("next")), "to").select("node", F.col("next").alias("to")), "hops")
        roots = to.withColumnRenamed("to", "root") if roots is None else roots.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        moved = live.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        live = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a != b").distinct(), "edges")
    return roots if roots is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))


def arcs(edges: DataFrame, edge_id: str, source: str, target: str, cost: Column, direction: str | None = None) -> DataFrame:
    """arc, u, v, cost: edges open both ways, forward or in reverse as arcs; negative costs are refused."""
    base = edges.select(F.col(edge_id).cast("string").alias("edge"), F.col(source).alias("u"), F.col(target).alias("v"), cost.cast("double").alias("cost"), (F.col(direction) if direction else F.lit("both")).alias("d"))
    require(base.where("cost < 0 or cost is null").isEmpty(), "costs must not be negative or missing")
    forward = base.where("d in ('both', 'forward')").select(F.concat("edge", F.lit(":f")).alias("arc"), "u", "v", "cost")
    reverse = base.where("d in ('both', 'reverse')").select(F.concat("edge", F.lit(":r")).alias("arc"), F.col("v").alias("u"), F.col("u").alias("v"), "cost")
    return forward.unionByName(reverse)


def od_costs(arc: DataFrame, origins: DataFrame, origin: str = "origin", budget: float | None = None) -> DataFrame:
    """origin, node, cost of the cheapest way to every node in reach.

    Label correcting on all origins at once: each round only relaxes the arcs that leave labels improved in the round
    before; parallel arcs are reduced to the cheapest first.
    """
    cheapest = written(arc.groupBy("u", "v").agg(F.min("cost").alias("w")), "arcs")
    labels = written(origins.select(F.col(origin).alias("origin"), F.col(origin).alias("node"), F.lit(0.0).alias("cost")).distinct(), "labels")
    front = labels
    while not front.isEmpty():
        step = front.join(cheapest, front["node"] == cheapest["u"]).select("origin", F.col("v").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        if budget is not None:
            step = step.where(F.col("cost") <= budget)
        step = step.groupBy("origin", "node").agg(F.min("cost").alias("new"))
        merged = written(labels.join(step, ["origin", "node"], "full_outer").select("origin", "node", F.least("cost", "new").alias("cost"), (F.col("cost").isNull() | (F.col("new") < F.col("cost"))).alias("better")), "labels")
        labels, front = merged.select("origin", "node", "cost"), merged.where("better").select("origin", "node", "cost")
    return labels


def od_matrix(arc: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """origin, dest, cost, status for all pairs asked for: reachable or unreachable. The pairs are the result itself."""
    costs = od_costs(arc, origins)
    asked = origins.select("origin").distinct().join(destinations.select("dest").distinct(), how="cross")
    found = costs.select("origin", F.col("node").alias("dest"), "cost")
    return asked.join(found, ["origin", "dest"], "left").select("origin", "dest", "cost", F.when(F.col("cost").isNull(), "unreachable").otherwise("reachable").alias("status"))


def nearest_facility(costs: DataFrame, facilities: DataFrame) -> DataFrame:
    """origin, facility, cost of the cheapest facility, ties to the least id."""
    at = costs.join(facilities.select(F.col("facility").alias("node")).distinct(), "node")
    return at.groupBy("origin").agg(F.min(F.struct("cost", "node")).alias("m")).select("origin", F.col("m.node").alias("facility"), F.col("m.cost").alias("cost"))


def service_segments(arc: DataFrame, costs: DataFrame, budget: float) -> DataFrame:
    """origin, arc, fraction: how far each arc is covered within the budget."""
    at = costs.where(F.col("cost") < budget)
    j = at.join(arc.withColumnRenamed("cost", "w"), at["node"] == arc["u"])
    share = F.when(F.col("w") > 0, F.least(F.lit(1.0), (budget - F.col("cost")) / F.col("w"))).otherwise(1.0)
    return j.groupBy("origin", "arc").agg(F.max(share).alias("fraction"))


def coverage(confirmed: DataFrame, possible: DataFrame, demand: DataFrame, facilities: DataFrame, budget: float) -> DataFrame:
    """origin, status by demand: covered if a facility is in reach over arcs known to be open, unknown if only over
    arcs whose state isn't known, else uncovered. Without facilities all are uncovered."""
    def reach(costs: DataFrame) -> DataFrame:
        return costs.where(F.col("cost") <= budget).join(facilities.select(F.col("facility").alias("node")).distinct(), "node").select("origin").distinct()

    return (
        demand.select("origin").distinct().join(reach(confirmed).withColumn("c", F.lit(True)), "origin", "left").join(reach(possible).withColumn("p", F.lit(True)), "origin", "left")
        .select("origin", F.when(F.col("c"), "covered").when(F.col("p"), "unknown").otherwise("uncovered").alias("status"))
    )


def coverage_summary(status: DataFrame, demand: DataFrame, weight: str) -> DataFrame:
    """covered, uncovered and unknown weights, coverage_rate and possible_coverage_rate."""
    j = demand.join(status, "origin")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col(weight))), F.lit(0.0))
    total = F.sum(weight)
    return j.agg(part("covered").alias("covered"), part("uncovered").alias("uncovered"), part("unknown").alias("unknown"), (part("covered") / total).alias("coverage_rate"), ((part("covered") + part("unknown")) / total).alias("possible_coverage_rate"))


def snap(points: DataFrame, nodes: DataFrame, limit: float) -> DataFrame:
    """id, node, dist2 of the nearest node within the limit (ties to the least node), null node otherwise."""
    from .spatial import near
    from .spatial import points as boxes

    found = near(boxes(points, "id"), boxes(nodes, "node"), limit)
    best = found.groupBy(F.col("left_id").alias("id")).agg(F.min(F.struct("dist2", F.col("right_id").alias("node"))).alias("m"))
    return points.select("id").join(best, "id", "left").select("id", F.col("m.node").alias("node"), F.col("m.dist2").alias("dist2"))


def spanning_forest(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """The edges (id, a, b, weight) of a maximum spanning forest: each round every component takes its heaviest way out, ties to the least id."""
    e = written(edges.select("id", "a", "b", F.col(weight).alias("w")).where("a != b"), "forest-edges")
    live, taken = e.withColumns({"ca": F.col("a"), "cb": F.col("b")}), None
    while not live.isEmpty():
        ends = live.select(F.col("ca").alias("c"), "id", "w", "ca", "cb").unionByName(live.select(F.col("cb").alias("c"), "id", "w", "ca", "cb"))
        pick = written(ends.groupBy("c").agg(F.min(F.struct(-F.col("w"), F.col("id"), F.col("ca"), F.col("cb"))).alias("m")).select("m.id", "m.ca", "m.cb").distinct(), "forest-picks")
        taken = pick.select("id") if taken is None else taken.unionByName(pick.select("id"))
        roots = written(connected_components(pick, "ca", "cb"), "forest-roots")
        side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        live = live.join(side("ca"), "ca", "left").join(side("cb"), "cb", "left").select("id", "a", "b", "w", F.coalesce("rca", "ca").alias("ca"), F.coalesce("rcb", "cb").alias("cb")).where("ca != cb")
        live = written(live, "forest-live")
    return e.join(taken.distinct(), "id", "left_semi").withColumnRenamed("w", weight) if taken is not None else e.withColumnRenamed("w", weight)


def running_order(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each row with the one after it in its group."""
    return df.withColumn("next", F.lead(order).over(Window.partitionBy(group).orderBy(order)))
