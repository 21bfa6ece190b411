"""Queries on edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, graph, spatial
from . import inputs as i

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


#: Cheapest arcs between the 25 nodes, and walks of up to 24 arcs, cut to the best cost so far by hop.
_ARC = "arc AS (SELECT u, v, min(cost) AS w FROM (SELECT u, v, cost FROM edge UNION ALL SELECT v, u, cost FROM edge) WHERE u <> v GROUP BY 1, 2)"
_HOPS = 12


def _reach(where: str = "true") -> str:
    steps = [f"h0 AS (SELECT n_nationkey AS o, n_nationkey AS n, 0.0::DOUBLE AS c FROM nation WHERE {where})"]
    for k in range(1, _HOPS + 1):
        steps.append(f"h{k} AS (SELECT o, n, min(c) AS c FROM (SELECT * FROM h{k - 1} UNION ALL SELECT o, v, c + w FROM h{k - 1} JOIN arc ON u = n) GROUP BY 1, 2)")
    return f"WITH {i.SQL['edge']}, {_ARC}, {', '.join(steps)}"


def _arcs(spark, sf):
    return graph.arcs(i.edges(spark, sf), "id", "u", "v", F.col("cost"))


#: Facilities: nations with a supplier of high balance.
_SITES = "SELECT DISTINCT s_nationkey AS f FROM supplier WHERE s_acctbal > 9000"


def _sites(spark, sf):
    return i.load(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("facility")).distinct()


def _nodes(spark, sf, name):
    return i.load(spark, sf, "nation").select(F.col("n_nationkey").alias(name))


@query("od_costs", f"{_reach()} SELECT a.n_nationkey AS origin, b.n_nationkey AS dest, c AS cost, CASE WHEN c IS NULL THEN 'unreachable' ELSE 'reachable' END AS status FROM nation a CROSS JOIN nation b LEFT JOIN h{_HOPS} ON o = a.n_nationkey AND n = b.n_nationkey")
def od_costs(spark, sf):
    return graph.od_matrix(_arcs(spark, sf), _nodes(spark, sf, "origin"), _nodes(spark, sf, "dest"))


@query("od_within_budget", f"{_reach()} SELECT o AS origin, n AS node, c AS cost FROM h{_HOPS} WHERE c <= 6")
def od_within_budget(spark, sf):
    return graph.od_costs(_arcs(spark, sf), _nodes(spark, sf, "origin"), budget=6.0)


@query("nearest_facility", f"{_reach()} SELECT o AS origin, arg_min(n, (c, n)) AS facility, min(c) AS cost FROM h{_HOPS} WHERE n IN (SELECT f FROM ({_SITES})) GROUP BY 1")
def nearest_facility(spark, sf):
    costs = graph.od_costs(_arcs(spark, sf), _nodes(spark, sf, "origin"))
    return graph.nearest_facility(costs, _sites(spark, sf))


@query("service_segments", f"{_reach()}, a2 AS (SELECT id || ':f' AS arc, u, v, cost FROM edge UNION ALL SELECT id || ':r', v, u, cost FROM edge) SELECT o AS origin, arc, round(max(least(1.0, (6 - c) / cost)), 6) AS fraction FROM h{_HOPS} JOIN a2 ON u = n WHERE c < 6 GROUP BY 1, 2")
def service_segments(spark, sf):
    arcs = _arcs(spark, sf)
    costs = graph.od_costs(arcs, _nodes(spark, sf, "origin"), budget=6.0)
    return graph.service_segments(arcs, costs, 6.0).withColumn("fraction", F.round("fraction", 6))


#: Arcs of customers in debt are of unknown state.
_OPEN = _ARC.replace("FROM edge", "FROM edge WHERE known")


@query("coverage_three_state", (lambda full, open_: f"WITH {full}, certain AS ({open_}) SELECT a.n_nationkey AS origin, CASE WHEN x.o IS NOT NULL THEN 'covered' WHEN y.o IS NOT NULL THEN 'unknown' ELSE 'uncovered' END AS status FROM nation a LEFT JOIN (SELECT DISTINCT o FROM certain) x ON x.o = n_nationkey LEFT JOIN (SELECT DISTINCT o FROM h{_HOPS} WHERE n IN (SELECT f FROM ({_SITES})) AND c <= 3) y ON y.o = n_nationkey")(
    _reach().removeprefix("WITH "), f"{_reach().replace(_ARC, _OPEN)} SELECT o FROM h{_HOPS} WHERE n IN (SELECT f FROM ({_SITES})) AND c <= 3"))
def coverage_three_state(spark, sf):
    e = i.edges(spark, sf)
    origins = _nodes(spark, sf, "origin")
    known = graph.od_costs(graph.arcs(e.where("known"), "id", "u", "v", F.col("cost")), origins, budget=3.0)
    possible = graph.od_costs(graph.arcs(e, "id", "u", "v", F.col("cost")), origins, budget=3.0)
    return graph.coverage(known, possible, origins, _sites(spark, sf), 3.0)


@query("components", "WITH RECURSIVE e AS (SELECT o_custkey AS u, 100000000 + o_orderkey AS v FROM orders UNION SELECT 100000000 + o_orderkey, o_custkey FROM orders), r(n, root) AS (SELECT u, u FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.n) SELECT n AS node, min(root) AS root FROM r WHERE EXISTS (SELECT 1 FROM e WHERE e.u = n AND e.v <> n) GROUP BY 1")
def components(spark, sf):
    return graph.connected_components(i.load(spark, sf, "orders").select(F.col("o_custkey").alias("u"), (F.col("o_orderkey") + 100_000_000).alias("v")), "u", "v")


@query("snap_nodes", f"WITH {i.SQL['cust']}, {i.SQL['supp']}, d AS (SELECT c_custkey AS id, s_suppkey AS node, CAST((cust.x - supp.x) * (cust.x - supp.x) + (cust.y - supp.y) * (cust.y - supp.y) AS BIGINT) AS d2 FROM cust JOIN supp ON (cust.x - supp.x) * (cust.x - supp.x) + (cust.y - supp.y) * (cust.y - supp.y) <= 625) SELECT c_custkey AS id, arg_min(node, (d2, node)) AS node, min(d2) AS dist2 FROM cust LEFT JOIN d ON id = c_custkey GROUP BY 1")
def snap_nodes(spark, sf):
    pts = i.customers(spark, sf).select(F.col("c_custkey").alias("id"), "x", "y")
    nodes = i.suppliers(spark, sf).select(F.col("s_suppkey").alias("node"), "x", "y")
    return graph.snap(pts, nodes, 25.0).withColumn("dist2", F.col("dist2").cast("bigint"))


@query("spanning_forest")
def spanning_forest(spark, sf):
    return graph.spanning_forest(i.edges(spark, sf).select("id", F.col("u").alias("a"), F.col("v").alias("b"), F.col("cost").alias("weight")))


@query("greedy_colouring")
def greedy_colouring(spark, sf):
    return analysis.greedy_colours(spatial.adjacency(i.zone_boxes(spark, sf)).select("a", "b"), _nodes(spark, sf, "node"))
