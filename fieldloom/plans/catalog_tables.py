"""Queries on attribute tables, keyed versions, rules, filters and SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import filters, text
from ..operators import aggregates, analysis, conflation, joins, rules, table, versions
from ..streaming import events as streams
from . import inputs as i
from .inputs import load
from .sql import run_select

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("frequency_pct", "SELECT o_orderpriority AS value, count(*) AS count, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
def frequency_pct(spark, sf):
    return aggregates.frequency(load(spark, sf, "orders"), "o_orderpriority")


@query("value_counts_null", "SELECT nullif(c_mktsegment, 'BUILDING') AS value, count(*) AS count FROM customer GROUP BY 1")
def value_counts_null(spark, sf):
    c = load(spark, sf, "customer").withColumn("s", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    return aggregates.values(c, "s")


@query("value_counts_top", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def value_counts_top(spark, sf):
    return aggregates.values(load(spark, sf, "part"), "p_size", 7)


def _describe(c: str) -> str:
    return f"SELECT '{c}' AS field, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c})::DOUBLE AS max FROM part"


@query("describe_numeric", " UNION ALL ".join(map(_describe, ("p_size", "p_retailprice"))))
def describe_numeric(spark, sf):
    out = aggregates.describe(load(spark, sf, "part"), ["p_size", "p_retailprice"])
    return out.select("field", "count", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "min", *(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "max")


@query("distribution_pop", "SELECT count(v) AS count, count(*) - count(v) AS missing, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75, max(v) AS max FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS v FROM lineitem)")
def distribution_pop(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("v", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
    return aggregates.distribution(li, "v").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _profile(c: str) -> str:
    return f"SELECT '{c}' AS field, CAST(sum(CASE WHEN v IS NULL THEN n ELSE 0 END) AS BIGINT) AS missing, count(v) AS \"unique\", CAST(coalesce(sum(CASE WHEN v IS NOT NULL AND n > 1 THEN n END), 0) AS BIGINT) AS duplicate_nonnull_rows FROM (SELECT {c} AS v, count(*) AS n FROM customer GROUP BY 1)"


@query("profile_columns", " UNION ALL ".join(map(_profile, ("c_custkey", "c_nationkey", "c_mktsegment"))))
def profile_columns(spark, sf):
    return aggregates.profile(load(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"])


@query("summarize_total", "SELECT l_returnflag, count(*) AS count, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def summarize_total(spark, sf):
    return aggregates.summarize(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("weighted_ratio", "SELECT l_shipdate::DATE - DATE '1990-01-01' AS day, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY 1")
def weighted_ratio(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("day", F.datediff("l_shipdate", F.lit("1990-01-01")).cast("bigint"))
    return aggregates.weighted_ratio(li, "day", "l_discount", "l_quantity").select("day", F.round("ratio", 6).alias("ratio"))


@query("weighted_category", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS weight_sum, count(*) AS count, round(sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_returnflag), 6) AS fraction FROM lineitem GROUP BY 1, 2")
def weighted_category(spark, sf):
    out = aggregates.weighted_category(load(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")
    return out.withColumn("fraction", F.round("fraction", 6))


@query("dissolve_first_sum", "SELECT l_suppkey, arg_min(l_shipdate::VARCHAR, (l_orderkey, l_linenumber)) AS first_s, sum(l_quantity) AS sum_l_quantity, count(*) AS n FROM lineitem GROUP BY 1")
def dissolve_first_sum(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("s", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return aggregates.dissolve(li, ["l_suppkey"], ["l_orderkey", "l_linenumber"], ["s"], ["l_quantity"])


@query("dissolve_blocks", "SELECT l_returnflag, l_orderkey // 1000 AS block, sum(l_quantity) AS sum_l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")
def dissolve_blocks(spark, sf):
    return aggregates.dissolve(load(spark, sf, "lineitem"), ["l_returnflag"], ["l_orderkey"], [], ["l_quantity"], F.floor(F.col("l_orderkey") / 1000))


@query("scheme_quantile", """WITH b AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM part), e AS (SELECT CAST(k AS INTEGER) AS class_id, CASE WHEN k > 0 THEN q[k] END AS lo, CASE WHEN k < 4 THEN q[k + 1] END AS hi FROM b, range(5) t(k))
    SELECT class_id, round(lo, 6) AS lo, round(hi, 6) AS hi, count(p_partkey) AS cnt FROM e LEFT JOIN part ON p_retailprice >= coalesce(lo, -1e9) AND p_retailprice < coalesce(hi, 1e9) GROUP BY 1, 2, 3""")
def scheme_quantile(spark, sf):
    p = load(spark, sf, "part")
    out = aggregates.scheme_counts(p, "p_retailprice", aggregates.breaks(p, "p_retailprice", "quantile", 5))
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("scheme_equal", """WITH b AS (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS z FROM part), e AS (SELECT CAST(k AS INTEGER) AS class_id, CASE WHEN k > 0 THEN a + (z - a) * k / 6 END AS lo, CASE WHEN k < 5 THEN a + (z - a) * (k + 1) / 6 END AS hi FROM b, range(6) t(k))
    SELECT class_id, round(lo, 6) AS lo, round(hi, 6) AS hi, count(p_partkey) AS cnt FROM e LEFT JOIN part ON p_size >= coalesce(lo, -1e9) AND p_size < coalesce(hi, 1e9) GROUP BY 1, 2, 3""")
def scheme_equal(spark, sf):
    p = load(spark, sf, "part")
    out = aggregates.scheme_counts(p, "p_size", aggregates.breaks(p, "p_size", "equal_interval", 6))
    return out.withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


@query("scheme_categories", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS class_id, p_brand AS code, count(*) AS cnt FROM part GROUP BY 2")
def scheme_categories(spark, sf):
    return aggregates.category_counts(load(spark, sf, "part"), "p_brand")


@query("layer_summary", i.sql("SELECT count(*) AS features, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM cust", "cust"))
def layer_summary(spark, sf):
    return aggregates.layer_summary(i.customers(spark, sf), "x", "y")


@query("chart_top_other", "WITH s AS (SELECT p_brand, sum(p_retailprice) AS t, row_number() OVER (ORDER BY sum(p_retailprice) DESC, p_brand) AS r FROM part GROUP BY 1) SELECT CASE WHEN r <= 5 THEN p_brand ELSE 'other' END AS category, round(sum(t), 4) AS total FROM s GROUP BY 1")
def chart_top_other(spark, sf):
    return aggregates.top_categories(load(spark, sf, "part"), "p_brand", "p_retailprice", 5).withColumn("total", F.round("total", 4))


@query("chart_histogram", "SELECT CAST(least(9, floor((p_size - a) / ((z - a) / 10))) AS INTEGER) AS bin, count(*) AS cnt FROM part, (SELECT min(p_size)::DOUBLE AS a, max(p_size)::DOUBLE AS z FROM part) GROUP BY 1")
def chart_histogram(spark, sf):
    return aggregates.equal_bins(load(spark, sf, "part"), "p_size", 10)


# --- rows and columns ------------------------------------------------------------------------------------------------


@query("head_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def head_rows(spark, sf):
    return table.head(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 25, ["o_orderkey"])


@query("field_list", "SELECT column_name AS field, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS dtype, false AS has_null FROM (DESCRIBE supplier)")
def field_list(spark, sf):
    return table.field_list(load(spark, sf, "supplier")).select("field", "dtype", "has_null")


_EV = "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' WHEN event_id % 13 = 0 THEN '1.5' ELSE CAST(event_id % 7 AS VARCHAR) END AS raw, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN '2023-02-29' ELSE '2024-02-' || lpad(CAST(1 + event_id % 29 AS VARCHAR), 2, '0') END AS d, CAST(event_id % 4000 AS VARCHAR) AS k, event_type FROM events"


def _event_texts(spark, sf):
    e = load(spark, sf, "events")
    k = F.col("event_id")
    raw = F.when(k % 11 == 0, "bad").when(k % 13 == 0, "1.5").otherwise((k % 7).cast("string"))
    d = F.when(k % 17 == 0, None).when(k % 19 == 0, "2023-02-29").otherwise(F.concat(F.lit("2024-02-"), F.lpad((k % 29 + 1).cast("string"), 2, "0")))
    out = e.select("event_id", raw.alias("raw"), d.alias("d"), (k % 4000).cast("string").alias("k"), "event_type")
    return table.normalize(out, "k", {"n": {"source": "raw", "type": "int"}, "day": {"source": "d", "type": "date", "format": "yyyy-MM-dd"}})


_CLEAN = f"(SELECT *, (raw <> 'bad' AND raw <> '1.5') AND (d IS NULL OR d <> '2023-02-29') AS ok FROM ({_EV}))"


@query("normalize_ok", f"SELECT event_id, CAST(raw AS BIGINT) AS n, d AS day FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM {_CLEAN} WHERE ok) WHERE c = 1")
def normalize_ok(spark, sf):
    return _event_texts(spark, sf).accepted.select("event_id", "n", "day")


@query("normalize_failures", f"SELECT field, reason, count(*) AS cnt FROM (SELECT 'raw' AS field, 'not a int' AS reason FROM {_CLEAN} WHERE raw IN ('bad', '1.5') UNION ALL SELECT 'd', 'not a date' FROM {_CLEAN} WHERE d = '2023-02-29' UNION ALL SELECT 'k', 'missing or duplicate key' FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM {_CLEAN} WHERE ok) WHERE c > 1) GROUP BY 1, 2")
def normalize_failures(spark, sf):
    return _event_texts(spark, sf).failures.groupBy("field", "reason").agg(F.count("*").alias("cnt"))


@query("cast_bool", "SELECT doc_id, toxic = 1 AS b FROM labels")
def cast_bool(spark, sf):
    words = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "Yes").otherwise(" T ")).otherwise(F.when(F.col("doc_id") % 3 == 0, "no").otherwise("0"))
    return table.cast(load(spark, sf, "labels").select("doc_id", words.alias("b")), "b", "bool")


@query("cast_int_text", "SELECT p_partkey, p_size::BIGINT AS v FROM part")
def cast_int_text(spark, sf):
    return table.cast(load(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("v")), "v", "int")


@query("dedupe_attributes", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_attributes(spark, sf):
    return table.dedupe(load(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query("merge_union", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment, 'customer' AS source_file FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier")
def merge_union(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return table.merge([("customer", c), ("supplier", s)])


@query("merge_intersection", "SELECT c_custkey::BIGINT AS id, c_acctbal AS v, 'customer' AS source_file FROM customer UNION ALL SELECT p_partkey, p_size::DOUBLE, 'part' FROM part")
def merge_intersection(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit("x").alias("only"))
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    return table.merge([("customer", c), ("part", p)], "intersection")


@query("split_counts", "SELECT coalesce(regexp_replace(o_orderpriority, '[^\\w\\-]', '_', 'g'), '_NULL') AS name, count(*) AS cnt FROM orders GROUP BY 1")
def split_counts(spark, sf):
    return load(spark, sf, "orders").groupBy(F.coalesce(text.sanitize(F.col("o_orderpriority")), F.lit("_NULL")).alias("name")).agg(F.count("*").alias("cnt"))


_LIFE = "SELECT o_orderkey, o_orderdate AS s, CASE WHEN o_orderkey % 10 <> 0 THEN max(l_shipdate) + INTERVAL 1 DAY END AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate"


def _life(spark, sf):
    last = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    j = load(spark, sf, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey")).where("last >= o_orderdate")
    return j.select("o_orderkey", F.col("o_orderdate").alias("s"), F.when(F.col("o_orderkey") % 10 != 0, F.col("last") + F.expr("interval 1 day")).alias("e"))


for _unknown, _test in {"hold": "s <= TIMESTAMP '1995-06-15' AND e > TIMESTAMP '1995-06-15'", "open": "s <= TIMESTAMP '1995-06-15' AND (e IS NULL OR e > TIMESTAMP '1995-06-15')"}.items():
    def _run(spark, sf, unknown=_unknown):
        return table.time_slice(_life(spark, sf), "s", "e", "1995-06-15", unknown).select("o_orderkey")

    query(f"time_slice_{_unknown}", f"SELECT o_orderkey FROM ({_LIFE}) WHERE {_test}")(_run)


@query("core_outliers", i.sql("SELECT c_custkey, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) <= 1.5 * (SELECT quantile_cont(sqrt((x - mx) * (x - mx) + (y - my) * (y - my)), 0.5) FROM cust, m) AS is_core FROM cust, m", "cust").replace(" SELECT c_custkey, sqrt", ", m AS (SELECT quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM cust) SELECT c_custkey, sqrt", 1))
def core_outliers(spark, sf):
    return table.core_outlier(i.customers(spark, sf), "x", "y", 1.5).select("c_custkey", "is_core")


@query("haversine", i.sql("SELECT c_custkey, round(2 * 6371.0088 * asin(least(1, sqrt(power(sin(radians(y / 12 - 40) / 2), 2) + cos(radians(40)) * cos(radians(y / 12)) * power(sin(radians(x / 6 - 80) / 2), 2)))), 6) AS km FROM cust", "cust"))
def haversine(spark, sf):
    km = text.haversine_km(F.lit(80.0), F.lit(40.0), F.col("x") / 6, F.col("y") / 12)
    return i.customers(spark, sf).select("c_custkey", F.round(km, 6).alias("km"))


@query("mercator_tiles", i.sql("SELECT c_custkey, CAST(floor((x / 6 + 180) / 360 * 1024) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(y / 12)) + 1 / cos(radians(y / 12))) / pi()) / 2 * 1024) AS BIGINT) AS ty FROM cust", "cust"))
def mercator_tiles(spark, sf):
    tx, ty = text.mercator_tile(F.col("x") / 6, F.col("y") / 12, 10)
    return i.customers(spark, sf).select("c_custkey", tx.alias("tx"), ty.alias("ty"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("filter_null_semantics", "SELECT p_partkey FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 7 <> 0 THEN p_brand END AS b FROM part) WHERE (b IS NULL OR b <> 'Brand#12') AND NOT coalesce(b IN ('Brand#13', 'Brand#23'), false) AND NOT coalesce(p_size > 40, false) AND (b IS NOT NULL OR p_size >= 14)")
def filter_null_semantics(spark, sf):
    p = load(spark, sf, "part").withColumn("b", F.when(F.col("p_size") % 7 != 0, F.col("p_brand")))
    tree = {"all": [{"field": "b", "op": "!=", "value": "Brand#12"}, {"field": "b", "op": "notIn", "value": ["Brand#13", "Brand#23"]}, {"not": {"field": "p_size", "op": ">", "value": 40}}, {"any": [{"field": "b", "op": "notNull"}, {"field": "p_size", "op": ">=", "value": 14}]}]}
    return p.where(filters.compile_filter(tree, p.columns)).select("p_partkey")


@query("style_rules_case", "SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN 'small' WHEN p_size >= 10 AND p_size < 30 THEN 'medium' WHEN p_size >= 30 AND p_size <= 45 THEN 'large' ELSE 'other' END AS label FROM part")
def style_rules_case(spark, sf):
    styles = filters.class_rules("p_size", [(1, 10, "small"), (10, 30, "medium"), (30, 45, "large")])
    return load(spark, sf, "part").select("p_partkey", filters.first_match(styles, "other").alias("label"))


@query("where_expression", "SELECT p_partkey FROM part WHERE p_size > 10 AND (p_brand = 'Brand#11' OR p_retailprice >= 1500) AND NOT (p_size IN (20, 30))")
def where_expression(spark, sf):
    return load(spark, sf, "part").where(filters.where("p_size > 10 and (p_brand == 'Brand#11' or p_retailprice >= 1500) and not (p_size in [20, 30])")).select("p_partkey")


# --- keys ------------------------------------------------------------------------------------------------------------


def _key_sides(spark, sf):
    k = F.col("c_custkey")
    left = load(spark, sf, "customer").select("c_custkey", F.concat(F.lpad((k % 50).cast("string"), 3, "0"), F.lit("-"), F.lpad((k % 30).cast("string"), 2, "0")).alias("lk"))
    s = F.col("s_suppkey")
    right = load(spark, sf, "supplier").select("s_suppkey", F.when(s % 9 == 0, None).otherwise(F.concat((s % 60).cast("string"), F.lit(" — "), F.lpad((s % 40).cast("string"), 4, "0"))).alias("rk"))
    return left, right


_LK = "SELECT c_custkey, lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0') AS lk, CAST(c_custkey % 50 AS VARCHAR) || '-' || CAST(c_custkey % 30 AS VARCHAR) AS k FROM customer"
_RK = "SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 60 AS VARCHAR) || ' — ' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 4, '0') END AS rk, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 60 AS VARCHAR) || '-' || CAST(s_suppkey % 40 AS VARCHAR) END AS k FROM supplier"


@query("attr_join_norm", f"SELECT c_custkey, s_suppkey FROM ({_LK}) l LEFT JOIN ({_RK}) r ON l.k = r.k")
def attr_join_norm(spark, sf):
    left, right = _key_sides(spark, sf)
    return joins.keyed_join(left, right, "lk", "rk", "id").select("c_custkey", "s_suppkey")


@query("attr_join_unmatched", f"SELECT DISTINCT 'left' AS side, lk AS written FROM ({_LK}) l WHERE NOT EXISTS (SELECT 1 FROM ({_RK}) r WHERE r.k = l.k) UNION ALL SELECT DISTINCT 'right', rk FROM ({_RK}) r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({_LK}) l WHERE r.k = l.k)")
def attr_join_unmatched(spark, sf):
    return joins.key_report(*_key_sides(spark, sf), "lk", "rk", "id").unmatched


@query("attr_join_duplicates", f"SELECT 'left' AS side, k AS key, count(*) AS rows FROM ({_LK}) GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'right', k, count(*) FROM ({_RK}) WHERE k IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def attr_join_duplicates(spark, sf):
    return joins.key_report(*_key_sides(spark, sf), "lk", "rk", "id").duplicates


@query("attr_join_collisions", "SELECT 'left' AS side, CAST(p_size AS VARCHAR) AS key, count(DISTINCT w) AS n FROM (SELECT p_size, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN lpad(CAST(p_size AS VARCHAR), 4, '0') ELSE ' ' || CAST(p_size AS VARCHAR) END AS w FROM part) GROUP BY 2 HAVING count(DISTINCT w) > 1")
def attr_join_collisions(spark, sf):
    p = load(spark, sf, "part")
    s = F.col("p_size").cast("string")
    p = p.withColumn("w", F.when(F.col("p_partkey") % 3 == 0, s).when(F.col("p_partkey") % 3 == 1, F.lpad(s, 4, "0")).otherwise(F.concat(F.lit(" "), s)))
    out = joins.key_report(p, p.select("w").limit(0), "w", "w", "id").collisions
    return out.select("side", "key", F.size("written").cast("bigint").alias("n"))


@query("strict_join", "SELECT c_custkey, n_name AS joined_n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def strict_join(spark, sf):
    out = joins.attribute_join(load(spark, sf, "customer"), load(spark, sf, "nation"), "c_nationkey", "n_nationkey", ["n_name"])
    return out.select("c_custkey", "joined_n_name")


@query("foreign_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def foreign_anti(spark, sf):
    return joins.unmatched(load(spark, sf, "orders"), load(spark, sf, "customer").where("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey")


# --- versions --------------------------------------------------------------------------------------------------------


def _versions(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    left = c
    right = c.withColumn("c_custkey", F.col("c_custkey") + 100).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 0, "CHANGED").when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_mktsegment")))
    return left, right


_L = "l AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer)"
#: The later version: ids moved by 100, so that rows come and go.
_R = "r AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN 'CHANGED' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM (SELECT * REPLACE (c_custkey + 100 AS c_custkey) FROM customer))"


@query("upsert", f"WITH {_L}, {_R} SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, l.c_name, CASE WHEN r.c_custkey IS NOT NULL THEN r.c_mktsegment ELSE l.c_mktsegment END AS c_mktsegment, l.c_acctbal FROM l FULL JOIN r ON l.c_custkey = r.c_custkey")
def upsert(spark, sf):
    return versions.update(*_versions(spark, sf), "c_custkey", ["c_mktsegment"], append=True).table


@query("upsert_changelog", f"WITH {_L}, {_R} SELECT CAST(r.c_custkey AS VARCHAR) AS id, CASE WHEN l.c_custkey IS NOT NULL THEN 'c_mktsegment' END AS field, l.c_mktsegment AS before, CASE WHEN l.c_custkey IS NOT NULL THEN r.c_mktsegment END AS after, l.c_custkey IS NOT NULL AS adopted FROM r LEFT JOIN l ON l.c_custkey = r.c_custkey WHERE l.c_custkey IS NULL OR l.c_mktsegment IS DISTINCT FROM r.c_mktsegment")
def upsert_changelog(spark, sf):
    return versions.update(*_versions(spark, sf), "c_custkey", ["c_mktsegment"]).changes


@query("version_diff", f"WITH {_L}, {_R} SELECT CAST(coalesce(l.c_custkey, r.c_custkey) AS VARCHAR) AS id, CASE WHEN l.c_custkey IS NULL THEN 'added' WHEN r.c_custkey IS NULL THEN 'removed' WHEN l.c_mktsegment IS DISTINCT FROM r.c_mktsegment OR l.c_acctbal IS DISTINCT FROM r.c_acctbal THEN 'modified' ELSE 'unchanged' END AS change FROM l FULL JOIN r ON l.c_custkey = r.c_custkey")
def version_diff(spark, sf):
    return versions.compare(*_versions(spark, sf), "c_custkey", ["c_mktsegment", "c_acctbal"]).select("id", "change")


@query("category_transitions", f"WITH {_L}, {_R} SELECT l.c_mktsegment AS before, r.c_mktsegment AS after, count(*) AS cnt FROM l JOIN r ON l.c_custkey = r.c_custkey GROUP BY 1, 2")
def category_transitions(spark, sf):
    return versions.transitions(*_versions(spark, sf), "c_custkey", "c_mktsegment")


@query("split_merge_proposals", f"WITH {i.SQL['zone']}, o AS (SELECT a.n_nationkey AS before_id, q AS after_id FROM zone a JOIN (SELECT q, 250.0 * (q % 4) AS x, 250.0 * (q // 4) AS y FROM range(16) t(q)) ON least(xmax, x + 250) > greatest(xmin, x) AND least(ymax, y + 250) > greatest(ymin, y)) SELECT before_id, after_id, CASE WHEN na = 1 AND nb = 1 THEN 'match' WHEN nb = 1 THEN 'split' WHEN na = 1 THEN 'merge' ELSE 'complex' END AS kind FROM (SELECT *, count(*) OVER (PARTITION BY before_id) AS na, count(*) OVER (PARTITION BY after_id) AS nb FROM o)")
def split_merge_proposals(spark, sf):
    from ..operators.spatial import overlay
    from .catalog_spatial import _quads

    found = overlay(i.zone_boxes(spark, sf), _quads(spark)).select(F.col("left_id").alias("before_id"), F.col("right_id").cast("bigint").alias("after_id"))
    return versions.proposals(found)


@query("semantic_preserved", "SELECT CAST(event_id AS VARCHAR) AS id, 'event_type' AS field, CASE WHEN value > 95 THEN 'missing_downstream' ELSE 'changed' END AS issue FROM events WHERE value > 95 OR event_id % 40 = 1")
def semantic_preserved(spark, sf):
    e = load(spark, sf, "events").select("event_id", "event_type", "value")
    after = e.where("value <= 95").withColumn("event_type", F.when(F.col("event_id") % 40 == 1, F.concat("event_type", F.lit("x"))).when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_type"))).otherwise(F.col("event_type")))
    return joins.semantic_check(e, after, "event_id", ["event_type"])


_RULES = [
    {"id": "u", "kind": "unique", "field": "o_custkey"}, {"id": "r", "kind": "required", "field": "c"}, {"id": "e", "kind": "enum", "field": "o_orderstatus", "values": ["O", "F"]},
    {"id": "c", "kind": "compare", "field": "o_totalprice", "op": "le", "value": 300000.0, "severity": "warning"}, {"id": "f", "kind": "foreign_key", "field": "o_custkey", "right_field": "c_custkey"},
]


@query("rules_violations", """WITH o AS (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS c FROM orders) SELECT 'u' AS rule_id, CAST(o_orderkey AS VARCHAR) AS source_id, 'error' AS severity, 'unreviewed' AS review FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o) WHERE n > 1
    UNION ALL SELECT 'r', CAST(o_orderkey AS VARCHAR), 'error', 'unreviewed' FROM o WHERE c = '' UNION ALL SELECT 'e', CAST(o_orderkey AS VARCHAR), 'error', 'unreviewed' FROM o WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT 'c', CAST(o_orderkey AS VARCHAR), 'warning', 'unreviewed' FROM o WHERE NOT o_totalprice <= 300000 UNION ALL SELECT 'f', CAST(o_orderkey AS VARCHAR), 'error', 'unreviewed' FROM o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def rules_violations(spark, sf):
    o = load(spark, sf, "orders").withColumn("c", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority")))
    return rules.violations(o, "o_orderkey", _RULES, load(spark, sf, "customer").where("c_acctbal > 0"))


# --- scores ----------------------------------------------------------------------------------------------------------

_CRITERIA = {"price": analysis.Criterion("p_retailprice", 900, 1800, "low"), "size": analysis.Criterion("s", 0, 50)}
_SCENARIOS = [{"id": "base", "weights": {"price": 3, "size": 1}, "threshold": 0.6}, {"id": "other", "weights": {"price": 1, "size": 3}, "threshold": 0.6}]
_SCORE = """WITH b AS (SELECT p_partkey, 1 - greatest(0, least(1, (p_retailprice - 900) / 900)) AS p, CASE WHEN p_size % 10 <> 0 THEN greatest(0, least(1, p_size / 50)) END AS s, p_retailprice BETWEEN 950 AND 1700 AS fit FROM part),
    w AS (SELECT * FROM (VALUES ('base', 0.75::DOUBLE, 0.25::DOUBLE), ('other', 0.25::DOUBLE, 0.75::DOUBLE)) v(scenario, wp, ws)),
    q AS (SELECT CAST(p_partkey AS VARCHAR) AS id, scenario, s IS NOT NULL AND fit AS eligible, round(p * wp + s * ws, 9) AS score FROM b, w)
    , t AS (SELECT id, scenario, eligible, CASE WHEN eligible THEN score END AS score, CASE WHEN eligible THEN CAST(rank() OVER (PARTITION BY scenario, eligible ORDER BY score DESC) AS INTEGER) END AS rank, coalesce(eligible AND score >= 0.6, false) AS selected FROM q)"""


def _scores(spark, sf):
    p = load(spark, sf, "part").withColumn("s", F.when(F.col("p_size") % 10 != 0, F.col("p_size")))
    return analysis.suitability(p, "p_partkey", _CRITERIA, _SCENARIOS, [("p_retailprice", 950, 1700)]).withColumn("score", F.round("score", 9))


@query("suitability_scores", f"{_SCORE} SELECT id, scenario, eligible, score, selected FROM t")
def suitability_scores(spark, sf):
    return _scores(spark, sf).select("id", "scenario", "eligible", "score", "selected")


@query("suitability_ranks", "SELECT id, CAST(rank() OVER (ORDER BY s DESC) AS INTEGER) AS rank FROM (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size / 64.0::DOUBLE AS s FROM part WHERE p_size IS NOT NULL)")
def suitability_ranks(spark, sf):
    """Scores that are sums of few binary digits, so that equal ones tie everywhere."""
    part = load(spark, sf, "part").select("p_partkey", "p_size")
    return analysis.suitability(part, "p_partkey", {"size": analysis.Criterion("p_size", 0, 64)}, [{"id": "one", "weights": {"size": 1}, "threshold": 0.0}]).select("id", "rank")


@query("suitability_stability", f"{_SCORE} SELECT id, CAST(sum(selected::INT) AS BIGINT) AS selected_scenarios, bool_and(selected) AS stable_selected, NOT bool_or(selected) AS never_selected, min(score) AS score_min, max(score) AS score_max FROM t GROUP BY 1")
def suitability_stability(spark, sf):
    return analysis.stability(_scores(spark, sf)).drop("rank_min", "rank_max")


@query("segment_matches")
def segment_matches(spark, sf):
    def lines(df, key, size):
        return df.select(F.col(key).alias("id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 25).alias("x1"), (F.col("y") + size).alias("y1"))

    return conflation.match_segments(lines(i.suppliers(spark, sf), "s_suppkey", 1), lines(i.customers(spark, sf), "c_custkey", F.col("c_custkey") % 3), 8.0, 15.0, 3.0)


# --- SQL -------------------------------------------------------------------------------------------------------------


def _sql_query(name: str, statement: str, *tables: str, oracle: str | None = None):
    def run(spark, sf):
        return run_select(spark, statement, {t: load(spark, sf, t) for t in tables}).df

    query(f"sql_{name}", oracle or statement)(run)


_sql_query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
_sql_query("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "lineitem")
_sql_query("grouping_sets", "SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber), ())", "lineitem")
_sql_query("window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", "orders", oracle="SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders")
_sql_query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", "customer", "supplier")
_sql_query("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", "customer", "orders")
_sql_query("filter_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders GROUP BY o_orderstatus", "orders")
_sql_query("recursive", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, count(p_partkey) AS parts FROM t LEFT JOIN part ON p_size = n GROUP BY n", "part")
_sql_query("correlated", "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)", "customer")


# --- streams ---------------------------------------------------------------------------------------------------------


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS cnt, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    return streams.tumbling(load(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("stream_sessions", "SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS cnt FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf):
    return streams.sessions(load(spark, sf, "events"), "30 minutes")


@query("duplicate_members", "SELECT p_partkey FROM (SELECT p_partkey, count(*) OVER (PARTITION BY p_size, p_brand) AS n FROM part) WHERE n > 1")
def duplicate_members(spark, sf):
    return load(spark, sf, "part").withColumn("n", F.count("*").over(Window.partitionBy("p_size", "p_brand"))).where("n > 1").select("p_partkey")
