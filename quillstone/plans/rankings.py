"""Queries that look up, rank, deduplicate and merge rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lookups, ranking
from ..operators.constraints import merged_documents
from ..sources.tables import table


def global_topk_merge(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.col("value").alias("score"), "event_id")
    best = lambda part: ranking.keep_first(e.filter(part), ["user_id", "event_type"], F.desc("score"), "event_id").drop("event_id")
    old, new = best(F.col("event_id") % 2 == 0), best(F.col("event_id") % 2 == 1)
    return ranking.merge_top_k(old, new, ["user_id", "event_type"], 50, "score").withColumn("score", F.round("score", 6))


def quota_topk(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return ranking.quota(p, "p_brand", {"Brand#11": 6, "Brand#12": 4, "Brand#13": 2, "Brand#1": 6, "Brand#2": 4, "Brand#3": 2}, F.desc("p_retailprice"), "p_partkey").withColumn("rank", F.col("rank").cast("long"))


def topk_per_group(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranking.top_k(o, ["o_custkey"], 3, F.desc("o_totalprice"), "o_orderkey").withColumn("rank", F.col("rank").cast("long"))


def resample_fraction(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    return ranking.fraction(s, ["s_nationkey"], 0.3, F.desc("s_acctbal"), "s_suppkey").withColumn("rank", F.col("rank").cast("long"))


def keep_last_rows(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return ranking.keep_last(e, ["user_id", "event_type"], "event_id")


def seeded_shuffle(spark, d):
    """Ten events of each user by a seeded shuffle that does not depend on partitions."""
    e = table(spark, d, "events").select("user_id", "event_id").withColumn("key", ranking.shuffled_key(F.col("event_id"), 7))
    return ranking.top_k(e, ["user_id"], 10, "key", "event_id").select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


def new_rows_antijoin(spark, d):
    o = table(spark, d, "orders")
    key = ["o_custkey", "o_orderpriority"]
    now, before = o.filter("o_orderdate >= '1996-01-01'").select(*key).distinct(), o.filter("o_orderdate < '1996-01-01'").select(*key).distinct()
    return lookups.new_rows(now, before, key)


def whitelist_semijoin(spark, d):
    good = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(good, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def first_wins_lookup(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lookups.lookup_first(o, l, "o_orderkey", "l_linenumber", "l_partkey")


def last_wins_enrich(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_shipdate", "l_linenumber", "l_suppkey").alias("o"), "l_suppkey")
    return lookups.enrich_last(table(spark, d, "orders").select("o_orderkey"), l, "o_orderkey", "l_suppkey", "o")


def missing_keys(spark, d):
    """Customers without an urgent order."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return lookups.missing_keys(c, table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


def best_instance(spark, d):
    """For each nation the first supplier of the first filled level: rich, then solvent, then any."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    rows = n.join(s, F.col("n_nationkey") == F.col("s_nationkey")).withColumn("level", F.when(F.col("s_acctbal") > 9000, 1).when(F.col("s_acctbal") > 0, 2).otherwise(3))
    return lookups.fallback_levels(rows.select("n_name", "level", "s_suppkey"), "n_name", "level", "s_suppkey")


def edge_inversion(spark, d):
    e = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    inv = lookups.inverted(e, "l_suppkey", "l_partkey", "parts")
    return inv.select("l_suppkey", F.size("parts").cast("long").alias("n_parts"), F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


def positional_join(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", F.length("text").alias("n")), table(spark, d, "benchmark").select("item_id", F.length("text").alias("m"))
    return lookups.zip_rows(docs, "doc_id", items, "item_id")


def evidence_rollup(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = l.groupBy("l_suppkey").agg(
        F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("brands"),
        F.array_join(F.array_sort(F.collect_set(F.upper("p_type"))), "|").alias("types"),
        F.count("*").alias("n"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("ratio"),
        F.max((F.col("l_discount") > 0.09).cast("int")).alias("a"),
        F.max((F.col("l_tax") > 0.07).cast("int")).alias("b"),
        F.max((F.col("l_quantity") > 49).cast("int")).alias("c"),
    )
    conf = F.least(F.lit(0.99), 0.4 * F.least(F.lit(1.0), F.col("n") / 50) + 0.3 * F.col("ratio") + 0.1 * (F.col("a") + F.col("b") + F.col("c")))
    return g.select("l_suppkey", "brands", "types", "n", F.round(conf, 3).alias("confidence"))


def multi_key_order(spark, d):
    """Places under a mixed order: hit first, then count downwards, then name."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.max((F.col("c_acctbal") > 9900).cast("int")).alias("hit"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("hit"), F.desc("n"), "c_nationkey")
    return c.withColumn("place", F.row_number().over(w).cast("long"))


def token_set_ops(spark, d):
    """Union, intersection, difference and subset of the letters of a customer's segment and name."""
    c = table(spark, d, "customer")
    a, b = (F.array_distinct(F.filter(F.split(F.upper(x), ""), lambda v: v.rlike("[A-Z]"))) for x in ("c_mktsegment", "c_name"))
    j = lambda x: F.array_join(F.array_sort(x), "")
    return c.select("c_custkey", j(F.array_union(a, b)).alias("u"), j(F.array_intersect(a, b)).alias("i"), j(F.array_except(a, b)).alias("x"), (F.size(F.array_except(b, a)) == 0).alias("subset"))


def doc_merge(spark, d):
    """A customer's orders as fragments of one document: lists united, the first and the last writer's fields."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("marks"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("head"), F.when(F.col("o_totalprice") < 200000, F.col("o_orderpriority")).alias("meta"))
    m = merged_documents(o, "o_custkey", "o_orderkey", ["marks"], ["head"], ["meta"])
    return m.select("o_custkey", F.array_join("marks", "|").alias("marks"), "head", "meta")


def customer_features(spark, d):
    """Nested records: each customer's lines by bucket, empty buckets as null."""
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.translate(F.upper(F.concat(F.col("l_returnflag"), F.lit(" - "), F.col("l_linestatus"))), " -", "")
    buckets = {"returned": ["RF"], "open": ["NO"], "closed": ["AF", "NF"]}
    g = l.withColumn("kind", kind).groupBy("o_custkey").agg(*[F.nullif(F.count_if(F.col("kind").isin(v)), F.lit(0)).alias(k) for k, v in buckets.items()], *[F.max_by("l_orderkey", F.when(F.col("kind").isin(v), F.col("l_orderkey") * 10 + F.col("l_linenumber"))).alias(f"last_{k}") for k, v in buckets.items()])
    return g


QUERIES = {f.__name__: f for f in (global_topk_merge, quota_topk, topk_per_group, resample_fraction, keep_last_rows, seeded_shuffle, new_rows_antijoin, whitelist_semijoin, first_wins_lookup, last_wins_enrich, missing_keys, best_instance, edge_inversion, positional_join, evidence_rollup, multi_key_order, token_set_ops, doc_merge, customer_features)}

ORACLES = {
    "global_topk_merge": """WITH f AS (SELECT user_id, event_type, value AS score, event_id % 2 AS new, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY new) AS k FROM f WHERE rn = 1)
SELECT user_id, event_type, round(score, 6) AS score FROM o WHERE k = 1 ORDER BY o.score DESC NULLS LAST, user_id, event_type LIMIT 50""",
    "quota_topk": """WITH r AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rank FROM part)
SELECT * FROM r WHERE rank <= CASE WHEN p_brand IN ('Brand#11', 'Brand#1') THEN 6 WHEN p_brand IN ('Brand#12', 'Brand#2') THEN 4 WHEN p_brand IN ('Brand#13', 'Brand#3') THEN 2 ELSE 0 END""",
    "topk_per_group": "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "resample_fraction": "SELECT s_nationkey, s_suppkey, s_acctbal, rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST, s_suppkey) AS rank, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) WHERE rank <= greatest(1, floor(n * 0.3::DOUBLE))",
    "keep_last_rows": "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(round(value, 6), event_id) AS value, min(event_id) AS first_place FROM events GROUP BY user_id, event_type",
    "seeded_shuffle": "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id || '|7'), event_id) AS rank FROM events) WHERE rank <= 10",
    "new_rows_antijoin": "SELECT DISTINCT o_custkey, o_orderpriority FROM orders n WHERE o_orderdate >= '1996-01-01' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderdate < '1996-01-01' AND b.o_custkey IS NOT DISTINCT FROM n.o_custkey AND b.o_orderpriority IS NOT DISTINCT FROM n.o_orderpriority)",
    "whitelist_semijoin": "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 5000)",
    "first_wins_lookup": "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1",
    "last_wins_enrich": "SELECT o_orderkey, l_suppkey FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1",
    "missing_keys": "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "best_instance": "SELECT n_name, level, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY level, s_suppkey) AS rn FROM (SELECT n_name, CASE WHEN s_acctbal > 9000 THEN 1 WHEN s_acctbal > 0 THEN 2 ELSE 3 END AS level, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey)) WHERE rn = 1",
    "edge_inversion": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_parts, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS parts FROM lineitem GROUP BY l_suppkey",
    "positional_join": "WITH a AS (SELECT doc_id, length(text)::INT AS n, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents), b AS (SELECT item_id, length(text)::INT AS m, row_number() OVER (ORDER BY item_id) - 1 AS ordinal FROM benchmark) SELECT * FROM a JOIN b USING (ordinal)",
    "evidence_rollup": """WITH g AS (SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT p_brand)), '|') AS brands, array_to_string(list_sort(list(DISTINCT upper(p_type))), '|') AS types, count(*) AS n, avg((l_returnflag = 'R')::INT) AS ratio,
 max((l_discount > 0.09::DOUBLE)::INT) + max((l_tax > 0.07::DOUBLE)::INT) + max((l_quantity > 49)::INT) AS f FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)
SELECT l_suppkey, brands, types, n, round(least(0.99::DOUBLE, 0.4::DOUBLE * least(1.0::DOUBLE, n / 50) + 0.3::DOUBLE * ratio + 0.1::DOUBLE * f), 3) AS confidence FROM g""",
    "multi_key_order": "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, max((c_acctbal > 9900)::INT) AS hit FROM customer GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY hit DESC, n DESC, c_nationkey) AS place FROM c",
    "token_set_ops": """WITH c AS (SELECT c_custkey, list_distinct(list_filter(string_split(upper(c_mktsegment), ''), lambda v: regexp_matches(v, '[A-Z]'))) AS a, list_distinct(list_filter(string_split(upper(c_name), ''), lambda v: regexp_matches(v, '[A-Z]'))) AS b FROM customer)
SELECT c_custkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), '') AS u, array_to_string(list_sort(list_intersect(a, b)), '') AS i, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), '') AS x, len(list_filter(b, lambda v: NOT list_contains(a, v))) = 0 AS subset FROM c""",
    "doc_merge": """WITH m AS (SELECT o_custkey, v, min(o_orderkey * 2 + p) AS o FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS v, 0 AS p FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, 1 FROM orders) GROUP BY ALL),
l AS (SELECT o_custkey, string_agg(v, '|' ORDER BY o) AS marks FROM m GROUP BY o_custkey), f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) FILTER (o_totalprice > 100000 AND o_orderstatus IS NOT NULL) AS head, arg_max(o_orderpriority, o_orderkey) FILTER (o_totalprice < 200000 AND o_orderpriority IS NOT NULL) AS meta FROM orders GROUP BY o_custkey)
SELECT * FROM l JOIN f USING (o_custkey)""",
    "customer_features": """WITH l AS (SELECT o_custkey, upper(l_returnflag || l_linestatus) AS kind, l_orderkey, l_orderkey * 10 + l_linenumber AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_custkey, nullif(count(*) FILTER (kind = 'RF'), 0) AS returned, nullif(count(*) FILTER (kind = 'NO'), 0) AS open, nullif(count(*) FILTER (kind IN ('AF', 'NF')), 0) AS closed,
 arg_max(l_orderkey, o) FILTER (kind = 'RF') AS last_returned, arg_max(l_orderkey, o) FILTER (kind = 'NO') AS last_open, arg_max(l_orderkey, o) FILTER (kind IN ('AF', 'NF')) AS last_closed FROM l GROUP BY o_custkey""",
}
