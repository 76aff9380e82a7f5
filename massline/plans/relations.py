"""Plain relational queries on the order tables: joins, rollups, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, read


def t(spark, d, *names):
    return [read(spark, d, n) for n in names]


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def tpch_pricing_summary(spark, d):
    (l,) = t(spark, d, "lineitem")
    g = l.where("l_shipdate <= timestamp'1998-09-02'").groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def tpch_inner_joins(spark, d):
    c, o, l, n, r = t(spark, d, "customer", "orders", "lineitem", "nation", "region")
    n = n.join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def tpch_left_outer(spark, d):
    c, o = t(spark, d, "customer", "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY ALL")
def tpch_semi(spark, d):
    o, l = t(spark, d, "orders", "lineitem")
    return o.join(l.where("l_quantity > 45").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) GROUP BY ALL")
def tpch_anti(spark, d):
    c, o = t(spark, d, "customer", "orders")
    return c.join(o.where("o_totalprice > 350000").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT coalesce(p_brand, 'ALL') AS brand, coalesce(p_type, 'ALL') AS kind, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_type)")
def tpch_rollup(spark, d):
    (p,) = t(spark, d, "part")
    g = p.rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))
    return g.select(F.coalesce("p_brand", F.lit("ALL")).alias("brand"), F.coalesce("p_type", F.lit("ALL")).alias("kind"), "n", "price")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def tpch_top_per_group(spark, d):
    (o,) = t(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rk", F.row_number().over(w)).where("rk <= 3").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


@query("SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY l_partkey ORDER BY qty DESC, l_partkey LIMIT 15")
def tpch_top_k(spark, d):
    (l,) = t(spark, d, "lineitem")
    return l.groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("qty")).orderBy(F.desc("qty"), "l_partkey").limit(15)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def tpch_intersect(spark, d):
    c, s = t(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def tpch_except(spark, d):
    n, s = t(spark, d, "nation", "supplier")
    return n.select(F.col("n_nationkey").alias("k")).exceptAll(s.where("s_acctbal > 5000").select("s_nationkey").distinct())


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal < 0) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def tpch_symmetric_difference(spark, d):
    c, s = t(spark, d, "customer", "supplier")
    a = c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = s.select(F.col("s_nationkey").alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").where("a is null or b is null").select("k", F.when(F.col("a").isNull(), "right").otherwise("left").alias("side"))


@query("""SELECT c_mktsegment, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS p FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment""")
def tpch_pivot(spark, d):
    c, o = t(spark, d, "customer", "orders")
    g = c.join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.sum("o_totalprice"), 2))
    return g.select("c_mktsegment", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT o_orderkey, measure, value FROM (SELECT o_orderkey, round(o_totalprice, 2) AS total, CAST(o_custkey AS DOUBLE) AS customer FROM orders) UNPIVOT (value FOR measure IN (total, customer))")
def tpch_unpivot(spark, d):
    (o,) = t(spark, d, "orders")
    x = o.select("o_orderkey", F.round("o_totalprice", 2).alias("total"), F.col("o_custkey").cast("double").alias("customer"))
    return x.unpivot("o_orderkey", ["total", "customer"], "measure", "value")


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def tpch_count_distinct(spark, d):
    (l,) = t(spark, d, "lineitem")
    return l.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))
