"""The relational floor: joins, set operations, grouping, ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.plans.registry import query
from lumenflow.session import table


@query("r01_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def r01(spark, d):
    li = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("r02_star_join", """SELECT n.n_name, c.c_mktsegment, round(sum(l.l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def r02(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice")
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "c_mktsegment").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


@query("r03_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS big FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def r03(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    some = c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
    big = o.filter("o_totalprice > 100000").select(F.col("o_custkey").alias("k")).distinct()
    return some.join(big, some.c_custkey == big.k, "left").select("c_custkey", F.col("k").isNotNull().alias("big"))


@query("r04_set_operations", "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def r04(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(o.union(c).distinct(), "union").unionByName(count(o.intersect(c), "intersect")).unionByName(count(c.subtract(o), "except"))


@query("r05_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def r05(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("r06_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, rk FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS rk FROM lineitem) WHERE rk <= 3")
def r06(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("rk", F.row_number().over(w)).filter("rk <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "rk")


@query("r07_event_counts", "SELECT event_type, date_trunc('day', ts)::DATE AS day, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1, 2")
def r07(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("v"))
