"""Breadth: streams read back as tables, and relational queries on the star schema.

The relational queries are the engine's breadth, for users who join an inventory
with other tables; they are not operators of an inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.sources import adapters as A
from folioforge.sources.scratch import scratch
from folioforge.streaming import progress


def stream_counters(spark, sf_dir) -> DataFrame:
    src = f"{sf_dir}/events.parquet"
    out, mark = scratch(spark, "counters"), scratch(spark, "counters-mark")
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    progress.run_counters(stream, out, mark)
    return progress.newest_batch(spark, out).select("event_type", "n", F.round("total", 2).alias("total"))


def stream_upsert(spark, sf_dir) -> DataFrame:
    old, feed = A.snapshot_and_feed(spark, sf_dir)
    snapshot, source, mark = (scratch(spark, t) for t in ("snapshot", "feed", "feed-mark"))
    progress.start_snapshot(old, snapshot, 8)
    feed.repartition(4, "item_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    progress.upsert_stream(progress.file_stream(spark, source, schema, 2), snapshot, mark, 8)
    return progress.snapshot_rows(spark, snapshot)


def breadth_star_join(spark, sf_dir) -> DataFrame:
    t = lambda n: A.table(spark, sf_dir, n)
    li = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = t("orders").select("o_orderkey", "o_custkey")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return j.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("lines"))


def breadth_semi_anti(spark, sf_dir) -> DataFrame:
    c, o = A.table(spark, sf_dir, "customer"), A.table(spark, sf_dir, "orders")
    big = o.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(big, "c_custkey", "left_semi").select("c_custkey", F.lit("semi").alias("kind"))
    return has.union(c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", F.lit("anti").alias("kind")))


def breadth_cube(spark, sf_dir) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("g"))


def breadth_set_ops(spark, sf_dir) -> DataFrame:
    li, ps = A.table(spark, sf_dir, "lineitem"), A.table(spark, sf_dir, "supplier")
    a, b = li.filter("l_quantity > 45").select(F.col("l_suppkey").alias("k")), ps.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    return a.intersect(b).withColumn("op", F.lit("intersect")).union(b.exceptAll(a.distinct()).withColumn("op", F.lit("except")))


def breadth_as_of(spark, sf_dir) -> DataFrame:
    """For each purchase the user's last click before it, as a running last value over the union: no range join."""
    e = A.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.withColumn("click_id", last).filter("event_type = 'purchase'").select("event_id", "click_id")


def breadth_sessions(spark, sf_dir) -> DataFrame:
    e = A.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = [
    (breadth_star_join, "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"),
    (breadth_semi_anti, "SELECT c_custkey, 'semi' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    (breadth_cube, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    (breadth_set_ops, "SELECT *, 'intersect' AS op FROM (SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT *, 'except' FROM (SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)"),
    (breadth_as_of, "SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events) WHERE event_type = 'purchase'"),
    (breadth_sessions, "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id"),
]
