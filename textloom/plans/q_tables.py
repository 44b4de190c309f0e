"""Relational breadth over the star schema, and windows over the events, batch and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import scoring as S
from textloom.session import table
from textloom.streaming import events as V


def _t(spark, d, *names):
    return [table(spark, d, n) for n in names]


def pricing_summary(spark, d):
    (li,) = _t(spark, d, "lineitem")
    li = li.where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("revenue"), F.round(F.avg("l_discount"), 10).alias("avg_disc"), F.count("*").alias("n")
    )


def nation_revenue(spark, d):
    c, o, li, n, r = _t(spark, d, "customer", "orders", "lineitem", "nation", "region")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def idle_customers(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))


def buying_customers(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    big = o.where("o_totalprice > 100000")
    return c.join(big, c.c_custkey == big.o_custkey, "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("customers"))


def supplier_customer_full(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a = c.where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    b = s.where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    return a.join(b, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


def segment_rollup(spark, d):
    c, o = _t(spark, d, "customer", "orders")
    return o.join(c, o.o_custkey == c.c_custkey).rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def part_cube(spark, d):
    (p,) = _t(spark, d, "part")
    return p.cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def customer_top_orders(spark, d):
    (o,) = _t(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", F.col("r").cast("bigint").alias("r"))


def order_gaps(spark, d):
    (o,) = _t(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    g = o.withColumn("gap", F.datediff("o_orderdate", F.lag("o_orderdate").over(w))).withColumn("running", F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("o_custkey").agg(F.max("gap").cast("bigint").alias("longest_gap"), F.round(F.max("running"), 2).alias("spent"))


def monthly_pivot(spark, d):
    (o,) = _t(spark, d, "orders")
    return o.withColumn("year", F.year("o_orderdate").cast("bigint")).groupBy("year").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]).agg(F.count("o_orderkey")).na.fill(0)


def median_quantities(spark, d):
    (li,) = _t(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), F.round(F.stddev("l_extendedprice"), 4).alias("sd"), F.count_distinct("l_suppkey").alias("suppliers"))


def set_operations(spark, d):
    c, s = _t(spark, d, "customer", "supplier")
    a, b = c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("nation")), s.select(F.col("s_nationkey").alias("nation"))
    return a.intersect(b).withColumn("op", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("op", F.lit("more_customers"))).unionByName(b.subtract(a).withColumn("op", F.lit("suppliers_only")))


def event_props(spark, d):
    (e,) = _t(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.round(F.avg("value"), 10).alias("value"))


def event_daily(spark, d):
    (e,) = _t(spark, d, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def event_funnel(spark, d):
    """Users with a view before a purchase, and the hours between the first ones."""
    (e,) = _t(spark, d, "events")
    f = e.groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "view", F.col("ts"))).alias("v"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("p"))
    return f.where("v < p").select("user_id", F.floor((F.unix_micros(F.col("p").cast("timestamp")) - F.unix_micros(F.col("v").cast("timestamp"))) / 3_600_000_000).alias("hours"))


def running_clock(spark, d):
    """A value that falls at times, as a clock that never does."""
    (e,) = _t(spark, d, "events")
    c = S.running_clock(e.withColumn("value", F.round("value", 2)), "user_id", ["ts", "event_id"], "value")
    return c.groupBy("user_id").agg(F.round(F.max("clock"), 2).alias("clock"), F.count("*").alias("n"))


def as_of_orders(spark, d):
    """For each order above 300,000 the customer's order before it."""
    (o,) = _t(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.withColumn("before", F.lag("o_orderkey").over(w)).where("o_totalprice > 300000").select("o_orderkey", "before")


def tumbling(spark, d):
    (e,) = _t(spark, d, "events")
    w = V.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(spark, d):
    (e,) = _t(spark, d, "events")
    w = V.windowed_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "2 hours", "1 hour")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def user_sessions(spark, d):
    (e,) = _t(spark, d, "events")
    s = V.sessions(e.withColumn("ts", F.col("ts").cast("timestamp")), "12 hours")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def stream_tumbling(spark, d):
    """The hourly counts by a stream that takes all there is."""
    w = V.run_once(V.windowed_counts(V.event_stream(spark, d), "1 hour"), "s" + uuid.uuid4().hex)
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        pricing_summary, nation_revenue, idle_customers, buying_customers, supplier_customer_full, segment_rollup, part_cube, customer_top_orders, order_gaps, monthly_pivot, median_quantities,
        set_operations, event_props, event_daily, event_funnel, running_clock, as_of_orders, tumbling, sliding, user_sessions, stream_tumbling,
    )
}

_HOURLY = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
ORACLES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 10) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "nation_revenue": """
        SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "idle_customers": "SELECT c_mktsegment, count(*) AS customers FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "buying_customers": "SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) GROUP BY 1",
    "supplier_customer_full": """
        SELECT coalesce(c_nationkey, s_nationkey) AS nation, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal < 0 GROUP BY 1)
        FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON c_nationkey = s_nationkey""",
    "segment_rollup": "SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)",
    "part_cube": "SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY CUBE (p_brand, p_size)",
    "customer_top_orders": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 2",
    "order_gaps": """
        SELECT o_custkey, max(gap) AS longest_gap, round(max(running), 2) AS spent FROM (SELECT o_custkey, date_diff('day', lag(o_orderdate) OVER w::DATE, o_orderdate::DATE) AS gap,
            sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) GROUP BY 1""",
    "monthly_pivot": "SELECT year(o_orderdate) AS year, " + ", ".join(f"count(*) FILTER (o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY 1",
    "median_quantities": "SELECT l_returnflag, median(l_quantity) AS median, round(stddev(l_extendedprice), 4) AS sd, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1",
    "set_operations": """
        WITH a AS (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal < 0), b AS (SELECT s_nationkey AS nation FROM supplier)
        SELECT nation, 'both' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT DISTINCT nation, 'more_customers' FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
        UNION ALL SELECT nation, 'suppliers_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "event_props": "SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS k, round(avg(value), 10) AS value FROM events GROUP BY 1",
    "event_daily": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_funnel": """
        SELECT user_id, floor((epoch_us(p) - epoch_us(v)) / 3600000000)::BIGINT AS hours FROM (SELECT user_id, min(ts) FILTER (event_type = 'view') AS v, min(ts) FILTER (event_type = 'purchase') AS p FROM events GROUP BY 1) WHERE v < p""",
    "running_clock": """
        WITH e AS (SELECT user_id, ts, event_id, round(value, 2) AS v, lag(round(value, 2)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l FROM events)
        SELECT user_id, round(max(clock), 2) AS clock, count(*) AS n FROM (SELECT user_id, v + sum(CASE WHEN v < l THEN l ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS clock FROM e) GROUP BY 1""",
    "as_of_orders": "SELECT o_orderkey, before FROM (SELECT o_orderkey, o_totalprice, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders) WHERE o_totalprice > 300000",
    "tumbling": _HOURLY,
    "stream_tumbling": _HOURLY,
    "sliding": """
        SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2""",
    "user_sessions": """
        WITH e AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR)::INT AS b FROM events),
        s AS (SELECT user_id, sum(coalesce(b, 0)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
        SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""",
}
