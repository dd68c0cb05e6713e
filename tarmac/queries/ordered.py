"""Windows and ordered analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import windows
from tarmac.queries.registry import Registry, table

query = Registry()


@query("""SELECT event_id, round(CASE WHEN n - p = 1 AND value > v THEN value - v ELSE 0 END, 6) AS gain FROM (SELECT *, lag(value) OVER w AS v, lag(n) OVER w AS p FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 5 > 0 WINDOW w AS (PARTITION BY user_id ORDER BY n))""")
def lag_gap_gain(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("n % 5 > 0")
    by = Window.partitionBy("user_id").orderBy("n")
    step = F.when((F.col("n") - F.lag("n").over(by) == 1) & (F.col("value") > F.lag("value").over(by)), F.col("value") - F.lag("value").over(by)).otherwise(0.0)
    return events.select("event_id", F.round(step, 6).alias("gain"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, lead(l_linenumber) OVER w AS next, (row_number() OVER w - 1)::INT AS segment FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""")
def lead_spans(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lead("l_linenumber").over(by).alias("next"), (F.row_number().over(by) - 1).alias("segment"))


@query("""SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY length(c_name) DESC) AS rank FROM customer) WHERE rank = 1""")
def rank_ties(spark, sf_dir):
    by = Window.partitionBy("c_nationkey").orderBy(F.desc(F.length("c_name")))
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.rank().over(by).cast("long").alias("rank")).where("rank = 1")


@query("""SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS running FROM orders""")
def running_sum(spark, sf_dir):
    by = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(by), 2).alias("running"))


@query("""SELECT p_brand, n FROM (SELECT p_brand, n, sum(n) OVER (ORDER BY n, p_brand) AS upto, sum(n) OVER () AS total FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)) WHERE upto <= total / 2""")
def running_cutoff(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")).withColumn("_all", F.lit(0))
    by = Window.partitionBy("_all")  # a row for each brand
    return counts.withColumn("upto", F.sum("n").over(by.orderBy("n", "p_brand"))).withColumn("total", F.sum("n").over(by)).where("upto <= total / 2").select("p_brand", "n")


_SPINE = """WITH hours AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
    spine AS (SELECT t.event_type, unnest(range(lo, hi + 3600, 3600)) AS hour FROM (SELECT DISTINCT event_type FROM hours) t, (SELECT min(hour) AS lo, max(hour) AS hi FROM hours)),
    dense AS (SELECT s.event_type, s.hour, h.v FROM spine s LEFT JOIN hours h USING (event_type, hour))"""


def _dense(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("hour", F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))))
    hours = events.groupBy("event_type", "hour").agg(F.round(F.sum("value"), 6).alias("v"))
    ends = hours.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    spine = hours.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", F.explode(F.sequence("lo", "hi", F.lit(3600).cast("long"))).alias("hour"))  # one row of ends
    return spine.join(hours, ["event_type", "hour"], "left")


@query(_SPINE + """ SELECT event_type, hour, v, CASE WHEN count(v) OVER a = 3 THEN round(sum(v) OVER a, 4) END AS v_3h, CASE WHEN count(v) OVER b = 12 THEN round(sum(v) OVER b, 4) END AS v_12h FROM dense
    WINDOW a AS (PARTITION BY event_type ORDER BY hour ROWS 2 PRECEDING), b AS (PARTITION BY event_type ORDER BY hour ROWS 11 PRECEDING)""")
def trailing_k_hours(spark, sf_dir):
    out = windows.trailing_sums(_dense(spark, sf_dir), "event_type", "hour", "v", [3, 12])
    return out.select("event_type", "hour", "v", F.round("v_3h", 4).alias("v_3h"), F.round("v_12h", 4).alias("v_12h"))


@query(_SPINE + """, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS n FROM dense), m AS (SELECT *, max(CASE WHEN v >= 100 THEN n END) OVER w AS last, max(CASE WHEN v IS NULL THEN n END) OVER w AS gap FROM n WINDOW w AS (PARTITION BY event_type ORDER BY hour))
    SELECT event_type, hour, v, (CASE WHEN gap IS NOT NULL AND gap > coalesce(last, 0) THEN NULL WHEN last IS NULL THEN 72 ELSE least(n - last, 72) END)::INT AS hours_since FROM m""")
def hours_since_event(spark, sf_dir):
    return windows.hours_since(_dense(spark, sf_dir), "event_type", "hour", "v", 100.0)


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size <= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size < a.p_size))""")
def pareto_front(spark, sf_dir):
    return windows.pareto_front(table(spark, sf_dir, "part"), "p_retailprice", "p_size").select("p_partkey")


_LAYER = "{name} AS (SELECT x.* FROM {rest} x WHERE NOT EXISTS (SELECT 1 FROM {rest} y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b)))"


@query(f"""WITH g AS (SELECT p_partkey, p_retailprice AS a, p_size AS b FROM part), {_LAYER.format(name="l0", rest="g")}, r1 AS (SELECT * FROM g EXCEPT SELECT * FROM l0), {_LAYER.format(name="l1", rest="r1")}, r2 AS (SELECT * FROM r1 EXCEPT SELECT * FROM l1), {_LAYER.format(name="l2", rest="r2")}
    SELECT p_partkey, 0 AS layer FROM l0 UNION ALL SELECT p_partkey, 1 FROM l1 UNION ALL SELECT p_partkey, 2 FROM l2""")
def pareto_layers(spark, sf_dir):
    return windows.pareto_layers(table(spark, sf_dir, "part"), "p_retailprice", "p_size", 3).where("layer is not null").select("p_partkey", "layer")


@query("""SELECT bin, s_suppkey, b FROM (SELECT floor(s_acctbal / 1000)::INT AS bin, s_suppkey, s_nationkey AS b, dense_rank() OVER (PARTITION BY floor(s_acctbal / 1000) ORDER BY s_nationkey) AS r FROM supplier) WHERE r <= 2""")
def bucketed_top(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.floor(F.col("s_acctbal") / 1000).cast("int").alias("bin"), "s_suppkey", F.col("s_nationkey").alias("b"))
    return rows.withColumn("r", F.dense_rank().over(Window.partitionBy("bin").orderBy("b"))).where("r <= 2").drop("r")


@query("""SELECT p_partkey, p_retailprice, p_size FROM part ORDER BY p_size, p_retailprice DESC, p_partkey LIMIT 25""")
def topk_lexsort(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_size", F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_retailprice", "p_size")


@query("""SELECT event_type, hour, v FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS n FROM (""" + _SPINE.replace("WITH hours", "WITH hours") + """ SELECT * FROM dense)) WHERE n % 2 = 1 AND n <= 16""")
def two_hour_slots(spark, sf_dir):
    placed = _dense(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("hour")))
    return placed.where("n % 2 = 1 and n <= 16").select("event_type", "hour", "v")


@query("""SELECT day, CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN round(max(v) - min(v), 4) END AS range FROM (SELECT strftime(to_timestamp(hour), '%Y-%m-%d') AS day, v FROM (""" + _SPINE + """ SELECT * FROM dense)) GROUP BY 1""")
def daily_range(spark, sf_dir):
    days = _dense(spark, sf_dir).withColumn("day", F.date_format(F.timestamp_seconds("hour"), "yyyy-MM-dd"))
    return days.groupBy("day").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.round(F.max("v") - F.min("v"), 4)).alias("range"))


QUERIES, ORACLES = query.queries, query.oracles
