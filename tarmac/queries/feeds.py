"""Event windows, sessions, deduplication, histories and rate limits on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.queries.registry import Registry, table
from tarmac.sources import ingest
from tarmac.streaming import feeds

query = Registry()


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("""SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark, sf_dir):
    out = feeds.windowed(_events(spark, sf_dir), "at", "1 hour", keys=("event_type",))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, count(*) AS n FROM (SELECT unnest([epoch(time_bucket(INTERVAL 1 HOUR, ts)) - 3600 * k FOR k IN range(0, 3)])::BIGINT AS start FROM events) GROUP BY 1""")
def sliding_window(spark, sf_dir):
    return feeds.windowed(_events(spark, sf_dir), "at", "3 hours", "1 hour").select(F.unix_timestamp("start").alias("start"), "n")


@query("""SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session_window(spark, sf_dir):
    out = feeds.sessions(_events(spark, sf_dir), "at", "6 hours", ("user_id",))
    return out.select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("""SELECT user_id, event_type, count(DISTINCT date_trunc('hour', ts)) AS n FROM events GROUP BY 1, 2""")
def dedup(spark, sf_dir):
    events = _events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "at"))
    return events.dropDuplicates(["user_id", "event_type", "hour"]).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id FROM events, (SELECT max(ts) AS last FROM events) WHERE ts >= last - INTERVAL 150 MINUTE""")
def late_filter(spark, sf_dir):
    events = _events(spark, sf_dir)
    last = events.agg(F.max("at").alias("last"))
    return events.crossJoin(F.broadcast(last)).where(F.col("at") >= F.col("last") - F.expr("interval 150 minutes")).select("event_id")  # one row


@query("""SELECT event_type, hour, round(value, 6) AS value FROM (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS hour, value, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS n, max(date_trunc('hour', ts)) OVER () AS last, date_trunc('hour', ts) AS h FROM events) WHERE n = 1 AND h > last - INTERVAL 72 HOUR""")
def hourly_history(spark, sf_dir):
    events = _events(spark, sf_dir).select("event_type", F.date_trunc("hour", "at").alias("hour"), F.struct("at", "event_id").alias("seen"), "value")
    half = events.where("seen.event_id % 2 = 0")
    history = feeds.upsert(feeds.upsert(None, half, ("event_type",), "seen", 10_000), events, ("event_type",), "seen", 72)
    return history.select("event_type", F.unix_timestamp("hour").alias("hour"), F.round("value", 6).alias("value"))


@query("""WITH h AS (SELECT DISTINCT event_type, date_trunc('hour', ts) AS hour FROM events), l AS (SELECT max(hour) AS last FROM h), w AS (SELECT DISTINCT event_type, unnest(generate_series(last - INTERVAL 71 HOUR, last, INTERVAL 1 HOUR)) AS hour FROM h, l)
    SELECT event_type, epoch(hour)::BIGINT AS hour FROM w ANTI JOIN h USING (event_type, hour)""")
def missing_hours(spark, sf_dir):
    """Hours of the last 72 that an event type has no value for, to be asked for again."""
    events = _events(spark, sf_dir).select("event_type", F.date_trunc("hour", "at").alias("hour"), F.lit(1.0).alias("value")).distinct()
    return feeds.missing_hours(events, ("event_type",)).select("event_type", F.unix_timestamp("hour").alias("hour"))


@query("""SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 3600 SECOND) <= 2 AS allowed FROM events a""")
def rate_limit(spark, sf_dir):
    return feeds.rate_limited(_events(spark, sf_dir), "user_id", "at", 2, 3600).select("event_id", "allowed")


@query("""SELECT CASE WHEN s % 3 = 0 THEN 'a' WHEN s % 3 = 1 THEN 'b' ELSE 'c' END AS source, bool_or(s % 3 > 0) AS stale FROM (SELECT s_suppkey AS s FROM supplier) GROUP BY 1""")
def freshness(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    name = F.when(F.col("s_suppkey") % 3 == 0, "a").when(F.col("s_suppkey") % 3 == 1, "b").otherwise("c")
    runs = supplier.select(
        F.col("s_suppkey").cast("string").alias("run"), name.alias("source"), F.lit("succeeded").alias("status"), F.timestamp_seconds("s_suppkey").alias("started"), F.timestamp_seconds("s_suppkey").alias("finished"), F.lit("").alias("fingerprint"), F.lit(0).cast("long").alias("rows")
    )
    last = ingest.latest_succeeded(runs)
    derived = last.select("source", F.when(F.col("source") == "a", F.col("run")).otherwise(F.lit("old")).alias("run")).where("source <> 'c'")
    return ingest.stale(runs, derived)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 100 < 60 THEN round(139 + (s_suppkey % 100) / 60.0 + 12.345 / 3600, 9) END AS lon FROM supplier""")
def degrees_minutes_seconds(spark, sf_dir):
    raw = F.concat(F.lit("139"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("12345"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(ingest.dms_degrees(raw), 9).alias("lon"))


@query("""SELECT s_suppkey FROM supplier WHERE s_nationkey % 4 = 0 OR (s_nationkey % 4 = 1 AND s_suppkey % 2 = 0)""")
def tag_rules(spark, sf_dir):
    n = F.col("s_nationkey") % 4
    tags = F.create_map(F.lit("highway"), F.when(n == 0, "cycleway").when(n == 1, "path").otherwise("motorway"), F.lit("bicycle"), F.when(F.col("s_suppkey") % 2 == 0, "yes"))
    rules = [{"highway": ["cycleway"]}, {"highway": ["path"], "bicycle": ["*"]}]
    return table(spark, sf_dir, "supplier").where(ingest.tag_rules(tags, rules)).select("s_suppkey")


QUERIES, ORACLES = query.queries, query.oracles
