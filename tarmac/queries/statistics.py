"""Aggregations: counts, shares, weighted means, quantiles and histograms, route totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import aggregates
from tarmac.operators.windows import first_by
from tarmac.plans.materials import coverage, exclusion
from tarmac.queries.registry import Registry, table

query = Registry()


@query("""SELECT position, material, present, total, 1 - present / total AS missing_ratio FROM (SELECT count(*) AS total, count(nullif(l_discount, 0)) AS a, count(nullif(l_tax, 0)) AS b, count(CASE WHEN l_quantity > 25 THEN 1 END) AS c FROM lineitem),
    LATERAL (VALUES (0, 'discount', a), (1, 'tax', b), (2, 'large', c)) v(position, material, present)""")
def material_coverage(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"), F.when(F.col("l_quantity") > 25, 1).alias("large"))
    return coverage(lines, ["discount", "tax", "large"]).select("position", "material", "present", "total", "missing_ratio")


@query("""SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'N') AS new FROM lineitem GROUP BY 1""")
def conditional_pivot(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["R", "A", "N"]).count().fillna(0)
    return wide.withColumnsRenamed({"R": "returned", "A": "accepted", "N": "new"})


@query("""SELECT l_partkey, sum(CASE WHEN l_returnflag = 'R' THEN 3.0 ELSE 1.0 END)::DOUBLE AS weighted FROM lineitem GROUP BY 1""")
def weighted_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", 3.0).otherwise(1.0)).alias("weighted"))


@query("""SELECT o_custkey, sum(n)::BIGINT AS lines, sum(q)::DOUBLE AS quantity FROM (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def rollup_sum(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return per.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum("n").alias("lines"), F.sum("q").alias("quantity"))


@query("""SELECT l_suppkey, round(sum(CASE WHEN l_discount > 0 THEN l_discount * l_quantity END) / sum(CASE WHEN l_discount > 0 THEN l_quantity END), 6) AS mean FROM lineitem GROUP BY 1""")
def weighted_mean(spark, sf_dir):
    value = F.when(F.col("l_discount") > 0, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(aggregates.weighted_mean(value, F.col("l_quantity")), 6).alias("mean"))


@query("""SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1""")
def first_last_by(spark, sf_dir):
    order = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", order).alias("first"), F.max_by("o_orderkey", order).alias("last"))


@query("""SELECT l_returnflag, count(DISTINCT (l_partkey, l_suppkey)) AS pairs, bool_or(l_quantity > 49) AS any_large, max(l_tax) AS top FROM lineitem GROUP BY 1""")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct(F.struct("l_partkey", "l_suppkey")).alias("pairs"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"), F.max("l_tax").alias("top"))


@query("""SELECT node, count(*) AS branches FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1""")
def branch_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("node")).groupBy("node").agg(F.count("*").alias("branches"))


@query("""SELECT l_orderkey, sum(share)::DOUBLE AS n FROM (SELECT l_orderkey, l_suppkey, CASE count(*) FILTER (l_quantity > 40) WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END AS share FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def place_shares(spark, sf_dir):
    each = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count_if(F.col("l_quantity") > 40).alias("ends"))
    return each.groupBy("l_orderkey").agg(F.sum(aggregates.place_share(F.col("ends"))).alias("n"))


@query("""SELECT user_id, view_percent, click_percent FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') * 100.0 / count(*) AS view_percent, count(*) FILTER (event_type = 'click') * 100.0 / count(*) AS click_percent
    FROM events WHERE event_type <> 'error' GROUP BY 1) WHERE n >= 5""")
def percent_shares(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return aggregates.percent_shares(counts, "user_id", "event_type", "n", ["view", "click"], ["error"], 5)


@query("""SELECT l_suppkey, l_returnflag, round(w / sum(w) OVER (PARTITION BY l_suppkey), 4) AS share, (row_number() OVER (PARTITION BY l_suppkey ORDER BY w DESC, l_returnflag))::INT AS place FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2)""")
def category_length_share(spark, sf_dir):
    return aggregates.category_shares(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", "l_quantity")


_STEPS = """steps AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM (SELECT l_returnflag, l_extendedprice, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2))"""


@query(f"""WITH {_STEPS} SELECT l_returnflag, min(l_extendedprice) FILTER (upto >= total * 0.1) AS q100, min(l_extendedprice) FILTER (upto >= total * 0.5) AS q500, min(l_extendedprice) FILTER (upto >= total * 0.99) AS q990 FROM steps GROUP BY 1""")
def weighted_quantiles(spark, sf_dir):
    return aggregates.weighted_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity", [0.1, 0.5, 0.99])


@query(f"""WITH {_STEPS}, edges AS (SELECT l_returnflag, (min(l_extendedprice) FILTER (upto >= total * 0.99) * 1.2 - least(0, min(l_extendedprice))) / 60 AS width, least(0, min(l_extendedprice)) AS low FROM steps GROUP BY 1)
    SELECT l_returnflag, bin, round(sum(coalesce(q, 0)), 4) AS w FROM (SELECT l_returnflag, unnest(range(0, 60))::INT AS bin FROM edges) LEFT JOIN (SELECT l_returnflag, greatest(0, least(59, floor((l_extendedprice - low) / width)))::INT AS bin, l_quantity AS q FROM lineitem JOIN edges USING (l_returnflag)) USING (l_returnflag, bin) GROUP BY 1, 2""")
def weighted_histogram(spark, sf_dir):
    return aggregates.weighted_histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", "bin", F.round("w", 4).alias("w"))


@query("""WITH s AS (SELECT l_linestatus, l_discount, sum(w) OVER (PARTITION BY l_linestatus ORDER BY l_discount) AS upto, sum(w) OVER (PARTITION BY l_linestatus) AS total FROM (SELECT l_linestatus, l_discount, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2))
    SELECT l_linestatus, min(l_discount) FILTER (upto >= total * 0.5) AS q500, round(sum(CASE WHEN l_discount = 0 THEN upto ELSE 0 END) / max(total), 6) AS zero_share FROM s GROUP BY 1""")
def spread(spark, sf_dir):
    out = aggregates.spread(table(spark, sf_dir, "lineitem"), ["l_linestatus"], "l_discount", "l_quantity", [0.5])
    return out.select("l_linestatus", "q500", F.round("zero_share", 6).alias("zero_share"))


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM lineitem GROUP BY 1""")
def ordered_array_agg(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("rows"))
    return own.select("l_orderkey", F.concat_ws(",", F.col("rows.l_partkey").cast("array<string>")).alias("parts"))


@query("""SELECT l_suppkey, round(avg(v) FILTER (k = 'A'), 6) AS a, round(avg(v) FILTER (k = 'R'), 6) AS r FROM (SELECT l_suppkey, l_returnflag AS k, sum(l_discount * l_quantity) / sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def map_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.create_map("l_returnflag", "l_discount").alias("values"))
    merged = aggregates.merge_maps(rows, ["l_suppkey"], "values", "l_quantity")
    return merged.select("l_suppkey", *[F.round(F.try_element_at("values", F.lit(k)), 6).alias(k.lower()) for k in ("A", "R")])


@query("""SELECT c_nationkey, median(n) AS median, max(n) - min(n) AS range FROM (SELECT c_nationkey, c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1""")
def median_range(spark, sf_dir):
    """Medians over small whole numbers: the buffer holds one entry for each different count."""
    per = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("c_nationkey").agg(F.percentile("n", 0.5).alias("median"), (F.max("n") - F.min("n")).alias("range"))


@query("""WITH RECURSIVE numbered AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INT AS n, l_quantity AS d FROM lineitem),
    walk AS (SELECT l_orderkey, n, 0 AS bin, CASE WHEN d >= 60 THEN 0 ELSE d END AS held, (d >= 60)::INT AS step FROM numbered WHERE n = 1
      UNION ALL SELECT b.l_orderkey, b.n, a.bin + a.step, CASE WHEN a.held + b.d >= 60 THEN 0 ELSE a.held + b.d END, (a.held + b.d >= 60)::INT FROM walk a JOIN numbered b ON b.l_orderkey = a.l_orderkey AND b.n = a.n + 1)
    SELECT l_orderkey, n, bin FROM walk""")
def distance_bins(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(by).alias("n"), F.col("l_quantity").alias("d"))
    return aggregates.distance_bins(rows, ["l_orderkey"], "n", "d", 60.0).select("l_orderkey", "n", "bin")


@query("""SELECT l_orderkey, round(sum(l) FILTER (hit) / sum(l), 6) AS overlap FROM (SELECT l_orderkey, x, y, max(l_quantity) AS l, bool_or(c.x2 IS NOT NULL) AS hit FROM (SELECT *, least(l_partkey, l_suppkey) AS x, greatest(l_partkey, l_suppkey) AS y FROM lineitem)
    LEFT JOIN (SELECT DISTINCT least(l_partkey, l_suppkey) AS x2, greatest(l_partkey, l_suppkey) AS y2 FROM lineitem WHERE l_orderkey % 10 = 0) c ON x = x2 AND y = y2 GROUP BY 1, 2, 3) GROUP BY 1 HAVING sum(l) FILTER (hit) > 0""")
def overlap_ratio(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    out = aggregates.overlap_ratio(lines, lines.where("l_orderkey % 10 = 0"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    return out.where("overlap > 0").select("l_orderkey", F.round("overlap", 6).alias("overlap"))


@query("""SELECT o_custkey, round(1 - sum(o) / sum(a), 6) AS retraced FROM (SELECT o_custkey, l_suppkey, max(l_quantity) AS o, sum(l_quantity) AS a FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY 1""")
def retraced_share(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.lit(0).cast("long").alias("a"), F.col("l_suppkey").alias("b"), "l_quantity")
    out = aggregates.retraced_share(rows, "o_custkey", "a", "b", "l_quantity")
    return out.select("o_custkey", F.round("retraced", 6).alias("retraced"))


@query("""SELECT round(sum(CASE WHEN l_discount <= 0 THEN n ELSE 0 END) / sum(n), 6) AS low_share, round(sum(CASE WHEN l_discount >= 0.1 THEN n ELSE 0 END) / sum(n), 6) AS high_share, round(max(n) / sum(n), 6) AS mode_share FROM (SELECT l_discount, count(*) AS n FROM lineitem GROUP BY 1)""")
def saturation(spark, sf_dir):
    out = aggregates.saturation(table(spark, sf_dir, "lineitem"), "l_discount", 0.0, 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""SELECT DISTINCT l_shipdate::DATE::VARCHAR AS day FROM lineitem""")
def distinct_values(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("day")).distinct()


@query("""SELECT o_orderkey, (o_orderstatus = 'F' OR abs(g) > 3) AS excluded FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 - 4 END AS g FROM orders) WHERE (o_orderstatus = 'F' OR abs(g) > 3) IS NOT NULL
    UNION ALL SELECT o_orderkey, false FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 9 - 4 END AS g FROM orders) WHERE (o_orderstatus = 'F' OR abs(g) > 3) IS NULL""")
def hard_filters(spark, sf_dir):
    gradient = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey") % 9 - 4)
    flags = {"closed": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    return table(spark, sf_dir, "orders").select("o_orderkey", exclusion(flags, {"closed": True, "urgent": False}, gradient, 3.0).alias("excluded"))


@query("""SELECT DISTINCT o_custkey AS node FROM orders WHERE o_orderstatus <> 'F'""")
def routable_nodes(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("node")).distinct()


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), (c_mktsegment), ())""")
def grouping_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    sets = [[F.col("r_name"), F.col("n_name")], [F.col("r_name")], [F.col("c_mktsegment")], []]
    return rows.groupingSets(sets, "r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query()
def approximate_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("""SELECT o_orderpriority, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def latest_run(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return first_by(runs, ["o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderpriority", F.col("o_orderkey").alias("latest"))


QUERIES, ORACLES = query.queries, query.oracles
