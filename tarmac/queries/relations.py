"""Joins, set operations, range and spatial joins, name linking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import places, spatial
from tarmac.operators.windows import first_by
from tarmac.plans.materials import Catalog, ValueTable
from tarmac.queries.registry import Registry, table
from tarmac.queries.scalar import _DISTANCE, place

query = Registry()


@query("""SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 200000""")
def inner_joins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000")
    both = orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return both.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("""SELECT p_partkey, sum(l_quantity) AS quantity, avg(p_size)::DOUBLE AS size FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def demand_driven_join(spark, sf_dir):
    """Three value tables, of which only the wanted one is joined."""
    lines = table(spark, sf_dir, "lineitem")
    sums = lambda c: lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(c).alias("v"))
    catalog = Catalog({t: ValueTable(sums(c), ("p_partkey",)) for t, c in (("amounts", "l_quantity"), ("taxes", "l_tax"), ("discounts", "l_discount"))})
    catalog.add("quantity", F.col("amounts.v"), "amounts")
    catalog.add("tax", F.col("taxes.v"), "taxes")
    catalog.add("discount", F.col("discounts.v"), "discounts")
    catalog.add("size", F.col("p_size").cast("double"))
    return catalog.read(table(spark, sf_dir, "part"), ["quantity", "size"]).select("p_partkey", "quantity", "size")


@query("""SELECT c_custkey, coalesce(b.n, a.n) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON b.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, -count(*) AS n FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey""")
def conditional_lateral(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    segment = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("a"))
    whole = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg((-F.count("*")).alias("b"))
    joined = table(spark, sf_dir, "customer").join(segment, "c_custkey", "left").join(whole, "c_custkey", "left")
    return joined.select("c_custkey", F.when(F.col("a").isNotNull(), F.col("a")).otherwise(F.col("b")).alias("n"))


@query("""SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n = 1""")
def lateral_lookup(spark, sf_dir):
    """The dearest order of each customer's key, which counts once however many rows have it."""
    for name in ("customer", "orders"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"_lateral_{name}")
    return spark.sql("SELECT c_custkey, o_orderkey FROM (SELECT DISTINCT c_custkey FROM _lateral_customer), LATERAL (SELECT o_orderkey FROM _lateral_orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey NULLS LAST LIMIT 1)")


@query("""SELECT p_partkey AS k, a, b FROM (SELECT p_partkey, p_size AS a FROM part WHERE p_size < 30) FULL JOIN (SELECT l_partkey AS p_partkey, count(*) AS b FROM lineitem WHERE l_quantity > 45 GROUP BY 1) USING (p_partkey)""")
def full_outer_join(spark, sf_dir):
    left = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("a"))
    right = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("b"))
    return left.join(right, "k", "full")


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def semi_anti_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    left = table(spark, sf_dir, "customer").join(orders.where("o_totalprice > 450000"), "c_custkey", "left_anti")
    urgent = orders.where("o_orderpriority = '1-URGENT'").select("c_custkey").distinct().withColumn("urgent", F.lit(True))
    return left.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("""SELECT r_name, orders, customers FROM region, (SELECT count(*) AS orders FROM orders), (SELECT count(*) AS customers FROM customer)""")
def cross_scalars(spark, sf_dir):
    """One-row aggregates beside five regions."""
    out = table(spark, sf_dir, "region").select("r_name")
    for name in ("orders", "customer"):
        out = out.crossJoin(F.broadcast(table(spark, sf_dir, name).agg(F.count("*").alias(name.rstrip("s") + "s"))))
    return out


@query("""SELECT event_id, hour FROM (SELECT event_id, epoch(date_trunc('hour', ts + INTERVAL 30 MINUTE))::BIGINT AS hour FROM events)""")
def asof_nearest_hour(spark, sf_dir):
    """Each event with its nearest hour of the dense spine between first and last, by an equi-join on the rounded hour."""
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    ends = events.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    spine = ends.select(F.explode(F.sequence(F.floor(F.col("a") / 3600) * 3600, (F.ceil(F.col("b") / 3600) + 1) * 3600, F.lit(3600).cast("long"))).alias("hour"))
    return events.withColumn("hour", F.floor(F.col("at") / 3600 + 0.5) * 3600).join(spine, "hour").select("event_id", "hour")


@query("""SELECT o_orderkey, l_linenumber, part_rank FROM (SELECT o_orderkey, l_linenumber, p_size, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 300000)
    JOIN (SELECT range * 10 AS lo, range * 10 + 9 AS hi, range AS part_rank FROM range(0, 6)) ON l_quantity BETWEEN lo AND hi""")
def range_join(spark, sf_dir):
    """Ranges of a regular width are met by their number, then checked."""
    ranges = spark.range(6).select((F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 9).alias("hi"), F.col("id").alias("part_rank"))
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 300000")
    rows = orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    met = rows.withColumn("_slot", F.floor(F.col("l_quantity") / 10)).join(ranges, F.col("_slot") == F.col("part_rank"))
    return met.where(F.col("l_quantity").between(F.col("lo"), F.col("hi"))).select("o_orderkey", "l_linenumber", "part_rank")


@query("""SELECT p_partkey, min_by(kind, priority) AS kind FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS token FROM part)
    JOIN (VALUES ('steel', 'metal', 1), ('brass', 'metal', 2), ('tin', 'light', 3), ('small', 'size', 4), ('large', 'size', 5), ('economy', 'class', 6)) r(token, kind, priority) USING (token) GROUP BY 1""")
def rule_table_join(spark, sf_dir):
    rules = spark.createDataFrame([("steel", "metal", 1), ("brass", "metal", 2), ("tin", "light", 3), ("small", "size", 4), ("large", "size", 5), ("economy", "class", 6)], "token string, kind string, priority int")
    tokens = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split(F.lower("p_type"), " ")).alias("token"))
    return tokens.join(F.broadcast(rules), "token").groupBy("p_partkey").agg(F.min_by("kind", "priority").alias("kind"))  # six rows


_POINTS = """(SELECT c_custkey, 139 + c_custkey * 37 % 1000 / 1000.0 AS a0, 35 + c_custkey * 61 % 700 / 1000.0 AS b0 FROM customer) c,
    (SELECT s_suppkey, 139 + (s_suppkey + 3) * 37 % 1000 / 1000.0 AS a1, 35 + (s_suppkey + 3) * 61 % 700 / 1000.0 AS b1 FROM supplier) s"""
_PAIR_DISTANCE = _DISTANCE.format(a0="a0", b0="b0", a1="a1", b1="b1")


def _points(spark, sf_dir):
    lon, lat = place("c_custkey")
    left = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    shifted = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") + 3).alias("k"))
    lon, lat = place("k")
    return left, shifted.select("s_suppkey", lon.alias("lon"), lat.alias("lat"))


@query(f"SELECT c_custkey, min_by(s_suppkey, (round(d, 6), s_suppkey)) AS s_suppkey FROM (SELECT c_custkey, s_suppkey, {_PAIR_DISTANCE} AS d FROM {_POINTS}) WHERE d <= 5000 GROUP BY 1")
def nearest_within(spark, sf_dir):
    left, right = _points(spark, sf_dir)
    return spatial.nearest(left, right, "c_custkey", "s_suppkey", 5000).select("c_custkey", "s_suppkey")


@query(f"SELECT c_custkey, s_suppkey FROM {_POINTS} WHERE {_PAIR_DISTANCE} <= 3000")
def within_distance(spark, sf_dir):
    left, right = _points(spark, sf_dir)
    return spatial.within(left, right, 3000).select("c_custkey", "s_suppkey")


@query(f"SELECT DISTINCT c_custkey FROM {_POINTS} WHERE {_PAIR_DISTANCE} <= 2500")
def near_any(spark, sf_dir):
    left, right = _points(spark, sf_dir)
    return spatial.near_any(left, right, "c_custkey", 2500).select("c_custkey")


@query("""SELECT c_custkey, min(n_nationkey) AS n_nationkey FROM (SELECT c_custkey, 139 + c_custkey * 37 % 1000 / 1000.0 AS x, 35 + c_custkey * 61 % 700 / 1000.0 AS y FROM customer),
    (SELECT n_nationkey, 139.0005 + n_nationkey * 37 % 1000 / 1000.0 AS w, 35.0005 + n_nationkey * 61 % 700 / 1000.0 AS s FROM nation) WHERE x > w AND x < w + 0.1 AND y > s AND y < s + 0.1 AND (x - w) + (y - s) < 0.15 GROUP BY 1""")
def polygon_containment(spark, sf_dir):
    lon, lat = place("n_nationkey")
    corner = lambda dx, dy: F.struct((lon + dx + 0.0005).alias("lon"), (lat + dy + 0.0005).alias("lat"))
    ring = F.array(corner(0.0, 0.0), corner(0.1, 0.0), corner(0.1, 0.05), corner(0.05, 0.1), corner(0.0, 0.1))
    areas = table(spark, sf_dir, "nation").select("n_nationkey", ring.alias("ring"))
    return spatial.containing(_points(spark, sf_dir)[0], areas, "c_custkey", "n_nationkey")


@query("""SELECT c_custkey, 10 * (floor((139 + c_custkey * 37 % 1000 / 1000.0 + 180) / 360 * 1024)::INT % 5) + floor((1 - ln(tan(radians(35 + c_custkey * 61 % 700 / 1000.0)) + 1 / cos(radians(35 + c_custkey * 61 % 700 / 1000.0))) / pi()) / 2 * 1024)::INT % 7 AS value FROM customer""")
def raster_lookup(spark, sf_dir):
    """One value for each tile, put in all its pixels, read back at points."""
    tiles = spark.range(900, 915).select(F.col("id").cast("int").alias("x")).crossJoin(spark.range(395, 412).select(F.col("id").cast("int").alias("y")))
    tiles = tiles.withColumn("pixels", F.array_repeat((F.col("x") % 5 * 10 + F.col("y") % 7).cast("int"), 16))
    return spatial.raster_values(_points(spark, sf_dir)[0], tiles, 10, key="c_custkey", size=4).select("c_custkey", "value")


@query("""SELECT a.o_orderkey, b.o_orderkey AS partner FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate::DATE = b.o_orderdate::DATE""")
def self_join(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    other = own.withColumnRenamed("o_orderkey", "partner")
    return own.join(other, ["o_custkey", "day"]).where("o_orderkey < partner").select("o_orderkey", "partner")


@query("""SELECT left_id, right_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY rank, -length(r), right_id) AS n FROM (
    SELECT c_custkey AS left_id, p AS right_id, CASE WHEN l = r THEN 0 WHEN starts_with(l, r) THEN 1 ELSE 2 END AS rank, r FROM
    (SELECT c_custkey, c_custkey::VARCHAR AS l FROM customer), (SELECT DISTINCT p_partkey AS p, p_partkey::VARCHAR AS r FROM part) WHERE starts_with(l, r) OR ends_with(l, r))) WHERE n = 1""")
def suffix_link(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_custkey").cast("string").alias("name"))
    right = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("right_id"), F.col("p_partkey").cast("string").alias("name"))
    return places.link_names(left, right)


@query("""SELECT area, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY kind, length(key), key) AS n FROM (
    SELECT c_custkey AS area, 1 AS kind, c_name AS key FROM customer WHERE starts_with(c_name, (SELECT min(c_name)[:-2] FROM customer)))) WHERE n = 1 ORDER BY kind, length(key), key, area LIMIT 10""")
def prefix_search(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("area"), F.col("c_name").alias("key"))
    asked = keys.agg(F.min("key")).first()[0][:-1]
    return places.search(keys, asked)


@query("""WITH RECURSIVE tree AS (SELECT 'c' || c_custkey AS area, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region),
    up AS (SELECT area, area AS ancestor, 0 AS up FROM tree UNION ALL SELECT u.area, t.parent, u.up + 1 FROM up u JOIN tree t ON t.area = u.ancestor WHERE t.parent IS NOT NULL) SELECT * FROM up""")
def recursive_chain(spark, sf_dir):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("area"), key("n", "c_nationkey").alias("parent"))
    tree = tree.unionByName(table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("area"), key("r", "n_regionkey").alias("parent")))
    tree = tree.unionByName(table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("area"), F.lit(None).cast("string").alias("parent")))
    return places.ancestors(tree)


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("""(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT p_partkey FROM part WHERE p_size < 25) EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.09""")
def intersect_except(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return lines.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).intersect(parts).subtract(lines.where("l_discount > 0.09").select("l_partkey"))


@query("""SELECT o_custkey, min_by(o_orderkey, (-o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1""")
def distinct_on(spark, sf_dir):
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""")
def top_ten(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("""SELECT s_suppkey, rank FROM (SELECT s_suppkey, rank() OVER (ORDER BY s_nationkey) AS rank FROM supplier) WHERE rank = 1""")
def rank_keep_ties(spark, sf_dir):
    """The smallest value is found by aggregation, so no row but its ties meets in one place."""
    supplier = table(spark, sf_dir, "supplier")
    least = supplier.agg(F.min("s_nationkey").alias("s_nationkey"))
    return supplier.join(F.broadcast(least), "s_nationkey").select("s_suppkey", F.lit(1).alias("rank"))


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17")
def way_lookup(spark, sf_dir):
    """One row by its key; the filter reaches the scan."""
    return table(spark, sf_dir, "part").where("p_partkey = 17").select("p_partkey", "p_name", "p_brand")


@query()
def sample_preview(spark, sf_dir):
    """A seeded sample with a row limit, as previews ask for."""
    return table(spark, sf_dir, "lineitem").sample(0.02, seed=7).limit(20_000).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""SELECT ordinal, o_orderkey, o_totalprice FROM (SELECT (row_number() OVER (ORDER BY k)) - 1 AS ordinal, k AS o_orderkey FROM (SELECT range * 37 AS k FROM range(0, 200))) LEFT JOIN orders USING (o_orderkey)""")
def keyed_scan(spark, sf_dir):
    """An array of keys, looked up in its order; missing keys stay."""
    keys = spark.range(1).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i * 37).cast("long"))).alias("ordinal", "o_orderkey"))
    return keys.join(table(spark, sf_dir, "orders"), "o_orderkey", "left").select(F.col("ordinal").cast("long").alias("ordinal"), "o_orderkey", "o_totalprice")


@query("""SELECT s_suppkey, avg(139 + s_suppkey * 37 % 1000 / 1000.0) OVER (PARTITION BY s_nationkey) AS lon, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier""")
def partition_aggregates(spark, sf_dir):
    by = Window.partitionBy("s_nationkey")
    lon, _ = place("s_suppkey")
    return table(spark, sf_dir, "supplier").withColumn("x", lon).select("s_suppkey", F.avg("x").over(by).alias("lon"), F.min("s_suppkey").over(by).alias("first"))


QUERIES, ORACLES = query.queries, query.oracles
