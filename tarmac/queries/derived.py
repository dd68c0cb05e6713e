"""Derivation chains and the relational part of the sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.functions import geo, text
from tarmac.operators import derive, lines, places, spatial
from tarmac.operators.aggregates import percent_shares, preview, weighted_mean
from tarmac.operators.windows import elevation_values
from tarmac.plans import catalog
from tarmac.queries.registry import Registry, table
from tarmac.queries.scalar import _DISTANCE, place
from tarmac.sources import views

query = Registry()

_XY = "139 + {k} * 37 % 1000 / 1000.0 AS lon, 35 + {k} * 61 % 700 / 1000.0 AS lat"
_TILE = "floor((lon + 180) / 360 * 1024)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)::INT AS y"
_STEP = _DISTANCE.format(a0="plon", b0="plat", a1="lon", b1="lat")


def _tiles(spark):
    """Two products of constant tiles: the better one has no value where x is odd, the other one none where y is a multiple of 5."""
    grid = spark.range(900, 915).select(F.col("id").cast("int").alias("x")).crossJoin(spark.range(395, 412).select(F.col("id").cast("int").alias("y")))
    better = grid.withColumn("pixels", F.array_repeat(F.when(F.col("x") % 2 == 0, F.col("x") * 3 + F.col("y") * 2.0), 16)).withColumn("product", F.lit(1))
    other = grid.withColumn("pixels", F.array_repeat(F.when(F.col("y") % 5 > 0, F.col("x") * 2 + F.col("y") * 4.0), 16)).withColumn("product", F.lit(2))
    return better.unionByName(other)


@query(f"""WITH v AS (SELECT l_orderkey AS edge, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS ord, {_XY.format(k="l_suppkey")}, l_orderkey % 5 = 0 AS st FROM lineitem), t AS (SELECT *, {_TILE} FROM v),
    e AS (SELECT *, CASE WHEN x % 2 = 0 THEN x * 3 + y * 2.0 WHEN y % 5 > 0 THEN x * 2 + y * 4.0 END AS elev FROM t), k AS (SELECT *, lag(ord) OVER w AS po, lag(elev) OVER w AS pe, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM e WHERE elev IS NOT NULL WINDOW w AS (PARTITION BY edge ORDER BY ord)),
    f AS (SELECT *, coalesce(ord = po + 1 AND {_STEP} > 0 AND abs(elev - pe) <= {_STEP} * 0.4, false) AS fine FROM k),
    g AS (SELECT edge, arg_min(elev, ord) AS a, arg_max(elev, ord) AS b, bool_or(st) AS st, coalesce(sum(elev - pe) FILTER (fine AND elev > pe), 0) AS up, coalesce(sum(pe - elev) FILTER (fine AND elev < pe), 0) AS down, count(*) FILTER (fine) AS n FROM f GROUP BY 1)
    SELECT edge, a AS start_elev, b AS end_elev, CASE WHEN st THEN greatest(b - a, 0) WHEN n > 0 THEN up END AS gain, CASE WHEN st THEN greatest(a - b, 0) WHEN n > 0 THEN down END AS loss FROM g""")
def derived_elevation(spark, sf_dir):
    """Vertices to tiles to pixels by product priority, then gains and losses of each edge."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lon, lat = place("l_suppkey")
    vertices = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), (F.row_number().over(by) - 1).alias("ord"), lon.alias("lon"), lat.alias("lat"), (F.col("l_orderkey") % 5 == 0).alias("on_structure"))
    vertices = vertices.withColumn("id", F.struct("edge", "ord"))
    known = spatial.raster_values(vertices, _tiles(spark), 10, "product", size=4).withColumnRenamed("value", "elev")
    return elevation_values(known, ["edge"]).select("edge", "start_elev", "end_elev", "gain", "loss")


_NEAR = _DISTANCE.format(a0="p.lon", b0="p.lat", a1="q.lon", b1="q.lat")


@query(f"""WITH p AS (SELECT s_suppkey, s_nationkey, {_XY.format(k="s_suppkey")} FROM supplier), q AS (SELECT c_custkey, c_nationkey % 4 AS class, {_XY.format(k="(c_custkey + 3)")} FROM customer), n AS (SELECT s_suppkey, class, count(DISTINCT c_custkey) AS n FROM p, q WHERE {_NEAR} <= 5000 GROUP BY 1, 2),
    s AS (SELECT s_suppkey, sum(n) AS valid, coalesce(sum(n) FILTER (class = 1), 0) * 100.0 / sum(n) AS a, coalesce(sum(n) FILTER (class = 2), 0) * 100.0 / sum(n) AS b FROM n WHERE class <> 0 GROUP BY 1 HAVING sum(n) >= 2)
    SELECT s_nationkey, round(sum(a * (1 + s_suppkey % 5)) / sum(1 + s_suppkey % 5), 6) AS wood, round(sum(b * (1 + s_suppkey % 5)) / sum(1 + s_suppkey % 5), 6) AS water FROM s JOIN supplier USING (s_suppkey) GROUP BY 1""")
def derived_landcover(spark, sf_dir):
    """Cells by class around segments, their percentages where enough are valid, and the length-weighted mean of each way."""
    lon, lat = place("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", lon.alias("lon"), lat.alias("lat"), (1.0 + F.col("s_suppkey") % 5).alias("km"))
    cells = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), (F.col("c_nationkey") % 4).alias("class"), (F.col("c_custkey") + 3).alias("k"))
    lon, lat = place("k")
    counts = spatial.zonal_counts(suppliers, cells.select("cell", "class", lon.alias("lon"), lat.alias("lat")), "s_suppkey", 5000)
    shares = percent_shares(counts, "s_suppkey", "class", "count", [1, 2], [0], 2)
    out = shares.join(suppliers, "s_suppkey").groupBy("s_nationkey").agg(*[weighted_mean(F.col(f"{i}_percent"), F.col("km")).alias(n) for i, n in ((1, "wood"), (2, "water"))])
    return out.select("s_nationkey", F.round("wood", 6).alias("wood"), F.round("water", 6).alias("water"))


_PIECE_M = """(SELECT sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) FROM (SELECT *, least(1.0, greatest(0.0, coalesce(-(ax * (bx - ax) + ay * (by_ - ay)) / nullif(pow(bx - ax, 2) + pow(by_ - ay, 2), 0), 0.0))) AS t FROM (
    SELECT ({a}.lon - {p}.lon) * k * cos(radians({p}.lat)) AS ax, ({a}.lat - {p}.lat) * k AS ay, ({b}.lon - {p}.lon) * k * cos(radians({p}.lat)) AS bx, ({b}.lat - {p}.lat) * k AS by_ FROM (SELECT radians(1.0) * 6371000.0 AS k))))"""
_BENT = "ln AS (SELECT s_suppkey, s_nationkey, lon, lat, {'lon': lon, 'lat': lat} AS p0, {'lon': lon + 0.011, 'lat': lat + 0.003} AS p1, {'lon': lon + 0.013, 'lat': lat + 0.012} AS p2 FROM (SELECT s_suppkey, s_nationkey, 139 + s_suppkey * 37 % 1000 / 1000.0 AS lon, 35 + s_suppkey * 61 % 700 / 1000.0 AS lat FROM supplier))"


def _bent(spark, sf_dir):
    lon, lat = place("s_suppkey")
    point = lambda x, y: F.struct((lon + x).alias("lon"), (lat + y).alias("lat"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.array(point(0.0, 0.0), point(0.011, 0.003), point(0.013, 0.012)).alias("points"))


@query(f"""WITH {_BENT}, tiles AS (SELECT DISTINCT floor((139 + c_custkey * 37 % 1000 / 1000.0) / 0.032)::BIGINT AS tx, floor((35 + c_custkey * 61 % 700 / 1000.0) / 0.032)::BIGINT AS ty FROM customer),
    px AS (SELECT px, py, {{'lon': (px + 0.5) * 0.002, 'lat': (py + 0.5) * 0.002}} AS c, (px * 3 + py * 5) % 4 AS class FROM (SELECT tx * 16 + i AS px, ty * 16 + j AS py FROM tiles, range(16) a(i), range(16) b(j))),
    near AS (SELECT s_suppkey, class, least({_PIECE_M.format(p="px.c", a="ln.p0", b="ln.p1")}, {_PIECE_M.format(p="px.c", a="ln.p1", b="ln.p2")}) AS d FROM ln JOIN px ON px.c.lon BETWEEN lon - 0.02 AND lon + 0.04 AND px.c.lat BETWEEN lat - 0.02 AND lat + 0.04),
    n AS (SELECT s_suppkey, class, count(*) AS n FROM near WHERE d > 250 AND d <= 900 AND class <> 0 GROUP BY 1, 2)
    SELECT s_suppkey, round(coalesce(sum(n) FILTER (class = 1), 0) * 100.0 / sum(n), 6) AS wood, round(coalesce(sum(n) FILTER (class = 2), 0) * 100.0 / sum(n), 6) AS water FROM n GROUP BY 1 HAVING sum(n) >= 10""")
def ring_landcover(spark, sf_dir):
    """Raster pixels by class in a ring of 250 to 900 metres along a bent line for each supplier."""
    lon, lat = place("c_custkey")
    tiles = table(spark, sf_dir, "customer").select(F.floor(lon / 0.032).alias("tx"), F.floor(lat / 0.032).alias("ty")).distinct()
    at = F.sequence(F.lit(0), F.lit(255))
    tiles = tiles.withColumn("pixels", F.transform(at, lambda i: (((F.col("tx") * 16 + i % 16) * 3 + (F.col("ty") * 16 + F.floor(i / 16)) * 5) % 4).cast("int")))
    counts = lines.ring_counts(_bent(spark, sf_dir), tiles, "s_suppkey", 250.0, 900.0, 0.002, 16)
    shares = percent_shares(counts, "s_suppkey", "class", "n", [1, 2], [0], 10)
    return shares.select("s_suppkey", F.round("1_percent", 6).alias("wood"), F.round("2_percent", 6).alias("water"))


@query(f"""WITH {_BENT}, acc AS (SELECT c_custkey, {{'lon': 139.0021 + c_custkey * 37 % 1000 / 1000.0, 'lat': 35.001 + c_custkey * 61 % 700 / 1000.0}} AS c, CASE WHEN c_custkey % 9 = 0 THEN 3.0 ELSE 1.0 END AS w FROM customer WHERE c_custkey % 4 < 3),
    near AS (SELECT c_custkey, w, s_suppkey, least({_PIECE_M.format(p="acc.c", a="ln.p0", b="ln.p1")}, {_PIECE_M.format(p="acc.c", a="ln.p1", b="ln.p2")}) AS d FROM acc, ln)
    SELECT s_suppkey, sum(w)::DOUBLE AS n FROM (SELECT c_custkey, any_value(w) AS w, min_by(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM near WHERE d <= 300 GROUP BY 1) GROUP BY 1""")
def accident_lines(spark, sf_dir):
    """Customers as accidents, three of four with a bicycle and one of nine deadly, at the nearest line within 300 metres."""
    lon, lat = place("c_custkey")
    key = F.col("c_custkey")
    accidents = table(spark, sf_dir, "customer").select(key.alias("accident"), (lon + 0.0021).alias("lon"), (lat + 0.001).alias("lat"), F.when(key % 4 < 3, "bicycle").otherwise("car").alias("party_a"), F.lit("car").alias("party_b"), F.when(key % 9 == 0, 1).otherwise(0).alias("deaths"))
    return derive.accident_counts(_bent(spark, sf_dir).withColumnRenamed("s_suppkey", "edge"), accidents, 300.0).withColumnRenamed("edge", "s_suppkey")


_BESIDE = """w AS (SELECT p_partkey AS way, 139 + (p_partkey // 2) * 37 % 1000 / 1000.0 AS lon, 35 + (p_partkey // 2) * 61 % 700 / 1000.0 + CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 5 * 0.00009 + 0.00001 ELSE 0 END AS lat,
        p_partkey % 2 = 1 AS turned, CASE WHEN p_partkey % 7 = 0 THEN 'both' WHEN p_partkey % 11 = 0 THEN 'backward' ELSE 'forward' END AS direction, CASE WHEN p_size % 4 = 0 THEN 'primary' ELSE 'residential' END AS highway,
        p_partkey % 13 = 0 AS tagged, CASE WHEN p_partkey % 3 > 0 THEN 'n' || (p_partkey // 2) % 3 END AS ident FROM part)"""


@query(f"""WITH {_BESIDE}, one AS (SELECT *, ((CASE WHEN turned THEN 270 ELSE 90 END) + CASE WHEN direction = 'backward' THEN 180 ELSE 0 END) % 360 AS deg, {{'lon': lon, 'lat': lat}} AS a, {{'lon': lon + 0.0009, 'lat': lat}} AS b FROM w WHERE direction <> 'both'),
    pairs AS (SELECT x.way, x.ident AS i, y.ident AS j, x.highway AS g, y.highway AS h, x.a AS xa, x.b AS xb, y.a AS ya, y.b AS yb FROM one x JOIN one y ON x.way <> y.way AND x.deg <> y.deg AND abs(x.lat - y.lat) < 0.001 AND abs(x.lon - y.lon) < 0.003),
    d AS (SELECT *, least({", ".join(_PIECE_M.format(p=f"pairs.{p}", a=f"pairs.{a}", b=f"pairs.{b}") for p, a, b in (("xa", "ya", "yb"), ("xb", "ya", "yb"), ("ya", "xa", "xb"), ("yb", "xa", "xb")))}) AS m FROM pairs),
    spots AS (SELECT pairs.*, f, {{'lon': xa.lon + (xb.lon - xa.lon) * f, 'lat': xa.lat}} AS c FROM pairs, (VALUES (0.05), (0.25), (0.5), (0.75), (0.95)) v(f) WHERE g = h AND coalesce(i = j, true)),
    hits AS (SELECT way, f FROM spots WHERE {_PIECE_M.format(p="spots.c", a="spots.ya", b="spots.yb")} <= 15)
    SELECT way, coalesce(direction <> 'both' AND (tagged OR way IN (SELECT way FROM d WHERE i = j AND m <= 40) OR way IN (SELECT way FROM hits GROUP BY way HAVING count(DISTINCT f) = 5)), false) AS divided FROM w""")
def divided_ways(spark, sf_dir):
    """Parts as short roads, every second one beside another; by tag, by name, and by the road alongside."""
    key = F.col("p_partkey")
    half = F.floor(key / 2)
    lon, lat = 139 + half * 37 % 1000 / 1000.0, 35 + half * 61 % 700 / 1000.0 + F.when(key % 2 == 1, key % 5 * 0.00009 + 0.00001).otherwise(0.0)
    west, east = F.struct(lon.alias("lon"), lat.alias("lat")), F.struct((lon + 0.0009).alias("lon"), lat.alias("lat"))
    ways = table(spark, sf_dir, "part").select(
        key.alias("way"), F.when(key % 2 == 1, F.array(east, west)).otherwise(F.array(west, east)).alias("points"), F.when(key % 7 == 0, "both").when(key % 11 == 0, "backward").otherwise("forward").alias("direction"),
        F.when(F.col("p_size") % 4 == 0, "primary").otherwise("residential").alias("highway"), F.when(key % 13 == 0, " Dual ").alias("carriageway"), F.lit(" ").alias("ref"), F.when(key % 3 > 0, F.concat(F.lit("n"), (half % 3).cast("string"))).alias("name"),
    )
    return lines.divided(ways)


@query(f"""WITH RECURSIVE c AS (SELECT 'c' || c_custkey AS area, 'n' || c_nationkey AS parent, {_XY.format(k="c_custkey")} FROM customer), n AS (SELECT 'n' || n_nationkey AS area, 'r' || n_regionkey AS parent, 100.0 AS lon, 0.0 AS lat FROM nation WHERE n_nationkey % 2 = 0),
    made AS (SELECT 'n' || n_nationkey AS area, 'r' || n_regionkey AS parent, avg(lon) AS lon, avg(lat) AS lat FROM c JOIN nation ON parent = 'n' || n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY 1, 2),
    every AS (SELECT * FROM c UNION ALL SELECT * FROM n UNION ALL SELECT * FROM made UNION ALL SELECT 'r' || r_regionkey, NULL, 100.0, 0.0 FROM region),
    up AS (SELECT area, parent FROM every WHERE lon BETWEEN 139.1 AND 139.4 AND lat BETWEEN 35.1 AND 35.5 UNION SELECT e.area, e.parent FROM up JOIN every e ON e.area = up.parent)
    SELECT area, parent, round(lon, 6) AS lon, round(lat, 6) AS lat FROM every WHERE area IN (SELECT area FROM up)""")
def address_tree(spark, sf_dir):
    """Areas in a box with all above them; parents without a row stand in the middle of their children."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    lon, lat = place("c_custkey")
    far = [F.lit(100.0).alias("lon"), F.lit(0.0).alias("lat")]
    nations = table(spark, sf_dir, "nation").select("n_nationkey", key("n", "n_nationkey").alias("area"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    areas = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("area"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), lon.alias("lon"), lat.alias("lat"))
    areas = areas.unionByName(nations.where("n_nationkey % 2 = 0").select("area", "parent", "name", *far))
    areas = areas.unionByName(table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("area"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), *far))
    out = places.in_range(places.with_missing_parents(areas, nations), (139.1, 35.1, 139.4, 35.5))
    return out.select("area", "parent", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(f"""WITH w AS (SELECT o_orderkey AS way, o_orderkey % 50 = 25 AS area, l_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'), n AS (SELECT p_partkey AS node, p_size, {_XY.format(k="p_partkey")} FROM part), v AS (SELECT DISTINCT node FROM w WHERE NOT area)
    SELECT node, 'vertex' AS kind FROM n JOIN v USING (node) UNION ALL SELECT node, 'supply' FROM n WHERE p_size = 7 AND node NOT IN (SELECT node FROM v) UNION ALL SELECT DISTINCT -way, 'area' FROM w WHERE area""")
def network_nodes(spark, sf_dir):
    """Vertices of accepted ways, places of supply by themselves, and middles of ways that are places."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.col("o_orderkey") == F.col("l_orderkey"))
    ways = lines.groupBy(F.col("o_orderkey").alias("way")).agg(F.collect_list("l_partkey").alias("node_ids")).withColumn("area", F.col("way") % 50 == 25)
    lon, lat = place("p_partkey")
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size", lon.alias("lon"), lat.alias("lat"))
    return views.network_nodes(ways, nodes, F.col("p_size") == 7).select("node", "kind")


@query("""SELECT s_nationkey % 2 AS region, state, count(*) AS count FROM (SELECT s_nationkey, CASE WHEN s_suppkey % 100 >= 60 THEN 'skipped' WHEN 139 + (s_suppkey % 100) / 60.0 + 12.345 / 3600 <= 139.5 THEN 'kept' ELSE 'outside' END AS state FROM supplier) GROUP BY 1, 2""")
def accident_states(spark, sf_dir):
    """Positions in degrees, minutes and seconds: kept, outside the box, or unreadable, each counted."""
    raw = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 2).alias("region"), F.concat(F.lit("139"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("12345")).alias("longitude"), F.lit("354012000").alias("latitude"))
    return views.tallies(views.accident_rows(raw, (139.0, 35.0, 139.5, 36.0)), ["region"])


@query("""SELECT DISTINCT c_nationkey AS prefecture FROM customer WHERE 139 + c_custkey * 37 % 1000 / 1000.0 BETWEEN 139.1 AND 139.12 AND 35 + c_custkey * 61 % 700 / 1000.0 BETWEEN 35.1 AND 35.4""")
def prefectures_in_range(spark, sf_dir):
    lon, lat = place("c_custkey")
    cities = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("prefecture"), lon.alias("lon"), lat.alias("lat"))
    return views.prefectures_in_range(cities, (139.1, 35.1, 139.12, 35.4))


@query("""SELECT p_brand, count(*) AS parts, arg_min(p_name, (-p_size, p_partkey::VARCHAR)) AS name FROM part WHERE p_size % 4 > 0 GROUP BY 1""")
def area_parts(spark, sf_dir):
    """Ordinary parts of each area, with the attributes of the largest."""
    rows = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") % 4).alias("kind"), "p_size", F.col("p_partkey").alias("ring"), "p_name")
    out = views.area_parts(rows, "p_brand", "kind", [1, 2, 3], "p_size")
    return out.select("p_brand", F.size("rings").cast("long").alias("parts"), F.col("p_name").alias("name"))


@query("""SELECT o_custkey, min(o_orderkey) AS first, arg_min(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 7 > 0 AND 139 + o_custkey * 37 % 1000 / 1000.0 <= 139.5 GROUP BY 1""")
def block_points(spark, sf_dir):
    lon, lat = place("o_custkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("first"), "o_totalprice", F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("representative"), (F.col("o_orderkey") % 7 == 0).alias("deleted"), lon.alias("lon"), lat.alias("lat"))
    return views.block_points(rows, ["o_custkey"], (139.0, 35.0, 139.5, 36.0), "o_orderkey").select("o_custkey", "first", F.col("o_totalprice").alias("price"))


@query("""SELECT product, state, count(*) AS tiles, coalesce(sum(m), 0)::BIGINT AS missing FROM (SELECT s_suppkey % 3 AS product, CASE WHEN s_suppkey % 5 < 3 THEN 'stored' WHEN s_suppkey % 5 = 3 THEN 'absent' ELSE 'not_fetched' END AS state, CASE WHEN s_suppkey % 5 < 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END END AS m FROM supplier) GROUP BY 1, 2""")
def tile_states(spark, sf_dir):
    """Tiles that are stored, absent at the source, or never fetched, and the missing pixels of the stored ones."""
    key = F.col("s_suppkey")
    wanted = table(spark, sf_dir, "supplier").select((key % 3).alias("product"), F.lit(10).alias("z"), key.alias("x"), F.lit(1).alias("y"))
    own = wanted.where("x % 5 < 3").withColumn("pixels", F.array(F.lit(None).cast("int"), F.when(F.col("x") % 2 > 0, 1), F.lit(5)))
    out = views.tile_states(wanted, own, wanted.where("x % 5 = 3"))
    return out.groupBy("product", "state").agg(F.count("*").alias("tiles"), F.coalesce(F.sum("missing_pixels"), F.lit(0)).alias("missing"))


@query(f"""SELECT s_suppkey, h * 3600 AS hour, round((1 - gx) * (1 - gy) * (i * 10 + j + h) + gx * (1 - gy) * ((i + 1) * 10 + j + h) + (1 - gx) * gy * (i * 10 + j + 1 + h) + gx * gy * ((i + 1) * 10 + j + 1 + h), 6) AS value
    FROM (SELECT *, fx - floor(fx) AS gx, fy - floor(fy) AS gy, floor(fx)::INT AS i, floor(fy)::INT AS j FROM (SELECT s_suppkey, (lon - 139) / 0.25 AS fx, (lat - 35) / 0.25 AS fy FROM (SELECT s_suppkey, {_XY.format(k="s_suppkey")} FROM supplier))), (SELECT unnest([2, 3, 4]) AS h)""")
def forecast_series(spark, sf_dir):
    """Whole hours from a start on, as far as the chunks reach, between four grid points."""
    lon, lat = place("s_suppkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon"), lat.alias("lat"))
    grid = spark.range(0, 6).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(0, 5).select(F.col("id").cast("int").alias("j"))).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(4))))
    chunks = grid.select(F.lit("wind").alias("variable"), F.timestamp_seconds(F.col("h") * 3600).alias("hour"), "i", "j", (F.col("i") * 10 + F.col("j") + F.col("h")).cast("double").alias("value"))
    out = views.forecast_series(chunks, points, "s_suppkey", F.timestamp_seconds(F.lit(2 * 3600 + 1500)), 6, 139.0, 35.0, 0.25, 0.25)
    return out.select("s_suppkey", F.unix_timestamp("hour").alias("hour"), F.round("value", 6).alias("value"))


@query("""SELECT event_id AS id, try_cast(json_extract_string(props, '$.k') AS INT) AS deaths, CASE event_id % 3 WHEN 0 THEN 'bicycle' WHEN 1 THEN 'other' END AS party FROM events WHERE event_type = 'click'""")
def source_view(spark, sf_dir):
    """The typed view of one source over a feature table of JSON attributes."""
    k = F.col("event_id")
    attrs = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("deaths"), F.when(k % 3 == 0, "51").when(k % 3 == 1, "09").alias("party_a")))
    features = table(spark, sf_dir, "events").select(k.alias("natural_key"), F.when(F.col("event_type") == "click", "accident").otherwise("way").alias("source"), attrs.alias("attrs"))
    return views.accidents_view(features).select(F.col("natural_key").alias("id"), "deaths", F.col("party_a").alias("party"))


@query("""SELECT o_orderkey, [o_custkey, -o_orderkey, 1099511627776 + o_custkey]::VARCHAR AS nodes FROM orders""")
def packed_nodes(spark, sf_dir):
    """Node ids packed as little-endian 64-bit integers, and read again."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    little = lambda v: F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(F.lpad(F.hex(v), 16, "0"), i, F.lit(2))), "")
    packed = F.unhex(F.concat(*map(little, (c, -k, c + (1 << 40)))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(views.int64s(packed).cast("array<string>"), ", "), F.lit("]")).alias("nodes"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ファミリーマート駅前' WHEN 1 THEN 'タイキ店' WHEN 2 THEN 'X' ELSE 'Y' END AS name, CASE p_partkey % 4 WHEN 0 THEN '正覚寺' WHEN 1 THEN '日赤病院' WHEN 2 THEN '豊川稲荷' ELSE '株式会社宮' END AS owner, p_partkey % 4 IN (0, 2) AS temple FROM part""")
def place_names(spark, sf_dir):
    """Shops of cash machines, unvoiced chain words, owners without marks, and whether one is a temple."""
    m = F.col("p_partkey") % 4
    name = F.when(m == 0, "銀行ATM | イーネット ファミリーマート駅前 共同出張所").when(m == 1, "ダイギ店").when(m == 2, "X").otherwise("Y")
    owner = F.when(m == 0, "（宗教法人）　正覚寺").when(m == 1, "日赤病院（東京）").when(m == 2, "豊川稲荷（豊川）、国").otherwise("株式会社宮")
    first = F.get(text.owners(owner), F.lit(0))
    shop = text.shop_of_machine(name)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(m == 1, text.unvoiced(shop)).otherwise(shop).alias("name"), first.alias("owner"), text.is_temple(first).alias("temple"))


_SPAN = _DISTANCE.format(a0="min(lon)", b0="min(lat)", a1="max(lon)", b1="max(lat)")
_LEG = _DISTANCE.format(a0="plon", b0="plat", a1="lon", b1="lat")


@query(f"""WITH p AS (SELECT s_nationkey, s_suppkey, {_XY.format(k="s_suppkey")} FROM supplier), l AS (SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))
    SELECT s_nationkey, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat, round({_SPAN}, 3) AS span_m, round(coalesce(sum({_LEG}) FILTER (plon IS NOT NULL), 0), 3) AS length_m FROM l GROUP BY 1""")
def group_geometry(spark, sf_dir):
    """Middle, span and length of a line through each nation's suppliers."""
    lon, lat = place("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", lon.alias("lon"), lat.alias("lat"))
    out = rows.groupBy("s_nationkey").agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), geo.span_m().alias("span_m"), geo.line_of("s_suppkey").alias("line"))
    return out.select("s_nationkey", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("span_m", 3).alias("span_m"), F.round(derive.line_length(F.col("line")), 3).alias("length_m"))


_HALF1, _HALF2 = (_DISTANCE.format(a0=f"lon{i}", b0=f"lat{i}", a1=f"lon{i + 1}", b1=f"lat{i + 1}") for i in (0, 1))


@query(f"""WITH p AS (SELECT s_suppkey, 139 + s_suppkey * 37 % 1000 / 1000.0 AS lon0, 35 + s_suppkey * 61 % 700 / 1000.0 AS lat0, 139.5 AS lon1, 35.3 AS lat1, 139.9 AS lon2, 35.1 AS lat2 FROM supplier), d AS (SELECT *, {_HALF1} AS a, {_HALF2} AS b FROM p), w AS (SELECT *, (a + b) * 0.4 AS x FROM d)
    SELECT s_suppkey, round(CASE WHEN x <= a THEN lon0 + (lon1 - lon0) * x / a ELSE lon1 + (lon2 - lon1) * (x - a) / b END, 6) AS lon, round(CASE WHEN x <= a THEN lat0 + (lat1 - lat0) * x / a ELSE lat1 + (lat2 - lat1) * (x - a) / b END, 6) AS lat FROM w""")
def points_along(spark, sf_dir):
    """The point at four tenths of a line of three points."""
    lon, lat = place("s_suppkey")
    point = lambda x, y: F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat"))
    at = geo.along(F.array(F.struct(lon.alias("lon"), lat.alias("lat")), point(139.5, 35.3), point(139.9, 35.1)), 0.4)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(at["lon"], 6).alias("lon"), F.round(at["lat"], 6).alias("lat"))


@query("""WITH s AS (SELECT p_brand, p_size AS v, p_retailprice AS w FROM part), q AS (SELECT p_brand, v, sum(w) AS w FROM s GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY v) AS upto, sum(w) OVER (PARTITION BY p_brand) AS total FROM q)
    SELECT p_brand, min(v) FILTER (upto >= total * 0.25 - total * 1e-12) AS q250, min(v) FILTER (upto >= total * 0.5 - total * 1e-12) AS q500, min(v) FILTER (upto >= total * 0.75 - total * 1e-12) AS q750, round(coalesce(sum(w) FILTER (v = 0), 0) / sum(w), 6) AS zero_share FROM c GROUP BY 1""")
def value_preview(spark, sf_dir):
    """What a preview shows of a sample, here of everything: quartiles by weight and the share at zero."""
    out = preview(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice", 1.0, None, [0.25, 0.5, 0.75])
    return out.select("p_brand", "q250", "q500", "q750", F.round("zero_share", 6).alias("zero_share"))


_TAGS = ["surface_class", "maxspeed_kmh", "bridge", "cycleway_class", "signal_count_per_km", "accident_count_per_km_year", "gradient_percent", "oneway", "rain_24h_mm"]


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'paved' WHEN 1 THEN 'gravel' END AS surface_class, CASE WHEN p_size % 4 > 0 THEN p_size::DOUBLE END AS maxspeed_kmh, p_partkey % 5 = 0 AS bridge, CASE WHEN p_partkey % 7 = 0 THEN 'separated' WHEN p_partkey % 7 = 1 THEN 'lane' END AS cycleway_class,
    CASE WHEN p_partkey % 2 = 0 THEN p_size / (p_retailprice / 1000.0) END AS signal_count_per_km, CASE WHEN p_partkey % 2 = 0 THEN 3 / (p_retailprice / 1000.0 * 7) END AS accident_count_per_km_year, CASE WHEN p_size % 3 = 0 THEN p_size - 20.0 END::DOUBLE AS gradient_percent,
    CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 = 1 END AS oneway, CASE WHEN p_size < 9 THEN p_size / 2.0 END::DOUBLE AS rain_24h_mm FROM part""")
def standard_materials(spark, sf_dir):
    """Nine of the standard materials over parts as segments; the land-cover table is never joined."""
    part = table(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    tags = F.create_map(*[x for n, c in (("surface", F.when(k % 3 == 0, " Asphalt").when(k % 3 == 1, "gravel")), ("maxspeed", F.when(z % 4 > 0, z.cast("string"))), ("bridge", F.when(k % 5 == 0, "yes")), ("cycleway:left", F.when(k % 7 == 0, "track").when(k % 7 == 1, "lane"))) for x in (F.lit(n), c)])
    base = part.select("p_partkey", tags.alias("tags"), F.col("p_retailprice").alias("distance_m"))
    own = lambda where, *columns: (part.where(where).select("p_partkey", *columns), ("p_partkey",))
    given = {
        "counts": own("p_partkey % 2 = 0", z.alias("signal_count"), F.lit(3).alias("accident_count"), F.lit(7).alias("accident_years")), "elevation": own("p_size % 3 = 0", (z - 20.0).alias("grade")),
        "directions": own("p_partkey % 4 > 0", F.when(k % 4 == 3, "both").otherwise("forward").alias("direction"), (k % 4 == 2).alias("divided")), "rain": own("p_size < 9", (z / 2.0).alias("rain_24h_mm")), "landcover": own("true", *[F.lit(1.0).alias(f"lc_{c}") for c in catalog.LAND_COVER]),
    }
    return catalog.standard(given).read(base, _TAGS).select("p_partkey", *_TAGS)


QUERIES, ORACLES = query.queries, query.oracles
