"""Serving queries: values along roads, bulletins, forecast frames, stations, tiles and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import tags
from tarmac.operators import bulletins, places, tiles
from tarmac.plans import tuning
from tarmac.queries.registry import Registry, table
from tarmac.queries.scalar import _DISTANCE, place

query = Registry()

_XY = "139 + {k} * 37 % 1000 / 1000.0 AS lon, 35 + {k} * 61 % 700 / 1000.0 AS lat"


def _points(spark, sf_dir, name: str, key: str, *more: str):
    lon, lat = place(key)
    return table(spark, sf_dir, name).select(key, lon.alias("lon"), lat.alias("lat"), *more)


_FROM = _DISTANCE.format(a0="c.lon", b0="c.lat", a1="s.lon", b1="s.lat")


@query(f"""SELECT c_custkey, min_by(s_suppkey, (round(d, 6), s_suppkey)) AS s_suppkey FROM (SELECT c_custkey, s_suppkey, {_FROM} AS d FROM (SELECT c_custkey, {_XY.format(k="c_custkey")} FROM customer) c,
    (SELECT s_suppkey, {_XY.format(k="(s_suppkey + 3)")} FROM supplier WHERE s_nationkey = 3) s) GROUP BY 1""")
def nearest_station(spark, sf_dir):
    """Every customer's nearest station, however far; few stations, so the radius grows."""
    stations = table(spark, sf_dir, "supplier").where("s_nationkey = 3").select("s_suppkey", (F.col("s_suppkey") + 3).alias("k"))
    lon, lat = place("k")
    return bulletins.nearest_station(_points(spark, sf_dir, "customer", "c_custkey"), stations.select("s_suppkey", lon.alias("lon"), lat.alias("lat")), "c_custkey", "s_suppkey", 2000.0).select("c_custkey", "s_suppkey")


@query("""SELECT p_partkey, CASE WHEN abs(least(t, 360 - t) - 90) > 15 THEN round(CASE WHEN least(t, 360 - t) < 90 THEN g ELSE -g END, 1) END AS value
    FROM (SELECT p_partkey, p_size / 7.0 - 3 AS g, (p_partkey * 31 % 360 - 40 + 360) % 360 AS t FROM part WHERE p_size % 4 > 0)""")
def gradient_values(spark, sf_dir):
    """Roads across the direction have a row without a value; roads without a gradient have no row."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 7.0 - 3).alias("gradient"), (F.col("p_partkey") * 31 % 360).cast("double").alias("road_bearing"))
    return bulletins.gradient_values(rows, "p_partkey", 40.0)


@query("""SELECT c_custkey, round(v / 3.0, 1) AS value FROM (SELECT c_custkey, c_custkey % 40 AS station FROM customer) JOIN (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 17 END AS v FROM supplier) USING (station) WHERE v IS NOT NULL""")
def rain_values(spark, sf_dir):
    """Values of each feature's gauge; a feature whose gauge has none is left out."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 40).alias("station"))
    gauges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 17 / 3.0).alias("value"))
    return bulletins.station_values(customers, customers, gauges, "c_custkey", "station")


def _wind_series(spark):
    grid = spark.range(2224, 2241).select(F.col("id").cast("int").alias("i")).crossJoin(spark.range(700, 715).select(F.col("id").cast("int").alias("j")))
    hours = grid.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return hours.select("i", "j", F.timestamp_seconds(F.col("h") * 3600).alias("hour"), (F.col("i") % 7 + F.col("j") % 5 / 8.0 + F.col("h")).alias("value"))


@query(f"""SELECT c_custkey, round(i % 7 + j % 5 / 8.0 + h, 3) AS value FROM (SELECT c_custkey, round_even(lon / 0.0625, 0)::INT AS i, round_even(lat / 0.05, 0)::INT AS j, least(floor((c_custkey % 9 * 3000) / 3600.0 + 0.5), 6)::INT AS h
    FROM (SELECT c_custkey, {_XY.format(k="c_custkey")} FROM customer) WHERE c_custkey % 9 * 3000 BETWEEN 3600 AND 21600) WHERE i BETWEEN 2224 AND 2240 AND j BETWEEN 700 AND 714""")
def wind_values(spark, sf_dir):
    """The lattice point and hour next to each feature; times outside the forecast give nothing."""
    at = F.timestamp_seconds(F.col("c_custkey") % 9 * 3000)
    return bulletins.lattice_values(_points(spark, sf_dir, "customer", "c_custkey"), _wind_series(spark), "c_custkey", at, 0.0625, 0.05)


@query("""SELECT p_partkey, CASE WHEN p_size % 4 > 0 AND p_partkey % 6 > 0 THEN p_size END AS value, CASE WHEN p_size % 4 = 0 THEN 'missing' WHEN p_partkey % 6 = 0 THEN 'undetermined' ELSE 'known' END AS state FROM part""")
def painted_values(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    values = part.where("p_size % 4 > 0").select("p_partkey", F.when(F.col("p_partkey") % 6 > 0, F.col("p_size")).alias("value"))
    return bulletins.painted(part.select("p_partkey"), values, "p_partkey")


def _bulletins(spark, sf_dir):
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        (key % 12).alias("bulletin"), F.when(key % 5 < 2, "fine").otherwise("coarse").alias("level"), F.when(key % 5 < 2, F.concat(F.lit("f"), (key % 3).cast("string"))).otherwise(F.concat(F.lit("c"), (key % 2).cast("string"))).alias("area"),
        key.alias("item"), (key % 7).alias("code"), F.concat(F.lit("warning "), (key % 11).cast("string")).alias("name"), (key % 4 > 0).alias("active"),
    )


@query("""WITH b AS (SELECT s_suppkey % 12 AS bulletin, CASE WHEN s_suppkey % 5 < 2 THEN 'fine' ELSE 'coarse' END AS level, CASE WHEN s_suppkey % 5 < 2 THEN 'f' || s_suppkey % 3 ELSE 'c' || s_suppkey % 2 END AS area, s_suppkey AS item, s_suppkey % 7 AS code, 'warning ' || s_suppkey % 11 AS name, s_suppkey % 4 > 0 AS active FROM supplier),
    own AS (SELECT *, max(level) OVER (PARTITION BY bulletin) AS best FROM b WHERE (level = 'fine' AND area = 'f1') OR (level = 'coarse' AND area = 'c1'))
    SELECT code, max_by(name, (bulletin, item)) AS name, (min((bulletin, item)))[1] AS first_bulletin, (min((bulletin, item)))[2] AS first_item FROM own WHERE level = best AND active AND name <> 'warning 3' GROUP BY 1""")
def active_warnings(spark, sf_dir):
    return bulletins.active_warnings(_bulletins(spark, sf_dir), "f1", "c1", ["warning 3"])


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 > 0 AND (s_suppkey % 3 = 1 OR s_suppkey % 4 = 2)")
def active_floods(spark, sf_dir):
    key = F.col("s_suppkey")
    code = lambda p, n: F.array(F.concat(F.lit(p), (key % n).cast("string")), F.lit("x"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 5 > 0, key % 5).alias("level"), code("f", 3).alias("fine_codes"), code("c", 4).alias("coarse_codes"))
    return bulletins.active_floods(rows, "f1", "c2").select("s_suppkey")


def _frames(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    base = F.timestamp_seconds((F.col("event_id") % 6 + 1) * 3600)
    return events.select((F.col("user_id") % 10).alias("layer"), (F.col("event_id") % 3).alias("member"), base.alias("basetime"), F.timestamp_seconds((F.col("event_id") % 6 + 1 + F.col("user_id") % 4) * 3600).alias("validtime")).distinct()


_FRAMES = "frames AS (SELECT DISTINCT user_id % 10 AS layer, event_id % 3 AS member, event_id % 6 + 1 AS b, event_id % 6 + 1 + user_id % 4 AS v FROM events)"


@query(f"WITH {_FRAMES} SELECT layer, member, b * 3600 AS basetime, v * 3600 AS validtime FROM (SELECT *, max(v) FILTER (v = b) OVER (PARTITION BY layer) AS last FROM frames) WHERE last IS NULL OR v >= last")
def nowcast_frames(spark, sf_dir):
    out = bulletins.nowcast_frames(_frames(spark, sf_dir), ["layer"])
    return out.select("layer", "member", F.unix_timestamp("basetime").alias("basetime"), F.unix_timestamp("validtime").alias("validtime"))


@query(f"""WITH {_FRAMES}, runs AS (SELECT layer, member, max(b) AS b FROM (SELECT layer, member, b FROM frames GROUP BY 1, 2, 3 HAVING count(DISTINCT v) > 1) GROUP BY 1, 2)
    SELECT layer, v * 3600 AS validtime, (min_by((b, member), (-b, member)))[1] * 3600 AS basetime, (min_by((b, member), (-b, member)))[2] AS member FROM frames JOIN runs USING (layer, member, b) GROUP BY 1, 2""")
def full_run_frames(spark, sf_dir):
    out = bulletins.full_run_frames(_frames(spark, sf_dir), ["layer"])
    return out.select("layer", F.unix_timestamp("validtime").alias("validtime"), F.unix_timestamp("basetime").alias("basetime"), "member")


@query(f"WITH {_FRAMES} SELECT layer, max(b) * 3600 AS basetime FROM frames GROUP BY 1")
def latest_frame(spark, sf_dir):
    return bulletins.latest_frame(_frames(spark, sf_dir), ["layer"]).select("layer", F.unix_timestamp("basetime").alias("basetime"))


@query("""WITH f AS (SELECT user_id, event_id % 5 AS issued, CASE WHEN event_id % 7 > 0 THEN floor(epoch(ts))::BIGINT END AS due, event_id % 400 / 10.0 AS wbgt FROM events), l AS (SELECT *, max(issued) OVER (PARTITION BY user_id) AS last FROM f)
    SELECT user_id, issued, min_by(due, (abs(due - 1700000000), due)) AS due FROM l WHERE issued = last AND due IS NOT NULL GROUP BY 1, 2""")
def heat_forecast(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5).alias("issued"), F.when(F.col("event_id") % 7 > 0, F.date_trunc("second", F.col("ts").cast("timestamp"))).alias("at"), (F.col("event_id") % 400 / 10.0).alias("wbgt"))
    out = bulletins.heat_forecast(events, "user_id", F.timestamp_seconds(F.lit(1_700_000_000)))
    return out.select("user_id", "issued", F.unix_timestamp("at").alias("due"))


@query("""SELECT s_suppkey, CASE WHEN r * 6 >= 0.5 THEN CASE WHEN t <= 1.0 THEN CASE WHEN r * 6 < 2.5 THEN 71 WHEN r * 6 < 7.6 THEN 73 ELSE 75 END ELSE CASE WHEN r * 6 < 2.5 THEN 61 WHEN r * 6 < 7.6 THEN 63 ELSE 65 END END WHEN s = 'clear' THEN 0 WHEN s IS NOT NULL THEN 3 END AS code
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 6 > 0 THEN s_suppkey % 20 / 10.0 - 0.4 END AS r, s_suppkey % 9 - 3 AS t, CASE s_suppkey % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'rain' END AS s FROM supplier)""")
def observed_weather(spark, sf_dir):
    key = F.col("s_suppkey")
    code = bulletins.observed_weather_code(F.when(key % 6 > 0, key % 20 / 10.0 - 0.4), F.when(key % 3 == 0, "clear").when(key % 3 == 1, "rain"), key % 9 - 3)
    return table(spark, sf_dir, "supplier").select("s_suppkey", code.alias("code"))


@query("""WITH e AS (SELECT k, unnest([(d * 24 + 5 + k) * 3600 FOR d IN range(0, 20)]) AS at, true AS dawn FROM range(0, 3) t(k) UNION ALL SELECT k, unnest([(d * 24 + 18 - k) * 3600 FOR d IN range(0, 20)]), false FROM range(0, 3) t(k)),
    q AS (SELECT o_orderkey, o_custkey % 3 AS k, o_orderkey % 500 * 3600 AS at FROM orders)
    SELECT o_orderkey, coalesce(NOT dawn AND q.at < (SELECT max(e.at) FROM e WHERE e.k = q.k), false) AS night FROM q ASOF LEFT JOIN e ON e.k = q.k AND e.at <= q.at""")
def night_mask(spark, sf_dir):
    """Orders as passages at one of three places with twenty days of dawns and dusks."""
    days = spark.range(3).withColumnRenamed("id", "k").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(19))))
    hour = lambda c: F.timestamp_seconds((F.col("d") * 24 + c) * 3600)
    events = days.select("k", hour(5 + F.col("k")).alias("at"), F.lit(True).alias("dawn")).unionByName(days.select("k", hour(18 - F.col("k")).alias("at"), F.lit(False).alias("dawn")))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("k"), F.timestamp_seconds(F.col("o_orderkey") % 500 * 3600).alias("at"))
    return bulletins.at_night(asked, "k", "at", events).select("o_orderkey", "night")


@query(f"""SELECT x, y, CASE WHEN x BETWEEN 900 AND 904 THEN true ELSE false END AS covered FROM (SELECT DISTINCT floor((lon + 180) / 360 * 1024)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024)::INT AS y
    FROM (SELECT c_custkey, {_XY.format(k="c_custkey")} FROM customer))""")
def covered_tiles(spark, sf_dir):
    """Tiles of the customers that the latest run's box meets; the box comes out of the run's profile."""
    from tarmac.functions.geo import tile_x, tile_y

    profile = '{"target": {"bbox": [20.0, 136.5, 60.0, 138.1640625]}}'
    box = tiles.ingested_box(spark.range(1).select(F.lit(profile).alias("profile")))
    points = _points(spark, sf_dir, "customer", "c_custkey").select(tile_x(F.col("lon"), 10).alias("x"), tile_y(F.col("lat"), 10).alias("y")).distinct()
    return tiles.covered(points.withColumns(tiles.tile_box(10)), box, "min_lat", "min_lon", "max_lat", "max_lon").select("x", "y", "covered")


@query("""SELECT l_orderkey, round(sum(l_discount * l_quantity) FILTER (l_returnflag <> 'N') / sum(l_quantity) FILTER (l_returnflag <> 'N'), 9) AS score, sum(l_linenumber)::BIGINT AS stops, sum(l_quantity) AS km, list_sort(list(l_linenumber))::VARCHAR AS segments FROM lineitem GROUP BY 1""")
def way_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("segment"), F.when(F.col("l_returnflag") != "N", F.col("l_discount")).alias("score"), F.col("l_linenumber").cast("long").alias("stops"), F.col("l_quantity").alias("km"))
    out = tiles.way_rollup(rows, "l_orderkey", "km", ["score"], ["stops"])
    return out.select("l_orderkey", F.round("score", 9).alias("score"), "stops", "km", F.concat(F.lit("["), F.array_join(F.col("segments").cast("array<string>"), ", "), F.lit("]")).alias("segments"))


_TX, _TY = "floor((p.lon + 180) / 360 * 1024)::INT", "floor((1 - ln(tan(radians(p.lat)) + 1 / cos(radians(p.lat))) / pi()) / 2 * 1024)::INT"


@query(f"""WITH p AS (SELECT s_suppkey, k, 139 + (s_suppkey * 37 + k * 300) % 1000 / 1000.0 AS lon, 35 + s_suppkey * 61 % 700 / 1000.0 AS lat FROM supplier, range(0, 3) t(k)), t AS (SELECT *, {_TX} AS x, {_TY} AS y FROM p),
    f AS (SELECT DISTINCT s_suppkey, x, y FROM t)
    SELECT f.s_suppkey, f.x, f.y, sum(round_even(((p.lon + 180) / 360 * 1024 - f.x) * 4096, 0)::BIGINT)::BIGINT AS east, sum(round_even(((1 - ln(tan(radians(p.lat)) + 1 / cos(radians(p.lat))) / pi()) / 2 * 1024 - f.y) * 4096, 0)::BIGINT)::BIGINT AS south FROM f JOIN p USING (s_suppkey) GROUP BY 1, 2, 3""")
def tile_features(spark, sf_dir):
    """Lines of three points in each tile that they touch; whole tile coordinates, added up."""
    key = F.col("s_suppkey")
    point = lambda k: F.struct((139 + (key * 37 + k * 300) % 1000 / 1000.0).alias("lon"), (35 + key * 61 % 700 / 1000.0).alias("lat"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(*map(point, range(3))).alias("points"))
    out = tiles.feature_rows(rows, "s_suppkey", 10, [])
    add = lambda c: F.aggregate("line", F.lit(0).cast("long"), lambda a, p: a + p[c])
    return out.select("s_suppkey", "x", "y", add("x").alias("east"), add("y").alias("south"))


_NEAR = _DISTANCE.format(a0="p.lon", b0="p.lat", a1="q.lon", b1="q.lat")


@query(f"""WITH RECURSIVE pts AS (SELECT s_suppkey, s_nationkey % 3 AS g, {_XY.format(k="s_suppkey")} FROM supplier), near AS (SELECT p.s_suppkey AS a, q.s_suppkey AS b FROM pts p JOIN pts q ON p.g = q.g WHERE p.g < 2 AND {_NEAR} <= 6000),
    walk AS (SELECT a AS n, a AS root FROM near UNION SELECT b, root FROM walk JOIN near ON a = n), c AS (SELECT n AS s_suppkey, min(root) AS root FROM walk GROUP BY 1)
    SELECT g AS kind, min(s_suppkey) AS first, count(*) AS n, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM pts LEFT JOIN c USING (s_suppkey) GROUP BY g, coalesce(root, s_suppkey)""")
def clustered_points(spark, sf_dir):
    rows = _points(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").withColumn("kind", F.col("s_nationkey") % 3)
    out = tiles.clustered_points(rows, "s_suppkey", "kind", 6000, [0, 1])
    return out.select("kind", "first", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '#fff' WHEN 1 THEN '#0a0' ELSE 'c' || p_size % 5 END AS colour, p_size % 5 < 2 AS known FROM part""")
def recoloured(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string")).alias("colour"))
    return tiles.recoloured(rows, {"c0": "#fff", "c1": "#0a0"})


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 1 THEN '10,20,30,255' WHEN 2 THEN '0,90,0,255' ELSE '0,0,0,0' END AS rgba FROM part""")
def class_colours(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("class"))
    return tiles.class_colours(rows, {1: (10, 20, 30, 255), 2: (0, 90, 0, 255)}).select("p_partkey", F.array_join(F.col("rgba").cast("array<string>"), ",").alias("rgba"))


@query("""SELECT layer, z, count(*) AS n, sum(x * 1000 + y)::BIGINT AS codes FROM (SELECT DISTINCT s_nationkey % 4 AS layer, s_suppkey % 3 AS z, s_suppkey % 50 AS x, s_suppkey % 31 AS y FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 5 > 0) GROUP BY 1, 2""")
def tile_presence(spark, sf_dir):
    """Tiles with any visible pixel; one without readable pixels counts as visible."""
    key = F.col("s_suppkey")
    alphas = F.when(key % 7 > 0, F.array(F.lit(0), key % 5))
    rows = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 4).alias("layer"), (key % 3).alias("z"), (key % 50).alias("x"), (key % 31).alias("y"), tiles.not_empty(alphas).alias("shown"))
    out = tiles.presence(rows)
    return out.select("layer", "z", F.size("tiles").cast("long").alias("n"), F.aggregate("tiles", F.lit(0).cast("long"), lambda a, t: a + t["x"] * 1000 + t["y"]).alias("codes"))


@query("SELECT p_partkey, (p_partkey * 7 % 4096 - 2048) * 2 AS px, p_size * 80 * 2 AS py FROM part WHERE p_partkey * 7 % 4096 BETWEEN 2048 - 64 AND 4096 + 64 AND p_size * 80 BETWEEN -64 AND 2048 + 64")
def clipped_points(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 4096).alias("px"), (F.col("p_size") * 80).alias("py"))
    return tiles.clipped_points(rows, 1, 0)


def _tracks(spark, sf_dir):
    """Orders as lines over a tile, a point for each of its lines."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 37 % 5000 - 400).cast("double").alias("x"), (F.col("l_suppkey") * 613 % 5000 - 400).cast("double").alias("y"))))
    points = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track")).agg(points.alias("points"))


def _once(tracks, clip):
    """Tracks with their ``clip`` if it is not empty; a filter on it would have it computed twice."""
    return tracks.select("track", F.explode(F.filter(F.array(clip), lambda c: F.size(c) > 0)).alias("clip"))


@query("""WITH v AS (SELECT l_orderkey AS track, row_number() OVER w AS i, (l_partkey * 37 % 5000 - 400)::DOUBLE AS x, (l_suppkey * 613 % 5000 - 400)::DOUBLE AS y, lead((l_partkey * 37 % 5000 - 400)::DOUBLE) OVER w AS u, lead((l_suppkey * 613 % 5000 - 400)::DOUBLE) OVER w AS v FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
    s AS (SELECT *, u - x AS dx, v - y AS dy FROM v WHERE u IS NOT NULL AND (u <> x OR v <> y)),
    t AS (SELECT *, greatest(0.0, CASE WHEN dx > 0 THEN (1984 - x) / dx WHEN dx < 0 THEN (4160 - x) / dx ELSE 0.0 END, CASE WHEN dy > 0 THEN (-64 - y) / dy WHEN dy < 0 THEN (2112 - y) / dy ELSE 0.0 END) AS a,
        least(1.0, CASE WHEN dx > 0 THEN (4160 - x) / dx WHEN dx < 0 THEN (1984 - x) / dx ELSE 1.0 END, CASE WHEN dy > 0 THEN (2112 - y) / dy WHEN dy < 0 THEN (-64 - y) / dy ELSE 1.0 END) AS b,
        (dx = 0 AND NOT x BETWEEN 1984 AND 4160) OR (dy = 0 AND NOT y BETWEEN -64 AND 2112) AS beside FROM s),
    k AS (SELECT *, NOT beside AND a < b AS inside FROM t), f AS (SELECT *, coalesce(lag(inside AND b >= 1) OVER (PARTITION BY track ORDER BY i), false) AS goes_on FROM k)
    SELECT track, count(*) FILTER (a > 0 OR NOT goes_on) AS parts, round(sum((b - a) * sqrt(dx * dx + dy * dy)) * 2, 3) AS length FROM f WHERE inside GROUP BY 1""")
def clipped_lines(spark, sf_dir):
    """Lines of the tile's north-eastern quadrant with their number of parts and their length there."""
    parts = tiles.clip_line(F.col("points"), tiles.quadrant_box(1, 0))
    own = _once(_tracks(spark, sf_dir), parts).select("track", F.transform("clip", lambda line: tiles.to_child(line, 1, 0)).alias("lines"))
    return own.select("track", F.size("lines").cast("long").alias("parts"), F.round(F.aggregate("lines", F.lit(0.0), lambda a, line: a + tiles.line_span(line)), 3).alias("length"))


@query()
def clipped_rings(spark, sf_dir):
    """The same tracks as rings, with the area that lies in the quadrant."""
    own = _once(_tracks(spark, sf_dir), tiles.clip_ring(F.col("points"), tiles.quadrant_box(1, 0))).select("track", tiles.to_child(F.col("clip"), 1, 0).alias("ring"))
    return own.select("track", F.round(tiles.ring_area(F.col("ring")), 3).alias("area"))


_HIT = _DISTANCE.format(a0="lon", b0="lat", a1="139.5", b1="35.3")


@query(f"""WITH h AS (SELECT c_nationkey AS area, CASE WHEN c_nationkey % 3 = 0 THEN 'city' WHEN c_nationkey % 3 = 1 THEN 'oaza' ELSE 'aza' END AS level, c_custkey % 2 AS numbered, c_custkey % 3 AS continued, {_XY.format(k="c_nationkey")} FROM customer WHERE c_acctbal > 9000),
    b AS (SELECT area, level, lon, lat, min(numbered) AS numbered, min(continued) AS continued FROM h GROUP BY 1, 2, 3, 4)
    SELECT area, level, (row_number() OVER (ORDER BY numbered, list_position(['city', 'oaza', 'aza'], level), continued, {_HIT}, area))::INT AS position FROM b QUALIFY position <= 10""")
def ranked_hits(spark, sf_dir):
    lon, lat = place("c_nationkey")
    level = F.when(F.col("c_nationkey") % 3 == 0, "city").when(F.col("c_nationkey") % 3 == 1, "oaza").otherwise("aza")
    hits = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("area"), level.alias("level"), (F.col("c_custkey") % 2).alias("numbered"), (F.col("c_custkey") % 3).alias("continued"), lon.alias("lon"), lat.alias("lat"))
    return places.ranked_hits(hits, ["city", "oaza", "aza"], 139.5, 35.3, 10).select("area", "level", "position")


@query(f"SELECT s_suppkey FROM (SELECT s_suppkey, {_XY.format(k='s_suppkey')} FROM supplier) ORDER BY {_HIT}, s_suppkey LIMIT 10")
def nearest_places(spark, sf_dir):
    return places.nearest_places(_points(spark, sf_dir, "supplier", "s_suppkey"), "s_suppkey", 139.5, 35.3, 10).select("s_suppkey")


@query("""SELECT 0 AS source, n_nationkey::BIGINT AS id, (row_number() OVER (ORDER BY n_nationkey))::INT AS position FROM nation UNION ALL SELECT 1, s_suppkey, (row_number() OVER (ORDER BY s_suppkey))::INT FROM supplier""")
def addresses_then_places(spark, sf_dir):
    first = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") + 1).alias("position"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + 1).cast("int").alias("position"))
    return places.in_order(first, second)


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bath' WHEN 1 THEN 'lodging' END AS kind FROM part""")
def query_groups(spark, sf_dir):
    """Words in other spellings name a group; a longer name does not."""
    word = F.when(F.col("p_partkey") % 4 == 0, "ス ー パ ー せんとう").when(F.col("p_partkey") % 4 == 1, "ＨＯＴＥＬ").when(F.col("p_partkey") % 4 == 2, "hotel garden")
    return table(spark, sf_dir, "part").select("p_partkey", places.group_of(word, {"bath": ["スーパーセントウ", "sento"], "lodging": ["hotel"]}).alias("kind"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 40 <= 30 THEN s_suppkey % 40 ELSE 12.0 END::DOUBLE AS value, s_suppkey % 3 = 0 AND s_suppkey % 40 > 30 AS rejected FROM supplier""")
def tuned_parameters(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    given = supplier.select(F.col("s_suppkey").alias("name"), F.lit(12.0).alias("standard"), F.lit(0.0).alias("low"), F.lit(30.0).alias("high"))
    over = supplier.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("name"), (F.col("s_suppkey") % 40).cast("double").alias("value"))
    return tuning.resolved_table(given, over).withColumnRenamed("name", "s_suppkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 OR s_suppkey % 7 = 0 THEN 1.3 ELSE s_suppkey % 7 / 4.0 END::DOUBLE AS ratio FROM supplier")
def detour_ratio(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", tuning.detour(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 7 / 4.0)).alias("ratio"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_partkey % 4 = 0 END AS bridge, CASE WHEN p_size % 3 > 0 THEN p_partkey % 4 = 1 END AS tunnel, p_partkey % 5 = 0 OR p_partkey % 5 = 1 AS signal, p_partkey % 3 > 0 AS one_way, p_partkey % 3 <> 1 AS along, p_partkey % 3 <> 2 AS against,
    CASE WHEN p_size % 2 = 0 AND p_partkey % 2 = 0 THEN 'traffic_signals' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'crossing' ELSE 'stop' END END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'bicycle' WHEN 1 THEN 'power_assisted_bicycle' WHEN 2 THEN 'other' END AS party, p_partkey % 4 < 2 AS bicycle, p_size % 5 > 0 AS fatal FROM part""")
def road_flags(spark, sf_dir):
    """Bridges, tunnels, signals, directions, kinds and parties read from tags."""
    k, z = F.col("p_partkey"), F.col("p_size")
    row = z % 3 > 0
    highway, crossing = F.when(k % 5 == 0, "traffic_signals").when(k % 5 < 3, "crossing"), F.when(k % 5 == 1, "traffic_signals").when(k % 5 == 2, "zebra")
    way = F.when(k % 3 == 0, "both").when(k % 3 == 1, "backward").otherwise("forward")
    along, against = tags.travel_allowed(way)
    party = tags.party_type(F.when(k % 4 == 0, "51").when(k % 4 == 1, "52").when(k % 4 == 2, "03"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", tags.is_bridge(row, F.when(k % 4 == 0, " Viaduct")).alias("bridge"), tags.is_tunnel(row, F.when(k % 4 == 1, "yes")).alias("tunnel"), tags.is_signal(highway, crossing).alias("signal"), tags.one_way(way).alias("one_way"),
        along.alias("along"), against.alias("against"), tags.stop_kind(F.when(k % 2 == 0, "crossing").otherwise("stop"), z % 2 == 0).alias("kind"), party.alias("party"), tags.involves_bicycle(F.lit(None).cast("string"), party).alias("bicycle"), tags.is_fatal(F.when(z % 5 > 0, 1)).alias("fatal"),
    )


QUERIES, ORACLES = query.queries, query.oracles
