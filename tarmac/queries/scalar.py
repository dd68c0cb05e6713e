"""Column functions: tags, numbers, text, geometry, weather, arrays, maps, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geo, numbers, tags, text, weather
from tarmac.operators import places, spatial
from tarmac.queries.registry import Registry, exact_tenth, table

query = Registry()

_LINE = [(0.0, 0.0), (1000.0, 20.0), (20_000.0, 60.0), (60_000.0, 100.0)]
_LINE_SQL = """CASE WHEN {x} <= 0 THEN 0 WHEN {x} <= 1000 THEN {x} / 50.0 WHEN {x} <= 20000 THEN 20 + ({x} - 1000) * 40.0 / 19000
    WHEN {x} <= 60000 THEN 60 + ({x} - 20000) * 40.0 / 40000 WHEN {x} IS NOT NULL THEN 100 END"""
_RAD = "6371000.0"
_DISTANCE = """2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({b1} - {b0}) / 2), 2) + cos(radians({b0})) * cos(radians({b1})) * pow(sin(radians({a1} - {a0}) / 2), 2))))"""


def place(key: str):
    """A pseudo position from a key."""
    return 139 + F.col(key) * 37 % 1000 / 1000.0, 35 + F.col(key) * 61 % 700 / 1000.0


@query("""SELECT p_partkey, lower(trim(p_type)) AS tag, p_brand, CASE WHEN regexp_matches(p_brand, '[0-9]') THEN regexp_extract(p_brand, '([0-9]+)', 1)::INT END AS number FROM part""")
def tag_normalize(spark, sf_dir):
    number = tags.positive_int(F.regexp_extract("p_brand", "([0-9]+)", 1))
    return table(spark, sf_dir, "part").select("p_partkey", tags.normalized(F.concat(F.lit(" "), "p_type", F.lit(" "))).alias("tag"), "p_brand", number.alias("number"))


@query("""SELECT event_id, CASE WHEN k > 0 THEN k END AS k FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def positive_int_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", tags.positive_int(F.get_json_object("props", "$.k")).alias("k"))


@query("""SELECT p_partkey, CASE WHEN m = 0 THEN 'paved' WHEN m = 1 THEN 'gravel' WHEN m = 2 THEN 'other' END AS surface_class,
    CASE WHEN m = 0 THEN 'paved' WHEN m = 1 THEN 'gravel' WHEN g = 1 THEN 'gravel' WHEN g = 4 THEN 'soil' WHEN p_size % 2 = 0 THEN 'unknown_track' ELSE 'unknown_road' END AS surface_estimate
    FROM (SELECT *, p_partkey % 4 AS m, p_size % 5 AS g FROM part)""")
def surface_ladder(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    m, g = F.col("p_partkey") % 4, F.col("p_size") % 5
    surface = F.when(m == 0, " Asphalt ").when(m == 1, "gravel").when(m == 2, "rails")
    grade = F.when(g == 1, "grade2").when(g == 4, "grade5")
    highway = F.when(F.col("p_size") % 2 == 0, "track").otherwise("residential")
    return part.select("p_partkey", tags.surface_class(surface).alias("surface_class"), tags.surface_estimate(surface, grade, highway).alias("surface_estimate"))


@query("""SELECT c_custkey, max(o_orderpriority = '1-URGENT') AS urgent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1""")
def tristate_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    joined = table(spark, sf_dir, "customer").join(orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy("c_custkey").agg(F.max(tags.absent_is_false(F.col("o_orderkey").isNotNull(), F.col("o_orderpriority") == "1-URGENT")).alias("urgent"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN true END AS flag, nullif(round(l_discount, 1), 0) AS discount,
    CASE WHEN l_linestatus = 'O' THEN l_tax ELSE -l_discount END + 0 AS directed, l_quantity / nullif(l_extendedprice / 1000.0, 0) AS per_km FROM lineitem""")
def tile_columns(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", tags.tile_boolean(c("l_returnflag") == "R").alias("flag"), tags.tile_number(c("l_discount"), 1).alias("discount"),
        (tags.directed(c("l_linestatus") == "O", c("l_tax"), c("l_discount"), negate=True) + 0).alias("directed"), tags.per_km(c("l_quantity"), c("l_extendedprice")).alias("per_km"),
    )


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'forward' WHEN 1 THEN 'backward' WHEN 2 THEN 'both' WHEN 3 THEN 'forward' ELSE 'both' END AS direction,
    [6, 2, 1, 0][(o_orderkey % 4 + 1)::INT] AS rank FROM orders""")
def travel_direction(spark, sf_dir):
    m = F.col("o_orderkey") % 6
    bicycle = F.when(m == 2, "no")
    oneway = F.when(m == 0, "yes").when(m == 1, "-1").when(m == 2, "yes")
    junction = F.when(m == 3, "roundabout")
    highway = F.get(F.array(*map(F.lit, ("motorway", "tertiary", "service", "cycleway"))), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tags.travel_direction(bicycle, oneway, junction).alias("direction"), tags.highway_rank(highway).alias("rank"))


@query("SELECT o_orderkey, round(" + _LINE_SQL.format(x="(o_totalprice - 50000)") + ", 6) AS score FROM orders")
def clamped_interp(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(numbers.interpolate(F.col("o_totalprice") - 50_000, _LINE), 6).alias("score"))


@query("""SELECT c_custkey, round(CASE WHEN s <= 20 THEN s * 50 WHEN s <= 60 THEN 1000 + (s - 20) * 475 ELSE 20000 + (s - 60) * 1000 END, 6) AS x
    FROM (SELECT c_custkey, (c_custkey % 101)::DOUBLE AS s FROM customer)""")
def inverse_interp(spark, sf_dir):
    score = (F.col("c_custkey") % 101).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(numbers.first_reached(score, _LINE), 6).alias("x"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = 0 THEN 0 ELSE round(p_retailprice * pow(10.0, 3 - floor(log10(abs(p_retailprice)))), 0) / pow(10.0, 3 - floor(log10(abs(p_retailprice)))) END AS v FROM part""")
def sigdigit_round(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", numbers.round_significant(F.col("p_retailprice")).alias("v"))


@query(f"""SELECT l_orderkey, l_linenumber, {exact_tenth("(l_extendedprice / 200)")} AS tenth FROM lineitem""")
def round_half_exact(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.round_tenth(F.col("l_extendedprice") / 200).alias("tenth"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_extendedprice + l_discount + l_tax - l_extendedprice, 6) AS total FROM lineitem""")
def neumaier_sum(spark, sf_dir):
    terms = [F.col(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.compensated_sum([*terms, -F.col("l_extendedprice")]), 6).alias("total"))


_PAIRS = """(SELECT s_suppkey, 139 + s_suppkey * 37 % 1000 / 1000.0 AS a0, 35 + s_suppkey * 61 % 700 / 1000.0 AS b0, 139 + (s_suppkey + 1) * 37 % 1000 / 1000.0 AS a1, 35 + (s_suppkey + 1) * 61 % 700 / 1000.0 AS b1 FROM supplier)"""


@query(f"SELECT s_suppkey, round({_DISTANCE.format(a0='a0', b0='b0', a1='a1', b1='b1')}, 4) AS metres FROM {_PAIRS}")
def haversine(spark, sf_dir):
    lon, lat = place("s_suppkey")
    nxt = table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("a0"), lat.alias("b0"), (F.col("s_suppkey") + 1).alias("k"))
    lon, lat = place("k")
    return nxt.select("s_suppkey", F.round(geo.haversine_m(F.col("a0"), F.col("b0"), lon, lat), 4).alias("metres"))


@query(f"""SELECT s_suppkey, round(d, 6) AS bearing, (floor(d / 22.5 + 0.5) % 16)::INT AS sector, round(least(d, 360 - d), 6) AS from_north FROM (
    SELECT s_suppkey, (degrees(atan2(sin(radians(a1 - a0)) * cos(radians(b1)), cos(radians(b0)) * sin(radians(b1)) - sin(radians(b0)) * cos(radians(b1)) * cos(radians(a1 - a0)))) + 360) % 360 AS d FROM {_PAIRS})""")
def bearing(spark, sf_dir):
    lon, lat = place("s_suppkey")
    here = table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("a0"), lat.alias("b0"), (F.col("s_suppkey") + 1).alias("k"))
    lon, lat = place("k")
    d = geo.bearing_deg(F.col("a0"), F.col("b0"), lon, lat)
    out = here.select("s_suppkey", d.alias("d"))
    return out.select("s_suppkey", F.round("d", 6).alias("bearing"), geo.compass_sector(F.col("d")).alias("sector"), F.round(geo.folded_angle_deg(F.col("d"), F.lit(0.0)), 6).alias("from_north"))


@query("""SELECT c_custkey, floor((lon + 180) / 360 * 16384)::INT AS x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::INT AS y,
    round(floor((lon + 180) / 360 * 16384) / 16384 * 360 - 180, 9) AS west
    FROM (SELECT c_custkey, 139 + c_custkey * 37 % 1000 / 1000.0 AS lon, 35 + c_custkey * 61 % 700 / 1000.0 AS lat FROM customer)""")
def tile_math(spark, sf_dir):
    lon, lat = place("c_custkey")
    out = table(spark, sf_dir, "customer").select("c_custkey", geo.tile_x(lon, 14).alias("x"), geo.tile_y(lat, 14).alias("y"))
    return out.withColumn("west", F.round(geo.tile_west(F.col("x"), 14), 9))


@query("""SELECT n_nationkey, count(*) AS tiles FROM (SELECT n_nationkey, 139 + n_nationkey * 37 % 1000 / 1000.0 AS w, 35 + n_nationkey * 61 % 700 / 1000.0 AS s FROM nation),
    range(0, 4096) tx(x), range(0, 4096) ty(y) WHERE x BETWEEN floor((w + 180) / 360 * 4096) AND floor((w + 0.3 + 180) / 360 * 4096)
    AND y BETWEEN floor((1 - ln(tan(radians(s + 0.2)) + 1 / cos(radians(s + 0.2))) / pi()) / 2 * 4096) AND floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * 4096) GROUP BY 1""")
def covering_tiles(spark, sf_dir):
    lon, lat = place("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.size(geo.covering_tiles(lon, lat, lon + 0.3, lat + 0.2, 12)).cast("long").alias("tiles"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * (1 - fx) * (1 - fy) + l_discount * fx * (1 - fy) + l_tax * (1 - fx) * fy + l_linenumber * fx * fy, 6) AS v
    FROM (SELECT *, l_orderkey % 10 / 10.0 AS fx, l_partkey % 10 / 10.0 AS fy FROM lineitem)""")
def bilinear(spark, sf_dir):
    c = F.col
    value = numbers.bilinear(c("l_quantity"), c("l_discount"), c("l_tax"), c("l_linenumber"), c("l_orderkey") % 10 / 10.0, c("l_partkey") % 10 / 10.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(value, 6).alias("v"))


@query("""SELECT event_id, round(s, 6) AS speed, round(s * cos(radians(f - b)), 6) AS head, round((6 + s * cos(radians(f - b))) * sqrt(pow(6 + s * cos(radians(f - b)), 2) + pow(s * sin(radians(f - b)), 2)) / 36, 6) + 0 AS drag
    FROM (SELECT event_id, sqrt(u * u + v * v) AS s, (degrees(atan2(-u, -v)) + 360) % 360 AS f, (user_id % 360)::DOUBLE AS b FROM (SELECT *, (event_id % 13 - 6)::DOUBLE AS u, (event_id % 7 - 2.5)::DOUBLE AS v FROM events))""")
def wind_components(spark, sf_dir):
    u, v = (F.col("event_id") % 13 - 6).cast("double"), (F.col("event_id") % 7 - 2.5).cast("double")
    speed, source, way = weather.wind_speed(u, v), weather.wind_from_deg(u, v), (F.col("user_id") % 360).cast("double")
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(speed, 6).alias("speed"), F.round(weather.head_wind(speed, source, way), 6).alias("head"), (F.round(weather.drag_ratio(speed, source, way, 6.0), 6) + 0).alias("drag")
    )


@query("""SELECT p_partkey, CASE WHEN a BETWEEN 75 AND 105 THEN NULL WHEN a < 90 THEN g ELSE -g END AS gradient FROM (
    SELECT p_partkey, (p_size % 9 - 4)::DOUBLE AS g, least((p_size * 7 - p_partkey * 13 % 360 + 360000000) % 360, 360 - (p_size * 7 - p_partkey * 13 % 360 + 360000000) % 360) AS a FROM part)""")
def effective_gradient(spark, sf_dir):
    value = geo.effective_gradient((F.col("p_size") % 9 - 4).cast("double"), F.col("p_size") * 7.0, F.col("p_partkey") * 13 % 360)
    return table(spark, sf_dir, "part").select("p_partkey", value.alias("gradient"))


@query("""WITH RECURSIVE b(p_partkey, f, lo, hi, i) AS (SELECT p_partkey, 80.0 * 9.80665 * (sin(atan(g / 100)) + 0.005 * cos(atan(g / 100))), 1.25::DOUBLE, 12.5::DOUBLE, 0 FROM (SELECT p_partkey, (p_size % 13 - 6)::DOUBLE AS g FROM part)
    UNION ALL SELECT p_partkey, f, CASE WHEN (f + 0.5 * 1.2 * 0.32 * m * m) * m <= 120 THEN m ELSE lo END, CASE WHEN (f + 0.5 * 1.2 * 0.32 * m * m) * m <= 120 THEN hi ELSE m END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 12)) SELECT p_partkey, round((lo + hi) / 2, 4) AS speed_ms FROM b WHERE i = 12""")
def balanced_speed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.round(weather.balanced_speed((F.col("p_size") % 13 - 6).cast("double"), F.lit(0.005), 120.0), 4).alias("speed_ms"))


@query("""SELECT s_suppkey, round(t + 0.33 * h / 100 * 6.105 * exp(17.27 * t / (237.7 + t)) - 0.7 * w - 4, 6) AS apparent, CASE WHEN t >= 31 THEN 'danger' WHEN t >= 28 THEN 'severe' WHEN t >= 25 THEN 'warning' WHEN t >= 21 THEN 'caution' ELSE 'safe' END AS level
    FROM (SELECT s_suppkey, (s_suppkey % 40)::DOUBLE AS t, (s_suppkey % 90)::DOUBLE AS h, (s_suppkey % 11)::DOUBLE AS w FROM supplier)""")
def apparent_temperature(spark, sf_dir):
    t, h, w = ((F.col("s_suppkey") % n).cast("double") for n in (40, 90, 11))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(weather.apparent_temperature(t, h, w), 6).alias("apparent"), weather.heat_level(t).alias("level"))


@query("""SELECT o_orderkey, (floor((o_custkey % 500 * 1800 + o_totalprice / 10000 * 1.3 / 20.0 * 3600) / 3600) * 3600)::BIGINT AS hour FROM orders""")
def passage_hours(spark, sf_dir):
    """The hour in which a rider who starts at half hours passes a point some kilometres away."""
    hour = weather.passage_hour(F.timestamp_seconds(F.col("o_custkey") % 500 * 1800), F.col("o_totalprice") / 10_000, 20.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(hour).alias("hour"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END::INT AS rank FROM supplier""")
def warning_ranks(spark, sf_dir):
    names = F.array(*map(F.lit, ("大雨特別警報", "洪水警報", "強風注意報", "flood emergency")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", weather.warning_severity(F.get(names, (F.col("s_suppkey") % 4).cast("int"))).alias("rank"))


@query("""SELECT p_partkey, c // 65536 % 256 AS red, c // 256 % 256 AS green, c % 256 AS blue FROM (SELECT p_partkey, (round_even((p_partkey * 37 % 4000 + 0.26 - 400 + 10000) * 10, 0))::INT AS c FROM part)""")
def terrain_colours(spark, sf_dir):
    """Elevations as the colours of a terrain tile."""
    red, green, blue = spatial.terrain_rgb(F.col("p_partkey") * 37 % 4000 + 0.26 - 400)
    return table(spark, sf_dir, "part").select("p_partkey", red.alias("red"), green.alias("green"), blue.alias("blue"))


@query("""SELECT p_partkey, CASE WHEN contains(p_type, 'BRUSHED') THEN 'brush' WHEN contains(p_type, 'STEEL') THEN 'smith' WHEN contains(p_type, 'ECONOMY') THEN 'thrift' END AS chain FROM part""")
def chain_words(spark, sf_dir):
    """The chain of the first word that a name contains."""
    return table(spark, sf_dir, "part").select("p_partkey", places.chain_of(F.col("p_type"), {"BRUSHED": "brush", "STEEL": "smith", "ECONOMY": "thrift"}).alias("chain"))


@query("""SELECT c_custkey, round(avg(lon) OVER (PARTITION BY c_nationkey), 6) AS lon, round(avg(lat) OVER (PARTITION BY c_nationkey), 6) AS lat FROM (SELECT c_custkey, c_nationkey, 139 + c_custkey * 37 % 1000 / 1000.0 AS lon, 35 + c_custkey * 61 % 700 / 1000.0 AS lat FROM customer)""")
def mean_points(spark, sf_dir):
    """Each customer with the middle of its nation's customers."""
    lon, lat = place("c_custkey")
    middle = spatial.mean_point(["c_nationkey"])
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", lon.alias("lon"), lat.alias("lat")).select("c_custkey", F.round(middle[0], 6).alias("lon"), F.round(middle[1], 6).alias("lat"))


@query("""SELECT s_suppkey, lower(regexp_replace(s_name, '[ ・-]', '', 'g')) AS key, '0' || (312345678 + s_suppkey)::VARCHAR AS phone, 'shop' || s_suppkey || '.example.com/a/?utm=1#top' AS site FROM supplier""")
def contact_keys(spark, sf_dir):
    key = F.col("s_suppkey")
    number = F.concat(F.lit("+81 "), (312_345_678 + key).cast("string"))
    site = F.concat(F.lit("https://WWW.shop"), key, F.lit(".example.com/a/?utm=1#top"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.name_key(F.col("s_name")).alias("key"), text.phone(number).alias("phone"), text.website(site).alias("site"))


@query("""SELECT n_nationkey, array_to_string(list_sort(list_distinct([p || c || lower(n_name) || t, c || lower(n_name) || t, lower(n_name) || t] || CASE WHEN c <> '' THEN [p || lower(n_name) || t] ELSE [] END)), '|') AS keys FROM (SELECT *, n_regionkey || '県' AS p, CASE WHEN n_nationkey % 2 = 0 THEN '鶴郡' ELSE '' END AS c, CASE WHEN n_nationkey % 3 = 0 THEN '2-' ELSE '' END AS t FROM nation)""")
def place_keys(spark, sf_dir):
    """Nations as towns under a prefecture and, for every second, a county; every third with the tail of a block."""
    n = F.col("n_nationkey")
    names = F.array(F.concat(F.col("n_regionkey").cast("string"), F.lit("県")), F.when(n % 2 == 0, "鶴　郡").otherwise(""), F.concat(F.lit("大字 "), F.col("n_name")))
    levels = F.array(F.lit("prefecture"), F.lit("county"), F.lit("city"))
    tails = F.array(F.when(n % 3 == 0, "二丁目").otherwise(""))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.array_sort(text.place_keys(names, levels, tails)), "|").alias("keys"))


@query("""SELECT n_nationkey, unnest(list_distinct([r_name || n_name, n_name])) AS key FROM nation JOIN region ON r_regionkey = n_regionkey""")
def address_keys(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("n_nationkey", F.explode(text.search_keys(F.array("r_name", "n_name"))).alias("key"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) = 'OBJECT' AS is_object, list_contains(json_keys(props), 'k') AS has_k FROM events""")
def json_access(spark, sf_dir):
    doc = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_variant_get(doc, "$.k", "string").alias("k"), F.schema_of_variant(doc).startswith("OBJECT").alias("is_object"), F.array_contains(F.json_object_keys("props"), "k").alias("has_k")
    )


@query("""SELECT o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey)[1] AS first_part, list(l_partkey ORDER BY l_linenumber, l_partkey)[-1] AS last_part, len(list(DISTINCT l_suppkey)) AS suppliers, max(l_returnflag = 'R') AS any_returned FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def array_functions(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    own = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("rows"))
    return own.select(
        "o_orderkey", F.element_at("rows", 1)["l_partkey"].alias("first_part"), F.element_at("rows", -1)["l_partkey"].alias("last_part"),
        F.size(F.array_distinct(F.col("rows.l_suppkey"))).cast("long").alias("suppliers"), F.exists("rows", lambda r: r["l_returnflag"] == "R").alias("any_returned"),
    )


@query("""SELECT o_orderkey, pos, part FROM (SELECT o_orderkey, unnest(range(0, len(p))) AS pos, unnest(p) AS part FROM (SELECT l_orderkey AS o_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1))""")
def explode_ordinality(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("rows"))
    return own.select("o_orderkey", F.posexplode(F.col("rows.l_partkey")).alias("pos", "part")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 90.0 WHEN '2-HIGH' THEN 70.0 WHEN '3-MEDIUM' THEN 50.0 END AS score FROM orders""")
def map_lookup(spark, sf_dir):
    scores = F.create_map(*[F.lit(x) for pair in (("1-URGENT", 90.0), ("2-HIGH", 70.0), ("3-MEDIUM", 50.0)) for x in pair])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.try_element_at(scores, F.col("o_orderpriority")).alias("score"))


@query("""SELECT o_orderkey, epoch(date_trunc('hour', o_orderdate + INTERVAL 30 MINUTE))::BIGINT AS hour, strftime(o_orderdate, '%Y-%m') AS month, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS age FROM orders""")
def date_functions(spark, sf_dir):
    at = F.col("o_orderdate").cast("timestamp")
    hour = weather.nearest_hour(at, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(4_000_000_000)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.unix_timestamp(hour).alias("hour"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("long").alias("age")
    )


@query("""SELECT p_partkey, 'way-' || p_partkey || '-seg' || p_size || '-' || CASE WHEN p_size % 2 = 0 THEN 'fwd' ELSE 'bwd' END AS key, p_partkey AS way, p_size AS segment FROM part""")
def key_codec(spark, sf_dir):
    key = F.concat(F.lit("way-"), "p_partkey", F.lit("-seg"), "p_size", F.when(F.col("p_size") % 2 == 0, "-fwd").otherwise("-bwd"))
    back = lambda i, kind: F.regexp_extract("key", r"^way-(\d+)-seg(\d+)-", i).cast(kind)
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).select("p_partkey", "key", back(1, "long").alias("way"), back(2, "int").alias("segment"))


QUERIES, ORACLES = query.queries, query.oracles
