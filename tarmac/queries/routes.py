"""Route queries over orders as routes and their lines as the rows of a route."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import graph, routes
from tarmac.queries.registry import Registry, table
from tarmac.queries.scalar import _DISTANCE, place
from tarmac.storage import dealt

query = Registry()

#: Lines of an order in a total order; numbers of lines repeat.
_ROWS = """rows AS (SELECT l_orderkey AS route, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS step, l_suppkey AS tail, l_partkey % 100 AS head,
    l_quantity AS km, l_discount * 100 AS score, l_tax * 100 AS back, l_extendedprice AS price, l_returnflag AS flag FROM lineitem)"""


def _rows(spark, sf_dir):
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return dealt(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("route"), (F.row_number().over(by) - 1).alias("step"), F.col("l_suppkey").alias("tail"), (F.col("l_partkey") % 100).alias("head"), F.col("l_quantity").alias("km"),
        (F.col("l_discount") * 100).alias("score"), (F.col("l_tax") * 100).alias("back"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"),
    )


@query("SELECT o_orderkey FROM orders WHERE o_totalprice / 20 BETWEEN 18000 / 1.9 AND 22000 / 2.1")
def turning_ring(spark, sf_dir):
    low, high = routes.ring(20, 2, 1.9, 2.1)
    return table(spark, sf_dir, "orders").where((F.col("o_totalprice") / 20).between(low, high)).select("o_orderkey")


@query("""SELECT o_orderkey, coalesce(h + b * 1.0 >= 18000 AND CASE WHEN b * 0.4 > 4000 THEN h + b * 1.0 ELSE h + b * 1.4 END <= 22000, false) AS fits, round(abs(h + b * 1.2 - 20000), 6) AS miss
    FROM (SELECT o_orderkey, o_totalprice / 40 AS h, CASE WHEN o_custkey % 10 > 0 THEN o_custkey % 1500 * 10.0 END AS b FROM orders)""")
def relay_band(spark, sf_dir):
    head, back = F.col("o_totalprice") / 40, F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey") % 1500 * 10.0)
    fits, miss = routes.relay_band(head, back, 20, 2, 1.0, 1.4)
    return table(spark, sf_dir, "orders").select("o_orderkey", fits.alias("fits"), F.round(miss, 6).alias("miss"))


@query("""WITH c AS (SELECT s_suppkey, 500 + s_suppkey * 37 % 5000 AS d, (s_suppkey * 61 % 90) / 10.0 AS diff FROM supplier), g AS (SELECT *, d // 100 AS near FROM c),
    a AS (SELECT * FROM g x WHERE NOT EXISTS (SELECT 1 FROM g y WHERE y.near <= x.near AND y.diff <= x.diff AND (y.near < x.near OR y.diff < x.diff))), r AS (SELECT * FROM g WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a)),
    b AS (SELECT * FROM r x WHERE NOT EXISTS (SELECT 1 FROM r y WHERE y.near <= x.near AND y.diff <= x.diff AND (y.near < x.near OR y.diff < x.diff))), l AS (SELECT *, 0 AS layer FROM a UNION ALL SELECT *, 1 FROM b)
    SELECT s_suppkey, diff AS difficulty, layer, (row_number() OVER (ORDER BY coalesce(layer, 2), diff, d, s_suppkey))::INT AS position FROM g LEFT JOIN (SELECT s_suppkey, layer FROM l) USING (s_suppkey)""")
def candidate_ranking(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (500 + key * 37 % 5000).alias("d"), (100.0 * (1 + (key * 61 % 90) / 10.0 / 100)).alias("cost"), F.lit(100.0).alias("seconds"))
    return routes.ranked_candidates(rows, "s_suppkey", "d", "cost", "seconds", 1.0, layers=2).select("s_suppkey", "difficulty", "layer", "position")


@query("""SELECT s_suppkey, (SELECT min(least((b - c + 360) % 360, 360 - (b - c + 360) % 360)) FROM (VALUES (10.0), (200.0)) v(c))::DOUBLE AS gap FROM (SELECT s_suppkey, (s_suppkey * 47 % 360)::DOUBLE AS b FROM supplier)""")
def bearing_spread(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 47 % 360).cast("double").alias("b"), F.lit(0.0).alias("near"))
    return routes.spread_order(rows, spark.createDataFrame([(10.0,), (200.0,)], "b double"), "s_suppkey", "b", "near").select("s_suppkey", "gap")


_FAR = _DISTANCE.format(a0="lon", b0="lat", a1="x", b1="y")


@query(f"""SELECT c_custkey FROM (SELECT c_custkey, 139 + c_custkey * 37 % 1000 / 1000.0 AS lon, 35 + c_custkey * 61 % 700 / 1000.0 AS lat FROM customer)
    WHERE NOT EXISTS (SELECT 1 FROM (VALUES (139.2, 35.2), (139.7, 35.5)) v(x, y) WHERE {_FAR} < 15000)""")
def far_apart(spark, sf_dir):
    lon, lat = place("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    return routes.far_apart(rows, spark.createDataFrame([(139.2, 35.2), (139.7, 35.5)], "lon double, lat double"), 15_000).select("c_custkey")


@query("""WITH t AS (SELECT o_custkey AS node, min(o_totalprice) AS c, min(o_orderkey % 5000) AS l FROM orders GROUP BY 1), b AS (SELECT o_custkey AS node, max(o_totalprice) AS c, max(o_orderkey % 3000) AS l FROM orders GROUP BY 1),
    both_ AS (SELECT node, t.c + b.c AS cost, t.l + b.l AS length_m FROM t JOIN b USING (node)), best AS (SELECT node AS n, length_m AS l FROM both_ ORDER BY cost, node LIMIT 1)
    SELECT node, round(cost, 4) AS cost, length_m, node = n AS best FROM both_, best WHERE length_m <= l * 1.3""")
def via_nodes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    half = lambda f, n: orders.groupBy(F.col("o_custkey").alias("node")).agg(f("o_totalprice").alias("cost"), f(F.col("o_orderkey") % n).alias("length_m"))
    out = routes.via_nodes(half(F.min, 5000), half(F.max, 3000))
    return out.select("node", F.round("cost", 4).alias("cost"), "length_m", "best")


_HALVES = f"{_ROWS}, half AS (SELECT *, CASE WHEN coalesce(sum(km) OVER (PARTITION BY route ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < sum(km) OVER (PARTITION BY route) / 2 THEN 0 ELSE 1 END AS leg FROM rows)"


@query(f"WITH {_HALVES} SELECT route, step, leg FROM half")
def route_halves(spark, sf_dir):
    return routes.halves(_rows(spark, sf_dir), "route", "km").select("route", "step", "leg")


@query(f"WITH {_HALVES} SELECT route FROM (SELECT route, flag, count(DISTINCT leg) AS n FROM half GROUP BY 1, 2) GROUP BY 1 HAVING max(n) = 1")
def unshared_halves(spark, sf_dir):
    return routes.without_shared_halves(routes.halves(_rows(spark, sf_dir), "route", "km"), "route", "leg", "flag")


@query("""SELECT p_partkey, bin, p_retailprice * f AS seconds, round(p_retailprice * f * (1 + 2.0 * coalesce((CASE WHEN p_size % 3 > 0 THEN p_size ELSE 0 END + CASE WHEN m THEN (p_partkey + bin) % 50 * 2.0 ELSE 0 END) / nullif(CASE WHEN p_size % 3 > 0 THEN 1.0 ELSE 0 END + CASE WHEN m THEN 2.0 ELSE 0 END, 0), 0) / 100), 6) AS cost
    FROM (SELECT *, (p_partkey + bin) % 4 = 0 AS m, CASE WHEN (p_partkey + bin) % 4 = 0 THEN 1.25 ELSE 1.0 END AS f FROM part, (SELECT range::INT AS bin FROM range(0, 4)))""")
def leg_costs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fixed = F.col("p_size") % 3 > 0
    edges = part.select("p_partkey", F.col("p_retailprice").alias("seconds"), F.when(fixed, F.col("p_size").cast("double")).alias("fixed_score"), F.when(fixed, 1.0).alias("fixed_weight"))
    hours = part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("bin")).where((F.col("p_partkey") + F.col("bin")) % 4 == 0)
    hourly = hours.select("p_partkey", "bin", F.lit(1.25).alias("factor"), ((F.col("p_partkey") + F.col("bin")) % 50).cast("double").alias("score"), F.lit(2.0).alias("weight"))
    out = routes.leg_costs(edges, hourly, "p_partkey", 2.0)
    return out.select("p_partkey", "bin", "seconds", F.round("cost", 6).alias("cost"))


@query(f"""WITH RECURSIVE {_HALVES}, x AS (SELECT *, km * 60 AS s0, km * 90 AS s1, CASE WHEN flag = 'R' THEN 30.0 ELSE 5.0 END AS wait FROM half),
    walk AS (SELECT route, step, leg, 0 AS bin, 0.0::DOUBLE AS elapsed, CASE WHEN flag = 'A' THEN km * 1000 / 5.0 ELSE s0 END::DOUBLE AS seconds, false AS beyond, 0.0::DOUBLE AS clock, wait::DOUBLE AS wait FROM x WHERE step = 0
    UNION ALL SELECT route, step, leg, bin, elapsed, CASE WHEN flag = 'A' THEN km * 1000 / 5.0 WHEN bin = 0 THEN s0 ELSE s1 END, clock >= 3600, own, wait FROM (
        SELECT x.*, w.elapsed + w.seconds + w.wait AS elapsed, CASE WHEN x.leg = w.leg THEN w.clock + w.seconds ELSE 0 END AS clock, CASE WHEN x.leg = w.leg THEN w.clock + w.seconds + w.wait ELSE 0 END AS own,
        CASE WHEN x.leg = w.leg AND w.clock + w.seconds >= 1800 THEN 1 ELSE 0 END AS bin FROM walk w JOIN x ON x.route = w.route AND x.step = w.step + 1))
    SELECT route, step, bin, round(elapsed, 4) AS elapsed, round(seconds, 4) AS seconds, beyond FROM walk""")
def route_passages(spark, sf_dir):
    """Two bins of half an hour; rows flagged A have no known seconds."""
    rows = routes.halves(_rows(spark, sf_dir), "route", "km")
    known = F.array(F.when(F.col("flag") != "A", F.col("km") * 60), F.when(F.col("flag") != "A", F.col("km") * 90))
    rows = rows.select("route", "step", "leg", (F.col("km") * 1000).alias("distance_m"), F.when(F.col("flag") == "R", 30.0).otherwise(5.0).alias("wait"), known.alias("seconds_by_bin"))
    out = routes.passages(rows, "route", 2, 1800.0, 5.0)
    return out.select("route", "step", "bin", F.round("elapsed", 4).alias("elapsed"), F.round("seconds", 4).alias("seconds"), "beyond")


@query("""SELECT l_suppkey AS tail, l_partkey AS head, min(l_extendedprice) * CASE WHEN l_suppkey % 5 = 0 OR l_partkey % 5 = 0 THEN 8 ELSE 1 END AS cost FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2""")
def return_leg(spark, sf_dir):
    """Edges of the way back: what was travelled (either way) costs eight times as much."""
    edges = table(spark, sf_dir, "lineitem").where("l_suppkey <> l_partkey").groupBy(F.col("l_suppkey").alias("tail"), F.col("l_partkey").alias("head")).agg(F.min("l_extendedprice").alias("cost"))
    gone = edges.where("tail % 5 = 0 or head % 5 = 0").select(F.col("head").alias("tail"), F.col("tail").alias("head"))
    return routes.retrace_penalised(edges, gone).select("tail", "head", "cost")


@query("SELECT l_orderkey AS route, round(abs(sum(l_quantity) - 100), 4) AS miss_km FROM lineitem GROUP BY 1 HAVING abs(sum(l_quantity) - 100) <= 20")
def loops_within(spark, sf_dir):
    loops = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route")).agg(F.sum("l_quantity").alias("length_km"))
    return routes.loops_within(loops, 100, 20).select("route", F.round("miss_km", 4).alias("miss_km"))


@query(f"""WITH {_ROWS}, own AS (SELECT route, least(tail, head) AS x, greatest(tail, head) AS y, max(km) AS l FROM rows WHERE step >= 1 GROUP BY 1, 2, 3), total AS (SELECT route, sum(l) AS t FROM own GROUP BY 1)
    SELECT a.route, b.route AS other FROM own a JOIN own b ON a.x = b.x AND a.y = b.y AND b.route % 20 = 0 AND a.route <> b.route JOIN total t ON t.route = a.route GROUP BY 1, 2, t HAVING sum(a.l) > t * 0.4""")
def similar_loops(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return routes.similar_loops(rows, rows.where("route % 20 = 0"), "route", "tail", "head", "km", 0.4, prefix=1)


@query(f"""WITH {_ROWS}, m AS (SELECT route, sum(score * km) FILTER (flag <> 'N') / sum(km) FILTER (flag <> 'N') AS f, sum(back * km) FILTER (flag <> 'R') / sum(km) FILTER (flag <> 'R') AS r FROM rows GROUP BY 1)
    SELECT route, coalesce(r < f, r IS NOT NULL) AS reversed, round(CASE WHEN coalesce(r < f, r IS NOT NULL) THEN r ELSE f END, 6) AS difficulty FROM m""")
def easier_direction(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("score", F.when(F.col("flag") != "N", F.col("score"))).withColumn("back", F.when(F.col("flag") != "R", F.col("back")))
    out = routes.easier_direction(rows, "route", "score", "back", "km")
    return out.select("route", "reversed", F.round("difficulty", 6).alias("difficulty"))


@query(f"""WITH {_ROWS} SELECT route, max(step) OVER (PARTITION BY route) - step AS step, head AS tail, tail AS head FROM rows""")
def reversed_rows(spark, sf_dir):
    return routes.reversed_rows(_rows(spark, sf_dir), "route").select("route", "step", "tail", "head")


@query("""WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 31 % 97 END AS d, s_suppkey = (SELECT max(s_suppkey) FROM supplier) AS b FROM supplier),
    k AS (SELECT * FROM c ORDER BY CASE WHEN b THEN 0 ELSE 1 END, d IS NULL, d, s_suppkey LIMIT 8) SELECT s_suppkey, (row_number() OVER (ORDER BY d IS NULL, d, s_suppkey))::INT AS position, b AS baseline FROM k""")
def with_baseline(spark, sf_dir):
    """The eight easiest candidates, and the baseline whatever its rank."""
    suppliers = table(spark, sf_dir, "supplier")
    last = suppliers.agg(F.max("s_suppkey").alias("last"))
    key = F.col("s_suppkey")
    rows = suppliers.crossJoin(F.broadcast(last)).select("s_suppkey", F.when(key % 9 > 0, key * 31 % 97).alias("d"), (key == F.col("last")).alias("baseline"))
    return routes.with_baseline(rows, "s_suppkey", "d", "baseline", 8).select("s_suppkey", "position", "baseline")


@query(f"WITH {_ROWS} SELECT route, round(coalesce(sum(km) FILTER (flag = 'N'), 0) / sum(km), 6) AS missing FROM rows GROUP BY 1")
def missing_share(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("score", F.when(F.col("flag") != "N", F.col("score")))
    return routes.missing_share(rows, "route", "score", "km").select("route", F.round("missing", 6).alias("missing"))


@query(f"""WITH {_ROWS}, e AS (SELECT route, step, tail % 5 AS point, step * 2400 AS elapsed FROM rows) SELECT route, step, point * 10.0 + h AS speed FROM (SELECT *, least(greatest(floor((7200 + elapsed) / 3600.0 + 0.5), 3), 5)::INT AS h FROM e)""")
def winds_along(spark, sf_dir):
    entered = _rows(spark, sf_dir).select("route", "step", (F.col("tail") % 5).alias("point"), (F.col("step") * 2400).alias("elapsed"))
    winds = spark.range(5).select(F.col("id").alias("point"), F.explode(F.sequence(F.lit(3), F.lit(5))).alias("h")).select("point", F.timestamp_seconds(F.col("h") * 3600).alias("hour"), (F.col("point") * 10.0 + F.col("h")).alias("speed"))
    return routes.winds_at(entered, winds, F.timestamp_seconds(F.lit(7200))).select("route", "step", "speed")


@query(f"""WITH {_ROWS}, b AS (SELECT route, step // 3 AS bin, sum(score * km) FILTER (flag <> 'N') / sum(km) FILTER (flag <> 'N') AS v, sum(km) FILTER (flag <> 'N') AS d FROM rows GROUP BY 1, 2)
    SELECT route, round(sum(v * d) / sum(d) FILTER (v IS NOT NULL), 6) AS score FROM b GROUP BY 1""")
def route_raw_values(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("score", F.when(F.col("flag") != "N", F.col("score"))).withColumn("bin", F.floor(F.col("step") / 3))
    return routes.raw_values(rows, "route", "bin", "score", "km").select("route", F.round("score", 6).alias("score"))


@query(f"WITH {_ROWS} SELECT route, round(sum(score) FILTER (flag <> 'N'), 4) AS gain FROM rows GROUP BY 1")
def route_gain(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("gain", F.when(F.col("flag") != "N", F.col("score")))
    return routes.elevation_gain(rows, "route", "gain").select("route", F.round("gain", 4).alias("gain"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN [o_orderkey, o_custkey, o_custkey + 1, 7] ELSE [o_orderkey, o_custkey, o_custkey + 1, o_custkey + 1 + 1, 7] END::VARCHAR AS line FROM orders""")
def joined_lines(spark, sf_dir):
    """Three pieces of a line; where the next piece starts at the point before, it stands once."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pieces = [F.array(k, c), F.when(c % 2 == 0, F.array(c, c + 1)).otherwise(F.array(c, c + 1)), F.when(c % 2 == 0, F.array(c + 1, F.lit(7).cast("long"))).otherwise(F.array(c + 2, F.lit(7).cast("long")))]
    line = routes.joined_line(pieces)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("["), F.array_join(line.cast("array<string>"), ", "), F.lit("]")).alias("line"))


_CHAIN_EDGES = """edges AS (SELECT tail, head, min(cost) AS cost FROM (SELECT l_partkey % 200 AS tail, (l_suppkey * 7 + l_linenumber) % 200 AS head, round(l_quantity, 0) AS cost FROM lineitem) WHERE tail <> head GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {_CHAIN_EDGES}, walk(source, node, cost) USING KEY (source, node) AS (SELECT s, s, 0.0::DOUBLE FROM (VALUES (0::BIGINT), (101::BIGINT), (57::BIGINT)) v(s) UNION
    (SELECT w.source, e.head, min(w.cost + e.cost) FROM walk w JOIN edges e ON e.tail = w.node LEFT JOIN recurring.walk k ON k.node = e.head AND k.source = w.source WHERE k.cost IS NULL OR w.cost + e.cost < k.cost GROUP BY 1, 2)),
    legs AS (SELECT * FROM (VALUES (0, 0, 101), (1, 101, 57), (2, 57, 8)) v(leg, a, b)), c AS (SELECT leg, cost FROM legs LEFT JOIN walk ON source = a AND node = b)
    SELECT leg, cost, CASE WHEN coalesce(bool_and(cost IS NOT NULL) OVER w, true) THEN coalesce(sum(cost) OVER w, 0)::DOUBLE END AS clock FROM c WINDOW w AS (ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def fixed_points(spark, sf_dir):
    """Legs over fixed points, each starting when the one before ends."""
    from tarmac.queries.network import _edges

    return graph.legs(_edges(spark, sf_dir), [0, 101, 57, 8])


def _greedy(wanted, low, high, tie):
    """SQL of a greedy choice: candidates (req, route, position, bearing, closeness) and overlaps (i, j, r), one more a round."""
    return f"""pick(req, chosen, n) AS (SELECT DISTINCT req, []::BIGINT[], 0 FROM cand UNION ALL SELECT req, list_append(chosen, route), n + 1 FROM (
        SELECT req, chosen, n, route, row_number() OVER (PARTITION BY req ORDER BY CASE WHEN worst <= {low} THEN 0 ELSE 1 END, position, {tie}, route) AS rn FROM (
            SELECT p.req, p.chosen, p.n, c.route, c.position, c.closeness, (SELECT coalesce(max(r), 0) FROM ov WHERE i = c.route AND list_contains(p.chosen, j)) AS worst,
                (SELECT min(least((c.bearing - d.bearing + 360) % 360, 360 - (c.bearing - d.bearing + 360) % 360)) FROM cand d WHERE d.req = c.req AND list_contains(p.chosen, d.route)) AS gap
            FROM pick p JOIN cand c ON c.req = p.req AND NOT list_contains(p.chosen, c.route) WHERE p.n < {wanted}) WHERE worst <= {high}) WHERE rn = 1),
        picked AS (SELECT req, max_by(chosen, n) AS chosen FROM pick GROUP BY 1)
    SELECT req, unnest(chosen) AS route, generate_subscripts(chosen, 1)::INT AS choice FROM picked"""


_CANDIDATES = """segs AS (SELECT l_orderkey AS route, l_partkey % 40 AS s, max(l_quantity) AS l FROM lineitem GROUP BY 1, 2), total AS (SELECT route, sum(l) AS t FROM segs GROUP BY 1),
    cand AS (SELECT o_custkey AS req, o_orderkey AS route, {position} AS position, (o_orderkey * 47 % 360)::DOUBLE AS bearing, o_totalprice AS closeness FROM orders JOIN total ON route = o_orderkey),
    ov AS (SELECT a.route AS i, b.route AS j, sum(x.l) / t AS r FROM cand a JOIN cand b ON a.req = b.req AND a.route <> b.route JOIN segs x ON x.route = a.route JOIN segs y ON y.route = b.route AND y.s = x.s JOIN total ON total.route = a.route GROUP BY a.route, b.route, t)"""


def _candidates(spark, sf_dir, position):
    orders = table(spark, sf_dir, "orders")
    rows = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), (F.col("l_partkey") % 40).alias("segment"), F.col("l_quantity").alias("length")), "route")
    rows = rows.join(orders.select(F.col("o_orderkey").alias("route"), F.col("o_custkey").alias("req")), "route")
    return orders.select(F.col("o_custkey").alias("req"), F.col("o_orderkey").alias("route"), position.alias("position"), (F.col("o_orderkey") * 47 % 360).cast("double").alias("bearing"), F.col("o_totalprice").alias("closeness")), rows


@query("WITH RECURSIVE " + _CANDIDATES.format(position="row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)") + ", " + _greedy(4, 0.1, 0.3, "0"))
def diverse_routes(spark, sf_dir):
    """Every customer's orders as ranked candidates over segments: four that differ, at first by nine tenths of their length."""
    ranked = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"))
    candidates, rows = _candidates(spark, sf_dir, ranked)
    return routes.pick_diverse(candidates, rows, 4, (0.1, 0.3), ["req"])


@query("WITH RECURSIVE " + _CANDIDATES.format(position="floor(o_totalprice / 100000)") + ", " + _greedy(3, 0.15, 0.4, "coalesce(-gap, 1), closeness"))
def spread_routes(spark, sf_dir):
    """The same, of which candidates of one layer go by the widest angle from those already chosen."""
    candidates, rows = _candidates(spark, sf_dir, F.floor(F.col("o_totalprice") / 100_000))
    return routes.pick_diverse(candidates, rows, 3, (0.15, 0.4), ["req"], spread=True)


QUERIES, ORACLES = query.queries, query.oracles
