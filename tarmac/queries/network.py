"""Derivation and search on a network made of orders: customers and suppliers as nodes, lines as ways."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.operators import derive, graph, places, search, spatial
from tarmac.operators.components import connected
from tarmac.queries.registry import Registry, table
from tarmac.queries.scalar import _DISTANCE, place
from tarmac.storage import stored

query = Registry()


def _edges(spark, sf_dir):
    """A sparse directed graph on part keys: each line leads from its part to one derived from its supplier."""
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("tail"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 200).alias("head"), F.round(F.col("l_quantity"), 0).alias("cost"))
    return lines.where("tail <> head").groupBy("tail", "head").agg(F.min("cost").alias("cost"))


_EDGES = """edges AS (SELECT tail, head, min(cost) AS cost FROM (SELECT l_partkey % 200 AS tail, (l_suppkey * 7 + l_linenumber) % 200 AS head, round(l_quantity, 0) AS cost FROM lineitem) WHERE tail <> head GROUP BY 1, 2)"""


def _roads(spark, sf_dir):
    """A directed graph on all orders: each line leads from its order to one derived from its part and number."""
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(orders))  # one row
    head = (F.col("l_orderkey") * 3 + F.col("l_partkey") * 7 + F.col("l_linenumber") * 11) % F.col("n")
    edges = lines.select((F.col("l_orderkey") % F.col("n")).alias("tail"), head.alias("head"), F.col("l_extendedprice").alias("cost"))
    return stored(edges.where("tail <> head").groupBy("tail", "head").agg(F.min("cost").alias("cost")))


_ROADS = """roads AS (SELECT tail, head, min(cost) AS cost FROM (SELECT l_orderkey % n AS tail, (l_orderkey * 3 + l_partkey * 7 + l_linenumber * 11) % n AS head, l_extendedprice AS cost FROM lineitem, (SELECT count(*) AS n FROM orders)) WHERE tail <> head GROUP BY 1, 2)"""
_TREE = "{name}(node, cost) USING KEY (node) AS (SELECT {source}::BIGINT, 0.0::DOUBLE UNION (SELECT e.{head}, min(w.cost + e.cost) FROM {name} w JOIN roads e ON e.{tail} = w.node LEFT JOIN recurring.{name} k ON k.node = e.{head} WHERE (k.cost IS NULL OR w.cost + e.cost < k.cost) AND w.cost + e.cost <= {limit} GROUP BY 1))"
_WALK = _TREE.format(name="walk", source=0, head="head", tail="tail", limit="1e300")


@query(f"WITH RECURSIVE {_ROADS}, {_WALK} SELECT node, round(cost, 4) AS cost FROM walk")
def shortest_path_tree(spark, sf_dir):
    return search.tree(search.network(_roads(spark, sf_dir)), 0).select("node", F.round("cost", 4).alias("cost"))


@query(f"""WITH RECURSIVE {_ROADS}, {_WALK}, back(node, n) AS (SELECT 101::BIGINT, 0 UNION ALL SELECT e.tail, n + 1 FROM back JOIN roads e ON e.head = back.node JOIN walk a ON a.node = e.tail JOIN walk b ON b.node = e.head WHERE back.node <> 0 AND a.cost + e.cost = b.cost)
    SELECT (max(n) OVER () - n)::BIGINT AS step, node FROM back""")
def path_reconstruct(spark, sf_dir):
    tree = search.tree(search.network(_roads(spark, sf_dir)), 0)
    return search.ways(tree, spark.createDataFrame([(101,)], "target bigint")).select("step", "node")


@query(f"""WITH RECURSIVE {_ROADS}, {_TREE.format(name="there", source=0, head="head", tail="tail", limit=200000)}, {_TREE.format(name="back", source=101, head="tail", tail="head", limit=200000)}
    SELECT node, round(t.cost, 4) AS to_node, round(b.cost, 4) AS from_node, round(t.cost + b.cost, 4) AS through FROM there t JOIN back b USING (node)""")
def tree_junction(spark, sf_dir):
    roads = search.network(_roads(spark, sf_dir))
    there, back = search.tree(roads, 0, limit=200_000.0), search.tree(search.reverse(roads), 101, limit=200_000.0)
    return graph.junction(there, back).select("node", *[F.round(c, 4).alias(c) for c in ("to_node", "from_node", "through")])


_DX, _DY = (0, 1, 1, 1, 0, -1, -1, -1), (1, 1, 0, -1, -1, -1, 0, 1)


def _streets(spark, sf_dir, tile=256):
    """A street grid of all orders, row by row: each line is a street from its order's crossing to one of the eight around.

    ``d`` counts directions of 45 degrees from north.  Every fifth row is a primary road; each third crossing has a signal.
    """
    orders = table(spark, sf_dir, "orders").agg(F.count("*").alias("n")).withColumn("w", F.floor(F.sqrt("n")))
    lines = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(orders))  # one row
    step = lambda by: F.element_at(F.array(*[F.lit(v) for v in by]), F.col("d").cast("int") + 1)
    own = lines.select((F.col("l_orderkey") % F.col("n")).alias("tail"), ((F.col("l_linenumber") + F.col("l_orderkey")) % 8).alias("d"), (1000 + F.col("l_extendedprice") / 100).alias("cost"), "n", "w")
    own = own.withColumn("x", F.col("tail") % F.col("w") + step(_DX)).withColumn("y", F.floor(F.col("tail") / F.col("w")) + step(_DY))
    own = own.withColumn("head", F.col("y") * F.col("w") + F.col("x")).where("x >= 0 and x < w and y >= 0 and head < n")
    row = F.floor(F.col("tail") / F.col("w"))
    place = lambda v: F.concat_ws("-", F.floor(F.col(v) % F.col("w") / tile), F.floor(F.floor(F.col(v) / F.col("w")) / tile))
    rank = F.when((row % 5 == 0) & F.col("d").isin(2, 6), 4).otherwise(1)
    cut = own.groupBy("tail", "head", "d", "w").agg(F.min("cost").alias("cost"))
    return stored(cut.select((F.col("tail") * 8 + F.col("d")).alias("edge"), "tail", "head", "d", "cost", rank.alias("rank"), place("tail").alias("place"), place("head").alias("to_place"), (F.col("tail") % F.col("w")).alias("x"), row.alias("y"), "w"))


_STREETS = f"""size AS (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS w FROM orders),
    steps AS (SELECT l_orderkey % n AS tail, (l_linenumber + l_orderkey) % 8 AS d, 1000 + l_extendedprice / 100 AS cost, n, w FROM lineitem, size),
    moved AS (SELECT *, tail % w + ({list(_DX)})[d + 1] AS x, tail // w + ({list(_DY)})[d + 1] AS y FROM steps),
    streets AS (SELECT tail * 8 + d AS edge, tail, y * w + x AS head, d, min(cost) AS cost, CASE WHEN tail // w % 5 = 0 AND d IN (2, 6) THEN 4 ELSE 1 END AS rank FROM moved WHERE x >= 0 AND x < w AND y >= 0 AND y * w + x < n GROUP BY tail, d, x, y, w)"""


def _ends(streets):
    """A crossing a quarter in from the corner, and one three quarters in."""
    width = streets.agg(F.max("w")).first()[0]
    return width // 4 * width + width // 4, width * 3 // 4 * width + width * 3 // 4


def _places(streets):
    ends = streets.select(F.col("tail").alias("node"), "place").unionByName(streets.select(F.col("head").alias("node"), F.col("to_place").alias("place")))
    return ends.distinct()


def _turning(streets):
    """Streets with what turns need; the rank of a crossing is that of the streets that meet there."""
    bearing = (F.col("d") * 45).cast("double")
    return streets.withColumns({"bearing_in": bearing, "bearing_out": bearing, "signal": F.col("tail") % 3 == 0})


_TURNS = """ranks AS (SELECT node, max(rank) AS node_rank FROM (SELECT tail AS node, rank FROM streets UNION ALL SELECT head, rank FROM streets) GROUP BY 1),
    turns AS (SELECT a.edge, b.edge AS next, b.cost + CASE WHEN b.head = a.tail THEN 60.0 WHEN t <= 30 OR t >= 330 THEN 0.0 WHEN t >= 180 THEN 2.0 ELSE 12.0 END
        + CASE WHEN b.tail % 3 <> 0 AND node_rank >= 2 AND node_rank > a.rank AND b.head <> a.tail THEN CASE WHEN t <= 30 OR t >= 330 THEN 8.0 ELSE 15.0 END ELSE 0.0 END AS cost
        FROM streets a JOIN streets b ON b.tail = a.head JOIN ranks ON node = b.tail, LATERAL (SELECT ((b.d - a.d) * 45 + 360) % 360 AS t))"""
_KEYED = "{name}({key}, cost) USING KEY ({key}) AS (SELECT {start} UNION (SELECT {ids}, min(w.cost + e.cost) FROM {name} w JOIN {edges} e ON {on} LEFT JOIN recurring.{name} k ON {known} WHERE k.cost IS NULL OR w.cost + e.cost < k.cost GROUP BY {ids}))"
_START, _GOAL = "(SELECT w // 4 * w + w // 4 FROM size)", "(SELECT w * 3 // 4 * w + w * 3 // 4 FROM size)"
_FROM_START = _KEYED.format(name="walk", key="node", start=f"{_START}, 0.0::DOUBLE", ids="e.head", edges="streets", on="e.tail = w.node", known="k.node = e.head")


@query(f"WITH RECURSIVE {_STREETS}, {_TURNS}, " + _KEYED.format(name="ride", key="edge", start=f"edge, cost FROM streets WHERE tail = {_START}", ids="e.next", edges="turns", on="e.edge = w.edge", known="k.edge = e.next") + " SELECT edge, round(cost, 4) AS cost FROM ride")
def turn_tree(spark, sf_dir):
    """Cheapest rides from one crossing up to each street, turns and waits included."""
    streets = _streets(spark, sf_dir, 256)
    net = search.turn_network(_turning(streets), block_edges=1 << 21)
    seeds = streets.where(F.col("tail") == _ends(streets)[0]).select(F.col("edge").alias("node"), "cost")
    return search.solve(net, seeds).labels.select(F.col("node").alias("edge"), F.round("cost", 4).alias("cost"))


@query()
def binned_turn_tree(spark, sf_dir):
    """The same rides where a street's cost changes by the hour with its direction, as in a wind that turns; by three bins."""
    streets = _streets(spark, sf_dir, 256)
    by_bin = F.array(*[F.col("cost") * (1 + (F.col("d") + b) % 3 * 0.1) for b in range(3)])
    hourly = _turning(streets).withColumn("seconds", F.array(*[F.col("cost")] * 3)).withColumn("cost", by_bin)
    net = search.turn_network(hourly, block_edges=1 << 21)
    seeds = streets.where(F.col("tail") == _ends(streets)[0]).select(F.col("edge").alias("node"), F.element_at(by_bin, 1).alias("cost"), F.col("cost").alias("seconds"))
    found = search.solve(net, seeds, bin_seconds=3600.0 * 8).labels
    return found.select(F.col("node").alias("edge"), F.round("cost", 4).alias("cost"), F.round("seconds", 4).alias("seconds"))


def _landmarked(streets, wanted=4):
    net = search.network(streets.select("tail", "head", "cost"), _places(streets), 1 << 23)
    return search.with_landmarks(net, search.outermost(streets.select(F.col("tail").alias("node"), F.col("x").alias("lon"), F.col("y").alias("lat")), wanted))


@query(f"""WITH RECURSIVE {_STREETS}, {_FROM_START}, back(node, n) AS (SELECT {_GOAL}, 0 UNION ALL SELECT e.tail, n + 1 FROM back JOIN streets e ON e.head = back.node JOIN walk a ON a.node = e.tail JOIN walk b ON b.node = e.head WHERE back.node <> {_START} AND a.cost + e.cost = b.cost)
    SELECT (max(n) OVER () - n)::BIGINT AS step, node, round(cost, 4) AS cost FROM back JOIN walk USING (node)""")
def point_to_point(spark, sf_dir):
    """The cheapest way between two crossings half the grid apart, by landmark bounds."""
    streets = _streets(spark, sf_dir, 1024)
    net, away = _landmarked(streets)
    start, goal = _ends(streets)
    found = search.to_goal(net, away, start, goal)
    if found is None:
        return spark.createDataFrame([], "step bigint, node bigint, cost double")
    held = stored(found.labels)
    steps = search.ways(held, spark.createDataFrame([(goal,)], "target bigint"))
    return steps.join(held.select("node", F.round("cost", 4).alias("cost")), "node").select("step", "node", "cost")


_TARGETS = "targets AS (SELECT i AS search, (i + 1) * n // 9 AS node FROM size, range(8) t(i))"


@query(f"""WITH RECURSIVE {_STREETS}, {_FROM_START}, {_TARGETS}, way(search, node, was) AS (SELECT search, node, NULL::BIGINT FROM targets UNION ALL SELECT way.search, e.tail, e.head FROM way JOIN streets e ON e.head = way.node JOIN walk a ON a.node = e.tail JOIN walk b ON b.node = e.head WHERE way.node <> {_START} AND a.cost + e.cost = b.cost),
    gone AS (SELECT DISTINCT search, unnest([node, was]) AS tail, unnest([was, node]) AS head FROM way WHERE was IS NOT NULL), costs AS (SELECT t.search, e.tail, e.head, e.cost * CASE WHEN g.tail IS NULL THEN 1.0 ELSE 8.0 END AS cost FROM targets t, streets e LEFT JOIN gone g ON g.search = t.search AND g.tail = e.tail AND g.head = e.head),
    back(search, node, cost) USING KEY (search, node) AS (SELECT search, node, 0.0::DOUBLE FROM targets UNION (SELECT w.search, e.head, min(w.cost + e.cost) FROM back w JOIN costs e ON e.tail = w.node AND e.search = w.search LEFT JOIN recurring.back k ON k.node = e.head AND k.search = w.search WHERE k.cost IS NULL OR w.cost + e.cost < k.cost GROUP BY 1, 2)),
    home(node, cost) USING KEY (node) AS (SELECT {_START}, 0.0::DOUBLE UNION (SELECT e.tail, min(w.cost + e.cost) FROM home w JOIN streets e ON e.head = w.node LEFT JOIN recurring.home k ON k.node = e.tail WHERE k.cost IS NULL OR w.cost + e.cost < k.cost GROUP BY 1))
    SELECT t.search AS candidate, t.node, round(o.cost, 2) AS out_cost, round(b.cost, 2) AS back_cost, round(h.cost, 2) AS fastest FROM targets t LEFT JOIN walk o ON o.node = t.node LEFT JOIN back b ON b.search = t.search AND b.node = {_START} LEFT JOIN home h ON h.node = t.node""")
def return_legs(spark, sf_dir):
    """Eight candidates at once: out to each, back where what was travelled (either way) costs eight times as much, and the fastest way back."""
    streets = _streets(spark, sf_dir, 1024)
    net, away = _landmarked(streets)
    n = table(spark, sf_dir, "orders").count()
    targets = {i: (i + 1) * n // 9 for i in range(8)}
    start, _ = _ends(streets)
    out = stored(search.tree(net, start))
    rows = spark.createDataFrame(list(targets.items()), "candidate bigint, node bigint")
    steps = search.ways(out, rows.select(F.col("node").alias("target"))).join(out.select("node", "prev"), "node").where("prev is not null")
    used = steps.join(rows.select("candidate", F.col("node").alias("target")), "target").select(F.col("candidate").alias("search"), F.explode(F.array(F.struct(F.col("prev").alias("tail"), F.col("node").alias("head")), F.struct(F.col("node").alias("tail"), F.col("prev").alias("head")))).alias("e"))
    changes = used.select("search", "e.tail", "e.head", F.lit(8.0).alias("factor"))
    ways = {i: (v, start) for i, v in targets.items()}
    found = search.to_goals(net, away, ways | {len(ways) + i: pair for i, pair in ways.items()}, changes, 8.0)  # the latter over unchanged costs
    back, fastest = found.where(F.col("search") < len(ways)), found.where(F.col("search") >= len(ways)).withColumn("search", F.col("search") - len(ways))
    cost = lambda df, name: df.select(F.col("search").alias("candidate"), F.round("cost", 2).alias(name))
    return rows.join(out.select("node", F.round("cost", 2).alias("out_cost")), "node", "left").join(cost(back, "back_cost"), "candidate").join(cost(fastest, "fastest"), "candidate")


@query(f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT tail AS a, head AS b FROM edges UNION SELECT a, head FROM reach JOIN edges ON tail = b), nodes AS (SELECT tail AS n FROM edges UNION SELECT head FROM edges),
    mutual AS (SELECT n, n AS m FROM nodes UNION SELECT r.a, r.b FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a), named AS (SELECT n, min(m) AS root FROM mutual GROUP BY 1)
    SELECT n AS node FROM named WHERE root = (SELECT root FROM named GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)""")
def strong_component(spark, sf_dir):
    return graph.largest_strong_component(_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ROADS}, hub AS (SELECT node FROM (SELECT tail AS node FROM roads UNION ALL SELECT head FROM roads) GROUP BY 1 ORDER BY count(*) DESC, node LIMIT 1),
    there(node) AS (SELECT node FROM hub UNION SELECT head FROM there JOIN roads ON tail = node), back(node) AS (SELECT node FROM hub UNION SELECT tail FROM back JOIN roads ON head = node),
    own AS (SELECT node FROM there JOIN back USING (node)), nodes AS (SELECT tail AS node FROM roads UNION SELECT head FROM roads)
    SELECT node FROM own WHERE 2 * (SELECT count(*) FROM own) > (SELECT count(*) FROM nodes)""")
def strong_component_orders(spark, sf_dir):
    """The largest strong component of the graph on all orders; the SQL gives the one of the busiest node if it has over half of all nodes."""
    return graph.largest_strong_component(_roads(spark, sf_dir))


@query("""WITH RECURSIVE links AS (SELECT c_custkey AS a, c_custkey + 1 + c_nationkey AS b FROM customer WHERE c_acctbal > 5000 AND c_custkey + 1 + c_nationkey <= (SELECT max(c_custkey) FROM customer)),
    twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), walk AS (SELECT a AS node, a AS root FROM twoway UNION SELECT b, root FROM walk JOIN twoway ON a = node)
    SELECT node, min(root) AS root FROM walk GROUP BY 1""")
def components(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    last = customers.agg(F.max("c_custkey").alias("last"))
    links = customers.where("c_acctbal > 5000").crossJoin(F.broadcast(last)).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("b"), "last").where("b <= last")
    return connected(links.select("a", "b"))


_NEAR = _DISTANCE.format(a0="p.lon", b0="p.lat", a1="q.lon", b1="q.lat")


@query(f"""WITH RECURSIVE pts AS (SELECT s_suppkey, s_nationkey % 3 AS kind, 139 + s_suppkey * 37 % 1000 / 1000.0 AS lon, 35 + s_suppkey * 61 % 700 / 1000.0 AS lat FROM supplier),
    near AS (SELECT p.s_suppkey AS a, q.s_suppkey AS b FROM pts p JOIN pts q ON p.kind = q.kind WHERE {_NEAR} <= 6000), walk AS (SELECT a AS n, a AS root FROM near UNION SELECT b, root FROM walk JOIN near ON a = n)
    SELECT n AS s_suppkey, min(root) AS cluster FROM walk GROUP BY 1""")
def components_eps(spark, sf_dir):
    lon, lat = place("s_suppkey")
    points = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("kind"), lon.alias("lon"), lat.alias("lat"))
    return spatial.clusters(points, "s_suppkey", 6000, ["kind"])


@query(f"""WITH {_EDGES} SELECT a.tail, a.head, b.head AS next, CASE WHEN b.head = a.tail THEN 60.0 WHEN least(t, 360 - t) <= 30 THEN 0.0 WHEN t >= 180 THEN 2.0 ELSE 12.0 END::DOUBLE AS seconds
    FROM edges a JOIN edges b ON b.tail = a.head, LATERAL (SELECT ((b.head * 13 % 360) - (a.head * 13 % 360) + 360) % 360 AS t)""")
def turn_costs(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    name = F.concat_ws("-", "tail", "head")
    own = edges.select(
        name.alias("edge"), "tail", "head", (F.col("head") * 13 % 360).cast("double").alias("bearing_out"), (F.col("head") * 13 % 360).cast("double").alias("bearing_in"),
        F.lit(0).alias("rank"), F.lit(False).alias("signal"), F.lit(0).alias("node_rank"),
    )
    pairs = graph.transitions(own)
    part = lambda c, i: F.split(c, "-")[i].cast("long")
    return pairs.select(part("edge", 0).alias("tail"), part("edge", 1).alias("head"), part("next", 1).alias("next"), "seconds")


@query("""SELECT tail, head, edge, cost FROM (SELECT tail, head, edge, cost, row_number() OVER (PARTITION BY tail, head ORDER BY cost, edge) AS n FROM (
    SELECT CASE WHEN f THEN a ELSE b END AS tail, CASE WHEN f THEN b ELSE a END AS head, o_orderkey AS edge, o_totalprice AS cost FROM (SELECT o_orderkey, o_custkey % 50 AS a, o_orderkey % 37 AS b, o_totalprice, o_orderkey % 4 AS m FROM orders), (VALUES (true), (false)) v(f) WHERE NOT (m = 0 AND NOT f) AND NOT (m = 1 AND f))) WHERE n = 1""")
def directed_edges(spark, sf_dir):
    """Both directions of each segment but for one-way ones; the cheapest of parallel edges."""
    m = F.col("o_orderkey") % 4
    ways = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("edge"), (F.col("o_custkey") % 50).alias("from_node"), (F.col("o_orderkey") % 37).alias("to_node"), F.col("o_totalprice").alias("cost"), F.when(m == 0, "forward").when(m == 1, "backward").otherwise("both").alias("direction")
    )
    return graph.single_edges(graph.directed(ways).select("tail", "head", "edge", "cost"))


def _ways(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("node")).groupBy("l_orderkey", "l_linenumber").agg(F.min("node").alias("node"))
    x, y = 139 + F.col("node") * 37 % 1000 / 1000.0, 35 + F.col("node") * 61 % 700 / 1000.0
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "node", x.alias("lon"), y.alias("lat"))))
    return lines.groupBy(F.col("l_orderkey").alias("way")).agg(rows.alias("r")).select("way", F.col("r.node").alias("node_ids"), F.transform("r", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points")).where(F.size("node_ids") > 1)


_SEGMENTS = """v AS (SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos, node, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS node FROM lineitem GROUP BY 1, 2)),
    w AS (SELECT way, pos, node, n, 139 + node * 37 % 1000 / 1000.0 AS lon, 35 + node * 61 % 700 / 1000.0 AS lat FROM v WHERE n > 1), c AS (SELECT *, count(*) OVER (PARTITION BY node) AS passes FROM w),
    cuts AS (SELECT way, pos AS s, node AS a, lead(pos) OVER o AS e, lead(node) OVER o AS b FROM c WHERE passes > 1 OR pos = 0 OR pos = n - 1 WINDOW o AS (PARTITION BY way ORDER BY pos)),
    spans AS (SELECT way, s, e FROM cuts WHERE e IS NOT NULL AND NOT (a = b AND e - s > 1) UNION ALL SELECT way, s, (s + e) // 2 FROM cuts WHERE a = b AND e - s > 1 UNION ALL SELECT way, (s + e) // 2, e FROM cuts WHERE a = b AND e - s > 1),
    seg AS (SELECT x.way, (row_number() OVER (PARTITION BY x.way ORDER BY s) - 1)::INT AS segment, s, e, p.node AS from_node, q.node AS to_node, p.lon AS lon0, p.lat AS lat0, q.lon AS lon1, q.lat AS lat1 FROM spans x JOIN w p ON p.way = x.way AND p.pos = s JOIN w q ON q.way = x.way AND q.pos = e WHERE p.node <> q.node)"""
_HEADING = "(degrees(atan2(sin(radians({a1} - {a0})) * cos(radians({b1})), cos(radians({b0})) * sin(radians({b1})) - sin(radians({b0})) * cos(radians({b1})) * cos(radians({a1} - {a0})))) + 360) % 360"


@query(f"WITH {_SEGMENTS} SELECT way, segment, from_node, to_node FROM seg")
def topology(spark, sf_dir):
    return derive.segments(_ways(spark, sf_dir)).select("way", "segment", "from_node", "to_node")


@query(f"""WITH {_SEGMENTS}, legs AS (SELECT way, pos, lon, lat, lead(lon) OVER o AS lon2, lead(lat) OVER o AS lat2 FROM w WINDOW o AS (PARTITION BY way ORDER BY pos)), d AS (SELECT seg.way, segment, sum({_DISTANCE.format(a0="lon", b0="lat", a1="lon2", b1="lat2")}) AS m FROM seg JOIN legs ON legs.way = seg.way AND pos >= s AND pos < e GROUP BY 1, 2)
    SELECT way, segment, (e - s + 1)::INT AS nodes, round(m, 3) AS distance_m, round({_HEADING.format(a0="lon0", b0="lat0", a1="lon1", b1="lat1")}, 6) AS bearing_deg, round({_HEADING.format(a0="lon1", b0="lat1", a1="lon0", b1="lat0")}, 6) AS reverse_bearing_deg FROM seg JOIN d USING (way, segment)""")
def segment_geometry(spark, sf_dir):
    out = derive.segments(_ways(spark, sf_dir))
    return out.select("way", "segment", F.size("node_ids").alias("nodes"), F.round("distance_m", 3).alias("distance_m"), F.round("bearing_deg", 6).alias("bearing_deg"), F.round("reverse_bearing_deg", 6).alias("reverse_bearing_deg"))


@query(f"""WITH {_SEGMENTS}, nodes AS (SELECT DISTINCT node, lon, lat FROM w), near AS (SELECT DISTINCT p.node FROM nodes p, nodes q WHERE q.node % 20 = 0 AND {_NEAR} <= 2500),
    ends AS (SELECT node, max(CASE WHEN way % 4 = 0 THEN 4 ELSE 1 END) AS rank FROM (SELECT way, unnest([from_node, to_node]) AS node FROM seg) GROUP BY 1) SELECT node, node IN (SELECT node FROM near) AS signal, rank FROM ends""")
def node_turns(spark, sf_dir):
    ways = _ways(spark, sf_dir)
    nodes = ways.select(F.explode(F.arrays_zip(F.col("node_ids").alias("node"), F.col("points").alias("p"))).alias("z")).select(F.col("z.node").alias("node"), "z.p.lon", "z.p.lat").distinct()
    kinds = ways.select("way", F.when(F.col("way") % 4 == 0, "primary").otherwise("residential").alias("highway"))
    return derive.node_turns(derive.segments(ways), kinds, nodes, nodes.where("node % 20 = 0"), 2500.0)


@query(f"""WITH RECURSIVE {_SEGMENTS}, stops AS (SELECT DISTINCT node, lon, lat, CASE WHEN node % 2 = 0 THEN 'signal' ELSE 'crossing' END AS kind FROM w WHERE node % 3 = 0), near AS (SELECT p.node AS a, q.node AS b FROM stops p JOIN stops q ON p.kind = q.kind WHERE {_NEAR} <= 2000),
    walk AS (SELECT a AS x, a AS root FROM near UNION SELECT b, root FROM walk JOIN near ON a = x), placed AS (SELECT x AS node, min(root) AS cluster FROM walk GROUP BY 1),
    touched AS (SELECT seg.way, segment, kind, cluster, sum((w.node = from_node)::INT + (w.node = to_node)::INT) AS ends FROM seg JOIN w ON w.way = seg.way AND pos BETWEEN s AND e JOIN stops ON stops.node = w.node JOIN placed ON placed.node = w.node GROUP BY 1, 2, 3, 4)
    SELECT way, segment, kind, sum(CASE ends WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS n FROM touched GROUP BY 1, 2, 3""")
def stop_counts(spark, sf_dir):
    ways = stored(_ways(spark, sf_dir))  # read for segments, twice, and for stops
    nodes = ways.select(F.explode(F.arrays_zip(F.col("node_ids").alias("node"), F.col("points").alias("p"))).alias("z")).select(F.col("z.node").alias("node"), "z.p.lon", "z.p.lat").distinct()
    stops = nodes.where("node % 3 = 0").withColumn("kind", F.when(F.col("node") % 2 == 0, "signal").otherwise("crossing"))
    return derive.place_counts(derive.segments(ways), stored(stops), 2000.0)


@query(f"""WITH {_SEGMENTS}, ends AS (SELECT way, segment, unnest([from_node, to_node]) AS node FROM seg), b AS (SELECT node, count(*) AS n FROM ends GROUP BY 1) SELECT way, segment, count(*) FILTER (n >= 3) * 0.5::DOUBLE AS n FROM ends JOIN b USING (node) GROUP BY 1, 2""")
def intersection_counts(spark, sf_dir):
    return derive.intersection_counts(derive.segments(_ways(spark, sf_dir)))


@query("""SELECT s_suppkey AS node, min_by(kind, priority) AS kind FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['stop', 'gate'] WHEN s_suppkey % 3 = 1 THEN ['gate'] ELSE ['none'] END) AS value FROM supplier) JOIN (VALUES ('stop', 'stop', 1), ('gate', 'barrier', 2)) r(value, kind, priority) USING (value) GROUP BY 1""")
def node_kinds(spark, sf_dir):
    rules = spark.createDataFrame([("highway", "stop", "stop", 1), ("barrier", "gate", "barrier", 2)], "tag string, value string, kind string, priority int")
    m = F.col("s_suppkey") % 3
    tags = F.when(m == 0, F.create_map(F.lit("highway"), F.lit(" Stop;other"), F.lit("barrier"), F.lit("gate"))).when(m == 1, F.create_map(F.lit("barrier"), F.lit("gate"))).otherwise(F.create_map(F.lit("barrier"), F.lit("none")))
    return derive.classify_nodes(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), tags.alias("tags")), rules)


@query(f"""WITH RECURSIVE s AS (SELECT s_suppkey AS id, 'Shop ' || s_suppkey % 7 AS name, s_acctbal / 10000 AS conf, s_suppkey % 40 AS phone, 139 + s_suppkey * 37 % 1000 / 1000.0 AS lon, 35 + s_suppkey * 61 % 700 / 1000.0 AS lat FROM supplier),
    c AS (SELECT phone FROM (SELECT phone, count(*) AS n, min(lon) AS a, min(lat) AS b, max(lon) AS c, max(lat) AS d FROM s GROUP BY 1) WHERE n > 1 AND {_DISTANCE.format(a0="a", b0="b", a1="c", b1="d")} <= 50000),
    r AS (SELECT *, CASE WHEN phone IN (SELECT phone FROM c) THEN min(id) OVER (PARTITION BY phone) ELSE id END AS root FROM s), kept AS (SELECT * FROM s WHERE id IN (SELECT min_by(id, (-conf, id)) FROM r GROUP BY root)),
    near AS (SELECT p.id AS a, q.id AS b FROM kept p JOIN kept q ON p.name = q.name WHERE {_NEAR} <= 20000), walk AS (SELECT a AS x, a AS root FROM near UNION SELECT b, root FROM walk JOIN near ON a = x), roots AS (SELECT x AS id, min(root) AS root FROM walk GROUP BY 1)
    SELECT id, 'food' AS "group", name FROM kept WHERE id IN (SELECT min_by(id, (-conf, id)) FROM kept JOIN roots USING (id) GROUP BY root)""")
def stop_places(spark, sf_dir):
    """Suppliers as shops: grouped, merged by contact and by name."""
    lon, lat = place("s_suppkey")
    key = F.col("s_suppkey")
    shops = table(spark, sf_dir, "supplier").select(
        key.alias("id"), F.concat(F.lit("Shop "), (key % 7).cast("string")).alias("name"), (F.col("s_acctbal") / 10_000).alias("confidence"), F.array(F.when(key % 2 == 0, "cafe").otherwise("bakery")).alias("categories"),
        F.array(F.concat(F.lit("+81 3"), (key % 40).cast("string"))).alias("phones"), F.array().cast("array<string>").alias("websites"), lon.alias("lon"), lat.alias("lat"),
    )
    found = places.grouped(shops, {"food": ["cafe", "bakery"]})
    return places.merge_by_name(places.merge_by_contact(found, 50_000.0), 20_000.0).select("id", "group", "name")


@query(f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT tail AS a, head AS b FROM edges UNION SELECT a, head FROM reach JOIN edges ON tail = b), mutual AS (SELECT r.a AS n, r.b AS m FROM reach r JOIN reach s ON r.a = s.b AND r.b = s.a), named AS (SELECT n, min(m) AS root FROM mutual GROUP BY 1),
    q AS (SELECT n AS node, 139 + n * 37 % 1000 / 1000.0 AS lon, 35 + n * 61 % 700 / 1000.0 AS lat FROM named WHERE root = (SELECT root FROM named GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)), p AS (SELECT c_custkey, 139.003 + c_custkey * 37 % 1000 / 1000.0 AS lon, 35 + c_custkey * 61 % 700 / 1000.0 AS lat FROM customer)
    SELECT c_custkey, min_by(node, (round(d, 6), node)) AS node FROM (SELECT c_custkey, node, {_NEAR} AS d FROM p, q) WHERE d <= 5000 GROUP BY 1""")
def snapped_points(spark, sf_dir):
    """Customers to their nearest node of the largest component, within five kilometres."""
    nodes = graph.largest_strong_component(_edges(spark, sf_dir))
    lon, lat = place("node")
    own = nodes.select("node", lon.alias("lon"), lat.alias("lat"))
    lon, lat = place("c_custkey")
    points = table(spark, sf_dir, "customer").select("c_custkey", (lon + 0.003).alias("lon"), lat.alias("lat"))
    return spatial.nearest(points, own, "c_custkey", "node", 5000).select("c_custkey", "node")


@query("""WITH e AS (SELECT o_orderkey AS edge, o_custkey % 7 AS tail, o_orderkey % 7 AS head FROM orders), r AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step, l_partkey * 3 AS edge FROM lineitem),
    k AS (SELECT path, step, tail, lag(head) OVER (PARTITION BY path ORDER BY step) AS before FROM r LEFT JOIN e USING (edge)) SELECT path, step::INT AS step FROM k WHERE tail IS NULL OR before <> tail""")
def path_breaks(spark, sf_dir):
    """Steps of orders, read as paths over other orders, that are no edge or do not start where the one before ended."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.row_number().over(by).alias("step"), (F.col("l_partkey") * 3).alias("edge"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("edge"), (F.col("o_custkey") % 7).alias("tail"), (F.col("o_orderkey") % 7).alias("head"))
    return graph.check_path(rows, edges).select("path", "step")


QUERIES, ORACLES = query.queries, query.oracles
