"""Shapes that larger tables have and the small ones do not: repeated keys, many rows in one place."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__
from tarmac.operators import aggregates, lines, places, routes, search, spatial
from tarmac.queries import network
from tarmac.storage import stored

SQL = __spark_entry__.oracle_sql()
QUERIES = __spark_entry__.queries()


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def by_sql(folder, name):
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}/*.parquet'")
    return sorted(con.execute(SQL[name]).fetchall())


def same_as_sql(spark, folder, name):
    found = sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())
    assert found == by_sql(folder, name)
    return found


def test_lateral_lookup_of_repeated_customers(spark, tmp_path):
    orders = [(1, 7, 5.0), (2, 7, 9.0), (3, 7, 9.0), (4, 8, 1.0), (None, 8, 1.0)]
    written(spark, tmp_path, customer=([(7,), (7,), (8,), (9,)], "c_custkey bigint"), orders=(orders, "o_orderkey bigint, o_custkey bigint, o_totalprice double"))
    assert same_as_sql(spark, tmp_path, "lateral_lookup") == [(7, 2), (8, 4)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_of_pieces_are_not_broadcast(spark):
    point = F.struct(F.lit(139.0).alias("lon"), F.lit(35.0).alias("lat"))
    roads = spark.range(20).select(F.col("id").alias("road"), F.array(point, F.struct((139.01 + F.col("id") * 1e-4).alias("lon"), F.lit(35.003).alias("lat"))).alias("points"))
    spots = spark.range(400).select(F.col("id").alias("p"), (139.0 + F.col("id") % 2 * 0.01).alias("lon"), F.lit(35.0).alias("lat"))
    got = lines.nearest_line(spots, roads, "p", "road", 600.0)
    assert "BroadcastHashJoin" not in plan(lines.near_lines(spots, roads, 600.0))
    assert {r.p: r.road for r in got.collect()} == {p: p % 2 * 19 for p in range(400)}  # the flattest line passes nearest


def test_rows_of_one_place_meet_once(spark):
    """Two thousand rows a side in one place: four million pairs of rows, one pair of places."""
    left = spark.range(2000).select(F.col("id").alias("a"), F.lit(139.7).alias("lon"), F.lit(35.6).alias("lat"))
    right = spark.range(2000).select((F.col("id") + 5).alias("b"), F.lit(139.7).alias("lon"), F.lit(35.6001).alias("lat"))
    assert spatial._near_spots(left, right, 100.0).count() == 1
    assert "BroadcastHashJoin" not in plan(spatial._near_spots(left, right, 100.0))
    assert spatial.within(left, right, 100.0).count() == 4_000_000
    assert {(r.b, r["count"]) for r in spatial.nearest(left, right, "a", "b", 100.0).groupBy("b").count().collect()} == {(5, 2000)}
    assert spatial.near_any(left, right, "a", 100.0).count() == 2000


def test_cells_of_several_places_count_once(spark):
    zones = spark.createDataFrame([(1, 139.7, 35.6), (1, 139.7001, 35.6), (2, 139.7, 35.6), (3, 139.9, 35.6)], "z int, lon double, lat double")
    cells = spark.createDataFrame([(10, 1, 139.7, 35.6001), (11, 1, 139.7, 35.6001), (12, 2, 139.7, 35.6001), (12, 2, 139.7001, 35.6001), (13, None, 139.7, 35.6001)], "cell int, class int, lon double, lat double")
    got = {(r.z, r["class"], r["count"]) for r in spatial.zonal_counts(zones, cells, "z", 100.0).collect()}
    assert got == {(z, c, n) for z in (1, 2) for c, n in ((1, 2), (2, 1), (None, 1))}


def test_divided_roads_of_one_shape(spark, tmp_path, monkeypatch):
    """Five hundred roads each way on the same two lines: shapes meet, not roads."""
    seen = []
    monkeypatch.setattr(lines, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    line = lambda lat: F.array(*[F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")) for lon in (139.0, 139.0009)])
    key = F.col("id")
    ways = spark.range(1000).select(key.alias("way"), F.when(key % 2 == 0, line(35.0)).otherwise(line(35.0001)).alias("points"), F.when(key % 2 == 0, "forward").otherwise("backward").alias("direction"),
        F.lit("primary").alias("highway"), F.lit(None).cast("string").alias("carriageway"), F.lit(None).cast("string").alias("ref"), F.when(key % 4 < 2, "n").alias("name"))
    ways = ways.unionByName(ways.where("way = 0").withColumns({"way": F.lit(-1).cast("long"), "highway": F.lit("service")}))
    assert {(r.way, r.divided) for r in lines.divided(ways).collect()} == {(i, True) for i in range(-1, 1000)}
    assert [df.count() for df in seen] == [5, 2]
    both = ways.where("way = 0").unionByName(ways.where("way = 1").withColumn("way", F.lit(0).cast("long")))
    assert not any(r.divided for r in lines.divided(both).collect())  # a road is not beside itself


def test_tree_over_blocks_dealt_by_hash(spark, monkeypatch):
    """The labels of one block, with ties and free edges, without solving blocks again."""
    i = F.col("id")
    edges = spark.range(4000).select((i % 500).alias("tail"), ((i * 7 + F.floor(i / 500) * 13) % 500).alias("head"), (i * 31 % 4).cast("double").alias("cost")).where("tail <> head").groupBy("tail", "head").agg(F.min("cost").alias("cost"))
    costs = lambda df: {(r.node, r.cost, r.seconds) for r in df.collect()}
    one, many = search.network(edges), search.network(edges, block_edges=500)
    want = costs(search.tree(one, 0))
    short = costs(search.tree(one, 0, limit=3.0))
    paid = edges.withColumn("cost", F.col("cost") + 1)
    labels = {tuple(r) for r in search.tree(search.network(paid), 0).collect()}
    monkeypatch.setattr(search, "solve", None)
    assert many.blocks > 1 and costs(search.tree(many, 0)) == want and costs(search.tree(many, 0, limit=3.0)) == short
    assert {tuple(r) for r in search.tree(search.network(paid, block_edges=500), 0).collect()} == labels


def test_tiles_of_a_street_grid_fit_a_block():
    import inspect

    tile = inspect.signature(network._streets).parameters["tile"].default
    assert tile * tile * 8 <= inspect.signature(search.network).parameters["block_edges"].default


def test_tiles_of_a_goal_search_are_wide(spark, tmp_path, monkeypatch):
    """Tiles of 1024 crossings, which a block holds whole: fewer borders, and so fewer rounds."""
    tiles, sizes = [], []
    own, net = network._streets, search.network
    monkeypatch.setattr(network, "_streets", lambda spark, sf_dir, tile=256: tiles.append(tile) or own(spark, sf_dir, tile))
    monkeypatch.setattr(search, "network", lambda edges, places=None, size=1 << 20: sizes.append(size) or net(edges, places, size))
    written(spark, tmp_path, orders=([(i,) for i in range(64)], "o_orderkey long"), lineitem=([(i % 64, i // 64, 100.0 * (i * 37 % 91)) for i in range(512)], "l_orderkey long, l_linenumber int, l_extendedprice double"))
    assert same_as_sql(spark, tmp_path, "point_to_point") and tiles == [1024] and tiles[0] ** 2 * 8 <= sizes[0]


def test_return_legs_search_all_ways_back_at_once(spark, tmp_path, monkeypatch):
    seen = []
    real = search.to_goals
    monkeypatch.setattr(search, "to_goals", lambda net, away, pairs, *a, **k: seen.append(len(pairs)) or real(net, away, pairs, *a, **k))
    written(spark, tmp_path, orders=([(i,) for i in range(64)], "o_orderkey long"), lineitem=([(i % 64, i // 64, 100.0 * (i * 37 % 91)) for i in range(512)], "l_orderkey long, l_linenumber int, l_extendedprice double"))
    assert len(same_as_sql(spark, tmp_path, "return_legs")) == 8 and seen == [16]


def test_rows_are_dealt_by_their_number(spark):
    from tarmac.storage import dealt

    assert dealt(spark.range(1000), "id", rows=100).rdd.getNumPartitions() == 10


def test_linked_names_are_dealt(spark):
    """One file of short names: its many candidates are made in several tasks; a name of several ids is met once."""
    left = spark.range(100, 140).select(F.col("id").alias("left_id"), F.col("id").cast("string").alias("name")).coalesce(1)
    right = spark.createDataFrame([(9, "1"), (7, "1"), (5, "112"), (6, "39")], "right_id long, name string")
    got = places.link_names(left, right)
    assert "REPARTITION_BY_NUM" in plan(got)
    assert {r.left_id: (r.right_id, r["rank"]) for r in got.collect()} == {i: (5, 0) if i == 112 else (7, 1) for i in range(100, 140)}


def test_rings_of_one_line_are_counted_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lines, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    line = lambda lat: F.array(*[F.struct(F.lit(lon).alias("lon"), F.lit(lat).alias("lat")) for lon in (139.001, 139.004)])
    own = spark.range(50).select(F.col("id").alias("k"), line(35.0).alias("points"))
    both = spark.createDataFrame([(50,), (51,)], "k long").crossJoin(own.select("points").limit(1).unionByName(spark.range(1).select(line(35.001).alias("points"))))
    tiles = spark.range(-4, 8).select((F.col("id") + 139 * 250).alias("tx")).crossJoin(spark.range(-4, 8).select((F.col("id") + 35 * 250).alias("ty"))).withColumn("pixels", F.array_repeat(F.lit(1), 16))
    got = {r.k: r.n for r in lines.ring_counts(own.unionByName(own).unionByName(both), tiles, "k", 10.0, 900.0, 0.001, 4).collect()}
    assert [df.count() for df in seen] == [2] and len(got) == 52 and len({got[k] for k in range(50)}) == 1
    assert got[0] < got[50] == got[51] < 2 * got[0]  # a pixel near both lines counts once


def test_clips_are_computed_once(spark, tmp_path):
    rows = [(i % 40, i * 31, i % 7, i // 40 + 1) for i in range(200)]
    written(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))
    for name, used in (("clipped_lines", 3), ("clipped_rings", 3)):
        found = plan(QUERIES[name](spark, str(tmp_path)))
        assert found.count("sequence(0, (size(points") <= 1 and found.count("4160.0") <= used and "- Filter " not in found


def test_few_keys_of_a_histogram_are_broadcast(spark):
    """Three keys would be three tasks of a join, whatever the table's size."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("w"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = aggregates.weighted_histogram(df, ["k"], "v", "w")
        assert plan(got).count("BroadcastHashJoin") == 1 and {r.n for r in got.groupBy("k").agg(F.sum("w").alias("n")).collect()} == {1000.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_unshared_halves_in_one_shuffle(spark, tmp_path):
    rows = [(i % 40, i, i % 7, i // 40 + 1, float(i % 5 + 1), 1.0, 0.0, 0.0, "ANR"[i % 3]) for i in range(200)]
    written(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"))
    same_as_sql(spark, tmp_path, "unshared_halves")
    found = plan(QUERIES["unshared_halves"](spark, str(tmp_path)))
    assert "REPARTITION_BY_NUM" in found and found.count("Exchange ") == 1


def test_parts_of_a_choice_follow_the_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(routes, "stored", lambda df: seen.append(plan(df)) or stored(df))
    candidates = spark.range(60).select((F.col("id") % 20).alias("req"), F.col("id").alias("route"), F.col("id").alias("position"))
    rows = candidates.select("req", "route", F.explode(F.array(F.lit(0), F.col("route") + 1)).alias("segment"), F.lit(1.0).alias("length"))
    got = routes.pick_diverse(candidates, rows, 2, (0.1, 0.6), ["req"], part_rows=10)
    assert {(r.req, r.route, r.choice) for r in got.collect()} == {(i % 20, i, i // 20 + 1) for i in range(40)}
    assert all("REPARTITION_BY_NUM" in p and ", 12)" in p for p in seen[1:])


def test_ways_are_made_once_for_stops(spark, tmp_path, monkeypatch):
    rows = [(i % 40, i * 31 % 60, i // 40 + 1) for i in range(200)]
    written(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_linenumber int"))
    assert "lineitem" not in plan(QUERIES["stop_counts"](spark, str(tmp_path)))
