"""Queries without SQL take whole tables, whatever the ids."""

from tarmac.queries import network


def test_ways_of_all_orders(spark, tmp_path):
    rows = [(order, line, order * 7 + line) for order in (1, 2_999, 3_000, 50_000) for line in (1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.way for r in network.segment_geometry(spark, str(tmp_path)).select("way").distinct().collect()} == {1, 2_999, 3_000, 50_000}
    assert {r.way for r in network._ways(spark, str(tmp_path)).collect()} == {1, 2_999, 3_000, 50_000}
