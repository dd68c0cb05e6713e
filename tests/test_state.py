"""Stateful streams: replays, late and repeated events, restarts; the same as the batch forms where those are defined."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarmac.streaming import feeds

BEGIN = datetime(2024, 5, 1, 12)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def played(spark, tmp_path, schema, batches, job):
    """The rows that each batch gave; the query ends after each one and starts again from its checkpoint."""
    out = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        result = job(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = result.writeStream.foreachBatch(lambda df, _, i=i: df.write.mode("append").parquet(f"{tmp_path}/out{i}")).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        out.append(sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{i}").collect()), key=repr))
    return out


def test_rate_limit_over_batches_and_restarts(rocks, tmp_path):
    at = lambda s: BEGIN + timedelta(seconds=s)
    batches = [[(1, "a", at(0)), (2, "a", at(10)), (3, "b", at(10))], [(4, "a", at(30)), (5, "a", at(30)), (6, "b", at(200))], [(7, "a", at(61)), (8, "a", at(95)), (9, "b", at(200))]]
    schema = "id long, user string, at timestamp"
    got = played(rocks, tmp_path, schema, batches, lambda s: feeds.rate_limited_stream(s, "user", "at", 2))
    allowed = {r[0]: r[-1] for batch in got for r in batch}
    want = {r.id: r.allowed for r in feeds.rate_limited(rocks.createDataFrame([r for b in batches for r in b], schema), "user", "at", 2).collect()}
    assert want == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False, 8: True, 9: True}
    assert allowed == want


def test_history_asks_for_missing_hours_again(rocks, tmp_path):
    hour = lambda h: BEGIN + timedelta(hours=h)
    schema = "station string, hour timestamp, value double, at timestamp"
    batches = [
        [("s", hour(0), 1.0, hour(0)), ("s", hour(2), 3.0, hour(2)), ("t", hour(0), 5.0, hour(0))],
        [("s", hour(2), 9.0, hour(1)), ("s", hour(3), None, hour(3))],  # an older report, and one without a value
        [("s", hour(1), 2.0, hour(4)), ("s", hour(2), 4.0, hour(5))],  # what was asked for, and a newer report
        [("s", hour(1), 2.0, hour(4)), ("s", hour(6), 7.0, hour(6))],  # a repeated report, and hours that fall out
    ]
    got = played(rocks, tmp_path, schema, batches, lambda s: feeds.ring_history(s, "station", "at", 4))
    number = lambda t: int((t - BEGIN).total_seconds() // 3600)
    seen = [{(s, number(h)): ("ask" if asked else v) for s, h, v, asked in batch} for batch in got]
    assert seen[0] == {("s", -1): "ask", ("s", 0): 1.0, ("s", 1): "ask", ("s", 2): 3.0, ("t", -3): "ask", ("t", -2): "ask", ("t", -1): "ask", ("t", 0): 5.0}
    assert seen[1] == {("s", 1): "ask", ("s", 3): "ask"}
    assert seen[2] == {("s", 1): 2.0, ("s", 2): 4.0, ("s", 3): "ask"}
    assert seen[3] == {("s", 3): "ask", ("s", 4): "ask", ("s", 5): "ask", ("s", 6): 7.0}


def test_missing_hours_of_a_table(spark):
    rows = [("s", BEGIN, 1.0), ("s", BEGIN + timedelta(hours=2), None), ("t", BEGIN + timedelta(hours=3), 1.0)]
    got = feeds.missing_hours(spark.createDataFrame(rows, "station string, hour timestamp, value double"), ("station",), 4)
    hours = {(r.station, int((r.hour - BEGIN).total_seconds() // 3600)) for r in got.select("station", F.col("hour").cast("timestamp").alias("hour")).collect()}
    assert hours == {("s", 1), ("s", 2), ("s", 3), ("t", 0), ("t", 1), ("t", 2)}
