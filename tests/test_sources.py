"""Ingest, publishing, streaming, and the entry module without the llm subpackage."""

import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarmac.sources import ingest
from tarmac.streaming import feeds

ROOT = Path(__file__).resolve().parents[1]


def test_accidents(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("year,prefecture,police,number,longitude,latitude,場所\n2020,1,2,3,1394512345,354012000,東京\n2020,1,2,4,1396112345,354012000,x\n2020,1,2,5,0104512345,354012000,x\n".encode("cp932"))
    rows = ingest.read(spark, "accident_csv", {"path": str(tmp_path / "a.csv")}).collect()
    assert [(r.natural_key, round(r.lon, 6)) for r in rows] == [("2020-1-2-3", 139.753429)]
    assert "東京" in rows[0].attrs
    with pytest.raises(ValueError):
        ingest.read(spark, "accident_csv", {})


def test_places_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", "n", 0.9, (1.0, 2.0, 1.0, 2.0)), ("b", None, 0.9, (1.0, 2.0, 1.0, 2.0)), ("c", "n", 0.1, (1.0, 2.0, 1.0, 2.0)), ("d", "n", 0.9, (50.0, 51.0, 1.0, 2.0))], "id string, name string, confidence double, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>").write.parquet(str(tmp_path / "p"))
    out = ingest.read(spark, "places_parquet", {"path": str(tmp_path / "p"), "box": "0,0,10,10", "confidence": "0.5"})
    assert [r.natural_key for r in out.collect()] == ["a"]
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = out._jdf.queryExecution().explainString(formatted)
    assert "GreaterThanOrEqual(confidence" in plan and "bbox.xmin" in plan.split("PushedFilters")[1]


def test_registry_and_items(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,name,flag\n1,first,0\n1,second,0\n2,none,1\n3,other,1\n")
    (tmp_path / "p.csv").write_text("code,flag,lon,lat\n1,1,5,5\n1,0,6,6\n3,0,7,7\n")
    rows = ingest.read(spark, "registry_csv", {"text": str(tmp_path / "t.csv"), "positions": str(tmp_path / "p.csv")}).collect()
    assert sorted((r.natural_key, r.lon) for r in rows) == [("1", 6.0), ("3", 7.0)]
    (tmp_path / "i.json").write_text('{"id":"x","designation":"national","lon":1,"lat":2,"name":"n"}\n{"id":"y","designation":"national","name":"n"}\n{"id":"z","designation":"local","lon":1,"lat":2}\n')
    assert [r.natural_key for r in ingest.read(spark, "json_lines", {"path": str(tmp_path / "i.json"), "designations": "national"}).collect()] == ["x"]


def test_ingest_replaces_a_partition_once(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda *keys: spark.createDataFrame([(k,) for k in keys], "natural_key string")
    mark = ingest.fingerprint({"a": "1"}, {"f": (3, 1.0)}, "v1")
    assert ingest.ingest(frame("a", "b"), path, "one", mark) and ingest.ingest(frame("z"), path, "two", mark)
    assert not ingest.ingest(frame("never"), path, "one", mark)
    assert ingest.ingest(frame("c"), path, "one", ingest.fingerprint({"a": "2"}, {}, "v1"))
    assert sorted((r.source, r.natural_key) for r in spark.read.parquet(f"{path}/features").collect()) == [("one", "c"), ("two", "z")]
    with pytest.raises(Exception, match="boom"):
        ingest.ingest(frame("d").select(F.raise_error(F.lit("boom")).alias("natural_key").cast("string")), path, "two", "other")
    statuses = [r.status for r in spark.read.parquet(f"{path}/runs").where("source = 'two'").collect()]
    assert sorted(statuses) == ["failed", "running", "running", "succeeded"]
    assert ingest.latest_runs(spark, path, "two")["fingerprint"] == mark


def test_publish(spark, tmp_path):
    ingest.publish(spark.range(3).toDF("x"), str(tmp_path), "t", "r1")
    old = ingest.current(spark, str(tmp_path), "t")
    ingest.publish(spark.range(5).toDF("x"), str(tmp_path), "t", "r2")
    assert (old.count(), ingest.current(spark, str(tmp_path), "t").count()) == (3, 5)


def test_history_by_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("s", start + timedelta(hours=h), start + timedelta(hours=h, minutes=m), float(h * 100 + m)) for h in range(6) for m in (5, 50)]
    frame = spark.createDataFrame(rows, "station string, hour timestamp, at timestamp, mm double")
    for i, part in enumerate((frame.where("mm < 300"), frame.where("mm > 200"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    feeds.keep_history(stream, str(tmp_path / "out"), str(tmp_path / "check"), ("station",), "at", 4).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir())
    got = sorted(r.mm for r in spark.read.parquet(str(tmp_path / "out" / str(last))).collect())
    assert last == 1 and got == [250.0, 350.0, 450.0, 550.0]
    again = feeds.upsert(feeds.upsert(None, frame, ("station",), "at", 4), frame, ("station",), "at", 4)
    assert sorted(r.mm for r in again.collect()) == got


def test_windows_in_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    frame = spark.createDataFrame([(i, start + timedelta(minutes=20 * i), 1.0) for i in range(12)], "id int, at timestamp, value double")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = feeds.windowed(feeds.once(stream, "id", "at"), "at", "1 hour", late=None).writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert all(r.n == 3 for r in spark.table("hours").collect())
    batch = feeds.windowed(frame, "at", "1 hour").collect()
    assert sorted(r.n for r in batch) == [3, 3, 3, 3]


def test_entry_without_llm(tmp_path):
    for item in ROOT.iterdir():
        if item.suffix == ".py" and item.name != "corpus_pipeline.py":
            (tmp_path / item.name).symlink_to(item)
    (tmp_path / "tarmac").mkdir()
    for item in (ROOT / "tarmac").iterdir():
        if item.name != "llm":
            (tmp_path / "tarmac" / item.name).symlink_to(item)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    count, numbered, known = said.stdout.split()
    assert int(count) > 90 and numbered == "False" and known == "True", said.stderr
