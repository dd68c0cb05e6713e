"""Ingest: adapters by name, one feature table partitioned by source, and a log of runs."""

from __future__ import annotations

import hashlib
import inspect
import json
import sys
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

register_pickle_by_value(sys.modules[__name__])  # workers need not have this package on their path

Adapter = Callable[[SparkSession, Mapping[str, str]], DataFrame]
_ADAPTERS: dict[str, tuple[Adapter, tuple[str, ...]]] = {}

_RUN_TYPES = {"run": T.StringType(), "source": T.StringType(), "status": T.StringType(), "started": T.TimestampType(), "finished": T.TimestampType(), "fingerprint": T.StringType(), "rows": T.LongType()}
RUNS = T.StructType([T.StructField(name, kind) for name, kind in _RUN_TYPES.items()])


def adapter(name: str, required: Sequence[str] = ()) -> Callable[[Adapter], Adapter]:
    """Registers a reader of records; ``required`` are the options that it needs."""

    def register(read: Adapter) -> Adapter:
        if name in _ADAPTERS:
            raise ValueError(f"there is an adapter {name}")
        _ADAPTERS[name] = (read, tuple(required))
        return read

    return register


def read(spark: SparkSession, name: str, options: Mapping[str, str]) -> DataFrame:
    found, required = _ADAPTERS[name]
    if missing := [o for o in required if o not in options]:
        raise ValueError(f"{name} needs {missing}")
    return found(spark, options)


def fingerprint(options: Mapping[str, str], files: Mapping[str, object], version: str) -> str:
    """A digest of what an ingest depends on: its options, its files' digests (``file_digests``), and the code's version."""
    return hashlib.sha256(json.dumps([sorted(options.items()), sorted(files.items()), version]).encode()).hexdigest()


def file_digests(spark: SparkSession, *paths: str) -> dict[str, str]:
    """The SHA-256 of each file's content, read by the executors; one row a file reaches the driver."""
    rows = spark.read.format("binaryFile").load(list(paths)).select("path", F.sha2("content", 256).alias("digest"))
    return {r["path"]: r["digest"] for r in rows.collect()}


def code_digest(*modules) -> str:
    """The SHA-256 of modules' sources, in the given order."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()


def ingest(df: DataFrame, path: str, source: str, mark: str, now: datetime | None = None) -> bool:
    """Replaces a source's partition of the feature table and logs the run; False if the last good run had the same mark.

    The log is appended first as running and then with the outcome, so a broken run leaves a trace and no rows.
    """
    spark = df.sparkSession
    runs = latest_runs(spark, path, source)
    if runs is not None and runs["fingerprint"] == mark:
        return False
    now = now or datetime.now(UTC)
    run = hashlib.sha256(f"{source}{now.isoformat()}".encode()).hexdigest()[:16]
    log = lambda status, end, rows: spark.createDataFrame([(run, source, status, now, end, mark, rows)], RUNS).write.mode("append").parquet(f"{path}/runs")
    log("running", None, None)
    try:
        df.withColumn("run", F.lit(run)).withColumn("source", F.lit(source)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/features")
        rows = spark.read.parquet(f"{path}/features").where(F.col("source") == source).count()
        log("succeeded", datetime.now(UTC), rows)
    except Exception:
        log("failed", datetime.now(UTC), None)
        raise
    return True


def latest_runs(spark: SparkSession, path: str, source: str | None = None):
    """The latest succeeded run of each source, or of one as a row (None if there is none)."""
    try:
        runs = spark.read.schema(RUNS).parquet(f"{path}/runs")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    best = latest_succeeded(runs)
    return best if source is None else best.where(F.col("source") == source).first()


def latest_succeeded(runs: DataFrame) -> DataFrame:
    own = runs.where("status = 'succeeded'")
    rest = [c for c in runs.columns if c != "source"]
    return own.groupBy("source").agg(F.max_by(F.struct(*rest), F.struct("finished", "run")).alias("_r")).select("source", "_r.*")


def stale(runs: DataFrame, derived: DataFrame) -> DataFrame:
    """``(source, stale)``: whether what was derived (``source``, ``run``) is not of the latest succeeded run."""
    last = latest_succeeded(runs).select("source", F.col("run").alias("_last"))
    both = last.join(derived.select("source", "run"), "source", "full")
    return both.select("source", (~F.coalesce(F.col("_last") == F.col("run"), F.lit(False))).alias("stale"))


def dms_degrees(raw: Column) -> Column:
    """Degrees of digits DDDMMSSsss (or DDMMSSsss): null unless minutes and seconds are under 60."""
    digits = F.when(raw.rlike("^[0-9]{9,10}$"), F.lpad(raw, 10, "0"))
    part = lambda a, n: F.substring(digits, a, n).try_cast("double")
    degrees, minutes, seconds = part(1, 3), part(4, 2), part(6, 5) / 1000
    return F.when((minutes < 60) & (seconds < 60), degrees + minutes / 60 + seconds / 3600)


def decoded(encoding: str):
    """Text of an encoding that Spark's readers do not have, read as Latin-1."""

    def decode(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t.encode("latin-1").decode(encoding, "replace"), na_action="ignore")

    return F.pandas_udf(decode, T.StringType())


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def tag_rules(tags: Column, rules: Sequence[Mapping[str, Sequence[str]]]) -> Column:
    """Any rule, all of whose tags are present with an allowed value (``*`` allows all)."""
    out = F.lit(False)
    for rule in rules:
        held = F.lit(True)
        for tag, allowed in rule.items():
            value = F.try_element_at(tags, F.lit(tag))
            held = held & (value.isNotNull() if "*" in allowed else F.coalesce(value.isin(*allowed), F.lit(False)))
        out = out | held
    return out


@adapter("accident_csv", ["path"])
def accident_csv(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Accident records: positions in degrees, minutes and seconds; rows out of range are left out."""
    raw = spark.read.csv(options["path"], header=True, encoding="ISO-8859-1", escape="\0")
    encoding = options.get("encoding", "cp932")
    rows = raw.select(*[F.col(f"`{c}`").alias(c.encode("latin-1").decode(encoding)) for c in raw.columns])
    ascii_only = {"year", "prefecture", "police", "number", "longitude", "latitude"}
    rows = rows.select(*[F.col(c) if c in ascii_only else decoded(encoding)(F.col(c)).alias(c) for c in rows.columns])
    out = rows.withColumn("lon", dms_degrees(F.col("longitude"))).withColumn("lat", dms_degrees(F.col("latitude")))
    out = out.where(in_box(F.col("lon"), F.col("lat"), (120.0, 20.0, 155.0, 47.0)))
    key = F.concat_ws("-", "year", "prefecture", "police", "number")
    return out.select(key.alias("natural_key"), "lon", "lat", F.to_json(F.struct(*rows.columns)).alias("attrs"))


@adapter("places_parquet", ["path"])
def places_parquet(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Points of interest: box and confidence are read off nested columns, so they reach the scan."""
    rows = spark.read.parquet(options["path"])
    west, south, east, north = map(float, options.get("box", "-180,-90,180,90").split(","))
    kept = rows.where((F.col("bbox.xmin") <= east) & (F.col("bbox.xmax") >= west) & (F.col("bbox.ymin") <= north) & (F.col("bbox.ymax") >= south) & (F.col("confidence") >= float(options.get("confidence", "0"))) & F.col("name").isNotNull())
    return kept.select(F.col("id").alias("natural_key"), F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"), F.to_json(F.struct(*[c for c in rows.columns if c not in ("bbox", "id")])).alias("attrs"))


@adapter("json_lines", ["path"])
def json_lines(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Items with coordinates, a listed designation, and a place in the box."""
    west, south, east, north = map(float, options.get("box", "-180,-90,180,90").split(","))
    rows = spark.read.schema("id string, designation string, lon double, lat double, name string").json(options["path"])
    kept = rows.where(in_box(F.col("lon"), F.col("lat"), (west, south, east, north)))
    if "designations" in options:
        kept = kept.where(F.col("designation").isin(*options["designations"].split(",")))
    return kept.select(F.col("id").alias("natural_key"), "lon", "lat", F.to_json(F.struct("designation", "name")).alias("attrs"))


@adapter("registry_csv", ["text", "positions"])
def registry_csv(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Address rows with a representative point: the one of the same residence flag, else of the smallest; rows without go."""
    keys = options.get("keys", "code").split(",")
    text = spark.read.csv(options["text"], header=True).withColumn("_n", F.monotonically_increasing_id())
    once = text.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in text.columns if c not in (*keys, "_n")]), "_n").alias("t")).select(*keys, "t.*")
    points = spark.read.csv(options["positions"], header=True)
    met = once.join(points.select(*keys, F.col("flag").alias("_flag"), F.col("lon").cast("double"), F.col("lat").cast("double")), keys)
    best = met.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in met.columns if c not in (*keys, "_flag")]), F.struct((F.col("flag") != F.col("_flag")).alias("other"), "_flag")).alias("b"))
    return best.select(F.concat_ws("-", *keys).alias("natural_key"), "b.lon", "b.lat", F.to_json("b").alias("attrs"))


def publish(df: DataFrame, path: str, name: str, revision: str) -> str:
    """Writes a table in a folder of its own, then appends a pointer to it; readers see the old one or the new one.

    A pointer is one file that Spark's commit renames into place, and no file is ever replaced, so publishing a revision
    again leaves readers of the first one alone.
    """
    at = f"{path}/{name}/{revision}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    df.sparkSession.createDataFrame([(revision, at, datetime.now(UTC))], _POINTER).coalesce(1).write.mode("append").json(f"{path}/{name}/_pointers")
    return at


_POINTER = "revision string, at string, published timestamp"


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The table published last."""
    pointers = spark.read.schema(_POINTER).json(f"{path}/{name}/_pointers")
    return spark.read.parquet(pointers.agg(F.max_by("at", "published").alias("at")).first()["at"])
