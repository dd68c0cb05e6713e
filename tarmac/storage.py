"""The folder that driver and executors share, and tables stored in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode (tests), and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get() if found.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tarmac-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: no lineage, computed once, safe from lost executors.

    Tables stay until their owner clears the folder: a caller may read a result long after it was returned.  ``by`` gives
    each value of a column a folder of its own, so that a filter on it leaves the others unread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarmac-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, buckets: int, dealt: bool = False) -> DataFrame:
    """``df`` stored in the shared folder, bucketed and sorted by a column: joins and groups on it read it without a shuffle.

    ``dealt``: its rows lie by the column in ``buckets`` parts already, so they are written where they are.
    """
    spark = df.sparkSession
    name = f"tarmac_{uuid.uuid4().hex}"
    (df if dealt else df.repartition(buckets, column)).write.bucketBy(buckets, column).sortBy(column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name, format="parquet")
    return spark.table(name)


def dealt(df: DataFrame, *by: str, rows: int = 1 << 18) -> DataFrame:
    """``df`` dealt by columns into parts of about ``rows`` rows, which are counted first: what a task holds does not grow with the table."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(parts, *by)


def measured(df: DataFrame, by: str | None = None, **measures: Column) -> tuple[DataFrame, dict]:
    """``df`` stored, and aggregates over it that are taken while it is written, without a job of their own."""
    seen = Observation()
    out = stored(df.observe(seen, *[column.alias(name) for name, column in measures.items()]), by)
    return out, seen.get


def forget(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/")
    for path in {p.rpartition("/")[0].split("/kind=")[0] for p in df.inputFiles()}:
        if path.rpartition("/")[2].startswith("tarmac-") and path.rpartition("/")[0].removeprefix("file:").lstrip("/") == root.removeprefix("file:").lstrip("/"):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
