"""Stages of a derivation: each is built again only if what it depends on has changed, and checked before it counts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.sources.ingest import current, publish

Build = Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A table by name, the tables that it reads (stages or sources), how it is built, its version, and its invariants.

    An invariant is a predicate over the table (SQL) that no row may fail.
    """

    name: str
    reads: tuple[str, ...]
    build: Build
    version: str = "1"
    invariants: tuple[str, ...] = field(default=())


class StageError(ValueError):
    pass


def in_order(stages: Sequence[Stage]) -> list[Stage]:
    """Stages after those they read; a circle or two stages of a name are errors."""
    by_name = {s.name: s for s in stages}
    if len(by_name) < len(stages):
        raise StageError("two stages share a name")
    out: list[Stage] = []
    while len(out) < len(stages):
        done = {s.name for s in out}
        ready = [s for s in stages if s.name not in done and all(r in done or r not in by_name for r in s.reads)]
        if not ready:
            raise StageError(f"stages read one another in a circle: {sorted(by_name.keys() - done)}")
        out += ready
    return out


def violations(df: DataFrame, invariants: Sequence[str]) -> dict[str, int]:
    """How many rows fail each invariant (unknown counts as failed), in one pass; only those that any row fails."""
    if not invariants:
        return {}
    row = df.agg(*[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(str(i)) for i, rule in enumerate(invariants)]).first()
    return {rule: row[str(i)] for i, rule in enumerate(invariants) if row[str(i)]}


def _built(spark: SparkSession, path: str) -> dict[str, str]:
    """The fingerprint of each stage as last built."""
    try:
        log = spark.read.schema("name string, fingerprint string, built timestamp").json(f"{path}/_stages")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["name"]: r["fingerprint"] for r in log.groupBy("name").agg(F.max_by("fingerprint", "built").alias("fingerprint")).collect()}


def run(spark: SparkSession, path: str, stages: Sequence[Stage], sources: Mapping[str, tuple[DataFrame, str]]) -> list[str]:
    """Builds and publishes what has changed and returns its names; ``sources`` give tables and their fingerprints.

    A stage's fingerprint covers its version and all that it reads, so a change reaches every stage after it.  A table
    that fails an invariant is not published, and the run ends with an error.
    """
    known, prints, tables, done = _built(spark, path), {n: p for n, (_, p) in sources.items()}, {n: t for n, (t, _) in sources.items()}, []
    for stage in in_order(stages):
        if unknown := [r for r in stage.reads if r not in prints]:
            raise StageError(f"{stage.name} reads {unknown}, which is unknown")
        mark = hashlib.sha256(json.dumps([stage.name, stage.version, [prints[r] for r in stage.reads]]).encode()).hexdigest()
        prints[stage.name] = mark
        if known.get(stage.name) != mark:
            candidate = stage.build(spark, {r: tables[r] for r in stage.reads})
            if broken := violations(candidate, stage.invariants):
                raise StageError(f"{stage.name} breaks {broken}")
            publish(candidate, path, stage.name, mark[:12])
            spark.createDataFrame([(stage.name, mark)], "name string, fingerprint string").withColumn("built", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/_stages")
            done.append(stage.name)
        tables[stage.name] = current(spark, path, stage.name)
    return done
