"""Running sums and minima over any number of rows: range partitions, their totals, and what lies before each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.storage import stored


def running(df: DataFrame, keys: Sequence[str], order: str, value: str, how: str = "sum", inclusive: bool = True) -> DataFrame:
    """``df`` with ``running``: the sum or minimum of ``value`` over the rows of the key up to each row (or before it).

    ``order`` is different in each row of a key.  Rows are dealt into ranges of (keys, order), so neither a key with most
    of the rows nor a missing key gathers in one task; only one row a key and range meets in the second window.
    """
    fold = {"sum": F.sum, "min": F.min}[how]
    own = stored(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = own.groupBy("_part", *keys).agg(fold(value).alias("_total"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], fold("_total").over(earlier).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.col("_part") == F.col("_p"))
    both = own.withColumn("_inside", fold(value).over(inside)).join(totals, same, "left")
    out = F.least("_inside", "_before") if how == "min" else F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    return both.select(*df.columns, out.alias("running"))
