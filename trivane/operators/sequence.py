"""Order-dependent operators without a global single-task window.

A long axis is cut into at most ``BUCKETS`` equal ranges.  Work inside a range is one task per range; one
summary row per range links the ranges, and that summary has a fixed upper size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivane.session import materialize

BUCKETS = 2048


def axis_bucket(df: DataFrame, axis: str) -> Column:
    """Number of the equal range that ``axis`` falls into (0 .. BUCKETS-1)."""
    span = df.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    low = span.select("lo").scalar()
    high = span.select("hi").scalar()
    width = F.greatest(F.ceil((high - low + 1) / F.lit(BUCKETS)), F.lit(1))
    return F.floor((F.col(axis) - low) / width)


def with_previous(df: DataFrame, axis: str, keys: Sequence[str] = (), name: str = "previous") -> DataFrame:
    """Distinct ``(keys, axis)`` values, each with the previous axis value of the same key."""
    points = df.select(*keys, axis).distinct()
    points = points.withColumn("__bucket", axis_bucket(df, axis))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(axis)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket")
    last = points.groupBy(*keys, "__bucket").agg(F.max(axis).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(across)).drop("__last")
    linked = points.withColumn(name, F.lag(axis).over(inside)).join(before, [*keys, "__bucket"], "inner")
    return linked.withColumn(name, F.coalesce(F.col(name), F.col("__before"))).drop("__bucket", "__before")


def running_max(df: DataFrame, axis: str, value: str, name: str) -> DataFrame:
    """Largest ``value`` at strictly smaller ``axis``; ``axis`` is unique."""
    spread = df.withColumn("__bucket", axis_bucket(df, axis))
    inside = Window.partitionBy("__bucket").orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    tops = spread.groupBy("__bucket").agg(F.max(value).alias("__top"))
    before = tops.withColumn("__before", F.max("__top").over(across)).drop("__top")
    linked = spread.withColumn(name, F.max(value).over(inside)).join(before, "__bucket", "inner")
    return linked.withColumn(name, F.greatest(F.col(name), F.col("__before"))).drop("__bucket", "__before")


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no", label: str = "numbered") -> DataFrame:
    """Dense 0-based numbers in a total order, without sorting everything in one task.

    Rows are range-partitioned and sorted, then written once: a second evaluation could draw other range
    bounds.  A row's number is its place in its range plus the sizes of the ranges before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    written = materialize(ranged.withColumn("__place", place), label)
    part = F.shiftright(F.col("__place"), 33)
    index = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = written.withColumn("__part", part).withColumn("__index", index)
    # One row per range; the number of ranges is the number of shuffle partitions.
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    joined = placed.join(F.broadcast(starts), "__part", "inner")
    return joined.withColumn(name, F.col("__start") + F.col("__index")).select(*df.columns, name)
