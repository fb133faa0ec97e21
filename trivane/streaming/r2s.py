"""Relation-to-stream operators over a sequence of evaluations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.sequence import with_previous

NOW, BEFORE = 1, 2


def relation_to_stream(
    rows: DataFrame, instants: DataFrame, operator: str, columns: Sequence[str], keys: Sequence[str] = ("fire_ts",)
) -> DataFrame:
    """``rows`` are evaluation results keyed by ``keys``; ``instants`` lists every evaluation.

    rstream: the rows of each evaluation.  istream: rows the evaluation before did not have.  dstream: rows
    the evaluation before had and this one has not.  Each row is marked in its own evaluation and in the
    next; one aggregation per (evaluation, row) then tells new, gone and unchanged rows apart.  The last of
    ``keys`` orders the evaluations.
    """
    if operator == "rstream":
        return rows.select(*keys, *columns)
    wanted = {"istream": NOW, "dstream": BEFORE}[operator]
    *others, axis = keys
    steps = with_previous(instants, axis).filter(F.col("previous").isNotNull())
    if others:
        steps = steps.join(instants.select(*keys).distinct(), axis)
    following = steps.select(F.col("previous").alias(axis), *[F.col(c).alias(f"__next_{c}") for c in keys])
    marked = rows.select(*keys, *columns).withColumn("__mark", F.lit(NOW))
    carried = (
        rows.select(axis, *columns)
        .join(following, axis, "inner")
        .select(*[F.col(f"__next_{c}").alias(c) for c in keys], *columns, F.lit(BEFORE).alias("__mark"))
    )
    marks = marked.unionByName(carried).groupBy(*keys, *columns).agg(F.bit_or("__mark").alias("__mark"))
    return marks.filter(F.col("__mark") == wanted).drop("__mark")
