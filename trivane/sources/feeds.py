"""Messages of a feed as timestamped triples; works on batch and streaming DataFrames alike."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number


def json_fields(messages: DataFrame, payload: str, schema: str) -> DataFrame:
    """Add the fields of a JSON payload column."""
    parsed = messages.withColumn("__fields", F.from_json(F.col(payload), schema))
    return parsed.select("*", "__fields.*").drop("__fields")


def to_triples(
    messages: DataFrame, subject: Column, fields: Mapping[str, Column], carry: Sequence[str] = ()
) -> DataFrame:
    """One triple per message and predicate; a missing field gives no triple."""
    entries = [
        F.struct(F.lit(p).alias("p"), v.cast("string").alias("o"), as_number(v.cast("string")).alias("o_num"))
        for p, v in fields.items()
    ]
    rows = messages.select(*carry, subject.alias("s"), F.explode(F.array(*entries)).alias("t"))
    return rows.select(*carry, "s", "t.p", "t.o", "t.o_num").filter(F.col("o").isNotNull())
