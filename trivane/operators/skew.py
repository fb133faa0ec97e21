"""Keeping hot keys out of single tasks.

A key may hold a third of all rows.  Aggregations combine before the shuffle, so they need nothing here.
Joins and groups that carry whole rows go through the helpers below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trivane.operators.bgp import BROADCAST_BYTES, weight
from trivane.session import materialize

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 200
SALT = 64
CHUNK_ROWS = 1000

# Fixed value: hex digits of an md5 digest that make up a row's chunk number.
CHUNK_DIGITS = 8


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that hold more than 1/HOT_SHARE of all rows; by counting, fewer than HOT_SHARE of them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    rows = counts.agg(F.sum("__n").alias("rows")).scalar()
    return counts.filter(F.col("__n") * HOT_SHARE > rows).select(*keys)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = (),
    hot: DataFrame | None = None,
) -> DataFrame:
    """Equi-join that spreads the hot keys of ``left`` over ``SALT`` tasks.

    Rows of ``right`` with a hot key are repeated once per salt, so every left row still meets each of its
    partners exactly once.  ``spread`` are left columns whose values differ within a key.  NULL keys never
    match and are left alone.

    Finding the hot keys reads ``left`` again.  In a chain of salted joins pass ``hot``, found on the
    chain's input, or the plan doubles with every link.
    """
    if hot is None:
        hot = hot_keys(left.filter(F.col(keys[0]).isNotNull()), keys)
    hot = hot.withColumn("__hot", F.lit(True))
    by = list(spread) or [c for c in left.columns if c not in keys]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int")).otherwise(F.lit(0))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    spread_left = left.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", salt).drop("__hot")
    spread_right = (
        right.join(F.broadcast(hot), list(keys), "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    )
    return spread_left.join(spread_right, [*keys, "__salt"], how).drop("__salt")


def chunk_of(columns: Sequence[str], chunks: Column) -> Column:
    """Stable chunk number of a row, from the md5 digest of its text."""
    digest = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return F.pmod(F.conv(F.substring(digest, 1, CHUNK_DIGITS), 16, 10).cast("bigint"), chunks)


def chunked(df: DataFrame, keys: Sequence[str], columns: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk``: groups larger than ``rows`` split into chunks of about that many rows.

    Rows are first counted by a hash of their keys, whose groups can only be larger.  Where none is above ``rows`` no row
    is joined or moved; else only groups of such hashes are counted by key, and only sizes above ``rows`` are joined back:
    by broadcast if their counted bytes are few, or by a join that spreads hot keys.
    """
    hashed = df.withColumn("__hash", F.xxhash64(*keys))
    counted = hashed.groupBy("__hash").agg(F.count("*").alias("__size")).filter(F.col("__size") > rows)
    large = materialize(counted.select("__hash"), "large")
    if large.isEmpty():
        return df.withColumn("chunk", F.lit(0).cast("bigint"))
    maybe = hashed.join(F.broadcast(large) if weight(large) <= BROADCAST_BYTES else large, "__hash", "left_semi")
    sizes = materialize(maybe.groupBy(*keys).agg(F.count("*").alias("__size")).filter(F.col("__size") > rows), "sizes")
    if weight(sizes) <= BROADCAST_BYTES:
        sized = df.join(F.broadcast(sizes), list(keys), "left")
    else:
        sized = salted_join(df, sizes, keys, "left", columns)
    chunks = F.coalesce(F.ceil(F.col("__size") / F.lit(rows)), F.lit(1)).cast("bigint")
    return sized.withColumn("chunk", chunk_of(columns, chunks)).drop("__size")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of each key.

    Each salt keeps its own best rows first, so the final ranking of a hot key sees at most
    ``SALT * (offset + limit)`` of its rows.
    """
    rest = [c for c in df.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*rest), F.lit(SALT))
    salted = Window.partitionBy(*keys, "__salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    first = (
        df.withColumn("__salt", salt)
        .withColumn("__rank", F.row_number().over(salted))
        .filter(F.col("__rank") <= offset + limit)
        .drop("__salt", "__rank")
    )
    ranked = first.withColumn("__rank", F.row_number().over(final))
    return ranked.filter((F.col("__rank") > offset) & (F.col("__rank") <= offset + limit)).drop("__rank")
