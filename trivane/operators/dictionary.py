"""Optional integer ids for terms: dense, in term order, the same for every store they are built from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.operators.sequence import numbered
from trivane.operators.skew import HOT_SHARE, salted_join

PLACES = ("s", "p", "o")


def terms(triples: DataFrame) -> DataFrame:
    """Distinct terms in any position, combined per task before the shuffle."""
    return triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()


def build(*stores: DataFrame) -> DataFrame:
    """``(term, id)`` over all stores together, so no two stores can disagree."""
    every = terms(stores[0])
    for other in stores[1:]:
        every = every.union(terms(other))
    distinct = every.distinct() if len(stores) > 1 else every
    return numbered(distinct, [F.col("term")], "id", "dictionary")


def _hot_terms(triples: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``(place, term)`` of every term that holds more than 1/HOT_SHARE of one position, in one pass.

    By counting there are fewer than HOT_SHARE per position.
    """
    entries = [F.struct(F.lit(place).alias("place"), F.col(c).alias("term")) for place, c in columns.items()]
    single = triples.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    counts = single.groupBy("place", "term").agg(F.count("*").alias("n"))
    rows = counts.agg((F.sum("n") / len(columns)).alias("rows")).scalar()
    return counts.filter(F.col("n") * HOT_SHARE > rows).select("place", "term")


def _replace(df: DataFrame, columns: dict[str, str], table: DataFrame, key: str, value: str, suffix: str) -> DataFrame:
    hot = _hot_terms(df, columns)
    out = df
    for place, column in columns.items():
        looked_up = table.select(F.col(key).alias(column), F.col(value).alias(f"{place}{suffix}"))
        mine = hot.filter(F.col("place") == place).select(F.col("term").alias(column))
        out = salted_join(out, looked_up, [column], hot=mine)
    return out


def encode(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Replace terms by ids.  A predicate can hold a third of all rows, so each join is salted."""
    base = triples.select(*PLACES)
    coded = _replace(base, {p: p for p in PLACES}, dictionary, "term", "id", "_id")
    return coded.select("s_id", "p_id", "o_id")


def decode(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``coded`` is read several times, so it should be a stored relation."""
    out = _replace(coded, {p: f"{p}_id" for p in PLACES}, dictionary, "id", "term", "")
    return out.select("s", "p", "o")
