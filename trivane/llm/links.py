"""Connected components of a link table, without collecting links, components or hubs anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.session import materialize


def _stars(edges: DataFrame) -> bool:
    """True if every larger end has one link and is nobody's smaller end, so that the smaller ends are components."""
    ends = edges.select(F.col("a").alias("id"), F.lit(0).alias("larger")).union(edges.select("b", F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("larger").alias("n"), F.min("larger").alias("least"))
    return seen.agg(F.count(F.when((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0)), 1))).first()[0] == 0


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (id, component) for every linked id: component is the smallest id reachable.

    Alternates two steps until all links are stars around their smallest id: every id links its larger neighbours to the smallest id it sees, then
    every id links itself and its smaller neighbours to the smallest of them.  The number of rounds is logarithmic in
    the longest chain.  The smallest neighbours are written before they are joined back, so that both sides of the
    join come straight from a shuffle and Spark can split a hub.  Null ids and links of an id with itself are left out.
    """
    x, y = F.col(a), F.col(b)
    edges = materialize(
        links.filter(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        .distinct(),
        "edges",
    )
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = (
            both.join(least, "a").filter((F.col("b") > F.col("a")) & (F.col("b") != F.col("m")))
            .select(F.col("m").alias("a"), "b").distinct()
        )
        large = materialize(large, "edges")
        least = materialize(large.groupBy("b").agg(F.min("a").alias("m")), "least")
        small = (
            large.join(least, "b").filter(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(least.select(F.col("m").alias("a"), "b")).distinct()
        )
        edges = materialize(small, "edges")
    roots = edges.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return roots.union(edges.select(F.col("b").alias("id"), F.col("a").alias("component")))
