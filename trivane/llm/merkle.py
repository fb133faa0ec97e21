"""Merkle manifests of tables: one tree of digests per group, and a tree over the groups' roots.

A row is a leaf. Every ``ARITY`` consecutive nodes of a level form a run, whose digests together give the parent's.
Levels are tables; the siblings of a node are fixed-offset lags and leads over blocks of whole runs, masked by the
node's slot and the length of its run, and the first child of a run hashes the parent.  Places come from range
partitions and one offset per partition, so no task ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.session import materialize

ARITY = 8
# Places per window partition: whole runs, few enough for one task, many enough to be worth a sort.
BLOCK = ARITY**3
NONE = bytearray()


def field(column: Column) -> Column:
    """A value as hashed: its bytes counted, a colon, the value; ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """Digest (32 bytes) of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def spelled(digests: Column) -> Column:
    """Concatenated digests as the lowercase hex text that is hashed."""
    return F.lower(F.hex(digests))


def hashed(digests: Column) -> Column:
    return F.unhex(F.sha2(spelled(digests), 256))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (place within ``tree`` by ``order``, from 0) and ``size`` (rows of the tree).

    Rows are range partitioned, so a large tree lies in many partitions; rows that agree in all of ``order`` are told
    apart by where they were read, so even copies spread.  Each partition's share of a tree gets its offset by one sum.
    """
    by = ["tree", *order, "read"]
    spread = rows.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    # The upper bits of the number are the partition, the lower ones the place in it.
    placed = materialize(spread.drop("read").withColumn("at", F.monotonically_increasing_id()), "places")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    shares = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(of_tree).alias("size"),
    )
    found = placed.join(shares, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return materialize(found.drop("at", "part", "shift"), "numbered")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add ``slot``, and the digests of the run's other nodes on the left (``before``) and right (``after``)."""
    nodes = nodes.withColumns({"slot": F.col("pos") % ARITY, "block": F.floor(F.col("pos") / BLOCK)})
    run = Window.partitionBy("tree", "block").orderBy("pos")
    length = F.least(F.lit(ARITY), F.col("size") - F.col("pos") + F.col("slot"))

    def kept(inside: Column, digest: Column) -> Column:
        return F.when(inside, digest).otherwise(F.lit(NONE))

    left = [kept(F.col("slot") >= k, F.lag("digest", k).over(run)) for k in range(ARITY - 1, 0, -1)]
    right = [kept(F.col("slot") + k < length, F.lead("digest", k).over(run)) for k in range(1, ARITY)]
    return nodes.withColumns({"before": F.concat(*left), "after": F.concat(*right)}).drop("block")


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: the first child of each run hashes the run."""
    first = with_siblings(nodes.select("tree", "pos", "size", "digest")).filter(F.col("slot") == 0)
    return first.select(
        "tree",
        F.expr(f"pos div {ARITY}").alias("pos"),
        F.ceil(F.col("size") / ARITY).alias("size"),
        hashed(F.concat("digest", "after")).alias("digest"),
    )


@dataclass(frozen=True)
class Forest:
    """Levels of all trees, leaves first; a tree ends with the level where it has one node."""

    levels: list[DataFrame]

    @classmethod
    def over(cls, leaves: DataFrame) -> Forest:
        """From ``leaves`` (tree, pos, size, digest, anything else), a written table."""
        levels = [leaves]
        largest = leaves.agg(F.max("size")).first()[0] or 1
        while largest > 1:
            levels.append(materialize(parents(levels[-1].filter(F.col("size") > 1)), "level"))
            largest = -(-largest // ARITY)
        return cls(levels)

    def roots(self) -> DataFrame:
        """(tree, digest): the last node of each tree."""
        ends = [level.filter(F.col("size") == 1).select("tree", "digest") for level in self.levels]
        return reduce(DataFrame.unionByName, ends)

    def paths(self, crowns: DataFrame) -> DataFrame:
        """The leaves with ``path``: the siblings, level by level, from the leaf to the end of its crown's path.

        ``crowns`` (tree, path, anything else) continues each tree's path above its root; its other columns are handed
        down.  Paths go from the top down, so a level joins its nodes with an eighth as many paths of the level above.
        """
        others = [c for c in crowns.columns if c not in ("tree", "path")]
        above: DataFrame | None = None
        for number in range(len(self.levels) - 1, -1, -1):
            level = self.levels[number]
            found = level.filter(F.col("size") == 1).join(crowns, "tree")
            if above is not None:
                inner = with_siblings(level.filter(F.col("size") > 1)).withColumn("run", F.expr(f"pos div {ARITY}"))
                inner = inner.join(above, ["tree", "run"])
                step = F.array(F.struct("before", "after"))
                found = found.unionByName(inner.withColumn("path", F.concat(step, "path")).select(found.columns))
            if number == 0:
                return found
            above = materialize(found.select("tree", F.col("pos").alias("run"), "path", *others), "paths")
        raise AssertionError("a forest has at least one level")


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, start, lambda node, step: hashed(F.concat(step["before"], node, step["after"])))


def proof(path: Column) -> Column:
    """The siblings' digests, from the leaf up and from left to right."""
    return F.aggregate(path, F.lit(NONE), lambda seen, step: F.concat(seen, step["before"], step["after"]))


STEPS = "array<struct<before: binary, after: binary>>"


def manifest(
    rows: DataFrame,
    fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    tree: str = "lang",
    order: str = "doc_id",
    claimed: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of ``rows``: (order, leaf, subroot, root, path, folded), digests as 32 bytes.

    Rows with one value of ``tree`` form a tree, ascending by ``order``; the trees' roots (subroots), null first and
    then by the bytes of the value as text, form the tree whose end is the root.  ``path`` holds the siblings on the way
    from the leaf to the root as (before, after).  ``folded`` is the root that follows from the leaf and its path;
    columns named in ``claimed`` take the place of the row's own fields there, as a tampered copy would.

    Null fields and null trees are values of their own, an empty text differs from a null one, texts of any length are
    hashed whole.  Rows with equal or null ``order`` are ordered by their digest (null first), so copies get neighbouring
    places; a table without rows gives none.  Other columns are ignored.  A tree with most rows is spread like any other.
    """
    own = leaf([F.col(c) for c in fields])
    other = leaf([(claimed or {}).get(c, F.col(c)) for c in fields])
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("-")).alias("tree"),
        F.col(order).alias("key"),
        own.alias("digest"),
        *([other.alias("claim")] if claimed else []),
    )
    forest = Forest.over(numbered(materialize(leaves, "leaves"), ["key", "digest"]))
    subroots = forest.roots().select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = Forest.over(numbered(materialize(subroots, "subroots"), ["name"]))
    ends = top.roots().select("tree", F.from_json(F.lit("[]"), STEPS).alias("path"), F.col("digest").alias("root"))
    crowns = top.paths(ends).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = forest.paths(materialize(crowns, "crowns"))
    start = F.col("claim") if claimed else F.col("digest")
    return found.select(
        F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", "path", fold(start, F.col("path")).alias("folded")
    )
