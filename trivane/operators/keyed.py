"""Joins of keyed facts (a window's content, a level) next to fixed facts that hold under every key.

A relation may hold both kinds of rows: keyed ones have their key in the carried columns, fixed ones have NULL
there.  Two rows go together if their keys agree or one of them has none, and the joined row has the key that is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.operators.bgp import linked_order, scan, variables
from trivane.terms import Pattern, twin

# How a row looks for partners: those of its own key, fixed ones, or any.
OWN, FIXED, ANY = 0, 1, 2


def with_fixed(keyed: DataFrame, fixed: DataFrame | None, carry: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keyed and fixed facts as one relation ``(carry, columns)``."""
    rows = keyed.select(*carry, *columns)
    if fixed is None:
        return rows
    none = [F.lit(None).cast(keyed.schema[c].dataType).alias(c) for c in carry]
    return rows.unionByName(fixed.select(*none, *columns))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbers(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))


def join_keyed(left: DataFrame, right: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Natural join of solutions of both kinds: one equi-join, whatever the kinds.

    A keyed row stands twice on the left, to meet rows of its key and fixed rows, and twice on the right, to be met by rows
    of its key and by fixed rows.  So every pair that goes together meets once and plans grow by one join per pattern.
    """
    shared = [v for v in variables(left) if v in set(variables(right))]
    fixed_row = F.col(carry[0]).isNull()
    left_ways = F.when(fixed_row, F.array(F.lit(ANY))).otherwise(F.array(F.lit(OWN), F.lit(FIXED)))
    right_ways = F.when(fixed_row, F.array(F.lit(FIXED), F.lit(ANY))).otherwise(F.array(F.lit(OWN), F.lit(ANY)))
    matched = {c: f"__on_{c}" for c in carry}

    def prepared(df: DataFrame, ways: Column) -> DataFrame:
        rows = df.withColumn("__way", F.explode(ways))
        # Only rows that look for their own key compare keys; the others carry NULL, which <=> lets agree.
        return rows.withColumns({on: F.when(F.col("__way") == OWN, F.col(c)) for c, on in matched.items()})

    one = prepared(left, left_ways)
    other = prepared(right.drop(*[twin(v) for v in shared]), right_ways)
    if not shared:
        # A product under each key: rows of one side are dealt over tasks, the other side is repeated for each.
        tasks = _tasks(left)
        one = one.withColumn("__task", F.pmod(F.xxhash64(*left.columns), F.lit(tasks)).cast("int"))
        other = other.withColumn("__task", _numbers(tasks))
    same = [*shared, "__way", *([] if shared else ["__task"])]
    other = other.select(*[F.col(c).alias(f"__r_{c}") for c in other.columns])
    if not (shared or left.isStreaming or right.isStreaming):
        # Spark estimates the repeated rows by those before, and might broadcast all of them.
        other = other.hint("merge")
    conditions = [F.col(c) == F.col(f"__r_{c}") for c in same]
    conditions += [F.col(on).eqNullSafe(F.col(f"__r_{on}")) for on in matched.values()]
    joined = one.join(other, reduce(lambda a, b: a & b, conditions))
    keys = [F.coalesce(F.col(c), F.col(f"__r_{c}")).alias(c) for c in carry]
    mine = [c for c in left.columns if c not in carry]
    new = [c for c in right.columns if c not in carry and c not in left.columns]
    return joined.select(*keys, *mine, *[F.col(f"__r_{c}").alias(c) for c in new])


def join_patterns_keyed(
    relation: DataFrame, patterns: Sequence[Pattern], carry: Sequence[str], start: DataFrame | None = None
) -> DataFrame:
    """All solutions of a pattern set over a relation of both kinds; solutions from fixed facts alone have no key."""
    bound = variables(start) if start is not None else ()
    solutions = start
    for pattern in linked_order(patterns, lambda p: p.variables, lambda p: p.bound, bound):
        found = scan(relation, pattern, carry)
        solutions = found if solutions is None else join_keyed(solutions, found, carry)
    if solutions is None:
        raise ValueError("no pattern given")
    return solutions


def under_every_key(solutions: DataFrame, keys: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Repeat rows without a key for each of ``keys``; keyed rows stay as they are.

    One outer join: rows without a key are dealt over tasks and meet the keys repeated for each task, keyed rows get
    numbers that no key has.
    """
    tasks = _tasks(solutions)
    deal = F.pmod(F.xxhash64(*solutions.columns), F.lit(tasks)).cast("int")
    dealt = solutions.withColumn("__task", F.when(F.col(carry[0]).isNull(), deal).otherwise(-1 - deal))
    listed = keys.select(*[F.col(c).alias(f"__k_{c}") for c in carry]).distinct().withColumn("__task", _numbers(tasks))
    joined = dealt.join(listed, "__task", "left")
    filled = [F.coalesce(F.col(c), F.col(f"__k_{c}")).alias(c) for c in carry]
    rest = [c for c in solutions.columns if c not in carry]
    return joined.select(*filled, *rest).filter(F.col(carry[0]).isNotNull())
