"""Basic graph patterns as DataFrame joins.

Each pattern becomes a filtered projection of the triple relation and patterns meet in equi-joins on
their shared variables.  The join algorithm is left to Catalyst and AQE unless the caller names one.
``carry`` columns (a window key, a reasoning level) are part of every scan and of every join key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.operators.wide import PropertyTable, scan_star, star_variables, stars
from trivane.terms import TWIN, Pattern, is_var, twin, var_name

# A side is broadcast on request only when its text and row overhead are counted below this.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64

_HINTS = {"merge": "merge", "shuffle_hash": "shuffle_hash"}


def pattern_filter(pattern: Pattern) -> Column | None:
    """Constants in any position, and equality of repeated variables."""
    conditions: list[Column] = []
    seen: dict[str, str] = {}
    for position, term in pattern.terms():
        if not is_var(term):
            conditions.append(F.col(position) == F.lit(term))
        elif term in seen:
            conditions.append(F.col(seen[term]) == F.col(position))
        else:
            seen[term] = position
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def scan(triples: DataFrame, pattern: Pattern, carry: Sequence[str] = ()) -> DataFrame:
    """Solutions of one pattern: a string column and a numeric twin per variable."""
    condition = pattern_filter(pattern)
    matched = triples if condition is None else triples.filter(condition)
    position = {}
    for place, term in pattern.terms():
        if is_var(term) and (term not in position or place == "o"):
            position[term] = place
    columns = [F.col(c) for c in carry]
    for term, place in position.items():
        name = var_name(term)
        number = F.col("o_num") if place == "o" else as_number(F.col(place))
        columns += [F.col(place).alias(name), number.alias(twin(name))]
    return matched.select(*columns) if columns else matched.select()


def variables(df: DataFrame) -> list[str]:
    """Names of the bound variables of a solution relation."""
    names = set(df.columns)
    return [c for c in df.columns if not c.endswith(TWIN) and twin(c) in names]


def join_order(patterns: Sequence[Pattern], bound: Iterable[str] = ()) -> list[Pattern]:
    """Most constants first, then always a pattern that shares a variable with what is bound."""
    return linked_order(patterns, lambda p: p.variables, lambda p: p.bound, bound)


def linked_order(items: Sequence, variables_of: Callable, constants_of: Callable, bound: Iterable[str] = ()) -> list:
    rest, known, ordered = list(enumerate(items)), set(bound), []
    while rest:
        linked = [e for e in rest if known & set(variables_of(e[1]))] or rest
        best = max(linked, key=lambda e: (len(known & set(variables_of(e[1]))) + constants_of(e[1]), -e[0]))
        rest.remove(best)
        ordered.append(best[1])
        known |= set(variables_of(best[1]))
    return ordered


def join_solutions(
    left: DataFrame, right: DataFrame, carry: Sequence[str] = (), strategy: str = "auto"
) -> DataFrame:
    """Natural join on all shared variables (and on the carried key)."""
    shared = [v for v in variables(left) if v in set(variables(right))]
    keys = [c for c in carry if c in right.columns and c in left.columns] + shared
    right = right.drop(*[twin(v) for v in shared])
    if not keys:
        return attach(left, right)
    if strategy in _HINTS:
        right = right.hint(_HINTS[strategy])
    elif strategy == "broadcast":
        # Beyond the bound the join stays an ordinary shuffle join.
        right = F.broadcast(right) if weight(right) <= BROADCAST_BYTES else right
    elif strategy != "auto":
        raise ValueError(f"unknown join strategy {strategy!r}")
    return left.join(right, keys, "inner")


def weight(df: DataFrame) -> int:
    """Bytes of the text in a relation, plus an overhead per row."""
    text = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    each = reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in text], F.lit(ROW_BYTES).cast("bigint"))
    return df.select(each.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def attach(left: DataFrame, right: DataFrame) -> DataFrame:
    """Extend every row of one side by a component that shares no variable with it.

    The result is a product by definition.  Both sides are weighed: the lighter one is broadcast if its counted bytes
    are few.  Else the rows of the heavier side are dealt over tasks and the lighter side is repeated for each of them,
    in a merge join of any size in which neither side passes through one place.  A stream can't be weighed and is dealt.
    """
    if not right.columns:
        return left.filter(right.exists())
    if not left.columns:
        return right.filter(left.exists())
    heavy, light = left, right
    if not (left.isStreaming or right.isStreaming):
        left_bytes, right_bytes = weight(left), weight(right)
        heavy, light = (left, right) if left_bytes >= right_bytes else (right, left)
        if min(left_bytes, right_bytes) <= BROADCAST_BYTES:
            return heavy.crossJoin(F.broadcast(light)).select(*left.columns, *right.columns)
    elif right.isStreaming:
        heavy, light = right, left
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heavy.withColumn("__task", F.pmod(F.xxhash64(*heavy.columns), F.lit(tasks)).cast("int"))
    repeated = light.withColumn("__task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    if not (left.isStreaming or right.isStreaming):
        # Spark estimates the repeated rows by those before, and might broadcast all of them.
        repeated = repeated.hint("merge")
    return dealt.join(repeated, "__task").select(*left.columns, *right.columns)


def join_patterns(
    triples: DataFrame,
    patterns: Sequence[Pattern],
    carry: Sequence[str] = (),
    start: DataFrame | None = None,
    strategy: str = "auto",
    tables: Sequence[PropertyTable] = (),
) -> DataFrame:
    """All solutions of a pattern set, optionally extending the solutions in ``start``.

    Where property tables hold the predicates, the patterns about one subject are a single scan.
    """
    groups: list[list[Pattern]] = [[p] for p in patterns]
    scans: dict[int, DataFrame] = {}
    if tables and not carry:
        whole, rest = stars(patterns)
        groups = []
        for star in whole:
            found = scan_star(tables, star)
            if found is None:
                groups += [[p] for p in star]
            else:
                scans[id(star)] = found
                groups.append(star)
        groups += [[p] for p in rest]
    solutions = start
    bound = variables(start) if start is not None else ()
    for group in linked_order(groups, star_variables, lambda g: sum(p.bound for p in g) - len(g) + 1, bound):
        found = scans[id(group)] if id(group) in scans else scan(triples, group[0], carry)
        solutions = found if solutions is None else join_solutions(solutions, found, carry, strategy)
    if solutions is None:
        raise ValueError("no pattern given")
    return solutions


def compatible_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join where an unbound (NULL) shared variable on the right agrees with anything.

    The right side is a VALUES table.  Its rows are grouped by which shared variables they bind, so
    each group is an equi-join on exactly the bound ones.
    """
    shared = [v for v in variables(left) if v in set(variables(right))]
    if not shared:
        return attach(left, right)
    extra = [c for c in right.columns if c not in set(left.columns)]
    shapes = right.select(*[F.col(v).isNotNull().alias(v) for v in shared]).distinct().collect()
    parts = []
    for shape in shapes:
        keys = [v for v in shared if shape[v]]
        group = right.filter(
            reduce(lambda a, b: a & b, [F.col(v).isNotNull() if shape[v] else F.col(v).isNull() for v in shared])
        ).select(*keys, *extra)
        parts.append(left.join(group, keys, "inner") if keys else attach(left, group) if extra else left)
    return reduce(DataFrame.unionByName, [p.select(*left.columns, *extra) for p in parts])
