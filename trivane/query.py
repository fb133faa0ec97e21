"""SELECT queries over a triple store.

Clauses apply in the order they are written, so a filter may use a variable bound before it.  The clause
list is turned into one DataFrame plan; nothing runs until the caller asks for rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.functions.expressions import as_number
from trivane.functions.registry import FunctionRegistry
from trivane.operators.bgp import (
    BROADCAST_BYTES,
    ROW_BYTES,
    compatible_join,
    join_patterns,
    join_solutions,
    variables,
)
from trivane.operators.keyed import join_keyed, join_patterns_keyed, under_every_key, with_fixed
from trivane.operators.skew import top_rows
from trivane.store import SPO, TripleStore, instantiate
from trivane.terms import Pattern, Prefixes, is_var, twin, var_name


@dataclass(frozen=True)
class Aggregate:
    function: Callable[[Column], Column]
    variable: str
    alias: str

    def column(self) -> Column:
        return self.function(F.col(twin(var_name(self.variable)))).alias(self.alias)


def total(variable: str, alias: str) -> Aggregate:
    return Aggregate(F.sum, variable, alias)


def minimum(variable: str, alias: str) -> Aggregate:
    return Aggregate(F.min, variable, alias)


def maximum(variable: str, alias: str) -> Aggregate:
    return Aggregate(F.max, variable, alias)


def avg(variable: str, alias: str) -> Aggregate:
    return Aggregate(F.avg, variable, alias)


def order_columns(keys: Sequence[str | tuple[str, str]], columns: Sequence[str]) -> list[Column]:
    """Total order: numbers before text, ties broken by every remaining column."""
    out: list[Column] = []
    named: set[str] = set()
    for key in keys:
        name, direction = (key, "asc") if isinstance(key, str) else key
        name = var_name(name)
        named.add(name)
        number = F.col(twin(name)) if twin(name) in columns else as_number(F.col(name).cast("string"))
        words = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if direction.lower() == "desc":
            out += [number.desc_nulls_last(), words.desc()]
        else:
            out += [number.asc_nulls_last(), words.asc()]
    rest = [c for c in columns if c not in named and twin(c) in columns]
    return out + [F.col(c).asc_nulls_first() for c in sorted(rest)]


@dataclass(frozen=True)
class Around:
    """What surrounds a keyed store: triples that hold under every key, and the keys there are.

    No triple of the store may be among the fixed ones, or solutions would count twice.
    """

    fixed: DataFrame
    keys: DataFrame

    def unkeyed(self, solutions: DataFrame, carry: Sequence[str]) -> DataFrame:
        return solutions.withColumns({c: F.lit(None).cast(self.keys.schema[c].dataType) for c in carry})

    def keyed(self, solutions: DataFrame, carry: Sequence[str]) -> DataFrame:
        """Solutions without a key hold under each."""
        known = solutions if carry[0] in solutions.columns else self.unkeyed(solutions, carry)
        return under_every_key(known, self.keys, carry)


class Select:
    """``Select("?a", "?b")`` or ``Select()`` for all subject and object variables, sorted by name."""

    def __init__(self, *names: str) -> None:
        self._names = [var_name(n) for n in names]
        self._clauses: list[tuple[str, tuple]] = []
        self._order: list[str | tuple[str, str]] = []
        self._limit: int | None = None
        self._strategy = "auto"
        self._starred: set[str] = set()

    def _then(self, kind: str, *args) -> Select:
        self._clauses.append((kind, args))
        return self

    def where(self, *patterns: Sequence[str]) -> Select:
        """Triple patterns; consecutive calls form one pattern set."""
        return self._then("patterns", list(patterns), None)

    def where_in(self, store: TripleStore, *patterns: Sequence[str]) -> Select:
        """Patterns matched in another store, e.g. static background data next to a window."""
        return self._then("patterns", list(patterns), store)

    def filter(self, condition: Column) -> Select:
        return self._then("filter", condition)

    def bind(self, variable: str, value: Column) -> Select:
        return self._then("bind", var_name(variable), value)

    def call(self, registry: FunctionRegistry, function: str, args: Sequence[str], variable: str) -> Select:
        """``BIND(function(args) AS variable)``."""
        return self.bind(variable, registry.call(function, *args))

    def values(self, names: Sequence[str], rows: Sequence[Sequence[str | None]]) -> Select:
        """Inline bindings; ``None`` leaves a variable unbound."""
        return self._then("values", [var_name(n) for n in names], [tuple(r) for r in rows])

    def subselect(self, inner: Select) -> Select:
        return self._then("subselect", inner)

    def group_by(self, *names: str) -> Select:
        self._then("group", [var_name(n) for n in names], [])
        return self

    def agg(self, *aggregates: Aggregate) -> Select:
        if self._clauses and self._clauses[-1][0] == "group":
            keys = self._clauses.pop()[1][0]
        else:
            keys = []
        return self._then("group", keys, list(aggregates))

    def order_by(self, *keys: str | tuple[str, str]) -> Select:
        self._order = list(keys)
        return self

    def limit(self, rows: int) -> Select:
        """Keep the first ``rows`` rows; 0 means no limit."""
        self._limit = rows or None
        return self

    def strategy(self, name: str) -> Select:
        """Join strategy for the pattern sets: auto, merge, shuffle_hash or broadcast."""
        self._strategy = name
        return self

    # -- evaluation --------------------------------------------------------------------------------

    def _inline(self, spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
        table = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        table = table.select(*[c for n in names for c in (F.col(n), as_number(F.col(n)).alias(twin(n)))])
        size = sum(ROW_BYTES + sum(len(v.encode()) for v in row if v is not None) for row in rows)
        return F.broadcast(table) if size <= BROADCAST_BYTES else table

    def _step(
        self, solutions: DataFrame | None, store: TripleStore, clause: tuple, carry: list[str], around: Around | None
    ):
        kind, args = clause
        if kind == "patterns":
            source = args[1] or store
            parsed = [Pattern.of(t, store.prefixes) for t in args[0]]
            for p in parsed:
                self._starred |= {var_name(t) for t in (p.s, p.o) if is_var(t)}
            keys = [] if args[1] else carry
            if around is not None and keys:
                relation = with_fixed(store.df, around.fixed, keys, [*SPO, "o_num"])
                if solutions is not None and keys[0] not in solutions.columns:
                    solutions = around.unkeyed(solutions, keys)
                return join_patterns_keyed(relation, parsed, keys, solutions)
            return join_patterns(source.df, parsed, keys, solutions, self._strategy, source.tables)
        if kind == "values":
            names, rows = args
            table = self._inline(store.spark, names, [tuple(v and store.prefixes.expand(v) for v in r) for r in rows])
            self._starred |= set(names)
            if solutions is None:
                return table
            if any(v is None for r in rows for v in r):
                return compatible_join(solutions, table)
            return join_solutions(solutions, table)
        if kind == "subselect":
            inner = args[0].solutions(store, carry, around)
            self._starred |= set(variables(inner))
            if solutions is None:
                return inner
            if around is not None:
                known = solutions if carry[0] in solutions.columns else around.unkeyed(solutions, carry)
                return join_keyed(known, inner, carry)
            return join_solutions(solutions, inner, carry)
        if solutions is None:
            raise ValueError(f"{kind} needs a pattern, VALUES or subselect before it")
        if kind == "filter":
            return solutions.filter(args[0])
        if kind == "bind":
            name, value = args
            return solutions.withColumn(name, value).withColumn(twin(name), as_number(F.col(name).cast("string")))
        names, aggregates = args
        if around is not None:
            solutions = around.keyed(solutions, carry)
        grouped = solutions.groupBy(*carry, *names)
        twins = [F.first(twin(n), ignorenulls=True).alias(twin(n)) for n in names]
        summed = grouped.agg(*twins, *[a.column() for a in aggregates])
        for a in aggregates:
            summed = summed.withColumn(twin(a.alias), F.col(a.alias))
        return summed

    @staticmethod
    def _late_values(clauses: list[tuple]) -> list[tuple]:
        """VALUES with unbound cells goes after the patterns, whose variables are always bound."""
        late = [c for c in clauses if c[0] == "values" and any(v is None for r in c[1][1] for v in r)]
        if not late:
            return clauses
        rest = [c for c in clauses if c not in late]
        last = max((i for i, c in enumerate(rest) if c[0] in ("patterns", "subselect")), default=-1)
        return rest[: last + 1] + late + rest[last + 1 :]

    @staticmethod
    def _merged(clauses: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for kind, args in clauses:
            if kind == "patterns" and out and out[-1][0] == "patterns" and out[-1][1][1] is args[1]:
                out[-1] = ("patterns", (out[-1][1][0] + args[0], args[1]))
            else:
                out.append((kind, args))
        return out

    def solutions(self, store: TripleStore, carry: Sequence[str] = (), around: Around | None = None) -> DataFrame:
        """Solution relation: carried key, selected variables and their numeric twins.

        With ``around`` every pattern also matches its fixed triples, which hold under each of its keys.
        """
        keys, solutions = list(carry), None
        self._starred = set()
        for clause in self._merged(self._late_values(self._clauses)):
            solutions = self._step(solutions, store, clause, keys, around)
        if solutions is None:
            raise ValueError("the query has no clause")
        if around is not None:
            solutions = around.keyed(solutions, keys)
        names = self._names or sorted(self._starred)
        missing = [n for n in names if n not in solutions.columns]
        for n in missing:
            solutions = solutions.withColumn(n, F.lit(None).cast("string")).withColumn(twin(n), F.lit(None).cast("double"))
        if self._order or self._limit:
            order = order_columns(self._order, solutions.columns)
            if keys and self._limit:
                solutions = top_rows(solutions, keys, order, self._limit)
            elif self._limit:
                solutions = solutions.orderBy(*order).limit(self._limit)
            elif not keys:
                solutions = solutions.orderBy(*order)
        return solutions.select(*keys, *[c for n in names for c in (n, twin(n)) if c in solutions.columns])

    def run(self, store: TripleStore, carry: Sequence[str] = (), around: Around | None = None) -> DataFrame:
        """One column per selected variable; unbound is NULL."""
        solved = self.solutions(store, carry, around)
        return solved.select(*carry, *[c for c in variables(solved) if c not in carry])

    def rows_as_text(self, store: TripleStore) -> DataFrame:
        """The same rows as text with ``""`` for unbound, as a client prints them."""
        solved = self.run(store)
        return solved.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in solved.columns])

    def construct(self, store: TripleStore, template: Sequence[Sequence[str]]) -> DataFrame:
        """Triples built from the solutions."""
        return instantiate(self.solutions(store), [Pattern.of(t, store.prefixes) for t in template])
