"""Fluent triple filter: conditions per position, store joins, ordering, grouping."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.operators import joins
from trivane.operators.sequence import numbered
from trivane.operators.skew import CHUNK_ROWS, chunked, top_rows
from trivane.store import SPO, TripleStore
from trivane.streaming.continuous import ContinuousQuery
from trivane.streaming.engine import StreamPlan
from trivane.streaming.windows import OnWindowClose, WindowSpec

_PLACES = {"subject": "s", "predicate": "p", "object": "o"}


class TripleQuery:
    """Collects conditions; accessors such as :meth:`triples` return DataFrames."""

    def __init__(self, store: TripleStore) -> None:
        self.store = store
        self._conditions: list[Column] = []
        self._joins: list[tuple] = []
        self._other: TripleStore | None = None
        self._distinct = False
        self._sort: list[Column] = []
        self._descending = False
        self._limit: int | None = None
        self._offset = 0
        self._window: WindowSpec | None = None
        self._reports: list = []
        self._operator: str | None = None
        self._tick, self._batch = "time", "batch"

    def _where(self, condition: Column) -> TripleQuery:
        self._conditions.append(condition)
        return self

    # -- position conditions -----------------------------------------------------------------------

    def _exact(self, place: str, value: str) -> TripleQuery:
        return self._where(F.col(_PLACES[place]) == F.lit(self.store.prefixes.expand(value)))

    def with_subject(self, value: str) -> TripleQuery:
        return self._exact("subject", value)

    def with_predicate(self, value: str) -> TripleQuery:
        return self._exact("predicate", value)

    def with_object(self, value: str) -> TripleQuery:
        return self._exact("object", value)

    def with_subject_like(self, part: str) -> TripleQuery:
        return self._where(F.col("s").contains(part))

    def with_predicate_like(self, part: str) -> TripleQuery:
        return self._where(F.col("p").contains(part))

    def with_object_like(self, part: str) -> TripleQuery:
        return self._where(F.col("o").contains(part))

    def with_subject_starting(self, part: str) -> TripleQuery:
        return self._where(F.col("s").startswith(part))

    def with_predicate_starting(self, part: str) -> TripleQuery:
        return self._where(F.col("p").startswith(part))

    def with_object_starting(self, part: str) -> TripleQuery:
        return self._where(F.col("o").startswith(part))

    def with_subject_ending(self, part: str) -> TripleQuery:
        return self._where(F.col("s").endswith(part))

    def with_predicate_ending(self, part: str) -> TripleQuery:
        return self._where(F.col("p").endswith(part))

    def with_object_ending(self, part: str) -> TripleQuery:
        return self._where(F.col("o").endswith(part))

    def filter(self, condition: Column) -> TripleQuery:
        """Any condition over ``s, p, o, o_num``; a pandas UDF also works, at the price of leaving the JVM."""
        return self._where(condition)

    # -- joins -------------------------------------------------------------------------------------

    def join(self, other: TripleStore) -> TripleQuery:
        self._other = other
        return self

    def join_on_subject(self) -> TripleQuery:
        self._joins.append((joins.on_subject, {}))
        return self

    def join_on_predicate(self) -> TripleQuery:
        self._joins.append((joins.on_predicate, {}))
        return self

    def join_on_object(self) -> TripleQuery:
        self._joins.append((joins.on_object, {}))
        return self

    def join_with(
        self,
        equal: Sequence[tuple[str, str]] = (),
        band: joins.Band | None = None,
        where: Column | None = None,
    ) -> TripleQuery:
        """Join on own conditions, written over ``l_s … r_o_num``."""
        self._joins.append((joins.theta, {"equal": equal, "band": band, "where": where}))
        return self

    # -- shaping -----------------------------------------------------------------------------------

    def distinct(self) -> TripleQuery:
        self._distinct = True
        return self

    def order_by(self, *keys: Column | str) -> TripleQuery:
        self._sort = [F.col(k) if isinstance(k, str) else k for k in keys]
        return self

    def asc(self) -> TripleQuery:
        self._descending = False
        return self

    def desc(self) -> TripleQuery:
        self._descending = True
        return self

    def limit(self, rows: int) -> TripleQuery:
        self._limit = rows
        return self

    def offset(self, rows: int) -> TripleQuery:
        self._offset = rows
        return self

    def _order(self) -> list[Column]:
        """The sort keys, then the triple itself, so that slices are well defined."""
        keys = [k.desc_nulls_last() if self._descending else k.asc_nulls_last() for k in self._sort]
        return keys + [F.col(c).asc() for c in SPO]

    def _filtered(self, df: DataFrame) -> DataFrame:
        for condition in self._conditions:
            df = df.filter(condition)
        return df

    def _result(self) -> DataFrame:
        found = self._filtered(self.store.df).select(*SPO, "o_num")
        if self._other is not None and self._joins:
            right = self._other.df.select(*SPO, "o_num")
            parts = [function(found, right, **options) for function, options in self._joins]
            joined = parts[0]
            for part in parts[1:]:
                joined = joined.unionByName(part)
            found = joined.dropDuplicates(SPO) if len(parts) > 1 else joined
        if self._limit is not None:
            found = found.orderBy(*self._order()).offset(self._offset).limit(self._limit)
        elif self._offset:
            ranked = numbered(found, self._order(), "__row", "offset")
            found = ranked.filter(F.col("__row") >= self._offset).drop("__row")
        elif self._sort:
            found = found.orderBy(*self._order())
        return found

    # -- accessors ---------------------------------------------------------------------------------

    def triples(self) -> DataFrame:
        return self._result().select(*SPO)

    def _column(self, place: str) -> DataFrame:
        values = self._result().select(F.col(_PLACES[place]).alias(place))
        return values.distinct() if self._distinct else values

    def subjects(self) -> DataFrame:
        return self._column("subject")

    def predicates(self) -> DataFrame:
        return self._column("predicate")

    def objects(self) -> DataFrame:
        return self._column("object")

    def count(self) -> DataFrame:
        return self._result().agg(F.count("*").alias("n"))

    def ask(self) -> bool:
        return not self._result().isEmpty()

    def group_by(self, key: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        """Groups as ``(key, chunk, n, members)`` with the member triples as an array.

        A group of up to ``chunk_rows`` triples is one row.  A larger one spans several chunks, so that no
        task ever holds a whole hot group.
        """
        keyed = self._result().select(key.alias("key"), *SPO)
        members = F.array_sort(F.collect_list(F.struct(*SPO)))
        split = chunked(keyed, ["key"], SPO, chunk_rows)
        return split.groupBy("key", "chunk").agg(F.count("*").alias("n"), members.alias("members"))

    def group_sizes(self, key: Column) -> DataFrame:
        return self._result().groupBy(key.alias("key")).agg(F.count("*").alias("n"))

    def group_by_subject(self, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        return self.group_by(F.col("s"), chunk_rows)

    def group_by_predicate(self, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        return self.group_by(F.col("p"), chunk_rows)

    def group_by_object(self, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
        return self.group_by(F.col("o"), chunk_rows)

    # -- streams -----------------------------------------------------------------------------------

    def window(self, width: int, slide: int) -> TripleQuery:
        self._window = WindowSpec(width, slide)
        return self

    def with_report_strategy(self, report) -> TripleQuery:
        self._reports.append(report)
        return self

    def with_stream_operator(self, operator: str) -> TripleQuery:
        """``rstream``, ``istream`` or ``dstream``."""
        self._operator = operator
        return self

    def with_tick_strategy(self, tick: str, batch: str = "batch") -> TripleQuery:
        """What is evaluated: ``time`` each event time, ``tuple`` each arrival, ``batch`` the end of each batch."""
        self._tick, self._batch = tick, batch
        return self

    def stream_plan(self) -> FilterPlan:
        """The plan of this query per window.

        The window defaults to 100 wide, 10 apart; reports are added to on-window-close.
        """
        return FilterPlan(
            window=self._window or WindowSpec(100, 10),
            reports=[OnWindowClose(), *self._reports],
            operator=self._operator or "rstream",
            tick=self._tick,
            batch=self._batch,
            asked=self,
        )

    def stream_results(self, events: DataFrame) -> DataFrame:
        """Evaluate over timestamped triples ``(s, p, o, o_num, ts)``: filters and slices apply per window.

        Rows carry ``fire_ts``, with tuple ticks also the number of the arrival.
        """
        return self.stream_plan().evaluate(events)

    def as_stream(
        self,
        spark: SparkSession,
        folder: str | None = None,
        delay: int = 0,
        sink: Callable[[DataFrame, int], None] | None = None,
    ) -> ContinuousQuery:
        """The same on a live source: ``start(stream)``, ``results()``; see :class:`ContinuousQuery`."""
        return ContinuousQuery(spark, self.stream_plan(), folder, delay, sink)

    def _per_instant(self, content: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Filters and slices within each evaluation."""
        content = self._filtered(content)
        if self._limit is not None:
            content = top_rows(content, keys, self._order(), self._limit, self._offset)
        elif self._offset:
            skipped = top_rows(content, keys, self._order(), self._offset)
            content = content.join(skipped.select(*keys, *SPO), [*keys, *SPO], "left_anti")
        return content.select(*keys, *SPO)


@dataclass(frozen=True, kw_only=True)
class FilterPlan(StreamPlan):
    """The filters and slices of a triple query, applied to each evaluated window."""

    asked: TripleQuery

    def answers(self, events: DataFrame, fired: DataFrame, around: TripleStore | None = None) -> DataFrame:
        return self.asked._per_instant(self.content(events, fired), self.instant)
