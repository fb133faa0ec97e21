"""Continuous queries: window, rules, query, relation-to-stream, consumer.

:class:`StreamPlan` is the plan and :class:`StreamQuery` the usual one.  ``evaluate`` replays recorded events with integer time as one batch job;
``trivane.streaming.continuous`` runs the same plan on a Structured Streaming source.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.plans.rules import FACT, Rule, infer
from trivane.query import Around, Select
from trivane.session import materialize
from trivane.store import SPO, TripleStore
from trivane.streaming.r2s import relation_to_stream
from trivane.streaming.windows import OnWindowClose, WindowSpec, arrivals, evaluations, instant, window_contents


@dataclass(frozen=True, kw_only=True)
class StreamPlan:
    """When a window is evaluated and what happens to the answers; what is asked is up to the subclass.

    ``batch`` names the column that numbers the batches of arrivals, for the batch tick.
    """

    window: WindowSpec
    reports: Sequence = (OnWindowClose(),)
    operator: str = "rstream"
    tick: str = "time"
    consumer: Callable[[DataFrame], None] | None = field(default=None, compare=False)
    batch: str = "batch"

    @property
    def instant(self) -> list[str]:
        """Columns that name an evaluation."""
        return instant(self.tick)

    def surroundings(self) -> TripleStore | None:
        """Triples that are there at every evaluation."""
        return None

    def content(self, events: DataFrame, fired: DataFrame) -> DataFrame:
        return window_contents(events, self.window, self.reports, self.tick, self.batch, fired=fired)

    def answers(self, events: DataFrame, fired: DataFrame, around: TripleStore | None = None) -> DataFrame:
        """Distinct result rows of the given evaluations, keyed by instant; ``around`` are the surroundings."""
        raise NotImplementedError

    def fired(self, events: DataFrame) -> DataFrame:
        return evaluations(events, self.window, self.reports, self.tick, self.batch)

    def evaluate(self, events: DataFrame) -> DataFrame:
        """Result rows of a replay, keyed by instant: ``fire_ts``, and per arrival its number."""
        if self.tick == "tuple":
            events = arrivals(events)
        fired = materialize(self.fired(events), "evaluations")
        rows = self.answers(events, fired, self.surroundings())
        columns = [c for c in rows.columns if c not in self.instant]
        out = relation_to_stream(rows, fired, self.operator, columns, self.instant)
        if self.consumer is not None:
            self.consumer(out)
        return out


@dataclass(frozen=True, kw_only=True)
class StreamQuery(StreamPlan):
    """A query, with rules, over window content next to static triples.

    ``background`` holds the static triples; patterns and rules see them at every evaluation.
    """

    query: Select
    rules: Sequence[Rule] = ()
    background: TripleStore | None = None

    def surroundings(self) -> TripleStore | None:
        """The background with what the rules conclude from it alone."""
        if self.background is None or not self.rules:
            return self.background
        store = self.background
        added = infer(store.df.select(*FACT), self.rules, prefixes=store.prefixes, tables=store.tables)
        return TripleStore(store.df.select(*FACT).unionByName(added), store.prefixes)

    def answers(self, events: DataFrame, fired: DataFrame, around: TripleStore | None = None) -> DataFrame:
        content = self.content(events, fired).select(*self.instant, *FACT)
        prefixes = around.prefixes if around else {}
        fixed = around.df.select(*FACT) if around else None
        if self.rules:
            content = materialize(content, "window-content")
            added = infer(content, self.rules, carry=self.instant, background=fixed, prefixes=prefixes)
            content = content.unionByName(added)
        if fixed is None:
            return self.query.run(TripleStore(content, prefixes), carry=self.instant).distinct()
        # A triple that is there anyway counts once.
        content = content.join(fixed.select(*SPO), SPO, "left_anti").select(*self.instant, *FACT)
        there = Around(fixed, fired.select(*self.instant))
        return self.query.run(TripleStore(content, prefixes), self.instant, there).distinct()


class StreamQueryBuilder:
    """Collects the parts of a :class:`StreamQuery`."""

    def __init__(self, width: int, slide: int) -> None:
        self._window = WindowSpec(width, slide)
        self._reports: list = []
        self._rules: list[Rule] = []
        self._background: TripleStore | None = None
        self._query: Select | None = None
        self._operator = "rstream"
        self._tick, self._batch = "time", "batch"
        self._consumer: Callable[[DataFrame], None] | None = None

    def add_report_strategy(self, report) -> StreamQueryBuilder:
        self._reports.append(report)
        return self

    def add_tick(self, tick: str, batch: str = "batch") -> StreamQueryBuilder:
        """``time``, ``tuple`` or ``batch``; the column ``batch`` numbers batches in a replay."""
        self._tick, self._batch = tick, batch
        return self

    def add_triples(self, store: TripleStore) -> StreamQueryBuilder:
        self._background = store
        return self

    def add_rules(self, *rules: Rule) -> StreamQueryBuilder:
        self._rules += rules
        return self

    def add_query(self, query: Select) -> StreamQueryBuilder:
        self._query = query
        return self

    def add_r2s(self, operator: str) -> StreamQueryBuilder:
        self._operator = operator
        return self

    def add_consumer(self, consumer: Callable[[DataFrame], None]) -> StreamQueryBuilder:
        self._consumer = consumer
        return self

    def build(self) -> StreamQuery:
        if self._query is None:
            raise ValueError("a stream query needs a query")
        return StreamQuery(
            window=self._window,
            query=self._query,
            reports=self._reports or [OnWindowClose()],
            rules=self._rules,
            background=self._background,
            operator=self._operator,
            tick=self._tick,
            consumer=self._consumer,
            batch=self._batch,
        )


def windows_joined(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join the results of two named windows that close at the same time.

    Both sides are keyed by ``w_close``; windows of different width meet where their closes coincide.
    """
    return left.join(right, ["w_close", *on], "inner")


def retrieve(catalogue: TripleStore, patterns: Sequence[Sequence[str]], stream: str = "?s", *, every: bool = True,
             active: bool | None = None, state: str = "state") -> DataFrame:
    """Streams of a catalogue that match a pattern set.

    ``every=False`` returns one of them, the first by name.  ``active`` selects by the state triple of the
    catalogue (``active`` or ``latent``).
    """
    asked = [*patterns]
    if active is not None:
        asked.append((stream, state, "active" if active else "latent"))
    found = Select(stream).where(*asked).run(catalogue).distinct()
    return found if every else found.orderBy(F.col(found.columns[0])).limit(1)
