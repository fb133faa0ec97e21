"""Stream-to-relation windows over logical time, evaluated as a batch over recorded events.

Events are timestamped triples ``(s, p, o, o_num, ts)`` with an integer ``ts``.  Windows close on multiples
of the slide.  An evaluation happens at a distinct event time and sees what arrived before that time.
Because windows lie on a fixed grid, the window that an evaluation reports follows from the event time and
its predecessor by arithmetic; no window has to be kept open or searched.  An evaluation may also be
called for by every arrival or by the end of every batch of arrivals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.functions.durations import seconds
from trivane.operators.sequence import numbered, with_previous

SPO = ["s", "p", "o"]


@dataclass(frozen=True)
class WindowSpec:
    """``closed="both"`` counts events at both ends of a window, ``"left"`` leaves the closing end out."""

    width: int
    slide: int
    closed: str = "both"

    @classmethod
    def tumbling(cls, width: str | int, closed: str = "both") -> WindowSpec:
        return cls(seconds(width), seconds(width), closed)

    @classmethod
    def sliding(cls, width: str | int, step: str | int = 1, closed: str = "both") -> WindowSpec:
        return cls(seconds(width), seconds(step), closed)

    @classmethod
    def range(cls, width: str | int, step: str | int = 1, closed: str = "both") -> WindowSpec:
        return cls(seconds(width), seconds(step), closed)

    def first_close(self, ts: Column) -> Column:
        if self.closed == "both":
            return ts + F.pmod(-ts, F.lit(self.slide))
        return self.on_grid(ts) + self.slide

    def last_close(self, ts: Column) -> Column:
        return self.on_grid(ts + self.width)

    def on_grid(self, ts: Column) -> Column:
        """The last close at or before ``ts``."""
        return ts - F.pmod(ts, F.lit(self.slide))

    def open_of(self, close: Column) -> Column:
        return F.greatest(close - self.width, F.lit(0).cast("bigint"))


@dataclass(frozen=True)
class OnWindowClose:
    """The window has closed before the event."""


@dataclass(frozen=True)
class NonEmptyContent:
    """The window holds something before the event."""


@dataclass(frozen=True)
class OnContentChange:
    """The window's content differs from what it was at the evaluation before."""


@dataclass(frozen=True)
class Periodic:
    """The event time is a multiple of the period."""

    period: int


def assign(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per event and window that contains it, with ``w_open`` and ``w_close``."""
    first, last = spec.first_close(F.col("ts")), spec.last_close(F.col("ts"))
    closes = F.when(first <= last, F.sequence(first, last, F.lit(spec.slide).cast("bigint")))
    placed = events.withColumn("w_close", F.explode(closes))
    return placed.withColumn("w_open", spec.open_of(F.col("w_close")))


def window_sets(events: DataFrame, spec: WindowSpec) -> DataFrame:
    """Content of every window as a set of triples."""
    keys = ["w_open", "w_close"]
    return assign(events, spec).select(*keys, *SPO, "o_num").dropDuplicates([*keys, *SPO])


def _has(reports: Sequence, kind: type) -> bool:
    return any(isinstance(r, kind) for r in reports)


# What may drive evaluations.
TICKS = ("time", "tuple", "batch")
# The number of an arrival, counted in the order of evaluation.
ARRIVAL = "fire_no"


def instant(tick: str) -> list[str]:
    """Columns that name an evaluation; the last one orders evaluations."""
    return ["fire_ts", ARRIVAL] if tick == "tuple" else ["fire_ts"]


def arrivals(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Number the events by key, time and triple, so that every arrival is an instant of its own."""
    if ARRIVAL in events.columns:
        return events
    return numbered(events, [F.col(c) for c in (*keys, "ts", *SPO)], ARRIVAL, "arrivals")


def _points(events: DataFrame, tick: str, batch: str, keys: Sequence[str]) -> DataFrame:
    """Instants that may be evaluated: ``(keys, ts, previous)``, per arrival also its number.

    previous is the time of the event before; the arrival before may have the same time.
    """
    points = with_previous(events, "ts", keys)
    if tick == "batch":
        ends = events.groupBy(*keys, batch).agg(F.max("ts").alias("ts")).select(*keys, "ts").distinct()
        return points.join(ends, [*keys, "ts"], "left_semi")
    if tick == "tuple":
        first = events.groupBy(*keys, "ts").agg(F.min(ARRIVAL).alias("__first"))
        each = events.select(*keys, "ts", ARRIVAL).join(points.join(first, [*keys, "ts"]), [*keys, "ts"])
        same = F.col(ARRIVAL) > F.col("__first")
        return each.withColumn("previous", F.when(same, F.col("ts")).otherwise(F.col("previous"))).drop("__first")
    return points


def evaluations(
    events: DataFrame,
    spec: WindowSpec,
    reports: Sequence = (OnWindowClose(),),
    tick: str = "time",
    batch: str = "batch",
    keys: Sequence[str] = (),
) -> DataFrame:
    """``(keys, fire_ts, previous, w_open, w_close)``: the instants at which a window is reported, and which.

    The tick says which instants there are: each distinct event time, each arrival (``fire_no`` then numbers them), or the
    last event time of each batch, named by the column ``batch``.  All reports have to agree; of the windows that qualify
    the latest one is evaluated.  With ``keys`` every key is a stream of its own.
    """
    if tick not in TICKS:
        raise ValueError(f"unknown tick {tick!r}")
    if tick == "tuple":
        events = arrivals(events, keys)
    holds_something = _has(reports, (OnWindowClose, NonEmptyContent, OnContentChange))
    points = _points(events, tick, batch, keys).filter(F.col("ts") > 0)
    before, now = F.col("previous"), F.col("ts")
    # Windows that hold something were fed by the event before; the others are opened by this event.
    anchor = before if holds_something else now
    upper = spec.last_close(anchor)
    if _has(reports, OnWindowClose):
        latest = now - 1 if spec.closed == "both" else now
        upper = F.least(upper, spec.on_grid(latest))
    fired = points.withColumn("w_close", upper.cast("bigint")).filter(F.col("w_close") >= spec.first_close(anchor))
    for report in reports:
        if isinstance(report, Periodic):
            fired = fired.filter(now % report.period == 0)
    if _has(reports, OnContentChange):
        fired = _changed(fired, events, spec, tick, keys)
    return fired.select(
        *keys,
        now.alias("fire_ts"),
        *([ARRIVAL] if tick == "tuple" else []),
        before.alias("previous"),
        spec.open_of(F.col("w_close")).alias("w_open"),
        "w_close",
    )


def _changed(fired: DataFrame, events: DataFrame, spec: WindowSpec, tick: str, keys: Sequence[str]) -> DataFrame:
    """Evaluations before which the last event put something new into the window."""
    repeats = with_previous(events, "ts", [*keys, *SPO], "same_before")
    oldest = F.coalesce(F.col("same_before"), F.lit(-(2**62)))
    if tick == "tuple":
        # Of equal triples at one time only the first arrival can be new; the next arrival is the one that sees it.
        first = events.groupBy(*keys, "ts", *SPO).agg(F.min(ARRIVAL).alias("__first"))
        newest = repeats.join(first, [*keys, "ts", *SPO]).select((F.col("__first") + 1).alias(ARRIVAL), oldest.alias("oldest"))
        found = fired.join(newest, ARRIVAL)
    else:
        newest = repeats.groupBy(*keys, F.col("ts").alias("previous")).agg(F.min(oldest).alias("oldest"))
        found = fired.join(newest, [*keys, "previous"])
    return found.filter(F.col("oldest") < F.col("w_close") - spec.width)


def window_contents(
    events: DataFrame,
    spec: WindowSpec,
    reports: Sequence = (OnWindowClose(),),
    tick: str = "time",
    batch: str = "batch",
    keys: Sequence[str] = (),
    fired: DataFrame | None = None,
) -> DataFrame:
    """Content of every evaluated window: ``(keys, instant, w_open, w_close, s, p, o, o_num)``.

    The events join the evaluations on the window's close.  A window that holds a large share of the
    events is one join key; AQE splits that partition, since the other side has one row per evaluation.
    ``fired`` are the evaluations, if they are known already.
    """
    if tick == "tuple":
        events = arrivals(events, keys)
    if fired is None:
        fired = evaluations(events, spec, reports, tick, batch, keys)
    names = [*keys, *instant(tick), "w_open", "w_close"]
    placed = assign(events, spec).drop("w_open")
    if tick == "tuple":
        inside = placed.withColumnRenamed(ARRIVAL, "__no").join(fired, [*keys, "w_close"], "inner")
        inside = inside.filter(F.col("__no") < F.col(ARRIVAL))
    else:
        inside = placed.join(fired, [*keys, "w_close"], "inner").filter(F.col("ts") <= F.col("previous"))
    return inside.select(*names, *SPO, "o_num").dropDuplicates([*names, *SPO])


def time_range(events: DataFrame, start: int, end: int) -> DataFrame:
    """Distinct triples with ``start <= ts <= end``."""
    return events.filter(F.col("ts").between(start, end)).select(*SPO).distinct()


def since(events: DataFrame, last: int) -> DataFrame:
    """Every arrival after ``last``; repeated triples stay."""
    return events.filter(F.col("ts") > last).select(*SPO, "ts")


def left_since(events: DataFrame, last: int, now: int, width: int) -> DataFrame:
    """Triples in the window that ends at ``last`` and no longer in the one that ends at ``now``."""
    old = F.max(F.col("ts").between(last - width, last))
    new = F.max(F.col("ts").between(now - width, now))
    seen = events.filter(F.col("ts").between(min(last, now) - width, max(last, now)))
    return seen.groupBy(*SPO).agg(old.alias("__old"), new.alias("__new")).filter("__old and not __new").select(*SPO)


def last_width(events: DataFrame, now: int, width: int) -> DataFrame:
    """Distinct triples of the last ``width`` ticks up to ``now``."""
    return time_range(events, now - width, now)


def on_time(events: DataFrame, arrival: str, batch_rows: int, delay: int) -> DataFrame:
    """Drop events that arrive too late, as a watermark does.

    ``arrival`` numbers the events in arrival order.  Every ``batch_rows`` arrivals form a batch; the
    watermark of a batch is the largest event time of the batches before it, minus ``delay``.
    """
    from trivane.operators.sequence import running_max

    batched = events.withColumn("__batch", F.floor(F.col(arrival) / F.lit(batch_rows)))
    tops = batched.groupBy("__batch").agg(F.max("ts").alias("__top"))
    marks = running_max(tops, "__batch", "__top", "__seen").select("__batch", "__seen")
    kept = batched.join(marks, "__batch", "inner").filter(
        F.col("__seen").isNull() | (F.col("ts") >= F.col("__seen") - delay)
    )
    return kept.drop("__batch", "__seen")
