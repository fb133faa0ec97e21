"""Window reports per key as a stateful streaming operator.

Where the events of many streams (sensors, users) come in one source, each key has windows of its own: its state holds the
events that its windows can still reach and the time of its last instant, and an event-time timer per instant reports
when the watermark passes, so nothing that belongs before it can still come.  State is partitioned by key, checkpointed
and restored by Spark; memory is bounded by one window of one key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trivane.functions.durations import interval
from trivane.store import with_number
from trivane.streaming.windows import (
    ARRIVAL,
    SPO,
    NonEmptyContent,
    OnContentChange,
    OnWindowClose,
    Periodic,
    WindowSpec,
    instant,
)

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
# Fixed value: the state store that timers and map state need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def closing(spec: WindowSpec, reports: Sequence, previous: int | None, now: int) -> int | None:
    """Close of the window that an instant reports, before content changes are looked at.

    Windows that hold something were fed by the event before; only those a purely periodic report looks at may be empty.
    """
    kinds = {type(r) for r in reports}
    anchor = previous if kinds & {OnWindowClose, NonEmptyContent, OnContentChange} else now
    if anchor is None or now <= 0 or any(isinstance(r, Periodic) and now % r.period for r in reports):
        return None
    close = (anchor + spec.width) // spec.slide * spec.slide
    if OnWindowClose in kinds:
        latest = now - 1 if spec.closed == "both" else now
        close = min(close, latest // spec.slide * spec.slide)
    first = -(-anchor // spec.slide) * spec.slide if spec.closed == "both" else (anchor // spec.slide + 1) * spec.slide
    return close if close >= first else None


class Reporter(StatefulProcessor):
    """Windows of one key."""

    def __init__(self, spec: WindowSpec, reports: Sequence, tick: str, columns: Sequence[str]) -> None:
        self._spec, self._reports, self._tick, self._columns = spec, tuple(reports), tick, list(columns)
        self._on_change = any(isinstance(r, OnContentChange) for r in reports)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._log = handle.getMapState("log", "ts bigint, s string, p string, o string", "o_num double, n bigint")
        self._last = handle.getValueState("last", "ts bigint, arrivals bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        new: dict[tuple, list] = {}
        for batch in rows:
            for s, p, o, number, ts in zip(batch.s, batch.p, batch.o, batch.o_num, batch["at"], strict=True):
                # Spark lets late rows pass for one batch more; what has been reported stays as it is.
                if 0 < passed and ts <= passed:
                    continue
                entry = new.setdefault((int(ts), s, p, o), [None if pd.isna(number) else float(number), 0])
                entry[1] += 1
        for event, (number, n) in new.items():
            if self._log.containsKey(event):
                known = self._log.getValue(event)
                number, n = known[0] if number is None else number, n + known[1]
            self._log.updateValue(event, (number, n))
        for ts in {event[0] for event in new}:
            self._handle.registerTimer(ts * 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        previous, count = self._last.get() if self._last.exists() else (None, 0)
        logged = [(tuple(event), tuple(entry)) for event, entry in self._log.iterator()]
        numbers = {event[1:]: entry[0] for event, entry in sorted(logged)}
        # Arrivals in order of time and triple; copies come one after another.
        order = sorted((*event, copy) for event, entry in logged for copy in range(entry[1]))
        here = [arrival for arrival in order if arrival[0] == now]
        if self._tick == "time":
            yield from self._report(key, order, numbers, previous, (now,))
        else:
            for number, arrival in enumerate(here, count):
                yield from self._report(key, order, numbers, previous, arrival, number)
                previous = now
        self._last.update((now, count + len(here)))
        for event, _ in logged:
            if event[0] < now - self._spec.width:
                self._log.removeKey(event)

    def _report(self, key, order, numbers, previous, at: tuple, number: int | None = None) -> Iterator[pd.DataFrame]:
        """The content an instant reports: the arrivals before ``at`` that lie in its window."""
        close = closing(self._spec, self._reports, previous, at[0])
        if close is None:
            return
        opened, upper = close - self._spec.width, close if self._spec.closed == "both" else close - 1
        inside = [arrival for arrival in order if arrival < at and opened <= arrival[0] <= upper]
        times: dict[tuple, list[int]] = {}
        for ts, s, p, o, _ in inside:
            times.setdefault((s, p, o), []).append(ts)
        if self._on_change:
            # New is a triple that came with the last instant and was not in the window before it.
            if number is None:
                new = any(min(seen) == previous for seen in times.values())
            else:
                new = len(times[inside[-1][1:4]]) == 1
            if not new:
                return
        if times:
            head = [*key, at[0], *([] if number is None else [number]), max(opened, 0), close]
            yield pd.DataFrame([[*head, *triple, numbers[triple]] for triple in times], columns=self._columns)

    def close(self) -> None:
        pass


def reported(
    stream: DataFrame,
    keys: Sequence[str],
    spec: WindowSpec,
    reports: Sequence = (OnWindowClose(),),
    tick: str = "time",
    delay: str | int = 0,
) -> DataFrame:
    """Content of every window that is reported, per key: ``(keys, instant, w_open, w_close, s, p, o, o_num)``.

    ``stream`` has the keys, ``s, p, o[, o_num]`` and ``ts``, a timestamp that is taken in whole seconds.  Reports and ticks are
    those of :func:`window_contents`, which gives the same rows for recorded events; the batch tick is left to
    :class:`ContinuousQuery`, since a key has no batches.  Events at or below the watermark, the latest time seen in the
    batches before minus ``delay``, are late and dropped.  The session's state store must be RocksDB.
    """
    if tick not in ("time", "tuple"):
        raise ValueError(f"tick {tick!r} is not one of a key's stream")
    if stream.sparkSession.conf.get(PROVIDER, "") != ROCKSDB:
        raise ValueError(f"set {PROVIDER} to {ROCKSDB}")
    rows = with_number(stream).select(*keys, *SPO, "o_num", F.unix_timestamp("ts").alias("at"), F.date_trunc("second", "ts").alias("ts"))
    rows = rows.dropna(subset=SPO).withWatermark("ts", interval(delay))
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    number = f"{ARRIVAL} bigint, " if tick == "tuple" else ""
    schema = f"{kinds}, fire_ts bigint, {number}w_open bigint, w_close bigint, s string, p string, o string, o_num double"
    columns = [*keys, *instant(tick), "w_open", "w_close", *SPO, "o_num"]
    processor = Reporter(spec, reports, tick, columns)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "eventTime")
