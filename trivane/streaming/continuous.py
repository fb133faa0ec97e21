"""Continuous queries on a live source: a :class:`StreamPlan` evaluated micro-batch by micro-batch.

Each micro-batch appends its events to a log, evaluates the instants that have become final and keeps what the next
one needs, all as tables in one folder, named by the batch's id:

* ``log/batch=N``: the events of the batch that came in time,
* ``answers/batch=N``: the rows of the last evaluation, before relation-to-stream,
* ``results/batch=N``: what the query emits,
* ``marks/batch=N``: how far time has come, and which of the above are alive; written last, so it commits the batch.

A batch that is run again after a failure reads the marks of the batch before and writes the same tables again, so every
result is there exactly once.  Nothing but a row of marks passes through the driver.  Log folders that no window can
reach any more, versions that no restart can ask for and the steps of an evaluation are removed.

Time.  Events carry an integer ``ts``.  The watermark is the latest time seen, minus ``delay``; an event below the
watermark of the batches before is late and is dropped.  An instant is final once the watermark has passed it, since
no event that belongs before it can come any more.  So results are those of the replay of all events in time, up to the
watermark.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trivane.functions.durations import interval
from trivane.session import new_step_dir, passing_steps, remove_dir
from trivane.store import TripleStore, with_number
from trivane.streaming.engine import StreamPlan
from trivane.streaming.r2s import relation_to_stream
from trivane.streaming.windows import ARRIVAL, SPO, arrivals

EVENT = [*SPO, "o_num", "ts", "batch"]


@dataclass(frozen=True)
class Marks:
    """How far a continuous query has come after a batch."""

    # Latest event time seen, and the watermark: instants below it have been evaluated.
    top: int | None = None
    watermark: int | None = None
    # Events below this time can't matter any more.
    cut: int | None = None
    # Arrivals that have been instants.
    arrivals: int = 0
    # Batches whose log may still matter, with their latest time.
    logs: dict[str, int] = field(default_factory=dict)
    # The last instant, and the batch whose answers are its rows.
    last: list[int] | None = None
    answered: int | None = None


class ContinuousQuery:
    """Runs ``plan`` on a stream of ``(s, p, o[, o_num], ts)``; its state and results live in ``folder``.

    Started again with the same folder the query goes on where it stopped.  ``sink`` is called with each batch's results
    and its id, before the batch commits; a sink that is called twice with an id gets the same rows.
    """

    def __init__(
        self,
        spark: SparkSession,
        plan: StreamPlan,
        folder: str | None = None,
        delay: int = 0,
        sink: Callable[[DataFrame, int], None] | None = None,
    ) -> None:
        # Batches are micro-batches here, whatever column numbers them in a replay.
        self.plan = replace(plan, batch="batch")
        self.delay = delay
        self.folder = (folder or new_step_dir(spark, "continuous")).rstrip("/")
        self._spark = spark
        consumer = plan.consumer
        self._sink = sink or (None if consumer is None else lambda df, number: consumer(df))
        self._around: list[TripleStore | None] = []

    def _path(self, table: str, number: int | str) -> str:
        return f"{self.folder}/{table}/batch={number}"

    def marks(self, number: int) -> Marks:
        """The marks after a batch; those before the first batch are empty."""
        if number < 0:
            return Marks()
        return Marks(**json.loads(self._spark.read.text(self._path("marks", number)).first()[0]))

    def results(self) -> DataFrame:
        """What committed batches have emitted, with the id of the batch."""
        newest = self._spark.read.text(f"{self.folder}/marks").agg(F.max("batch")).first()[0]
        found = self._spark.read.parquet(f"{self.folder}/results")
        return found.filter(F.col("batch") <= newest)

    def _keep(self, df: DataFrame, table: str, number: int) -> DataFrame:
        path = self._path(table, number)
        df.write.mode("overwrite").parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def consume(self, batch: DataFrame, number: int) -> None:
        """Process one micro-batch; the function for ``foreachBatch``."""
        before = self.marks(number - 1)
        now = self._take_in(batch, number, before)
        if now.watermark != before.watermark:
            if not self._around:
                self._around.append(self.plan.surroundings())
            with passing_steps(self._spark):
                now = self._evaluate(now, before, number)
        line = self._spark.range(1).select(F.lit(json.dumps(asdict(now))).alias("value"))
        line.coalesce(1).write.mode("overwrite").text(self._path("marks", number))
        self._clean(before, now, number)

    def _take_in(self, batch: DataFrame, number: int, before: Marks) -> Marks:
        """Write the batch's events in time to the log."""
        new = with_number(batch).withColumns({"ts": F.col("ts").cast("bigint"), "batch": F.lit(number)}).select(*EVENT)
        if before.watermark is not None:
            new = new.filter(F.col("ts") >= before.watermark)
        newest = self._keep(new, "log", number).agg(F.max("ts")).first()[0]
        if newest is None:
            return before
        top = newest if before.top is None else max(newest, before.top)
        return replace(before, top=top, watermark=top - self.delay, logs={**before.logs, str(number): newest})

    def _events(self, now: Marks) -> DataFrame:
        """The events that may still matter."""
        schema = "s string, p string, o string, o_num double, ts bigint, batch int"
        events = self._spark.read.schema(schema).parquet(*[self._path("log", n) for n in now.logs])
        return events if now.cut is None else events.filter(F.col("ts") >= now.cut)

    def _evaluate(self, now: Marks, before: Marks, number: int) -> Marks:
        """Evaluate the instants that have become final and write what they give."""
        plan, low, high = self.plan, before.watermark, now.watermark
        events = self._events(now)
        if plan.tick == "tuple":
            # Numbers count all arrivals since the start, of which the log holds the latest only.
            events = arrivals(events)
            evaluated = 0 if low is None else events.filter(F.col("ts") < low).count()
            events = events.withColumn(ARRIVAL, F.col(ARRIVAL) + (before.arrivals - evaluated))

        def final(time: Column) -> Column:
            return time < high if low is None else (time >= low) & (time < high)

        fired = self._keep(plan.fired(events).filter(final(F.col("fire_ts"))), "fired", number)
        ts = F.col("ts")
        latest, count = events.agg(F.max(F.when(ts < high, ts)), F.count_if(final(ts))).first()
        # The next instant reports a window that the latest event below the watermark lies in, or a later one.
        cut = before.cut if latest is None else latest - plan.window.width
        logs = {n: t for n, t in now.logs.items() if cut is None or t >= cut}
        now = replace(now, cut=cut, logs=logs, arrivals=before.arrivals + count)
        last = fired.select(*plan.instant).orderBy(F.col(plan.instant[-1]).desc()).first()
        if last is None:
            return now
        rows = self._keep(plan.answers(events, fired, self._around[0]), "answered", number)
        self._keep(rows.filter(F.col(plan.instant[-1]) == last[-1]), "answers", number)
        out = self._keep(self._emitted(rows, fired, before), "results", number)
        if self._sink is not None:
            self._sink(out, number)
        return replace(now, last=list(last), answered=number)

    def _emitted(self, rows: DataFrame, fired: DataFrame, before: Marks) -> DataFrame:
        """Relation-to-stream, going on from the last evaluation before this batch."""
        keys = self.plan.instant
        columns = [c for c in rows.columns if c not in keys]
        instants = fired.select(*keys)
        if before.last is None:
            return relation_to_stream(rows, instants, self.plan.operator, columns, keys)
        earlier = self._spark.read.schema(rows.schema).parquet(self._path("answers", before.answered))
        known = [F.lit(v).cast("bigint").alias(k) for k, v in zip(keys, before.last, strict=True)]
        instants = instants.unionByName(self._spark.range(1).select(*known))
        out = relation_to_stream(rows.unionByName(earlier), instants, self.plan.operator, columns, keys)
        return out.filter(F.col(keys[-1]) > before.last[-1])

    def _clean(self, before: Marks, now: Marks, number: int) -> None:
        """Remove what neither the next batch nor a repetition of this one reads."""
        gone = [("fired", number), ("answered", number), ("marks", number - 3)]
        if str(number) not in now.logs:
            gone.append(("log", number))
        if number >= 2:
            older = self.marks(number - 2)
            gone += [("log", n) for n in older.logs if n not in before.logs]
            if older.answered not in (None, before.answered, now.answered):
                gone.append(("answers", older.answered))
        for table, n in gone:
            remove_dir(self._spark, self._path(table, n))

    def start(self, stream: DataFrame, every: str | int | None = None) -> StreamingQuery:
        """Run on a streaming DataFrame: all that is available, or at an interval until stopped."""
        trigger = {"availableNow": True} if every is None else {"processingTime": interval(every)}
        writer = stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.foreachBatch(self.consume).trigger(**trigger).start()
