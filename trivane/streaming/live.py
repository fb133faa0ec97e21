"""The window and relation-to-stream operators on Structured Streaming sources.

Streams are DataFrames ``(s, p, o, o_num, ts)`` with ``ts`` a timestamp.  Windows are half-open
``[start, end)``, late rows beyond the declared delay are dropped by the watermark, and every operator is a
native streaming aggregation, de-duplication or join, so state is partitioned, checkpointed and evicted by
Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trivane.functions.durations import interval, seconds
from trivane.session import new_step_dir

SPO = ["s", "p", "o"]


def windowed(stream: DataFrame, width: str | int, slide: str | int | None = None, delay: str | int = 0) -> DataFrame:
    """Add the window each row falls into (one row per window), as ``w_start`` and ``w_end``."""
    keyed = stream.withWatermark("ts", interval(delay)).withColumn(
        "window", F.window("ts", interval(width), interval(slide or width))
    )
    return keyed


def contents(stream: DataFrame, width: str | int, slide: str | int | None = None, delay: str | int = 0) -> DataFrame:
    """Window contents as sets: the count of arrivals per window and triple, emitted when the window closes."""
    spread = windowed(stream, width, slide, delay)
    counted = spread.groupBy("window", *SPO).agg(F.count("*").alias("arrivals"))
    return counted.select(
        F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *SPO, "arrivals"
    )


def aggregate(
    stream: DataFrame, keys: Sequence[str], values: Sequence[Column], width: str | int,
    slide: str | int | None = None, delay: str | int = 0,
) -> DataFrame:
    """Grouped aggregates per window."""
    grouped = windowed(stream, width, slide, delay).groupBy("window", *keys).agg(*values)
    return grouped.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), "*").drop("window")


def content_changes(stream: DataFrame, width: str | int, slide: str | int | None = None, delay: str | int = 0) -> DataFrame:
    """Each triple the first time it enters a window: the changes of the window's content set."""
    # A stream may carry one event-time column only; behind the window the time itself is plain data.
    spread = windowed(stream, width, slide, delay).withColumn("at", F.timestamp_micros(F.unix_micros("ts")))
    first = spread.select("window", *SPO, "at").dropDuplicates(["window", *SPO])
    return first.select(F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *SPO, "at")


def insertions_and_deletions(
    stream: DataFrame, operator: str, width: str | int, slide: str | int, delay: str | int = 0
) -> DataFrame:
    """istream / dstream between consecutive windows of the grid.

    Every row is marked in its own windows and in the windows one slide later; one streaming aggregation
    per (window, triple) tells new rows from those gone.
    """
    wanted = {"istream": 1, "dstream": 2}[operator]
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds(slide)))
    marks = F.explode(
        F.array(
            F.struct(F.col("ts").alias("at"), F.lit(1).alias("mark")),
            F.struct((F.col("ts") + step).alias("at"), F.lit(2).alias("mark")),
        )
    )
    marked = stream.withColumn("__m", marks).select(F.col("__m.at").alias("at"), F.col("__m.mark").alias("mark"), *SPO)
    # The marked times run one slide ahead of the events, and so does the delay.
    keyed = marked.withWatermark("at", interval(seconds(delay) + seconds(slide)))
    grouped = keyed.groupBy(F.window("at", interval(width), interval(slide)), *SPO).agg(F.bit_or("mark").alias("mark"))
    return grouped.filter(F.col("mark") == wanted).select(
        F.col("window.start").alias("w_start"), F.col("window.end").alias("w_end"), *SPO
    )


def with_background(stream: DataFrame, background: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Stream-static join: static triples next to the stream, state-free."""
    return stream.join(background, list(on), how)


def named_windows_joined(left: DataFrame, right: DataFrame, on: Sequence[str], within: str | int) -> DataFrame:
    """Join two streams on ``on`` where the right time is at most ``within`` away from the left one.

    Both inputs carry ``ts`` with a watermark; the time bound lets Spark evict join state.
    """
    l_side = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns])
    r_side = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds(within)))
    condition = (F.col("r_ts") >= F.col("l_ts") - span) & (F.col("r_ts") <= F.col("l_ts") + span)
    for c in on:
        condition = condition & (F.col(f"l_{c}") == F.col(f"r_{c}"))
    return l_side.join(r_side, condition, "inner")


def start(
    result: DataFrame,
    consumer: Callable[[DataFrame, int], None],
    *,
    mode: str = "append",
    every: str | int | None = None,
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Run a streaming result into a consumer called per micro-batch.

    Without ``every`` all available input is processed and the query ends; with it the query fires at
    that interval until stopped.  Progress is kept in ``checkpoint``; a query started again with the same folder
    goes on where it stopped.  Without it the query has a folder of its own and starts from the beginning.
    """
    writer = (
        result.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or new_step_dir(result.sparkSession, "stream"))
        .foreachBatch(consumer)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": interval(every)}
    return writer.trigger(**trigger).start()


def rules_per_window(rules, background: DataFrame | None = None):
    """Consumer that materialises rules over each micro-batch of closed windows; wrap it around a sink."""
    from trivane.plans.rules import FACT, infer
    from trivane.session import materialize
    from trivane.store import with_number

    def wrap(sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def consume(batch: DataFrame, number: int) -> None:
            content = materialize(with_number(batch).select("w_end", *FACT), "closed-windows")
            added = infer(content, rules, carry=["w_end"], background=background)
            sink(content.unionByName(added), number)

        return consume

    return wrap
