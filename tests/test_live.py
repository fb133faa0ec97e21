"""Structured Streaming gives what the batch form gives."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane.plans.rules import Rule
from trivane.streaming import live
from trivane.streaming.windows import WindowSpec, window_sets

SCHEMA = "s string, p string, o string, o_num double, at bigint"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Recorded events as a file stream, with a last event far ahead that closes every window."""
    folder = str(tmp_path_factory.mktemp("feed"))
    rows = [(f"u{i % 4}", ["click", "buy"][i % 2], f"i{i % 5}", float(i), 10 + i * 7) for i in range(60)]
    spark.createDataFrame([*rows, ("end", "end", "end", 0.0, 10_000)], SCHEMA).repartition(1).sortWithinPartitions("at").write.mode("append").parquet(folder)
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = spark.readStream.schema(SCHEMA).parquet(folder).withColumn("ts", F.timestamp_seconds("at"))
    return batch.withColumn("ts", F.col("at")), stream


def gathered(spark, result, *columns):
    """Everything a query emits, through the consumer interface."""
    parts = []
    query = live.start(result, lambda df, n: parts.extend(tuple(r) for r in df.select(*columns).collect()))
    query.awaitTermination(120)
    assert query.exception() is None
    return sorted((p for p in parts if "end" not in p), key=str)


def ends():
    return F.unix_timestamp("w_end").alias("close")


def test_window_contents(spark, feed):
    batch, stream = feed
    want = window_sets(batch, WindowSpec(60, 20, "left")).filter("w_close <= 9000").select(F.col("w_close").alias("close"), "s", "p", "o")
    assert gathered(spark, live.contents(stream, 60, 20), ends(), "s", "p", "o") == tuples(want)


def test_aggregates(spark, feed):
    batch, stream = feed
    from trivane.streaming.windows import assign

    peak = F.max("o_num").alias("peak")
    want = assign(batch, WindowSpec(60, 60, "left")).groupBy(F.col("w_close").alias("close"), "p").agg(peak)
    assert gathered(spark, live.aggregate(stream, ["p"], [peak], 60), ends(), "p", "peak") == tuples(want)


def test_content_changes(spark, feed):
    batch, stream = feed
    want = window_sets(batch, WindowSpec(60, 60, "left")).select(F.col("w_close").alias("close"), "s", "p", "o")
    assert gathered(spark, live.content_changes(stream, 60), ends(), "s", "p", "o") == tuples(want)


@pytest.mark.parametrize("operator", ["istream", "dstream"])
def test_difference_of_consecutive_windows(spark, feed, operator):
    batch, stream = feed
    sets = window_sets(batch, WindowSpec(60, 20, "left")).select("w_close", "s", "p", "o")
    moved = sets.withColumn("w_close", F.col("w_close") + 20)
    want = sets.exceptAll(moved) if operator == "istream" else moved.exceptAll(sets)
    got = gathered(spark, live.insertions_and_deletions(stream, operator, 60, 20), ends(), "s", "p", "o")
    assert got == tuples(want.select(F.col("w_close").alias("close"), "s", "p", "o"))


def test_late_rows_are_dropped(spark, tmp_path):
    folder = tmp_path / "late"
    for n, at in enumerate([100, 500, 510, 120, 495, 900, 901]):
        one = spark.createDataFrame([("u", "p", f"o{n}", 0.0, at)], SCHEMA)
        one.coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    stream = stream.withColumn("ts", F.timestamp_seconds("at"))
    got = gathered(spark, live.contents(stream, 60, delay=10), ends(), "o")
    # The watermark is at 490 when the fourth event arrives, two batches after the one that moved it there.
    assert got == [(120, "o0"), (540, "o1"), (540, "o2"), (540, "o4")]


def test_background_and_rules(spark, feed):
    batch, stream = feed
    names = spark.createDataFrame([("u0", "Ann"), ("u1", "Bob")], "s string, name string")
    joined = live.with_background(stream, names, ["s"])
    assert {r[0] for r in gathered(spark, joined, "name")} == {"Ann", "Bob"}
    rule = Rule([("?u", "click", "?i"), ("?v", "buy", "?i")], [("?u", "inspired", "?v")])
    found = []
    sink = lambda df, n: found.extend(tuple(r) for r in df.filter("p = 'inspired'").select(F.unix_timestamp("w_end"), "s", "o").collect())
    query = live.start(live.contents(stream, 60), live.rules_per_window([rule])(sink))
    query.awaitTermination(120)
    assert query.exception() is None
    sets = window_sets(batch, WindowSpec(60, 60, "left"))
    a, b = sets.filter("p = 'click'").alias("a"), sets.filter("p = 'buy'").alias("b")
    want = a.join(b, (F.col("a.w_close") == F.col("b.w_close")) & (F.col("a.o") == F.col("b.o"))).select("a.w_close", "a.s", "b.s").distinct()
    assert found and sorted(found, key=str) == tuples(want)


def test_two_streams(spark, feed):
    _, stream = feed
    timed = stream.withWatermark("ts", "1 seconds").select("s", "p", "o", "ts")
    both = live.named_windows_joined(timed.filter("p = 'click'"), timed.filter("p = 'buy'"), ["o"], 35)
    rows = gathered(spark, both, "l_s", "r_s", "l_o")
    assert rows and all(a in ("u0", "u2") and b in ("u1", "u3") for a, b, _ in rows)


def test_stop(spark, feed):
    _, stream = feed
    query = live.start(live.contents(stream, 60), lambda df, n: None, every=1)
    assert query.isActive
    query.stop()
    assert not query.isActive
