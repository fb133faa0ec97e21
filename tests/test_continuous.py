"""Live queries give what the replay of the events in time gives: all reports, ticks, static triples, restarts."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane.builder import TripleQuery
from trivane.plans.rules import Rule
from trivane.query import Aggregate, Select
from trivane.store import TripleStore
from trivane.streaming import keyed
from trivane.streaming.continuous import ContinuousQuery
from trivane.streaming.engine import StreamQueryBuilder
from trivane.streaming.windows import (
    NonEmptyContent,
    OnContentChange,
    OnWindowClose,
    Periodic,
    WindowSpec,
    evaluations,
    window_contents,
)

SCHEMA = "s string, p string, o string, o_num double, ts bigint"
DELAY = 6


def batches(seed, count=4, late=True):
    """Micro-batches of events, somewhat out of order, some of them too late."""
    draw = random.Random(seed)
    out, clock = [], 3
    for _ in range(count):
        rows = []
        for _ in range(draw.randint(4, 9)):
            clock += draw.choice([0, 0, 1, 2, 5])
            ts = max(1, clock - draw.choice([0, 0, 0, 3, 5, 30 if late else 0]))
            rows.append((f"u{draw.randint(0, 2)}", draw.choice(["temp", "door"]), f"v{draw.randint(0, 2)}", None, ts))
        out.append(rows)
    return out


def in_time(rows, strict=False):
    """The events that are not late, with their batch, and the last watermark."""
    kept, mark = [], None
    for number, batch in enumerate(rows):
        on_time = [r for r in batch if mark is None or r[4] > mark or (r[4] == mark and not strict)]
        kept += [(*r, number) for r in on_time]
        tops = [r[4] for r in on_time]
        if tops:
            mark = max(tops) - DELAY if mark is None else max(mark, max(tops) - DELAY)
    return kept, mark


def as_stream(spark, folder, rows):
    for number, batch in enumerate(rows):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in/n={number:03d}")
    return spark.readStream.schema(SCHEMA + ", n int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("n")


def replayed(spark, rows, plan):
    kept, mark = in_time(rows)
    events = spark.createDataFrame(kept, SCHEMA + ", batch int")
    return plan.evaluate(events).filter(F.col("fire_ts") < mark)


def live(spark, folder, rows, plan, **more):
    query = ContinuousQuery(spark, plan, f"{folder}/query", DELAY, **more)
    running = query.start(as_stream(spark, folder, rows))
    running.awaitTermination(300)
    assert running.exception() is None
    return query.results().drop("batch")


def asked():
    return Select("?u", "?o").where(("?u", "temp", "?o"))


REPORTS = {
    "close": [OnWindowClose()],
    "non_empty": [NonEmptyContent()],
    "change": [OnContentChange()],
    "periodic": [Periodic(1)],
    "all": [OnWindowClose(), NonEmptyContent(), OnContentChange(), Periodic(3)],
}


def builder(reports, operator="rstream", tick="time", width=10, slide=5):
    made = StreamQueryBuilder(width, slide).add_query(asked()).add_r2s(operator).add_tick(tick)
    for report in reports:
        made = made.add_report_strategy(report)
    return made


@pytest.mark.parametrize(
    "name, operator, tick",
    [("close", "istream", "time"), ("change", "dstream", "time"), ("all", "rstream", "batch"), ("non_empty", "istream", "tuple")],
)
def test_live_is_replay(spark, tmp_path, name, operator, tick):
    rows = batches(len(name) + len(tick))
    plan = builder(REPORTS[name], operator, tick).build()
    want = tuples(replayed(spark, rows, plan))
    got = live(spark, tmp_path, rows, plan)
    assert want and tuples(got.select(*replayed(spark, rows, plan).columns)) == want


def test_late_events_change_the_replay(spark):
    """The rows of these tests do contain late events."""
    for name, tick in (("close", "time"), ("change", "time"), ("non_empty", "tuple")):
        rows = batches(len(name) + len(tick))
        assert len(in_time(rows)[0]) < sum(map(len, rows))


def test_static_triples_and_rules(spark, tmp_path, make_store):
    rows = batches(4, count=3, late=False)
    places = make_store([("u0", "in", "hall"), ("u1", "in", "hall"), ("u2", "in", "yard"), ("hall", "in", "house"), ("u1", "temp", "v0")])
    rules = [
        Rule([("?x", "in", "?y"), ("?y", "in", "?z")], [("?x", "in", "?z")]),
        Rule([("?x", "temp", "?t"), ("?x", "in", "?y"), ("?w", "door", "?t"), ("?w", "in", "?y")], [("?x", "near", "?w")]),
    ]
    question = Select("?x", "?w", "?h").where(("?x", "near", "?w"), ("?x", "in", "?h"), ("?h", "in", "house"))
    plan = StreamQueryBuilder(12, 4).add_triples(places).add_rules(*rules).add_query(question).add_r2s("istream").build()
    want = tuples(replayed(spark, rows, plan))
    assert want and tuples(live(spark, tmp_path, rows, plan)) == want
    # By hand: what each window holds, next to the places.
    kept, _ = in_time(rows)
    events = spark.createDataFrame(kept, SCHEMA + ", batch int")
    by_fire = {}
    for r in window_contents(events, WindowSpec(12, 4)).collect():
        by_fire.setdefault(r["fire_ts"], set()).add((r["s"], r["p"], r["o"]))
    found = {}
    for at, content in by_fire.items():
        facts = content | {("u1", "temp", "v0")}
        found[at] = {
            (x, w, "hall") for x, p, t in facts if p == "temp" and x != "u2" for w, q, v in facts if q == "door" and v == t and w != "u2"
        }
    plain = StreamQueryBuilder(12, 4).add_triples(places).add_rules(*rules).add_query(question).build().evaluate(events)
    got = {}
    for r in plain.collect():
        got.setdefault(r["fire_ts"], set()).add((r["x"], r["w"], r["h"]))
    assert got == {at: rows for at, rows in found.items() if rows}


def test_solutions_of_static_triples_alone_hold_at_every_evaluation(spark, make_store):
    events = spark.createDataFrame([("a", "p", "x", None, t) for t in (2, 7, 13, 18)], SCHEMA)
    fixed = make_store([("k", "likes", "m"), ("m", "likes", "n"), ("a", "p", "x")])
    plan = lambda q: StreamQueryBuilder(5, 5).add_triples(fixed).add_query(q).build()
    fired = [r[0] for r in evaluations(events, WindowSpec(5, 5)).select("fire_ts").collect()]
    chain = Select("?x", "?z").where(("?x", "likes", "?y"), ("?y", "likes", "?z"))
    assert tuples(plan(chain).evaluate(events)) == sorted(((t, "k", "n") for t in fired), key=str)
    # A triple that is both static and in the window counts once; unrelated patterns form a product per evaluation.
    count = Select("?n").where(("?s", "p", "?o"), ("?x", "likes", "?y")).agg(Aggregate(F.count, "?y", "n"))
    rows = plan(count).evaluate(events).collect()
    assert sorted(r["fire_ts"] for r in rows) == sorted(fired)


def test_restart_after_a_failure_emits_each_result_once(spark, tmp_path):
    rows = batches(9)
    plan = builder(REPORTS["non_empty"], "istream").build()
    want = tuples(replayed(spark, rows, plan))
    seen, failed = {}, []

    def sink(df, number):
        seen[number] = sorted(tuple(r) for r in df.collect())
        if number == 2 and not failed:
            failed.append(number)
            raise RuntimeError("lost")

    query = ContinuousQuery(spark, plan, f"{tmp_path}/query", DELAY, sink)
    stream = as_stream(spark, tmp_path, rows)
    broken = query.start(stream)
    with pytest.raises(Exception, match="lost"):
        broken.awaitTermination(300)
    first = dict(seen)
    # Another process: a new object with the same folder.
    again = ContinuousQuery(spark, plan, f"{tmp_path}/query", DELAY, sink)
    running = again.start(stream)
    running.awaitTermination(300)
    assert failed == [2] and seen[2] == first[2]
    assert tuples(again.results().drop("batch")) == want
    assert sorted((r for part in seen.values() for r in part), key=str) == want


def test_old_versions_are_removed(spark, tmp_path):
    rows = batches(3, count=6, late=False)
    live(spark, tmp_path, rows, builder(REPORTS["close"], width=4, slide=2).build())
    left = lambda table: sorted(p.name for p in (tmp_path / "query" / table).glob("batch=*"))
    assert len(left("marks")) <= 3 and len(left("log")) < 6 and not left("fired") and not left("answered")


def test_builder_on_a_stream(spark, tmp_path):
    rows = batches(8)
    filters = lambda: TripleQuery(TripleStore(spark.createDataFrame([], SCHEMA))).with_predicate("temp").window(10, 5).offset(1).limit(2)
    kept, mark = in_time(rows)
    want = tuples(filters().stream_results(spark.createDataFrame(kept, SCHEMA + ", batch int")).filter(F.col("fire_ts") < mark))
    query = filters().as_stream(spark, f"{tmp_path}/query", DELAY)
    query.start(as_stream(spark, tmp_path, rows)).awaitTermination(300)
    assert want and tuples(query.results().drop("batch")) == want


# -- per key -----------------------------------------------------------------------------------------------------------


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(keyed.PROVIDER)
    spark.conf.set(keyed.PROVIDER, keyed.ROCKSDB)
    yield
    spark.conf.set(keyed.PROVIDER, before)


@pytest.mark.parametrize("name, tick", [("close", "time"), ("non_empty", "time"), ("change", "time"), ("periodic", "time"), ("change", "tuple")])
def test_windows_per_key(spark, tmp_path, rocksdb, name, tick):
    rows = batches(len(name) * 3, count=5 if name == "periodic" else 3)
    # A last event far ahead moves the watermark past all others.
    rows.append([("end", "end", "end", None, 10_000)])
    spec = WindowSpec(10, 5)
    stream = as_stream(spark, tmp_path, rows).withColumns({"key": F.col("s"), "ts": F.timestamp_seconds("ts")})
    found = []
    query = (
        keyed.reported(stream, ["key"], spec, REPORTS[name], tick, DELAY)
        .writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
        .foreachBatch(lambda df, n: found.extend(df.drop("o_num").collect()))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    kept, _ = in_time(rows, strict=True)
    events = spark.createDataFrame(kept, SCHEMA + ", batch int").withColumn("key", F.col("s")).filter("s != 'end'")
    want = window_contents(events, spec, REPORTS[name], tick, keys=["key"]).drop("o_num")
    if tick == "tuple":
        # Replays number the arrivals of all keys, state those of its key.
        starts = {}
        from trivane.streaming.windows import arrivals

        for r in arrivals(events, ["key"]).groupBy("key").agg(F.min("fire_no").alias("n")).collect():
            starts[r["key"]] = r["n"]
        rows_want = sorted(((r["key"], r["fire_ts"], r["fire_no"] - starts[r["key"]], *tuple(r)[3:]) for r in want.collect()), key=str)
    else:
        rows_want = tuples(want)
    assert rows_want and sorted((tuple(r) for r in found if r["key"] != "end"), key=str) == rows_want


def test_state_store_is_asked_for(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        keyed.reported(spark.readStream.format("rate").load(), ["value"], WindowSpec(1, 1))
