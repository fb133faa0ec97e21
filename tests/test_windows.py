import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane import Select, TripleStore
from trivane.plans.rules import Rule
from trivane.streaming.engine import StreamQueryBuilder, retrieve
from trivane.streaming.r2s import relation_to_stream
from trivane.streaming.windows import (
    NonEmptyContent,
    OnContentChange,
    OnWindowClose,
    Periodic,
    WindowSpec,
    evaluations,
    left_since,
    on_time,
    window_contents,
    window_sets,
)


def stream(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, ts bigint").withColumn("o_num", F.col("o").try_cast("double"))


def ticks(spark, n):
    return stream(spark, [(f"s{i}", "p", "o", i) for i in range(n)])


def test_five_evaluations(spark):
    content = window_contents(ticks(spark, 10), WindowSpec(10, 2))
    sizes = content.groupBy("fire_ts", "w_close").agg(F.count("*").alias("n"))
    assert sorted(tuples(sizes)) == [(1, 0, 1), (3, 2, 3), (5, 4, 5), (7, 6, 7), (9, 8, 9)]


def test_eighty_rows(spark):
    query = StreamQueryBuilder(10, 2).add_query(Select("?s").where(("?s", "p", "o"))).build()
    assert query.evaluate(ticks(spark, 20)).count() == 80


class Replay:
    """Windows event by event: the model the batch form has to agree with, for events in time order."""

    def __init__(self, width, slide, reports):
        self.width, self.slide, self.reports = width, slide, reports
        self.active, self.last, self.fired, self.time = {}, {}, [], 0

    def ready(self, window, content, ts, changed):
        checks = {
            OnWindowClose: lambda r: window < ts,
            NonEmptyContent: lambda r: bool(content),
            OnContentChange: lambda r: changed,
            Periodic: lambda r: ts % r.period == 0,
        }
        return all(checks[type(r)](r) for r in self.reports)

    def at(self, ts, items):
        close = -(-ts // self.slide) * self.slide
        while close <= ts + self.width:
            self.active.setdefault(close, set())
            close += self.slide
        ready = []
        for close, content in self.active.items():
            changed = content != self.last.get(close, set())
            self.last[close] = set(content)
            if self.ready(close, content, ts, changed):
                ready.append(close)
        if ready and ts > self.time:
            self.time = ts
            best = max(ready)
            self.fired.append((ts, max(best - self.width, 0), best, frozenset(self.active[best])))
        self.active = {c: v | set(items) for c, v in self.active.items() if c - self.width <= ts <= c}


CASES = [
    (10, 2, [OnWindowClose()]),
    (7, 3, [OnWindowClose()]),
    (10, 10, [OnWindowClose(), NonEmptyContent()]),
    (9, 3, [NonEmptyContent()]),
    (6, 2, [Periodic(3)]),
    (12, 4, [OnContentChange()]),
    (12, 3, [OnContentChange(), OnWindowClose()]),
    (12, 4, [OnWindowClose(), Periodic(2)]),
]


@pytest.mark.parametrize("width,slide,reports", CASES)
def test_batch_agrees_with_event_by_event(spark, width, slide, reports):
    rng = random.Random(width * 31 + slide)
    rows, ts = [], 1
    for _ in range(80):
        ts += rng.choice([0, 0, 1, 1, 2, 5, 17])
        rows.append((f"s{rng.randrange(3)}", "p", f"o{rng.randrange(2)}", ts))
    replay = Replay(width, slide, reports)
    for at in sorted({r[3] for r in rows}):
        replay.at(at, [r[:3] for r in rows if r[3] == at])
    events = stream(spark, rows)
    fired = tuples(evaluations(events, WindowSpec(width, slide), reports).select("fire_ts", "w_open", "w_close"))
    want = [f[:3] for f in replay.fired]
    if not any(isinstance(r, (OnWindowClose, NonEmptyContent, OnContentChange)) for r in reports):
        fired = [f for f in fired if f[0] in {w[0] for w in want}]
    assert sorted(fired) == sorted(want)
    content = tuples(window_contents(events, WindowSpec(width, slide), reports).select("fire_ts", "s", "p", "o"))
    assert sorted(content) == sorted((f[0], *item) for f in replay.fired for item in f[3])


def test_closed_ends(spark):
    events = stream(spark, [("a", "p", "x", 10)])
    assert [r.w_close for r in window_sets(events, WindowSpec(10, 5)).sort("w_close").collect()] == [10, 15, 20]
    assert [r.w_close for r in window_sets(events, WindowSpec(10, 5, "left")).sort("w_close").collect()] == [15, 20]
    assert WindowSpec.tumbling("PT1M") == WindowSpec(60, 60) and WindowSpec.range("PT1M", "PT10S") == WindowSpec(60, 10)


def test_relation_to_stream(spark):
    rows = spark.createDataFrame([(1, "1", "2"), (1, "1.2", "2.2"), (2, "1", "2"), (2, "1.3", "2.3")], "fire_ts bigint, a string, b string")
    instants = spark.createDataFrame([(1,), (2,), (3,)], "fire_ts bigint")
    out = lambda op: tuples(relation_to_stream(rows, instants, op, ["a", "b"]))
    assert len(out("rstream")) == 4
    assert out("istream") == [(1, "1", "2"), (1, "1.2", "2.2"), (2, "1.3", "2.3")]
    # The evaluation at 3 has no row, so everything of 2 has gone.
    assert out("dstream") == [(2, "1.2", "2.2"), (3, "1", "2"), (3, "1.3", "2.3")]


def test_background_and_rules_mix_with_window_content(spark, make_store):
    background = make_store([("s1", "in", "room"), ("s2", "in", "hall"), ("room", "near", "hall")])
    events = stream(spark, [("s1", "temp", "90", 1), ("s2", "temp", "20", 2), ("s1", "temp", "10", 11), ("s3", "temp", "99", 30)])
    rule = Rule([("?x", "temp", "?t"), ("?x", "in", "?r"), ("?r", "near", "?n")], [("?n", "warm", "?t")])
    asked = Select("?n", "?t").where(("?n", "warm", "?t"))
    query = StreamQueryBuilder(10, 10).add_triples(background).add_rules(rule).add_query(asked).build()
    assert tuples(query.evaluate(events)) == [(11, "hall", "90"), (30, "hall", "10")]
    seen = []
    builder = StreamQueryBuilder(10, 10).add_triples(background).add_query(Select("?x").where(("?x", "temp", "?t")))
    builder.add_r2s("istream").add_consumer(lambda df: seen.append(df.count())).build().evaluate(events)
    assert seen == [2]
    with pytest.raises(ValueError):
        StreamQueryBuilder(1, 1).build()
    tuple_driven = StreamQueryBuilder(10, 10).add_query(Select("?x").where(("?x", "temp", "?t"))).add_tick("tuple").build()
    # The arrivals at 11 and 30 find a window closed, the one at 2 does not.
    assert tuples(tuple_driven.evaluate(events), "fire_ts", "fire_no", "x") == [(11, 2, "s1"), (11, 2, "s2"), (30, 3, "s1")]


def test_difference_between_windows(spark):
    events = stream(spark, [("a", "p", "1", 5), ("b", "p", "1", 8), ("a", "p", "1", 12), ("c", "p", "1", 15)])
    assert tuples(left_since(events, 10, 16, 5)) == [("b", "p", "1")]


def test_late_events(spark):
    rows = [(0, 10), (1, 50), (2, 5), (3, 45), (4, 60), (5, 20)]
    events = spark.createDataFrame(rows, "n bigint, ts bigint")
    # Batches of two: the second sees watermark 50-10, the third 50-10 as well.
    assert tuples(on_time(events, "n", 2, 10)) == [(0, 10), (1, 50), (3, 45), (4, 60)]


def test_retrieve(make_store):
    catalogue = make_store([("st1", "type", "temp"), ("st1", "state", "active"), ("st2", "type", "temp"), ("st2", "state", "latent"), ("st3", "type", "temp"), ("st3", "state", "active")])
    found = lambda **k: tuples(retrieve(catalogue, [("?s", "type", "temp")], **k))
    assert found(active=True) == [("st1",), ("st3",)]
    assert found(active=True, every=False) == [("st1",)]
    assert found(active=False) == [("st2",)] and len(found()) == 3


def test_multi_window_alignment(spark):
    from trivane.streaming.engine import windows_joined

    events = stream(spark, [("u", "k", "1", 3), ("u", "b", "2", 9)])
    one = Select("?u").where(("?u", "k", "?x")).run(TripleStore(window_sets(events, WindowSpec(10, 5))), carry=["w_close"])
    two = Select("?u").where(("?u", "b", "?x")).run(TripleStore(window_sets(events, WindowSpec(5, 5))), carry=["w_close"])
    assert tuples(windows_joined(one, two, ["u"])) == [(10, "u")]
