import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane import TripleQuery
from trivane.operators.joins import Band


def n(query):
    return query.count().first()["n"]


def test_position_conditions(people):
    q = lambda: TripleQuery(people)
    assert n(q()) == 11
    assert n(q().with_subject("http://example.org/person1")) == 4
    assert n(q().with_predicate("ex:name")) == 3
    assert n(q().with_subject_like("person")) == 8
    assert n(q().with_object_like("example.com")) == 2
    assert n(q().with_predicate_ending("For")) == 2
    assert n(q().with_predicate_starting("ex:")) == 11
    assert n(q().filter(F.col("o_num").isNotNull())) == 3
    assert q().with_object("30").ask() and not q().with_object("31").ask()


def test_groups(people):
    groups = {r["key"]: r for r in TripleQuery(people).group_by_predicate().collect()}
    assert groups["ex:name"]["n"] == 3 and groups["ex:age"]["n"] == 2
    assert len(groups["ex:name"]["members"]) == 3
    assert {r["key"]: r["n"] for r in TripleQuery(people).group_sizes(F.col("s")).collect()}["http://example.org/company1"] == 3


def test_accessors_keep_duplicates_unless_distinct(people):
    assert len(TripleQuery(people).predicates().collect()) == 11
    assert len(TripleQuery(people).distinct().predicates().collect()) == 6


def test_order_limit_offset(people):
    ages = TripleQuery(people).with_predicate("ex:age").order_by("o_num").desc()
    assert [r.o for r in ages.triples().collect()] == ["30", "25"]
    ordered = lambda: TripleQuery(people).order_by("o")
    everything = [tuple(r) for r in ordered().triples().collect()]
    assert [tuple(r) for r in ordered().offset(2).limit(3).triples().collect()] == everything[2:5]
    assert tuples(ordered().offset(7).triples()) == sorted(everything[7:])


def test_joins_between_stores(make_store):
    left = make_store([("a", "p", "b"), ("c", "q", "b")])
    right = make_store([("a", "r", "z"), ("b", "p", "w"), ("x", "p", "b")])
    join = lambda: TripleQuery(left).join(right)
    assert tuples(join().join_on_subject().triples()) == [("a", "p", "z")]
    assert tuples(join().join_on_predicate().triples()) == [("a", "p", "b"), ("a", "p", "w")]
    assert tuples(join().join_on_object().triples()) == [("a", "p", "b"), ("c", "p", "b")]
    several = join().join_on_subject().join_on_object().triples()
    assert tuples(several) == [("a", "p", "b"), ("a", "p", "z"), ("c", "p", "b")]


def test_predicate_join_beyond_the_folding_bound(make_store, monkeypatch):
    from trivane.operators import joins

    monkeypatch.setattr(joins, "SMALL_BYTES", 1)
    left, right = make_store([("a", "p", "b"), ("c", "q", "b")]), make_store([("b", "p", "w"), ("x", "p", "b"), ("x", "q", "y")])
    found = TripleQuery(left).join(right).join_on_predicate().triples()
    assert tuples(found) == [("a", "p", "b"), ("a", "p", "w"), ("c", "q", "y")]


def test_theta_join_needs_an_anchor(make_store):
    left, right = make_store([("a", "v", "1"), ("b", "v", "-2.5")]), make_store([("x", "w", "1.9"), ("y", "w", "-3.4")])
    near = TripleQuery(left).join(right).join_with(band=Band("o_num", "o_num", 0.9)).triples()
    assert tuples(near) == [("a", "w", "1.9"), ("b", "w", "-3.4")]
    below = TripleQuery(left).join(right).join_with(band=Band("o_num", "o_num", 0.9), where=F.col("l_o_num") < F.col("r_o_num"))
    assert tuples(below.triples()) == [("a", "w", "1.9")]
    with pytest.raises(ValueError):
        TripleQuery(left).join(right).join_with(where=F.col("l_o") > F.col("r_o")).triples()


def test_stream_results(spark):
    from trivane import TripleStore

    events = spark.createDataFrame(
        [("Alice", "knows", "Bob", 1), ("Bob", "knows", "Charlie", 2), ("Alice", "likes", "Pizza", 3), ("Zed", "likes", "Tea", 20)],
        "s string, p string, o string, ts bigint",
    ).withColumn("o_num", F.lit(None).cast("double"))
    knows = TripleQuery(TripleStore(events.select("s", "p", "o", "o_num"))).with_predicate("knows").window(10, 2)
    # At 3 the window closed at 2 is reported, at 20 the one closed at 12.
    assert tuples(knows.stream_results(events)) == [
        (20, "Bob", "knows", "Charlie"), (3, "Alice", "knows", "Bob"), (3, "Bob", "knows", "Charlie"),
    ]
    gone = TripleQuery(TripleStore(events.select("s", "p", "o", "o_num"))).with_predicate("knows").window(10, 2)
    assert tuples(gone.with_stream_operator("dstream").stream_results(events)) == [(20, "Alice", "knows", "Bob")]
    paged = TripleQuery(TripleStore(events.select("s", "p", "o", "o_num"))).window(10, 2).order_by("s").offset(1)
    assert (3, "Alice", "knows", "Bob") not in tuples(paged.stream_results(events))
