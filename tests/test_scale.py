"""Hot keys, order-dependent helpers, and the shape of physical plans."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import tuples
from trivane import Select, TripleStore
from trivane.functions.expressions import compare
from trivane.operators import dictionary, sequence, skew


@pytest.fixture(scope="module")
def lopsided(spark):
    """A key holds a third of the rows."""
    return spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.col("id").alias("v")
    )


def test_hot_keys_are_few(lopsided):
    assert tuples(skew.hot_keys(lopsided, ["k"])) == [("hot",)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, lopsided, how):
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k4", 4), ("none", 5)], "k string, w int")
    plain, salted = lopsided.join(right, ["k"], how), skew.salted_join(lopsided, right, ["k"], how)
    assert sorted(plain.columns) == sorted(salted.columns)
    assert tuples(salted, *sorted(plain.columns)) == tuples(plain, *sorted(plain.columns))


def test_salted_join_spreads_the_hot_key(spark, lopsided):
    hot = skew.hot_keys(lopsided, ["k"]).withColumn("__hot", F.lit(True))
    salted = lopsided.join(hot, ["k"]).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(skew.SALT)))
    sizes = [r["count"] for r in salted.groupBy("salt").count().collect()]
    assert len(sizes) == skew.SALT and max(sizes) < 80


def test_chunks_are_bounded(lopsided):
    split = skew.chunked(lopsided, ["k"], ["v"], rows=100)
    sizes = {(r.k, r.chunk): r["count"] for r in split.groupBy("k", "chunk").count().collect()}
    assert sum(sizes.values()) == 6000
    assert max(sizes.values()) < 200 and sum(k == "hot" for k, _ in sizes) == 20
    assert all(c == 0 for k, c in sizes if k != "hot")


def test_top_rows_per_key(spark, lopsided):
    best = skew.top_rows(lopsided, ["k"], [F.col("v").desc()], 2, 1)
    assert [r.v for r in best.filter("k = 'hot'").sort("v").collect()] == [5991, 5994]


def test_previous_value_crosses_ranges(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BUCKETS", 5)
    rng = random.Random(1)
    values = [(rng.choice("ab"), rng.randrange(1000)) for _ in range(60)]
    df = spark.createDataFrame(values, "k string, t bigint")
    plain = sorted({t for _, t in values})
    assert sorted(tuples(sequence.with_previous(df, "t")), key=lambda r: r[0]) == list(zip(plain, [None, *plain]))
    got = {(r.k, r.t): r.previous for r in sequence.with_previous(df, "t", ["k"]).collect()}
    for k in "ab":
        mine = sorted({t for key, t in values if key == k})
        assert [got[(k, t)] for t in mine] == [None, *mine[:-1]]


def test_running_max(spark, monkeypatch):
    monkeypatch.setattr(sequence, "BUCKETS", 4)
    values = [(i, (i * 37) % 101) for i in range(50)]
    df = spark.createDataFrame(values, "n bigint, v bigint")
    got = {r.n: r.seen for r in sequence.running_max(df, "n", "v", "seen").collect()}
    assert got == {i: max((v for j, v in values if j < i), default=None) for i, _ in values}


def test_dense_numbers(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = [tuple(r) for r in sequence.numbered(df, [F.col("v")]).sort("row_no").collect()]
    assert [n for _, n in got] == list(range(5000)) and [v for v, _ in got] == sorted(v for v, _ in got)


def test_dictionary_round_trip(make_store):
    one = make_store([("a", "p", "b"), ("b", "p", "c")]).df
    two = make_store([("c", "q", "a")]).df
    ids = dictionary.build(one, two)
    assert {r.term: r.id for r in ids.collect()} == {"a": 0, "b": 1, "c": 2, "p": 3, "q": 4}
    assert tuples(dictionary.decode(dictionary.encode(two, ids), ids)) == [("c", "q", "a")]


# -- plans ---------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_read_only_what_they_bind(spark):
    from workloads.tables import store

    found = Select("?c").where(("?c", "balance", "?b")).filter(compare("?b", ">", 5000)).run(store(spark, SF))
    text = plan(found)
    assert text.count("FileScan") == 2  # customers and suppliers, of seven tables
    assert "GreaterThan(c_acctbal,5000.0)" in text and "GreaterThan(s_acctbal,5000.0)" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in text


def test_a_star_is_one_scan_or_one_shuffle_per_pattern(spark):
    from workloads.tables import store

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        star = Select("?o", "?s", "?p").where(("?o", "status", "?s"), ("?o", "priority", "?p"), ("?o", "total", "?t"))
        orders = store(spark, SF, "orders")
        narrow = TripleStore(orders.df)
        assert plan(star.run(orders)).count("Exchange") == 0 and plan(star.run(orders)).count("FileScan") == 1
        assert plan(star.run(narrow)).count("Exchange hashpartitioning") == 3
        assert tuples(star.run(orders)) == tuples(star.run(narrow))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stars_over_tables_and_over_triples_agree(spark):
    from trivane.terms import about
    from workloads.tables import store

    wide = store(spark, SF, "customer", "supplier", "nation", "part")
    narrow = TripleStore(wide.df)
    queries = [
        Select("?x", "?b").where(*about("?x", ("partOf", "?n"), ("balance", "?b")), ("?n", "partOf", "region/1")),
        Select("?x").where(*about("?x", ("name", "?a"), ("partOf", "nation/3"))),
        Select("?p", "?o").where(("customer/7", "segment", "?s"), ("customer/7", "?p", "?o")),
        Select("?x", "?y").where(("?x", "parent", "?y"), ("?y", "brand", "?b"), ("?x", "brand", "?b")),
        Select("?a", "?b").where(("?x", "segment", "?a"), ("?x", "segment", "?b")),
        Select("?x").where(("?x", "nothing", "?y")),
    ]
    for asked in queries:
        assert tuples(asked.run(wide)) == tuples(asked.run(narrow))


def test_adaptive_execution_splits_a_skewed_pattern_join(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60000, 1, 8).select(
            F.concat(F.lit("s"), "id").alias("s"),
            F.lit("in").alias("p"),
            F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("o"), "id")).alias("o"),
        )
        names = rows.select(F.col("o").alias("s"), F.lit("name").alias("p"), F.col("o")).distinct()
        found = Select("?x", "?n").where(("?x", "in", "?h"), ("?h", "name", "?n")).strategy("merge").run(TripleStore(rows.union(names)))
        assert len(found.collect()) == 60000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_broadcast_is_dropped_beyond_its_bound(make_store, monkeypatch):
    from trivane.operators import bgp

    data = make_store([("a", "p", "b"), ("b", "q", "c")])
    asked = Select("?x").where(("?x", "p", "?y"), ("?y", "q", "?z")).strategy("broadcast")
    assert tuples(asked.run(data)) == [("a",)]
    monkeypatch.setattr(bgp, "BROADCAST_BYTES", 0)
    assert "broadcast" not in str(asked.run(data)._jdf.queryExecution().analyzed()).lower()
    assert tuples(asked.run(data)) == [("a",)]
