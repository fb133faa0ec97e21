"""Bloom filters hold every key, and few others."""

from pyspark.sql import functions as F

from trivane.llm import bloom


def test_no_key_is_missed_and_few_others_pass(spark):
    keys = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    table, bits = bloom.bloom(keys.union(spark.createDataFrame([(None,)], "k string")), "k")
    asked = spark.range(20_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    passed = asked.crossJoin(F.broadcast(table)).filter(bloom.may_hold(F.col("words"), bits, F.col("k")))
    found = {r["id"] for r in passed.select("id").collect()}
    assert found >= set(range(3000)) and len(found) < 3000 + 17_000 * 0.05


def test_more_keys_than_bits_lose_none(spark, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 256)
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    table, bits = bloom.bloom(keys, "k")
    assert bits == 256
    assert keys.crossJoin(table).filter(bloom.may_hold(F.col("words"), bits, F.col("k"))).count() == 500


def test_no_keys(spark):
    table, bits = bloom.bloom(spark.createDataFrame([], "k string"), "k")
    rows = spark.createDataFrame([("a",), (None,)], "k string")
    assert rows.crossJoin(table).filter(bloom.may_hold(F.col("words"), bits, F.col("k"))).count() == 0
