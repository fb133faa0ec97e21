"""Benchmark decontamination by winnowing.

Every k-gram of words is hashed and each window of w consecutive k-grams keeps its smallest hash, so any span of
k + w - 1 words that a document shares with a benchmark item leaves a common fingerprint.  A join of fingerprints gives
the documents that can hold a window of an item; their hits are then extended to whole windows.  All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.session import materialize

WINDOW = 10
GRAM = 6
SMALL_BYTES = 8 << 20

# What separates words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; null has none.

    A text of ASCII bytes can go through ``lower``; any other is translated letter by letter.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _grams(hashes: Column, size: int) -> Column:
    """Hash of every run of ``size`` word hashes; none if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(hashes) - size)
    grams = F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    return F.when(F.size(hashes) >= size, grams).otherwise(F.expr("cast(array() as array<bigint>)"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once per row, also where ``then`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), then), 0)


def _fingerprints(grams: Column, width: int) -> Column:
    """Smallest hash of each window of ``width`` k-grams, each once; too few k-grams have none."""

    def least(g: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(g) - width)
        found = F.transform(at, lambda i: F.least(*[F.get(g, i + j) for j in range(width)]))
        return F.when(F.size(g) >= width, F.array_distinct(found)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return _let(grams, least)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a written table if its counted rows are proven small."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def _hashes(df: DataFrame) -> DataFrame:
    return df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: (id_col, n_words, n_hit, items), items being the sorted ids whose windows occur, as text.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window.  A word
    of a document inside any occurrence of a window is hit.

    * Pass 1 joins winnowing fingerprints: k = gram and w = window - gram + 1, so a shared window always shares one.
    * Pass 2 extends the hits: within the documents found, all runs of ``window`` words are joined with the items'.
    * Items shorter than a window can't rely on fingerprints; the runs of just their lengths are joined as well.

    Hits of a document are counted as the union of its occurrences.  Null and empty texts have no words.  Rows with a
    null document id are returned with their words and no hit, rows with a null item id are left out.  Rows that share
    a document id get the union of their hits, once per row.  Empty tables give an empty result or no hits.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("words"))
    items = _hashes(items.filter(F.col("item").isNotNull())).withColumn("n", F.size("words")).filter("n > 0")
    items = materialize(items.select("item", "n", "hashes"), "items")
    own = F.when(F.col("n") >= window, _grams(F.col("hashes"), window))
    lengths = [r["n"] for r in items.filter(F.col("n") < window).select("n").distinct().collect()]  # below `window` rows
    for n in lengths:
        own = own.when(F.col("n") == n, _grams(F.col("hashes"), n))
    windows = items.select("item", F.least("n", F.lit(window)).alias("size"), F.explode(own).alias("g")).distinct()
    windows = materialize(windows, "windows")

    width = window - gram + 1
    prints = items.filter(F.col("n") >= window).select(
        F.explode(_fingerprints(_grams(F.col("hashes"), gram), width)).alias("g")
    )
    prints = materialize(prints.distinct(), "prints")
    split = rows.select("id", words(F.col("text")).alias("words"))
    hashed = _hashes(split).select("id", "hashes")
    counted = materialize(
        hashed.select(
            "id",
            F.size("hashes").alias("n_words"),
            _fingerprints(_grams(F.col("hashes"), gram), width).alias("prints"),
            *[F.array_distinct(_grams(F.col("hashes"), n)).alias(f"short_{n}") for n in lengths],
        ),
        "fingerprints",
    )
    named = counted.filter(F.col("id").isNotNull())
    found = named.select("id", F.explode("prints").alias("g")).join(_small(prints, 16), "g", "left_semi").select("id")
    for n in lengths:
        short = windows.filter(F.col("size") == n).select("g").distinct()
        found = found.union(
            named.select("id", F.explode(f"short_{n}").alias("g")).join(_small(short, 16), "g", "left_semi").select("id")
        )
    found = materialize(found.distinct(), "found")

    near = hashed.join(_small(found, 16), "id", "left_semi")
    runs = None
    for n in [*lengths, window]:
        part = near.select("id", F.posexplode(_grams(F.col("hashes"), n)).alias("at", "g"), F.lit(n).alias("size"))
        runs = part if runs is None else runs.union(part)
    keys = windows.select("g", "size").distinct()
    matched = runs.join(_small(keys, 24), ["g", "size"], "left_semi").distinct()
    hits = materialize(matched.select("id", "at", "size", "g"), "hits")

    by_start = Window.partitionBy("id").orderBy("at", "size")
    reach = F.max(F.col("at") + F.col("size")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("id", "at", "size").distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
    covered = spans.groupBy("id").agg(
        F.sum(F.greatest(F.lit(0), F.col("at") + F.col("size") - F.greatest("at", "reach"))).alias("n_hit")
    )
    touched = (
        hits.select("id", "g", "size").distinct().join(windows, ["g", "size"]).select("id", "item").distinct()
        .groupBy("id").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    )
    result = materialize(covered.join(touched, "id"), "contamination")
    return (
        counted.select("id", "n_words")
        .join(result, "id", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n_words").cast("bigint").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        )
    )
