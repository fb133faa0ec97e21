"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, turns every vector into the string of its sides and sorts all vectors by it.  Close
vectors tend to stand close together, so only neighbours within a bounded window are compared, in double precision.
Pairs that reach the threshold in any pass are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trivane.llm.links import components
from trivane.llm.text import bounded_batches
from trivane.session import materialize

BITS = 32
BLOCK = 256
MISS = 1e-3


def passes_for(rows: int, cosine: float, block: int = BLOCK, miss: float = MISS) -> int:
    """Passes after which a pair at the threshold has been in one window with probability 1 - miss.

    Two vectors share a side of a random hyperplane with probability 1 - angle / pi.  They surely meet in a pass if
    they share the first log2(rows / block) sides, after which about a block of vectors is left.
    """
    if rows <= 2 * block:
        return 1
    together = (1 - math.acos(cosine) / math.pi) ** math.log2(rows / block)
    return math.ceil(math.log(miss) / math.log(1 - together))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors in double precision as bytes; null for vectors that can't be compared."""
    for batch in batches:
        out: list[bytes | None] = []
        for value in batch.column(1).to_pylist():
            good = None
            if value and None not in value:
                x = np.array(value, np.float64)
                if np.isfinite(x).all() and x.any():
                    x /= np.abs(x).max()
                    good = (x / np.sqrt(x @ x)).tobytes()
            out.append(good)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])


def _sides(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            units = batch.column(1).to_pylist()
            codes = np.zeros((len(units), passes), np.int64)
            sizes = np.array([len(u) // 8 for u in units], np.int64)
            for size in np.unique(sizes).tolist():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, passes * BITS))
                own = np.flatnonzero(sizes == size)
                x = np.frombuffer(b"".join(units[i] for i in own), np.float64).reshape(len(own), size)
                side = (x @ planes[size] > 0).reshape(len(own), passes, BITS)
                codes[own] = side @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            flat = pa.array(np.repeat(np.arange(len(units)), passes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(flat),
                    pa.array(np.tile(np.arange(passes, dtype=np.int32), len(units))),
                    pa.array(np.repeat(sizes, passes)),
                    pa.array(codes.ravel()),
                ],
                names=["id", "pass", "size", "code"],
            )

    return run


def _compared(cosine: float):
    """Links within the rows of one pair of blocks; of two different blocks only links across count."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("block").to_numpy()
        ids = np.array(table.column("id").to_pylist(), object)
        units = table.column("unit").to_pylist()
        left, right = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found_a, found_b = [], []
        sizes = np.array([len(u) for u in units])
        for size in np.unique(sizes):
            a, b = np.flatnonzero((block == left) & (sizes == size)), np.flatnonzero((block == right) & (sizes == size))
            if not len(a) or not len(b):
                continue
            x = np.frombuffer(b"".join(units[k] for k in a), np.float64).reshape(len(a), -1)
            y = np.frombuffer(b"".join(units[k] for k in b), np.float64).reshape(len(b), -1)
            p, q = np.nonzero(x @ y.T >= cosine)
            one, two = ids[a[p]], ids[b[q]]
            found_a.append(np.where(one < two, one, two)[one != two])
            found_b.append(np.where(one < two, two, one)[one != two])
        one = np.concatenate(found_a) if found_a else ids[:0]
        two = np.concatenate(found_b) if found_b else ids[:0]
        pairs = sorted(set(zip(one.tolist(), two.tolist(), strict=True)))
        kind = table.schema.field("id").type
        return pa.table(
            {
                "i": pa.array([left] * len(pairs), pa.int64()),
                "j": pa.array([right] * len(pairs), pa.int64()),
                "a": pa.array([p[0] for p in pairs], kind),
                "b": pa.array([p[1] for p in pairs], kind),
            }
        )

    return run


def _placed(codes: DataFrame, block: int) -> DataFrame:
    """(id, block): the place of every vector in every pass, in blocks of ``block`` neighbours.

    All passes lie one behind the other in one sorted order, which is range-partitioned; places are numbered on through
    the partitions from one count per partition, so every block but the last is full however many partitions there are.
    """
    parts = max(codes.sparkSession.sparkContext.defaultParallelism, int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = codes.repartitionByRange(parts, "pass", "size", "code", "id").sortWithinPartitions("pass", "size", "code", "id")
    mark = F.monotonically_increasing_id()
    ordered = materialize(
        ordered.select("id", F.shiftright(mark, 33).alias("part"), mark.bitwiseAND((1 << 33) - 1).alias("at")), "ordered"
    )
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    offset, begins = 0, []  # one row per partition
    for part, n in sizes:
        begins.append((part, offset))
        offset += n
    starts = codes.sparkSession.createDataFrame(begins, "part bigint, begin bigint")
    placed = ordered.join(F.broadcast(starts), "part")
    return placed.select("id", F.floor((F.col("begin") + F.col("at")) / block).cast("bigint").alias("block"))


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.9,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 5,
    block: int = BLOCK,
    miss: float = MISS,
) -> DataFrame:
    """One row per vector: (id_col, n_links, component_id, kept).

    Two vectors are linked if they are found and their cosine is at least ``cosine``; vectors of different lengths never
    are.  component_id is the smallest id reachable over links, kept marks it.

    * Vectors that point exactly the same way form a class and go through the passes once; their links are counted from
      the class sizes, so copies are not expanded into pairs.
    * The number of passes follows from the number of classes and ``miss`` alone.
    * A window is a block with the block after it.  Where links reach across the whole window it is carried on by one
      block at a time, so groups of any size are compared in tasks of two blocks, and nothing is capped.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Rows with a null id
    take no part and are returned with no links, a null component, and kept.  Repeated ids count as further copies, and
    every row is returned.  An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    id_type = vectors.schema[id_col].dataType
    kind = id_type.simpleString()
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    units = materialize(picked.mapInArrow(_unit, f"id {kind}, unit binary"), "units")
    usable = units.filter("id is not null and unit is not null").withColumn("key", F.sha2("unit", 256))
    classes = materialize(
        usable.groupBy("key").agg(F.min("id").alias("id"), F.first("unit").alias("unit"), F.count("*").alias("copies")),
        "classes",
    )
    passes = passes_for(classes.count(), cosine, block, miss)
    codes = classes.select("id", "unit").mapInArrow(_sides(passes, seed), f"id {kind}, pass int, size bigint, code bigint")
    placed = materialize(_placed(codes, block).join(classes.select("id", "unit"), "id"), "placed")
    last = placed.agg(F.max("block")).first()[0]
    links = spark.createDataFrame([], T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)]))

    out = f"i bigint, j bigint, a {kind}, b {kind}"
    first = placed.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("step"))
    same = placed.select("*", F.col("block").alias("i"), F.col("block").alias("j"))
    ahead = first.select("id", "block", "unit", (F.col("block") - F.col("step")).alias("i"))
    ahead = ahead.withColumn("j", F.col("i") + 1).filter((F.col("i") >= 0) & (F.col("j") <= F.lit(last)))
    jobs = same.unionByName(ahead)
    while last is not None:
        found = materialize(jobs.groupBy("i", "j").applyInArrow(_compared(cosine), out), "found")
        links = materialize(links.union(found.select("a", "b")).distinct(), "links")
        further = found.filter("j > i").select("i", (F.col("j") + 1).alias("j")).distinct()
        further = materialize(further.filter(F.col("j") <= F.lit(last)), "further")
        if further.isEmpty():
            break
        sides = further.select("i", "j", F.explode(F.array("i", "j")).alias("block"))
        jobs = placed.join(sides, "block").select("id", "block", "unit", "i", "j")

    copies = classes.select("id", "copies")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
    joined = components(links)
    found = (
        classes.select("key", "id", "copies")
        .join(linked.withColumnRenamed("a", "id"), "id", "left")
        .join(joined, "id", "left")
        .select(
            "key",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    found = materialize(found, "classes")
    rows = units.withColumn("key", F.when(F.col("id").isNotNull(), F.sha2("unit", 256))).select("id", "key")
    rows = rows.join(found, "key", "left").withColumn("group", F.coalesce("component", "id"))
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("group").alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == F.col("group"))).alias("kept"),
    )
