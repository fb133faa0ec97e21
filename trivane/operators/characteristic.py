"""Property tables found from triples: subjects grouped by the set of predicates they have.

Triples that were loaded from text are one relation; a star over them is a join per pattern.  Here the predicates that no
subject has twice become columns, and subjects with the same set of them (their characteristic set) share a table.
The commonest sets get a table each, all other subjects one table with every column, so each subject has its row in
exactly one table and a star is a scan of the tables that have all its predicates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.operators.wide import PropertyTable
from trivane.session import materialize

# Tables of their own for so many sets, and columns for so many predicates; the rest stays correct, only less narrow.
MOST_SETS = 32
MOST_COLUMNS = 400
ROWS_PER_FILE = 1_000_000
META = "number int, predicate string, position int"


def single_valued(triples: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """Predicates of which every subject has at most one object, and that as text; the commonest first.

    A column has no way to tell an object without text from none, so such predicates stay triples.  Counted per subject and predicate and then per predicate, both with partial sums before the shuffle.
    """
    each = triples.groupBy("s", "p").agg(F.count("*").alias("n"), F.count("o").alias("texts"))
    totals = each.groupBy("p").agg(F.max("n").alias("most"), F.min("texts").alias("texts"), F.sum("n").alias("rows"))
    found = totals.filter("most = 1 AND texts = 1").orderBy(F.col("rows").desc(), "p").select("p").limit(most)
    return [r["p"] for r in found.collect()]


def save_tables(triples: DataFrame, path: str, most_sets: int = MOST_SETS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write the property tables of ``(s, p, o, o_num)`` below ``path``.

    One shuffle by subject makes the rows.  A table is spread over as many files as its rows fill, sorted by subject in
    each; a set with most subjects is therefore written by many tasks.
    """
    spark = triples.sparkSession
    predicates = single_valued(triples)
    cells = []
    for k, p in enumerate(predicates):
        here = F.col("p") == F.lit(p)
        cells += [F.max(F.when(here, F.col("o"))).alias(f"c{k}"), F.max(F.when(here, F.col("o_num"))).alias(f"n{k}")]
    kept = triples.filter(F.col("p").isin(predicates)) if predicates else triples.limit(0)
    has = [F.when(F.col(f"c{k}").isNotNull(), F.lit(k)) for k in range(len(predicates))] or [F.lit(None).cast("int")]
    # Dealt by subject first: a triple is moved as it is and sorted once, not as a wide row with one cell filled.
    rows = kept.repartition("s").groupBy("s").agg(*(cells or [F.lit(None).alias("none")])).withColumn("held", F.array_compact(F.array(*has)))
    rows = materialize(rows, "rows-of-subjects")
    sets = rows.groupBy("held").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "held").limit(most_sets).collect()
    every = list(range(len(predicates)))
    sizes = [(r["held"], r["n"]) for r in sets]
    rest = rows.count() - sum(n for _, n in sizes)
    wanted = [(k, held, n, F.col("held") == F.lit(held).cast("array<int>")) for k, (held, n) in enumerate(sizes)]
    if rest:
        own = reduce(lambda a, b: a | b, [w[3] for w in wanted], F.lit(False))
        wanted.append((len(sizes), every, rest, ~own))
    for number, held, n, condition in wanted:
        columns = [c for k in held for c in (f"c{k}", f"n{k}")]
        part = rows.filter(condition).select("s", *columns).repartitionByRange(-(-n // rows_per_file), "s")
        part.sortWithinPartitions("s").write.mode("overwrite").parquet(f"{path}/table={number}")
    meta = [(number, predicates[k], k) for number, held, _, _ in wanted for k in held]
    spark.createDataFrame(meta, META).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")


def load_tables(spark: SparkSession, path: str) -> list[PropertyTable]:
    """The property tables below ``path``; their list of columns is small by construction."""
    columns: dict[int, dict[str, tuple[str, str]]] = {}
    for row in spark.read.parquet(f"{path}/columns").collect():
        k = row["position"]
        columns.setdefault(row["number"], {})[row["predicate"]] = (f"c{k}", f"n{k}")
    return [PropertyTable(spark.read.parquet(f"{path}/table={number}"), "s", held) for number, held in sorted(columns.items())]
