"""A set of triples held as one DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trivane.functions.expressions import as_number
from trivane.operators.bgp import scan
from trivane.operators.wide import PropertyTable
from trivane.session import materialize
from trivane.terms import RDF_TYPE, Pattern, Prefixes

SPO = ["s", "p", "o"]
SCHEMA = "s string, p string, o string"
# A file of a saved store holds about this many triples.
ROWS_PER_FILE = 2_000_000


def with_number(df: DataFrame) -> DataFrame:
    """Add the numeric reading of the object unless the source supplies it."""
    if "o_num" in df.columns:
        return df
    return df.withColumn("o_num", as_number(F.col("o")))


def long_type(df: DataFrame) -> DataFrame:
    """The predicate ``a`` is short for the type predicate, in data as in queries."""
    return df.withColumn("p", F.when(F.col("p") == "a", F.lit(RDF_TYPE)).otherwise(F.col("p")))


class TripleStore:
    """Immutable handle: every change returns a new store.

    ``df`` has the columns ``s, p, o`` (text) and ``o_num`` (the object as a number, or NULL) and holds no
    triple twice.  Use :meth:`of` for input that may.  ``tables`` may hold the same triples in wide form.
    """

    def __init__(
        self, df: DataFrame, prefixes: dict[str, str] | None = None, tables: Sequence[PropertyTable] = ()
    ) -> None:
        self.df = with_number(df)
        self.prefixes = Prefixes(prefixes or {})
        self.tables = list(tables)

    @classmethod
    def of(cls, df: DataFrame, prefixes: dict[str, str] | None = None) -> TripleStore:
        """Store over input with possible duplicates and short type predicates."""
        return cls(with_number(long_type(df)).dropDuplicates(SPO), prefixes)

    @classmethod
    def from_rows(
        cls, spark: SparkSession, rows: Iterable[Sequence[str]], prefixes: dict[str, str] | None = None
    ) -> TripleStore:
        return cls.of(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), prefixes)

    @classmethod
    def load(cls, spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> TripleStore:
        """A saved store.  Predicates are folder names and stay text, whatever they look like."""
        schema = spark.read.parquet(path).schema
        schema["p"].dataType = StringType()
        return cls(spark.read.schema(schema).parquet(path), prefixes)

    def save(self, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Parquet, one folder per predicate, sorted by subject within each file.

        A predicate is spread by subject over as many tasks as its rows fill files, so one that holds a third of
        the data is not written by one task.  Only predicates with more than one file are looked up, and there are
        fewer of them than files.
        """
        large = self.df.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_file)
        files = large.select("p", F.ceil(F.col("n") / rows_per_file).alias("__files"))
        spread = self.df.join(F.broadcast(files), "p", "left")
        salt = F.pmod(F.xxhash64("s"), F.coalesce("__files", F.lit(1)))
        spread = spread.withColumn("__salt", salt).repartition("p", "__salt").drop("__salt", "__files")
        spread.sortWithinPartitions("p", "s").write.partitionBy("p").parquet(path)

    def save_with_tables(self, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        """The triples as :meth:`save` writes them, and property tables found from them: stars are then scans.

        The triples may come from a costly reader, so they are evaluated once and then read back.
        """
        from trivane.operators.characteristic import save_tables

        once = materialize(self.df, "to-save")
        TripleStore(once).save(f"{path}/triples", rows_per_file)
        save_tables(once.select(*SPO, "o_num"), f"{path}/tables")

    @classmethod
    def load_with_tables(cls, spark: SparkSession, path: str, prefixes: dict[str, str] | None = None) -> TripleStore:
        from trivane.operators.characteristic import load_tables

        triples = cls.load(spark, f"{path}/triples", prefixes)
        return cls(triples.df, prefixes, load_tables(spark, f"{path}/tables"))

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    def _same(self, df: DataFrame) -> TripleStore:
        return TripleStore(df, self.prefixes)

    def with_prefixes(self, prefixes: dict[str, str]) -> TripleStore:
        return TripleStore(self.df, self.prefixes.merged(prefixes), self.tables)

    # -- changes -----------------------------------------------------------------------------------

    def _aligned(self, other: DataFrame) -> DataFrame:
        return with_number(other).select(*SPO, "o_num")

    def add(self, triples: DataFrame) -> TripleStore:
        """Set insert: the store's rows stay as they are, and every triple it lacks is added once.

        Of equal new triples the largest number counts.  The new triples are evaluated once, whatever their size.
        """
        mine = self.df.select(*SPO, "o_num")
        new = self._aligned(triples).groupBy(*SPO).agg(F.max("o_num").alias("o_num"))
        return self._same(mine.unionByName(new.join(mine.select(*SPO), SPO, "left_anti")))

    def add_rows(self, rows: Iterable[Sequence[str]]) -> TripleStore:
        return self.add(long_type(self.spark.createDataFrame([tuple(r) for r in rows], SCHEMA)))

    def remove(self, triples: DataFrame) -> TripleStore:
        return self._same(self.df.join(triples.select(*SPO), SPO, "left_anti"))

    def removed(self, triples: DataFrame) -> DataFrame:
        """The triples of a removal that are present: the answer to "was it there?"."""
        return triples.select(*SPO).distinct().join(self.df.select(*SPO), SPO, "left_semi")

    def union(self, other: TripleStore) -> TripleStore:
        both = self.df.select(*SPO, "o_num").unionByName(self._aligned(other.df))
        return TripleStore(both.dropDuplicates(SPO), self.prefixes.merged(other.prefixes))

    def minus(self, other: TripleStore) -> TripleStore:
        return self._same(self.df.join(other.df.select(*SPO), SPO, "left_anti"))

    def insert_where(self, template: Sequence[Sequence[str]], solutions: DataFrame) -> TripleStore:
        """Add one triple per template entry and solution."""
        return self.add(instantiate(solutions, [Pattern.of(t, self.prefixes) for t in template]))

    # -- lookups -----------------------------------------------------------------------------------

    def lookup(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples with the given positions; any subset of the three may be bound."""
        found = self.df
        for place, term in zip(SPO, (s, p, o)):
            if term is not None:
                wanted = RDF_TYPE if place == "p" and term == "a" else self.prefixes.expand(term)
                found = found.filter(F.col(place) == F.lit(wanted))
        return found.select(*SPO)

    def third(self, **two: str) -> DataFrame:
        """Distinct values of the position left open by two bound ones, e.g. ``third(s=…, p=…)``."""
        if len(two) != 2:
            raise ValueError("bind exactly two positions")
        (open_place,) = [c for c in SPO if c not in two]
        return self.lookup(**two).select(open_place).distinct()

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.lookup(s, p, o).isEmpty()

    def ask(self, triples: DataFrame) -> DataFrame:
        """The distinct given triples, each with whether it is ``there``; with NULL in a position it is not."""
        asked = triples.select(*SPO).distinct()
        return asked.join(self.df.select(*SPO, F.lit(True).alias("there")), SPO, "left").select(
            *SPO, F.coalesce("there", F.lit(False)).alias("there")
        )

    def solutions(self, pattern: Sequence[str]) -> DataFrame:
        parsed = Pattern.of(pattern, self.prefixes)
        return scan(self.df, parsed).select(*parsed.variables)

    def profile(self, exact: bool = False) -> DataFrame:
        """Per predicate: triples, distinct subjects and distinct objects.

        Sketched counts take one pass and no shuffle of terms.  Exact ones first reduce to distinct pairs,
        so a predicate with a large share of the triples is counted by many tasks.
        """
        if not exact:
            return self.df.groupBy("p").agg(
                F.count("*").alias("triples"),
                F.approx_count_distinct("s").alias("subjects"),
                F.approx_count_distinct("o").alias("objects"),
            )
        by_s = self.df.groupBy("p", "s").agg(F.count("*").alias("n"))
        subjects = by_s.groupBy("p").agg(F.sum("n").alias("triples"), F.count("*").alias("subjects"))
        by_o = self.df.select("p", "o").distinct()
        return subjects.join(by_o.groupBy("p").agg(F.count("*").alias("objects")), "p")


def instantiate(solutions: DataFrame, templates: Sequence[Pattern], carry: Sequence[str] = ()) -> DataFrame:
    """Triples built from solutions; all templates are filled in one pass over the solutions."""
    from trivane.terms import is_var, twin, var_name

    def value(term: str):
        if not is_var(term):
            return F.lit(term)
        if var_name(term) not in solutions.columns:
            raise ValueError(f"variable {term} is not bound by the body")
        return F.col(var_name(term)).cast("string")

    def number(term: str):
        if not is_var(term):
            return as_number(F.lit(term))
        name = var_name(term)
        return F.col(twin(name)) if twin(name) in solutions.columns else as_number(F.col(name).cast("string"))

    entries = [
        F.struct(value(t.s).alias("s"), value(t.p).alias("p"), value(t.o).alias("o"), number(t.o).alias("o_num"))
        for t in templates
    ]
    if len(entries) == 1:
        return solutions.select(*carry, entries[0].alias("t")).select(*carry, "t.*")
    return solutions.select(*carry, F.explode(F.array(*entries)).alias("t")).select(*carry, "t.*")
