"""Token counts kept up to date by deltas.

A batch of changes is turned into signed counts: an insert adds, a delete takes away what the document had counted for,
a revision does both.  Totals by source, language and tokenizer version are the sum of the batches' deltas, so a batch
costs its own size and never a pass over the corpus.  A batch has a name; committing it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm.chat import Ranks, encoding
from trivane.llm.text import bounded_batches
from trivane.session import materialize, new_step_dir

KEY = ("source", "lang", "tokenizer")


def counted(
    documents: DataFrame, ranks: Ranks, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id as id, source, lang, tokenizer, tokens, chars) of every row; null and empty texts have 0 of both."""
    bounded_batches(documents.sparkSession, 500)
    picked = documents.select(
        F.col(id_col).alias("id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    kind = picked.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(ranks).encode_ordinary
        for batch in batches:
            texts = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(count(t)) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["id", "source", "lang", "tokens", "chars"],
            )

    found = picked.mapInArrow(run, f"id {kind}, source string, lang string, tokens bigint, chars bigint")
    return found.select("id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), "tokens", "chars")


class Rollup:
    """Totals of documents, tokens and characters under a folder of shared storage.

    ``rows`` holds the signed rows of each batch, ``deltas`` their sums by key.  A batch is committed by the success
    marker of its deltas, which are written last and from the written rows; a half-written batch is written anew.
    Null sources and languages are keys of their own.  Documents with a null id can be inserted but not revised.
    Inserting an id that is already counted replaces it, so totals never count a document twice per tokenizer version;
    rows that repeat an id within a batch count once (the one with the most tokens, then the smallest key).
    """

    def __init__(self, spark: SparkSession, id_type: str = "bigint", folder: str | None = None) -> None:
        self._spark = spark
        self._folder = folder or new_step_dir(spark, "rollup")
        self._rows = f"id {id_type}, source string, lang string, tokenizer string, tokens bigint, chars bigint, sign int"

    def _path(self, kind: str, batch: str = "") -> str:
        return f"{self._folder}/{kind}/{batch}".rstrip("/")

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        jvm = self._spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self._path("deltas"))
        system = root.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(root):
            return []
        names = [s.getPath().getName() for s in system.listStatus(root)]
        return sorted(n for n in names if system.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS")))

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.batches()
        if not done:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[self._path(kind, b) for b in done])

    def current(self) -> DataFrame:
        """The rows that count now: those whose signs don't cancel out."""
        rows = self._read("rows", self._rows)
        return (
            rows.groupBy("id", *KEY, "tokens", "chars").agg(F.sum("sign").alias("n")).filter("n > 0").drop("n")
        )

    def commit(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch: ``upserts`` as from ``counted``, ``deletes`` with columns id and tokenizer.

        Returns False, with nothing changed, if a batch of that name is committed already.
        """
        if batch in self.batches():
            return False
        columns = ["id", *KEY, "tokens", "chars"]
        parts, gone = [], []
        if upserts is not None:
            new = materialize(upserts.select(columns), "upserts")
            named = new.filter(F.col("id").isNotNull())
            rest = [c for c in columns if c not in ("id", "tokenizer")]
            best = named.groupBy("id", "tokenizer").agg(
                F.max_by(F.struct(*rest), F.struct("tokens", "chars", "source", "lang")).alias("r")
            )
            parts += [best.select("id", "r.source", "r.lang", "tokenizer", "r.tokens", "r.chars"), new.filter("id is null")]
            gone.append(named.select("id", "tokenizer"))
        if deletes is not None:
            gone.append(deletes.select("id", "tokenizer").filter(F.col("id").isNotNull()))
        signed = [p.select(columns).withColumn("sign", F.lit(1)) for p in parts]
        if gone and self.batches():
            names = gone[0] if len(gone) == 1 else gone[0].union(gone[1])
            old = self.current().join(names.distinct(), ["id", "tokenizer"], "left_semi")
            signed.append(old.select(columns).withColumn("sign", F.lit(-1)))
        rows = self._spark.createDataFrame([], self._rows)
        for part in signed:
            rows = rows.union(part)
        rows.write.mode("overwrite").parquet(self._path("rows", batch))
        written = self._spark.read.schema(self._rows).parquet(self._path("rows", batch))
        sums = written.groupBy(*KEY).agg(
            F.sum("sign").alias("docs"),
            F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("chars")).alias("chars"),
        )
        sums.write.mode("overwrite").parquet(self._path("deltas", batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens, chars) over all committed batches; keys without documents are gone."""
        deltas = self._read("deltas", "source string, lang string, tokenizer string, docs bigint, tokens bigint, chars bigint")
        sums = deltas.groupBy(*KEY).agg(*[F.sum(c).cast("bigint").alias(c) for c in ("docs", "tokens", "chars")])
        return sums.filter("docs > 0")
