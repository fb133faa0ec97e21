"""Five stages over the documents table, each working on all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import langid, minhash, pieces, secrets, winnow
from trivane.llm.bloom import bloom, may_hold
from trivane.llm.queries import PIECES
from trivane.session import materialize, new_step_dir

ORACLE_SQL = None
SURE = 0.5
SMALL_BYTES = 8 << 20


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast a written table if its counted rows are proven small."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id isn't listed; rows without an id stay."""
    ids = materialize(ids.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct(), "dropped")
    return docs.join(_small(ids, 16), "doc_id", "left_anti").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts of no certain language; fill in missing languages."""
    languages, table = langid.train(docs, PIECES)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    found = langid.identify(docs, languages, table, PIECES, keep=rest)
    found = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= SURE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, the one with the smallest id; repeated rows go as well."""
    found = materialize(minhash.near_duplicates(docs).select("doc_id", "kept"), "near")
    kept = _without(docs, found.filter(~F.col("kept")))
    repeated = found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    named = kept.filter(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.unionByName(kept.filter(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = winnow.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter(F.col("n_hit") > 0))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark and keep the document.

    Only rows that a Bloom filter of the contents with findings lets pass move to meet them; all others, texts and all,
    stay where they are read.
    """
    found = secrets.scan(docs, secrets.Ledger(spark), "documents")
    hits = materialize(found.filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"]), "hits")
    words, bits = bloom(hits, "blob")
    asked = secrets.addressed(docs).crossJoin(F.broadcast(materialize(words, "bloom")))
    asked = asked.withColumn("maybe", may_hold(F.col("words"), bits, F.col("blob"))).drop("words")
    spotted = asked.filter("maybe").join(hits, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.redacted(F.col("text"), F.col("spans")))
    length = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length(clean).cast("bigint"))
    hidden = spotted.withColumns({"n_chars": length, "text": clean}).select(docs.columns)
    return hidden.unionByName(asked.filter("not maybe").select(docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with what the library decodes them to as a digest."""
    return pieces.encode_decode(docs, PIECES)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("hide_secrets", hide_secrets),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_step_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
