"""The registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivane.llm import bpe, chat, langid, merkle, pieces, quality, rollup, search, secrets, tokenfile, winnow
from trivane.llm.minhash import Shingling, near_duplicates
from trivane.llm.neighbours import near_vectors
from trivane.llm.oracles import LOWER, ORACLES, UPPER

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = chat.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
WORDS = public_tokenizers.path("word_bpe_49k.json")
TOKENS = tokenfile.Tokens(WORDS, 2)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(number: int):
    return F.crc32(F.col("doc_id").cast("string")) % number


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality learned from labelled rows that are not held out, scored for all."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.train(documents, labels.filter(_remainder(3) != 1), F.col("quality"))
    found = quality.score(documents, model)
    return found.select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of every document, scanned by content against a ledger that starts empty."""
    found = secrets.scan(_table(spark, sf_dir, "documents"), secrets.Ledger(spark), "documents")
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(rule.kind) for rule in secrets.BASE],
        F.sha2(secrets.spelled(base), 256).alias("base_sha256"),
        secrets.spelled(F.col("spans")).alias("spans"),
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), Shingling(words=4))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back from the ids."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id int, turn int, role string, text string")
    extra = extra.select(*[F.col(c).cast(kind) for c, kind in kinds.items()])
    return chat.read_chats(chat.format_chats(turns.union(extra), RANKS), RANKS)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages learned from the rows that are not held out, predicted for all."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    languages, table = langid.train(documents.filter(_remainder(5) != 0), PIECES)
    found = langid.identify(documents, languages, table, PIECES)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_table(spark, sf_dir, "documents"), PIECES, with_ids=False)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write_tokens(_table(spark, sf_dir, "documents"), TOKENS)
    return tokenfile.read_tokens(manifest, TOKENS)


def op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after one batch with all documents; the second commit of the same batch must change nothing."""
    kept = rollup.Rollup(spark)
    counts = rollup.counted(_table(spark, sf_dir, "documents"), RANKS, "byte_bpe_50k")
    kept.commit("documents", counts)
    kept.commit("documents", counts)
    return kept.totals()


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for every benchmark item."""
    return search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), WORDS, with_ids=False)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf, with its proof; texts of a third of the ids are folded as if lower-cased."""
    tampered = F.when(_remainder(3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = merkle.manifest(_table(spark, sf_dir, "documents"), claimed={"text": tampered})
    return found.select(
        "doc_id",
        *[merkle.spelled(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(merkle.spelled(merkle.proof(F.col("path"))), 256).alias("proof_sha256"),
        merkle.spelled(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "pipeline": pipeline,
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_neighbours": op3_neighbours,
    "op4_minhash": op4_minhash,
    "op5_chat": op5_chat,
    "op6_language": op6_language,
    "op7_pieces": op7_pieces,
    "op8_winnowing": op8_winnowing,
    "op9_tokens": op9_tokens,
    "op10_counts": op10_counts,
    "op11_search": op11_search,
    "op12_bpe": op12_bpe,
    "op13_manifest": op13_manifest,
}

__all__ = ["ORACLES", "QUERIES"]
