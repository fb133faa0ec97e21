"""The registered queries and the pipeline on the given tables and on awkward ones."""

import hashlib

import pandas as pd
import pytest

import corpus_pipeline
from trivane.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS = {
    "op3_neighbours": "embeddings", **{f"op{n}": "documents" for n in ()},
    **{name: "documents" for name in QUERIES if name.startswith("op") and name.split("_")[0] not in ("op3", "op5", "op10", "op11")},
}


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_one_row_for_each_row(spark, name):
    table = pd.read_parquet(f"{SF}/{ROWS[name]}.parquet")
    assert QUERIES[name](spark, SF).count() == len(table)


def test_chat_query(spark):
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, SF).collect()}
    assert set(got) == set(turns.conv_id) | {-1}
    text = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_quality_query_on_held_out_rows(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").set_index("doc_id").quality
    got = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    held = got[got.held_out & got.index.isin(labels.index)]
    assert (held.predicted == labels[held.index]).mean() > 0.95


def test_language_query_on_held_out_rows(spark):
    languages = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").set_index("doc_id").lang
    got = QUERIES["op6_language"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == languages[held.index]).mean() > 0.98


def test_stages_keep_clean_documents(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs = before
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert after.columns == before.columns
        assert 0.8 * docs.count() <= after.count() <= docs.count()
        docs = after
    encoded = corpus_pipeline.encode(spark, docs, SF)
    assert encoded.count() == docs.count()


def test_stages_on_awkward_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "the quick brown fox jumps over the lazy dog and runs far away from here"
    secret = "a clean house by the river has the password: hunter2hunter2 written on its wall today"
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, "en", None, 3)]
    rows += [(3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, secret, "en", "b", 9)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.hide_secrets):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
    got = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    assert [g[0] for g in got] == [1, 5, None]
    assert "hunter2" not in got[1][1] and "[secret]" in got[1][1]
    assert corpus_pipeline.encode(spark, docs, SF).count() == 3
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
