"""Ranked search, BPE and Merkle manifests against brute force, on given and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trivane.llm import bpe, merkle, search
from trivane.llm.queries import ORACLES, QUERIES, WORDS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def as_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# -- search ------------------------------------------------------------------------------------------------------------


def words_of(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def ranked_by_hand(docs, items, limit):
    cut = [(d, words_of(t)) for d, t in docs]
    n, total = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    found = []
    for item, text in items:
        scored = []
        asked = set(words_of(text))
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in w for _, w in cut) + 1))) for t in asked}
        for doc, words in cut:
            m = 100 - 50 + (50 * len(words) * n) // total if total else 0
            score = sum(
                weight[t] * ((1_000_000_000 * words.count(t)) // (1000 * words.count(t) + 20 * m)) for t in asked if t in words
            )
            if score > 0:
                scored.append((-score, doc is not None, doc))
        scored.sort(key=lambda r: r if r[1] else r[:2])
        found += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(scored[:limit])]
    return sorted(found, key=str)


def test_search_query_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    want = con.execute(ORACLES["op11_search"]).fetchall()
    assert as_rows(QUERIES["op11_search"](spark, SF), "item_id", "rank", "doc_id", "score") == sorted(want, key=str)


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_search_with_ties_copies_and_small_segments(spark, monkeypatch, limit):
    """Few candidates at a time and small segments take every way through the lists."""
    monkeypatch.setattr(search, "SEGMENT_DOCS", 40)
    monkeypatch.setattr(search, "CHUNK_DOCS", 7)
    monkeypatch.setattr(search, "CANDIDATES", 5)
    monkeypatch.setattr(search, "SHORT_SHARE", 6)
    draw = random.Random(limit)
    letters = [f"w{k}" for k in range(40)]
    weights = [1 / (k + 1) for k in range(40)]
    docs = [(k, " ".join(draw.choices(letters, weights, k=draw.randint(0, 30)))) for k in range(300)]
    docs += [(k, docs[5][1]) for k in range(400, 430)] + [(7, docs[7][1]), (None, docs[5][1]), (None, None), (431, "")]
    items = [(k, " ".join(draw.choices(letters, k=draw.randint(0, 12)))) for k in range(12)] + [(90, None), (91, "zz W1"), (91, "zz W1")]
    got = search.ranked(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id bigint, text string"),
        limit,
    )
    # A repeated query has its rows twice.
    assert as_rows(got, "item_id", "rank", "doc_id", "score") == ranked_by_hand(docs, items, limit)


def test_search_prunes_without_losing(monkeypatch):
    """The threshold makes lists passive, so few documents are ever scored in full, and the best are still right."""
    monkeypatch.setattr(search, "CANDIDATES", 16)
    draw = np.random.default_rng(3)
    n = 5000
    lists = {0: np.arange(n), 1: np.flatnonzero(draw.random(n) < 0.5), 2: np.flatnonzero(draw.random(n) < 0.01)}
    values = {t: draw.integers(1, 50, len(p)) for t, p in lists.items()}
    segment = search.Segment(list(range(n)), lists, values, {t: int(v.max()) for t, v in values.items()})
    weights = {0: 1, 1: 2, 2: 100}
    looked = []
    plain = search.looked_up
    monkeypatch.setattr(search, "looked_up", lambda p, v, c: looked.append(len(c)) or plain(p, v, c))
    best = search.Best(5)
    search.search(segment, weights, best)
    scores = np.zeros(n, np.int64)
    for t, p in lists.items():
        scores[p] += values[t] * weights[t]
    want = sorted(range(n), key=lambda d: (-scores[d], d))[:5]
    assert [r[2] for r in best.rows] == want
    assert sum(looked) < n


def test_search_in_several_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 8)
    monkeypatch.setattr(search, "PIECE_BYTES", 10)
    docs = [(1, "alpha beta gamma Delta " * 20), (2, "beta"), (3, "x" * 100 + " beta alpha"), (4, "Ünï beta ünï")]
    items = [(1, "alpha beta"), (2, "DELTA gamma"), (3, "ünï"), (4, "nothing of it")]
    got = search.ranked(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    )
    assert as_rows(got, "item_id", "rank", "doc_id", "score") == ranked_by_hand(docs, items, 50)


def test_search_without_rows_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "one two", 1, 2, 3.0)], "doc_id string, text string, key int, rank int, score double")
    items = spark.createDataFrame([("q", "Two", 1)], "item_id string, text string, key int")
    assert [r[:3] for r in as_rows(search.ranked(docs, items), "item_id", "rank", "doc_id")] == [("q", 1, "a")]
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(docs, items.withColumn("text", F.lit(None).cast("string"))).count() == 0


# -- BPE ---------------------------------------------------------------------------------------------------------------

ALPHABET = "aAbeEtThHiI 019'sS.,<|>\n\t\x1c\x85\xa0éÉñÑüßİΣσς́̈한각中文🙂²½①KÅ‍ẞ\x00"


def awkward_texts():
    draw = random.Random(5)
    texts = ["".join(draw.choices(ALPHABET, k=draw.randint(0, 50))) for _ in range(3000)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(500)]
    texts += ["x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext|>", "", " ", "don't We'Ll 'S 'rE", "a" * 3000]
    return [*texts, "ab" * 500 + "é" * 500, "word " * 60_000 + "<|endoftext|>" + "né\n" * 60_000, "b" * 300_000 + " end"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_library_s(name):
    import public_tokenizers

    tool = Tokenizer.from_file(public_tokenizers.path(name))
    own = bpe.Bpe(public_tokenizers.path(name))
    texts = awkward_texts()
    for want, text, pieces in zip(tool.encode_batch(texts, add_special_tokens=False), texts, own.encode(texts), strict=True):
        ids = np.frombuffer(b"".join(pieces), "<u4").tolist()
        assert ids == want.ids, text[:80]
        assert own.decode(ids) == tool.decode(ids, skip_special_tokens=False)


def test_bpe_merges_by_rank_then_place():
    """Against merging the lowest rank of a plain list again and again."""
    own = bpe.vocabulary(WORDS)
    draw = random.Random(2)
    for _ in range(300):
        part = "".join(draw.choices("aeinrst", k=draw.randint(1, 25))).encode()
        symbols = [*(own._inner[b] for b in part[:-1]), own._last[part[-1]]]
        while True:
            ranked = [(*own._ranks[pair], i) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in own._ranks]
            if not ranked:
                break
            _, made, i = min(ranked, key=lambda r: (r[0], r[2]))
            symbols[i : i + 2] = [made]
        assert own.merge(part) == symbols


def test_bpe_generations_keep_ids(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PARTS", 20)
    own = bpe.Bpe(WORDS)
    tool = Tokenizer.from_file(WORDS)
    draw = random.Random(4)
    for _ in range(20):
        texts = [" ".join("".join(draw.choices("aeinrst", k=4)) for _ in range(30)) + " the end" for _ in range(5)]
        got = [np.frombuffer(b"".join(p), "<u4").tolist() for p in own.encode(texts)]
        assert got == [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]


def test_bpe_rows(spark):
    rows = [(1, "Hello  world", 5), (1, "Hello  world", 5), (None, None, 1), (2, "", 0), (3, "w " * 200_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = {(r["doc_id"], r["n_tokens"]): r for r in bpe.encode_decode(docs, WORDS).collect()}
    tool = Tokenizer.from_file(WORDS)
    for doc, text, _ in rows:
        ids = tool.encode(text or "", add_special_tokens=False).ids
        row = got[doc, len(ids)]
        assert row["ids"] == ids
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(tool.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), WORDS).count() == 0


def test_bpe_refuses_other_files(tmp_path):
    import json

    made = json.load(open(WORDS, encoding="utf-8"))
    made["model"]["unk_token"] = "!"
    path = tmp_path / "odd.json"
    path.write_text(json.dumps(made))
    with pytest.raises(ValueError, match="unk_token"):
        bpe.Bpe(str(path))


# -- Merkle ------------------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    doc, _, lang, source, n = row
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree_of(nodes):
    """The last node, and each leaf's siblings as (left, right) by level."""
    paths, under = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [list(range(a, min(a + 8, len(nodes)))) for a in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for leaf in under[k]:
                    paths[leaf].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        nodes, under = [digest("".join(nodes[k] for k in run)) for run in runs], [sum((under[k] for k in run), []) for run in runs]
    return nodes[0], paths


def manifest_by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for group in order:
        groups[group].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[group] = tree_of([leaf_of(r, r[1]) for r in groups[group]])
    root, tops = tree_of([trees[g][0] for g in order])
    out = []
    for group, top in zip(order, tops, strict=True):
        for row, path in zip(groups[group], trees[group][1], strict=True):
            path, text = path + top, row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            node = leaf_of(row, text)
            for left, right in path:
                node = digest("".join([*left, node, *right]))
            proof = digest("".join("".join(left + right) for left, right in path))
            out.append((row[0], leaf_of(row, row[1]), trees[group][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit(1)).withColumn("pos", F.lit("x")).write.parquet(f"{path}/documents.parquet")
    return as_rows(QUERIES["op13_manifest"](spark, path), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("counts", [[1], [8, 1], [9, 64, 65, 7], [530, 3, 0, 1]])
def test_manifest_of_trees_of_all_heights(spark, tmp_path, counts):
    langs = [None, "ü", "Z", "a"]
    rows = [(1000 * g + k, f"Text {k}", langs[g], None if k % 3 else "s", k) for g, n in enumerate(counts) for k in range(n)]
    random.Random(1).shuffle(rows)
    assert manifest_rows(spark, rows, tmp_path) == manifest_by_hand(rows)


def test_manifest_of_awkward_rows(spark, tmp_path):
    rows = [(7, "Copy", "en", "s", 4)] * 40 + [(None, "A", "en", None, None), (None, None, None, None, None), (7, "Other", "en", "s", 4)]
    rows += [(3, None, "", "s", None), (4, "", "", "s", 0), (5, "Long " * 100_000, "", "é", 1)]
    assert manifest_rows(spark, rows, tmp_path) == manifest_by_hand(rows)
    assert merkle.manifest(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_manifest_with_many_trees_and_other_columns(spark):
    """More trees than one run of roots; other fields, ids as text, no claims."""
    rows = [(f"k{k:03d}", k % 70, "v" * (k % 5)) for k in range(300)]
    table = spark.createDataFrame(rows, "name string, kind int, digest string")
    got = merkle.manifest(table, ["name", "digest"], "kind", "name").collect()
    assert len(got) == 300 and len({bytes(r["root"]) for r in got}) == 1 and len({bytes(r["subroot"]) for r in got}) == 70
    assert all(r["folded"] == r["root"] for r in got)


def test_manifest_query_on_the_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = as_rows(QUERIES["op13_manifest"](spark, SF), "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert got == manifest_by_hand(rows)
