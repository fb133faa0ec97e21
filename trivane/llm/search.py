"""Ranked lexical search of a set of queries over all documents, by lists of postings.

Two passes.  The first reads every text once and writes, for each chunk of documents, the postings of the queried terms;
the counts that weights need (documents, terms, documents holding a term) are sums over that table.  The second pass
searches the postings segment by segment, with integer scores:

* Short lists are summed term at a time into accumulators, which from then on are one iterator in document order with
  the largest sum as its bound.
* That iterator and the long lists are walked document at a time.  Lists whose bounds together can't lift a document into
  the best are only looked up: candidates come from the others, are dropped as soon as what they have plus the
  bounds of what's left falls below the threshold, and the long lists are skipped through to the candidates that stay.

A task carries its best documents of every query, and so the threshold, from segment to segment.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.llm.text import alone
from trivane.session import materialize

# Characters of query texts per pass over the documents; more queries are searched in several passes.
QUERY_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
CHUNK_DOCS = 500
SEGMENT_DOCS = 16_384
# A list with fewer than one posting for so many documents of its segment is short.
SHORT_SHARE = 32
CANDIDATES = 1024

# A term is a run of digits, ASCII letters and characters beyond ASCII; only A to Z are lower-cased.
TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


@contextmanager
def rows_per_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a job runs, Python workers get at most so many rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in order, piece by piece, so that a long text is never a list of all its terms."""
    plain = text.encode().translate(TERM_BYTES)
    start = 0
    while len(plain) - start > PIECE_BYTES:
        cut = plain.find(b" ", start + PIECE_BYTES)
        if cut < 0:
            break
        yield plain[start:cut].split()
        start = cut
    yield plain[start:].split()


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column of numbers, as views."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def postings(documents: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of documents: (holding, total, ids, lengths, terms, sizes, places, counts).

    holding documents with a term, and total terms; of the documents with a queried term the ids and lengths.  terms are
    the queried ones present, sizes their numbers of postings; places (in ids) and counts are the postings, list by list.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    table = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("search")
        known = table.value.get
        for batch in batches:
            at, found, lengths, total, holding = [], [], [], 0, 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                n, hits = 0, []
                for words in terms(text or ""):
                    n += len(words)
                    hits += [t for t in map(known, words) if t is not None]
                total, holding = total + n, holding + (n > 0)
                if hits:
                    at.append(row)
                    lengths.append(n)
                    found.append(np.array(hits, np.int64))
            # A posting is a term and the place of its document; equal ones are counted.
            width = max(1, len(at))
            keys = np.concatenate([f * width + k for k, f in enumerate(found)]) if found else np.zeros(0, np.int64)
            keys, counts = np.unique(keys, return_counts=True)
            present, sizes = np.unique(keys // width, return_counts=True)

            def one(values, of: pa.DataType) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, of))

            ids = batch.column(0).take(pa.array(at, pa.int64()))
            columns = {
                "holding": pa.array([holding], pa.int64()),
                "total": pa.array([total], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "lengths": one(lengths, pa.int64()),
                "terms": one(present, pa.int32()),
                "sizes": one(sizes, pa.int32()),
                "places": one(keys % width, pa.int32()),
                "counts": one(counts, pa.int32()),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = (
        f"holding bigint, total bigint, ids array<{kind}>, lengths array<bigint>, "
        "terms array<int>, sizes array<int>, places array<int>, counts array<int>"
    )
    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with rows_per_batch(spark, CHUNK_DOCS):
        return materialize(picked.mapInArrow(run, schema), "postings")


@dataclass
class Segment:
    """Postings of some documents: for each term the documents, ascending, and what each is worth before weighting."""

    ids: list
    places: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    most: dict[int, int]

    @classmethod
    def of(cls, chunks: list[tuple], documents: int, total: int) -> Segment:
        ids: list = []
        lengths, lists = [], []
        for of_ids, of_lengths, present, sizes, places, counts in chunks:
            ends = np.cumsum(sizes)
            for term, a, b in zip(present.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                lists.append((term, places[a:b] + len(ids), counts[a:b]))
            ids += of_ids
            lengths.append(of_lengths)
        norm = 100 - 50 + (50 * np.concatenate(lengths).astype(np.int64) * documents) // total
        held: dict[int, list] = {}
        for term, places, counts in lists:
            held.setdefault(term, []).append((places, counts))
        segment = cls(ids, {}, {}, {})
        for term, parts in held.items():
            places = np.concatenate([p for p, _ in parts]).astype(np.int64)
            counts = np.concatenate([c for _, c in parts]).astype(np.int64)
            values = (1_000_000_000 * counts) // (1000 * counts + 20 * norm[places])
            segment.places[term], segment.values[term], segment.most[term] = places, values, int(values.max())
        return segment


def looked_up(places: np.ndarray, values: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """What a list adds to each of the ascending candidates, skipping all between."""
    at = np.searchsorted(places, candidates)
    at[at == len(places)] = 0
    return np.where(places[at] == candidates, values[at], 0)


class Best:
    """The best documents of a query: highest score first, then the smallest id, null before all."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.rows: list[tuple] = []
        self.threshold = 0

    def offer(self, ids: list, places: np.ndarray, scores: np.ndarray) -> None:
        places, scores = places[scores > 0], scores[scores > 0]
        if len(scores) > 4 * self.limit:
            # No row below the limit-th score of these can stay, whatever the ties.
            enough = np.partition(scores, len(scores) - self.limit)[len(scores) - self.limit]
            places, scores = places[scores >= enough], scores[scores >= enough]
        new = [(-s, ids[p] is not None, ids[p]) for s, p in zip(scores.tolist(), places.tolist(), strict=True)]
        self.rows = heapq.nsmallest(self.limit, self.rows + new, key=_order)
        if len(self.rows) == self.limit:
            self.threshold = -self.rows[-1][0]


def _order(row: tuple) -> tuple:
    score, known, key = row
    return (score, known, key) if known else (score, known)


def search(segment: Segment, weights: dict[int, int], best: Best) -> None:
    """Offer ``best`` all documents of the segment that may belong to it."""
    short, iterators = [], []
    for term, weight in weights.items():
        places = segment.places.get(term)
        if places is None or weight <= 0:
            continue
        values = segment.values[term]
        if len(places) * SHORT_SHARE < len(segment.ids):
            short.append((places, values * weight))
        else:
            iterators.append((segment.most[term] * weight, places, values, weight))
    if short:
        # Term at a time: one sum per document of any short list.
        docs, back = np.unique(np.concatenate([p for p, _ in short]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, back, np.concatenate([v for _, v in short]))
        iterators.append((int(sums.max()), docs, sums, 1))
    if not iterators:
        return
    # Document at a time, the lists with the smallest bounds first.
    iterators.sort(key=lambda i: i[0])
    bounds = np.cumsum([0] + [i[0] for i in iterators])
    start, end = 0, len(segment.ids)
    while start < end:
        # Lists that can't reach the threshold together are only looked up; a tie may still win by its id.
        passive = min(int(np.searchsorted(bounds, best.threshold, "left")) - 1, len(iterators)) if best.threshold else 0
        passive = max(passive, 0)
        if passive == len(iterators):
            return
        stop, heads = end, []
        for _, places, _, _ in iterators[passive:]:
            a = int(np.searchsorted(places, start))
            heads.append(places[a : a + CANDIDATES])
            if a + CANDIDATES < len(places):
                stop = min(stop, int(places[a + CANDIDATES]))
        found = np.unique(np.concatenate(heads))
        found = found[found < stop]
        scores = np.zeros(len(found), np.int64)
        for k in range(len(iterators) - 1, -1, -1):
            _, places, values, weight = iterators[k]
            scores += looked_up(places, values, found) * weight
            if best.threshold:
                alive = scores + bounds[k] >= best.threshold
                found, scores = found[alive], scores[alive]
            if not len(found):
                break
        if len(found):
            best.offer(segment.ids, found, scores)
        start = stop


def _block(
    documents: DataFrame, queries: list[tuple[str, list[str]]], limit: int, id_col: str, text_col: str
) -> DataFrame:
    """(key, id, score, part): the best of every task for queries given with their terms."""
    spark = documents.sparkSession
    numbers: dict[bytes, int] = {}
    wanted = [[numbers.setdefault(t.encode(), len(numbers)) for t in words] for _, words in queries]
    table = postings(documents, numbers, id_col, text_col)
    documents_, total = table.agg(F.sum("holding"), F.sum("total")).first()
    held = table.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes"))
    weight = {t: math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df + 1))) for t, df in held.collect()}
    plans = spark.sparkContext.broadcast([{t: weight[t] for t in words if t in weight} for words in wanted])
    keys = spark.sparkContext.broadcast([key for key, _ in queries])
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("search")
        best = [Best(limit) for _ in plans.value]
        held: list[tuple] = []

        def flush() -> None:
            segment = Segment.of(held, documents_, total)
            held.clear()
            for of_query, mine in zip(plans.value, best, strict=True):
                search(segment, of_query, mine)

        waiting = 0
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type.value_type
            ids = [row or [] for row in batch.column(0).to_pylist()]
            for chunk in zip(ids, *[lists_of(batch.column(c)) for c in range(1, 6)], strict=True):
                if chunk[0]:
                    held.append(chunk)
                    waiting += len(chunk[0])
                if waiting >= SEGMENT_DOCS:
                    flush()
                    waiting = 0
        if held:
            flush()
        for key, mine in zip(keys.value, best, strict=True):
            if mine.rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key] * len(mine.rows), pa.string()),
                        pa.array([r[2] for r in mine.rows], id_type),
                        pa.array([-r[0] for r in mine.rows], pa.int64()),
                    ],
                    names=["key", "id", "score"],
                )

    lists = table.select("ids", "lengths", "terms", "sizes", "places", "counts")
    with rows_per_batch(spark, SEGMENT_DOCS // CHUNK_DOCS):
        found = lists.mapInArrow(run, f"key string, id {kind}, score bigint")
        return materialize(found.withColumn("part", F.spark_partition_id() % 64), "best")


def ranked(
    documents: DataFrame,
    queries: DataFrame,
    limit: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
) -> DataFrame:
    """The ``limit`` highest-scoring documents of each query: (query_id, rank, id_col, score), rank from 1.

    A document's score is the sum, over the query's distinct terms, of weight times dampened count; weights fall with the
    documents that hold the term, counts with the document's length.  Equal scores rank by ascending id (null first).
    Only scores above 0 rank, so a query may have fewer rows or none.

    Null and empty texts have no terms: such queries give no rows and such documents count nowhere.  Repeated documents
    rank separately, repeated queries each get their rows; tables without rows give none; other columns are ignored.

    Queries are searched in blocks of about QUERY_BYTES of their texts, one pass over the documents each.  Only a block's
    queries and the counts of its terms pass through the driver.  A task's memory is bounded by a segment's postings.
    """
    spark = documents.sparkSession
    rows = queries.select(F.col(query_id).alias("query"), F.coalesce(F.col(query_text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.sha2("text", 256))
    texts = materialize(rows.select("key", "text").dropDuplicates(["key"]), "queries")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    found = None
    for number in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).orderBy("key").collect()
        cut = [(r["key"], list(dict.fromkeys(t.decode() for words in terms(r["text"]) for t in words))) for r in mine]
        cut = [(key, words) for key, words in cut if words]
        if cut:
            block = _block(documents, cut, limit, id_col, text_col)
            found = block if found is None else found.unionByName(block)
    if found is None:
        kind = documents.schema[id_col].dataType.simpleString()
        found = spark.createDataFrame([], f"key string, id {kind}, score bigint, part int")
    # First the best of some tasks, then of all, so that no query's rows of all tasks meet in one task.
    for by in (["key", "part"], ["key"]):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_first())
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    named = rows.select("query", "key").join(found, "key")
    return named.select(F.col("query").alias(query_id), "rank", F.col("id").alias(id_col), "score")
