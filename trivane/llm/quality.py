"""A quality classifier of supervised subword embeddings.

Words and character n-grams are hashed into buckets that each own a learned vector; a text is the average of its
vectors and a softmax layer scores it.  Training is stochastic gradient descent in numpy on a bounded sample.  For two
classes the output is linear in the average, so scoring needs one number per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trivane.llm.text import NOT_SPACE, bounded_batches, chunks, mix, span_hashes, word_spans


@dataclass(frozen=True)
class Settings:
    """Parameters of the model.  ``sample`` rows of each label, the first by a hash of the id, are trained on;
    rows whose text is longer than ``longest`` bytes are not taken into the sample (they are scored like any other)."""

    buckets: int = 1 << 18
    width: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    steps: int = 4500
    rate: float = 0.4
    batch: int = 16
    sample: int = 3000
    longest: int = 1 << 16
    seed: int = 11


def features(column: pa.Array, how: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: (index of the first, number of features of each, buckets in order of the texts).

    Words are runs without white space; a word that repeats the one before counts for one shared bucket too, the
    two-word pattern that no hash of the words themselves could share between texts.  Character n-grams are n bytes
    with no white space between the outer two, so they see where a word begins and ends.
    """
    for first, data, offsets in chunks(column):
        solid = NOT_SPACE[data]
        starts, ends, doc = word_spans(solid, offsets)
        word = span_hashes(data, starts, ends)
        again = np.flatnonzero((word[1:] == word[:-1]) & (doc[1:] == doc[:-1])) + 1
        found, owner = [word % np.uint64(how.buckets), np.zeros(len(again), np.uint64)], [doc, doc[again]]
        place = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        wide = np.where(solid, data, 32).astype(np.uint64)
        for n in how.grams:
            if len(data) < n:
                continue
            count = len(data) - n + 1
            code, valid = np.full(count, n, np.uint64), place[:count] == place[n - 1 :]
            for j in range(n):
                code = (code << np.uint64(8)) | wide[j : j + count]
                if 0 < j < n - 1:
                    valid &= solid[j : j + count]
            valid &= solid[:count] | solid[n - 1 :]
            at = np.flatnonzero(valid)
            found.append(mix(code[at]) % np.uint64(how.buckets))
            owner.append(place[at])
        owners = np.concatenate(owner)
        order = np.argsort(owners, kind="stable")
        yield first, np.bincount(owners, minlength=len(offsets) - 1), np.concatenate(found)[order].astype(np.int64)


class Model:
    """One number per bucket and a bias: the difference of the two classes' outputs."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    def scores(self, column: pa.Array, how: Settings) -> np.ndarray:
        out = np.zeros(len(column))
        for first, sizes, buckets in features(column, how):
            sums = np.zeros(len(buckets) + 1)
            np.cumsum(self.weights[buckets], out=sums[1:])
            ends = np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes]
            out[first : first + len(sizes)] = total / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -700, 700)))


def _descend(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, how: Settings) -> Model:
    """Train on (buckets, shares) of each text.  Classes weigh the same, so the rarer one is not drowned."""
    random = np.random.default_rng(how.seed)
    vectors = random.uniform(-1, 1, (how.buckets, how.width)).astype(np.float32) / how.width
    output, bias = np.zeros((how.width, 2), np.float32), np.zeros(2, np.float32)
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))[labels]
    order = np.zeros(0, np.int64)
    for done in range(how.steps):
        if not len(order):
            order = random.permutation(len(rows))
        picked, order = order[: how.batch], order[how.batch :]
        rate = how.rate * (1 - done / how.steps)
        sizes = np.array([len(rows[i][0]) for i in picked])
        buckets = np.concatenate([rows[i][0] for i in picked])
        shares = np.concatenate([rows[i][1] for i in picked])[:, None]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.zeros((len(buckets) + 1, how.width))
        np.cumsum(vectors[buckets] * shares, axis=0, out=sums[1:])
        hidden = sums[bounds[1:]] - sums[bounds[:-1]]
        logits = hidden @ output + bias
        logits -= logits.max(axis=1, keepdims=True)
        grad = np.exp(logits)
        grad /= grad.sum(axis=1, keepdims=True)
        grad[np.arange(len(picked)), labels[picked]] -= 1
        grad *= weight[picked][:, None]
        back = grad @ output.T
        output -= (rate * hidden.T @ grad / len(picked)).astype(np.float32)
        bias -= (rate * grad.mean(axis=0)).astype(np.float32)
        change = np.repeat(back, sizes, axis=0) * shares
        order_ = np.argsort(buckets, kind="stable")
        unique, begin = np.unique(buckets[order_], return_index=True)
        vectors[unique] -= (rate * np.add.reduceat(change[order_], begin, axis=0)).astype(np.float32)
    return Model((vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(
    documents: DataFrame,
    labels: DataFrame,
    label: Column,
    how: Settings = Settings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit a model on at most ``2 * how.sample`` labelled texts (``label`` is 0 or 1; null labels are left out).

    The sample is chosen from the label rows alone, by a hash of the id and so alike at every size; its ids are a
    proven small list.  Without labelled rows of both classes every text scores 0.5 or the one class seen.
    """
    bounded_batches(documents.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), label.cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    marked = marked.withColumn("h", F.xxhash64("id", F.lit(how.seed)))
    first = [marked.filter(F.col("y") == y).orderBy("h", "id").limit(how.sample).select("id", "y") for y in (0, 1)]
    chosen = first[0].union(first[1]).dropDuplicates(["id"])
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = texts.filter(F.octet_length("text") <= how.longest)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for _, sizes, buckets in features(batch.column(1), how):
                for own in np.split(buckets, np.cumsum(sizes)[:-1]):
                    unique, n = np.unique(own, return_counts=True)
                    packed.append(np.concatenate([unique, n]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["id", "y", "packed"]
            )

    joined = texts.join(F.broadcast(chosen), "id").select("id", "text", "y")
    rows = joined.mapInArrow(run, f"id {kind}, y int, packed binary").toArrow().sort_by("id")
    parts, kept = [], []
    for y, packed in zip(rows.column("y").to_pylist(), rows.column("packed").to_pylist(), strict=True):
        pair = np.frombuffer(packed, np.int32)
        if len(pair):
            buckets, n = pair[: len(pair) // 2].astype(np.int64), pair[len(pair) // 2 :]
            parts.append((buckets, (n / n.sum()).astype(np.float32)))
            kept.append(y)
    if not parts:
        return Model(np.zeros(how.buckets), 0.0)
    return _descend(parts, np.array(kept, np.int64), how)


def score(
    documents: DataFrame, model: Model, how: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (id_col, score), the probability of label 1 from the whole text.

    Null, empty and blank texts have no features and get the model's bias alone.  Rows are independent: repeated rows
    and null ids come back as they are, an empty table gives an empty result, other columns are ignored.
    """
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(batch.column(1), how)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["id", "score"])

    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
