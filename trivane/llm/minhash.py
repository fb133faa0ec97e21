"""Near-duplicate documents by min-max hashing of word shingles.

Every permutation gives two signature values, the smallest and the largest hash of the set, so half the hash
evaluations of plain min-hashing make signatures of the same length with less variance.  Bands of signature values
bring candidates together; every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.links import components
from trivane.llm.text import LOWER, NOT_SPACE, alone, bounded_batches, chunks, lists, mix, span_hashes, word_spans
from trivane.session import materialize

PIECE = 2048
SMALL_BYTES = 8 << 20
SMALL_BUCKET = 6
BLOCK = 256
COLUMNS = 4096
COMPARED = 16


@dataclass(frozen=True)
class Shingling:
    """Parameters: words in a shingle, percent of similarity, bands, and permutations in a band (two values each).

    With 40 bands of 3 permutations a pair at similarity 0.8 is missed with a probability of about 5e-6.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    permutations: int = 3
    seed: int = 7


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted.

    A text with fewer words than a shingle has its whole word sequence as its one shingle; one without words has none.
    """
    step = np.uint64(0xD6E8FEB86659FD93)
    for _, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, doc = word_spans(NOT_SPACE[data], offsets)
        word = span_hashes(data, starts, ends)
        bounds = np.searchsorted(doc, np.arange(len(offsets)))
        rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for j in range(words):
            rolled = rolled * step + word[j : j + len(rolled)]
        rolled = mix(rolled)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                whole = np.zeros(1, np.uint64)
                for h in word[lo:hi]:
                    whole = whole * step + h
                yield mix(whole + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def min_max(shingles: np.ndarray, flip: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest hash of a set under each permutation."""
    low = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(flip), np.uint64)
    for at in range(0, len(shingles), PIECE):
        hashed = (shingles[None, at : at + PIECE] ^ flip[:, None]) * factor[:, None]
        np.minimum(low, hashed.min(axis=1), out=low)
        np.maximum(high, hashed.max(axis=1), out=high)
    return low, high


def _signer(how: Shingling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("minhash")
        random = np.random.default_rng(how.seed)
        count = how.bands * how.permutations
        flip, factor = random.integers(0, 1 << 64, (2, count), np.uint64)
        factor |= np.uint64(1)
        number = mix(np.arange(1, how.bands + 1, dtype=np.uint64))
        step = np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            sizes, first, second, bands = [], [], [], []
            for shingles in shingle_sets(batch.column(1), how.words):
                sizes.append(len(shingles))
                mixed = mix(shingles + step)
                first.append(mixed.sum(dtype=np.uint64))
                second.append(np.bitwise_xor.reduce(mix(mixed ^ step)) if len(shingles) else np.uint64(0))
                if not len(shingles):
                    bands.append(np.zeros(0, np.int64))
                    continue
                low, high = min_max(shingles, flip, factor)
                key = number.copy()
                for value in (low, high):
                    for column in value.reshape(how.bands, how.permutations).T:
                        key = mix(key * step + column)
                bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.array(first, np.uint64).view(np.int64)),
                    pa.array(np.array(second, np.uint64).view(np.int64)),
                    lists(bands, pa.int64()),
                ],
                names=["id", "n", "k1", "k2", "bands"],
            )

    return run


def signatures(documents: DataFrame, how: Shingling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, k1, k2, bands): size of the shingle set, a 128-bit digest of it, and one key per band."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema[id_col].dataType.simpleString()
    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(_signer(how), f"id {kind}, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def _sets(documents: DataFrame, ids: DataFrame, how: Shingling) -> DataFrame:
    """(id, shingles) of the documents named in ``ids``; the ids are broadcast only if counted small."""
    if ids.count() * 16 <= SMALL_BYTES:
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch.column(1), how.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(found, pa.int64())], names=["id", "shingles"])

    kind = documents.schema["id"].dataType.simpleString()
    return documents.join(ids, "id", "left_semi").mapInArrow(run, f"id {kind}, shingles array<bigint>")


def _alike(one, two, percent: int):
    return F.least(one, two) * 100 >= F.greatest(one, two) * percent


def _confirmed(pairs: DataFrame, documents: DataFrame, how: Shingling) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    ids = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = materialize(_sets(documents, ids, how), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("n"))
    return common.filter(F.col("n") * 100 >= (F.col("both") - F.col("n")) * how.percent).select("a", "b").distinct()


def _open(members: DataFrame, joined: DataFrame) -> tuple[DataFrame, int, int]:
    """Members of buckets with several components, with their component and the bucket's largest.

    Also the number of rows outside the largest, and of the comparisons of those with all of their bucket.
    """
    placed = members.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    shares = placed.groupBy("band", "component").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("band").agg(F.max(F.struct("c", "component")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("m"))
    outside = (F.col("m") - F.col("most.c")).alias("outside")
    mixed = materialize(mixed.filter("parts > 1").select("band", F.col("most.component").alias("main"), "m", outside), "mixed")
    left = mixed.agg(F.coalesce(F.sum("outside"), F.lit(0)), F.coalesce(F.sum(F.col("outside") * F.col("m")), F.lit(0))).first()
    return materialize(placed.join(mixed.drop("outside"), "band"), "open"), left[0], left[1]


def _small_pairs(open_: DataFrame, how: Shingling) -> DataFrame:
    """Pairs across components in buckets of at most SMALL_BUCKET members: a bounded number per member."""
    small = open_.filter(F.col("m") <= SMALL_BUCKET)
    one, two = small.filter("component != main").alias("one"), small.alias("two")
    met = one.join(
        two,
        (F.col("one.band") == F.col("two.band"))
        & (F.col("one.component") != F.col("two.component"))
        & _alike(F.col("one.n"), F.col("two.n"), how.percent),
    )
    return met.select(F.least("one.rep", "two.rep").alias("a"), F.greatest("one.rep", "two.rep").alias("b")).distinct()


def _common(left: np.ndarray, right: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in ``left`` with those in ``right``, some columns at a time."""
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    place = np.full(len(starts) - 1, -1)
    place[left] = np.arange(len(left))
    place_r = np.full(len(starts) - 1, -1)
    place_r[right] = np.arange(len(right))
    column = np.unique(values, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, rows = column[order], rows[order]
    found = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        c, r = column[lo:hi] - at, rows[lo:hi]
        x[place[r][place[r] >= 0], c[place[r] >= 0]] = 1
        y[place_r[r][place_r[r] >= 0], c[place_r[r] >= 0]] = 1
        found += x @ y.T
    return found


def _block_links(open_: DataFrame, rows: DataFrame, how: Shingling) -> DataFrame:
    """Links across components in larger buckets.

    A bucket is dealt into blocks of about BLOCK members.  Each block of members outside the largest component meets
    each block in one group of bounded size, whose full sets are compared there; only links leave the group.
    """
    big = open_.filter(F.col("m") > SMALL_BUCKET)
    ids = materialize(big.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = materialize(_sets(rows, ids, how).withColumnRenamed("id", "rep"), "sets")
    held = big.join(sets, "rep").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    held = held.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    all_ = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cols = ["band", "rep", "component", "shingles", "i", "j", "side"]
    first = held.filter("component != main").withColumns({"i": F.col("own"), "side": F.lit(0)}).withColumn("j", all_)
    second = held.withColumns({"j": F.col("own"), "side": F.lit(1)}).withColumn("i", all_)
    percent = how.percent

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        rep, part = table.column("rep").to_numpy(), table.column("component").to_numpy()
        if not len(left) or not len(right):
            return pa.table({"a": pa.array(rep[:0]), "b": pa.array(rep[:0])})
        packed = table.column("shingles").chunk(0)
        starts = packed.offsets.to_numpy().astype(np.int64)
        values = packed.values.to_numpy()[starts[0] : starts[-1]]
        both = _common(left, right, starts - starts[0], values)
        size = np.diff(starts)
        union = size[left][:, None] + size[right][None, :] - both
        x, y = np.nonzero((both * 100 >= union * percent) & (part[left][:, None] != part[right][None, :]))
        one, two = rep[left[x]], rep[right[y]]
        return pa.table({"a": pa.array(np.minimum(one, two)), "b": pa.array(np.maximum(one, two))})

    kind = rows.schema["id"].dataType.simpleString()
    grouped = first.select(cols).union(second.select(cols)).groupBy("band", "i", "j")
    return grouped.applyInArrow(compare, f"a {kind}, b {kind}").distinct()


def _extended(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the components that the links touch are joined anew."""
    one = joined.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    two = joined.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    met = links.join(one, "a", "left").join(two, "b", "left")
    merged = components(met.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = materialize(merged, "merged")
    known = joined.union(merged.select("id", "id")).groupBy("id").agg(F.min("component").alias("c"))
    now = merged.select(F.col("id").alias("c"), F.col("component").alias("new"))
    return materialize(known.join(now, "c", "left").select("id", F.coalesce("new", "c").alias("component")), "components")


def near_duplicates(
    documents: DataFrame, how: Shingling = Shingling(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    Two documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id reachable over links and kept marks it.  Words are runs of bytes that are no white space, lower-cased
    in A-Z.

    1. Documents with equal sets form a class, so copies cost nothing from here on.
    2. In each bucket of a band all classes are compared with the smallest one: linear in the bucket.
    3. Where a bucket still holds several components, the classes outside its largest one are compared with a class
       of the largest one, another in every bucket and round, as long as that halves what is open and step 4 would
       take more than COMPARED comparisons for each member of a bucket.
    4. What is still open is compared across components, the classes outside a bucket's largest component with all
       others: small buckets by a join, larger ones in blocks, so no task gets a whole bucket and no pair but a link
       leaves a block.  This covers every candidate pair that could still join two components.

    Texts that are null, empty or without words have no shingles and link with nothing.  Rows with a null id are
    returned with a null component and kept.  Rows that share an id count as one document in links, and each row is
    returned.  An empty table gives an empty result.  Other columns are ignored.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(rows, how, "id", "text"), "signatures")
    usable = signed.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = materialize(
        usable.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("band"), "rep", "n")
    buckets = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.count("*").alias("size"))
    buckets = materialize(buckets.filter("size > 1").select("band", "lead", "size"), "buckets")
    members = materialize(
        banded.join(buckets, "band").filter(F.col("rep") != F.col("lead.rep")), "members"
    )
    star = members.filter(_alike(F.col("n"), F.col("lead.n"), how.percent))
    star = materialize(star.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    links = materialize(_confirmed(star, rows, how), "links")
    joined = materialize(components(links), "components")

    members = members.filter("size > 2").select("band", "rep", "n")
    open_, left, work = _open(members, joined)
    bound = COMPARED * members.count()
    while work > bound:
        own = open_.filter("component = main")
        pivot = own.groupBy("band").agg(
            F.min(F.struct(F.xxhash64("rep", "band", F.lit(left)).alias("h"), "rep", "n")).alias("pivot")
        )
        tried = open_.filter("component != main").join(pivot, "band")
        tried = tried.filter(_alike(F.col("n"), F.col("pivot.n"), how.percent))
        tried = tried.select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b"))
        joined = _extended(joined, _confirmed(materialize(tried.distinct(), "pairs"), rows, how))
        before = left
        open_, left, work = _open(members, joined)
        if left * 2 > before:
            break
    if left:
        small = _confirmed(materialize(_small_pairs(open_, how), "pairs"), rows, how)
        joined = _extended(joined, small.union(_block_links(open_, rows, how)))

    found = classes.select("k1", "k2", "rep").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    found = materialize(found.select("k1", "k2", F.coalesce("component", "rep").alias("component")), "found")
    out = signed.select("id", "n", "k1", "k2").join(found, ["k1", "k2"], "left")
    group = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    group = F.when(F.col("id").isNotNull(), group)
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        group.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == group)).alias("kept"),
    )
