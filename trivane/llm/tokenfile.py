"""Token ids of documents as binary files, written and read by Spark tasks.

A file is a sequence of groups of whole documents.  A group has a header (id histogram, document index) and blocks of
equal length that are coded independently by ``rangecoder`` and carry the CRC-32 of their ids.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trivane.llm import rangecoder
from trivane.llm.bpe import LETTER, NOT_PLAIN, NUMBER, PLAIN_END, SPACE, byte_letters
from trivane.llm.text import BASE, KEPT, alone, bounded_batches, mix
from trivane.session import materialize, new_step_dir

MAGIC = b"TIDS2\n"
BLOCK = 4096
GROUP = 1536 * BLOCK
KEPT_WORDS = 400_000
KEPT_IDS = 8 * KEPT_WORDS
KEPT_OTHERS = 100_000
LONGEST_KEPT = 64
# Texts are cut into parts in runs of about this many characters.
RUN_CHARS = 1 << 20
# Parts of about this many characters of text are looked up together.
JOIN_CHARS = 1 << 24
# magic, blocks, block length, ids, ids that occur, documents, bytes of the packed header
HEAD = struct.Struct("<6sIIQIQQ")


@dataclass(frozen=True)
class Tokens:
    """A tokenizer file of the tokenizers library, and the id put after every document."""

    path: str
    end: int


# The pattern by which the vocabulary's splitter finds its parts, and the same on lower-case ASCII text.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ASCII_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
PRINTABLE = re.compile(r"[a-z]+|[0-9]|[!-/:-@\[-`{-~]+")
STEPS = ["NFC", "Replace", "Lowercase"]
# Kinds and lower case of the plain characters.  One of them has a lower case of two characters.
OF_SPACE, OF_LETTER, OF_NUMBER, OF_OTHER = range(4)
KIND = np.full(PLAIN_END, OF_OTHER, np.uint8)
for _kind, _members in ((OF_SPACE, SPACE), (OF_LETTER, LETTER), (OF_NUMBER, NUMBER)):
    KIND[[ord(c) for c in _members]] = _kind
LONGER = next(chr(c) for c in range(PLAIN_END) if len(chr(c).lower()) > 1)
LOWER = np.array([ord(chr(c).lower()[0]) for c in range(PLAIN_END)], np.uint16)
BYTE_LETTERS = "".join(byte_letters())
QUOTE = ord("'")


def plain_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SPLITTER's parts of lower-cased plain characters: (characters of all parts, begins in them, begins in ``codes``)."""
    kind, low = KIND[codes], LOWER[codes]
    begins = np.empty(len(codes), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == OF_NUMBER
    inside = kind != OF_SPACE
    begins &= inside
    # A quote that begins a part takes certain endings with it; what follows begins anew.
    quotes = np.flatnonzero((low == QUOTE) & begins)
    if len(quotes):
        after = np.concatenate([low, np.zeros(3, np.uint16)])
        one, two = after[quotes + 1], after[quotes + 2]
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, length in ((np.isin(one, [ord(c) for c in "stmd"]), 2), (pairs, 3)):
            at = quotes[found]
            begins[at + 1] = False
            end = at + length
            end = end[end < len(codes)]
            begins[end] = inside[end]
    return low[inside], np.flatnonzero(begins[inside]), np.flatnonzero(begins)


def spread(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` of given starts and lengths, one after another."""
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    shift += np.arange(len(shift))
    return flat[shift]


def part_hashes(chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts that follow one another in ``chars``; none is empty."""
    if not len(begins):
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64), dtype=np.uint64)
    place = np.arange(len(chars)) - np.repeat(begins, sizes)
    return mix(np.add.reduceat((chars + np.uint64(1)) * powers[place], begins) + sizes.astype(np.uint64))


class _Kept:
    """Parts and their ids: sorted hashes, the place of each, and by place the part's characters and ids."""

    def __init__(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.begins, self.sizes, self.chars = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint16)
        self.starts, self.counts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def full(self) -> bool:
        return len(self.sizes) > KEPT_WORDS or len(self.ids) > KEPT_IDS

    def find(self, keys: np.ndarray, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The place of each part, -1 where it isn't kept; characters are compared, since hashes may agree by chance."""
        places = np.full(len(keys), -1)
        if not len(self.keys):
            return places
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        k = np.flatnonzero(self.keys[at] == keys)
        found = self.places[at[k]].astype(np.int64)
        alike = self.sizes[found] == sizes[k]
        k, found = k[alike], found[alike]
        places[k] = found
        other = spread(chars, begins[k], sizes[k]) != spread(self.chars, self.begins[found], sizes[k])
        if other.any():
            places[np.repeat(k, sizes[k])[other]] = -1
        return places

    def add(
        self, keys: np.ndarray, chars: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray
    ) -> None:
        """Keep parts of given characters and ids; of those with one hash the first is found again."""
        places = np.arange(len(self.sizes), len(self.sizes) + len(keys), dtype=np.int32)
        for name, more in (
            ("begins", len(self.chars) + np.cumsum(sizes) - sizes),
            ("sizes", sizes),
            ("chars", spread(chars, begins, sizes)),
            ("starts", len(self.ids) + np.cumsum(counts) - counts),
            ("counts", counts),
            ("ids", ids),
        ):
            array = getattr(self, name)
            setattr(self, name, np.concatenate([array, more.astype(array.dtype)]))
        once, first = np.unique(keys, return_index=True)
        at = np.searchsorted(self.keys, once)
        fresh = np.append(self.keys, 0)[at] != once
        fresh |= at == len(self.keys)
        self.keys = np.insert(self.keys, at[fresh], once[fresh])
        self.places = np.insert(self.places, at[fresh], places[first[fresh]])

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the parts at these places, ids per part)."""
        counts = self.counts[places].astype(np.int64)
        return spread(self.ids, self.starts[places].astype(np.int64), counts), counts


# Plain texts that are cut: their words as an Arrow dictionary, and words per text.  Or other texts: ids, and ids per text.
Cut = tuple[pa.DictionaryArray | np.ndarray, np.ndarray]


class Encoder:
    """Encodes whole texts part by part.

    The tokenizer's normaliser and splitter treat white space as a break that nothing crosses, so a text's ids are
    those of its parts between spaces and line feeds, one after another.  Where the tokenizer lower-cases and splits by
    SPLITTER, plain texts are cut further, many at once, into what the splitter gives the model, and so are the ASCII
    words of others.  Parts seen before are looked up in two generations, so that common parts stay when the older one
    goes.
    """

    def __init__(self, how: Tokens) -> None:
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(how.path)
        self.size = max(self._tool.get_vocab_size(with_added_tokens=True), how.end + 1)
        self._young, self._old = _Kept(), _Kept()
        # Of texts that aren't plain.
        self._young_words: dict[str, tuple[int, ...]] = {"": ()}
        self._old_words: dict[str, tuple[int, ...]] = {}
        made = json.loads(self._tool.to_str())
        steps = [s["type"] for s in (made["normalizer"] or {}).get("normalizers", [])]
        split = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self._fine = steps == STEPS and split == SPLITTER
        self._added = [a["content"] for a in made["added_tokens"]]

    def _parts(self, text: str) -> list[str]:
        whole = any(a in text for a in self._added)
        if not self._fine or whole:
            return text.replace("\n", " ").split(" ")
        if text.isascii():
            return ASCII_PARTS.findall(text.lower())
        # Runs of ASCII words between the others are cut together.
        parts: list[str] = []
        for ascii_, words in groupby(text.replace("\n", " ").split(" "), str.isascii):
            if ascii_:
                parts += ASCII_PARTS.findall(" ".join(words).lower())
            else:
                parts += words
        return parts

    def _plain(self, text: str) -> bool:
        plain = self._fine and not NOT_PLAIN.search(text) and LONGER not in text
        return plain and not any(a in text for a in self._added)

    def _other(self, texts: list[str]) -> Cut:
        """(ids, ids per text) of texts that aren't plain."""
        if len(self._young_words) > KEPT_OTHERS:
            self._young_words, self._old_words = {"": ()}, self._young_words
        young, old = self._young_words, self._old_words
        cut = [self._parts(t) for t in texts]
        fresh = set().union(*cut).difference(young)
        young.update((w, old[w]) for w in fresh if w in old)
        new = [w for w in fresh if w not in young]
        if self._fine:
            # The splitter gives parts of printable ASCII to the model as they are.
            tokenize = self._tool.model.tokenize
            young.update((w, tuple([t.id for t in tokenize(w)])) for w in new if PRINTABLE.fullmatch(w))
        rest = [w for w in new if w not in young]
        found = self._tool.encode_batch_fast(rest, add_special_tokens=False)
        young.update((w, tuple(e.ids)) for w, e in zip(rest, found, strict=True))
        ids = [np.fromiter(chain.from_iterable(map(young.__getitem__, parts)), np.int32) for parts in cut]
        for word in new:
            if len(word) > LONGEST_KEPT:
                del young[word]
        return np.concatenate(ids), np.array([len(i) for i in ids])

    def _cut_plain(self, texts: list[str]) -> Cut:
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        chars, begins, at = plain_parts(codes)
        ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))
        offsets = np.append(begins, len(chars)).astype(np.int32) * np.int32(2)
        words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(chars)])
        return words.dictionary_encode(), np.diff(ends, prepend=0)

    def cut(self, texts: list[str]) -> list[Cut]:
        """The parts of all texts, in runs."""
        sums = np.cumsum([len(t) for t in texts])
        cuts, first = [], 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(sums, sums[first] + RUN_CHARS, "right")))
            run = texts[first:last]
            if self._plain("\n".join(run)):
                cuts.append(self._cut_plain(run))
            else:
                for plain, some in groupby(run, self._plain):
                    cuts.append((self._cut_plain if plain else self._other)(list(some)))
            first = last
        return cuts

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, counts) of distinct plain parts; new ones are encoded and kept."""
        if self._young.full():
            self._young, self._old = _Kept(), self._young
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(words) + 1].astype(np.int64)
        data = data.to_pybytes() if data is not None else b""
        chars, begins, sizes = np.frombuffer(data, np.uint16), offsets[:-1] // 2, np.diff(offsets) // 2
        keys = part_hashes(chars[: offsets[-1] // 2], begins, sizes)
        places = self._young.find(keys, chars, begins, sizes)
        unknown = np.flatnonzero(places < 0)
        older = self._old.find(keys[unknown], chars, begins[unknown], sizes[unknown])
        again, older, new = unknown[older >= 0], older[older >= 0], unknown[older < 0]
        known = np.flatnonzero(places >= 0)
        # The splitter gives the model a part's bytes as letters.
        tokenize, ids, counts = self._tool.model.tokenize, [], []
        for a, b in zip(offsets[new].tolist(), offsets[new + 1].tolist(), strict=True):
            found = tokenize(charmap_decode(data[a:b].decode("utf-16-le").encode(), "strict", BYTE_LETTERS)[0])
            counts.append(len(found))
            ids += [t.id for t in found]
        new_ids, new_counts = np.array(ids, np.int32), np.array(counts, np.int64)
        (known_ids, known_counts), (again_ids, again_counts) = self._young.of(places[known]), self._old.of(older)
        order = np.concatenate([known, again, new])
        counts_in_order = np.concatenate([known_counts, again_counts, new_counts])
        begin, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begin[order], count[order] = np.cumsum(counts_in_order) - counts_in_order, counts_in_order
        flat = np.concatenate([known_ids, again_ids, new_ids])
        kept = np.concatenate([again, new])
        kept = kept[sizes[kept] <= LONGEST_KEPT]
        self._young.add(keys[kept], chars, begins[kept], sizes[kept], spread(flat, begin[kept], count[kept]), count[kept])
        return flat, begin, count

    def join(self, cuts: list[Cut]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text) of texts that are cut: their distinct parts are looked up together."""
        plain = [words for words, _ in cuts if isinstance(words, pa.DictionaryArray)]
        found = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        if plain:
            every = pa.concat_arrays([w.dictionary for w in plain]).dictionary_encode()
            number, first = every.indices.to_numpy(), 0
            flat, begin, count = self._ids_of(every.dictionary)
        for words, n in cuts:
            if isinstance(words, np.ndarray):
                found.append((words, n))
                continue
            part = number[first : first + len(words.dictionary)][words.indices.to_numpy()]
            first += len(words.dictionary)
            counts = count[part]
            sums = np.concatenate([[0], np.cumsum(counts)])
            found.append((spread(flat, begin[part], counts), np.diff(sums[np.cumsum(n)], prepend=0)))
        ids, counts = zip(*found, strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        return self.join(self.cut(texts))

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.flat(texts)
        ends = np.cumsum(counts)
        return [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


_LOADED: dict[Tokens, Encoder] = {}
KEPT["tokenfile"] = _LOADED.clear


def encoder(how: Tokens) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if how not in _LOADED:
        _LOADED[how] = Encoder(how)
    return _LOADED[how]


def pack_group(ids: np.ndarray, docs: list, counts: list[int], size: int) -> bytes:
    """A group: header, document index and coded blocks."""
    blocks = max(1, -(-len(ids) // BLOCK))
    histogram = np.bincount(ids, minlength=size)
    freq = rangecoder.scaled(histogram)
    used = np.flatnonzero(freq)
    padded = np.full(blocks * BLOCK, used[0], np.int32)
    padded[: len(ids)] = ids
    coded = rangecoder.encode(padded.reshape(blocks, BLOCK), freq)
    sums = [zlib.crc32(padded[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(blocks)]
    index = zlib.compress(
        np.diff(used, prepend=0).astype("<u4").tobytes()
        + freq[used].astype("<u4").tobytes()
        + np.array(counts, "<u8").tobytes()
        + np.array([len(c) for c in coded], "<u4").tobytes()
        + np.array(sums, "<u4").tobytes()
        + "\n".join("" if d is None else str(d) for d in docs).encode(),
        6,
    )
    return HEAD.pack(MAGIC, blocks, BLOCK, len(ids), len(used), len(docs), len(index)) + index + b"".join(coded)


def unpack_group(data: bytes, size: int = 0) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(ids, document ids as text, ids per document) of a group; damaged blocks raise ValueError."""
    magic, blocks, length, total, used, docs, packed = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a group of token ids")
    head = zlib.decompress(data[HEAD.size : HEAD.size + packed])
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(head, kind, n, at)
        at += out.nbytes
        return out

    occur = np.cumsum(take("<u4", used).astype(np.int64))
    freq = np.zeros(max(size, int(occur[-1]) + 1), np.int64)
    freq[occur] = take("<u4", used)
    counts, sizes, sums = take("<u8", docs).astype(np.int64), take("<u4", blocks), take("<u4", blocks)
    names = head[at:].decode().split("\n") if docs else []
    ends = HEAD.size + packed + np.cumsum(sizes.astype(np.int64))
    ids = rangecoder.decode([data[e - n : e] for e, n in zip(ends, sizes, strict=True)], length, freq)
    for k in range(blocks):
        if zlib.crc32(ids[k].astype("<u4").tobytes()) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return ids.ravel()[:total], names, counts


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_tokens(
    documents: DataFrame, how: Tokens, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the ids of all documents in ascending id order; returns the manifest, one row per group.

    (part, file, number, at, bytes, docs, ids): files are numbered by ``part`` in id order, groups by ``number``.  A
    task writes a file of its own name, and only files whose task succeeded are in the manifest, so lost executors and
    repeated tasks leave no wrong data.  Null texts are empty, null ids come first, repeated rows are written as often.
    """
    spark = documents.sparkSession
    bounded_batches(spark, 500)
    folder = folder or new_step_dir(spark, "tokens")
    picked = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = picked.repartitionByRange("id").sortWithinPartitions("id")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("tokenfile")
        tool, stream, number, part, name = encoder(how), None, 0, 0, ""
        docs: list = []
        texts: list[str] = []
        cuts: list[Cut] = []
        chars = cut_chars = 0
        # Documents that are encoded, and not yet written.
        held: list[np.ndarray] = []
        counts: list[int] = []

        def cut() -> None:
            nonlocal chars, cut_chars
            cuts.extend(tool.cut(texts))
            texts.clear()
            chars, cut_chars = 0, cut_chars + chars

        def join() -> None:
            nonlocal cut_chars
            ids, found = tool.join(cuts)
            held.append(np.insert(ids, np.cumsum(found), how.end))
            counts.extend((found + 1).tolist())
            cuts.clear()
            cut_chars = 0

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            """Write groups of whole documents while more than ``least`` ids are held."""
            nonlocal number
            total = sum(counts)
            if total <= least:
                return
            ids = np.concatenate(held)
            ends, first, begin = np.cumsum(counts), 0, 0
            while total - begin > least:
                # The last groups are of about the same size, so that none is small.
                most = GROUP if least else -(-(total - begin) // -(-(total - begin) // GROUP))
                last = min(int(np.searchsorted(ends, begin + most, "left")) + 1, len(ends))
                body = pack_group(ids[begin : ends[last - 1]], docs[first:last], counts[first:last], tool.size)
                at = stream.tell()
                stream.write(body)
                row = [part, name, number, at, len(body), last - first, int(ends[last - 1]) - begin]
                kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                number, first, begin = number + 1, last, int(ends[last - 1])
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=MANIFEST)
            held[:] = [ids[begin:]]
            del docs[:first], counts[:first]

        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                part = batch.column(2)[0].as_py()
                system, root = _open(folder)
                system.create_dir(root, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.tok"
                stream = system.open_output_stream(f"{root}/{name}")
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                chars += len(text)
                if chars >= RUN_CHARS:
                    cut()
                if cut_chars >= JOIN_CHARS:
                    join()
                    yield from flush(GROUP + GROUP // 2)
        if stream is not None:
            cut()
            join()
            yield from flush(0)
            stream.close()

    schema = "part int, file string, number bigint, at bigint, bytes bigint, docs bigint, ids bigint"
    written = materialize(ordered.mapInArrow(run, schema), "manifest")
    return written.withColumn("folder", F.lit(folder))


MANIFEST = ["part", "file", "number", "at", "bytes", "docs", "ids"]


def read_tokens(manifest: DataFrame, how: Tokens, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: (id_col, start, n_tokens, ids_crc32).

    start counts the ids of all documents before it; ids_crc32 is over the ids as little-endian unsigned 32-bit numbers.
    Groups are read independently; only one total per file passes through the driver.
    """
    spark = manifest.sparkSession
    sizes = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("ids").alias("n")).collect())
    offset, begins = 0, []
    for part, n in sizes:
        begins.append((part, offset))
        offset += n
    starts = spark.createDataFrame(begins, "part int, begin bigint")
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    groups = manifest.withColumn("inner", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    groups = groups.join(F.broadcast(starts), "part")
    groups = groups.select("folder", "file", "at", "bytes", (F.col("begin") + F.col("inner")).alias("start"))
    spread = groups.repartition(max(1, len(sizes), spark.sparkContext.defaultParallelism), "file", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("tokenfile read")
        for batch in batches:
            for row in batch.to_pylist():
                system, root = _open(row["folder"])
                with system.open_input_file(f"{root}/{row['file']}") as stream:
                    stream.seek(row["at"])
                    ids, names, counts = unpack_group(stream.read(row["bytes"]))
                raw = ids.astype("<u4")
                ends = np.cumsum(counts)
                sums = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n or None for n in names], pa.string()),
                        pa.array(row["start"] + ends - counts),
                        pa.array(counts),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    found = spread.mapInArrow(run, "id string, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.select(F.col("id").cast(id_type).alias(id_col), "start", "n_tokens", "ids_crc32")
