"""Byte-level BPE encoding and decoding by a priority queue of merge ranks.

A text becomes parts (by the file's own normaliser and splitter), a part becomes a doubly linked list of symbols, and
the queue holds the adjacent pairs that have a rank.  The lowest rank merges first, the leftmost on ties; entries whose
pair has changed since are stale and skipped.  Workers keep the parts they have met, in two generations, so a common
part costs one look-up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.text import KEPT, alone, bounded_batches

KEPT_PARTS = 150_000
LONGEST_KEPT = 64
# Texts are cut into pieces of about this many characters, at white space, which no part crosses.
PIECE_CHARS = 1 << 18
# Below this code point nothing is decomposed or composed, and letters, numbers and cases are those of every version.
PLAIN_END = 0x300

# The normaliser's steps and the splitter's pattern that the short way below reproduces.
STEPS = ["NFC", "Replace", "Lowercase"]
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others for 256 and up, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _class(kind: str) -> str:
    """The plain characters of a general category, for use in brackets."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] == kind)


LETTER, NUMBER, SPACE = _class("L"), _class("N"), "\t\n\x0b\x0c\r \x85\xa0"
PLAIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
ASCII_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")
NOT_PLAIN = re.compile(f"[{chr(PLAIN_END)}-\U0010ffff]")
BREAK = re.compile("[ \n]")


class Bpe:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        made = json.load(open(path, encoding="utf-8"))
        model = made["model"]
        odd = [k for k in ("unk_token", "dropout", "continuing_subword_prefix") if model.get(k)]
        odd += [k for k in ("fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [a["content"] for a in made["added_tokens"] if any(a[k] for k in ("normalized", "single_word", "lstrip", "rstrip"))]
        self.decoder = (made["decoder"] or {}).get("type")
        if model["type"] != "BPE" or odd or self.decoder not in (None, "ByteLevel"):
            raise ValueError(f"not a plain byte-level BPE file: {model['type']}, {odd}, {self.decoder}")
        tool = Tokenizer.from_file(path)
        self._normalise = tool.normalizer.normalize_str if tool.normalizer else str
        self._split = tool.pre_tokenizer.pre_tokenize_str
        ids = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # Pair of symbols to (rank, symbol made); the symbol that each rank makes.
        self._ranks: dict[tuple[int, int], tuple[int, int]] = {}
        self._made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self._ranks[ids[a], ids[b]] = rank, ids[a + b]
            self._made.append(ids[a + b])
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self._bytes = {letter: b for b, letter in enumerate(letters)}
        # A byte without a symbol of its own is left out, as the library does where there is no unknown token.
        self._inner = [ids.get(letter) for letter in letters]
        self._last = [ids.get(letter + suffix) for letter in letters]
        self.names = {i: name for name, i in ids.items()}
        self.added = {a["content"]: a["id"] for a in made["added_tokens"]}
        self.names.update((i, name) for name, i in self.added.items())
        longest = sorted(self.added, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        steps = [s["type"] for s in (made["normalizer"] or {}).get("normalizers", [])]
        split = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        self._short = steps == STEPS and split == SPLITTER
        # White space separates parts, and an added token that holds some could be cut.
        self._cuts = self._short and not any(BREAK.search(a) for a in self.added)
        self._young: dict[str | int, bytes] = {}
        self._old: dict[str | int, bytes] = {}

    def merge(self, part: bytes) -> list[int]:
        """Ids of a part: merges by rank, then from the left, until no adjacent pair has a rank."""
        symbols = [s for s in map(self._inner.__getitem__, part[:-1]) if s is not None]
        if part and self._last[part[-1]] is not None:
            symbols.append(self._last[part[-1]])
        n, ranks, made = len(symbols), self._ranks, self._made
        queue = []
        for i in range(n - 1):
            found = ranks.get((symbols[i], symbols[i + 1]))
            if found is not None:
                queue.append(found[0] * n + i)  # rank first, then place
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        gone = -1
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            j, new = after[i], made[rank]
            # Stale: the symbol is gone, or what stands here now doesn't make this entry's symbol.
            if symbols[i] == gone or j >= n or ranks.get((symbols[i], symbols[j]), (0, gone))[1] != new:
                continue
            symbols[i], symbols[j] = new, gone
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((new, symbols[k]))
                if found is not None:
                    heapq.heappush(queue, found[0] * n + i)
            h = before[i]
            if h >= 0:
                found = ranks.get((symbols[h], new))
                if found is not None:
                    heapq.heappush(queue, found[0] * n + h)
        return [s for s in symbols if s != gone]

    def _long_way(self, text: str) -> list[str]:
        """Parts by the file's normaliser and splitter."""
        seen = self._split(self._normalise(text))
        return [bytes([self._bytes[c] for c in letters]).decode("utf-8", "surrogatepass") for letters, _ in seen]

    def _unmarked(self, text: str) -> list[str]:
        if not self._short:
            return self._long_way(text)
        if text.isascii():
            return ASCII_PARTS.findall(text.lower())
        if not NOT_PLAIN.search(text):
            return PLAIN_PARTS.findall(text.lower())
        parts: list[str] = []
        plain: list[str] = []
        for word in BREAK.split(text):
            if not NOT_PLAIN.search(word):
                plain.append(word)
                continue
            parts += PLAIN_PARTS.findall(" ".join(plain).lower())
            plain.clear()
            parts += self._long_way(word)
        return parts + PLAIN_PARTS.findall(" ".join(plain).lower())

    def parts(self, text: str) -> list[str | int]:
        """The parts of a text in order; an added token is its id."""
        if self._marks is None or not self._marks.search(text):
            return self._unmarked(text)
        found: list[str | int] = []
        for k, piece in enumerate(self._marks.split(text)):
            if k % 2:
                found.append(self.added[piece])
            elif piece:
                found += self._unmarked(piece)
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """A text in pieces that are encoded one by one; a run without a break stays whole."""
        start = 0
        while self._cuts and len(text) - start > PIECE_CHARS:
            cut = BREAK.search(text, start + PIECE_CHARS)
            if cut is None:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:] if start else text

    def learn(self, parts: set[str | int]) -> dict[str | int, bytes]:
        """Ids of each part, as little-endian 32-bit numbers."""
        if len(self._young) > KEPT_PARTS:
            self._young, self._old = {}, self._young
        young, old = self._young, self._old
        extra: dict[str | int, bytes] = {}
        for part in parts.difference(young):
            known = old.get(part)
            if known is None:
                ids = [part] if isinstance(part, int) else self.merge(part.encode("utf-8", "surrogatepass"))
                known = np.array(ids, "<u4").tobytes()
                if not isinstance(part, int) and len(part) > LONGEST_KEPT:
                    extra[part] = known
                    continue
            young[part] = known
        return young if not extra else {**{p: young[p] for p in parts if p in young}, **extra}

    def encode(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """For each text the ids of its pieces, as little-endian 32-bit numbers."""
        short = [self.parts(t) if len(t) <= PIECE_CHARS else None for t in texts]
        known = self.learn(set().union(*(p for p in short if p is not None)))

        def long(text: str) -> Iterator[bytes]:
            for piece in self.pieces(text):
                parts = self.parts(piece)
                yield b"".join(map(self.learn(set(parts)).__getitem__, parts))

        for text, parts in zip(texts, short, strict=True):
            yield long(text) if parts is None else iter([b"".join(map(known.__getitem__, parts))])

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after another, as the file's decoder puts them: with spaces between if it has none."""
        if self.decoder is None:
            return " ".join(map(self.names.__getitem__, ids))
        raw = "".join(map(self.names.__getitem__, ids))
        return b"".join(bytes([self._bytes[c]]) if c in self._bytes else c.encode() for c in raw).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}
KEPT["bpe"] = _LOADED.clear


def vocabulary(path: str) -> Bpe:
    """The worker's vocabulary of a tokenizer file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_decode(
    documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per document: (id_col, ids, n_tokens, ids_sha256, decoded_sha256).

    ids are those of the whole text without ids added around it; strings of added tokens in a text become their ids.
    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the UTF-8 bytes of the text
    they decode to.  ``with_ids=False`` leaves the ids out.

    Null texts are empty, an empty text has no ids.  Rows are independent, so repeated rows, null ids and a table without
    rows need nothing special; other columns are ignored.  Long texts are encoded in pieces cut at white space, so memory
    is bounded by an Arrow batch of texts, the longest run without a break and 2 x KEPT_PARTS short parts per worker.
    """
    bounded_batches(documents.sparkSession, 500)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe")
        bpe = vocabulary(path)
        between = " " if bpe.decoder is None else ""
        for batch in batches:
            all_ids, counts, digests, decoded = [], [], [], []
            for pieces in bpe.encode([t or "" for t in batch.column(1).to_pylist()]):
                raw, back, n, kept = hashlib.sha256(), hashlib.sha256(), 0, []
                held: list[int] = []
                for ids in pieces:
                    raw.update(ids)
                    now = np.frombuffer(ids, "<u4").tolist()
                    if with_ids:
                        kept += now
                    if bpe.decoder is None:
                        if now:
                            back.update(((between if n else "") + bpe.decode(now)).encode())
                    else:
                        held += now  # a character's bytes may lie in two pieces
                    n += len(now)
                if held:
                    back.update(bpe.decode(held).encode())
                counts.append(n)
                digests.append(raw.hexdigest())
                decoded.append(back.hexdigest())
                all_ids.append(kept)
            columns = {
                "id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>"
    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
