"""SentencePiece encoding and decoding for merge-type vocabularies.

A segment is a run of space marks with the characters after it.  The vocabulary holds no piece with a space mark after
another character, so merges never cross segments and every distinct segment can be merged on its own.  Merging works
on an agenda of adjacent symbol pairs ordered by score and then by place: a heap for a long segment, one array of the
pairs of many short ones, of which each segment takes its first entry in every round.  Workers keep the segments they
have seen, so a text costs about one look-up per word; in every Arrow batch all new segments are checked against the
library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.text import KEPT, Slots, alone, bounded_batches

MARK = "▁"
# Segments kept by a worker, in each of two generations.
KEPT_SEGMENTS = 70_000
LONGEST_KEPT = 64
# Fewer segments than this are merged one by one, which then costs less than the rounds over arrays.
FEWEST_AT_ONCE = 50
# More than this are merged in several runs, whose arrays stay in the processor's cache.
MOST_AT_ONCE = 4096
# Texts are cut into segments in runs of about this many characters, since each occurrence is a string of its own.
RUN_CHARS = 1 << 18
CODES = 0x110000
# An entry of the agenda is a piece's place in the order of scores, times PLACES, and the row of its left symbol.
PLACES = 1 << 7
NEVER = 1 << 40


class Vocabulary:
    """The pieces of a model file, read through the library, and the merges over them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = {}
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in self.ids)
        # Ids as text by segment: texts cost the garbage collector nothing, unlike lists.
        self._seen: dict[str, str] = {}
        self._old: dict[str, str] = {}
        # Segments that are let go of with the next call.
        self._long: list[str] = []
        # Segments whose ids are not the library's.
        self.differ: set[str] = set()
        self._pair_table()

    def _pair_table(self) -> None:
        """Symbols as numbers (a piece by its id, another character by its code past all ids) and the pairs that join."""
        size = self.library.vocab_size()
        self._spelled = [str(i) for i in range(size)]
        self._plain, self._none, self._base = size, size + CODES, size + CODES + 1
        self._symbol_of = np.arange(size, size + CODES, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self._symbol_of[ord(piece)] = i
        symbol = lambda text: self.ids.get(text, size + ord(text) if len(text) == 1 else None)
        joins: dict[int, int] = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    joins[left * self._base + right] = i
        self._pairs = Slots(np.fromiter(joins, np.uint64, len(joins)))
        # By entry of the pairs, of which 0 is none.
        self._made = np.array([0, *joins.values()], np.int64)
        # Places in the order of scores, the highest first; equal scores have equal places.
        places = np.zeros(size, np.int64)
        places[list(self.ids.values())] = np.unique([-self.scores[p] for p in self.ids], return_inverse=True)[1]
        self._place = places[self._made] * PLACES
        self._place[0] = NEVER

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, its place in the order of scores) of pairs of symbols; the place is NEVER where none exists."""
        entry = self._pairs.find((left * self._base + right).view(np.uint64))
        return self._made[entry], self._place[entry]

    def merge_all(self, segments: Sequence[str]) -> list[list[int]]:
        """Ids of each segment, as :meth:`merge` gives them, for all segments at once; none is longer than LONGEST_KEPT.

        The agenda holds the pairs of all segments, a column for each; in a round every segment's first entry is merged
        and the pairs beside it are entered anew.  Rounds are as many as one segment has merges at most.
        """
        n, sizes = len(segments), np.array([len(s) for s in segments])
        width = int(sizes.max())
        # A row before and rows behind hold no symbol, so that no pair needs a test for an end.
        symbols = np.full((width + 2, n), self._none)
        inside = np.arange(width) < sizes[:, None]
        symbols[1:-1].T[inside] = self._symbol_of[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        made, agenda = np.zeros(symbols.shape, np.int64), np.full(symbols.shape, NEVER)
        some = np.flatnonzero(symbols[2:] != self._none) + n
        symbols, made, flat = symbols.ravel(), made.ravel(), agenda.ravel()
        made[some], place = self._joined(symbols[some], symbols[some + n])
        flat[some] = place + some // n
        after = np.arange(len(symbols)) + n
        before = np.arange(len(symbols)) - n
        columns = np.arange(n)
        while True:
            first = agenda.min(axis=0)
            going = first < NEVER
            if not going.any():
                break
            left = (first[going] & (PLACES - 1)) * n + columns[going]
            right = after[left]
            symbols[left], symbols[right] = made[left], self._none
            flat[right] = NEVER
            behind = after[right]
            after[left], before[behind] = behind, left
            ahead = before[left]
            pairs = np.concatenate([ahead, left])
            made[pairs], place = self._joined(symbols[pairs], symbols[np.concatenate([left, behind])])
            flat[pairs] = np.minimum(place + pairs // n, NEVER)
        kept = symbols.reshape(width + 2, n).T
        there = kept != self._none
        ids, ends = kept[there], np.cumsum(there.sum(axis=1))
        odd = (kept[:, 1:-1] >= self._plain) & there[:, 1:-1]
        plain, begin, out = ids.tolist(), 0, []
        for end, unlisted in zip(ends.tolist(), odd.any(axis=1).tolist(), strict=True):
            own, begin = plain[begin:end], end
            if unlisted:
                own = [i for s in own for i in ([s] if s < self._plain else self._unlisted(chr(s - self._plain)))]
            out.append(own)
        return out

    def _unlisted(self, symbol: str) -> list[int]:
        """Ids of a character that is no piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def merge(self, segment: str) -> list[int]:
        """Ids of a segment: the pair whose joined piece has the highest score is merged first, the leftmost on ties."""
        n = len(segment)
        symbols: list[str | None] = list(segment)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, agenda = self.scores, []
        for i in range(n - 1):
            joined = segment[i : i + 2]
            if joined in scores:
                agenda.append((-scores[joined], i, i + 1, joined))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            # A pair is stale once either side has been merged: its text is then no longer the pair's.
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = joined + symbols[k]
                if new in scores:
                    heapq.heappush(agenda, (-scores[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + joined
                if new in scores:
                    heapq.heappush(agenda, (-scores[new], h, i, new))
        out: list[int] = []
        for symbol in symbols:
            if symbol is None:
                continue
            if symbol in self.ids:
                out.append(self.ids[symbol])
            else:
                out += self._unlisted(symbol)
        return out

    def segments(self, text: str) -> list[str]:
        """The segments of a text after the library's own normalisation of the model."""
        if not text:
            return []
        plain = self.library.normalize(text)
        return SEGMENT.findall(plain) if self.splits else [plain]

    def learn(self, segments: set[str]) -> dict[str, str]:
        """The ids, as text, of each segment and of others; valid until the next call.

        A segment that starts with its space mark is what the library makes of the rest, since it puts the mark before
        a text; the ids are the agenda's, and a segment for which the two differ is kept in ``differ``.
        """
        for segment in self._long:
            self._seen.pop(segment, None)
        self.differ.difference_update(self._long)
        if len(self._seen) > KEPT_SEGMENTS:
            self._seen, self._old = {}, self._seen
            self.differ.intersection_update(self._old)
        seen, old = self._seen, self._old
        fresh = segments.difference(seen)
        seen.update((s, old[s]) for s in fresh if s in old)
        new = sorted((s for s in fresh if s not in seen), key=len)
        long = len(new)
        while long and len(new[long - 1]) > LONGEST_KEPT:
            long -= 1
        for at in range(0, long, MOST_AT_ONCE):
            some = new[at : min(at + MOST_AT_ONCE, long)]
            seen.update(self._checked(some, self.merge_all(some) if len(some) >= FEWEST_AT_ONCE else map(self.merge, some)))
        self._long = new[long:]
        for segment in self._long:
            seen.update(self._checked([segment], [self.merge(segment)]))
        return seen

    def _checked(self, segments: list[str], merged: Iterable[list[int]]) -> Iterator[tuple[str, str]]:
        """Segments and their ids as text, after a look at the library's ids."""
        spell = self._spelled.__getitem__
        marked = [s[0] == MARK and len(s) > 1 for s in segments]
        rest = [s[1:].replace(MARK, " ") for s, m in zip(segments, marked, strict=True) if m]
        wanted = iter(self.library.encode(rest, num_threads=1))
        for segment, m, ids in zip(segments, marked, merged, strict=True):
            if m and next(wanted) != ids:
                self.differ.add(segment)
            yield segment, " ".join(map(spell, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str, bool]]:
        """(ids, ids as text, agreed) of each text, without an end id."""
        first = 0
        while first < len(texts):
            size, last = len(texts[first]), first + 1
            while last < len(texts) and size + len(texts[last]) <= RUN_CHARS:
                size, last = size + len(texts[last]), last + 1
            cut = [self.segments(t) for t in texts[first:last]]
            known = self.learn(set().union(*cut))
            for parts in cut:
                spelled = " ".join(map(known.__getitem__, parts))
                yield list(map(int, spelled.split())), spelled, not self.differ or self.differ.isdisjoint(parts)
            first = last


# A run of marks and what follows, or the start of a text without a mark.
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

_LOADED: dict[str, Vocabulary] = {}
KEPT["pieces"] = _LOADED.clear


def vocabulary(path: str) -> Vocabulary:
    """The worker's vocabulary of a model file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_decode(
    documents: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per document: (id_col, ids, n_tokens, ids_sha256, decoded_sha256, agreed).

    ids are those of the agenda for the whole text with the end id; ids_sha256 is over the decimal ids joined by one
    space, decoded_sha256 over the UTF-8 bytes of the library's decoding.  agreed tells whether the agenda and the
    library gave the same ids for all segments.  ``with_ids=False`` leaves the ids out.

    Null texts are empty; an empty text has the end id alone.  Rows are independent, so repeated rows, null ids and an
    empty table need nothing special; other columns are ignored.  Memory is bounded by an Arrow batch of texts and twice
    KEPT_SEGMENTS short segments, with those of one batch, per worker.
    """
    bounded_batches(documents.sparkSession, 500)
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("pieces")
        words = vocabulary(model)
        decode, end = words.library.decode, words.end
        for batch in batches:
            all_ids, counts, digests, decoded, agreed = [], [], [], [], []
            for ids, spelled, same in words.encode([t or "" for t in batch.column(1).to_pylist()]):
                ids.append(end)
                counts.append(len(ids))
                digests.append(hashlib.sha256(f"{spelled} {end}".lstrip().encode()).hexdigest())
                decoded.append(hashlib.sha256(decode(ids).encode()).hexdigest())
                agreed.append(same)
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))
            columns = {
                "id": batch.column(0),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(digests, pa.string()),
                "decoded_sha256": pa.array(decoded, pa.string()),
                "agreed": pa.array(agreed, pa.bool_()),
            }
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, agreed boolean"
    if with_ids:
        schema += ", ids array<int>"
    picked = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)
