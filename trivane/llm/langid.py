"""Language identification by unigrams over a fixed piece vocabulary, summed over all segmentations.

A word is a run of letters, lower-cased, with a space mark before it.  Each language has a probability for every piece
of a public vocabulary; the forward algorithm sums the probabilities of all ways to cut a word into pieces, and a text
scores the sum of the logarithms over its words.  Words are counted over many texts, so that the sums are found once
per distinct word of a task, as far as its memory goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.text import KEPT, Slots, SpanHasher, alone, bounded_batches, span_hashes, word_spans

MARK = ord("▁")
# A longer run of letters is scored as several words; it keeps the products of probabilities in range.
LONGEST = 24
FLOOR = 1e-7
UNKNOWN = "und"
BLOCK_CHARS = 1 << 20
# Distinct words that a task holds, and those whose prefixes are summed at a time.
MOST_WORDS = 1 << 18
WORDS_AT_ONCE = 1 << 14


class Pieces:
    """Letter pieces of a vocabulary, looked up by hash and length."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = []
        for i in range(library.vocab_size()):
            piece = library.id_to_piece(i)
            body = piece[1:] if piece and ord(piece[0]) == MARK else piece
            if (body.isalpha() and body == body.lower() or piece == chr(MARK)) and len(piece) <= LONGEST + 1:
                kept.append(piece)
        self.count = len(kept)
        # By length: the beginnings of pieces, and the piece that each is, or the count of pieces if it is none.
        number = {piece: k for k, piece in enumerate(kept)}
        begins = sorted({piece[:n] for piece in kept for n in range(1, len(piece) + 1)})
        self.tables: dict[int, tuple[Slots, np.ndarray]] = {}
        for n in range(1, max(map(len, kept), default=0) + 1):
            own = [p for p in begins if len(p) == n]
            chars = np.array([[ord(c) for c in p] for p in own], np.uint32).ravel()
            at = np.arange(0, len(chars), n)
            self.tables[n] = Slots(span_hashes(chars, at, at + n)), np.array([self.count, *[number.get(p, self.count) for p in own]])
        letter = np.zeros(0x110000, bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                letter[code] = True
                low = c.lower()
                if len(low) == 1:
                    lower[code] = ord(low)
        self.letter, self.lower = letter, lower


_LOADED: dict[str, Pieces] = {}
KEPT["langid"] = _LOADED.clear


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


@dataclass(frozen=True)
class Bag:
    """Distinct words by ascending hash: their lengths, and their letters one after another."""

    hashes: np.ndarray
    sizes: np.ndarray
    letters: np.ndarray

    def only(self, which: np.ndarray) -> Bag:
        """The words at some places, in the order given."""
        starts = np.cumsum(self.sizes) - self.sizes
        return Bag(self.hashes[which], self.sizes[which], _gathered(self.letters, starts[which], self.sizes[which]))


def _gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The values of spans, one after another."""
    return values[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def bag_of(vocab: Pieces, texts: list[str]) -> tuple[Bag, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and for each occurrence its text and its word's place."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    starts, ends, doc = word_spans(vocab.letter[codes], offsets)
    parts = -(-(ends - starts) // LONGEST)
    if len(parts) and parts.max() > 1:
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + step * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, parts))
        doc = np.repeat(doc, parts)
    codes = vocab.lower[codes]
    hashes, first, inverse = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
    sizes = (ends - starts)[first]
    return Bag(hashes, sizes, _gathered(codes, starts[first], sizes)), doc, inverse


class Lattice:
    """Distinct words, the longest first, so that those still running are a prefix, and the pieces within them."""

    def __init__(self, vocab: Pieces, bag: Bag) -> None:
        order = np.argsort(-bag.sizes, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        bag = bag.only(order)
        self.size = bag.sizes + 1
        self.at = np.zeros(len(self.size) + 1, np.int64)
        np.cumsum(self.size, out=self.at[1:])
        self.chars = np.full(self.at[-1], MARK, np.uint32)
        inner = np.ones(self.at[-1], bool)
        inner[self.at[:-1]] = False
        self.chars[inner] = bag.letters
        self.count = vocab.count
        self.hits = self._look_up(vocab)

    def _look_up(self, vocab: Pieces) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: (words, pieces, bounds); entries bounds[t] to bounds[t + 1] are the pieces that start at t."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        begin = np.arange(len(self.chars)) - self.at[word]
        left = self.size[word] - begin
        spots, hasher, hits = np.arange(len(self.chars)), SpanHasher(self.chars), {}
        longest = int(self.size.max(initial=0))
        for n, (slots, piece_of) in vocab.tables.items():
            # Only where a piece's beginning was found can a longer one be.
            spots = spots[left[spots] >= n]
            entry = slots.find(hasher.of(spots, spots + n))
            spots, piece = spots[entry > 0], piece_of[entry[entry > 0]]
            real = np.flatnonzero(piece < vocab.count)
            at, piece = spots[real], piece[real]
            order = np.argsort(begin[at], kind="stable")
            at, piece = at[order], piece[order]
            hits[n] = word[at], piece, np.searchsorted(begin[at], np.arange(longest + 2))
        return hits

    @property
    def found(self) -> dict[int, np.ndarray]:
        """For each length, the piece that starts at each character, or the one past the last."""
        out = {}
        for n, (word, piece, bounds) in self.hits.items():
            out[n] = np.full(len(self.chars), self.count, np.int64)
            out[n][self.at[word] + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = piece
        return out

    def forward(self, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Probabilities of all prefixes by position, and of all words; ``table`` has a last row of zeros."""
        words, groups = len(self.size), table.shape[1]
        reach = [np.ones((words, groups))]
        total = np.ones((words, groups))
        for t in range(1, int(self.size.max(initial=0)) + 1):
            running = int(np.searchsorted(-self.size, -t, "right"))
            now = reach[t - 1][:running] * FLOOR  # an unknown character
            for n, (word, piece, bounds) in self.hits.items():
                if n > t:
                    break
                own = slice(bounds[t - n], bounds[t - n + 1])
                now[word[own]] += reach[t - n][word[own]] * table[piece[own]]
            reach.append(now)
            ended = int(np.searchsorted(-self.size, -t, "left"))
            total[ended:running] = now[ended:running]
        return reach, total

    def expected(self, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of times each piece is used; weights are the words' counts by group."""
        reach, total = self.forward(table)
        words, groups = total.shape
        longest = int(self.size.max(initial=0))
        weights = weights / total
        shares = {n: np.zeros((len(word), groups)) for n, (word, _, _) in self.hits.items()}
        # after[t] is the probability of what follows position t of each word that reaches it.
        after: list[np.ndarray] = [np.zeros((0, groups))] * (longest + 1)
        for t in range(longest, -1, -1):
            running = int(np.searchsorted(-self.size, -t, "right")) if t else words
            going = int(np.searchsorted(-self.size, -t, "left")) if t else words
            after[t] = now = np.ones((running, groups))
            if t + 1 <= longest:
                now[:going] = after[t + 1][:going] * FLOOR
            for n, (word, piece, bounds) in self.hits.items():
                if t + n > longest:
                    break
                own = slice(bounds[t], bounds[t + 1])
                rows = word[own]
                flow = table[piece[own]] * after[t + n][rows]
                now[rows] += flow
                shares[n][own] = reach[t][rows] * flow * weights[rows]
        gain = np.zeros(table.shape)
        for n, (_, piece, _) in self.hits.items():
            gain += _summed(piece, shares[n], table.shape)
        return gain

    def spread(self, weights: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """What each piece gets if a word's weight goes in equal parts to its characters, and to all pieces at each."""
        weights, gain = weights / self.size[:, None], np.zeros(shape)
        for word, piece, _ in self.hits.values():
            gain += _summed(piece, weights[word], shape)
        return gain


def _summed(rows: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of the values by row."""
    at = rows[:, None] * shape[1] + np.arange(shape[1])
    return np.bincount(at.ravel(), values.ravel(), shape[0] * shape[1]).reshape(shape)


class Words(Lattice):
    """The distinct words of some texts, and which text has which word how often."""

    def __init__(self, vocab: Pieces, texts: list[str]) -> None:
        bag, self.doc, inverse = bag_of(vocab, texts)
        super().__init__(vocab, bag)
        self.inverse, self.texts = self.rank[inverse], len(texts)


def _runs(bag: Bag) -> Iterator[np.ndarray]:
    """Places of at most WORDS_AT_ONCE words of like length at a time."""
    order = np.argsort(-bag.sizes, kind="stable")
    for at in range(0, len(order), WORDS_AT_ONCE):
        yield order[at : at + WORDS_AT_ONCE]


class Tally:
    """Words of many texts with their counts by language; ``use`` gets them when there are MOST_WORDS, and at the end."""

    def __init__(self, use: Callable[[Bag, np.ndarray], None]) -> None:
        self._use = use
        self._parts: list[tuple[Bag, np.ndarray]] = []
        self._held = 0

    def add(self, bag: Bag, counts: np.ndarray) -> None:
        self._parts.append((bag, counts))
        self._held += len(bag.sizes)
        if self._held > MOST_WORDS:
            self._merge()
            # Merging again with every text would cost more than it saves.
            if self._held > MOST_WORDS // 2:
                self.end()

    def _merge(self) -> None:
        bags = [bag for bag, _ in self._parts]
        whole = Bag(*(np.concatenate([getattr(b, k) for b in bags]) for k in ("hashes", "sizes", "letters")))
        first, inverse = np.unique(whole.hashes, return_index=True, return_inverse=True)[1:]
        counts = np.concatenate([c for _, c in self._parts])
        self._parts = [(whole.only(first), _summed(inverse, counts, (len(first), counts.shape[1])))]
        self._held = len(first)

    def end(self) -> None:
        if self._held:
            self._merge()
            self._use(*self._parts[0])
        self._parts, self._held = [], 0


class Scored:
    """The logarithms of words' probabilities, kept for at most MOST_WORDS words besides those of the last texts."""

    def __init__(self, vocab: Pieces, table: np.ndarray) -> None:
        self._vocab, self._table = vocab, table
        self._hashes, self._logs = np.zeros(0, np.uint64), np.zeros((0, table.shape[1]))

    def of(self, bag: Bag) -> np.ndarray:
        at = np.searchsorted(self._hashes, bag.hashes)
        known = np.zeros(len(at), bool)
        inside = at < len(self._hashes)
        known[inside] = self._hashes[at[inside]] == bag.hashes[inside]
        logs = np.zeros((len(at), self._table.shape[1]))
        logs[known] = self._logs[at[known]]
        new = np.flatnonzero(~known)
        fresh = bag.only(new)
        for run in _runs(fresh):
            lattice = Lattice(self._vocab, fresh.only(run))
            logs[new[run]] = np.log(lattice.forward(self._table)[1])[lattice.rank]
        if len(self._hashes) + len(new) > MOST_WORDS:
            self._hashes, self._logs = bag.hashes, logs
        elif len(new):
            self._hashes = np.insert(self._hashes, at[new], fresh.hashes)
            self._logs = np.insert(self._logs, at[new], logs[new], axis=0)
        return logs


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about BLOCK_CHARS characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


def _counts(documents: DataFrame, model: str, tables: np.ndarray | None, names: list[str]) -> dict[str, np.ndarray]:
    """Piece counts by language over all texts, from each task's own sums.

    Without a table every piece that occurs counts, weighted so that all segmentations of a few pieces share a word;
    with one, each counts as often as it is expected to be used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        vocab = pieces(model)
        sums = np.zeros((vocab.count + 1, len(names)))
        place = {name: k for k, name in enumerate(names)}

        def use(bag: Bag, counts: np.ndarray) -> None:
            nonlocal sums
            for run in _runs(bag):
                words = Lattice(vocab, bag.only(run))
                weights = np.empty((len(run), len(names)))
                weights[words.rank] = counts[run]
                sums += words.spread(weights, sums.shape) if tables is None else words.expected(tables, weights)

        tally = Tally(use)
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
            for at, texts in _blocks(batch.column(0).to_pylist()):
                bag, doc, inverse = bag_of(vocab, texts)
                own = inverse * len(names) + langs[at : at + len(texts)][doc]
                tally.add(bag, np.bincount(own, minlength=len(bag.sizes) * len(names)).reshape(-1, len(names)))
        tally.end()
        for name, k in place.items():
            used = np.flatnonzero(sums[:-1, k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(sums[used, k])],
                names=["lang", "piece", "n"],
            )

    summed = documents.mapInArrow(run, "lang string, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    # At most languages x vocabulary rows.
    table = summed.toArrow()
    out = {}
    for name in names:
        own = table.filter(pc.equal(table.column("lang"), name))
        out[name] = (own.column("piece").to_numpy(), own.column("n").to_numpy())
    return out


def _probabilities(counts: dict, names: list[str], size: int) -> np.ndarray:
    """Smoothed piece probabilities by language, with a row of zeros for no piece."""
    table = np.full((size + 1, len(names)), 0.0)
    for k, name in enumerate(names):
        index, n = counts[name]
        table[index, k] = n
    table[:-1] += 0.01
    table /= table.sum(axis=0)
    table[-1] = 0
    return table


def train(
    documents: DataFrame, model: str, rounds: int = 1, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities) from all rows with a text and a language.

    A first pass counts pieces, ``rounds`` further ones re-estimate them by expectation and maximisation.  What reaches
    the driver is bounded by languages x vocabulary, whatever the input.
    """
    bounded_batches(documents.sparkSession)
    rows = documents.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    names = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    size = pieces(model).count
    if not names:
        return names, np.zeros((size + 1, 0))
    table = _probabilities(_counts(rows, model, None, names), names, size)
    for _ in range(rounds):
        table = _probabilities(_counts(rows, model, table, names), names, size)
    return names, table


def identify(
    documents: DataFrame,
    languages: list[str],
    table: np.ndarray,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: (id_col, *keep, lang_pred, score).

    score is the posterior probability of the language, all being equally likely beforehand.  Texts that are null or
    hold no letter, and all texts if no language was learned, get ``und`` and 0.  Ties go to the first language in
    alphabetical order.  Rows are independent: repeated rows and null ids are returned as they come.
    """
    bounded_batches(documents.sparkSession)
    picked = documents.select(
        F.col(text_col).alias("__text"), F.col(id_col).alias("__id"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("langid")
        vocab = pieces(model)
        scored = Scored(vocab, table)
        for batch in batches:
            found, sure = [], []
            for _, texts in _blocks([t or "" for t in batch.column(0).to_pylist()]):
                bag, doc, inverse = bag_of(vocab, texts)
                logs = np.zeros((len(texts), len(languages)))
                if len(bag.sizes) and languages:
                    each = scored.of(bag)
                    for g in range(len(languages)):
                        logs[:, g] = np.bincount(doc, each[inverse, g], len(texts))
                some = np.bincount(doc, minlength=len(texts)) > 0
                if not languages:
                    found += [UNKNOWN] * len(texts)
                    sure += [0.0] * len(texts)
                    continue
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                found += [languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                sure += np.where(some, share, 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(found, pa.string()), pa.array(sure, pa.float64())],
                names=[*batch.schema.names[1:], "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    out = picked.mapInArrow(run, f"{kinds}, lang_pred string, score double")
    names = [F.col("__id").alias(id_col), *[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)]]
    return out.select(*names, "lang_pred", "score")
