"""A context-mixing range coder for token ids, run over many blocks at once.

Every block starts from the same state, so blocks can be decoded on their own.  For each id an order-2 and an order-1
context predict one id each; how far both are trusted follows from how often predictions of the same confidence came
true in this block.  What neither predicts is coded by order 0, the id histogram of the group of blocks.  All blocks of
a group advance together, one numpy operation for all of them.

A block has a stream of choices among the orders, and streams of the ids that order 0 tells.  The latter need no model,
so they are cut into runs of ``RUN`` ids that advance together too.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SLOTS = 1 << 13
LEVELS = 8
MIX_BITS = 15
ORDER_0_BITS = 20
RUN = 2048
# Spans lie between BOTTOM and BOTTOM << WORD; less than BOTTOM_BITS are taken between two looks at them.
WORD = 32
BOTTOM_BITS = 31
BOTTOM = 1 << BOTTOM_BITS
# A confidence is below ID, counted in units of 8 for order 2 and of 1 for order 1; the id is kept times ID.
UNITS = (8, 1)
ID = 64
EMPTY = ((1 << 25) - 1) * ID
# Factors of the context hashes, whose upper bits count: the last id for order 2 and 1, and the one before it.
NEAR = (0x9E3779B1, 0x85EBCA6B)
FAR = np.uint32(0xC2B2AE35)
HASH_SHIFT = np.uint32(32 - 13)
# Trials by confidence: (hits of order 2, hits of either, trials) in fields of a number, a trial counting as TRIAL.
FIELD = 21
TRIAL = 32
FIELDS = (1 << FIELD) - 1
# Shares follow the trials every LAG ids; after HALVING ids trials count half.
LAG = 64
HALVING = 4096
# Blocks whose ids are looked through together where all are known.
AT_ONCE = 256


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**ORDER_0_BITS, at least 1 for every id that occurs."""
    total = 1 << ORDER_0_BITS
    used = counts > 0
    room = total - int(used.sum())
    freq = np.where(used, 1 + (counts.astype(np.float64) * room / max(1, counts.sum())).astype(np.int64), 0)
    freq[int(freq.argmax())] += total - int(freq.sum())
    return freq


def _prior() -> np.ndarray:
    """Trials before the first id, by (whether the predictions differ, confidence of order 2, of order 1)."""
    level = np.arange(LEVELS)
    trust = np.where(level > 0, (level + 1) / (LEVELS + 2), 0)
    two, one = trust[:, None], trust[None, :]
    all_ = np.full((2, LEVELS, LEVELS), 8.0)
    hits_2 = np.stack([8 * (1 - (1 - two) * (1 - one)), np.broadcast_to(8 * two, (LEVELS, LEVELS))])
    either = np.broadcast_to(8 * (1 - (1 - two) * (1 - one)), (2, LEVELS, LEVELS))
    parts = [(TRIAL * x).round().astype(np.int64).ravel() for x in (hits_2, either, all_)]
    return (parts[0] << 2 * FIELD) | (parts[1] << FIELD) | parts[2]


PRIOR = _prior()


def _shares(trials: np.ndarray) -> np.ndarray:
    """The ends of the shares of order 2 and of both orders in the mixing interval; order 0 always has some."""
    most = np.float32((1 << MIX_BITS) - 32)
    by = most / (trials & FIELDS).astype(np.float32)
    out = np.empty((len(trials), 2), np.uint64)
    out[:, 0] = (trials >> 2 * FIELD).astype(np.float32) * by
    out[:, 1] = ((trials >> FIELD) & FIELDS).astype(np.float32) * by
    return out


class _Trust:
    """How far each block trusts predictions of each confidence; ``rows`` are confidences of its part of the arrays."""

    def __init__(self, lanes: int) -> None:
        self.trials = np.tile(PRIOR, lanes)
        self.rows = np.arange(lanes, dtype=np.int32) * np.int32(len(PRIOR))
        # Pairs of shares are moved as one number of 16 bytes.
        self.shares = np.tile(_shares(PRIOR), (lanes, 1)).view(np.complex128).ravel()

    def learn(self, rows: np.ndarray, past_2: np.ndarray, past: np.ndarray) -> None:
        """Count ids that were of these confidences, whether they were not order 2's, and neither's."""
        rows = rows.ravel().astype(np.int64)
        tried = np.full(len(rows), TRIAL)
        tried += np.multiply(~past_2.ravel(), TRIAL << 2 * FIELD)
        tried += np.multiply(~past.ravel(), TRIAL << FIELD)
        np.add.at(self.trials, rows, tried)
        changed = np.zeros(len(self.trials), bool)
        changed[rows] = True
        rows = np.flatnonzero(changed)
        self.shares[rows] = _shares(self.trials[rows]).view(np.complex128).ravel()

    def halve(self) -> None:
        """Let the trials up to now count half."""
        low = (FIELDS >> 1) * ((1 << 2 * FIELD) | (1 << FIELD) | 1)
        trials = self.trials.reshape(-1, len(PRIOR))
        trials[:] = PRIOR + (((trials - PRIOR) >> 1) & low)


def _chains(slot: np.ndarray, ids: np.ndarray, unit: int) -> np.ndarray:
    """What each id of each block found in its slot: the ids that meet in a slot follow one another.

    The first ids of all slots are taken at once, then the second ones, and so on.
    """
    unit = np.int32(unit)
    top = unit * np.int32(LEVELS - 1)
    order = np.argsort(slot, axis=1, kind="stable")
    order += np.arange(len(slot))[:, None] * slot.shape[1]
    order = order.ravel()
    met, told = slot.ravel()[order], ids.ravel()[order]
    begins = np.ones(slot.shape, bool)
    np.not_equal(met[1:], met[:-1], out=begins.ravel()[1:])
    begins[:, 0] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(order)))
    longest = int(sizes.max(initial=0))
    left = len(sizes) - np.cumsum(np.bincount(sizes, minlength=1))
    starts = starts[np.argsort((longest - sizes).astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")]
    entries = np.full(len(starts), EMPTY, np.int32)
    found = np.empty(len(order), np.int32)
    for place in range(longest):
        here = starts[: left[place]] + place
        entry, now = entries[: len(here)], told[here]
        found[here] = entry
        level = entry & top
        hit = entry - level == now
        now |= unit
        raised = np.minimum(entry + unit, entry | top)
        entry -= unit
        np.copyto(entry, now, where=level < 2 * unit)
        np.copyto(entry, raised, where=hit)
    out = np.empty(len(order), np.int32)
    out[order] = found
    return out.reshape(slot.shape)


def _foreseen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_Model`` comes to for each id of each block: its confidence, and whether it is past order 2, and past both.

    All ids are known here, so slots need not be kept; columns are blocks.
    """
    lanes, length = ids.shape
    rows = np.empty((length, lanes), np.int32)
    past_2, past = np.empty((length, lanes), bool), np.empty((length, lanes), bool)
    for first in range(0, lanes, AT_ONCE):
        here = slice(first, first + AT_ONCE)
        now = ids[here].astype(np.int32) * np.int32(ID)
        near = np.zeros(now.shape, np.uint32)
        near[:, 1:] = now[:, :-1]
        hash_2, hash_1 = near * np.uint32(NEAR[0]), near * np.uint32(NEAR[1])
        hash_2[:, 1:] += near[:, :-1] * FAR
        two, one = (_chains((h >> HASH_SHIFT).astype(np.uint16), now, u) for h, u in zip((hash_2, hash_1), UNITS, strict=True))
        level_2, level_1 = two & np.int32(ID - 1), one & np.int32(ID - 1)
        two -= level_2
        one -= level_1
        rows[:, here] = (np.minimum(two ^ one, ID) + level_2 + level_1).T
        not_2 = two != now
        past_2[:, here] = not_2.T
        past[:, here] = (not_2 & (one != now)).T
    return rows, past_2, past


class _Model:
    """Predictions of all blocks of a group, and how far to trust them.

    Arrays hold order 2 of all blocks, then order 1.  A slot holds the predicted id and its confidence in one number.
    Arrays are kept and written in place, and ids are times ID, since calls cost more than the arithmetic.
    """

    def __init__(self, lanes: int) -> None:
        def each(pair: tuple[int, int], kind: type = np.int32) -> np.ndarray:
            return np.repeat(np.array(pair, kind), lanes)

        both = 2 * lanes
        self.lanes = lanes
        self.base = np.arange(both, dtype=np.uint32) * np.uint32(SLOTS)
        self.slots = np.full(both * SLOTS, EMPTY, np.int32)
        self.unit, self.factor = each(UNITS), each(NEAR, np.uint32)
        self.top, self.low = self.unit * np.int32(LEVELS - 1), self.unit * np.int32(2)
        self.trust = _Trust(lanes)
        self.rows, self.shares = self.trust.rows, self.trust.shares
        self.pair = np.empty(lanes, np.complex128)
        self.share = self.pair.view(U).reshape(lanes, 2).T
        self.hash, self.at = np.empty(both, np.uint32), np.empty(both, np.int64)
        self.entry, self.level, self.guess, self.down, self.fresh = (np.empty(both, np.int32) for _ in range(5))
        self.hit, self.weak = np.empty(both, bool), np.empty(both, bool)
        self.near, self.far = np.zeros(both, np.uint32), np.zeros(lanes, np.uint32)
        self.id = self.near.view(np.int32)
        self.guess_2, self.guess_1 = self.guess[:lanes], self.guess[lanes:]
        self.level_2, self.level_1 = self.level[:lanes], self.level[lanes:]
        self.hash_2, self.near_2, self.ids = self.hash[:lanes], self.near[:lanes], self.id.reshape(2, lanes)
        # Of the last LAG ids: the confidence, and whether they were not order 2's, and neither's.
        self.seen = np.empty((LAG, lanes), np.int32)
        self.past_2, self.past = np.empty((LAG, lanes), bool), np.empty((LAG, lanes), bool)
        self.step = 0

    def predict(self) -> None:
        """Set the predicted ids and the ends of the shares of the mixing interval."""
        np.multiply(self.near, self.factor, out=self.hash)
        self.hash_2 += self.far
        self.hash >>= HASH_SHIFT
        self.hash += self.base
        np.copyto(self.at, self.hash)
        np.take(self.slots, self.at, out=self.entry, mode="clip")
        np.bitwise_and(self.entry, self.top, out=self.level)
        np.subtract(self.entry, self.level, out=self.guess)
        row = self.seen[self.step]
        np.bitwise_xor(self.guess_2, self.guess_1, out=row)
        np.minimum(row, ID, out=row)
        row += self.level_2
        row += self.level_1
        row += self.rows
        np.take(self.shares, row, out=self.pair, mode="clip")

    def learn(self, ids: np.ndarray) -> None:
        """Take the id, once its outcome is noted in ``past_2`` and ``past``."""
        entry, down = self.entry, self.down
        np.multiply(self.near_2, FAR, out=self.far)
        np.copyto(self.ids, ids)
        # A hit raises the confidence up to the top; a miss lowers it, or puts the new id into a weak slot.
        np.equal(self.guess, self.id, out=self.hit)
        np.less(self.level, self.low, out=self.weak)
        np.subtract(entry, self.unit, out=down)
        np.bitwise_or(self.id, self.unit, out=self.fresh)
        np.copyto(down, self.fresh, where=self.weak)
        np.bitwise_or(entry, self.top, out=self.level)
        entry += self.unit
        np.minimum(entry, self.level, out=entry)
        np.copyto(down, entry, where=self.hit)
        self.slots[self.at] = down
        self.step += 1
        if self.step % LAG == 0:
            self.trust.learn(self.seen, self.past_2, self.past)
            self.step = 0


class _Writer:
    """Streams of words that grow together.  Carries are kept in the words until the end."""

    def __init__(self, lanes: int, room: int) -> None:
        self.low, self.span = np.zeros(lanes, U), np.full(lanes, BOTTOM << WORD, U)
        self.part, self.need = np.empty(lanes, U), np.empty(lanes, bool)
        self.used = np.zeros(lanes, np.int64)
        self.words, self.most = np.zeros((lanes, room), U), 0

    def put(self, begin: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Go into a part of each span, of a whole of 2**bits."""
        self.span >>= U(bits)
        np.multiply(self.span, begin, out=self.part)
        self.low += self.part
        self.span *= width

    def settle(self) -> None:
        """Shift out a word where a span is narrow."""
        low, span = self.low, self.span
        np.less(span, U(BOTTOM), out=self.need)
        k = np.flatnonzero(self.need)
        if not len(k):
            return
        if self.most == self.words.shape[1]:
            self.most = int(self.used.max())
            if self.most == self.words.shape[1]:
                self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        here = low[k]
        self.words[k, self.used[k]] = here >> U(BOTTOM_BITS)
        self.used[k] += 1
        low[k] = (here & U(BOTTOM - 1)) << U(WORD)
        span[k] <<= U(WORD)
        self.most += 1

    def streams(self) -> list[bytes]:
        """The bytes of each stream, which tell a number within the span; zeros follow."""
        words = np.concatenate([self.words[:, : int(self.used.max(initial=0))], np.zeros((len(self.used), 1), U)], axis=1)
        # Where there is room, the last word has two bytes of zeros.
        bits = np.where(self.span >= U(1 << BOTTOM_BITS + 16), U(BOTTOM_BITS + 16), U(BOTTOM_BITS))
        last = ((self.low + ((U(1) << bits) - U(1))) >> bits) << (bits - U(BOTTOM_BITS))
        words[np.arange(len(words)), self.used] = last
        while (carry := words >> U(WORD)).any():
            words &= U((1 << WORD) - 1)
            words[:, :-1] += carry[:, 1:]
        words = words.astype(">u4")
        return [words[i, : n + 1].tobytes().rstrip(b"\0") for i, n in enumerate(self.used.tolist())]


class _Reader:
    """The reverse of ``_Writer``; ``code`` is how far the number is from the begin of the span."""

    def __init__(self, streams: list[bytes]) -> None:
        lanes = len(streams)
        room = max(map(len, streams), default=0) // 4 + 4
        words = np.frombuffer(b"".join(s.ljust(4 * room, b"\0") for s in streams), ">u4").astype(U).reshape(lanes, room)
        self.span = np.full(lanes, BOTTOM << WORD, U)
        self.code = (words[:, 0] << U(BOTTOM_BITS)) | (words[:, 1] >> U(WORD - BOTTOM_BITS))
        # A span has a bit less than two words, so all later words begin a bit late.
        words[:, :-1] = ((words[:, :-1] << U(BOTTOM_BITS)) & U((1 << WORD) - 1)) | (words[:, 1:] >> U(WORD - BOTTOM_BITS))
        self.words = words.ravel()
        self.next = np.arange(lanes) * room + 1
        self.need = np.empty(lanes, bool)

    def settle(self) -> None:
        np.less(self.span, U(BOTTOM), out=self.need)
        k = np.flatnonzero(self.need)
        if len(k):
            at = self.next[k]
            self.code[k] = (self.code[k] << U(WORD)) | self.words.take(at, mode="clip")
            self.next[k] = at + 1
            self.span[k] <<= U(WORD)


def _order_0(freq: np.ndarray) -> np.ndarray:
    """Begin and width of every id; the entry after the last one is the whole, for what is past a stream's end."""
    begin = np.append(np.cumsum(freq) - freq, 0).astype(U)
    return (begin << U(32)) | np.append(freq, 1 << ORDER_0_BITS).astype(U)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block of each run, ids in it) for blocks of so many ids told by order 0."""
    runs = -(-counts // RUN)
    block = np.repeat(np.arange(len(counts)), runs)
    place = np.arange(len(block)) - np.repeat(np.cumsum(runs) - runs, runs)
    return block, np.minimum(RUN, counts[block] - place * RUN)


def encode(ids: np.ndarray, freq: np.ndarray) -> list[bytes]:
    """The coded bytes of each row of ``ids``."""
    lanes, length = ids.shape
    rows, past_2, past = _foreseen(ids)
    trust, choices = _Trust(lanes), _Writer(lanes, length // 16 + 16)
    rows += trust.rows
    for first in range(0, length, LAG):
        here = slice(first, first + LAG)
        not_2, neither = past_2[here], past[here]
        share = trust.shares.take(rows[here]).view(U).reshape(-1, lanes, 2)
        begin = np.where(neither, share[:, :, 1], np.where(not_2, share[:, :, 0], U(0)))
        width = np.where(neither, U(1 << MIX_BITS), np.where(not_2, share[:, :, 1], share[:, :, 0])) - begin
        for t in range(len(begin)):
            choices.put(begin[t], width[t], MIX_BITS)
            if t & 1 or t == len(begin) - 1:
                choices.settle()
        if len(begin) == LAG:
            trust.learn(rows[here], not_2, neither)
        if (first + LAG) % HALVING == 0:
            trust.halve()
    chosen = choices.streams()
    del rows, past_2, trust, choices
    told = ids[past.T]
    counts = past.sum(axis=0)
    block, sizes = _runs(counts)
    columns = np.full((RUN if len(sizes) else 0, len(sizes)), len(freq), np.int64)
    columns.T[np.arange(RUN) < sizes[:, None]] = told
    columns = columns[: sizes.max(initial=0)]
    order_0 = _Writer(len(sizes), RUN * ORDER_0_BITS // WORD + 16)
    parts = _order_0(freq)
    for column in columns:
        part = parts.take(column)
        order_0.put(part >> U(32), part & U((1 << 32) - 1), ORDER_0_BITS)
        order_0.settle()
    runs: list[list[bytes]] = [[] for _ in range(lanes)]
    for i, stream in zip(block.tolist(), order_0.streams(), strict=True):
        runs[i].append(stream)
    return [
        np.array([n], "<u4").tobytes() + np.array([len(s) for s in run], "<u2").tobytes() + b"".join(run) + choice
        for n, run, choice in zip(counts.tolist(), runs, chosen, strict=True)
    ]


def _told(streams: list[bytes], sizes: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The ids of all runs, one after another."""
    reader, steps = _Reader(streams), int(sizes.max(initial=0))
    code, span = reader.code, reader.span
    parts = _order_0(freq)
    of_value = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) < 1 << 16 else np.int32), freq)
    found = np.empty((steps, len(sizes)), np.int32)
    shortest = int(sizes.min(initial=RUN))
    value, part = np.empty(len(sizes), U), np.empty(len(sizes), U)
    for t in range(steps):
        span >>= U(ORDER_0_BITS)
        np.floor_divide(code, span, out=value)
        np.minimum(value, U((1 << ORDER_0_BITS) - 1), out=value)
        ids = of_value.take(value.view(np.int64))
        found[t] = ids
        if t >= shortest:
            ids = np.where(sizes > t, ids, len(freq))
        np.take(parts, ids, out=part, mode="clip")
        np.right_shift(part, U(32), out=value)
        value *= span
        code -= value
        part &= U((1 << 32) - 1)
        span *= part
        reader.settle()
    return found.T[np.arange(steps) < sizes[:, None]]


def decode(coded: list[bytes], length: int, freq: np.ndarray) -> np.ndarray:
    """The ids of each block, the reverse of ``encode``; ValueError if a block can't be one."""
    lanes = len(coded)
    if any(len(c) < 4 for c in coded):
        raise ValueError("a block is damaged")
    counts = np.array([int.from_bytes(c[:4], "little") for c in coded])
    if (counts > length).any():
        raise ValueError("a block is damaged")
    sizes = _runs(counts)[1]
    streams, chosen = [], []
    for c, n in zip(coded, (-(-counts // RUN)).tolist(), strict=True):
        at = 4 + 2 * n
        if len(c) < at or len(c) < at + sum(lengths := np.frombuffer(c, "<u2", n, 4).tolist()):
            raise ValueError("a block is damaged")
        for size in lengths:
            streams.append(c[at : at + size])
            at += size
        chosen.append(c[at:])
    # Ids told by order 0, block after block, and where the next one of each block is; one more for a damaged block.
    told = np.append(_told(streams, sizes, freq), 0).astype(np.int32) * np.int32(ID)
    next_ = np.cumsum(counts) - counts
    model, choices = _Model(lanes), _Reader(chosen)
    code, span, share = choices.code, choices.span, model.share
    ends, begin = np.empty((2, lanes), U), np.empty(lanes, U)
    end_2, end = ends
    known, hit_2 = np.empty(lanes, bool), np.empty(lanes, bool)
    out = np.empty((length, lanes), np.int32)
    for t in range(length):
        now, not_2, neither = out[t], model.past_2[t % LAG], model.past[t % LAG]
        model.predict()
        span >>= U(MIX_BITS)
        np.multiply(share, span, out=ends)
        np.greater_equal(code, end_2, out=not_2)
        np.greater_equal(code, end, out=neither)
        np.logical_not(neither, out=known)
        np.logical_not(not_2, out=hit_2)
        # The begin of the id's share, and its end in the place of the span.
        np.multiply(end_2, not_2, out=begin)
        np.copyto(begin, end, where=neither)
        span <<= U(MIX_BITS)
        np.copyto(span, end, where=known)
        np.copyto(span, end_2, where=hit_2)
        span -= begin
        code -= begin
        if t & 1 or t == length - 1:
            choices.settle()
        np.take(told, next_, out=now, mode="clip")
        next_ += neither
        np.copyto(now, model.guess_1, where=known)
        np.copyto(now, model.guess_2, where=hit_2)
        model.learn(now)
        if (t + 1) % HALVING == 0:
            model.trust.halve()
    out //= ID
    return np.ascontiguousarray(out.T)
