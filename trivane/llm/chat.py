"""Chat formatting at the level of token ids.

Every text is encoded on its own and reserved ids are spliced between the segments, so no text can produce a control
id.  Control strings inside texts are escaped as well, so that the format is safe when it is written as plain text.
The loss mask comes from prefix sums over +1 and -1 at the borders of assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.text import KEPT, alone, bounded_batches

# The control strings of the template, in the order of their reserved ids.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, INST_END, ROLE, ROLE_END = range(6)
ASSISTANT, USER = "assistant", "user"

# A control string with any number of backslashes after its first character: one more is put in, one is taken out.
_ESCAPE = re.compile(r"([<\[])(\\*)(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\])")
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(s>|/s>|INST\]|/INST\]|ROLE\]|/ROLE\])")


def escaped(text: str) -> str:
    """The text without any control string; ``unescaped`` gives the text back."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


@dataclass(frozen=True)
class Ranks:
    """A byte-level vocabulary file of token ranks and the pattern that splits texts for it."""

    path: str
    pattern: str


_LOADED: dict[Ranks, object] = {}
KEPT["chat"] = _LOADED.clear


def encoding(ranks: Ranks):
    """The worker's encoder, loaded once."""
    if ranks not in _LOADED:
        import base64

        import tiktoken

        with open(ranks.path, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _LOADED[ranks] = tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=table, special_tokens={})
    return _LOADED[ranks]


def _reserved(tool) -> list[int]:
    """Ids past the vocabulary, one per control string."""
    top = tool.max_token_value + 1
    return list(range(top, top + len(CONTROL)))


def _segments(role: str, text: str) -> tuple[list, list[bool]]:
    """A turn as reserved numbers and texts, and which parts carry loss."""
    if role == USER:
        return [INST, text, INST_END], [False, False, False]
    if role == ASSISTANT:
        return [text, EOS], [True, False]
    return [ROLE, role, ROLE_END, text, EOS], [False, False, False, False, False]


def turn_tokens(tool, role: str, text: str, first: bool) -> tuple[list[int], list[int]]:
    """Ids of one turn, and its loss mask as the prefix sums of +1 and -1 at the borders of its loss spans."""
    control = _reserved(tool)
    parts, loss = _segments(role, text)
    if first:
        parts, loss = [BOS, *parts], [False, *loss]
    ids: list[int] = []
    marks = []
    for part, counts in zip(parts, loss, strict=True):
        begin = len(ids)
        ids += [control[part]] if isinstance(part, int) else tool.encode_ordinary(escaped(part))
        if counts:
            marks.append((begin, len(ids)))
    change = np.zeros(len(ids) + 1, np.int64)
    for begin, end in marks:
        change[begin] += 1
        change[end] -= 1
    return ids, np.cumsum(change)[:-1].tolist()


def read_turn(tool, ids: list[int], mask: list[int]) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, length as formatted) of one turn, from its ids and mask alone."""
    control = {value: k for k, value in enumerate(_reserved(tool))}
    spans: list[tuple[int | None, list[int]]] = []
    for i in ids:
        if i in control:
            spans.append((control[i], []))
        elif spans and spans[-1][0] is None:
            spans[-1][1].append(i)
        else:
            spans.append((None, [i]))
    spell = lambda own: tool.decode_bytes(own).decode("utf-8")
    length = sum(len(CONTROL[k]) if k is not None else len(spell(own)) for k, own in spans)
    if spans and spans[0][0] == BOS:
        spans = spans[1:]
    kinds = [k for k, _ in spans]
    body = lambda own: unescaped(spell(own))
    if kinds and kinds[0] == INST:
        role, text = USER, "".join(body(own) for k, own in spans if k is None)
    elif kinds and kinds[0] == ROLE:
        cut = kinds.index(ROLE_END)
        role = "".join(body(own) for k, own in spans[:cut] if k is None)
        text = "".join(body(own) for k, own in spans[cut:] if k is None)
    else:
        role, text = ASSISTANT, "".join(body(own) for k, own in spans if k is None)
    learned = unescaped(spell([i for i, m in zip(ids, mask, strict=True) if m]))
    return role, text, learned, length


def format_chats(
    turns: DataFrame,
    ranks: Ranks,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per turn: (conv, turn, role, text order keys, start, ids, mask) in the order of the conversation.

    A conversation's token sequence is the ids of its turns one after another; ``start`` is where a turn begins in it,
    the prefix sum of the lengths before.  Rows of a conversation are ordered by turn, then role and text, nulls
    first, so ties and repeated rows have one order.  Null roles and texts are empty, a null conversation id is a
    conversation of its own.  Other columns are ignored.

    Encoding needs no order and happens where the rows are.  Then the rows of a conversation stream through one task in
    order; no conversation is held as a whole, however long.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    picked = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    conv, turn = (picked.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoding(ranks)
        for batch in batches:
            found = [
                turn_tokens(tool, r, t, False)
                for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([f[1] for f in found], pa.list_(pa.int8())),
                ],
                names=[*batch.schema.names, "ids", "mask"],
            )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bos = _reserved(encoding(ranks))[BOS]
        now, at = object(), 0
        for batch in batches:
            starts, ids, masks = [], [], []
            for key, own, mask in zip(*(batch.column(k).to_pylist() for k in (0, 4, 5)), strict=True):
                if key != now:
                    now, at = key, 0
                    own, mask = [bos, *own], [0, *mask]
                starts.append(at)
                at += len(own)
                ids.append(own)
                masks.append(mask)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(starts, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(masks, pa.list_(pa.int8())),
                ],
                names=["conv", "turn", "start", "ids", "mask"],
            )

    encoded = picked.mapInArrow(encode, f"conv {conv}, turn {turn}, role string, text string, ids array<int>, mask array<tinyint>")
    ordered = encoded.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInArrow(assemble, f"conv {conv}, turn {turn}, start bigint, ids array<int>, mask array<tinyint>")


def read_chats(formatted: DataFrame, ranks: Ranks, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from formatted turns: digests of its turns and of its text under the mask.

    (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).  The digests are taken as the turns stream
    by in order of ``start``; nothing grows with a conversation.
    """
    conv = formatted.schema["conv"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoding(ranks)
        done: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                key, n, turns, chars, loss, length = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[]] * 6
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)
            done.clear()
            return out

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, ids, mask in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                if state is None or state[0] != key:
                    close()
                    state = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, learned, length = read_turn(tool, ids, mask)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += length
            yield flush()
        if key_type is not None:
            close()
            yield flush()

    ordered = formatted.select("conv", "ids", "mask", "start").repartition("conv").sortWithinPartitions("conv", "start")
    schema = f"conv {conv}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return ordered.mapInArrow(read, schema).withColumnRenamed("conv", conv_col)


NAMES = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
