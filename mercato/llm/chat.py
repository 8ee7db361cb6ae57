"""Chat formatting at token level.

Every segment (a turn's text, a foreign role's name) is encoded on its own, and reserved ids above the
vocabulary are spliced in as marks, so no content can make a mark. As text, marks are control strings;
inside content they are escaped with a backslash, reversibly. The loss mask comes from a prefix sum:
plus one after an assistant mark, minus one at the end of the turn.

    ### User: question</turn>
    ### Assistant: answer</turn>
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.bpe import encoded, encoder

TOKENIZER = "byte_bpe_50k.json"
#: reserved ids from here on; the vocabulary ends below
FIRST_RESERVED = 50_257
MARKS = ("### System: ", "### User: ", "### Assistant: ", "### Role: ", "</role>", "</turn>\n")
ROLES = {"system": FIRST_RESERVED, "user": FIRST_RESERVED + 1, "assistant": FIRST_RESERVED + 2}
ROLE, ROLE_END, TURN_END = FIRST_RESERVED + 3, FIRST_RESERVED + 4, FIRST_RESERVED + 5
ASSISTANT = ROLES["assistant"]


def escape(text: str) -> str:
    """No control string is left: backslashes are doubled, and one comes before each # after two others
    and before the slash of an end mark."""
    text = text.replace("\\", "\\\\")
    text = re.sub(r"(?<=##)#", r"\\#", text)
    return re.sub(r"<(?=/(?:turn|role)>)", r"<\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def loss_mask(ids: np.ndarray) -> np.ndarray:
    """1 on the content of assistant turns, by a prefix sum over the marks of whole turns."""
    step = np.zeros(len(ids) + 1, np.int64)
    turn = np.cumsum(np.isin(ids, (*ROLES.values(), ROLE)))  # number of the turn
    own = np.zeros(int(turn[-1]) + 1 if len(turn) else 1, bool)
    own[turn[ids == ASSISTANT]] = True
    step[1:][ids == ASSISTANT] = 1
    ends = np.flatnonzero(ids == TURN_END)
    step[ends[own[turn[ends]]]] -= 1
    return np.cumsum(step[:-1])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv: object = batches  # no conversation yet
    seq = 0
    for batch in batches:
        conv_ids, roles = batch.column("conv_id").to_pylist(), batch.column("role").to_pylist()
        body, role_ids = batch.column("body"), batch.column("role_ids")
        parts, seqs, sizes = [], [], []
        for i, (c, role) in enumerate(zip(conv_ids, roles)):
            seq, conv = (seq + 1, c) if c == conv and conv is not batches else (0, c)
            mark = [ROLES[role]] if role in ROLES else [ROLE, *role_ids[i].as_py(), ROLE_END]
            turn = np.concatenate([np.array(mark, np.int32), body[i].values.to_numpy(zero_copy_only=False), np.array([TURN_END], np.int32)])
            parts.append(turn)
            seqs.append(seq)
            sizes.append(len(turn))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
        mask = loss_mask(ids).astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(seqs, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))),
             pa.ListArray.from_arrays(at, pa.array(mask))],
            names=["conv_id", "seq", "ids", "loss_mask"],
        )


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Format ``conversations`` (conv_id, turn, role, text; a row per turn).

    Returns a row per turn: conv_id, seq (from 0, by turn, role and text), ids and loss_mask; the
    turns of a conversation, by seq, are its formatted token stream. A conversation's rows come one
    after another in one partition; they are streamed in batches, so a long conversation needs no
    more memory than a short one. Null texts and roles are empty; rows of null conv_id are one
    conversation; repeated rows are turns of their own; a role other than system, user and assistant
    is written out. An empty table gives no rows. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([escape(x or "") for x in batch.column("text").to_pylist()], pa.large_string())
            names = pa.array(["" if x in ROLES else escape(x or "") for x in batch.column("role").to_pylist()], pa.large_string())
            lists = [
                pa.array([x.astype(np.int32) for x in encoded(column, tokenizer, plain=True)], pa.list_(pa.int32()))
                for column in (texts, names)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "body", "role_ids"])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    segments = rows.mapInArrow(encode, "conv_id long, turn long, role string, text string, body array<int>, role_ids array<int>")
    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "body", "role_ids").mapInArrow(
        _assemble, "conv_id long, seq long, ids array<int>, loss_mask array<tinyint>"
    )


def read_back(formatted: DataFrame, tokenizer: str = TOKENIZER, ordered: bool = False) -> DataFrame:
    """Read conversations back from :func:`format_chats`'s ids and masks alone, as digests.

    Returns per conversation: conv_id, n_turns, turns_sha256 (over role, line feed, text, line feed
    per turn), loss_chars and loss_sha256 (of the unescaped text under the mask), formatted_chars.
    The digests take the turns in order, as they stream by; a table that lost :func:`format_chats`'s
    order (by conv_id and seq in a partition) is dealt out and sorted; ``ordered`` says that it has it still. A null conv_id is one
    conversation; an empty table gives no rows; other columns are ignored.
    """
    role_of = {i: name for name, i in ROLES.items()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        decode = encoder(tokenizer, plain=True).tokenizer.decode_batch
        state: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            out = []
            turns = []
            for ids, mask in zip(batch.column("ids").to_pylist(), batch.column("loss_mask").to_pylist()):
                end = ids.index(ROLE_END) if ids[0] == ROLE else 0
                turns.append((ids[0], ids[1:end], ids[end + 1 : -1], [i for i, m in zip(ids, mask) if m]))
            texts = decode([part for turn in turns for part in turn[1:]], skip_special_tokens=False)
            for k, (conv, turn) in enumerate(zip(batch.column("conv_id").to_pylist(), turns)):
                name, body, lost = texts[3 * k : 3 * k + 3]
                if state is None or state[0] != conv:
                    out += [row(state)] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, lost = role_of.get(turn[0], unescape(name)), unescape(lost)
                state[1] += 1
                state[2].update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                state[3] += len(lost)
                state[4].update(lost.encode("utf-8", "surrogatepass"))
                marks = [turn[0], TURN_END] + [ROLE_END] * (turn[0] == ROLE)
                state[5] += len(name) + len(body) + sum(len(MARKS[i - FIRST_RESERVED]) for i in marks)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(state), kinds)], names=names)

    rows = formatted.select("conv_id", "seq", "ids", "loss_mask")
    if not ordered:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
