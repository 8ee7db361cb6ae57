"""Token ids of a byte-level BPE tokenizer for Arrow text columns.

Such a tokenizer never joins bytes across a single space that a visible character follows: the space
begins the next token. Texts are cut there, each distinct piece is encoded once by the tokenizer, and
the ids are gathered back; a worker keeps the pieces it has met, up to ``CACHE_PIECES``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

from mercato.llm.textbatch import as_bytes, chunks, span_numbers

CACHE_PIECES = 1_000_000
#: pieces that the tokenizer encodes together: what it returns takes many times the ids' memory
ENCODED_AT_ONCE = 4096
#: bytes after a space that can't begin a white space character (leads of the non-ASCII ones are out)
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
_VISIBLE[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    def __init__(self, name: str, plain: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = plain
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}  # of a piece in at and n
        self.at = np.zeros(0, np.int64)  # of its ids
        self.n = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(pieces), ENCODED_AT_ONCE):
            texts = [p.decode("utf-8", "replace") for p in pieces[i : i + ENCODED_AT_ONCE]]
            some = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts.append(np.fromiter(map(len, some), np.int64, len(some)))
            flat.append(np.fromiter((i for x in some for i in x), np.uint32, int(counts[-1].sum())))
        n, ids = np.concatenate(counts), np.concatenate(flat)
        self.place.update(zip(pieces, range(len(self.n), len(self.n) + len(pieces))))
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``data[at[i]:at[i + 1]]``, end to end, and where each text's ids begin."""
        begins = np.zeros(len(data) + 1, bool)
        begins[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(data))[: len(starts)]
        number, distinct = span_numbers(data, starts, ends)
        pieces = as_bytes(distinct)
        known = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(known < 0)
        if len(self.n) + len(new) > CACHE_PIECES and len(self.n):
            self._forget()
            new = np.arange(len(pieces))
        if len(new):
            known[new] = np.arange(len(self.n), len(self.n) + len(new))
            self._learn([pieces[i] for i in new.tolist()])
        n = self.n[known][number]
        total = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[known][number] - total + n, n) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.append(0, total)[np.searchsorted(starts, at)]


def encoder(name: str, plain: bool = False) -> PieceEncoder:
    """The worker's encoder for a vocabulary. ``plain``: special tokens' strings in a text are text."""
    if (name, plain) not in _encoders:
        _encoders[name, plain] = PieceEncoder(name, plain)
    return _encoders[name, plain]


def encoded(column: pa.Array, name: str, plain: bool = False) -> Iterator[np.ndarray]:
    """The ids of each text of a column (null: empty), in order."""
    enc = encoder(name, plain)
    for chunk in chunks(column, lower=False):
        ids, at = enc.encode(chunk.data, chunk.at)
        for i in range(chunk.docs):
            yield ids[at[i] : at[i + 1]]
