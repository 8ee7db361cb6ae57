"""Words of Arrow text columns as numpy arrays.

A batch is handled in chunks of a few MB of UTF-8 bytes, so the arrays stay small whatever the batch
holds; a longer document makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: texts of a batch that are decoded together
CHUNK_ROWS = 1024
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: spans of more bytes are hashed by a digest
_LONG = 512
#: masks of the first n bytes of eight
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


@dataclass
class Chunk:
    """Documents ``first .. first + len(word_at) - 2`` of a batch."""

    first: int
    data: np.ndarray  # bytes of all its texts
    at: np.ndarray  # where each text begins in data, and the end
    starts: np.ndarray  # of each word in data
    ends: np.ndarray
    word_at: np.ndarray  # index of the first word of each document, and the number of words

    @property
    def docs(self) -> int:
        return len(self.word_at) - 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(column: pa.Array, lower: bool = True, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    for first in range(0, len(column), CHUNK_ROWS):
        body, at = utf8(column.slice(first, CHUNK_ROWS))
        i, n = 0, len(at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
            data = body[at[i] : at[j]]
            if lower:
                data = _LOWER[data]
            begin = at[i : j + 1] - at[i]
            yield Chunk(first + i, data, begin, *word_spans(data, begin))
            i = j


def release() -> None:
    """Give memory that is free in this worker back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over a task's batches, that ends with :func:`release`."""

    def runs(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return runs


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[at] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: its length, then eight bytes at a time, every step a bijection of the
    state. Spans of one length up to eight bytes never collide, others by chance only; long spans get a
    digest."""
    size = ends - starts
    state = mix(size.astype(np.uint64) + np.uint64(_BASE))
    eights = np.ndarray((len(data) + 1,), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    live, at = np.flatnonzero((size > 0) & (size <= _LONG)), 0
    while len(live):
        left = size[live] - at
        lane = eights[starts[live] + at] & _FIRST_BYTES[np.minimum(left, 8)]
        state[live] = mix((state[live] ^ lane) * np.uint64(_BASE))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        state[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return state


def span_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each span, the same for equal spans only (by dictionary, not by hash), and the distinct
    spans by number. Spans ascend and don't overlap."""
    size = ends - starts
    packed = data
    if int(size.sum()) < len(data):
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[size > 0]] = 1
        inside[ends[size > 0]] -= 1
        packed = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    found = spans.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def as_bytes(spans: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; much faster than to_pylist."""
    _, offsets, data = spans.buffers()
    at = np.frombuffer(offsets, np.int64)[spans.offset : spans.offset + len(spans) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def word_hashes(chunk: Chunk) -> np.ndarray:
    return span_hashes(chunk.data, chunk.starts, chunk.ends)


def gram_hashes(words: np.ndarray, gaps: tuple[int, ...], salt: int = 0) -> np.ndarray:
    """Hash of the words at ``i + gap`` for each ``i``; the last ones that don't fit are left out."""
    n = max(0, len(words) - gaps[-1])
    total = np.full(n, (salt * _BASE) % (1 << 64), np.uint64)
    for k, gap in enumerate(gaps):
        total += words[gap : gap + n] * np.uint64((2 * k + 3) * _INVERSE % (1 << 64) | 1)
    return mix(total)
