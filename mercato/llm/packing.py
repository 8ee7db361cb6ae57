"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

Documents are tokenized and cut into pieces of at most a sequence; the histogram of piece lengths (at
most one row per length) is packed on the driver by counts: lengths are placed longest first, each
onto the open packing pattern with the most room, which splits that pattern's count. The patterns then
give every (length, rank) its sequence and offset, and pieces join them by their rank among the pieces
of their length. Neither the packing nor its result grows with the number of documents.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.bpe import encoded
from mercato.llm.common import materialise, prefix_positions
from mercato.llm.textbatch import releasing

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"


def pack_histogram(counts: dict[int, int], room: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (piece lengths, how many sequences) for ``counts`` pieces of each length."""
    done: list[tuple[tuple[int, ...], int]] = []
    waiting: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    rooms: list[int] = []  # heap of -room

    def put(pattern: tuple[int, ...], n: int, left: int) -> None:
        if not left:
            done.append((pattern, n))
            return
        if left not in waiting:
            waiting[left] = []
            heapq.heappush(rooms, -left)
        waiting[left].append((pattern, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            most = -rooms[0] if rooms else 0
            if most < length:
                put((length,), n, room - length)
                break
            pattern, have = waiting[most].pop()
            if not waiting[most]:
                del waiting[most]
                heapq.heappop(rooms)
            used = min(n, have)
            put((*pattern, length), used, most - length)
            if have > used:
                put(pattern, have - used, most)
            n -= used
    return done + [(pattern, n) for left in sorted(waiting) for pattern, n in waiting[left]]


def pattern_places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """For each length, from which rank on its pieces go to which sequences and offset."""
    rows, used, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    out = pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).astype("int64")
    return out.sort_values(["length", "first"], ignore_index=True)


def token_pieces(docs: DataFrame, sequence: int, tokenizer: str, with_ids: bool) -> DataFrame:
    """Pieces of at most ``sequence`` ids: doc_id, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            cuts: list[np.ndarray] = []
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, encoded(batch.column("text"), tokenizer)):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), sequence):
                    piece = ids[start : start + sequence]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                    if with_ids:
                        cuts.append(piece)
            columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in cuts], pa.list_(pa.int32())))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(cut), schema)


def pack_documents(
    docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = TOKENIZER, with_ids: bool = False
) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of ``sequence`` ids.

    A document is its ids by ``tokenizer`` and END_ID; it is cut every ``sequence`` ids. Returns a row
    per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (gapless from 0 in a
    sequence) and, if asked for, ids. Null and empty texts are one END_ID. Rows that repeat a document
    are packed as often as they come. An empty table gives no rows. Other columns are ignored.
    """
    pieces = materialise(token_pieces(docs, sequence, tokenizer, with_ids), "pack-pieces")
    # at most one row per length
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = pattern_places(pack_histogram(counts, sequence))
    # one ascending key over (length, rank): the ranks of the shorter lengths come first
    lengths = sorted(counts)
    base = dict(zip(lengths, np.cumsum([0] + [counts[x] for x in lengths]).tolist()))
    key = np.array([base[x] + r for x, r in places[["length", "first"]].itertuples(index=False)], np.int64)
    first_sequence, first_offset = places["sequence"].to_numpy(), places["offset"].to_numpy()
    ranked = prefix_positions(pieces, "length", ["doc_id", "start", "ids_crc32"], F.lit(1), "rank")

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            at = part["length"].map(base).to_numpy(np.int64) + part["rank"].to_numpy(np.int64)
            i = np.searchsorted(key, at, side="right") - 1
            yield part.drop(columns="rank").assign(sequence_id=first_sequence[i] + at - key[i], offset=first_offset[i])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    return ranked.select(*columns, "rank").mapInPandas(place, schema + ", sequence_id long, offset long")
