"""Periodic runs of words, found by uniting suffix classes in the order of falling LCP.

A run is a stretch that repeats a block of q words (its smallest period) and that no neighbouring word
extends. The words of a batch of texts get exact numbers, suffixes are sorted by prefix doubling, and
neighbours in that order become edges weighted by their longest common prefix. Kruskal's way, the heaviest
edge first, classes of suffixes are united with union-find; every class keeps its positions in order. Two
positions that become neighbours in a class at level l, d apart, agree on l words; with l >= d they begin a
repetition of period d, and nothing between them agrees on as many words, so d is the smallest period.

Documents are independent: one pass over the table without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from mercato.llm.textbatch import Chunk, chunks, releasing, span_numbers

#: a run has at least so many words, and at least so many periods
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: the neighbours' common prefix that a run of LEAST_WORDS and LEAST_PERIODS has at least
LEAST_LCP = 5
#: suffixes that agree on fewer words than this are never compared further
_FIRST = 4

RUN = StructType().add("start", "long").add("length", "long").add("period", "long")
RUNS = ArrayType(RUN)


def suffix_edges(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours ``i, j`` in the order of the texts' suffixes and their LCP, of those with LCP >= LEAST_LCP.

    ``words`` holds the texts' word numbers on end, ``word_at`` where each begins. Prefix doubling sorts
    positions by their first 1, 2, 4, ... words; a position that agrees with no other on as many is done.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(word_at) - 1, dtype=np.int64), np.diff(word_at))
    key = doc * (int(words.max(initial=0)) + 1) + words  # the same for equal words of a text; equal words of different texts differ
    order = np.argsort(key)
    fresh = np.append(True, key[order][1:] != key[order][:-1])[:n]
    labels = [np.full(n + 1, -1, np.int32 if n < 1 << 31 else np.int64)]  # class of each position at each level, numbered by its place in the order
    labels[0][order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else none
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    span, at = 1, order
    while True:
        same = ~fresh
        alone = fresh & np.append(~same[1:], True)[: len(fresh)]
        at = at[~alone]
        if not len(at):
            break
        label = labels[-1]
        first, second = label[at], label[np.minimum(at + span, n)]
        order = np.argsort(first.astype(np.int64) * (n + 2) + second)
        at, first, second = at[order], first[order], second[order]
        group = np.append(True, first[1:] != first[:-1])
        fresh = group | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(at))
        start = first + place - np.maximum.accumulate(np.where(group, place, 0))
        if span >= _FIRST:  # part at this level: neighbours that agree on span words and not on twice as many
            apart = np.flatnonzero(fresh & ~group)
            i, j = at[apart - 1], at[apart]
            common = np.full(len(i), span)
            for level in range(len(labels) - 1, -1, -1):
                agree = labels[level][np.minimum(i + common, n)] == labels[level][np.minimum(j + common, n)]
                common += agree << level
            long = common >= LEAST_LCP
            found.append((i[long], j[long], common[long]))
        new = label.copy()
        new[at] = start[np.maximum.accumulate(np.where(fresh, place, 0))]
        labels.append(new)
        span *= 2
    if not found:
        return none, none, none
    i, j, common = (np.concatenate(x) for x in zip(*found))
    return i, j, common


def seeds(i: np.ndarray, j: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Unite the positions along the edges by falling LCP; yields (first, second, level) of positions that
    become neighbours in a class and repeat often enough at that level."""
    order = np.argsort(-common, kind="stable")
    places, index = np.unique(np.concatenate([i, j]), return_inverse=True)
    parent = list(range(len(places)))
    positions = [[p] for p in places.tolist()]
    least = LEAST_PERIODS - 1

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, level in zip(index[: len(i)][order].tolist(), index[len(i) :][order].tolist(), common[order].tolist()):
        a, b = find(a), find(b)
        if len(positions[a]) < len(positions[b]):
            a, b = b, a
        large, small = positions[a], positions[b]
        parent[b], positions[b] = a, []
        before = -1  # the element of the smaller set before this one
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at and large[at - 1] > before and (x - large[at - 1]) * least <= level:
                yield large[at - 1], x, level
            after = small[k + 1] if k + 1 < len(small) else None
            if at < len(large) and (after is None or large[at] < after) and (large[at] - x) * least <= level:
                yield x, large[at], level
            before = x
        if len(small) > 8:
            large += small
            large.sort()  # two ascending stretches: linear
        else:
            for x in small:
                insort(large, x)


def find_runs(words: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``words``), length and period of every run of the texts, by start, then period."""
    got = np.fromiter(seeds(*suffix_edges(words, word_at)), [("first", "i8"), ("second", "i8"), ("level", "i8")])
    start, period = got["first"], got["second"] - got["first"]
    length = got["level"] + period
    text = np.searchsorted(word_at, start, side="right") - 1
    inner = start > word_at[text]
    # only the seed at a run's first word has its whole length; the word before the others continues the run
    whole = ~inner | (words[start - 1] != words[start + period - 1])
    whole &= length >= LEAST_WORDS
    start, length, period = start[whole], length[whole], period[whole]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeated_tails(h: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """Which original word stands at each place once the texts with ``h`` % 10 = 0 have a periodic tail:
    from word a = g % n on, word i is a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)), g = floor(h / 10).
    ``h`` is negative for a null id, which changes nothing."""
    n = np.diff(word_at)
    g = h // 10
    a = np.where(n > 0, g % np.maximum(n, 1), 0)
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(word_at[-1])
    changed = np.repeat((h >= 0) & (h % 10 == 0), n)
    place = at - np.repeat(word_at[:-1], n)
    a, p = np.repeat(a, n), np.repeat(p, n)
    moved = changed & (place >= a)
    return np.where(moved, np.repeat(word_at[:-1], n) + a + (place - a) % p, at)


def collapse(
    docs: DataFrame, keep: list[str], rewrite: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, key: str | None = None
) -> DataFrame:
    """``docs``' columns ``keep``, n_words, runs (an array of start, length, period, by start, then period)
    and collapsed: the words that no run holds after its first period, joined by one space.

    ``rewrite(keys, word_at)`` gets the texts' values of the column ``key`` and says which word of a batch
    stands at each place before runs are looked for; without it texts are taken as they are. Null and empty
    texts have no words and no runs.
    """
    wanted = docs.select(*dict.fromkeys([*keep, *[key] * bool(key), "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in chunks(batch.column("text"), lower=False):
                source = np.arange(len(chunk.starts))
                if rewrite:
                    source = rewrite(batch.column(key).slice(done, chunk.docs).to_numpy(zero_copy_only=False), chunk.word_at)
                start, length, period = find_runs(span_numbers(chunk.data, chunk.starts, chunk.ends)[0][source], chunk.word_at)
                gone = np.zeros(len(source) + 1, np.int64)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, start + length, -1)
                kept = np.cumsum(gone[:-1]) == 0
                run_at = np.searchsorted(start, chunk.word_at)
                text = np.repeat(chunk.word_at[:-1], np.diff(run_at))
                runs = pa.StructArray.from_arrays([pa.array(start - text), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(done, chunk.docs) for c in keep]
                    + [pa.array(np.diff(chunk.word_at)), pa.ListArray.from_arrays(pa.array(run_at.astype(np.int32)), runs), _joined(chunk, source, kept)],
                    names=[*keep, "n_words", "runs", "collapsed"],
                )
                done += chunk.docs

    kind = StructType([*wanted.select(*keep).schema.fields]).add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return wanted.mapInArrow(releasing(run), kind)


def _joined(chunk: Chunk, source: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words (``source`` of them by place) with one space between."""
    place = np.flatnonzero(kept)
    starts, ends = chunk.starts[source[place]], chunk.ends[source[place]]
    at = np.searchsorted(place, chunk.word_at)
    room = ends - starts + 1  # a word and the space after it
    room[at[1:][np.diff(at) > 0] - 1] -= 1  # none after a text's last
    to = np.append(0, np.cumsum(room))
    out = np.full(to[-1], 32, np.uint8)
    size = ends - starts
    offset = np.arange(int(size.sum())) - np.repeat(np.append(0, np.cumsum(size))[:-1], size)
    out[np.repeat(to[:-1], size) + offset] = chunk.data[np.repeat(starts, size) + offset]
    text = pa.LargeStringArray.from_buffers(chunk.docs, pa.py_buffer(to[at].astype(np.int64)), pa.py_buffer(out))
    return text.cast(pa.string())


def crc(doc_id: Column) -> Column:
    """crc32 of the id as decimal text; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(-1)).cast("long")


def run_digests(found: DataFrame) -> DataFrame:
    """Per document of :func:`collapse`'s result: doc_id, n_runs, the run of greatest exact length / period
    (start, length, period, exponent_milli; of equal ones the smallest start, then period; null without
    any), and sha256 of the list of runs and of the collapsed text."""
    runs = F.col("runs")
    # exact comparison of fractions; equal ones keep the array's order
    best = F.aggregate(
        runs, F.lit(None).cast(RUN), lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m)
    )
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    with_best = found.withColumn("best", best)
    return with_best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """Runs of every whole text of ``docs`` (doc_id, text): the digests of :func:`run_digests`, with
    ``tails`` after :func:`repeated_tails`.

    A row per row; null and empty texts have no runs (the best run's columns are null, the digests are of
    empty texts); repeated rows stay repeated; a null doc_id stays null and never gets a periodic tail. An
    empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("h", crc(F.col("doc_id")))
    return run_digests(collapse(rows, ["doc_id"], repeated_tails if tails else None, "h"))
