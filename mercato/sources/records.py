"""CSV records whose quoted fields hold line ends, read by many tasks, with their place in the file.

Spark's ``multiLine`` reads a whole file in one task. Here files are read as lines, in splits as ever:

1. Each task says of its splits, for both cases of how a split may begin (outside or inside a quoted field),
   how it ends, and how many lines and records it has: one row per split. Lines without a quote, nearly all,
   cost a vectorised count.
2. A prefix scan over a file's splits tells how each really begins, and where a record that crosses a border
   begins and ends.
3. With that, each task numbers its lines and records and puts together the records that lie in one split.
   Only pieces of a record that crosses a border meet by file and first line. ``from_csv`` parses the records.

So a file is read three times, the third time without a line leaving the scan for splits that no record
crosses the border of.

A quote that is never closed would swallow the rest of the file: a record of over MAX_LINES lines isn't put
together, and each of its lines is a record of its own with ``_unclosed`` true. No line is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.schema import LINE, RECORD, UNCLOSED

#: a record of more lines is taken for an unclosed quote
MAX_LINES = 10_000
_SPLIT = "file string, block long, at long, out0 int, out1 int, rec0 long, rec1 long, last0 long, last1 long, head long"
_PLACED = f"sid int, kind int, n long, goes_on boolean, `{LINE}` long, `{RECORD}` long, value string"
#: kinds of placed rows: a record, a piece of one that crosses a split's border, a line of one that is too long
WHOLE, PIECE, APART = 0, 1, 2


def ends_inside(line: str, inside: bool) -> bool:
    """Whether ``line`` ends inside a quoted field, when it begins inside one or not. A quote opens at the
    beginning of a field only; two quotes inside are one of the text."""
    at = 0
    while True:
        if inside:
            close = line.find('"', at)
            if close < 0:
                return True
            if line[close + 1 : close + 2] == '"':
                at = close + 2
                continue
            inside, at = False, close + 1
        elif line[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


def _marks(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines with quotes, and which lines are blank."""
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    return quoted, pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)


def _between(places: np.ndarray, a: int, b: int) -> list[int]:
    return places[np.searchsorted(places, a) : np.searchsorted(places, b)].tolist()


def _states(change: list[tuple[int, int]], a: int, b: int) -> np.ndarray:
    """State of each line from ``a`` on and of the one after the last, from the places where it may change."""
    from_, value = zip(*change)
    return np.repeat(value, np.diff([*from_, b + 1]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split and batch, of the split up to there: the last line's place, and for both cases the
    state after it, the number of records and the last record's first line; also the line in which a record
    that the split begins in ends."""
    before, carry = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, blocks, lines = batch.column("file"), batch.column("block").to_numpy(zero_copy_only=False), batch.column("value")
        new = np.ones(n, bool)  # a split begins
        new[1:] = (blocks[1:] != blocks[:-1]) | pc.not_equal(files.slice(1), files.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = (files[0].as_py(), int(blocks[0])) != before
        before = (files[n - 1].as_py(), int(blocks[n - 1]))
        quoted, blank = _marks(lines)
        starts = np.unique(np.append(np.flatnonzero(new), 0)).tolist()
        out = []
        for a, b in zip(starts, [*starts[1:], n]):
            state, first, records, last, head = carry if carry and not new[a] else ([0, 1], 0, [0, 0], [-1, -1], None)
            state, records, last = list(state), list(records), list(last)
            change = [[(a, s)] for s in state]  # states from a line on
            for i in _between(quoted, a, b):
                text = lines[i].as_py()
                ends = [ends_inside(text, False), ends_inside(text, True)]
                for h in (0, 1):
                    state[h] = int(ends[state[h]])
                    change[h].append((i + 1, state[h]))
                if head is None and not state[1]:
                    head = first + i - a
            for h in (0, 1):
                begins = np.flatnonzero((_states(change[h], a, b)[: b - a] == 0) & ~blank[a:b])
                if len(begins):
                    records[h], last[h] = records[h] + len(begins), first + int(begins[-1])
            carry = (state, first + b - a, records, last, head)
            out.append((files[a].as_py(), int(blocks[a]), first + b - a - 1, *state, *records, *last, head))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
        names = [c.split()[0] for c in _SPLIT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)


class _Placer:
    """Places the lines of splits in their order. Of the record that is being put together at most
    ``max_lines`` lines are held."""

    def __init__(self, max_lines: int, pieces: bool):
        self.max_lines, self.pieces = max_lines, pieces  # only the pieces, or all but them
        self.sid, self.held, self.rows = None, [], []

    def emit(self, kind: int, n: int, goes_on: bool, line: int, record: int, value: str) -> None:
        if (kind == PIECE) == self.pieces:
            self.rows.append((self.sid, kind, n + 1, goes_on, (n if kind == APART else line) + 1, record, value))

    def begin(self, sid: int, state: int, base: int, records: int, begun: int | None, in_end: int | None, out_end: int | None) -> None:
        self.end()
        self.sid, self.state, self.at, self.records, self.line, self.out_end = sid, state, base, records, begun, out_end
        # how the rest of a record is placed that began in an earlier split, or is too long
        self.rest = None if not state else APART if in_end - begun + 1 > self.max_lines else PIECE

    def end(self) -> None:
        """The split's end: the record held goes on behind it."""
        if self.held:
            kind = APART if self.out_end - self.line + 1 > self.max_lines else PIECE
            for n, goes_on, value in self.held:
                self.emit(kind, n, goes_on, self.line, self.records, value)
        self.held = []

    def part(self, n: int, goes_on: bool, value: str) -> None:
        """A line that begins or ends inside a quoted field."""
        if self.rest is not None:
            self.emit(self.rest, n, goes_on, self.line, self.records, value)
            if not goes_on:
                self.rest = None
            return
        self.held.append((n, goes_on, value))
        if len(self.held) > self.max_lines:
            for x in self.held:
                self.emit(APART, x[0], x[1], self.line, self.records, x[2])
            self.held, self.rest = [], APART if goes_on else None
        elif not goes_on:
            self.emit(WHOLE, n, False, self.line, self.records, "\n".join(x[2] for x in self.held))
            self.held = []

    def place(self, lines: pa.Array, a: int, b: int, quoted: np.ndarray, blank: np.ndarray) -> pa.RecordBatch | None:
        """Lines from ``a`` to ``b`` of the split: those that are a record each, in a batch."""
        change = [(a, self.state)]
        for i in _between(quoted, a, b):
            self.state = int(ends_inside(lines[i].as_py(), bool(self.state)))
            change.append((i + 1, self.state))
        states = _states(change, a, b)
        inside, goes_on = states[:-1], states[1:]
        n = self.at + np.arange(b - a)
        begins = (inside == 0) & ~blank[a:b]
        record = self.records + np.cumsum(begins)
        first = -1 if self.line is None else self.line
        line = np.maximum(np.maximum.accumulate(np.where(begins, n, -1)), first)
        apart = (inside != 0) | (goes_on != 0)
        for i in np.flatnonzero(apart).tolist():
            self.records, self.line = int(record[i]), int(line[i])
            self.part(int(n[i]), bool(goes_on[i]), lines[a + i].as_py())
        self.records, self.at = int(record[-1]), self.at + b - a
        self.line = int(line[-1]) if line[-1] >= 0 else None
        alone = np.flatnonzero(~apart)
        if self.pieces or not len(alone):
            return None
        k = len(alone)
        values = lines.slice(a, b - a) if k == b - a else lines.take(pa.array(a + alone))
        columns = [
            pa.array(np.full(k, self.sid, np.int32)), pa.array(np.full(k, WHOLE, np.int32)), pa.array(n[alone] + 1), pa.array(np.zeros(k, bool)),
            pa.array(line[alone] + 1, mask=line[alone] < 0), pa.array(record[alone]), values,
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)

    def taken(self) -> Iterator[pa.RecordBatch]:
        """The other rows so far."""
        if self.rows:
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*self.rows), kinds)], names=_NAMES)
            self.rows = []


_NAMES = [c.split()[0].strip("`") for c in _PLACED.split(", ")]


def _placed(max_lines: int, pieces: bool):
    """Rows of _PLACED for lines with what is known of their split: the pieces, or all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placer = _Placer(max_lines, pieces)
        for batch in batches:
            if not batch.num_rows:
                continue
            sids, lines = batch.column("sid").to_numpy(zero_copy_only=False), batch.column("value")
            quoted, blank = _marks(lines)
            starts = [0, *(np.flatnonzero(sids[1:] != sids[:-1]) + 1).tolist()]
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                if int(sids[a]) != placer.sid:
                    placer.begin(*[batch.column(c)[a].as_py() for c in ("sid", "state", "base", "records", "begun", "in_end", "out_end")])
                alone = placer.place(lines, a, b, quoted, blank)
                if alone is not None:
                    yield alone
            yield from placer.taken()
        placer.end()
        yield from placer.taken()

    return run


def _known_splits(text: DataFrame) -> DataFrame:
    """How each split begins: a row for each of spark.sql.files.maxPartitionBytes of input."""
    split = text.mapInArrow(_summaries, _SPLIT).groupBy("file", "block")
    # one aggregate: whoever reads of it, the lines are read once
    split = split.agg(F.max(F.struct("at", "out0", "out1", "rec0", "rec1", "last0", "last1", "head")).alias("s")).select("file", "block", "s.*")
    # windows over a file's splits
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("out0") == F.col("out1"), (F.col("out0") == 1) & (F.col("out1") == 0)
    split = split.withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(past), F.lit(0)))
    known = F.last(F.when(fixed, F.struct(F.col("out0").alias("s"), "turned")), ignorenulls=True).over(past)
    split = split.withColumn("known", known).withColumn(
        "state", F.pmod(F.coalesce(F.col("known.s"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("known.turned"), F.lit(0)), F.lit(2))
    )
    of = lambda c: F.when(F.col("state") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    lines = F.col("at") + 1
    split = split.withColumn("base", F.coalesce(F.sum(lines).over(past), F.lit(0))).withColumn("records", F.coalesce(F.sum(of("rec")).over(past), F.lit(0)))
    split = split.withColumn("begun", F.last(F.when(of("last") >= 0, F.col("base") + of("last")), ignorenulls=True).over(past))
    # last lines of the records that a split begins and ends in; the file's if such a record isn't closed
    end = F.when(F.col("state") == 1, F.col("base") + F.col("head"))
    over = F.sum(lines).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1
    split = split.withColumn("in_end", F.coalesce(F.first(end, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), over))
    split = split.withColumn("out_end", F.coalesce(F.first(end, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), over))
    sid = F.row_number().over(Window.orderBy("file", "block"))  # over all splits
    return split.select("file", "block", sid.alias("sid"), "state", of("out").alias("out"), "base", "records", "begun", "in_end", "out_end")


def read_records(spark: SparkSession, path: str, header: bool = True, max_lines: int = MAX_LINES) -> DataFrame:
    """Records of the CSV files at ``path`` as text: file, _line, _record, _unclosed, record. With ``header``
    each file's first record is left out (it counts as record 1). Both line ends are read; inside a quoted
    field they are kept as they are. An empty file has no records."""
    text = spark.read.option("lineSep", "\n").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = _known_splits(text)
    begins = ["sid", "state", "base", "records", "begun", "in_end", "out_end"]
    named = F.broadcast(splits.where(F.col("state").isNotNull()).select("sid", "file"))

    def placed(some: DataFrame, pieces: bool) -> DataFrame:
        lines = text.join(F.broadcast(some.select("file", "block", *begins)), ["file", "block"]).select(*begins, "value")
        return lines.mapInArrow(_placed(max_lines, pieces), _PLACED).join(named, "sid")

    rows = placed(splits, False).where((F.col("kind") == APART) | (F.trim(F.col("value"), F.lit(" \t\r")) != ""))
    whole = rows.select("file", LINE, RECORD, (F.col("kind") == APART).alias(UNCLOSED), "value")
    joined = (
        placed(splits.where((F.col("state") == 1) | (F.col("out") == 1)), True).groupBy("file", LINE, RECORD)
        .agg(F.sort_array(F.collect_list(F.struct("n", "value", "goes_on"))).alias("x"))
        .select("file", LINE, RECORD, F.element_at("x", -1)["goes_on"].alias(UNCLOSED), F.array_join(F.col("x.value"), "\n").alias("value"))
    )
    value = F.col("value")
    records = whole.unionByName(joined).withColumn("record", F.when(value.contains("\r"), F.regexp_replace(value, r"\r$", "")).otherwise(value)).drop("value")
    records = records.withColumn("record", F.when(F.col(LINE) == 1, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")))
    return records.where(F.col(RECORD) > 1) if header else records


def parse_records(records: DataFrame, columns: list[str] | tuple[str, ...], numbers: bool = False) -> DataFrame:
    """The fields of :func:`read_records`' records as text ``columns`` (a record of fewer fields has nulls at
    its end); with ``numbers`` also _line, _record and _unclosed."""
    options = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "maxCharsPerColumn": "-1"}
    parsed = records.withColumn("f", F.from_csv("record", ", ".join(f"`{c}` string" for c in columns), options))
    return parsed.select(*[F.col("f").getField(c).alias(c) for c in columns], *[LINE, RECORD, UNCLOSED] * numbers)
