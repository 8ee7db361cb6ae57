"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is described by binned measures of itself and of the lines next to it, and gets a label, good
or bad; two weights say how readily a label goes on to the next line. Documents are described once (a few
bytes a line, written as a table); the fit is a full-batch L-BFGS whose gradients Spark sums over all
labelled documents, so it needs no sample, and no task or driver holds more than a batch and the weights.

A document label says nothing about single lines, so the fit has two rounds: a classifier of lines alone,
taught with the documents' labels, then the chain, taught with those labels except where the first round
strongly contradicts them. A document's score is the mean of its lines' forward-backward chances of being
good, weighted by their lengths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialise
from mercato.llm.textbatch import Chunk, chunks, mix, releasing, span_hashes, word_hashes

#: what is measured of a line, in this order
MEASURES = (
    "words", "word length", "upper case", "symbols", "sentence marks", "digits", "beyond ASCII", "one word's repeats",
    "distinct words", "distinct pairs", "seen before in the document", "last byte",
)
BINS = 12
#: the bin of a neighbour that isn't there
NONE = BINS - 1
#: bounds between the bins of a share
SHARES = np.array([0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8])
SIDES = 3  # the line, the one before, the one after
UNARY = SIDES * len(MEASURES) * BINS
DIMS = UNARY + 3  # intercept, good after good, bad after bad
#: penalty on squared weights, against a mean loss a document
L2 = 2e-4
ITERATIONS = 14
#: a line goes against its document's label in the second round from this chance on
CONTRADICTED = 0.95
#: gradients are summed as whole numbers of this part, so that no order of summing shows
UNIT = 2.0**-24

_SYMBOL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"|#&*%$@^~=+_<>{}[]\\/!")] = True
_MARK[list(b".,;:?'\"-()")] = True


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of the texts ``data[at[i]:at[i + 1]]``, and the index of each text's
    first line. A text of n line feeds has n + 1 lines; the empty text has one, empty."""
    feeds = np.flatnonzero(data == 10)
    ends = np.concatenate([at[1:], feeds])
    order = np.argsort(ends, kind="stable")  # a text ends before a line feed at the same place
    ends, last = ends[order], order < len(at) - 1
    starts = np.append(0, ends[:-1] + ~last[:-1])[: len(ends)]
    return starts, ends, np.append(0, np.flatnonzero(last) + 1)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.searchsorted(SHARES, part / np.maximum(whole, 1))


def describe(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's lines: the bins of MEASURES (lines x measures), the bytes, and each text's first line."""
    data = chunk.data
    starts, ends, line_at = line_spans(data, chunk.at)
    lines = len(starts)
    size = ends - starts

    def count(which: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(which, dtype=np.int64))
        return sums[ends] - sums[starts]

    line = np.searchsorted(starts, chunk.starts, side="right") - 1
    words = np.bincount(line, minlength=lines)
    letters = np.bincount(line, chunk.ends - chunk.starts, lines)  # bytes that aren't white space
    hashes = word_hashes(chunk)
    upper = count((data >= 65) & (data <= 90))
    lower = count((data >= 97) & (data <= 122))
    of_line = mix(hashes + np.uint64(0x9E3779B97F4A7C15) * line.astype(np.uint64))
    _, first, again = np.unique(of_line, return_index=True, return_counts=True)
    distinct = np.bincount(line[first], minlength=lines)
    most = np.zeros(lines, np.int64)
    np.maximum.at(most, line[first], again)
    same = line[1:] == line[:-1]
    pairs = mix(of_line[:-1] * np.uint64(3) + mix(of_line[1:]))[same]
    _, first = np.unique(pairs, return_index=True)
    distinct_pairs = np.bincount(line[1:][same][first], minlength=lines)
    doc = np.repeat(np.arange(chunk.docs, dtype=np.uint64), np.diff(line_at))
    _, first = np.unique(mix(span_hashes(data, starts, ends) + np.uint64(0x9E3779B97F4A7C15) * doc), return_index=True)
    seen = np.ones(lines, np.int64)
    seen[first] = 0
    end = np.zeros(lines, np.int64)
    full = size > 0
    byte = data[ends[full] - 1]
    end[full] = np.select([_MARK[byte], _SYMBOL[byte], (byte >= 48) & (byte <= 57), byte >= 128, byte <= 32], [2, 3, 4, 5, 6], 1)
    bins = np.stack([
        np.minimum(np.ceil(np.log2(words + 1)), NONE - 1).astype(np.int64),
        np.minimum(letters / np.maximum(words, 1), NONE - 1).astype(np.int64),
        _share(upper, upper + lower), _share(count(_SYMBOL[data]), letters), _share(count(_MARK[data]), letters),
        _share(count((data >= 48) & (data <= 57)), letters), _share(count(data >= 128), letters),
        _share(np.where(words > 1, most, 0), words), _share(distinct, words), _share(distinct_pairs, words - 1), seen, end,
    ], axis=1)
    return bins.astype(np.uint8), size, line_at


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, sizes and first lines of a batch of described documents."""
    bins, sizes = (np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("bins", np.uint8), ("sizes", "<i8")))
    lines = np.array([len(x) // 8 for x in batch.column("sizes").to_pylist()], np.int64)
    return bins.reshape(-1, len(MEASURES)), sizes, np.append(0, np.cumsum(lines))


def _with_neighbours(bins: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """Feature numbers of each line: its own bins, those of the line before and those of the line after."""
    before, after = np.full_like(bins, NONE), np.full_like(bins, NONE)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[line_at[:-1]] = NONE
    after[line_at[1:] - 1] = NONE
    return np.concatenate([bins, before, after], axis=1).astype(np.int64) + BINS * np.arange(SIDES * len(MEASURES))


@dataclass
class Chains:
    """What forward-backward says of a batch of documents."""

    good: np.ndarray  # chance of each line to be good
    norm: np.ndarray  # log of the sum over all labellings, a document
    both_good: np.ndarray  # expected pairs of neighbours that are both good, a document
    both_bad: np.ndarray


def forward_backward(unary: np.ndarray, line_at: np.ndarray, stay_good: float, stay_bad: float) -> Chains:
    """Chains of lines whose log odds of being good, by themselves, are ``unary``."""
    count = np.diff(line_at)
    order = np.argsort(-count, kind="stable")
    at, count = line_at[:-1][order], count[order]
    alive = [int(np.searchsorted(-count, -t, side="left")) for t in range(int(count.max(initial=0)))]  # chains of over t lines
    fg, fb, bg, bb = (np.zeros(len(unary)) for _ in range(4))
    for t, k in enumerate(alive):
        now = at[:k] + t
        if t:
            was = now - 1
            fb[now] = np.logaddexp(fb[was] + stay_bad, fg[was])
            fg[now] = np.logaddexp(fg[was] + stay_good, fb[was])
        fg[now] += unary[now]
    for t in range(len(alive) - 2, -1, -1):
        now = at[: alive[t + 1]] + t
        to = now + 1
        good = unary[to] + bg[to]
        bb[now] = np.logaddexp(stay_bad + bb[to], good)
        bg[now] = np.logaddexp(bb[to], stay_good + good)
    last = line_at[1:] - 1
    norm = np.logaddexp(fg[last], fb[last])
    doc = np.repeat(np.arange(len(norm)), np.diff(line_at))
    inner = np.ones(len(unary), bool)
    inner[line_at[:-1]] = False  # lines with one before them
    to = np.flatnonzero(inner)
    pg = np.exp(fg[to - 1] + stay_good + unary[to] + bg[to] - norm[doc[to]])
    pb = np.exp(fb[to - 1] + stay_bad + bb[to] - norm[doc[to]])
    return Chains(
        1.0 / (1.0 + np.exp(-np.clip(fg + bg - fb - bb, -500, 500))), norm,
        np.bincount(doc[to], pg, len(norm)), np.bincount(doc[to], pb, len(norm)),
    )


def _unary(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights[features].sum(axis=1) + weights[UNARY]


def line_labels(unary: np.ndarray, y: np.ndarray, line_at: np.ndarray) -> np.ndarray:
    """Labels for the second round: the document's, but for lines whose log odds by the first round go
    against it strongly; a document of such lines only keeps its label."""
    of_doc = np.repeat(y, np.diff(line_at))
    odds = np.log(CONTRADICTED / (1 - CONTRADICTED))
    against = np.where(of_doc == 1, unary < -odds, unary > odds)
    whole = np.minimum.reduceat(against, line_at[:-1]) if len(y) else against
    return np.where(against & ~np.repeat(whole, np.diff(line_at)), 1 - of_doc, of_doc)


def gradient(batch: pa.RecordBatch, weights: np.ndarray, teacher: np.ndarray | None) -> np.ndarray:
    """Gradient of the documents' losses, then the summed loss and the number of documents. Each document
    counts as one, whatever its lines. Without ``teacher``: the first round, lines by themselves."""
    bins, _, line_at = _documents(batch)
    y = np.asarray(batch.column("y").to_numpy(zero_copy_only=False), float)
    features, lines = _with_neighbours(bins, line_at), np.diff(line_at)
    unary, out = _unary(features, weights), np.zeros(DIMS + 2)
    share = np.repeat(1.0 / lines, lines)
    if teacher is None:
        label = np.repeat(y, lines)
        good = 1.0 / (1.0 + np.exp(-np.clip(unary, -500, 500)))
        out[DIMS] = (share * (np.logaddexp(0, unary) - label * unary)).sum()
    else:
        label = line_labels(_unary(features, teacher), y, line_at)
        stay_good, stay_bad = weights[UNARY + 1 : DIMS]
        chains = forward_backward(unary, line_at, stay_good, stay_bad)
        good = chains.good
        doc = np.repeat(np.arange(len(y)), lines)
        inner = np.ones(len(label), bool)
        inner[line_at[:-1]] = False
        to = np.flatnonzero(inner)
        both_good = np.bincount(doc[to], label[to] * label[to - 1], len(y))
        both_bad = np.bincount(doc[to], (1 - label[to]) * (1 - label[to - 1]), len(y))
        out[UNARY + 1] = ((chains.both_good - both_good) / lines).sum()
        out[UNARY + 2] = ((chains.both_bad - both_bad) / lines).sum()
        path = np.bincount(doc, label * unary, len(y)) + stay_good * both_good + stay_bad * both_bad
        out[DIMS] = ((chains.norm - path) / lines).sum()
    rest = (good - label) * share
    for k in range(features.shape[1]):
        out[: UNARY] += np.bincount(features[:, k], rest, UNARY)
    out[UNARY] = rest.sum()
    out[DIMS + 1] = len(y)
    return out


def summed_gradient(described: DataFrame, weights: np.ndarray, teacher: np.ndarray | None) -> tuple[float, np.ndarray]:
    """Mean loss and its gradient over all described documents with a label, penalty included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMS + 2)
        for batch in batches:
            if batch.num_rows:
                total += gradient(batch, weights, teacher)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMS + 2)), pa.array(np.rint(total / UNIT).astype(np.int64))], names=["ix", "units"]
        )

    parts = described.mapInArrow(releasing(run), "ix long, units long")
    sums = np.zeros(DIMS + 2)
    for row in parts.groupBy("ix").agg(F.sum(F.col("units").cast("decimal(38,0)")).alias("units")).collect():  # a row a weight
        sums[row["ix"]] = float(row["units"]) * UNIT
    docs = max(sums[DIMS + 1], 1.0)
    return sums[DIMS] / docs + L2 / 2 * float(weights @ weights), sums[:DIMS] / docs + L2 * weights


def lbfgs(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, iterations: int = ITERATIONS, kept: int = 8) -> np.ndarray:
    """Weights of small ``loss``, which returns its value and gradient."""
    w, (value, g) = start, loss(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.abs(g).max() < 1e-6:
            break
        d, memory = g.copy(), []
        for s, y in reversed(steps):
            memory.append((s @ d) / (s @ y))
            d -= memory[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(memory)):
            d += (a - (y @ d) / (s @ y)) * s
        step = 1.0 if steps else 1.0 / max(1.0, float(np.abs(g).sum()))
        for _ in range(8):
            to = w - step * d
            after, g_to = loss(to)
            if after <= value - 1e-4 * step * float(g @ d):
                break
            step /= 4
        else:
            break
        if (to - w) @ (g_to - g) > 1e-12:
            steps = [*steps[1 - kept :], (to - w, g_to - g)]
        w, value, g = to, after, g_to
    return w


def described_documents(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs``' columns ``keep`` and the description of their lines: bins and sizes as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for chunk in chunks(batch.column("text"), lower=False):
                bins, size, line_at = describe(chunk)
                size = size.astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(done, chunk.docs) for c in keep]
                    + [pa.array([x[line_at[i] : line_at[i + 1]].tobytes() for i in range(chunk.docs)], pa.binary()) for x in (bins, size)],
                    names=[*keep, "bins", "sizes"],
                )
                done += chunk.docs

    wanted = docs.select(*keep, *[c for c in ["text"] if c not in keep])
    return wanted.mapInArrow(releasing(run), wanted.select(*keep).schema.add("bins", "binary").add("sizes", "binary"))


def fit(described: DataFrame, labels: DataFrame, learn: Column | None = None, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights learned from the described documents (doc_id, bins, sizes) that have a label in ``labels``
    (doc_id, quality) and, with ``learn``, fulfil that condition on doc_id. Of several labels of an id the
    largest counts; null ids and labels count for nothing. Without any label all weights are 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if learn is not None:
        known = known.where(learn)
    one = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    taught = materialise(described.select(F.col("doc_id").cast("long").alias("doc_id"), "bins", "sizes").join(one, "doc_id"), "line-crf-taught")
    teacher = lbfgs(lambda w: summed_gradient(taught, w, None), np.zeros(DIMS), iterations)
    return lbfgs(lambda w: summed_gradient(taught, w, teacher), teacher, iterations)


def score_described(described: DataFrame, weights: np.ndarray, keep: list[str], name: str = "score") -> DataFrame:
    """Columns ``keep`` and ``name``: the mean chance of a document's lines to be good, each line weighted
    by its bytes and one (its line feed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, sizes, line_at = _documents(batch)
            good = _good_lines(bins, line_at, weights)
            first = line_at[:-1]  # every document has a line
            score = np.add.reduceat(good * (sizes + 1), first) / np.add.reduceat(sizes + 1, first) if len(first) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.clip(score, 0, 1))], names=[*keep, name])

    return described.mapInArrow(releasing(run), described.select(*keep).schema.add(name, "double"))


def _good_lines(bins: np.ndarray, line_at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return forward_backward(_unary(_with_neighbours(bins, line_at), weights), line_at, *weights[UNARY + 1 : DIMS]).good


def labelled_lines(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """A row per line of every text: doc_id, line (from 0), bytes, good (its chance of being good). A null
    or empty text has one empty line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, sizes, line_at = _documents(batch)
            lines = np.diff(line_at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(lines)), lines))),
                    pa.array(np.arange(len(sizes)) - np.repeat(line_at[:-1], lines)), pa.array(sizes.astype(np.int64)),
                    pa.array(_good_lines(bins, line_at, weights)),
                ], names=["doc_id", "line", "bytes", "good"],
            )

    described = described_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    return described.mapInArrow(releasing(run), "doc_id long, line long, bytes long, good double")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, quality) outside the
    held-out fold.

    Returns a row per row: doc_id, held_out, score, predicted (1 if score >= 0.7), n_lines. Null and empty
    texts count as one empty line; equal texts get equal scores; repeated rows stay repeated; without any
    label every score is 0.5 (to rounding). An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialise(described_documents(texts, ["doc_id"]), "line-crf-described")
    weights = fit(described, labels, ~held_out(F.col("doc_id")), iterations)
    scored = score_described(described.withColumn("n_lines", (F.octet_length("sizes") / 8).cast("long")), weights, ["doc_id", "n_lines"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines"
    )
