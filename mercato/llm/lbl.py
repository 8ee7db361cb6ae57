"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Word counts come from all training documents. Every frequent word of at least LEAST tokens, the end mark
among them, is a unit of the model; the other words share hashed cells, about four for each root of the
number of distinct words, and a cell is a unit too. The most frequent units are classes of their own, the
others lie by frequency in about as many classes as a class has units, so classes and units grow with the
input. A class is scored by the bilinear product of its vector with the sum of the two previous classes'
position vectors, plus a bias; a unit within its class likewise, by its vector and the sum of the two
previous units' context vectors, each times its position's weights. Each partition of the training documents trains a copy in numpy against noise, for classes
drawn from their frequencies and for units evenly from the class, and the copies are averaged by their
tokens. One matrix product then gives the normaliser over the classes of every context, and a sum over a
token's class the one over units, so that token log-probabilities are exactly normalised; within a cell a
word has its smoothed count's share, and words never seen have together that of half a token.

Frequent words' counts go to every task: words with at least one token in FREQUENT, so at most FREQUENT
of them at any corpus size. Rarer words meet their counts in a shuffled join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialise
from mercato.llm.textbatch import Chunk, chunks, release, word_hashes
from mercato.llm.toxicity import held_out

HEADS = 1024  # units that are classes of their own
LEAST = 5  # tokens of a word that is a unit of its own
CELLS = 64  # at least so many hashed cells for the other words
DIMS = 16
NOISE = 64
NEAR = 5  # noise units for a token, out of its class
BLOCK = 1 << 16  # numbers of a model in a row
BATCH = 4096
COPY_TOKENS = 12  # tokens, for each unit of the model, that a copy of it learns from before copies are averaged
FEW = 8  # terms of a sum that is added up side by side with others
RATE = 0.15
FREQUENT = 1 << 22
SEED = 7
#: the end mark's place among the word hashes
END = np.uint64(0x9D5A6E3B17C4F821)


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a chunk, an end mark after each document, and where each document's begin."""
    words = word_hashes(chunk)
    out = np.empty(len(words) + chunk.docs, np.uint64)
    at = chunk.word_at + np.arange(chunk.docs + 1)
    ends = at[1:] - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word], out[ends] = words, END
    return out, at


def chance(x: np.ndarray) -> np.ndarray:
    """The logistic function, in place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def count_words(docs: DataFrame) -> DataFrame:
    """Counts (h, c) of all tokens of ``docs``, counted in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [tokens(chunk)[0] for chunk in chunks(batch.column("text"))]
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "c"])

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def contexts(classes: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens back; ``start`` before a document's first token."""
    one, two = np.full(len(classes), start), np.full(len(classes), start)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    first = at[:-1][at[:-1] < len(classes)]
    one[first] = two[first] = start
    second = first + 1
    two[second[second < len(classes)]] = start
    return one, two


def cells(h: np.ndarray, n: int) -> np.ndarray:
    """The cells, of ``n``, of word hashes; score_documents has the same in SQL."""
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


class Units:
    """Own words and cells by descending mass, and the classes that they lie in.

    ``keys`` are the frequent words' hashes, ascending, ``c`` their counts, ``rest`` the mass of all other
    words by cell. A word has its count and a half as mass, a cell its words' and a half for unseen ones.
    """

    def __init__(self, keys: np.ndarray, c: np.ndarray, rest: np.ndarray, heads: int):
        own, at = c >= LEAST, cells(keys, len(rest))
        cell = rest + 0.5 + np.bincount(at[~own], c[~own] + 0.5, len(rest))
        mass = np.concatenate([c[own] + 0.5, cell])
        order = np.lexsort((np.arange(len(mass)), -mass))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.keys, self.mass = keys, mass[order]
        self.cell = rank[own.sum() :]
        self.word = self.cell[at]
        self.word[own] = rank[: own.sum()]
        self.heads = min(heads, len(mass))
        self.width = math.isqrt(max(0, len(mass) - self.heads - 1)) + 1  # units of the other classes
        self.is_cell = np.zeros(len(mass), bool)
        self.is_cell[self.cell] = True
        first = np.append(np.arange(self.heads), np.arange(self.heads, len(mass), self.width))
        self.count = len(first)  # of classes
        share = np.add.reduceat(self.mass, first)
        self.within = self.mass / share[self.classes(np.arange(len(mass)))]  # of each unit in its class
        self.share = share / share.sum()

    @cached_property
    def index(self) -> pd.Index:
        """The frequent words' hash table; each worker makes its own."""
        return pd.Index(self.keys)

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units of word hashes, places among the frequent words, and whether they are there."""
        place = self.index.get_indexer(found)
        known = place >= 0
        cell = self.cell[cells(found, len(self.cell))]
        return (np.where(known, self.word[place], cell) if len(self.keys) else cell), place, known

    def classes(self, units: np.ndarray) -> np.ndarray:
        """Classes of units; the place before a document's start has the number after the last."""
        of = np.where(units < self.heads, units, self.heads + (units - self.heads) // self.width)
        return np.where(units == len(self.mass), self.count, of)

    def span(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First unit of classes that aren't heads, and the one after the last."""
        low = self.heads + (k - self.heads) * self.width
        return low, np.minimum(low + self.width, len(self.mass))


class Model:
    """Position vectors of the context classes (one more: before the start), class vectors and biases; with
    ``within``, the units' shares of their classes, also the units' context vectors, the two positions'
    weights, and the units' vectors and biases."""

    def __init__(self, share: np.ndarray, within: np.ndarray | None = None):
        rng = np.random.default_rng(SEED)
        self.share = share  # of each class among the tokens: the noise, and the first biases
        draw = lambda n: rng.standard_normal((n, DIMS), np.float32) * np.float32(0.1)
        bias = lambda first: np.log(first)[:, None].astype(np.float32)
        k = len(share)
        self.parts = [draw(k + 1), draw(k + 1), draw(k), bias(share)]
        if within is not None:
            n = len(within)
            self.parts += [draw(n + 1), np.ones((2, DIMS), np.float32), draw(n), bias(within)]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, vector: np.ndarray) -> Model:
        cuts = np.cumsum([p.size for p in self.parts])[:-1]
        self.parts = [x.reshape(p.shape) for x, p in zip(np.split(vector, cuts), self.parts)]
        return self


class RowSums:
    """The distinct ``rows``, as ``at``, and the sums over each of them of arrays whose rows lie like ``rows``.

    Most sums have few terms, and one costs less than a step of reduceat: those of up to FEW terms are added up
    side by side, falling by number of terms, so that a term's place is a slice. To the last bit the sums are
    reduceat's over rows in order: the first term, and to it the sum of the others.
    """

    def __init__(self, rows: np.ndarray):
        rows = rows.astype(np.int32)
        order = np.argsort(rows)
        rows = rows.take(order)
        new = np.ones(len(rows) + 1, bool)
        np.not_equal(rows[1:], rows[:-1], out=new[1:-1])
        cuts = np.flatnonzero(new)
        n = cuts[1:] - cuts[:-1]
        rank = np.maximum(FEW + 1 - n, 0).astype(np.uint8)  # falls with the number of terms
        by = np.argsort(rank, kind="stable")
        first, n = cuts.take(by), n.take(by)
        self.at = rows.take(first)
        many, *ends = np.cumsum(np.bincount(rank, minlength=FEW + 1))[:FEW].tolist()  # sums of more than FEW, ..., 1 terms
        self.many, self.first = many, order.take(first)
        self.others = [order.take(first[many:end] + k) for k, end in enumerate(reversed(ends), 1) if end > many]
        spans = [order[x : x + size] for x, size in zip(first[:many].tolist(), n[:many].tolist())]
        self.spans, self.cuts = np.concatenate(spans) if spans else order[:0], np.cumsum(n[:many]) - n[:many]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, many = x.take(self.first, 0), self.many
        if self.others:
            rest = x.take(self.others[0], 0)
            for other in self.others[1:]:
                rest[: len(other)] += x.take(other, 0)
            total[many : many + len(rest)] += rest
        if many:
            np.add.reduceat(x.take(self.spans, 0), self.cuts, axis=0, out=total[:many])
        return total


class Trainer:
    """Noise-contrastive estimation by Adagrad over mini-batches; the noise classes are a batch's, the
    noise units a token's."""

    def __init__(self, units: Units):
        self.units = units
        self.model = Model(units.share, units.within)
        self.speed = [np.ones((len(p), 1), np.float32) for p in self.model.parts]
        self.rng = np.random.default_rng(SEED + 1)
        self.cumulative = np.cumsum(units.share)
        self.log_noise = np.log(NOISE * units.share).astype(np.float32)
        self.seen = 0

    def _step(self, rows: np.ndarray, *parts: tuple[int, np.ndarray]) -> None:
        """One step for each of (part, gradients), whose gradients are for the same ``rows``."""
        sums = RowSums(rows)
        for part, gradient in parts:
            self._move(part, sums.at, sums(gradient))

    def _move(self, part: int, at: np.ndarray, total: np.ndarray) -> None:
        """One step of distinct rows by their gradients, which are overwritten."""
        table, speed = self.model.parts[part], self.speed[part]
        rate = speed.take(at, 0) + (np.einsum("ij,ij->i", total, total) / total.shape[1])[:, None]
        speed[at] = rate
        total *= np.float32(RATE) / np.sqrt(rate)
        table[at] = np.subtract(table.take(at, 0), total, out=total)

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        self._classes(*(self.units.classes(x) for x in (target, one, two)))
        inside = target >= self.units.heads
        if inside.any():
            self._units(target[inside], one[inside], two[inside])
        self.seen += len(target)

    def _classes(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        a1, a2, q, b = self.model.parts[:4]
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(q) - 1)
        r = a1.take(one, 0)
        r += a2.take(two, 0)
        qt, qn = q.take(target, 0), q[noise]
        # chance that a class came from the noise (targets) or the data (noise classes)
        g_target = -chance(self.log_noise[target] - b[target, 0] - np.einsum("ij,ij->i", r, qt))
        s = r @ qn.T
        s += b[noise, 0] - self.log_noise[noise]
        g_noise = chance(s)
        back = g_target[:, None] * qt + g_noise @ qn
        rows = np.concatenate([target, noise])
        self._step(one, (0, back))
        self._step(two, (1, back))
        vectors, biases = np.concatenate([g_target[:, None] * r, g_noise.T @ r]), np.concatenate([g_target, g_noise.sum(0)])[:, None]
        self._step(rows, (2, vectors), (3, biases))

    def _units(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        e, d, u, b = self.model.parts[4:]
        low, high = self.units.span(self.units.classes(target))
        size = (high - low)[:, None]
        noise = low[:, None] + (self.rng.random((len(target), NEAR)) * size).astype(np.int64)
        rows = np.concatenate([target[:, None], noise], 1)
        e1, e2, v = e.take(one, 0), e.take(two, 0), u.take(rows, 0)
        r = e1 * d[0] + e2 * d[1]
        log_noise = np.log(NEAR / size).astype(np.float32)
        s = np.einsum("nkd,nd->nk", v, r)
        s += b.take(rows) - log_noise
        g = chance(s)
        g[:, 0] -= 1.0
        back = np.einsum("nk,nkd->nd", g, v)
        weights = np.stack([(back * e1).sum(0), (back * e2).sum(0)])
        self._step(np.concatenate([one, two]), (4, np.concatenate([back * d[0], back * d[1]])))
        self._move(5, np.arange(2), weights)
        self._step(rows.ravel(), (6, np.einsum("nk,nd->nkd", g, r).reshape(-1, DIMS)), (7, g.reshape(-1, 1)))


class Scorer:
    """Natural logarithms of the units' probabilities by a trained model."""

    def __init__(self, units: Units, model: Model):
        self.units = units
        a1, a2, q, b, *self.inner = model.parts
        self.one, self.two = a1 @ q.T + b.T, a2 @ q.T
        top = self.one.max(1, keepdims=True), self.two.max(1, keepdims=True)
        self.log_z = np.log(np.exp(self.one - top[0]) @ np.exp(self.two - top[1]).T) + top[0] + top[1].T

    def __call__(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        k, k1, k2 = (self.units.classes(x) for x in (target, one, two))
        out = self.one[k1, k].astype(np.float64) + self.two[k2, k] - self.log_z[k1, k2]
        e, d, u, b = self.inner
        inside = np.flatnonzero(target >= self.units.heads)
        inside = inside[np.argsort(k[inside], kind="stable")]
        for i in range(0, len(inside), BATCH):
            at = inside[i : i + BATCH]
            r, of, own = e.take(one[at], 0) * d[0] + e.take(two[at], 0) * d[1], k[at], target[at]
            cuts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
            low, high = self.units.span(of[cuts[:-1]])
            log_z = np.empty(len(at), np.float32)
            for x, y, lo, hi in zip(cuts[:-1], cuts[1:], low, high):
                s = r[x:y] @ u[lo:hi].T
                s += b[lo:hi, 0]
                top = s.max(1)
                s -= top[:, None]
                np.exp(s, out=s)
                log_z[x:y] = np.log(s @ np.ones(s.shape[1], np.float32)) + top
            out[at] += (r * u.take(own, 0)).sum(1) + b[own, 0] - log_z
        return out


def train(docs: DataFrame, units: Units, n: int) -> Model:
    """The average, by tokens, of copies of the model that each learn from some partitions of ``docs``, which
    has ``n`` tokens; every token is learned from. A copy is shipped as a whole, so there are only as many as
    get COPY_TOKENS tokens a unit: what is shipped grows with the tokens, not with partitions x units."""
    copies = max(1, n // (COPY_TOKENS * len(units.mass)))
    docs = docs.select("text").coalesce(copies)
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        for batch in batches:
            trainer = trainer or Trainer(shared.value)
            for chunk in chunks(batch.column("text")):
                found, at = tokens(chunk)
                of = trainer.units.find(found)[0]
                one, two = contexts(of, at, len(trainer.units.mass))
                order = trainer.rng.permutation(len(of))
                for i in range(0, len(of), BATCH):
                    part = order[i : i + BATCH]
                    trainer.learn(of[part], one[part], two[part])
        if trainer and trainer.seen:
            vector, p, seen = trainer.model.vector(), TaskContext.get().partitionId(), trainer.seen
            vector -= Model(trainer.units.share, trainer.units.within).vector()  # rows that weren't learned: zeros, which compress
            del trainer
            for i in range(0, len(vector), BLOCK):
                columns = [pa.array([p]), pa.array([i // BLOCK]), pa.array([seen]), pa.array([vector[i : i + BLOCK].tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, names=["p", "block", "seen", "v"])
        release()

    def add(part: pd.DataFrame) -> pd.DataFrame:
        seen = int(part["seen"].sum())
        total = sum(np.frombuffer(v, "<f4") * (n / seen) for v, n in zip(part["v"], part["seen"].astype(float)))
        return pd.DataFrame({"p": [0], "block": [part["block"].iloc[0]], "seen": [seen], "v": [total.astype("<f4").tobytes()]})

    schema = "p long, block long, seen long, v binary"
    models = docs.mapInArrow(run, schema)
    # added up in groups of about the square root of their number, so that no task gets all
    groups = max(1, math.isqrt(models.rdd.getNumPartitions()))
    added = models.groupBy("block", F.pmod("p", F.lit(groups))).applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema)
    blocks = sorted((r["block"], r["v"]) for r in materialise(added, "lbl-model").select("block", "v").toLocalIterator())
    shared.unpersist()
    model = Model(units.share, units.within)
    learned = [np.frombuffer(v, "<f4") for _, v in blocks]
    return model.load(model.vector() + np.concatenate(learned)) if learned else model


def score_documents(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from those outside the held-out fold.

    Words are the runs of other than white space after lower-casing A-Z; an end mark follows. Returns a
    row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigram) and
    score (log10 probability by the model). Null and empty texts are the end mark alone; a null doc_id
    is not held out; repeated rows count as often as they come. Without training documents all tokens
    are unknown. An empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(~held_out(F.col("doc_id"), fold))
    counts = materialise(count_words(training), "lbl-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = F.col("c") * FREQUENT >= n
    table = counts.where(frequent).toPandas().sort_values("h")  # at most FREQUENT rows
    order = table["h"].to_numpy(np.int64).view(np.uint64).argsort()
    keys, c = table["h"].to_numpy(np.int64).view(np.uint64)[order], table["c"].to_numpy(np.int64)[order]
    log_total = math.log10(n + 0.5 * (v + 1))
    log_p = np.log10(c + 0.5) - log_total

    size = max(CELLS, 4 * math.isqrt(v))
    rest = np.zeros(size)
    late = counts.where(~frequent).groupBy((F.shiftrightunsigned("h", 33) % size).alias("cell")).agg(F.sum(F.col("c") + 0.5).alias("m"))
    for r in late.toLocalIterator():
        rest[r["cell"]] = r["m"]
    units = Units(keys, c, rest, HEADS)
    shared = docs.sparkSession.sparkContext.broadcast((Scorer(units, train(training, units, n)), log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, log_p = shared.value
        units = score.units
        # logarithm of a cell's share, 0 for own words
        share = np.where(units.is_cell, np.log10(units.mass) - log_total, 0.0)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(4)]
            rare, rare_at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for chunk in chunks(batch.column("text")):
                found, at = tokens(chunk)
                of, place, known = units.find(found)
                p = score(of, *contexts(of, at, len(units.mass))) / math.log(10)
                own = np.where(known, log_p[place], 0.0) if len(log_p) else np.zeros(len(found))
                p += np.where(units.is_cell[of], own - share[of], 0.0)
                unknown = np.append(0, np.cumsum(~known))
                for out, x in zip(columns, (np.ones(len(found), np.int64), known.astype(np.int64), own, p)):
                    out.append(np.add.reduceat(x, at[:-1]))  # every document has a token
                rare.append(found[~known])
                rare_at.append(unknown[at[1:]] + rare_at[-1][-1])
            size = batch.num_rows
            ids = pa.array(uid + np.arange(size))
            uid += size
            values = [pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(columns, ("i8", "i8", "f8", "f8"))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(rare_at).astype(np.int32)), pa.array(np.concatenate(rare).view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id"), *values, lists], names=["uid", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    scored = materialise(
        rows.mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>"), "lbl-scores"
    )
    # words outside the frequent ones: their counts, and so the rest of both sums
    words = scored.select("uid", F.explode("rare").alias("h")).join(counts.where(~frequent), "h", "left")
    rest = F.log10(F.coalesce("c", F.lit(0)) + 0.5) - log_total
    late = words.select(
        "uid", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"),
        F.col("c").isNotNull().cast("long").alias("n_known"), rest.alias("base"), rest.alias("score"),
    )
    total = scored.drop("rare").unionByName(late).groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")]
    )
    return total.select(
        "doc_id", held_out(F.col("doc_id"), fold).alias("held_out"), "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
