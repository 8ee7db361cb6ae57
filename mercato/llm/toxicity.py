"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashed buckets of its words, word pairs and pairs with one or two words
skipped, each present or not. The classifier is fitted on a bounded sample of labelled documents, one
document at a time, with a learning rate per coordinate and L1 shrinkage; what is left is a short list
of weights, which every task that scores documents gets. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.textbatch import Chunk, chunks, gram_hashes, releasing, word_hashes

#: words, pairs, and pairs with one or two words between
GAPS = ((0,), (0, 1), (0, 2), (0, 3))
BITS = 22
#: labelled documents that the classifier is fitted on, at most: those of smallest hashed doc_id
TRAIN_ROWS = 16_384
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.6, 1.0, 12.0, 0.1
#: a feature counts in the fit from so many documents on
LEAST_DOCS = 3


def features(chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per kind of gram: the document (in the chunk) and the feature of every gram."""
    words = word_hashes(chunk)
    doc = np.repeat(np.arange(chunk.docs), np.diff(chunk.word_at))
    for kind, gaps in enumerate(GAPS):
        grams = gram_hashes(words, gaps, kind)
        inside = doc[: len(grams)] == doc[gaps[-1] : gaps[-1] + len(grams)]
        yield doc[: len(grams)][inside], (grams[inside] & np.uint64((1 << BITS) - 1)).astype(np.int64)


def ftrl(rows: list[tuple[float, np.ndarray]], dims: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over (label, features present) in their order."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)
    for _ in range(epochs):
        for y, present in rows:
            at = np.append(present, np.uint32(dims))
            zi, ni = z[at], n[at]
            shrunk = np.abs(zi) > L1
            shrunk[-1] = True  # the intercept isn't shrunk
            l1 = np.full(len(at), L1)
            l1[-1] = 0.0
            rate = (BETA + np.sqrt(ni)) / ALPHA
            w = np.where(shrunk, -(zi - np.sign(zi) * l1) / (rate + L2), 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - ((np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA) * w
            n[at] += g * g
    rate = (BETA + np.sqrt(n)) / ALPHA + L2
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / rate, 0.0)
    return w[:dims], float(-z[dims] / rate[dims])


def held_out(doc_id, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` modulo 5 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, the weights, and the intercept. Learns from labelled documents outside
    the held-out fold; of several labels of an id the largest counts; null labels count for nothing."""
    sample = (
        labels.where(~held_out(F.col("doc_id"), 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("double").alias("y"))
        .withColumn("key", F.xxhash64("id")).orderBy("key", "id").limit(train_rows)
    )
    # the sample has at most train_rows small rows
    labelled = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(sample), "id")
    one_text = labelled.groupBy("id", "key", "y").agg(F.min("text").alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for chunk in chunks(batch.column("text")):
                pairs = [np.unique((d << BITS) | f) for d, f in features(chunk)]
                both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
                at = np.searchsorted(both, np.arange(chunk.docs + 1) << BITS)
                present = (both & ((1 << BITS) - 1)).astype("<u4")
                found += [present[at[i] : at[i + 1]].tobytes() for i in range(chunk.docs)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("y"), pa.array(found, pa.binary())], names=["key", "y", "present"]
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # flat arrays: a list of many small ones would take a multiple of their memory
        flat, ends, labels, docs_with = [], [], [], np.zeros(1 << BITS, np.int32)
        for batch in batches:
            column = batch.column("present")
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
            present = np.frombuffer(column.buffers()[2], "<u4")[at[0] : at[-1]].copy() if len(column) and at[-1] > at[0] else np.zeros(0, "<u4")
            np.add.at(docs_with, present, 1)
            flat.append(present)
            ends.append(at - at[0])
            labels += batch.column("y").to_pylist()
        rows = []
        while flat:
            present, at = flat.pop(0), ends.pop(0)
            often = docs_with[present] >= LEAST_DOCS
            kept = np.append(0, np.cumsum(often))[at]
            present = present[often]
            rows += [present[kept[i] : kept[i + 1]] for i in range(len(kept) - 1)]
        rows = list(zip(labels, rows))
        weights, intercept = ftrl(rows, 1 << BITS)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(weights[at], intercept), pa.float64())], names=["feature", "weight"]
        )

    # one task: the sample is bounded, and the fit takes one document after another
    rows = one_text.mapInArrow(releasing(featurise), "key long, y double, present binary").repartition(1).sortWithinPartitions("key")
    model = rows.mapInArrow(releasing(train), "feature long, weight double").toPandas()  # at most 2**BITS + 1 rows
    one = model["feature"].to_numpy() >= 0
    intercept = float(model["weight"][~one].sum()) if (~one).any() else 0.0
    return model["feature"].to_numpy()[one], model["weight"].to_numpy()[one], intercept


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: list[str], name: str = "score") -> DataFrame:
    """``docs``' columns ``keep`` and ``name``, the model's chance of label 1 for the text."""
    at, weights, intercept = model
    out = docs.select(*keep, *[c for c in ["text"] if c not in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float64)
        table[at] = weights
        counts = table != 0
        for batch in batches:
            scores = [np.zeros(0)]
            for chunk in chunks(batch.column("text")):
                hits = [((d[c := counts[f]]) << BITS) | f[c] for d, f in features(chunk)]
                both = np.unique(np.concatenate(hits))
                total = np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], chunk.docs)
                scores.append(1.0 / (1.0 + np.exp(-np.clip(total + intercept, -35, 35))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.concatenate(scores), pa.float64())], names=[*keep, name]
            )

    schema = out.select(*keep).schema.add(name, "double")
    return out.mapInArrow(releasing(run), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, toxic).

    Returns a row per row: doc_id, held_out, score, predicted (1 if score >= 0.5). Null and empty texts
    get the intercept's score; repeated rows get the same score; without any label every score is 0.5.
    An empty table gives no rows. Other columns are ignored.
    """
    model = fit(docs, labels, train_rows)
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model, ["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with all their columns, without the rows whose text scores ``threshold`` or more."""
    scored = score(docs, fit(docs, labels), docs.columns, "__toxic")
    return scored.where(F.col("__toxic") < threshold).drop("__toxic")
