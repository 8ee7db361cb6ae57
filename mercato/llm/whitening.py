"""Whitening of embeddings on the leading principal components, found by slicing the spectrum.

Spark sums counts, integer sums and centred products of the vectors; what reaches the driver is one
matrix of dimension x dimension. There the inertia of LDL' factorisations of the shifted covariance (how
many pivots are negative) counts the eigenvalues below a shift: bisection with these counts isolates each
leading eigenvalue, Rayleigh quotient iteration inside the interval converges cubically to its
eigenvector, and two more counts beside the result certify its number. The vectors are then projected in
one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType

from mercato.llm.common import materialise
from mercato.llm.textbatch import releasing

#: a component c becomes the whole number floor(SCALE * c) + OFFSET
SCALE, OFFSET = 1024, 100_000
#: whole numbers are held within +- this
MOST = 1 << 40
COMPONENTS = 8
EPS = float(np.finfo(float).eps)
#: rows that are multiplied at once
_BLOCK = 4096


@dataclass
class Spectrum:
    """What the fit leaves: bounded by the dimension, whatever the number of vectors."""

    n: int
    sums: list[int]  # of each dimension, exact
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # their unit eigenvectors, a row each
    trace: float


# ------------------------------------------------------------------------------------- spectrum slicing
def ldl_inertia(a: np.ndarray) -> int:
    """Number of negative eigenvalues of the symmetric matrix ``a``: negative pivots of its LDL'
    factorisation with diagonal pivots of order 1 and 2 (by Sylvester's law of inertia)."""
    a, negative, k, n = a.copy(), 0, 0, len(a)
    alpha = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        column = np.abs(a[k + 1 :, k])
        r = int(column.argmax()) + k + 1 if len(column) else k
        most = column[r - k - 1] if len(column) else 0.0
        if most == 0 or abs(a[k, k]) >= alpha * most:
            order = 1
        else:
            other = np.abs(a[k:, r])
            other[r - k] = 0
            if abs(a[k, k]) * other.max() >= alpha * most * most:
                order = 1
            elif abs(a[r, r]) >= alpha * other.max():
                swap(k, r)
                order = 1
            else:
                swap(k + 1, r)
                order = 2
        if order == 1:
            pivot = a[k, k]
            negative += pivot < 0
            if pivot:
                rest = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest / pivot)
        else:
            block, rest = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            negative += 1  # such a block has one eigenvalue of either sign
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(block, rest.T)
        k += order
    return int(negative)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` lie above ``shift`` (at it: by rounding)."""
    return ldl_inertia(shift * np.eye(len(v)) - v)


def isolate(v: np.ndarray, k: int, low: float, high: float, least: float) -> tuple[float, float, int, int]:
    """The interval around the k-th largest eigenvalue (from 1), from one that holds it: halved until it
    holds no other or is ``least`` wide. Also the counts above its two ends."""
    count_low, count_high = above(v, low), above(v, high)
    while count_low - count_high > 1 and high - low > least:
        middle = (low + high) / 2
        count = above(v, middle)
        if count >= k:
            low, count_low = middle, count
        else:
            high, count_high = middle, count
    return low, high, count_low, count_high


def rayleigh(v: np.ndarray, low: float, high: float, found: np.ndarray, scale: float) -> tuple[float, np.ndarray] | None:
    """Eigenvalue in ``(low, high)`` and its unit vector, orthogonal to the rows of ``found``; None when
    the iteration leaves the interval."""

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(v - (shift + 4 * EPS * scale) * np.eye(len(v)), x)
        for _ in range(2):
            y = y - found.T @ (found @ y)
        size = np.linalg.norm(y)
        return y / size if np.isfinite(size) and size > 0 else x

    x = np.random.default_rng(13).standard_normal(len(v))
    x -= found.T @ (found @ x)
    x /= np.linalg.norm(x)
    for _ in range(4):
        x = solved((low + high) / 2, x)
    best = None
    for _ in range(12):
        value = float(x @ v @ x)
        rest = float(np.linalg.norm(v @ x - value * x))
        if best is None or rest < best[0]:
            best = rest, value, x
        elif best[0] <= 64 * EPS * scale:
            break
        x = solved(value, x)
    rest, value, x = best
    slack = 8 * EPS * scale
    return (value, x) if low - slack <= value <= high + slack and rest <= 256 * EPS * scale * len(v) ** 0.5 else None


def leading(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``components`` largest eigenvalues of the covariance ``v`` that aren't zero by rounding,
    and their unit eigenvectors as rows (largest entry positive).

    Equal eigenvalues, which no shift can part, get orthogonal vectors of their common space.
    """
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is larger
    floor = 16 * d * EPS * scale
    if not scale > 0:
        return np.zeros(0), np.zeros((0, d))
    wanted = min(components, above(v, floor))
    values, vectors, top = [], np.zeros((0, d)), scale * (1 + 1e-9)
    for k in range(1, wanted + 1):
        low, high, count_low, count_high = isolate(v, k, floor, top, 32 * EPS * scale)
        top = high if count_high == k - 1 else top
        beside = 64 * EPS * scale * d**0.5

        def certified() -> tuple[float, np.ndarray] | None:
            got = rayleigh(v, low, high, vectors, scale)
            return got if got and above(v, got[0] + beside) < k <= above(v, got[0] - beside) else None

        got = certified()
        while got is None and high - low > 32 * EPS * scale:  # nearer, until inverse iteration can't miss it
            middle = (low + high) / 2
            low, high = (middle, high) if above(v, middle) >= k else (low, middle)
            got = certified()
        if got is None:
            raise ArithmeticError(f"eigenvalue {k} was not found")
        value, x = got
        values.append(value)
        vectors = np.vstack([vectors, x * np.sign(x[np.abs(x).argmax()])])
    return np.array(values), vectors


# ------------------------------------------------------------------------------------------ Spark passes
def usable(vector: str | Column) -> Column:
    """Whether a vector is there, not empty, and holds neither null nor NaN nor infinity."""
    v = F.col(vector) if isinstance(vector, str) else vector
    inf = float("inf")
    return (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != inf), F.lit(False)))


def whole_numbers(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(np.clip(SCALE * flat, -MOST, MOST)).astype(np.int64) + OFFSET
    return x.reshape(len(lengths), -1)


def _count_and_sum(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension (halves of the numbers are summed apart, so that
    long sums can't overflow)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column(0))
                n, low, high = n + len(x), low + (x & 0xFFFFF).sum(axis=0), high + (x >> 20).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d), pa.int64()), pa.array(np.append(0, low)), pa.array(np.append(n, high))], names=["j", "low", "high"])

    parts = vectors.mapInArrow(releasing(run), "j long, low long, high long").groupBy("j")
    rows = parts.agg(F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high")).collect()
    sums = {r["j"]: (int(r["high"]) << 20 if r["j"] >= 0 else int(r["high"])) + int(r["low"]) for r in rows}  # a row a dimension
    return sums.get(-1, 0), [sums.get(j, 0) for j in range(d)]


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance with divisor n: each vector is centred by the exact mean, then multiplied. Tasks sum
    their own products; the rows of the matrices are added up by row number."""
    d = len(sums)
    whole = np.array([s // n for s in sums])
    part = np.array([(s % n) / n for s in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK):
                centred = (whole_numbers(batch.column(0).slice(at, _BLOCK)) - whole) - part
                total += centred.T @ centred
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "products"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, total = -1, np.zeros(d)
        for batch in batches:
            for row, products in zip(batch.column("i").to_pylist(), batch.column("products")):
                if row != i and i >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total], pa.list_(pa.float64()))], names=["i", "products"])
                if row != i:
                    i, total = row, np.zeros(d)
                total = total + products.values.to_numpy()
        if i >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total], pa.list_(pa.float64()))], names=["i", "products"])

    kind = "i long, products array<double>"
    # sorted as a whole row, so that the sums don't depend on which task ends first
    rows = vectors.mapInArrow(releasing(run), kind).repartition("i").sortWithinPartitions("i", "products").mapInArrow(add, kind).collect()
    v = np.zeros((d, d))
    for row in rows:  # d of them
        v[row["i"]] = row["products"]
    return (v + v.T) / (2 * n)


def dimension(vectors: DataFrame) -> int:
    """The commonest length of ``vectors``' column v (of several, the greatest); 0 without any."""
    lengths = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).limit(1).collect()
    return lengths[0]["d"] if lengths else 0


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Spectrum:
    """Spectrum of the covariance of ``vectors``' only column v (usable vectors of one length)."""
    d = dimension(vectors)
    n, sums = _count_and_sum(vectors, d)
    if not n:
        return Spectrum(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    v = _covariance(vectors, n, sums)
    values, units = leading(v, components)
    return Spectrum(n, sums, values, units, float(np.trace(v)))


def project(rows: DataFrame, spectrum: Spectrum, keep: list[str], vector: str = "v") -> DataFrame:
    """Columns ``keep`` of rows with vectors of the fitted length, deviation (decimal; null if it has over
    38 digits) and whitened, an array with an entry a component."""
    n, d = spectrum.n, len(spectrum.sums)
    whole = np.array([s // n for s in spectrum.sums], np.int64)
    rest = np.array([s % n for s in spectrum.sums], np.int64)
    out = (spectrum.vectors / np.sqrt(spectrum.values)[:, None]).T if len(spectrum.values) else np.zeros((d, 0))

    def deviations(x: np.ndarray) -> list[int | None]:
        away = x - whole  # n * x - S = n * away - rest
        bound = n * (int(np.abs(away).max(initial=0)) + 1)
        y = n * away - rest if bound * bound * d < 1 << 63 else n * away.astype(object) - rest.astype(object)
        return [t if t < 10**38 else None for t in map(int, (y * y).sum(axis=1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column(vector))
            white = ((x - whole) - rest / n) @ out
            at = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(deviations(x), pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(at), pa.array(white.ravel()))],
                names=[*keep, "deviation", "whitened"],
            )

    schema = rows.select(*keep).schema.add("deviation", DecimalType(38, 0)).add("whitened", ArrayType(DoubleType()))
    return rows.select(*dict.fromkeys([*keep, vector])).mapInArrow(releasing(run), schema)


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``white``'s arrays (divisor n) minus the identity."""
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    if not pairs:
        return 0.0
    at = [F.element_at("whitened", i + 1) for i in range(components)]
    row = white.agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_embeddings(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whiten ``embeddings`` (vec_id, embedding) on their leading components; all usable vectors are the
    fit list.

    Returns a row per usable vector and component: vec_id, component (from 1, by falling eigenvalue), n,
    deviation (decimal), whitened, explained, identity_error. Vectors that are null, empty or hold null or
    non-finite entries take no part, nor do those of another length than the commonest (of several, the
    greatest). Repeated rows count and come back as often as they are there; null ids stay null. There are
    fewer components where the dimension is less, or where the rest of the spectrum is zero by rounding
    (one vector, or equal ones, give no row, as nothing can be scaled to variance 1). Entries beyond
    2**30 count as that. An empty table gives no rows. Other columns are ignored.
    """
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    rows = rows.where(F.size("v") == dimension(rows.select("v")))
    spectrum = fit(rows.select("v"), components)
    kept = len(spectrum.values)
    empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not kept:
        return embeddings.sparkSession.createDataFrame([], empty)
    white = materialise(project(rows, spectrum, ["vec_id"]), "whitened")
    error = identity_error(white, kept)
    explained = F.array(*[F.lit(float(e / spectrum.trace)) for e in spectrum.values])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("at") + 1).cast("int").alias("component"), F.lit(spectrum.n).cast("long").alias("n"),
        "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
