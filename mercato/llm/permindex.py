"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots, in order. Vectors are indexed in blocks; a block's
inverted file lists, for each pivot, the vectors that have it among their nearest and at which place.
A query walks the lists of its own nearest pivots, adding up footrule distances (a vector missing from a
list counts as one place beyond the last), and the nearest vectors by footrule are reranked by the exact
inner product. Queries also come in blocks, so no task holds more than a block of each.

Largest inner product becomes nearest in angle by one more component, sqrt(M^2 - |x|^2) with M the
largest norm, which a query has as 0; with vectors of equal norms it changes nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import materialise

#: pivots: from the first PIVOT_SAMPLE vectors by hashed id, the first PIVOTS distinct ones
PIVOTS, PIVOT_SAMPLE = 256, 4096
#: nearest pivots that a vector is listed under, and that a query looks at
LISTED, LOOKED = 64, 32
#: of a block, reranked exactly: this share of it, and so many at least
RERANKED, RERANKED_LEAST = 0.15, 1024
BLOCK, QUERY_BLOCK = 8192, 2048


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as array<double>): no null id; no null, zero, or partly null or non-finite vector; all
    of the most common length; the rows of an id are one vector, the least of them."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = materialise(rows, "ann-vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


def inverted_file(places: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of vectors by pivot: where each pivot's list begins, the vectors in it, their places.
    ``places[i, j]`` is the pivot at place j of vector i."""
    n, k = places.shape
    order = np.argsort(places.ravel(), kind="stable")
    return np.searchsorted(places.ravel()[order], np.arange(pivots + 1)), order // k, (order % k).astype(np.int32)


def search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int, pivots: int) -> pd.DataFrame:
    """The best ``k`` of a block of vectors for each of a block of queries."""
    vectors = vectors.sort_values("vec_id", ignore_index=True)  # ties fall to the smaller id
    ids = vectors["vec_id"].to_numpy()
    x = np.stack([np.frombuffer(b, "<f8") for b in vectors["v"]])
    places = np.stack([np.frombuffer(b, "<i4") for b in vectors["near"]])
    listed = places.shape[1]
    begins, member, place = inverted_file(places, pivots)
    keep = max(RERANKED_LEAST, math.ceil(RERANKED * len(ids)))
    out = []
    for query_id, raw, near in zip(queries["vec_id"], queries["v"], queries["near"]):
        q, look = np.frombuffer(raw, "<f8"), np.frombuffer(near, "<i4")[:LOOKED]
        far = np.full(len(ids), listed * len(look), np.int32)  # every pivot one place beyond the last
        for j, pivot in enumerate(look):
            a, b = begins[pivot], begins[pivot + 1]
            far[member[a:b]] -= listed - np.abs(place[a:b] - j)
        if keep < len(ids):  # nearest by footrule, ties by id
            edge = np.partition(far, keep - 1)[keep - 1]
            sure = np.flatnonzero(far < edge)
            found = np.concatenate([sure, np.flatnonzero(far == edge)[: keep - len(sure)]])
        else:
            found = np.arange(len(ids))
        found = found[ids[found] != query_id]
        score = (x[found] * q).sum(1)
        best = np.lexsort((ids[found], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[found][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """The ``k`` nearest vectors by inner product of every vector whose id is a multiple of ``query_every``.

    Returns query_id, rank (from 1; nearest first, ties to the smaller id), vec_id, score: the inner
    product in double precision. Candidates are all other vectors; with at most RERANKED_LEAST vectors
    the search is exact. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do those of another length than most. An empty table gives no rows. Other columns are
    ignored.
    """
    rows = usable(vectors)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    top, n = rows.agg(F.max(norm), F.count(F.lit(1))).first()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toPandas()["v"]  # bounded
    pivots = np.array([list(p) for p in dict.fromkeys(tuple(v) for v in sample)][:PIVOTS]).reshape(-1, len(sample[0]) if len(sample) else 1)
    top = top or 0.0
    rest = np.sqrt(np.maximum(top * top - (pivots * pivots).sum(1), 0.0))
    listed = min(LISTED, len(pivots))

    def represent(parts):
        for part in parts:
            x = np.array([list(v) for v in part["v"]]).reshape(len(part), pivots.shape[1])
            up = np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))
            query = part["query"].to_numpy()
            up[query] = 0.0
            near = np.argsort(-(x @ pivots.T + up[:, None] * rest), axis=1, kind="stable")[:, :listed].astype("<i4")
            yield pd.DataFrame({"vec_id": part["vec_id"], "query": query, "v": [r.tobytes() for r in x.astype("<f8")], "near": [r.tobytes() for r in near]})

    is_query = F.pmod("vec_id", F.lit(query_every)) == 0
    both = rows.select("vec_id", "v", F.explode(F.when(is_query, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("query"))
    index = materialise(both.mapInPandas(represent, "vec_id long, query boolean, v binary, near binary"), "ann-index")
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n // (QUERY_BLOCK * query_every)))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    filed = index.where("not query").select("vec_id", "v", "near", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b"), all_of(query_blocks).alias("qb"))
    asked = index.where("query").select("vec_id", "v", "near", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), all_of(blocks).alias("b"))
    count = len(pivots)

    def search(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return search_block(x, q, k, count)

    found = filed.groupBy("b", "qb").cogroup(asked.groupBy("b", "qb")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
