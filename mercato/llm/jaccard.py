"""Exact n-gram Jaccard join in the Jaccard metric space, and its connected components.

Jaccard distance is a metric, and two documents link at distance EPS = 1 - 0.8 or less. The join works
on distinct shingle sets:

1. Screening. In a prefix-filter sense a document can lose at most a fifth of its shingles to a partner,
   so one with more shingles that no other document has is at a distance above EPS from everything and
   leaves. The first count takes a hashed sample of long documents' shingles, the second, over what is
   left, takes all.
2. Regions. What is left is ordered by shingle frequency; two linked documents share a shingle of their
   prefixes, so the holders of a prefix shingle are a region whose documents may be near. Each region
   takes pivots, the document with the fewest shingles of its own first. Distances from documents to the
   pivots of their regions are computed exactly; a pivot's cell within EPS is linked by that alone.
3. Recursion. Regions of the same first pivot become one if that makes no more pairs: a group of near copies
   is in a region for each shingle of its prefixes, and one for all does. A region whose documents are not yet
   all in one component joins again around new pivots, those of its small components first. A document beyond a
   cell takes part in every region whose window it is in: with distances to the
   region's first pivot that differ by more than EPS (triangle inequality), with sizes that differ by
   more than a fifth, or with too many shingles of their own, a document and a pivot are not compared. Regions end when one component or one document
   is left, so every pair is compared, excluded by a proof, or connected already.

Sets travel as sorted 64-bit hashes; a region of any size is salted over tasks, each with the pivot's set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import bounded, join_groups, materialise
from mercato.llm.textbatch import Chunk, chunks, gram_hashes, mix, release, releasing, word_hashes

WORDS = 5
#: link at PERCENT / 100 or more
PERCENT = 80
EPS = 1 - PERCENT / 100
#: documents of more shingles are sampled by hash; two of a linked pair are both below LONG or both above SHORT
SHORT, LONG = 256, 320
SAMPLE = 0.4
#: text characters for each range of hashes in the screening
RANGE_CHARS = 10_000_000
#: hashed segments of a pivot's shingles, by which the overlap of two of its neighbours is bounded
SEGMENTS = 128
#: shingles that a task posts together, to keep its memory small
POSTED_AT_ONCE = 500_000
#: members of a region for each task that compares them with its pivot
REGION_TASK = 1000
#: pairs of a member and a pivot that are looked at together, and those of them whose segments are
PAIRS_AT_ONCE, SEGMENTS_AT_ONCE = 500_000, 10_000
#: pivots of a region that are compared with its members in one go, to keep a task's memory small
PIVOT_TASK = 128
_NO_DOC = 0xFFFF


def allowed(n):
    """How many of its ``n`` shingles a document can lose to a partner."""
    return n * (100 - PERCENT) // 100


def shingle_sets(chunk: Chunk) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    words = word_hashes(chunk)
    grams = gram_hashes(words, tuple(range(WORDS)))
    at, n = chunk.word_at[:-1], np.diff(chunk.word_at)
    whole = np.zeros(len(n), np.uint64)
    for size in range(1, WORDS):  # the whole sequence as one
        own = n == size
        if own.any():
            sums = sum((words[at[own] + k] * np.uint64(2 * k + 2 * size * size + 1) for k in range(size)), np.uint64(0))
            whole[own] = mix(mix(sums) + np.uint64(size))
    return [
        np.unique(grams[a : a + k - WORDS + 1]) if k >= WORDS else whole[i : i + (k > 0)]
        for i, (a, k) in enumerate(zip(at.tolist(), n.tolist()))
    ]


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _limit(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def screen(sets: DataFrame, ranges: int, share: float) -> DataFrame:
    """Distinct sets (digest, n, alone) that may have a partner; ``sets`` has the column text, or tokens.

    A task posts its batch's shingles, once each, to ranges of hashes: 32 bits of the hash and the
    document, or none if the batch has it more than once. A range finds the shingles posted once in all
    and returns their documents to their batches, where they are counted: alone. Of long documents only
    a ``share`` of the shingles counts, so alone is a lower bound there if the share is below 1.
    """
    low = _limit(share)
    ready = "tokens" in sets.columns

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        if ready:
            yield from (np.frombuffer(x, "<u8") for x in batch.column("tokens").to_pylist())
        else:
            for chunk in chunks(batch.column("text")):
                yield from shingle_sets(chunk)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 24
        for batch in batches:
            seen: set[bytes] = set()
            sizes, tokens, owners = [], [], []

            def rows(batch_id: int):
                token = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
                owner = np.concatenate(owners) if owners else np.zeros(0, np.uint16)
                spread = mix(token)
                to = (spread >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                key = (to << np.uint64(32)) | (token & np.uint64(0xFFFFFFFF))
                order = np.argsort(key, kind="stable")
                key, owner = key[order], owner[order]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                more = np.append(~first[1:], False)[first] if len(key) else first
                key, owner = key[first], np.where(more, np.uint16(_NO_DOC), owner[first]).astype("<u2")
                cuts = np.searchsorted(key >> np.uint64(32), np.arange(ranges + 1))
                low32 = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
                full = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(full, -1 - batch_id)), pa.array(np.full(len(full) + 1, batch_id)),
                     pa.array([low32[cuts[i] : cuts[i + 1]].tobytes() for i in full] + [np.array(sizes, "<i8").tobytes()], pa.binary()),
                     pa.array([owner[cuts[i] : cuts[i + 1]].tobytes() for i in full] + [b"".join(seen_order)], pa.binary())],
                    names=["range", "batch", "a", "b"],
                )

            seen_order: list[bytes] = []
            held = 0
            for s in of(batch):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    seen_order.append(d)
                    n, who = len(s), len(sizes)
                    sizes.append(n)
                    own = s if n <= LONG else s[s <= low]
                    tokens.append(own)
                    # between SHORT and LONG only sampled shingles count against the document
                    counted = (own <= low) if SHORT < n <= LONG else np.ones(len(own), bool)
                    owners.append(np.where(counted, np.uint16(who), np.uint16(_NO_DOC)))
                    held += len(own)
                    if held >= POSTED_AT_ONCE or len(sizes) == _NO_DOC - 1:
                        yield from rows(batch_id)
                        batch_id += 1
                        sizes, tokens, owners, seen_order = [], [], [], []
                        seen, held = set(), 0
            yield from rows(batch_id)
            batch_id += 1

    def single(part: pd.DataFrame) -> pd.DataFrame:
        if part["range"].iloc[0] < 0:  # what a batch says of its documents
            return part[["batch", "a", "b"]].assign(about=True)
        key = np.concatenate([np.frombuffer(x, "<u4") for x in part["a"]])
        owner = np.concatenate([np.frombuffer(x, "<u2") for x in part["b"]])
        batch = np.repeat(np.arange(len(part), dtype=np.int32), [len(x) // 4 for x in part["a"]])
        # hash and position in one number: sorted in place
        placed = key.astype(np.uint64) << np.uint64(32) | np.arange(len(key), dtype=np.uint64)
        placed.sort()
        new = np.ones(len(key) + 1, bool)
        new[1:-1] = np.diff(placed >> np.uint64(32)) != 0
        once = (placed[new[:-1] & new[1:]] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        once = once[owner[once] != _NO_DOC]
        once = once[np.argsort(batch[once], kind="stable")]
        cuts = np.searchsorted(batch[once], np.arange(len(part) + 1))
        return pd.DataFrame({
            "batch": part["batch"].to_numpy(), "a": [owner[once[cuts[i] : cuts[i + 1]]].tobytes() for i in range(len(part))],
            "b": [b""] * len(part), "about": False,
        })

    def lonely(part: pd.DataFrame) -> pd.DataFrame:
        found = single(part)
        if part["range"].iloc[0] >= 0:
            release()
        return found

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        about = part[part["about"]].iloc[0]
        sizes = np.frombuffer(about["a"], "<i8")
        alone = np.zeros(len(sizes), np.int64)
        for x in part["a"][~part["about"]]:
            alone += np.bincount(np.frombuffer(x, "<u2"), minlength=len(sizes))
        left = np.flatnonzero(alone <= allowed(sizes))
        return pd.DataFrame({"digest": [about["b"][16 * i : 16 * i + 16] for i in left], "n": sizes[left], "alone": alone[left]})

    posted = sets.select("tokens" if ready else "text").mapInArrow(releasing(post), "range long, batch long, a binary, b binary")
    told = posted.groupBy("range").applyInPandas(lonely, "batch long, a binary, b binary, about boolean")
    kept = told.groupBy("batch").applyInPandas(decide, "digest binary, n long, alone long")
    return kept.groupBy("digest").agg(F.first("n").alias("n"), F.max("alone").alias("alone"))


def read_sets(docs: DataFrame, left: DataFrame) -> DataFrame:
    """Every document (uid, doc_id, n, digest), with its set where the digest is ``left``; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            doc_ids, i = batch.column("doc_id"), 0
            for chunk in chunks(batch.column("text")):
                sets = shingle_sets(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(len(sets))), doc_ids.slice(i, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["uid", "doc_id", "n", "digest", "tokens"],
                )
                uid, i = uid + len(sets), i + len(sets)

    rows = docs.mapInArrow(releasing(run), "uid long, doc_id long, n long, digest binary, tokens binary")
    flagged = rows.join(bounded(left.select("digest", F.lit(True).alias("open"))), "digest", "left")
    return materialise(flagged.select("uid", "doc_id", "n", "digest", F.when(F.col("open"), F.col("tokens")).alias("tokens")), "jaccard-sets")


def covered(sets: DataFrame, share: float) -> bool:
    """Whether every long set has more sampled shingles than it can lose."""
    low = _limit(share)

    def short_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tokens in part["tokens"]:
                s = np.frombuffer(tokens, "<u8")
                if (s <= low).sum() <= allowed(len(s)):
                    yield pd.DataFrame({"n": [len(s)]})

    return sets.where(F.col("n") > SHORT).select("tokens").mapInPandas(short_of, "n long").limit(1).count() == 0


def prefixes(sets: DataFrame, share: float) -> DataFrame:
    """Prefix postings (region, c): the rarest shared shingles of each set, as many as it can
    lose and one more, not counting those that it shares with nobody."""
    low = _limit(share)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, tokens in zip(batch.column("c").to_pylist(), batch.column("tokens").to_pylist()):
                s = np.frombuffer(tokens, "<u8")
                for own, mark in ((s if len(s) <= LONG else s[:0], 1), (s[s <= low] if len(s) > SHORT else s[:0], 0)):
                    if len(own):
                        key = (own << np.uint64(1)) | np.uint64(mark)  # the two universes don't meet
                        k = len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(np.full(k, c)), pa.array(np.full(k, len(s))), pa.array(np.full(k, k)), pa.array(np.full(k, mark))],
                            names=["region", "c", "n", "posted", "mark"],
                        )

    posted = materialise(sets.select("c", "tokens").mapInArrow(releasing(post), "region long, c long, n long, posted long, mark long"), "jaccard-postings")
    often = posted.groupBy("region").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = posted.join(often, "region")
    own = Window.partitionBy("c", "mark")
    ranked = shared.withColumn("rn", F.row_number().over(own.orderBy("df", "region"))).withColumn(
        "alone", F.col("posted") - F.count(F.lit(1)).over(own)
    )
    lose = F.floor(F.col("n") * (100 - PERCENT) / 100)
    return ranked.where(F.col("rn") <= lose + 1 - F.col("alone")).select("region", "c")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact (p, c, both, either, parts) of pairs of a pivot and a member: sizes of intersection and union,
    and how much of the intersection falls into each segment of hashes."""
    load = pairs.groupBy("p").agg(F.count(F.lit(1)).alias("members"))
    tasks = F.ceil(F.col("members") / REGION_TASK)
    salted = pairs.join(load, "p").select("p", "c", F.pmod(F.xxhash64("c"), tasks).cast("int").alias("salt"))
    salted = materialise(salted, "jaccard-pairs")
    held = sets.select("c", "tokens")
    members = held.join(bounded(salted), "c").select("p", "salt", F.lit(1).alias("kind"), "c", "tokens")
    centres = salted.select("p", "salt").distinct()
    pivots = held.withColumnRenamed("c", "p").join(centres, "p").select("p", "salt", F.lit(0).alias("kind"), F.col("p").alias("c"), "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for p, kind, c, tokens in zip(*(batch.column(x).to_pylist() for x in ("p", "kind", "c", "tokens"))):
                s = np.frombuffer(tokens, "<u8")
                if not kind:
                    pivot = s
                else:
                    at = np.searchsorted(pivot, s)
                    shared = s[pivot[np.minimum(at, len(pivot) - 1)] == s]
                    both = len(shared)
                    segment = ((shared * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(SEGMENTS)
                    out.append((p, c, both, len(s) + len(pivot) - both, np.bincount(segment.astype(np.int64), minlength=SEGMENTS)))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["p", "c", "both", "either", "parts"]
            )

    dealt = pivots.unionByName(members).repartition("p", "salt").sortWithinPartitions("p", "salt", "kind")
    return materialise(dealt.select("p", "kind", "c", "tokens").mapInArrow(releasing(compare), "p long, c long, both long, either long, parts array<int>"), "jaccard-distances")


def components(links: DataFrame) -> DataFrame:
    """(c, label) of the nodes of ``links`` (p, c): the least node of each component, by taking the least
    label around and following labels until nothing changes."""
    both = materialise(links.select("p", "c").unionByName(links.select(F.col("c").alias("p"), F.col("p").alias("c"))).distinct(), "links")
    labels = materialise(both.groupBy("c").agg(F.least(F.min("p"), F.col("c")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("c").alias("p"), "label"), "p").groupBy("c").agg(F.min("label").alias("near"))
        least = labels.join(around, "c").select("c", "label", F.least("label", "near").alias("new"))
        # follow one step: a label is a node and has a label itself
        jump = labels.select(F.col("c").alias("new"), F.col("label").alias("next"))
        moved = materialise(least.join(jump, "new", "left").select("c", "label", F.least("new", F.coalesce("next", "new")).alias("to")), "labels")
        changed = moved.where("label <> to").limit(1).count()
        labels = moved.select("c", F.col("to").alias("label"))
        if not changed:
            return labels


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` (p, c) more: only the components that they join are looked at."""
    if labels is None:
        return components(links)
    known = bounded(labels.select(F.col("c").alias("__node"), "label"))
    for end in ("p", "c"):
        links = links.join(known, F.col(end) == F.col("__node"), "left").withColumn(end, F.coalesce("label", end)).drop("__node", "label")
    step = components(links)
    nodes = labels.unionByName(step.select("c", F.col("c").alias("label")).join(labels, "c", "left_anti"))
    moved = bounded(step.select(F.col("c").alias("label"), F.col("label").alias("to")))
    return materialise(nodes.join(moved, "label", "left").select("c", F.coalesce("to", "label").alias("label")), "labels")


def _open(regions: DataFrame, key: list[str]) -> DataFrame:
    """What of ``regions`` (key, c, n, own, label) is still to be compared: members that could link with the
    smallest member at best, in regions that have more than one component of them."""
    least = regions.groupBy(key).agg(F.min("n").alias("__least"))
    alive = regions.join(least, key).where(_may_link(F.col("n"), F.col("own"), F.col("__least"), F.col("own"))).drop("__least")
    mixed = alive.groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(key)
    return materialise(alive.join(mixed, key, "left_semi"), "jaccard-open")


def united(regions: DataFrame) -> DataFrame:
    """``regions`` (p, region, c, n, own, label) where those of one first pivot ``p`` are one, numbered 0, if its members make no
    more pairs than theirs together: a group of near copies is in a region for each shingle of its prefixes."""
    apart = regions.groupBy("p", "region").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("p").agg(F.sum(F.col("k") * F.col("k")).alias("apart"))
    whole = regions.select("p", "c").distinct().groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("k"))
    as_one = materialise(apart.join(whole, "p").where("k * k <= apart").select("p"), "jaccard-united")
    one = regions.join(bounded(as_one), "p", "left_semi").withColumn("region", F.lit(0).cast("long")).distinct()
    return one.unionByName(regions.join(bounded(as_one), "p", "left_anti"))


def _may_link(n, own, m, other):
    """Whether sets of ``n`` and ``m`` shingles can link, of which at most ``own`` and ``other`` are not theirs alone."""
    return F.least(own, other) * (100 + PERCENT) >= (n + m) * PERCENT


def near_pairs(members: dict[str, np.ndarray], pivots: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of members and pivots of a region that have different labels and can link as far as is known:
    by their sizes, by their distances to the region's first pivot, and by their overlaps with it: inside it at most
    the smaller of both in each segment, outside it at most what the one has there that is not its alone.

    A member has n, own, label, far, got, parts; far is nan where the first pivot wasn't compared.
    """
    at, to = [], []
    step = max(1, PAIRS_AT_ONCE // max(1, len(members["n"])))
    for start in range(0, len(pivots["n"]), step):
        p = {x: v[start : start + step] for x, v in pivots.items()}
        n, m = members["n"][:, None], p["n"][None, :]
        may = members["label"][:, None] != p["label"][None, :]
        may &= np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT
        may &= np.minimum(members["own"][:, None], p["own"][None, :]) * (100 + PERCENT) >= (n + m) * PERCENT
        may &= ~(np.abs(members["far"][:, None] - p["far"][None, :]) > EPS + 1e-9)  # true for nan
        x, y = np.nonzero(may)
        for cut in range(0, len(x), SEGMENTS_AT_ONCE):
            i, j = x[cut : cut + SEGMENTS_AT_ONCE], y[cut : cut + SEGMENTS_AT_ONCE]
            inside = np.minimum(members["parts"][i], p["parts"][j]).sum(axis=1, dtype=np.int64)
            outside = np.minimum(members["own"][i] - members["got"][i], p["own"][j] - p["got"][j])
            enough = (inside + outside) * (100 + PERCENT) >= (members["n"][i] + p["n"][j]) * PERCENT
            enough |= np.isnan(members["far"][i]) | np.isnan(p["far"][j])
            at.append(i[enough])
            to.append(j[enough] + start)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *to])


def _groups(batch: pa.RecordBatch, key: list[str]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """The stretches of rows of one ``key``: its values, first row and end."""
    column = [batch.column(x).to_numpy(zero_copy_only=False) for x in key]
    changes = np.zeros(max(0, batch.num_rows - 1), bool)
    for x in column:
        changes |= x[1:] != x[:-1]
    cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield tuple(int(x[a]) for x in column), a, b


def candidates(ranked: DataFrame, pivots: int) -> DataFrame:
    """Blocks (p, region, salt, part, kind, c, label) of up to PIVOT_TASK of a region's first ``pivots`` members by k (kind 0) and
    members (kind 1) to compare: those with a pair that :func:`near_pairs` doesn't exclude. A region of any size is
    salted over tasks, each with all the pivots."""
    held = ["p", "region", "salt", "kind", "c", "n", "own", "label", "far", "got", "parts"]
    tasks = F.ceil(F.col("members") / REGION_TASK).cast("int")
    rows = ranked.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("p", "region")))
    centres = rows.where(F.col("k") <= pivots).withColumn("kind", F.lit(0)).withColumn("salt", F.explode(F.sequence(F.lit(0), tasks - 1)))
    others = rows.withColumn("kind", F.lit(1)).withColumn("salt", F.pmod(F.xxhash64("c"), tasks).cast("int"))
    dealt = centres.select(held).unionByName(others.select(held)).repartition("p", "region", "salt").sortWithinPartitions("p", "region", "salt", "kind", "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, centre = None, [], {}
        for batch in batches:
            column = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "n", "own", "label")}
            column["far"] = batch.column("far").to_numpy(zero_copy_only=False).astype(float)
            column["got"] = batch.column("got").fill_null(0).to_numpy(zero_copy_only=False)
            column["parts"] = np.zeros((batch.num_rows, SEGMENTS), np.int32)
            known = batch.column("parts").is_valid().to_numpy(zero_copy_only=False)
            column["parts"][known] = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(-1, SEGMENTS)
            for (*now, kind), a, b in _groups(batch, ["p", "region", "salt", "kind"]):
                block = {x: v[a:b] for x, v in column.items()}
                if kind == 0:
                    group, first, centre = now, (first if now == group else []) + [block], {}
                    continue
                centre = centre or {x: np.concatenate([f[x] for f in first]) for x in block}
                i, j = near_pairs(block, centre)
                part = j // PIVOT_TASK
                for k in np.unique(part).tolist():
                    ours, theirs = np.unique(j[part == k]), np.unique(i[part == k])
                    size = len(ours) + len(theirs)
                    where = [pa.array(np.full(size, x, kind)) for x, kind in zip((*now, k), ("i8", "i8", "i4", "i4"))]
                    kinds = pa.array(np.repeat(np.array([0, 1], "i4"), [len(ours), len(theirs)]))
                    what = [pa.array(np.concatenate([centre[x][ours], block[x][theirs]])) for x in ("c", "label")]
                    yield pa.RecordBatch.from_arrays([*where, kinds, *what], names=["p", "region", "salt", "part", "kind", "c", "label"])

    # members may come in two batches, each with its pivots
    return dealt.mapInArrow(releasing(compare), "p long, region long, salt int, part int, kind int, c long, label long").distinct()


def block_links(blocks: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (p, c) of a block's pivots and members that have different labels, by the exact sizes of their intersections.
    A set travels once for each of its blocks."""
    key = ["p", "region", "salt", "part", "kind"]
    rows = sets.select("c", "n", "tokens").join(bounded(blocks), "c").select(*key, "c", "n", "label", "tokens")
    dealt = rows.repartition(*key[:-1]).sortWithinPartitions(*key, "c")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, token = None, [], None
        for batch in batches:
            c, n, label = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "n", "label"))
            out = []
            for (*now, kind), a, b in _groups(batch, key):
                tokens = [np.frombuffer(x, "<u8") for x in batch.column("tokens").slice(a, b - a).to_pylist()]
                if kind == 0:
                    group, first, token = now, (first if now == group else []) + [(c[a:b], n[a:b], label[a:b], tokens)], None
                    continue
                if token is None:
                    pivot, size, of = (np.concatenate([f[x] for f in first]) for x in range(3))
                    held = [t for f in first for t in f[3]]
                    token = np.concatenate(held)
                    order = np.argsort(token, kind="stable")
                    token, owner = token[order], np.repeat(np.arange(len(held)), [len(t) for t in held])[order]
                for x, s in enumerate(tokens, a):
                    low, high = np.searchsorted(token, s), np.searchsorted(token, s, side="right")
                    count = high - low
                    at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                    both = np.bincount(owner[at], minlength=len(pivot))
                    link = (both * (100 + PERCENT) >= (size + n[x]) * PERCENT) & (of != label[x])
                    out.append((pivot[link], np.full(link.sum(), c[x])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["p", "c"])

    return materialise(dealt.mapInArrow(releasing(compare), "p long, c long"), "jaccard-links")


def link_sets(sets: DataFrame, share: float) -> DataFrame | None:
    """(c, label) of the sets (c, n, own, tokens) that link with another; None if none does."""
    if share < 1 and not covered(sets, share):
        share = 1.0
    posted = materialise(prefixes(sets, share), "jaccard-prefixes")
    # regions with the same members make the same comparisons: one of them is enough
    members = posted.groupBy("region").agg(
        F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y")
    )
    distinct = members.where("k > 1").groupBy("k", "x", "y").agg(F.min("region").alias("region")).select("region")
    facts = materialise(sets.select("c", "n", "own"), "jaccard-facts")
    regions = posted.join(distinct, "region", "left_semi").join(bounded(facts), "c")
    open_ = _open(regions.select("region", "c", "n", "own", F.col("c").alias("label")), ["region"])
    if not open_.limit(1).count():
        return None
    # a document of few shingles of its own is central: many are near to it
    central = Window.partitionBy("region").orderBy(F.col("n") - F.col("own"), "c")
    centre = materialise(
        open_.withColumn("k", F.row_number().over(central)).where("k = 1").select("region", F.col("c").alias("p"), F.col("n").alias("pn"), F.col("own").alias("po")),
        "jaccard-pivots",
    )
    cells = open_.join(centre, "region").where("c <> p")
    near_in_size = F.least("n", "pn") * 100 >= F.greatest("n", "pn") * PERCENT
    met = cells.where(near_in_size & _may_link(F.col("n"), F.col("own"), F.col("pn"), F.col("po")))
    measured = distances(met.select("p", "c").distinct(), sets)
    labels = linked(None, measured.where(F.col("both") * 100 >= F.col("either") * PERCENT).select("p", "c"))
    open_ = united(_open(relabelled(cells.select("p", "region", "c", "n", "own", "label"), labels), ["p", "region"]))
    # the distance to the region's first pivot is what windows compare
    apart = measured.select("p", "c", (1 - F.col("both") / F.col("either")).alias("far"), F.col("both").alias("got"), "parts")
    open_ = materialise(open_.join(apart, ["p", "c"], "left"), "jaccard-cells")
    # members of a region's small components go first: once they are compared, one component is left
    count = F.count(F.lit(1)).over(Window.partitionBy("p", "region", "label"))
    order = Window.partitionBy("p", "region").orderBy("size", F.col("n") - F.col("own"), "c")
    pivots = 4
    while open_.limit(1).count():
        ranked = materialise(open_.withColumn("size", count).withColumn("k", F.row_number().over(order)).drop("size"), "jaccard-pivots")
        labels = linked(labels, block_links(materialise(candidates(ranked, pivots), "jaccard-blocks"), sets))
        open_ = _open(relabelled(ranked.where(F.col("k") > pivots).drop("k"), labels), ["p", "region"])
        pivots *= 4
    return labels


def linked(labels: DataFrame | None, found: DataFrame) -> DataFrame | None:
    """``labels`` after the links ``found``, if any."""
    return joined(labels, found) if found.limit(1).count() else labels


def relabelled(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return regions
    return regions.drop("label").join(bounded(labels), "c", "left").withColumn("label", F.coalesce("label", "c"))


def near_duplicates(docs: DataFrame, share: float = SAMPLE) -> DataFrame:
    """Components of ``docs`` (doc_id, text) under links of Jaccard similarity 0.8 or more.

    Words are the runs of other than white space after lower-casing A-Z. Returns a row per row: doc_id,
    n_shingles (distinct shingles of five words; with fewer words the whole sequence is one), and
    component_id, the least doc_id that links reach. Null texts and texts without words have no shingle
    and link with nothing; repeated rows link with each other; null ids count for no component. An empty
    table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = max(16, -(-chars // RANGE_CHARS))
    left = materialise(screen(rows, ranges, share), "jaccard-left")
    all_docs = read_sets(rows, left)
    members = all_docs.select("doc_id", "n", "digest")
    # one set for each digest that is left: the row of least uid has it
    firsts = materialise(
        all_docs.where("tokens is not null").groupBy("digest").agg(F.min("uid").alias("uid")).select("uid", F.lit(True).alias("one")), "jaccard-firsts"
    )
    sets = materialise(
        all_docs.where("tokens is not null").join(bounded(firsts), "uid").select(F.col("uid").alias("c"), "n", "digest", "tokens"), "jaccard-distinct"
    )
    # the same screening again over what is left, by all shingles
    near = materialise(screen(sets, ranges, 1.0), "jaccard-near").select("digest", (F.col("n") - F.col("alone")).alias("own"))
    sets = materialise(sets.join(bounded(near), "digest"), "jaccard-candidates")
    labels = link_sets(sets, share)
    groups = members.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    if labels is None:
        placed = groups.withColumnRenamed("least", "component_id")
    else:
        of = sets.select("c", "digest").join(labels, "c").select("digest", "label")
        named = materialise(groups.join(of, "digest", "left"), "jaccard-groups")
        least = named.where("label is not null").groupBy("label").agg(F.min("least").alias("component_id"))
        placed = named.join(least, "label", "left").select("digest", "copies", F.coalesce("component_id", "least").alias("component_id"))
    placed = materialise(placed, "jaccard-placed")
    with_words = join_groups(members.where("n > 0"), placed, "digest", "copies", members.count())
    return with_words.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with all their columns: of each component the row of least doc_id, and every row without
    words. Rows that share the doc_id that stays stay with it; a null id stays only where it links with
    no other."""
    found = near_duplicates(docs)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = materialise(found.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("not stays").select(F.col("doc_id").alias("__gone")), "jaccard-gone")
    return docs.join(bounded(gone), docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")), "left_anti")
