"""Byte-balanced shards by Karmarkar-Karp differencing.

Equal texts form one indivisible group. A partial partition is a vector of bin sizes; differencing
repeatedly takes the two partial partitions of largest spread and adds them oppositely ordered (the
largest bin of one onto the smallest of the other), until one is left.

Differencing is sequential, so it runs in blocks: groups are dealt by hash into blocks, each block's
task differences its groups into BUNDLES bundles of nearly equal size, and the bundles are the
indivisible items of the next round, until one block is left, which is differenced into the shards.
A group larger than its block's other bundles stays a bundle of its own, so the last round still
balances it against everything else; a hashed half block of single groups joins only there, as small
change. No task ever holds more than about two blocks.
"""

from __future__ import annotations

import heapq
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import join_groups, materialise, prefix_positions, text_or_empty

#: items differenced in one task, and the bundles that a block becomes
BLOCK_ITEMS = 16_384
BUNDLES = 128


def difference(sizes: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each item, by differencing into ``bins`` bins. Ties fall to the earlier partition."""
    if len(sizes) <= bins:
        return np.argsort(np.argsort(-sizes, kind="stable"), kind="stable")
    # a partial partition: bin sizes, descending, and for each bin the items in it as a chain of
    # (left, right) pairs; the heap holds (-spread, order of making, sizes, chains)
    made = count()
    heap = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, next(made), [size] + [0] * (bins - 1), [i] + [None] * (bins - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, chain_a = heapq.heappop(heap)
        _, _, b, chain_b = heapq.heappop(heap)
        both = sorted(
            ((x + y, c if d is None else d if c is None else (c, d)) for x, y, c, d in zip(a, reversed(b), chain_a, reversed(chain_b))),
            key=lambda z: -z[0],
        )
        bin_sizes, chains = [z[0] for z in both], [z[1] for z in both]
        heapq.heappush(heap, (bin_sizes[-1] - bin_sizes[0], next(made), bin_sizes, chains))
    out = np.zeros(len(sizes), np.int64)
    for k, chain in enumerate(heap[0][3]):
        todo = [] if chain is None else [chain]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                out[x] = k
    return out


def _differ(items: pd.DataFrame, bins: int) -> pd.DataFrame:
    items = items.sort_values(["size", "item"], ascending=[False, True], kind="stable", ignore_index=True)
    return pd.DataFrame({"item": items["item"], "size": items["size"], "bin": difference(items["size"].to_numpy(), bins)})


def assign_bins(groups: DataFrame, bins: int, block_items: int = BLOCK_ITEMS, bundles: int = BUNDLES) -> DataFrame:
    """``groups`` (item binary, size long) with the column ``shard`` in ``0 .. bins - 1``."""
    items = groups.select("item", "size")
    levels: list[DataFrame] = []
    n = items.count()
    loose = items.limit(0)
    if n > block_items:  # about half a block of single groups wait for the last round, to even it out
        share = F.pmod(F.xxhash64("item", F.lit("loose")), F.lit(1 << 40)) < int((1 << 40) * (block_items / 2) / n)
        loose, items = items.where(share), items.where(~share)
    while n > block_items:
        blocks = -(-n // (block_items // 2))
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(blocks)))
        differed = dealt.groupBy("block").applyInPandas(
            lambda key, part: _differ(part, bundles).assign(block=key[0]), "item binary, size long, bin long, block long"
        )
        level = materialise(
            differed.select(
                "item", "size", F.unhex(F.sha2(F.concat_ws(":", F.lit(len(levels)), "block", "bin"), 256)).alias("bundle")
            ),
            f"bundles-{len(levels)}",
        )
        levels.append(level.select("item", "bundle"))
        items = materialise(level.groupBy(F.col("bundle").alias("item")).agg(F.sum("size").alias("size")), "bundle-sizes")
        m = items.count()
        if m >= n:  # every block holds giants only
            break
        n = m
    out = (
        items.unionByName(loose).groupBy().applyInPandas(lambda part: _differ(part, bins), "item binary, size long, bin long")
        .select("item", F.col("bin").alias("shard"))
    )
    if not levels:
        return out
    out = materialise(out, "last-round")
    singles = out.join(loose.select("item"), "item", "left_semi")
    for level in reversed(levels):
        out = level.join(out.withColumnRenamed("item", "bundle"), "bundle").select("item", "shard")
    return out.unionByName(singles)


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put ``docs`` (doc_id, text) into ``shards`` shards of nearly equal bytes, equal texts together.

    Returns a row per row of ``docs``: doc_id, size (UTF-8 bytes of the text plus 1; null text: 1),
    text_crc32, shard, slot (gapless from 0 in a shard, in a fixed pseudorandom order). Null and empty
    texts are equal. A group larger than a shard's share makes its shard larger; the others stay even.
    An empty table gives no rows. Columns besides doc_id and text are ignored.
    """
    text = text_or_empty(docs)
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("item"),
        ),
        "shard-rows",
    )
    groups = materialise(
        rows.groupBy("item").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "shard-groups"
    )
    placed = materialise(groups.join(assign_bins(groups, shards), "item").select("item", "n", "shard"), "shard-places")
    total = rows.count()
    located = materialise(join_groups(rows, placed, "item", "n", total), "shard-located")
    return prefix_positions(located, "shard", ["doc_id", "item"], F.lit(1), "slot").select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot"
    )
