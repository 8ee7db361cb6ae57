"""Mixing sources to target weights.

Each source's words are packed, document after document in a fixed pseudorandom order, into blocks of
a fixed length. The mix is a list of slots in output shards: every shard draws its source counts from
a multinomial of the target weights, a source's draws are numbered over the shards, and draw ``j``
takes the block at place ``j`` of pseudorandom permutations of that source's block numbers, one after
another. So a block is never used again before all blocks of its source have been used. The draws key the
permutations: they decide how many of a shard's slots each source fills, and which blocks fill them.
Multinomial noise would leave a source some draws above or below its quota: draws beyond a quota are handed,
in order, to the sources that miss some. Blocks and slots meet by (source, block number).

The targets need one small row per source on the driver; documents, blocks and slots stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import WORD, materialise, prefix_positions, text_or_empty
from mercato.llm.textbatch import chunks, mix, releasing

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix over words of the corpus
MOST = 2.0  # of a source's size
BLOCK_WORDS = 64
#: for a mix that is to be read: no text is cut into shorter stretches, but at a document's end
TEXT_BLOCK_WORDS = 256
SHARD_SLOTS = 16_384
#: slots that a task maps
SLOTS_A_TASK = 500_000
SEED = 20_260_101


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Split ``share * sum(sizes)`` by weight; none above ``most`` times its size, the excess going to
    the others by weight until none is above."""
    caps = [most * s for s in sizes]
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        heavy = sum(weights[i] for i in free)
        above = sorted(i for i in free if rest * weights[i] / heavy > caps[i])
        if not above:
            for i in free:
                out[i] = rest * weights[i] / heavy
            break
        for i in above:
            out[i] = caps[i]
            free.discard(i)
        rest = max(0.0, share * sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free))
    return out


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``0 .. n - 1`` at the places ``j``: a four-round Feistel network
    over the next even number of bits, walked until it falls below ``n``."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.arange(4, dtype=np.uint64) + np.uint64(key % (1 << 60)) * np.uint64(8))
    x = j.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= np.uint64(n)
    return x.astype(np.int64)


def block_pieces(docs: DataFrame, block_words: int) -> DataFrame:
    """Pieces of documents in blocks: ``docs`` has source_ix, doc_id, size and at (words before it in
    its source); returns them with block, start (words of the document before the piece), length."""
    last = F.floor((F.col("at") + F.col("size") - 1) / block_words)
    spans = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block_words), last)))
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    return spans.withColumn("start", begin - F.col("at")).withColumn("length", end - begin)


def mixed_sources(docs: DataFrame) -> tuple[DataFrame, pd.DataFrame]:
    """The sized documents (doc_id, source, source_ix, size, at), written once, and a row per source."""
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text_or_empty(docs), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text_or_empty(docs)).alias("text_hash"),
        ),
        "mix-sizes",
    )
    # one small row per source
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).toPandas()
    per = per.iloc[sorted(range(len(per)), key=lambda i: ((s := per["source"].iloc[i]) is None, s or ""))].reset_index(drop=True)
    per["source_ix"] = np.arange(len(per))
    per["target"] = targets(per["source_size"].tolist(), [WEIGHTS[i % len(WEIGHTS)] for i in range(len(per))])
    spark = docs.sparkSession
    known = spark.createDataFrame(
        [(s, int(i), int(z), float(t)) for s, i, z, t in per[["source", "source_ix", "source_size", "target"]].itertuples(index=False)],
        "name string, source_ix int, source_size long, target double",
    )
    sized = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["name"])).drop("name")
    placed = prefix_positions(sized, "source_ix", ["doc_id", "text_hash"], F.col("size"), "at")
    return materialise(placed, "mix-places"), per


def slots(spark, per: pd.DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix as (shard, source_ix, block, epoch): every slot of every output shard."""
    size, target = per["source_size"].to_numpy(np.int64), per["target"].to_numpy(float)
    blocks = -(-size // block_words)
    with np.errstate(divide="ignore", invalid="ignore"):
        quota = np.where(size > 0, np.rint(target * blocks / size), 0).astype(np.int64)
    quota = np.minimum(quota, 2 * blocks)
    total = int(quota.sum())
    shards = -(-total // shard_slots)
    if not total:
        return spark.createDataFrame([], "shard long, source_ix int, block long, epoch int")
    chance = quota / total

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard in part["id"].tolist():
                rng = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, shard]))
                drawn = rng.multinomial(min(shard_slots, total - shard * shard_slots), chance)
                yield pd.DataFrame({"shard": shard, "source_ix": np.arange(len(drawn), dtype=np.int32), "drawn": drawn})

    counts = materialise(
        spark.range(shards).mapInPandas(draw, "shard long, source_ix int, drawn long").where("drawn > 0"), "mix-draws"
    )
    numbered = prefix_positions(counts, "source_ix", ["shard"], F.col("drawn"), "first")
    got, keys = np.zeros(len(per), np.int64), np.zeros(len(per), np.int64)  # one row per source
    for row in counts.groupBy("source_ix").agg(F.sum("drawn").alias("n"), F.bit_xor(F.xxhash64("shard", "drawn")).alias("key")).collect():
        got[row["source_ix"]], keys[row["source_ix"]] = row["n"], row["key"] & ((1 << 40) - 1)
    spare, short = np.maximum(got - quota, 0), np.maximum(quota - got, 0)
    spare_at, short_at = np.cumsum(spare) - spare, np.cumsum(short)

    def take(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, ix, drawn, first in part[["shard", "source_ix", "drawn", "first"]].itertuples(index=False):
                j = np.arange(first, first + drawn, dtype=np.int64)
                to = np.full(len(j), ix, np.int64)
                over = j >= quota[ix]
                if over.any():  # hand the spare draws to the sources that miss some
                    rank = spare_at[ix] + j[over] - quota[ix]
                    to[over] = taker = np.searchsorted(short_at, rank, side="right")
                    j[over] = got[taker] + rank - (short_at[taker] - short[taker])
                block, epoch = np.empty(len(j), np.int64), np.empty(len(j), np.int32)
                for s in np.unique(to):
                    own = to == s
                    epoch[own] = j[own] // blocks[s]
                    for e in np.unique(epoch[own]):
                        at = own & (epoch == e)
                        block[at] = permute(j[at] % blocks[s], int(blocks[s]), seed + int(keys[s]) + 1009 * int(s) + int(e))
                yield pd.DataFrame({"shard": shard, "source_ix": to.astype(np.int32), "block": block, "epoch": epoch})

    # the few draws become many slots: dealt out before, by shard
    tasks = -(-total // SLOTS_A_TASK)
    return numbered.select("shard", "source_ix", "drawn", "first").repartition(tasks, "shard").mapInPandas(
        take, "shard long, source_ix int, block long, epoch int"
    )


def mix_sources(
    docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Mix ``docs`` (doc_id, text, source) to the target weights.

    Returns the documents (doc_id, source, source_ix, source_size, target, size, at, text_hash) and the pieces of
    the mix (shard, epoch, source_ix, block, at, doc_id, start, length): in that slot the mix takes
    ``length`` words of the document, from its word ``start`` on. Sources count in code point order,
    null last, and weigh 5, 2, 1, 5, ...; a null or wordless text has size 0 and takes no part; rows
    that repeat a doc_id are told apart by ``at`` (within a source). Reruns on the same rows agree.
    An empty table gives no rows. Other columns are ignored.
    """
    placed, per = mixed_sources(docs)
    pieces = block_pieces(placed.select("source_ix", "doc_id", "size", "at"), block_words)
    drawn = slots(docs.sparkSession, per, block_words, shard_slots, seed)
    return placed, drawn.join(pieces.hint("merge"), ["source_ix", "block"]).select(
        "shard", "epoch", "source_ix", "block", "at", "doc_id", "start", "length"
    )


def taken_words(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """``placed`` with the columns taken (words of the document in the mix, repeats counted) and first_shard
    (the first output shard that has some of them; null: none)."""
    taken = pieces.groupBy("source_ix", "at").agg(F.sum("length").alias("taken"), F.min("shard").alias("first_shard"))
    some = placed.where("size > 0").join(taken, ["source_ix", "at"], "left")
    none = placed.where("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("long")})
    return some.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).unionByName(none)


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each pass over a source's blocks (epoch), a
    row for every contiguous stretch of words that it takes of a document, whose text is those words with the
    white space after them (the whole text if all are taken), and n_chars, if there, its length. No text holds
    words that didn't follow each other.

    Null and wordless texts are not in a mix; an empty table gives no rows. Of rows that repeat doc_id, source
    and text, one (by a hash of its columns) takes the words of all. Columns may have any names but those that
    begin with ``__mix_``.
    """
    placed, pieces = mix_sources(docs, block_words)
    # of the mix a document's spans, narrow, meet its text
    spans = pieces.groupBy("source_ix", "at", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__mix_spans"))
    spans = spans.join(placed.where("size > 0").select("source_ix", "at", "doc_id", "source", "text_hash"), ["source_ix", "at"]).select(
        F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("text_hash").alias("__mix_hash"), "__mix_spans"
    )
    columns = docs.columns
    keyed = docs.withColumn("__mix_text", F.xxhash64(text_or_empty(docs)))
    if placed.groupBy("doc_id", "source", "text_hash").count().where("count > 1").limit(1).count():
        hashable = [c for c, kind in docs.dtypes if "map<" not in kind]
        nth = F.row_number().over(Window.partitionBy("doc_id", "source", "__mix_text").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in hashable])))
        keyed = keyed.withColumn("__mix_nth", nth).where("__mix_nth = 1").drop("__mix_nth")
    same = keyed["doc_id"].cast("long").eqNullSafe(F.col("__mix_id")) & keyed["source"].eqNullSafe(F.col("__mix_source"))
    taken = keyed.join(spans, same & (F.col("__mix_text") == F.col("__mix_hash"))).select(*columns, "__mix_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), lower=False):
                rows, of, texts = batch.slice(chunk.first, chunk.docs), [], []
                # a word's piece runs to the next word; the first one has what comes before it
                for i, spans in enumerate(rows.column("__mix_spans").to_pylist()):
                    first, last = int(chunk.word_at[i]), int(chunk.word_at[i + 1])
                    edges = np.append(chunk.starts[first:last], chunk.at[i + 1])
                    edges[0] = chunk.at[i]
                    stretches: list[list[int]] = []
                    for s in spans:
                        if stretches and stretches[-1][1] == s["start"]:
                            stretches[-1][1] += s["length"]
                        else:
                            stretches.append([s["start"], s["start"] + s["length"]])
                    texts += [chunk.data[edges[a] : edges[b]].tobytes().decode("utf-8", "replace") for a, b in stretches]
                    of += [i] * len(stretches)
                rows = rows.take(pa.array(of, pa.int64()))
                arrays = [pa.array(texts, pa.string()) if c == "text" else rows.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = taken.mapInArrow(releasing(cut), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else out
