"""Join helpers: broadcast only behind a size check, referential-integrity orphans, outer joins that deal a
hot key of the side that isn't preserved to many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side is broadcast only when it is proven to hold at most this many rows.
DEFAULT_BROADCAST_ROWS = 200_000
# A hot key's rows are dealt in pieces of a partition's share divided by this: hashing spreads small pieces evenly.
PIECES = 8


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain count: each task sends one number, and on a Parquet table reads no column. A limit before it
    would ship up to ``max_rows + 1`` rows of every task to a single one.
    """
    return df.count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` when ``df`` is proven small, else ``df`` unchanged (a shuffle join; AQE may
    still switch to a broadcast at run time from measured sizes)."""
    return F.broadcast(df) if has_at_most(df, max_rows) else df


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of ``child`` whose non-null ``fk`` has no ``pk`` in ``parent`` (a null reference is legal).

    A left-anti join: only the parent's key column is read; Spark shuffles both sides on the key
    (or broadcasts the parent when it is small).
    """
    keys = parent.select(F.col(pk).alias("__pk"))
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__pk"), "left_anti")


def deal_hot_keys(
    preserved: DataFrame, key: str, other: DataFrame, other_key: str, tag: str = "", partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides of an outer join that preserves ``preserved``, ready to be joined on ``key = other_key``
    and ``__salt = __salt``, such that no key of ``other`` fills more than about one of ``partitions`` tasks
    (default: ``spark.sql.shuffle.partitions``).

    AQE can't split the side that isn't preserved, as an unmatched row must be extended once. A key is hot
    when it holds more than a piece of ``other``'s rows, a partition's share divided by PIECES; there are
    fewer such keys than pieces, so their broadcast is bounded. Its rows are dealt over a salt a piece, by a
    hash of the row, and the preserved rows of that key get a copy for each salt. Of the joined rows those
    with ``__there`` null and ``__hot`` true must go: a hot key has rows, so they are copies of rows that met
    theirs under another salt; rows of any other key are extended once, as ever.

    New columns, ended by ``tag``: ``__salt`` and ``__hot`` on the preserved side, ``__salt`` and ``__there``
    on the other. Null keys are never hot and match nothing. All is lazy; ``other``'s keys are counted first.
    """
    salt, hot, there, n, k = (f"__{c}{tag}" for c in ("salt", "hot", "there", "n", "k"))
    parts = int(partitions or other.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = other.where(F.col(f"`{other_key}`").isNotNull()).groupBy(F.col(f"`{other_key}`").alias(k)).agg(F.count(F.lit(1)).alias(n))
    piece = counts.agg(F.sum(n) / F.lit(parts * PIECES)).scalar()
    salts = F.broadcast(counts.where(F.col(n) > piece).select(k, F.ceil(F.col(n) / piece).cast("int").alias(n)))
    hashable = [c for c, kind in other.dtypes if "map<" not in kind]
    row = F.xxhash64(*[F.col(f"`{c}`") for c in hashable], F.spark_partition_id())
    dealt = other.join(salts, F.col(f"`{other_key}`") == F.col(k), "left").withColumn(
        salt, F.when(F.col(n).isNotNull(), F.pmod(row, F.col(n)).cast("int")).otherwise(0)
    )
    copies = preserved.join(salts, F.col(f"`{key}`") == F.col(k), "left").withColumn(hot, F.col(n).isNotNull())
    copies = copies.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n) - 1, F.lit(0)))))
    return copies.drop(n, k), dealt.withColumn(there, F.lit(True)).drop(n, k)


def outer_join(preserved: DataFrame, other: DataFrame, key: str, other_key: str, how: str = "left", partitions: int | None = None) -> DataFrame:
    """``preserved`` left (or ``full``) outer join ``other`` on ``key = other_key``, the columns of both, with
    hot keys of ``other`` dealt to many tasks (:func:`deal_hot_keys`). The other side's names must differ."""
    if how not in ("left", "full"):
        raise ValueError("how must be left or full")
    copies, dealt = deal_hot_keys(preserved, key, other, other_key, "_p", partitions)
    dealt = dealt.withColumnRenamed("__salt_p", "__salt_o")
    on = (F.col(f"`{key}`") == F.col(f"`{other_key}`")) & (F.col("__salt_p") == F.col("__salt_o"))
    joined = copies.join(dealt, on, how)
    return joined.where(F.col("__there_p").isNotNull() | ~F.col("__hot_p")).drop("__salt_p", "__salt_o", "__hot_p", "__there_p")
