"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.session import discard, scratch

#: white space between words: space, tab, line feed, vertical tab, form feed, carriage return
WORD = r"[^\x20\x09-\x0D]+"
#: a key is hot when it holds more than one row in so many; there are at most that many hot keys
HOT_SHARE = 500
#: a table of up to so many small rows may be broadcast
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, and safe against
    lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more."""
    for df in tables:
        if hasattr(df, "scratch"):
            discard(df.scratch)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"], F.lit(""))


def prefix_positions(
    df: DataFrame, group: str, order: list[str], weight: Column, name: str, rows_per_bucket: int = 50_000
) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows before this one in its ``group``.

    The order inside a group is fixed but pseudorandom: rows go to hash buckets of ``order`` and are
    sorted by ``order`` inside one. Bucket totals are summed first (map-side), so a group of any size
    is spread over its buckets and no window holds more than a bucket of a group.
    """
    rows = df.count()
    buckets = max(1, -(-rows // rows_per_bucket))
    work = df.withColumn("__w", weight.cast("long")).withColumn(
        "__b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    )
    before = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        work.groupBy(group, "__b").agg(F.sum("__w").alias("__s"))
        .select(group, "__b", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__base"))
    )
    inside = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        work.join(offsets, [group, "__b"])
        .withColumn(name, (F.col("__base") + F.sum("__w").over(inside) - F.col("__w")).cast("long"))
        .drop("__w", "__b", "__base")
    )


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of small rows, marked for broadcast if it has at most ``most`` of them; beyond
    that it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has one row per ``key`` and its row count.

    Groups of more than ``total / HOT_SHARE`` rows (at most HOT_SHARE of them, so their broadcast is
    bounded at any size) meet their rows without a shuffle; the others go through a shuffled join.
    """
    hot = F.col(count) * HOT_SHARE > F.lit(total)
    large, small = groups.where(hot), groups.where(~hot)
    return (
        rows.join(F.broadcast(large), key)
        .unionByName(rows.join(F.broadcast(large.select(key)), key, "left_anti").join(small, key))
    )
