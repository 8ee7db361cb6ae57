"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text, and partitioned by
batch. A batch is reduced to one row per digest (map-side first), a sort-merge anti-join against the other
batches' entries finds the digests that are new, and those are the batch's entries: a batch that is repeated,
after a crash say, replaces its own and finds what it found before. The index side of that join is read by
bucket, without a shuffle; the texts themselves never move.

A table is deduplicated in batches of falling doc_id, so the first batch that brings a text has its largest id.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import bounded, done_with, join_groups, lower_ascii, materialise, scratch, text_or_empty

#: batches of a table that is deduplicated as a whole
BATCHES = 2


class DigestIndex:
    """Digest -> the row that stays. ``path`` persists it; a later session opens it by the same path
    and the same number of buckets."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        # a folder to look for batches in
        spark.createDataFrame([], "digest binary, keep_id long, batch string").write.mode("ignore").partitionBy("batch").parquet(self.path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id and digest of every row."""
        return docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(lower_ascii(text_or_empty(docs)), 256)).alias("digest")
        )

    def append(self, rows: DataFrame, batch: str) -> None:
        """Make the digests of ``rows`` (doc_id, digest) that no other batch has the entries of ``batch``."""
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        known = self.entries().where(F.col("batch") != batch).select("digest")
        # written first: Spark doesn't let a statement replace what it reads, another batch of the table even
        fresh = materialise(groups.join(known.hint("merge"), "digest", "left_anti"), "digest-fresh")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT digest, keep_id FROM {{rows}}", rows=fresh.repartition(self.buckets, "digest"))
        done_with(fresh)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicate ``docs`` (columns doc_id, text) against the index and append the new texts.

        Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Texts are
        equal when identical after lower-casing A-Z; null counts as empty. Of new texts the row with
        the largest doc_id stays; a text that an earlier batch brought keeps that batch's row, and
        group_size counts it besides this batch's rows. Of rows that repeat doc_id and text, one
        stays. A null doc_id is smaller than any other. An empty batch gives no rows. Columns besides
        doc_id and text are ignored. A batch that comes again under its name ``batch`` (letters and digits;
        by default a new one) replaces itself.
        """
        batch = batch or uuid.uuid4().hex
        if not batch.isalnum():
            raise ValueError("a batch is named by letters and digits")
        rows = materialise(self.digests(docs), "digests")
        old = self.entries().where(F.col("batch") != batch).select("digest", "keep_id").withColumn("__old", F.lit(True))
        groups = rows.groupBy("digest").agg(F.max("doc_id").alias("batch_keep"), F.count(F.lit(1)).alias("n"))
        groups = materialise(
            groups.join(old.hint("merge"), "digest", "left").select(
                "digest", "n", F.when(F.col("__old"), F.col("keep_id")).otherwise(F.col("batch_keep")).alias("keep_id"), F.col("__old").isNotNull().alias("__old")
            ),
            "digest-groups",
        )
        self.append(rows, batch)
        return _told(rows, groups)


def _told(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """A row per row (doc_id, digest): what its group (digest, n, keep_id, __old) makes of it."""
    # rows that repeat doc_id and text: the first of them can stay
    per_id = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("__m"))
    single = per_id.select("digest", "doc_id", F.explode(F.sequence(F.lit(1), F.col("__m").cast("int"))).alias("__nth"))
    return join_groups(single, groups, "digest", "n", rows.count()).select(
        "doc_id",
        "keep_id",
        (F.col("n") + F.col("__old").cast("long")).alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("__old") & (F.col("__nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, path: str | None = None, batches: int = BATCHES) -> DataFrame:
    """``docs`` (doc_id, text) through an index at ``path`` (a new one if None), in ``batches`` of falling doc_id.

    Returns a row per row: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts (as in
    :meth:`DigestIndex.add`) the row of largest doc_id stays, whatever batch it is in; group_size counts all
    rows of ``docs``. With an index that already has entries, texts that they hold stay theirs. Null ids come
    in the last batch; an empty table gives no rows; other columns are ignored.
    """
    index = DigestIndex(docs.sparkSession, path)
    rows = materialise(index.digests(docs), "digests")
    before = {r["batch"] for r in index.entries().select("batch").distinct().collect()}  # a row a batch
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    cuts, name = [high - (high - low) * b // batches for b in range(1, batches)], uuid.uuid4().hex
    number = F.lit(0)
    for cut in cuts:  # falling: an id is in the batch of as many cuts as lie above it
        number = number + (F.col("doc_id") < cut).cast("int")
    for b in range(batches):
        index.append(rows.where(F.coalesce(number, F.lit(batches - 1)) == b), f"{name}{b}")
    kept = index.entries().withColumn("__old", F.col("batch").isin(*before) if before else F.lit(False)).select("digest", "keep_id", "__old")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).join(kept.hint("merge"), "digest")
    return _told(rows, materialise(groups, "digest-groups"))


def drop_copies(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with all their columns, without the rows that :func:`exact_dedup` drops. The texts stay
    where they are as long as the keys of the dropped rows are few enough to broadcast."""
    found = materialise(exact_dedup(docs, path), "dedup-found")
    keys = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(
        F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__times")
    )
    gone = materialise(keys.where("not __kept").select("__id", "__sha"), "dedup-gone")
    repeated = materialise(keys.where("__kept and __times > 1").select("__id", "__sha"), "dedup-repeated")
    marked = docs.withColumn("__digest", F.sha2(lower_ascii(text_or_empty(docs)), 256))
    same = marked["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (marked["__digest"] == F.col("__sha"))
    left = marked.join(bounded(gone), same, "left_anti")
    once = left.join(bounded(repeated), same, "left_anti")
    first = left.join(bounded(repeated), same, "left_semi").dropDuplicates(["doc_id", "__digest"])
    return once.unionByName(first).drop("__digest") if repeated.limit(1).count() else left.drop("__digest")
