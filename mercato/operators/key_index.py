"""Keys of everything loaded so far, so that an arriving batch is checked without reading the table again.

The index is a table bucketed and sorted by key and partitioned by batch: a batch meets it by a sort-merge
join that shuffles the batch alone. A batch's entries replace those of the same batch id, so a load that is
repeated changes nothing. Keys are counted per batch before they are stored (map-side combined): a key that
a third of all rows hold is one row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16


class KeyIndex:
    """Index at ``path`` (a shared folder) over ``columns``. Opening it again finds what earlier sessions
    stored; ``buckets`` must stay the same."""

    def __init__(self, spark: SparkSession, path: str, columns: list[str] | tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), list(columns), buckets
        self.name = "key_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        # a folder to look for batches in
        spark.createDataFrame([], "key string, n long, batch string").write.mode("ignore").partitionBy("batch").parquet(self.path)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (`key` STRING, n BIGINT, batch STRING) USING parquet "
            f"PARTITIONED BY (batch) CLUSTERED BY (`key`) SORTED BY (`key`) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _keys(self, df: DataFrame) -> DataFrame:
        """Distinct keys of ``df`` with their number of rows. A key with a null column isn't a key."""
        known = df.dropna(subset=self.columns)
        texts = [F.col(f"`{c}`").cast("string") for c in self.columns]
        # a separator that a text holds is escaped, so different keys stay different
        key = F.concat_ws("|", *[F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for t in texts]) if len(texts) > 1 else texts[0]
        return known.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def _dealt(self, keys: DataFrame) -> DataFrame:
        """``keys`` as the index's buckets lie: with another number of partitions Spark would shuffle the index."""
        return keys.repartition(self.buckets, "key")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, df: DataFrame, batch: str) -> None:
        """Store the keys of batch ``batch``, in place of what that batch stored before."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id is letters, digits, - and _")
        rows = self._dealt(self._keys(df))
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (batch = '{batch}') SELECT `key`, n FROM {{rows}}", rows=rows)

    def duplicates(self) -> DataFrame:
        """Keys of more than one row over all batches: key, n."""
        return self.table().groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")

    def repeated_in(self, df: DataFrame, batch: str) -> DataFrame:
        """Keys of an arriving batch that it repeats itself or that other batches hold: key, n (its own rows),
        held (rows of other batches). Same before and after the batch is added."""
        others = self.table().where(F.col("batch") != batch).groupBy("key").agg(F.sum("n").alias("held"))
        found = self._dealt(self._keys(df)).join(others, "key", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        return found.where("n > 1 OR held > 0")

    def missing(self, df: DataFrame) -> DataFrame:
        """Keys of ``df`` (the index's columns) that no batch holds, with their rows: key, n. For references:
        the index of the parent's key, and ``df`` the child's references under the parent's names."""
        # an anti-join would be moved before the keys are dealt
        found = self._dealt(self._keys(df)).join(self.table().select("key", F.lit(True).alias("held")), "key", "left")
        return found.where(F.col("held").isNull()).drop("held")
