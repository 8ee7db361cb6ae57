"""The key index stays where it lies, whatever the session's number of shuffle partitions."""

import pytest
from pyspark.sql import functions as F

from mercato.operators.key_index import KeyIndex


@pytest.mark.parametrize("partitions", ["2", "8"])
def test_the_index_isnt_shuffled_for_another_number_of_partitions(spark, tmp_path, partitions):
    index = KeyIndex(spark, f"file://{tmp_path}/index", ["id"], buckets=4)
    index.add(spark.range(2000), "1")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": partitions}
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        batch = spark.range(1900, 2100).select(F.col("id"))
        for found, rows in ((index.missing(batch), 100), (index.repeated_in(batch, "2"), 100)):
            assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString() and found.count() == rows
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
