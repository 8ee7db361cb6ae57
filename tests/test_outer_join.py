"""Outer joins whose other side holds a hot key: same rows, no large task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from mercato.operators import outer_join

PARTS = 12


@pytest.fixture(scope="module")
def sides(spark):
    staff = spark.range(60).select(F.when(F.col("id") < 58, F.col("id")).alias("staff"), (F.col("id") * 3).alias("pay"))
    # a third of the sales belong to one seller, some to none, some to an unknown one
    seller = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).when(F.col("id") % 50 == 2, F.lit(999)).otherwise(F.col("id") % 50)
    return staff, spark.range(24_000).select(F.col("id").alias("sale"), seller.cast("long").alias("seller"))


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("how", ["left", "full"])
def test_same_rows_as_the_plain_join(sides, how):
    staff, sales = sides
    got = outer_join(staff, sales, "staff", "seller", how, PARTS)
    want = staff.join(sales, F.col("staff") == F.col("seller"), how)
    assert got.columns == want.columns and rows(got) == rows(want)
    assert rows(outer_join(staff, sales.limit(0), "staff", "seller", how, PARTS)) == rows(staff.join(sales.limit(0), F.col("staff") == F.col("seller"), how))
    assert rows(outer_join(staff.limit(0), sales, "staff", "seller", how, PARTS)) == rows(staff.limit(0).join(sales, F.col("staff") == F.col("seller"), how))


def test_repeated_preserved_rows_and_identical_other_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "a long")
    right = spark.createDataFrame([(1, "x")] * 500 + [(3, "y")] * 20, "b long, c string").repartition(5)
    got = outer_join(left, right, "a", "b", "left", 4)
    assert rows(got) == Counter({(1, 1, "x"): 1000, (2, None, None): 1, (None, None, None): 1})


def test_no_task_is_twice_the_usual(spark, sides):
    staff, sales = sides
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(PARTS))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

        def largest(df):
            sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return sizes[-1] / sizes[len(sizes) // 2], sizes[-1]

        known = sales.where("seller IS NOT NULL")
        plain, dealt = largest(staff.join(known, F.col("staff") == F.col("seller"), "left")), largest(outer_join(staff, known, "staff", "seller"))
        assert plain[0] > 4 and dealt[0] <= 2.5 and dealt[1] * 2 < plain[1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
