import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mercato.operators import Numbering, global_ntile, global_rank, global_row_number, numbered, top_n_per_group


def skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # a third of all rows share one value: the hot key must not break or unbalance the result
        v = 5 if i % 3 == 0 else rnd.randint(0, 200)
        rows.append((i, v, None if i % 97 == 0 else rnd.randint(0, 9)))
    return spark.createDataFrame(rows, "id long, v long, w long")


def as_map(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_global_rank_matches_window(spark):
    df = skewed(spark)
    for cols, asc in ((["v"], False), (["w"], True), (["w", "v"], [False, True])):
        expect = df.withColumn("r", F.rank().over(Window.orderBy(*[F.col(c).asc() if a else F.col(c).desc()
                                                             for c, a in zip(cols, asc if isinstance(asc, list) else [asc] * len(cols))])))
        got = global_rank(df, cols, asc, name="r", num_partitions=5)
        assert as_map(got, "r") == as_map(expect, "r")
        assert got.count() == df.count()


def test_global_row_number_and_ntile_match_window(spark):
    df = skewed(spark)
    w = Window.orderBy(F.col("v").desc(), F.col("id").asc())
    expect = df.withColumn("rn", F.row_number().over(w)).withColumn("q", F.ntile(4).over(w))
    got = global_row_number(df, ["v", "id"], [False, True], name="rn", num_partitions=6)
    assert as_map(got, "rn") == as_map(expect, "rn")
    for k in (1, 3, 4, 7, 5000):
        exp_k = df.withColumn("q", F.ntile(k).over(w))
        got_k = global_ntile(df, k, ["v", "id"], [False, True], name="q", num_partitions=6)
        assert as_map(got_k, "q") == as_map(exp_k, "q"), k


def test_ntile_small_inputs(spark):
    for n in (1, 2, 3, 5, 8, 11):
        df = spark.range(n).withColumnRenamed("id", "id")
        w = Window.orderBy("id")
        for k in (1, 3, 4, 7):
            exp = df.withColumn("q", F.ntile(k).over(w))
            got = global_ntile(df, k, "id", True, name="q", num_partitions=3)
            assert as_map(got, "q") == as_map(exp, "q"), (n, k)


def test_no_rows_go_through_one_partition(spark):
    df = skewed(spark)
    for got in (
        global_ntile(df, 4, ["v", "id"], [False, True], name="q", num_partitions=4),
        global_rank(df, "v", False, name="r"),
        global_row_number(df, "v", name="n"),
    ):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "hashpartitioning(__mc_range" in plan


def test_a_value_of_a_third_of_all_rows_is_dealt_to_many_ranges(spark):
    n, ranges = 30_000, 16
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id") % 1000).alias("v"))
    got = global_rank(df, "v", False, name="r", num_partitions=ranges)
    want = df.withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc())))
    assert as_map(got, "r") == as_map(want, "r")
    # the window's ranges, before their rows meet the prefix sums
    keyed = df.withColumn("t", F.xxhash64("id", "v"))
    from mercato.operators import windows

    seen = []
    plain = windows._prefix
    windows._prefix = lambda counts, bounds: seen.append(counts) or plain(counts, bounds)
    try:
        global_rank(keyed, "v", False, name="r", num_partitions=ranges)
    finally:
        windows._prefix = plain
    sizes = [rows for rows, _ in seen[0].values()]
    assert sum(sizes) == n and len(sizes) == ranges and max(sizes) < 2 * n / ranges


def test_several_numberings_at_once_and_odd_orders(spark):
    nan = float("nan")
    rows = [(i, [None, nan, 1.5, -0.0, 0.0, 7.25][i % 6], ["b", None, "ä", "Z", ""][i % 5], i % 4 == 0) for i in range(700)] + [(5, 1.5, "x", True)] * 40
    df = spark.createDataFrame(rows, "id long, `a.b` double, s string, f boolean").withColumnRenamed("a.b", "d")
    got = numbered(
        df, Numbering("r1", ["d", "s"], [False, True]), Numbering("r2", "f"), Numbering("q", ["s", "id"], [False, False], "ntile", 7), num_partitions=6
    )
    w1, w2, w3 = Window.orderBy(F.col("d").desc(), F.col("s")), Window.orderBy("f"), Window.orderBy(F.col("s").desc(), F.col("id").desc())
    want = df.select("*", F.rank().over(w1).alias("r1"), F.rank().over(w2).alias("r2"), F.ntile(7).over(w3).alias("q"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.columns == want.columns and {dict(got.dtypes)[c] for c in ("r1", "r2", "q")} == {"bigint"}
    assert numbered(df.limit(0), Numbering("r", "d")).count() == 0
    with pytest.raises(ValueError):
        numbered(df, Numbering("r", ["d", "s"], [True, False, True]))
    with pytest.raises(ValueError):
        global_ntile(df, 0, "d")


def test_top_n_per_group_keeps_ties(spark):
    df = spark.createDataFrame(
        [("a", 1, 10), ("a", 2, 10), ("a", 3, 9), ("a", 4, 8), ("b", 5, 1)], "g string, id int, v int"
    )
    got = sorted((r.g, r.id, r.rank) for r in top_n_per_group(df, "g", "v", 2).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("b", 5, 1)]
    plan = top_n_per_group(df, "g", "v", 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(0, 6)), min_size=1, max_size=60),
    parts=st.integers(1, 7),
    k=st.integers(1, 9),
    desc=st.booleans(),
)
def test_property_rank_and_ntile(spark, values, parts, k, desc):
    df = spark.createDataFrame(list(enumerate(values)), "id long, v long")
    order = F.col("v").desc() if desc else F.col("v").asc()
    exp = df.withColumn("r", F.rank().over(Window.orderBy(order))).withColumn(
        "q", F.ntile(k).over(Window.orderBy(order, F.col("id")))
    )
    got_r = global_rank(df, "v", not desc, name="r", num_partitions=parts)
    got_q = global_ntile(df, k, ["v", "id"], [not desc, True], name="q", num_partitions=parts)
    assert as_map(got_r, "r") == as_map(exp, "r")
    assert as_map(got_q, "q") == as_map(exp, "q")


def test_default_partitioning_path(spark):
    # no explicit count: as many ranges as the session has shuffle partitions
    df = skewed(spark, n=4000, seed=11)
    w = Window.orderBy(F.col("v").desc(), F.col("id").asc())
    exp = df.withColumn("q", F.ntile(4).over(w)).withColumn("r", F.rank().over(Window.orderBy(F.col("v").desc())))
    assert as_map(global_ntile(df, 4, ["v", "id"], [False, True], name="q"), "q") == as_map(exp, "q")
    assert as_map(global_rank(df, "v", False, name="r"), "r") == as_map(exp, "r")
