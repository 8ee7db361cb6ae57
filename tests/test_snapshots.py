"""States replaced as a whole, and the index of keys over batches."""

import pytest
from pyspark.sql import functions as F

from mercato.operators import quality
from mercato.operators.key_index import KeyIndex
from mercato.sources import snapshots

HEAD = "CustomerID,FirstName,MiddleInitial,LastName,CityID,Address\n"


def load(spark, tmp_path, name, rows, **more):
    path = tmp_path / name
    path.write_text(HEAD + "".join(rows))
    return quality.load_csv_snapshot(spark, str(path), "customers", str(tmp_path / "table"), **more)


def test_a_load_replaces_rows_and_rejects_together(spark, tmp_path):
    table = str(tmp_path / "table")
    assert snapshots.current(spark, table) is None
    with pytest.raises(ValueError):
        quality.loaded_rows(spark, table, "customers")
    rows = [f"{i},Ana,B,Ruiz,1,Calle {i}\n" for i in range(1, 10)]
    assert load(spark, tmp_path, "a.csv", rows + ["10,,B,Ruiz,1,\n"]) == {"table": "customers", "rows": 10, "rejected": 1, "state": 1}  # exactly 10 %
    ids = lambda df: sorted(r["CustomerID"] for r in df.collect())
    assert ids(quality.loaded_rows(spark, table, "customers")) == list(range(1, 10)) and ids(quality.loaded_rejects(spark, table, "customers")) == [10]
    with pytest.raises(quality.TooManyErrors):
        load(spark, tmp_path, "b.csv", rows[:3] + ["20,,B,Ruiz,1,\n"])
    assert ids(quality.loaded_rows(spark, table, "customers")) == list(range(1, 10)) and ids(quality.loaded_rejects(spark, table, "customers")) == [10]
    assert load(spark, tmp_path, "c.csv", rows[:2])["state"] == 2
    assert ids(quality.loaded_rows(spark, table, "customers")) == [1, 2] and ids(quality.loaded_rejects(spark, table, "customers")) == []
    assert quality.loaded_rejects(spark, table, "customers").columns[-2:] == ["errors", "raw"]


def test_a_killed_load_leaves_the_old_state(spark, tmp_path, monkeypatch):
    rows = [f"{i},Ana,B,Ruiz,1,Calle {i}\n" for i in range(1, 30)]
    load(spark, tmp_path, "a.csv", rows + ["99,,B,Ruiz,1,\n"])
    monkeypatch.setattr(snapshots, "switch", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))  # after the write, before the switch
    with pytest.raises(KeyboardInterrupt):
        load(spark, tmp_path, "b.csv", rows[:5])
    assert quality.loaded_rows(spark, str(tmp_path / "table"), "customers").count() == 29
    assert [r["raw"]["CustomerID"] for r in quality.loaded_rejects(spark, str(tmp_path / "table"), "customers").collect()] == ["99"]


def test_an_empty_file_and_two_writers(spark, tmp_path):
    assert load(spark, tmp_path, "a.csv", []) == {"table": "customers", "rows": 0, "rejected": 0, "state": 1}
    assert quality.loaded_rows(spark, str(tmp_path / "table"), "customers").count() == 0
    path = str(tmp_path / "t")
    one, other = snapshots.new_state(path), snapshots.new_state(path)
    for folder in (one, other):
        spark.range(1).write.parquet(folder)
    assert snapshots.switch(spark, path, one) == 1 and snapshots.switch(spark, path, other) == 2 and snapshots.current(spark, path) == other
    assert snapshots.read(spark, path).count() == 1
    with pytest.raises(ValueError):
        snapshots.switch(spark, path, path + "/elsewhere")


def test_key_index(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, None), (None, "x"), (4, "c|d"), (5, "e")]
    df = spark.createDataFrame(rows, "a long, b string")
    index = KeyIndex(spark, f"file://{tmp_path}/index", ["a", "b"], buckets=3)
    pairs = lambda d: sorted(map(tuple, d.collect()))
    first, second = df.limit(4), spark.createDataFrame([(2, "b"), (6, "f"), (4, "c|d"), (None, "z")], "a long, b string")
    assert pairs(index.repeated_in(df, "1")) == [("1|a", 2, 0)]
    index.add(df, "1")
    assert pairs(index.duplicates()) == [("1|a", 2)]
    want = [("2|b", 1, 1), ("4|c\\|d", 1, 1)]
    assert pairs(index.repeated_in(second, "2")) == want
    for _ in range(2):  # the second time changes nothing
        index.add(second, "2")
        assert pairs(index.duplicates()) == [("1|a", 2), ("2|b", 2), ("4|c\\|d", 2)] and pairs(index.repeated_in(second, "2")) == want
    index.add(first, "1")  # a batch that shrinks
    assert pairs(index.duplicates()) == [("1|a", 2), ("2|b", 2)]
    assert pairs(index.missing(spark.createDataFrame([(9, "z"), (9, "z"), (6, "f"), (None, None)], "a long, b string"))) == [("9|z", 2)]
    index.close()
    again = KeyIndex(spark, f"file://{tmp_path}/index", ["a", "b"], buckets=3)  # another session's view
    assert pairs(again.duplicates()) == [("1|a", 2), ("2|b", 2)]
    again.add(df.limit(0), "3")
    assert again.table().count() == 5
    with pytest.raises(ValueError):
        again.add(df, "../x")


def test_a_batch_meets_the_index_without_shuffling_it(spark, tmp_path):
    index = KeyIndex(spark, f"file://{tmp_path}/index", ["id"], buckets=4)
    index.add(spark.range(2000), "1")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.missing(spark.range(1900, 2100).select(F.col("id")))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert found.count() == 100
        below = plan[plan.index("SortMergeJoin"):]
        scan = below[: below.index(index.name)]
        assert scan.rstrip().rsplit("\n", 1)[-1].count("Exchange") == 0  # the index's side is read as it lies
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
