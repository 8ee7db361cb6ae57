"""Values that once were lost or accepted wrongly on load."""

import os

from mercato.operators import quality
from mercato.sources.csv import read_text_csv
from mercato.streaming.ingest import start_csv_ingest


def _products(spark, price, days):
    row = {"ProductID": "1", "ProductName": "p", "Price": price, "CategoryID": "1", "Class": "Low", "ModifyDate": None,
           "Resistant": None, "IsAllergic": "TRUE", "VitalityDays": days}
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names))
    return quality.conform(df, "products").first()


def test_long_shelf_life_is_kept(spark):
    row = _products(spark, "2.5", "1200")
    assert row["VitalityDays"] == 1200 and row["errors"] == []
    assert _products(spark, "2.5", "3651")["errors"] == ["VitalityDays:vitality_range"]


def test_price_scale_counts_the_exponent(spark):
    assert "Price:price_scale" in _products(spark, "1e-7", "1")["errors"]
    assert _products(spark, "1.25e1", "1")["errors"] == []


def test_negative_discount_is_seen_before_rounding(spark):
    names = ["SalesID", "SalesPersonID", "ProductID", "CustomerID", "Quantity", "Discount", "TotalPrice", "SalesDate", "TransactionNumber"]
    df = spark.createDataFrame([("1", "1", "1", "1", "1", "-0.001", "1", None, None)], ", ".join(f"{n} string" for n in names))
    assert "Discount:discount_non_negative" in quality.conform(df, "sales").first()["errors"]


def test_doubled_quotes(spark, tmp_path):
    path = os.path.join(tmp_path, "a.csv")
    with open(path, "w") as f:
        f.write('id,name\n1,"Casa ""Azul"" 3"\n')
    assert read_text_csv(spark, path).first()["name"] == 'Casa "Azul" 3'


def test_surplus_fields_are_rejected_and_rejects_keep_their_text(spark, tmp_path):
    path, out = os.path.join(tmp_path, "customers.csv"), os.path.join(tmp_path, "out")
    with open(path, "w") as f:
        f.write("CustomerID,FirstName,MiddleInitial,LastName,CityID,Address\n1,Ana,B,Ruiz,1,Calle 1, Rosario\n2,Eva,,Paz,abc,Calle 2\n")
        f.write("".join(f"{i},Ana,B,Ruiz,1,Calle {i}\n" for i in range(3, 30)) + "30,Ana,B,Ruiz,1,Calle 30,\n")
    assert quality.load_csv_table(spark, path, "customers", out) == {"table": "customers", "rows": 30, "rejected": 2}
    rejects = {r["CustomerID"]: r for r in spark.read.parquet(out + "_rejects").collect()}
    assert rejects[1]["errors"] == ["_surplus:malformed_row"] and rejects[1]["raw"]["_surplus"] == " Rosario"
    assert rejects[2]["CityID"] is None and rejects[2]["raw"]["CityID"] == "abc"
    good = spark.read.parquet(out)
    assert good.count() == 28 and not {"raw", "errors", "_surplus"} & set(good.columns)
    report = quality.validate_file(spark, path, "customers.csv").collect()
    assert sorted((r["key"], r["rule"]) for r in report) == [("1", "malformed_row"), ("2", "type")]


def test_stream_checkpoint_belongs_to_the_output(spark, tmp_path):
    src, out = os.path.join(tmp_path, "in"), os.path.join(tmp_path, "out")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("SalesID,SalesPersonID,ProductID,CustomerID,Quantity,Discount,TotalPrice,SalesDate,TransactionNumber\n")
        f.write("".join(f"{i},1,2,3,{i},0.1,10.00,21:49.2,T{i}\n" for i in range(1, 6)))
    for _ in range(2):
        start_csv_ingest(spark, src, "sales", out).awaitTermination(120)
    assert os.path.isdir(out + "_checkpoint") and spark.read.parquet(out).count() == 5


def test_stream_rejects_surplus_fields(spark, tmp_path):
    src, out = os.path.join(tmp_path, "in"), os.path.join(tmp_path, "out")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("CustomerID,FirstName,MiddleInitial,LastName,CityID,Address\n1,Ana,B,Ruiz,1,Calle 1, Rosario\n")
        f.write("".join(f"{i},Ana,B,Ruiz,1,Calle {i}\n" for i in range(2, 21)))
    start_csv_ingest(spark, src, "customers", out).awaitTermination(120)
    good, rejects = spark.read.parquet(out), spark.read.parquet(out + "_rejects").collect()
    assert good.count() == 19 and not {"raw", "errors", "_surplus"} & set(good.columns)
    assert [(r["CustomerID"], r["errors"], r["raw"]["_surplus"]) for r in rejects] == [(1, ["_surplus:malformed_row"], " Rosario")]
