import os
import tempfile

from mercato.streaming import start_csv_ingest

HEADER = "SalesID,SalesPersonID,ProductID,CustomerID,Quantity,Discount,TotalPrice,SalesDate,TransactionNumber\n"


def test_incremental_csv_ingest(spark):
    root = tempfile.mkdtemp(prefix="mercato-stream-", dir="/tmp")
    src, out, ck = (os.path.join(root, x) for x in ("in", "out", "ck"))
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w", newline="") as f:
        f.write(HEADER + "".join(f"{i},1,2,3,{i},0.1,10.00,21:49.2,T{i}\r\n" for i in range(1, 11)))
    q = start_csv_ingest(spark, src, "sales", out, checkpoint_location=ck)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 10
    # a new file: only it is processed; one bad row of ten passes the 10 % gate
    with open(os.path.join(src, "b.csv"), "w", newline="") as f:
        f.write(HEADER + "".join(f"{i},1,2,3,{i if i != 20 else 0},,10.00,,T{i}\n" for i in range(11, 21)))
    q = start_csv_ingest(spark, src, "sales", out, checkpoint_location=ck)
    q.awaitTermination(120)
    good = spark.read.parquet(out)
    assert good.count() == 19 and good.select("SalesID").distinct().count() == 19
    rejects = spark.read.parquet(out + "_rejects").collect()
    assert [(r.SalesID, r.errors) for r in rejects] == [(20, ["Quantity:quantity_positive"])]
    assert dict(good.dtypes)["SalesDate"] == "bigint"
