import os
import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.operators import quality
from mercato.operators.quality import TooManyErrors
from mercato.sources.csv import read_table_csv, read_text_csv


def write(path, text, crlf=False):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text.replace("\n", "\r\n") if crlf else text)


@pytest.fixture()
def tmp():
    return tempfile.mkdtemp(prefix="mercato-test-", dir="/tmp")


def test_csv_line_ends_quotes_and_null_tokens(spark, tmp):
    body = 'ProductID,ProductName,Price,CategoryID,Class,ModifyDate,Resistant,IsAllergic,VitalityDays\n' \
           '1,"Flour - Whole Wheat",74.2988,3,Medium,21:49.2,Durable,Unknown,0\n' \
           '2,"Cheese, Blue",NA,N/A,NULL,,Weak,TRUE,7\n'
    for crlf in (False, True):
        p = os.path.join(tmp, f"products_{crlf}.csv")
        write(p, body, crlf)
        rows = read_table_csv(spark, p, "products").orderBy("ProductID").collect()
        assert [r.ProductName for r in rows] == ["Flour - Whole Wheat", "Cheese, Blue"]
        assert rows[1].Price is None and rows[1].CategoryID is None and rows[1].Class is None
        assert rows[1].ModifyDate is None and rows[1].VitalityDays == "7"


def test_customers_file_order_is_mapped(spark, tmp):
    p = os.path.join(tmp, "customers.csv")
    write(p, "CustomerID,FirstName,MiddleInitial,LastName,CityID,Address\n100,Ana,B,López,1,Calle Mayor 123\n")
    row = read_table_csv(spark, p, "customers").first()
    assert row.asDict() == {"CustomerID": "100", "FirstName": "Ana", "MiddleInitial": "B", "LastName": "López",
                            "Address": "Calle Mayor 123", "CityID": "1"}


def test_validator_rules(spark, tmp):
    p = os.path.join(tmp, "sales.csv")
    write(p, "SalesID,SalesPersonID,ProductID,CustomerID,Quantity,Discount,TotalPrice,SalesDate,TransactionNumber\n"
             "1,5,10,20,3,0.1,12.50,21:49.2,T1\n"
             "2,,10,20,3.7,0,abc,60:00,T2\n"
             "3,x,,20,2,0,1e3,10:05.x,T3\n", crlf=True)
    rep = quality.validate_file(spark, p, "sales.csv")
    got = sorted((r.key, r.column, r.rule) for r in rep.collect())
    assert got == [
        ("2", "Quantity", "type"), ("2", "SalesDate", "type"), ("2", "TotalPrice", "type"),
        ("3", "ProductID", "required"), ("3", "SalesDate", "type"), ("3", "SalesPersonID", "type"),
    ]
    summary = quality.error_summary(rep, first=5).collect()
    assert summary[0].problems == 6 and len(summary[0].first_problems) == 5


def test_missing_file_and_missing_columns(spark, tmp):
    rep = quality.validate_file(spark, os.path.join(tmp, "nope.csv"), "countries.csv").collect()
    assert [r.rule for r in rep] == ["missing_file"]
    p = os.path.join(tmp, "countries.csv")
    write(p, "CountryID,Code\n1,AR\n")
    rep = quality.validate_file(spark, p, "countries.csv").collect()
    assert [(r.rule, r.column) for r in rep] == [("missing_columns", "CountryName")]


def test_conform_rules_and_gate(spark):
    rows = [
        ("1", "Apples", "1.50", "2", "Low", None, "Durable", "FALSE", "5"),
        ("2", "Pears", "1.50000", "3", "Medium", None, "Weak", "TRUE", "3651"),  # price scale, shelf life
        ("3", "X", "2", "4", "Huge", None, "Soft", "maybe", None),  # strict: name, class, resistance, perishable
        ("4", "Plums", "-1", "12", None, None, None, None, "7.5"),
    ]
    cols = "ProductID ProductName Price CategoryID Class ModifyDate Resistant IsAllergic VitalityDays".split()
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    conf = {r.ProductID: sorted(r.errors) for r in quality.conform(df, "products", "conform").collect()}
    assert conf == {
        1: [],
        2: ["Price:price_scale", "VitalityDays:vitality_range"],
        3: ["IsAllergic:allergy_token"],
        4: ["Price:price_range", "VitalityDays:type"],
    }
    strict = {r.ProductID: sorted(r.errors) for r in quality.conform(df, "products", "strict").collect()}
    assert strict[3] == ["Class:class_domain", "IsAllergic:allergy_token", "ProductName:name_length",
                         "Resistant:resistance_domain", "VitalityDays:perishable_needs_shelf_life"]
    assert "CategoryID:category_domain" in strict[4]


def test_error_gate_at_ten_percent(spark):
    def frame(bad, n):
        return spark.createDataFrame([([f"e"] if i < bad else [],) for i in range(n)], "errors array<string>")

    assert quality.check_error_rate(frame(1, 10)) == (1, 10)  # exactly 10 % passes
    with pytest.raises(TooManyErrors):
        quality.check_error_rate(frame(2, 10))
    assert quality.check_error_rate(spark.createDataFrame([], "errors array<string>")) == (0, 0)


def test_load_csv_table_end_to_end(spark, tmp):
    p = os.path.join(tmp, "employees.csv")
    write(p, "EmployeeID,FirstName,MiddleInitial,LastName,BirthDate,Gender,CityID,HireDate\n"
             + "".join(f"{i},Carlos,R,Martínez,1985-03-15 00:00:00.000,M,67,2020-06-01 00:00:00.000\n" for i in range(1, 10))
             + "10,Ana,,Ruiz,1990-13-01 00:00:00.000,F,5,\n")
    out = os.path.join(tmp, "employees_out")
    res = quality.load_csv_table(spark, p, "employees", out)
    assert res == {"table": "employees", "rows": 10, "rejected": 1}
    good = spark.read.parquet(out)
    assert good.count() == 9 and dict(good.dtypes)["HireDate"] == "date"
    assert spark.read.parquet(out + "_rejects").first().errors == ["BirthDate:type"]


def test_duplicates_orphans_counts(spark):
    sales = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, None, 3)], "SalesID long, SalesPersonID long, ProductID long")
    dups = [tuple(r) for r in quality.duplicate_keys(sales.withColumn("CustomerID", F.lit(1)), "sales").collect()]
    assert dups == [("sales", "primary_key(SalesID)", "1", 2)]
    countries = spark.createDataFrame([(1, "A", None), (2, "B", None), (3, "A", "AR")],
                                      "CountryID long, CountryName string, CountryCode string")
    dups = [tuple(r) for r in quality.duplicate_keys(countries, "countries").collect()]
    assert dups == [("countries", "unique(CountryName)", "A", 2)]  # null codes are not duplicates
    from mercato.operators import orphans

    emps = spark.createDataFrame([(10,)], "EmployeeID long")
    assert [r.SalesID for r in orphans(sales, "SalesPersonID", emps, "EmployeeID").collect()] == [1]


def test_star_quality_matches_expectations(star):
    tables = star.as_dict()
    counts = {(r.table, r.column): r.orphans for r in quality.orphan_counts(tables).collect()}
    assert set(counts.values()) == {0} and len(counts) == 7
    checks = {r.table: (r.rows, r.ok) for r in quality.row_count_check(tables).collect()}
    assert checks["countries"] == (5, False)


def test_sales_view_keeps_sales_without_seller(star):
    from mercato.plans import reports

    view = reports.sales_detail_view(star)
    assert view.count() == star.sales.count()
    no_seller = view.filter("ID_Empleado_Vendedor IS NULL")
    assert no_seller.count() == star.sales.filter("SalesPersonID IS NULL").count() > 0
    assert no_seller.filter("Nombre_Completo_Empleado_Vendedor IS NOT NULL").count() == 0


def test_orphan_counts_with_cut_parent(star):
    tables = star.as_dict()
    tables["products"] = star.products.filter("ProductID % 50 <> 0")  # a cut parent makes orphans
    counts = {(r.table, r.column): r.orphans for r in quality.orphan_counts(tables).collect()}
    expected = star.sales.filter("ProductID % 50 = 0").count()
    assert expected > 0 and counts[("sales", "ProductID")] == expected
    assert sum(v for k, v in counts.items() if k != ("sales", "ProductID")) == 0
    from mercato.operators import orphans

    assert orphans(tables["sales"], "ProductID", tables["products"], "ProductID").count() == expected


def test_validate_folder_summary(spark, tmp):
    write(os.path.join(tmp, "countries.csv"), "CountryID,CountryName,CountryCode\n1,Argentina,AR\nx,,BR\n")
    write(os.path.join(tmp, "categories.csv"), "CategoryID,CategoryName\n1,Produce\n")
    report, summary = quality.validate_folder(spark, tmp)
    rows = {r.table: r for r in summary.collect()}
    assert len(rows) == 7
    assert rows["countries.csv"].problems == 2 and not rows["countries.csv"].missing
    assert rows["categories.csv"].problems == 0
    assert rows["sales.csv"].missing and rows["sales.csv"].problems == 1
    assert rows["sales.csv"].total_problems == 2 + 5 and rows["sales.csv"].files_read == 2


def test_command_line_validate_and_load(tmp, capsys, spark):
    from mercato.__main__ import main

    write(os.path.join(tmp, "countries.csv"), "CountryID,CountryName,CountryCode\n1,Argentina,AR\n2,Chile,CL\n")
    write(os.path.join(tmp, "categories.csv"), "CategoryID,CategoryName\n1,Produce\n")
    out = os.path.join(tmp, "out")
    assert main(["--master", "local[2]", "load", tmp, out]) == 0
    text = capsys.readouterr().out
    assert "countries: 2 rows, 0 rejected" in text and "sales: no file" in text
    assert spark.read.parquet(os.path.join(out, "categories")).count() == 1
    write(os.path.join(tmp, "categories.csv"), "CategoryID,CategoryName\n1,Produce\nx,Dairy\n")
    assert main(["--master", "local[2]", "load", tmp, out]) == 2
    assert "categories: stopped, too many errors: 1 of 2 rows" in capsys.readouterr().out
    assert main(["--master", "local[2]", "validate", tmp]) == 1
    text = capsys.readouterr().out
    assert "categories.csv: 1 problems" in text and "sales.csv: missing" in text


def test_orphan_counts_read_the_fact_once(spark, star, tmp_path):
    # three foreign keys on sales, one pass over it (no per-key re-scan of the fact table)
    tables = star.as_dict()
    path = str(tmp_path / "sales")
    tables["sales"].write.parquet(path)
    tables["sales"] = spark.read.parquet(path)
    counts = quality.orphan_counts(tables)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [SalesID") == 1
    got = {(r.table, r.column): r.orphans for r in counts.collect()}
    assert got[("sales", "SalesPersonID")] == got[("sales", "CustomerID")] == got[("sales", "ProductID")] == 0
