"""The quality rules on whole tables made dirty by rule: every k-th key has a null, a bad number, a bad
time, a short name, and so on. :mod:`mercato.plans.dirty_sql` says the same in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators import quality
from mercato.sources.star import Star


def _every(key: str, column: str, *cases: tuple[int, str | None]) -> Column:
    """Text of ``column``, but the case's text where ``key`` is a multiple of the case's number."""
    out = F.col(column).cast("string")
    for k, text in reversed(cases):
        out = F.when(F.col(key) % k == 0, F.lit(text)).otherwise(out)
    return out.alias(column)


def sales_text(star: Star) -> DataFrame:
    """Sales as a file's text, dirty by rule."""
    sales = star.sales.withColumn("SalesDate", F.lit("21:49.2"))
    k = "SalesID"
    return sales.select(
        F.col(k).cast("string").alias(k),
        _every(k, "ProductID", (101, None)),
        F.col("CustomerID").cast("string").alias("CustomerID"),
        _every(k, "Quantity", (103, "3.7")),
        _every(k, "TotalPrice", (107, "abc"), (109, "1e3")),
        _every(k, "SalesDate", (113, "60:00"), (127, None)),
        _every(k, "SalesPersonID", (131, "x")),
    )


def products_text(star: Star) -> DataFrame:
    """Products as a file's text, dirty by rule."""
    k = "ProductID"
    return star.products.select(
        F.col(k).cast("string").alias(k),
        _every(k, "ProductName", (37, "X"), (43, None)),
        _every(k, "Price", (11, "1.50000"), (13, "-1"), (17, "abc"), (59, "1e-7")),
        _every(k, "CategoryID", (41, "12")),
        _every(k, "Class", (31, "Huge")),
        F.lit(None).cast("string").alias("ModifyDate"),
        _every(k, "Resistant", (47, "Soft")),
        _every(k, "IsAllergic", (29, "maybe")),
        _every(k, "VitalityDays", (19, "3651"), (23, "1200"), (53, None)),
    )


def validator(star: Star) -> DataFrame:
    """Report rows of the file validator for the dirty sales."""
    return quality.validate_text(sales_text(star), "sales.csv")


def validator_summary(star: Star) -> DataFrame:
    """The number of problems and the first five, a row each."""
    summary = quality.error_summary(validator(star), first=5)
    first = summary.select("table", "problems", F.explode("first_problems").alias("p"))
    return first.select("table", "problems", F.col("p.__n").alias("n"), "p.key", "p.column", "p.value", "p.rule")


def conformed_products(star: Star) -> DataFrame:
    """The dirty products after conversion, with the rules that each breaks."""
    found = quality.conform(products_text(star), "products")
    return found.select(
        "ProductID", "ProductName", "Price", "CategoryID", "VitalityDays", F.array_join(F.array_sort("errors"), ",").alias("errors")
    )


def strict_products(star: Star) -> DataFrame:
    """Report rows of the strict rules for the dirty products."""
    text = products_text(star)
    return quality.violations(text, "products", "ProductID", quality.entity_rules("products", "strict")).drop("message")


def customer_schema_violations(star: Star) -> DataFrame:
    """NOT NULL and length violations of customers with missing first names, long last names and initials."""
    k = "CustomerID"
    dirty = star.customers.withColumns({
        "FirstName": _every(k, "FirstName", (7, None)),
        "LastName": _every(k, "LastName", (11, "x" * 46)),
        "MiddleInitial": _every(k, "MiddleInitial", (13, "XY")),
    })
    return quality.schema_violations(dirty, "customers")


def cut_parent_orphans(star: Star) -> DataFrame:
    """Orphan counts against parents that miss some rows."""
    tables = star.as_dict()
    tables["products"] = star.products.where("ProductID % 50 <> 0")
    tables["employees"] = star.employees.where("EmployeeID % 9 <> 0")
    tables["cities"] = star.cities.where("CityID <> 3")
    return quality.orphan_counts(tables)
