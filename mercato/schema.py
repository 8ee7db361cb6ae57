"""The star schema: tables, column types, keys and the CSV file layouts.

Identifier columns are LongType (the declared INT would overflow at 100 TB row counts);
times of day are LongType microseconds since 00:00.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


@dataclass(frozen=True)
class Col:
    name: str
    dtype: DataType
    required: bool = False  # NOT NULL
    max_len: int | None = None  # VARCHAR(n) / CHAR(n)


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Col, ...]
    primary_key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    # (column, parent table, parent column, nullable reference)
    foreign_keys: tuple[tuple[str, str, str], ...] = ()
    # CSV column order when it differs from the table order
    file_columns: tuple[str, ...] | None = None
    crlf: bool = False

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> StructType:
        return StructType([StructField(c.name, c.dtype, True) for c in self.columns])

    def col(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


ID = LongType()
TIME_US = LongType()

# FIXED VALUES: the seven tables as declared (names, order, NOT NULL, lengths, decimals, keys).
COUNTRIES = Table(
    "countries",
    (Col("CountryID", ID, True), Col("CountryName", StringType(), True, 45), Col("CountryCode", StringType(), False, 2)),
    primary_key=("CountryID",),
    unique=(("CountryName",), ("CountryCode",)),
)
CITIES = Table(
    "cities",
    (
        Col("CityID", ID, True),
        Col("CityName", StringType(), True, 45),
        Col("Zipcode", StringType(), False, 10),
        Col("CountryID", ID, True),
    ),
    primary_key=("CityID",),
    foreign_keys=(("CountryID", "countries", "CountryID"),),
    crlf=True,
)
CATEGORIES = Table(
    "categories",
    (Col("CategoryID", ID, True), Col("CategoryName", StringType(), True, 45)),
    primary_key=("CategoryID",),
    unique=(("CategoryName",),),
)
CUSTOMERS = Table(
    "customers",
    (
        Col("CustomerID", ID, True),
        Col("FirstName", StringType(), True, 45),
        Col("MiddleInitial", StringType(), False, 1),
        Col("LastName", StringType(), True, 45),
        Col("Address", StringType(), False, 90),
        Col("CityID", ID, True),
    ),
    primary_key=("CustomerID",),
    foreign_keys=(("CityID", "cities", "CityID"),),
    file_columns=("CustomerID", "FirstName", "MiddleInitial", "LastName", "CityID", "Address"),
)
EMPLOYEES = Table(
    "employees",
    (
        Col("EmployeeID", ID, True),
        Col("FirstName", StringType(), True, 45),
        Col("MiddleInitial", StringType(), False, 1),
        Col("LastName", StringType(), True, 45),
        Col("BirthDate", DateType()),
        Col("Gender", StringType(), False, 1),
        Col("CityID", ID, True),
        Col("HireDate", DateType()),
    ),
    primary_key=("EmployeeID",),
    foreign_keys=(("CityID", "cities", "CityID"),),
)
PRODUCTS = Table(
    "products",
    (
        Col("ProductID", ID, True),
        Col("ProductName", StringType(), True, 45),
        Col("Price", DecimalType(10, 4), True),
        Col("CategoryID", ID, True),
        Col("Class", StringType(), False, 45),
        Col("ModifyDate", TIME_US),
        Col("Resistant", StringType(), False, 45),
        Col("IsAllergic", StringType(), False, 10),
        Col("VitalityDays", DecimalType(4, 0)),  # the rule allows up to 3650
    ),
    primary_key=("ProductID",),
    foreign_keys=(("CategoryID", "categories", "CategoryID"),),
    crlf=True,
)
SALES = Table(
    "sales",
    (
        Col("SalesID", ID, True),
        Col("SalesPersonID", ID),
        Col("ProductID", ID, True),
        Col("CustomerID", ID, True),
        Col("Quantity", IntegerType(), True),
        Col("Discount", DecimalType(10, 2)),
        Col("TotalPrice", DecimalType(10, 2), True),
        Col("SalesDate", TIME_US),
        Col("TransactionNumber", StringType(), False, 255),
    ),
    primary_key=("SalesID",),
    foreign_keys=(
        ("SalesPersonID", "employees", "EmployeeID"),
        ("CustomerID", "customers", "CustomerID"),
        ("ProductID", "products", "ProductID"),
    ),
    crlf=True,
)

TABLES: dict[str, Table] = {
    t.name: t for t in (COUNTRIES, CITIES, CATEGORIES, CUSTOMERS, EMPLOYEES, PRODUCTS, SALES)
}
# load order (parents first)
LOAD_ORDER = ("countries", "cities", "categories", "customers", "employees", "products", "sales")

# FIXED VALUES: expected row counts of the full retail data set.
EXPECTED_ROWS = {"countries": 206, "sales": 50_000}

#: the column of a file row's first field beyond the table's columns
SURPLUS = "_surplus"
#: of a file's record: its first line, its number (both from 1), whether its quote isn't closed
LINE, RECORD, UNCLOSED = "_line", "_record", "_unclosed"

__all__ = [
    "Col",
    "Table",
    "TABLES",
    "LOAD_ORDER",
    "EXPECTED_ROWS",
    "SURPLUS",
    "LINE",
    "RECORD",
    "UNCLOSED",
]
