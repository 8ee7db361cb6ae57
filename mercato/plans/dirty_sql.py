"""Plain SQL of :mod:`mercato.plans.dirty`: the same dirty tables, the rules said independently."""

from __future__ import annotations

from mercato.plans.duckdb_sql import with_star


def _every(key: str, column: str, *cases: tuple[int, str | None], text: str | None = None) -> str:
    whens = " ".join(f"WHEN {key} % {k} = 0 THEN {'NULL' if t is None else repr(t)}" for k, t in cases)
    return f"CASE {whens} ELSE {text or f'CAST({column} AS VARCHAR)'} END AS {column}"


def _text(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in columns)


_S = "SalesID"
SALES = f"""(SELECT {_text(_S, "CustomerID")}, {_every(_S, "ProductID", (101, None))}, {_every(_S, "Quantity", (103, "3.7"))},
  {_every(_S, "TotalPrice", (107, "abc"), (109, "1e3"))}, {_every(_S, "SalesDate", (113, "60:00"), (127, None), text="'21:49.2'")},
  {_every(_S, "SalesPersonID", (131, "x"))} FROM sales) t"""
_INT, _DEC = "[+-]?[0-9]+", "[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?"
_FORMS = {"int": _INT, "decimal": _DEC, "time_mm_ss": "[0-5]?[0-9]:[0-5]?[0-9]([.][0-9]+)?"}
_SALES_RULES = [
    ("SalesID", "int", True), ("ProductID", "int", True), ("CustomerID", "int", True), ("Quantity", "int", True),
    ("TotalPrice", "decimal", True), ("SalesDate", "time_mm_ss", False), ("SalesPersonID", "int", False),
]


def _validator() -> str:
    parts = []
    for c, kind, required in _SALES_RULES:
        rows = f"""SELECT 'sales.csv' AS "table", SalesID AS "key", '{c}' AS "column", {c} AS "value","""
        if required:
            parts.append(f"{rows} 'required' AS rule, 'required value of ''{c}'' is empty' AS message FROM {SALES} WHERE {c} IS NULL")
        parts.append(
            f"{rows} 'type' AS rule, 'value of ''{c}'' is not of type ''{kind}''' AS message FROM {SALES} WHERE NOT regexp_full_match(trim({c}), '{_FORMS[kind]}')"
        )
    return "\nUNION ALL\n".join(parts)


_P = "ProductID"
PRODUCTS = f"""(SELECT {_text(_P)}, {_every(_P, "ProductName", (37, "X"), (43, None))},
  {_every(_P, "Price", (11, "1.50000"), (13, "-1"), (17, "abc"), (59, "1e-7"))}, {_every(_P, "CategoryID", (41, "12"))},
  {_every(_P, "Class", (31, "Huge"))}, {_every(_P, "Resistant", (47, "Soft"))}, {_every(_P, "IsAllergic", (29, "maybe"))},
  {_every(_P, "VitalityDays", (19, "3651"), (23, "1200"), (53, None))} FROM products) t"""
# (column, rule, condition): the rules that these tables can break
_CONFORM = [
    ("IsAllergic", "allergy_token", "upper(trim(IsAllergic)) NOT IN ('TRUE', 'FALSE', 'UNKNOWN')"),
    ("Price", "price_range", "TRY_CAST(Price AS DECIMAL(20,10)) < 0 OR TRY_CAST(Price AS DECIMAL(20,10)) > 999999.99"),
    ("Price", "price_scale", "Price = '1e-7' OR length(regexp_extract(Price, '[.]([0-9]*)$', 1)) > 4"),
    ("Price", "type", f"NOT regexp_full_match(Price, '{_DEC}')"),
    ("ProductName", "required", "ProductName IS NULL"),
    ("VitalityDays", "vitality_range", "CAST(VitalityDays AS BIGINT) NOT BETWEEN 0 AND 3650"),
]
_STRICT = [
    ("ProductID", "id_positive", "CAST(ProductID AS BIGINT) <= 0"),
    ("ProductName", "name_length", "length(trim(ProductName)) NOT BETWEEN 2 AND 100"),
    ("CategoryID", "category_domain", "CAST(CategoryID AS BIGINT) NOT BETWEEN 1 AND 11"),
    ("Class", "class_domain", "Class NOT IN ('Low', 'Medium', 'High')"),
    ("Resistant", "resistance_domain", "Resistant NOT IN ('Durable', 'Weak', 'Unknown')"),
    ("VitalityDays", "perishable_needs_shelf_life", "VitalityDays IS NULL AND CAST(CategoryID AS BIGINT) IN (2, 4, 6, 7, 10)"),
]
_STRICT_ROWS = "\nUNION ALL\n".join(
    f"""SELECT 'products' AS "table", ProductID AS "key", '{c}' AS "column", {c} AS "value", '{rule}' AS rule FROM {PRODUCTS} WHERE {bad}"""
    for c, rule, bad in _CONFORM + _STRICT
)
_ERRORS = ", ".join(f"CASE WHEN {bad} THEN '{c}:{rule}' END" for c, rule, bad in _CONFORM)

_LONG = "x" * 46
CUSTOMERS = f"""(SELECT CustomerID, {_every("CustomerID", "FirstName", (7, None), text="FirstName")},
  {_every("CustomerID", "LastName", (11, _LONG), text="LastName")},
  {_every("CustomerID", "MiddleInitial", (13, "XY"), text="MiddleInitial")} FROM customers) t"""
_CUSTOMER_RULES = [
    ("FirstName", "not_null", "FirstName is NOT NULL", "FirstName IS NULL"),
    ("LastName", "max_length", "LastName longer than 45", "length(LastName) > 45"),
    ("MiddleInitial", "max_length", "MiddleInitial longer than 1", "length(MiddleInitial) > 1"),
]

_CUT = {"products": "ProductID % 50 <> 0", "employees": "EmployeeID % 9 <> 0", "cities": "CityID <> 3"}
_KEYS = [
    ("cities", "CountryID", "countries", "CountryID"), ("customers", "CityID", "cities", "CityID"), ("employees", "CityID", "cities", "CityID"),
    ("products", "CategoryID", "categories", "CategoryID"), ("sales", "SalesPersonID", "employees", "EmployeeID"),
    ("sales", "CustomerID", "customers", "CustomerID"), ("sales", "ProductID", "products", "ProductID"),
]

QUERIES = {
    "q2_q3_validator": with_star(_validator()),
    "q5_error_summary": with_star(
        f"""SELECT "table", problems, n, "key", "column", "value", rule FROM (
SELECT *, count(*) OVER () AS problems, CAST(row_number() OVER (ORDER BY "key" NULLS FIRST, "column", rule) AS INTEGER) AS n
FROM ({_validator()}) r) s WHERE n <= 5"""
    ),
    "q6_q16_conform": with_star(
        f"""SELECT CAST(ProductID AS BIGINT) AS ProductID, ProductName, TRY_CAST(Price AS DECIMAL(10,4)) AS Price, CAST(CategoryID AS BIGINT) AS CategoryID,
  CAST(VitalityDays AS DECIMAL(4,0)) AS VitalityDays, concat_ws(',', {_ERRORS}) AS errors FROM {PRODUCTS}"""
    ),
    "q6_q16_strict": with_star(_STRICT_ROWS),
    "q18_schema_violations_dirty": with_star(
        "\nUNION ALL\n".join(
            f"""SELECT 'customers' AS "table", CAST(CustomerID AS VARCHAR) AS "key", '{c}' AS "column", {c} AS "value", '{rule}' AS rule, '{message}' AS message
FROM {CUSTOMERS} WHERE {bad}"""
            for c, rule, message, bad in _CUSTOMER_RULES
        )
    ),
    "q21_orphan_counts_cut_parents": with_star(
        "\nUNION ALL\n".join(
            f"""SELECT '{t}' AS "table", '{c}' AS "column", '{p}' AS parent, COUNT(*) AS orphans
FROM (SELECT * FROM {t} WHERE {_CUT.get(t, "true")}) x
WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM {p} WHERE {_CUT.get(p, "true")}) y WHERE y.{k} = x.{c})"""
            for t, c, p, k in _KEYS
        )
    ),
    "r7_cheapest_products": with_star("SELECT ProductName, Price, ProductID FROM products WHERE Price < 1000 ORDER BY Price ASC, ProductID LIMIT 3"),
    "r1_spec_bound_values": with_star(
        """SELECT c.CategoryName AS "Categoría", p.ProductName AS Producto, CAST(SUM(s.Quantity) AS BIGINT) AS TotalVendido
FROM sales s JOIN products p ON s.ProductID = p.ProductID JOIN categories c ON p.CategoryID = c.CategoryID
WHERE p.Price > 950 GROUP BY c.CategoryName, p.ProductName HAVING SUM(s.Quantity) > 100 AND COUNT(*) > 1
ORDER BY TotalVendido DESC, "Categoría", Producto LIMIT 20"""
    ),
}
