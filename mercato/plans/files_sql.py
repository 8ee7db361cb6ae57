"""Plain SQL of :mod:`mercato.plans.files`: the same texts and files, what must come out said independently."""

from __future__ import annotations

from mercato.plans.dirty_sql import _DEC, _INT, PRODUCTS, SALES, _every, _text
from mercato.plans.duckdb_sql import with_star
from mercato.plans.files import FILE_KEYS

_C, _E, _CI, _CO, _CA = "CustomerID", "EmployeeID", "CityID", "CountryID", "CategoryID"
TEXTS = {
    "customers": f"""(SELECT {_text(_C)}, {_every(_C, "FirstName", (17, None))}, MiddleInitial, {_every(_C, "LastName", (19, "  "), (23, " Paz "))},
  {_every(_C, "CityID", (29, "x1"), (31, None))}, {_every(_C, "Address", (37, "NA"), (41, "null"))} FROM customers) t""",
    "employees": f"""(SELECT {_text(_E)}, FirstName, MiddleInitial, {_every(_E, "LastName", (13, None))}, {_every(_E, "Gender", (5, "XX"))},
  {_every(_E, "BirthDate", (7, "1985-02-30"), (11, "N/A"), text="'1985-03-15 00:00:00.000'")}, {_every(_E, "CityID", (17, None))},
  {_every(_E, "HireDate", (3, "01/02/2020"), (19, None), text="strftime(HireDate, '%Y-%m-%d') || ' 08:30:00.000'")} FROM employees) t""",
    "cities": f"(SELECT {_text(_CI)}, {_every(_CI, 'CityName', (5, None), (7, ' '))}, {_every(_CI, 'CountryID', (11, '1.5'))} FROM cities) t",
    "countries": f"(SELECT {_text(_CO)}, {_every(_CO, 'CountryName', (3, None))}, {_every(_CO, 'CountryCode', (4, 'ABC'))} FROM countries) t",
    "categories": f"(SELECT {_text(_CA)}, {_every(_CA, 'CategoryName', (4, None), (5, ''))} FROM categories) t",
    "products": PRODUCTS,
    "sales": SALES,
}


def _bad(column: str, kind: str) -> str:
    if kind == "date":
        return f"try_strptime(split_part(trim({column}), ' ', 1), '%Y-%m-%d') IS NULL"
    if kind == "time":
        return f"NOT regexp_full_match(trim({column}), '[0-5]?[0-9]:[0-5]?[0-9]([.][0-9]+)?')"
    return f"NOT regexp_full_match(trim({column}), '{_INT if kind == 'int' else _DEC}')"


_KIND = {"time": "time_mm_ss"}
# per file the validator's rules: required columns, and the checked kind of each column that has one
_RULES = {
    "customers": (("CustomerID", "FirstName", "LastName", "CityID"), {"CustomerID": "int", "CityID": "int"}),
    "employees": (("EmployeeID", "FirstName", "LastName", "CityID"), {"EmployeeID": "int", "CityID": "int", "BirthDate": "date", "HireDate": "date"}),
    "cities": (("CityID", "CityName", "CountryID"), {"CityID": "int", "CountryID": "int"}),
    "countries": (("CountryID", "CountryName"), {"CountryID": "int"}),
    "categories": (("CategoryID", "CategoryName"), {"CategoryID": "int"}),
    "products": (("ProductID", "ProductName", "Price", "CategoryID"), {"ProductID": "int", "Price": "decimal", "CategoryID": "int"}),
    "sales": (
        ("SalesID", "ProductID", "CustomerID", "Quantity", "TotalPrice"),
        {"SalesID": "int", "ProductID": "int", "CustomerID": "int", "Quantity": "int", "TotalPrice": "decimal", "SalesDate": "time", "SalesPersonID": "int"},
    ),
}


def _report(table: str, read: bool = False) -> str:
    """Report rows of a file; ``read``: after reading, where some texts are null."""
    required, kinds = _RULES[table]
    key, parts = required[0], []

    def value(c: str) -> str:
        return f"CASE WHEN {c} NOT IN ('', 'NA', 'N/A', 'NULL') THEN {c} END" if read else c

    for c in required:
        parts.append((c, "required", f"{value(c)} IS NULL", f"required value of ''{c}'' is empty"))
    for c, kind in kinds.items():
        parts.append((c, "type", f"{value(c)} IS NOT NULL AND {_bad(c, kind)}", f"value of ''{c}'' is not of type ''{_KIND.get(kind, kind)}''"))
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}.csv' AS "table", {key} AS "key", '{c}' AS "column", {value(c)} AS "value", '{rule}' AS rule, '{message}' AS message FROM {TEXTS[table]} WHERE {bad}"""
        for c, rule, bad, message in parts
    )


_ENTITIES = ("customers", "employees", "cities", "countries", "categories", "sales")


def _entity(table: str) -> list[tuple[str, str, str]]:
    required, kinds = _RULES[table]
    rules = [(c, "required", f"{c} IS NULL") for c in required]
    rules += [(c, "type", f"{c} IS NOT NULL AND {_bad(c, kind)}") for c, kind in kinds.items() if kind != "time"]
    return rules


_STRICT = {
    "customers": [("CustomerID", "id_positive", "CAST(CustomerID AS BIGINT) < 1"), ("FirstName", "name_empty", "trim(FirstName) = ''"), ("LastName", "name_empty", "trim(LastName) = ''")],
    "employees": [
        ("EmployeeID", "id_positive", "CAST(EmployeeID AS BIGINT) < 1"), ("FirstName", "name_empty", "trim(FirstName) = ''"),
        ("LastName", "name_empty", "trim(LastName) = ''"), ("Gender", "gender_length", "length(trim(Gender)) > 1"),
    ],
    "cities": [("CityID", "id_positive", "CAST(CityID AS BIGINT) < 1"), ("CityName", "name_empty", "trim(CityName) = ''")],
    "countries": [
        ("CountryID", "id_positive", "CAST(CountryID AS BIGINT) < 1"), ("CountryName", "name_empty", "trim(CountryName) = ''"),
        ("CountryCode", "country_code_length", "length(trim(CountryCode)) > 2"),
    ],
    "categories": [("CategoryID", "id_positive", "CAST(CategoryID AS BIGINT) < 1"), ("CategoryName", "name_empty", "trim(CategoryName) = ''")],
    "sales": [("SalesID", "id_positive", "CAST(SalesID AS BIGINT) < 1")],
}


def _errors(table: str) -> str:
    said = ", ".join(f"CASE WHEN {bad} THEN '{c}:{rule}' END" for c, rule, bad in _entity(table))
    return f"""SELECT '{table}' AS "table", {_RULES[table][0][0]} AS "key", array_to_string(list_sort(list_filter([{said}], lambda x: x IS NOT NULL)), ',') AS errors FROM {TEXTS[table]}"""


def _strict(table: str) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS "table", {_RULES[table][0][0]} AS "key", '{c}' AS "column", {c} AS "value", '{rule}' AS rule FROM {TEXTS[table]} WHERE {bad}"""
        for c, rule, bad in _entity(table) + _STRICT[table]
    )


_READ = "\nUNION ALL\n".join(_report(t, read=True) for t in _RULES if t not in ("cities", "categories"))
_FOLDER = f"""WITH report AS (SELECT "table", coalesce("key", '-') || '|' || "column" || '|' || rule AS said,
  row_number() OVER (PARTITION BY "table" ORDER BY "key" NULLS FIRST, "column", rule) AS n, count(*) OVER (PARTITION BY "table") AS problems FROM ({_READ}) r),
files AS (SELECT "table", CAST(max(problems) AS BIGINT) AS problems, string_agg(said, ';' ORDER BY n) FILTER (n <= 5) AS first_problems, false AS missing
  FROM report GROUP BY "table"
  UNION ALL SELECT 'cities.csv', 1, '-|CountryID|missing_columns', false UNION ALL SELECT 'categories.csv', 1, '-|missing_file', true),
every AS (SELECT unnest(['products.csv', 'sales.csv', 'employees.csv', 'customers.csv', 'categories.csv', 'cities.csv', 'countries.csv']) AS "table")
SELECT "table", coalesce(problems, 0) AS problems, first_problems, coalesce(missing, false) AS missing,
  CAST(sum(coalesce(problems, 0)) OVER () AS BIGINT) AS total_problems, CAST(6 AS BIGINT) AS files_read FROM every LEFT JOIN files USING ("table")"""


def _address(k: str) -> str:
    street = f"'Calle ' || {k}"
    return f"""CASE WHEN {k} % 7 = 0 THEN {street} || chr(10) || 'Piso 2, "B"' WHEN {k} % 11 = 0 THEN '"' || {street} || '"'
  WHEN {k} % 13 = 0 THEN chr(10) || chr(10) || {street} || chr(10) WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 3 = 0 THEN {street} || ', Rosario' ELSE {street} END"""


_RECORDS = f"""SELECT CustomerID, FirstName, MiddleInitial, LastName, CityID,
  CASE WHEN part % 2 = 1 THEN replace(a, chr(10), chr(13) || chr(10)) ELSE a END AS Address,
  row_number() OVER (PARTITION BY part ORDER BY CustomerID) + 1 AS record,
  CAST(2 + coalesce(sum(1 + length(coalesce(a, '')) - length(replace(coalesce(a, ''), chr(10), ''))) OVER (PARTITION BY part ORDER BY CustomerID
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line
FROM (SELECT *, CustomerID // {FILE_KEYS} AS part, {_address("CustomerID")} AS a FROM customers) c"""

_TIME = """CASE WHEN k % 17 = 0 THEN NULL WHEN k % 13 = 0 THEN '' WHEN k % 11 = 0 THEN '60:00' WHEN k % 7 = 0 THEN '10:05.1.2'
  WHEN k % 5 = 0 THEN '14:' || lpad(CAST(k % 60 AS VARCHAR), 2, '0') || ':59' WHEN k % 3 = 0 THEN '7:5.1234567'
  ELSE (k % 60) || ':' || lpad(CAST(k % 59 AS VARCHAR), 2, '0') || '.' || (k % 10) END"""

_LOADED = with_star(
    f"""SELECT CAST(CustomerID AS BIGINT) AS CustomerID, FirstName, MiddleInitial, trim(LastName) AS LastName,
  CASE WHEN Address NOT IN ('NA', '') THEN Address END AS Address, TRY_CAST(CityID AS BIGINT) AS CityID,
  concat_ws(',', CASE WHEN FirstName IS NULL THEN 'FirstName:required' END, CASE WHEN CityID = 'x1' THEN 'CityID:type' END) AS errors
FROM {TEXTS["customers"]} WHERE CAST(CustomerID AS BIGINT) % 31 <> 0"""
)

QUERIES = {
    "s1_s2_csv_records": with_star(_RECORDS),
    "s3_null_tokens": with_star(
        """SELECT CustomerID, CASE CustomerID % 9 WHEN 4 THEN 'null' WHEN 5 THEN ' NA' WHEN 6 THEN 'n/a' WHEN 7 THEN 'None' WHEN 8 THEN 'x' END AS texto FROM customers"""
    ),
    "s5_q7_load_customers": _LOADED,
    "s5_q7_replaced_customers": _LOADED,
    "q17_two_batch_duplicates": with_star("SELECT SalesID, COUNT(*) AS n FROM sales GROUP BY SalesID HAVING COUNT(*) > 1"),
    "j8_two_batch_orphans": with_star(
        """SELECT 1 AS batch, ProductID, COUNT(*) AS n FROM sales WHERE ProductID % 3 = 0 GROUP BY ProductID
UNION ALL SELECT 2, ProductID, COUNT(*) FROM sales WHERE ProductID % 15 = 0 GROUP BY ProductID"""
    ),
    "q1_q5_s7_validated_folder": with_star(f"SELECT * FROM ({_FOLDER}) x"),
    "q4_validator_files": with_star("\nUNION ALL\n".join(_report(t) for t in _RULES if t != "sales")),
    "q8_conform_entities": with_star("SELECT * FROM (" + "\nUNION ALL\n".join(map(_errors, _ENTITIES)) + ") e WHERE errors <> ''"),
    "q14_q16_strict_entities": with_star("\nUNION ALL\n".join(map(_strict, _ENTITIES))),
    "f6_f13_f14_cleaned_people": with_star(
        """SELECT EmployeeID, CASE WHEN EmployeeID % 3 <> 0 AND EmployeeID % 19 <> 0 THEN HireDate END AS ingreso,
  CASE WHEN EmployeeID % 7 <> 0 AND EmployeeID % 11 <> 0 THEN DATE '1985-03-15' END AS nacimiento,
  CASE WHEN EmployeeID % 2 = 0 OR EmployeeID % 5 <> 0 THEN MiddleInitial END AS inicial,
  CASE WHEN EmployeeID % 3 <> 0 AND EmployeeID % 13 <> 0 THEN LastName END AS apellido,
  CASE WHEN EmployeeID % 4 <> 0 AND EmployeeID % 7 <> 0 THEN CAST(EmployeeID AS DOUBLE) / 4 END AS cociente FROM employees"""
    ),
    "p9_f7_f8_parsed_times": with_star(
        f"""SELECT SalesID, ProductID, texto,
  CAST(CASE WHEN regexp_full_match(texto, '[0-9]+:[0-9]+[.][0-9]+') AND texto <> '60:00' THEN
    CASE WHEN texto = '7:5.1234567' THEN 425123456 ELSE ((k % 60) * 60 + k % 59) * 1000000 + (k % 10) * 100000 END END AS BIGINT) AS minutos,
  CAST(CASE WHEN regexp_full_match(texto, '14:[0-9]+:59') THEN (14 * 3600 + (k % 60) * 60 + 59) * 1000000
    WHEN texto = '7:5.1234567' THEN 425123456
    WHEN regexp_full_match(texto, '[0-9]+:[0-9]+[.][0-9]+') THEN ((k % 60) * 60 + k % 59) * 1000000 + (k % 10) * 100000 END AS BIGINT) AS hora
FROM (SELECT SalesID, ProductID, k, {_TIME} AS texto FROM (SELECT *, SalesID AS k FROM sales) s) t"""
    ),
}
