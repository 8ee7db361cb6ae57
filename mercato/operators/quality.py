"""Data-quality rules as column expressions.

Every check yields rows ``(table, key, column, value, rule, message)``: one pass per table, the
violations of all rules of a row packed in an array and exploded (no Python per row, no UDF).

Levels of the entity rules:
* ``conform``: what the loaders enforce (types, required values, price range and scale, shelf-life
  range, positive quantity, non-negative discount, allergy token);
* ``strict``: adds name lengths, ID / category / class / resistance domains, perishable categories
  needing a shelf life, non-empty names, gender and country-code lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mercato.functions.names import initial, trim_to_null
from mercato.functions.products import allergy_flag, allergy_is_valid
from mercato.functions.temporal import date_prefix, mmss_micros, time_micros
from mercato.operators.joins import orphans
from mercato.schema import EXPECTED_ROWS, RECORD, SURPLUS, TABLES, UNCLOSED, Table
from mercato.session import scratch

REPORT_COLUMNS = ["table", "key", "column", "value", "rule", "message"]

# ----------------------------------------------------------------------------------- validator
# FIXED VALUES: the file validator's rule sets: expected columns, then per column (type, required).
VALIDATION = {
    "products.csv": (
        ["ProductID", "ProductName", "Price", "CategoryID", "ModifyDate"],
        {"ProductID": ("int", True), "ProductName": ("str", True), "Price": ("decimal", True),
         "CategoryID": ("int", True), "ModifyDate": ("time_mm_ss", False)},
    ),
    "sales.csv": (
        ["SalesID", "ProductID", "CustomerID", "Quantity", "TotalPrice", "SalesDate"],
        {"SalesID": ("int", True), "ProductID": ("int", True), "CustomerID": ("int", True),
         "Quantity": ("int", True), "TotalPrice": ("decimal", True), "SalesDate": ("time_mm_ss", False),
         "SalesPersonID": ("int", False)},
    ),
    "employees.csv": (
        ["EmployeeID", "FirstName", "LastName", "CityID", "BirthDate", "HireDate"],
        {"EmployeeID": ("int", True), "FirstName": ("str", True), "LastName": ("str", True),
         "CityID": ("int", True), "BirthDate": ("date", False), "HireDate": ("date", False)},
    ),
    "customers.csv": (
        ["CustomerID", "FirstName", "LastName", "CityID"],
        {"CustomerID": ("int", True), "FirstName": ("str", True), "LastName": ("str", True),
         "CityID": ("int", True)},
    ),
    "categories.csv": (
        ["CategoryID", "CategoryName"],
        {"CategoryID": ("int", True), "CategoryName": ("str", True)},
    ),
    "cities.csv": (
        ["CityID", "CityName", "CountryID"],
        {"CityID": ("int", True), "CityName": ("str", True), "CountryID": ("int", True)},
    ),
    "countries.csv": (
        ["CountryID", "CountryName"],
        {"CountryID": ("int", True), "CountryName": ("str", True)},
    ),
}

_DECIMAL_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def is_int_text(c: Column) -> Column:
    return F.trim(c).try_cast("long").isNotNull()


def is_decimal_text(c: Column) -> Column:
    return F.trim(c).rlike(_DECIMAL_TEXT)


def type_ok(kind: str, c: Column) -> Column:
    """Is the (non-null) text ``c`` a valid value of the validator type ``kind``?"""
    if kind == "int":
        return is_int_text(c)
    if kind == "decimal":
        return is_decimal_text(c)
    if kind == "date":
        return date_prefix(c).isNotNull()
    if kind == "time_mm_ss":
        return mmss_micros(c).isNotNull()
    if kind == "str":
        return F.lit(True)
    raise ValueError(f"unknown type {kind!r}")


@dataclass(frozen=True)
class Rule:
    column: str
    rule: str
    bad: Column  # true when the row violates the rule
    message: str


def violations(df: DataFrame, table: str, key: Column | str, rules: list[Rule]) -> DataFrame:
    """One report row per (row, violated rule), in one pass over ``df``. Messages name the row's number in
    its file where ``df`` has it."""
    key_col = F.col(key) if isinstance(key, str) else key
    row = F.concat(F.lit("row "), F.col(RECORD), F.lit(": ")) if RECORD in df.columns else F.lit("")
    if not rules:
        return df.sparkSession.createDataFrame([], "table string, key string, column string, value string, rule string, message string")
    cells = [
        F.when(
            r.bad,
            F.struct(
                F.lit(r.column).alias("column"),
                F.col(r.column).cast("string").alias("value"),
                F.lit(r.rule).alias("rule"),
                F.concat(row, F.lit(r.message)).alias("message"),
            ),
        )
        for r in rules
    ]
    found = F.filter(F.array(*cells), lambda s: s.isNotNull())
    return df.select(key_col.cast("string").alias("key"), F.explode(found).alias("v")).select(
        F.lit(table).alias("table"), "key", "v.column", "v.value", "v.rule", "v.message"
    )


def missing_columns(df: DataFrame, file_name: str) -> list[str]:
    expected, _ = VALIDATION[file_name]
    return [c for c in expected if c not in df.columns]


def validate_text(df: DataFrame, file_name: str) -> DataFrame:
    """Check a text frame read from ``file_name`` with the validator's rules.

    Missing expected columns give one report row and stop; extra columns are ignored; rule
    columns absent from the file are skipped. A required null gives ``required``; a non-null value
    of the wrong type gives ``type``; nulls skip the type check.
    """
    spark = df.sparkSession
    miss = missing_columns(df, file_name)
    if miss:
        return spark.createDataFrame(
            [(file_name, None, ",".join(sorted(miss)), None, "missing_columns", "missing expected columns")],
            "table string, key string, column string, value string, rule string, message string",
        )
    expected, checks = VALIDATION[file_name]
    rules = []
    for col, (kind, required) in checks.items():
        if col not in df.columns:
            continue
        c = F.col(col)
        if required:
            rules.append(Rule(col, "required", c.isNull(), f"required value of '{col}' is empty"))
        rules.append(Rule(col, "type", c.isNotNull() & ~type_ok(kind, c), f"value of '{col}' is not of type '{kind}'"))
    return violations(df, file_name, F.col(expected[0]), rules + _surplus_rule(df))


def _surplus_rule(df: DataFrame) -> list[Rule]:
    """Rows with more fields than the file has columns, where ``df`` has the first of them, and rows of an
    unclosed quote, where it says so."""
    found = []
    if SURPLUS in df.columns:
        found.append(Rule(SURPLUS, "malformed_row", F.col(SURPLUS).isNotNull(), "more fields than columns"))
    if UNCLOSED in df.columns:
        found.append(Rule(UNCLOSED, "malformed_row", F.col(UNCLOSED), "a quote isn't closed"))
    return found


def validate_file(spark, path: str, file_name: str) -> DataFrame:
    """Read ``path`` as text (header names the columns) and validate it; a missing file gives one
    ``missing_file`` report row."""
    from mercato.sources.csv import MissingFile, read_text_csv

    try:
        df = read_text_csv(spark, path, (*read_text_csv(spark, path).columns, SURPLUS), numbers=True)
    except MissingFile:
        return spark.createDataFrame(
            [(file_name, None, None, path, "missing_file", "file not found")],
            "table string, key string, column string, value string, rule string, message string",
        )
    return validate_text(df, file_name)


def error_summary(report: DataFrame, first: int = 5) -> DataFrame:
    """Per table: number of problems and the first ``first`` of them (by key, rule, column).

    The first-``first`` cut is a ``row_number() <= first`` window that Spark limits per task before
    the shuffle, so a table with millions of problems ships only ``first`` rows per task.
    """
    w = Window.partitionBy("table").orderBy(F.col("key").asc_nulls_first(), "column", "rule")
    counts = report.groupBy("table").agg(F.count(F.lit(1)).alias("problems"))
    firsts = (
        report.withColumn("__n", F.row_number().over(w))
        .filter(F.col("__n") <= first)
        .groupBy("table")
        .agg(F.sort_array(F.collect_list(F.struct("__n", "key", "column", "value", "rule"))).alias("first_problems"))
    )
    return counts.join(firsts, "table")


# --------------------------------------------------------------------------------- entity rules
# FIXED VALUES: entity rule domains.
PRICE_MAX = "999999.99"
PRICE_MAX_DECIMALS = 4
VITALITY_MAX_DAYS = 3650
CATEGORY_IDS = (1, 11)  # inclusive range of valid category IDs
PRODUCT_CLASSES = ("Low", "Medium", "High")
RESISTANCE_LEVELS = ("Durable", "Weak", "Unknown")
PERISHABLE_CATEGORIES = (2, 4, 6, 7, 10)
NAME_LENGTH = (2, 100)
# FIXED VALUES: required fields per entity when creating records.
REQUIRED = {
    "customers": ["CustomerID", "FirstName", "LastName", "CityID"],
    "employees": ["EmployeeID", "FirstName", "LastName", "CityID"],
    "products": ["ProductID", "ProductName", "Price", "CategoryID"],
    "sales": ["SalesID", "ProductID", "CustomerID", "Quantity", "TotalPrice"],
    "categories": ["CategoryID", "CategoryName"],
    "cities": ["CityID", "CityName", "CountryID"],
    "countries": ["CountryID", "CountryName"],
}


def _decimals_in_text(c: Column) -> Column:
    """Number of digits after the point as written (``1.50000`` has 5, ``1e-7`` has 7)."""
    t = F.lower(F.trim(c))
    digits = F.substring_index(t, "e", 1)
    written = F.when(digits.contains("."), F.length(F.substring_index(digits, ".", -1))).otherwise(F.lit(0))
    exponent = F.when(t.contains("e"), F.coalesce(F.substring_index(t, "e", -1).try_cast("int"), F.lit(0))).otherwise(F.lit(0))
    return F.greatest(written - exponent, F.lit(0))


def typed_columns(table: str) -> dict[str, Column]:
    """Typed value of every column of ``table`` from its text column (null when unparsable)."""
    t = TABLES[table]
    out: dict[str, Column] = {}
    for c in t.columns:
        src = F.col(c.name)
        name = c.name
        dt = c.dtype.simpleString()
        if name in ("BirthDate", "HireDate"):
            out[name] = date_prefix(src)
        elif name in ("ModifyDate", "SalesDate"):
            out[name] = time_micros(src)
        elif dt in ("bigint", "int"):
            out[name] = F.trim(src).try_cast(dt)
        elif dt.startswith("decimal"):
            out[name] = F.trim(src).try_cast(dt)
        elif name == "MiddleInitial":
            out[name] = initial(src)
        elif name in ("FirstName", "LastName", "ProductName", "CategoryName", "CityName", "CountryName", "Zipcode", "CountryCode"):
            out[name] = F.trim(src)
        elif name in ("Class", "Resistant", "Gender", "Address", "TransactionNumber"):
            out[name] = trim_to_null(src)
        else:
            out[name] = src
    return out


def entity_rules(table: str, level: str = "conform") -> list[Rule]:
    """Rules on the *text* columns of ``table`` (``level`` is ``conform`` or ``strict``)."""
    if level not in ("conform", "strict"):
        raise ValueError("level must be 'conform' or 'strict'")
    t = TABLES[table]
    typed = typed_columns(table)
    rules: list[Rule] = []
    for name in REQUIRED[table]:
        rules.append(Rule(name, "required", F.col(name).isNull(), f"required field {name} is missing"))
    for c in t.columns:
        src = F.col(c.name)
        if c.name in ("BirthDate", "HireDate"):
            rules.append(Rule(c.name, "type", src.isNotNull() & typed[c.name].isNull(), f"{c.name} is not a date"))
        elif c.name in ("ModifyDate", "SalesDate"):
            continue  # a time that can't be read becomes null, as on creating an entity
        elif c.dtype.simpleString() in ("bigint", "int") or c.dtype.simpleString().startswith("decimal"):
            if c.name == "VitalityDays":
                bad = src.isNotNull() & F.trim(src).try_cast("long").isNull()
            else:
                bad = src.isNotNull() & typed[c.name].isNull()
            rules.append(Rule(c.name, "type", bad, f"{c.name} is not numeric"))
    if table == "products":
        price = F.trim(F.col("Price")).try_cast("decimal(38,10)")
        rules += [
            Rule("Price", "price_range", (price < 0) | (price > F.lit(PRICE_MAX).cast("decimal(38,10)")),
                 "price must be between 0 and 999999.99"),
            Rule("Price", "price_scale", F.col("Price").isNotNull() & (_decimals_in_text(F.col("Price")) > PRICE_MAX_DECIMALS),
                 "price has more than 4 decimals"),
        ]
        days = F.trim(F.col("VitalityDays")).try_cast("long")
        rules.append(Rule("VitalityDays", "vitality_range", (days < 0) | (days > VITALITY_MAX_DAYS),
                          "shelf life must be 0..3650 days"))
        rules.append(Rule("IsAllergic", "allergy_token", ~allergy_is_valid(F.col("IsAllergic")),
                          "allergy must be TRUE, FALSE or Unknown"))
    if table == "sales":
        q = typed["Quantity"]
        rules.append(Rule("Quantity", "quantity_positive", q.isNotNull() & (q <= 0), "quantity must be a positive integer"))
        d = F.trim(F.col("Discount")).try_cast("double")  # the sign as written, before rounding to two decimals
        rules.append(Rule("Discount", "discount_non_negative", d.isNotNull() & (d < 0), "discount cannot be negative"))
    if level == "strict":
        rules += _strict_rules(table, typed)
    return rules


def _strict_rules(table: str, typed: dict[str, Column]) -> list[Rule]:
    rules: list[Rule] = []
    pk = TABLES[table].primary_key[0]
    rules.append(Rule(pk, "id_positive", typed[pk].isNotNull() & (typed[pk] <= 0), f"{pk} must be positive"))
    for name in ("FirstName", "LastName", "CategoryName", "CityName", "CountryName"):
        if name in typed:
            rules.append(Rule(name, "name_empty", F.col(name).isNotNull() & (F.length(F.trim(F.col(name))) == 0),
                              f"{name} cannot be empty"))
    if table == "products":
        n = F.length(F.trim(F.col("ProductName")))
        lo, hi = NAME_LENGTH
        rules.append(Rule("ProductName", "name_length", F.col("ProductName").isNotNull() & ~n.between(lo, hi),
                          "product name must have 2..100 characters"))
        cat = typed["CategoryID"]
        rules.append(Rule("CategoryID", "category_domain", cat.isNotNull() & ~cat.between(*CATEGORY_IDS),
                          "category ID must be 1..11"))
        cls = trim_to_null(F.col("Class"))
        rules.append(Rule("Class", "class_domain", cls.isNotNull() & ~cls.isin(*PRODUCT_CLASSES),
                          "class must be Low, Medium or High"))
        res = trim_to_null(F.col("Resistant"))
        rules.append(Rule("Resistant", "resistance_domain", res.isNotNull() & ~res.isin(*RESISTANCE_LEVELS),
                          "resistance must be Durable, Weak or Unknown"))
        rules.append(Rule("VitalityDays", "perishable_needs_shelf_life",
                          cat.isin(*PERISHABLE_CATEGORIES) & F.col("VitalityDays").isNull(),
                          "perishable category needs a shelf life"))
    if table == "employees":
        rules.append(Rule("Gender", "gender_length", F.length(F.trim(F.col("Gender"))) > 1, "gender must be one character"))
    if table == "countries":
        rules.append(Rule("CountryCode", "country_code_length", F.length(F.trim(F.col("CountryCode"))) > 2,
                          "country code must have at most 2 characters"))
    return rules


def conform(text_df: DataFrame, table: str, level: str = "conform") -> DataFrame:
    """Typed columns of ``table`` plus ``errors`` (array of violated rule names, empty when clean) and
    ``raw``, the text columns as read where there are errors, so that rejects can be mended.

    ``text_df`` holds the table's columns as text (see :func:`mercato.sources.csv.read_table_csv`) and
    may have a row's first surplus field.
    """
    rules = entity_rules(table, level) + _surplus_rule(text_df)
    errs = F.filter(
        F.array(*[F.when(r.bad, F.lit(f"{r.column}:{r.rule}")) for r in rules]), lambda x: x.isNotNull()
    )
    typed = typed_columns(table)
    extra = [F.col("IsAllergic").alias("IsAllergic")] if table == "products" else []
    cols = [typed[c].alias(c) for c in TABLES[table].column_names if not (table == "products" and c == "IsAllergic")]
    raw = F.when(F.size(errs) > 0, F.struct(*text_df.columns)).alias("raw")
    return text_df.select(*cols, *extra, errs.alias("errors"), raw)


def allergy_column(df: DataFrame) -> DataFrame:
    """Add the parsed allergy flag ``Allergic`` (boolean) next to the ``IsAllergic`` text."""
    return df.withColumn("Allergic", allergy_flag("IsAllergic"))


class TooManyErrors(RuntimeError):
    pass


def check_error_rate(flagged: DataFrame, max_fraction: float = 0.1) -> tuple[int, int]:
    """Fail when more than ``max_fraction`` of the rows have errors (exactly 10 % passes).

    One aggregation returning one row; an empty input passes.
    """
    row = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("errors") > 0, 1)).alias("bad")
    ).first()
    n, bad = int(row["n"]), int(row["bad"])
    if bad > max_fraction * n:
        raise TooManyErrors(f"too many errors: {bad} of {n} rows")
    return bad, n


def load_csv_table(spark, csv_path: str, table: str, out_path: str, level: str = "conform", max_fraction: float = 0.1):
    """CSV -> checked, typed Parquet. Rows with errors go to ``out_path + '_rejects'``.

    The flagged rows are written once to a staging folder next to the output; the error-rate gate
    and both outputs read that staging copy, so the CSV is parsed once.
    """
    from mercato.sources.csv import read_table_csv

    flagged = conform(read_table_csv(spark, csv_path, table, surplus=True), table, level)
    staging = out_path.rstrip("/") + "_staging"
    flagged.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    bad, n = check_error_rate(staged, max_fraction)
    staged.filter(F.size("errors") == 0).drop("errors", "raw").write.mode("overwrite").parquet(out_path)
    staged.filter(F.size("errors") > 0).write.mode("overwrite").parquet(out_path.rstrip("/") + "_rejects")
    return {"table": table, "rows": n, "rejected": bad}


#: in a loaded state: whether the row broke a rule
REJECTED = "_rejected"


def load_csv_snapshot(spark, csv_path: str, table: str, path: str, level: str = "conform", max_fraction: float = 0.1):
    """CSV -> checked, typed state of the table at ``path``, replaced as a whole.

    One pass: the file is read once and written once, good rows and rejects side by side (partitioned by
    ``_rejected``), while the rows are counted. Only when at most ``max_fraction`` of them are rejected does
    the new state become the current one (:mod:`mercato.sources.snapshots`). A load that fails or dies at any
    point leaves the old state, its rows and rejects together. Read with :func:`loaded_rows` and
    :func:`loaded_rejects`.
    """
    from mercato.sources import snapshots
    from mercato.sources.csv import read_table_csv

    bad = F.size("errors") > 0
    flagged = conform(read_table_csv(spark, csv_path, table, surplus=True), table, level).withColumn(REJECTED, bad)
    counts = Observation()
    watched = flagged.observe(counts, F.count(F.lit(1)).alias("n"), F.count_if(F.col(REJECTED)).alias("bad"))
    folder = snapshots.new_state(path)
    # an empty file has a state too
    watched.write.partitionBy(REJECTED).parquet(f"{folder}")
    n, rejected = counts.get["n"], counts.get["bad"]
    if rejected > max_fraction * n:
        raise TooManyErrors(f"too many errors: {rejected} of {n} rows")
    return {"table": table, "rows": n, "rejected": rejected, "state": snapshots.switch(spark, path, folder)}


def _loaded(spark, path: str, table: str) -> DataFrame:
    from mercato.sources import snapshots

    folder = snapshots.current(spark, path)
    if folder is None:
        raise ValueError(f"nothing was loaded at {path!r}")
    text = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*TABLES[table].column_names, SURPLUS, UNCLOSED])).withColumn(UNCLOSED, F.lit(False))
    schema = conform(text, table).schema.add(REJECTED, "boolean")
    return spark.read.schema(schema).parquet(folder)


def loaded_rows(spark, path: str, table: str) -> DataFrame:
    """Good rows of the current state of :func:`load_csv_snapshot`; the rejects' files aren't read."""
    return _loaded(spark, path, table).where(~F.col(REJECTED)).drop("errors", "raw", REJECTED)


def loaded_rejects(spark, path: str, table: str) -> DataFrame:
    """Rejects of the current state with their errors and their text as read."""
    return _loaded(spark, path, table).where(F.col(REJECTED)).drop(REJECTED)


# ---------------------------------------------------------------------------- keys and schema
def duplicate_keys(df: DataFrame, table: str | Table) -> DataFrame:
    """Primary-key and unique-key values held by more than one row: ``(table, constraint, key, n)``.

    Nulls are allowed (and not compared) in unique keys. Counting is a map-side combined
    aggregation on the typed key columns, so a hot key value costs one row per task; the key text
    (values joined by ``|``) is built only for the duplicated keys.
    """
    t = TABLES[table] if isinstance(table, str) else table
    parts = []
    for kind, cols in [("primary_key", t.primary_key)] + [("unique", u) for u in t.unique]:
        g = df
        if kind == "unique":
            for c in cols:
                g = g.filter(F.col(c).isNotNull())
        parts.append(
            g.groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1)
            .select(
                F.lit(t.name).alias("table"),
                F.lit(f"{kind}({','.join(cols)})").alias("constraint"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"),
                "n",
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_violations(df: DataFrame, table: str | Table) -> DataFrame:
    """NOT NULL and VARCHAR(n) length violations of a typed table (report rows)."""
    t = TABLES[table] if isinstance(table, str) else table
    rules = []
    for c in t.columns:
        if c.required:
            rules.append(Rule(c.name, "not_null", F.col(c.name).isNull(), f"{c.name} is NOT NULL"))
        if c.max_len is not None:
            rules.append(Rule(c.name, "max_length", F.length(F.col(c.name)) > c.max_len, f"{c.name} longer than {c.max_len}"))
    return violations(df, t.name, F.col(t.primary_key[0]), rules)


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """For every foreign key: rows whose non-null reference has no parent ``(table, column, parent, orphans)``.

    Each child table is read once, whatever its number of foreign keys: its references are exploded
    into ``(fk index, key)`` pairs and counted per pair (a map-side combined aggregation, so a key
    holding a third of all rows costs one row per task). One anti-join against the parent keys,
    tagged with the index of the foreign key they serve, leaves the missing keys; their counts are
    summed per foreign key in one global aggregate (one row per task before the single final step).
    """
    parts = []
    for name in TABLES:
        fks = TABLES[name].foreign_keys
        if not fks:
            continue
        child = tables[name]
        integral = all(isinstance(child.schema[c].dataType, IntegralType) for c, _, _ in fks)
        key_type = "long" if integral else "string"
        refs = F.inline(
            F.array(*[F.struct(F.lit(i).alias("__i"), F.col(c).cast(key_type).alias("__fk")) for i, (c, _, _) in enumerate(fks)])
        )
        per_key = (
            child.select(refs)
            .filter(F.col("__fk").isNotNull())
            .groupBy("__i", "__fk")
            .agg(F.count(F.lit(1)).alias("__n"))
        )
        parent_keys = None
        for i, (_, parent, pcol) in enumerate(fks):
            k = tables[parent].select(F.lit(i).alias("__pi"), F.col(pcol).try_cast(key_type).alias("__pk"))
            parent_keys = k if parent_keys is None else parent_keys.unionByName(k)
        missing = per_key.join(
            parent_keys, (F.col("__i") == F.col("__pi")) & (F.col("__fk") == F.col("__pk")), "left_anti"
        )
        sums = missing.agg(
            *[F.coalesce(F.sum(F.when(F.col("__i") == i, F.col("__n"))), F.lit(0)).cast("long").alias(f"__o{i}")
              for i in range(len(fks))]
        )
        rows = F.inline(
            F.array(*[
                F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.lit(parent).alias("parent"),
                         F.col(f"__o{i}").alias("orphans"))
                for i, (c, parent, _) in enumerate(fks)
            ])
        )
        parts.append(sums.select(rows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_count_check(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """Row counts against expected counts ``(table, rows, expected, ok)``."""
    expected = EXPECTED_ROWS if expected is None else expected
    parts = [
        tables[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(n).cast("long").alias("expected"),
            (F.col("rows") == F.lit(n)).alias("ok"),
        )
        for name, n in expected.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_text(df: DataFrame) -> DataFrame:
    """Every column cast to text (what a CSV file would hold)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def spot_check(df: DataFrame, key: str, ids: list, columns: list[str], time_columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows named by ID (the filter reaches the scan as an IN list), times of day rendered as text."""
    from mercato.functions.temporal import time_text

    sel = [time_text(c).alias(c) if c in time_columns else F.col(c) for c in columns]
    return df.filter(F.col(key).isin(list(ids))).select(*sel)


def validate_folder(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """Validate the seven star-table CSV files of ``folder``.

    Returns ``(report, summary)``: the report rows of every file (a missing file is one
    ``missing_file`` row) and one summary row per file with its problem count and first five
    problems, plus the run's total problems and the number of files read.

    The report is written once to the session's shared folder and read from there: the files are read for
    it alone, not again for the summary's counts and first problems.
    """
    import os

    reports = [validate_file(spark, os.path.join(folder, name), name) for name in VALIDATION]
    report = reports[0]
    for r in reports[1:]:
        report = report.unionByName(r)
    path = scratch(spark, "folder-report")
    report.write.parquet(path)
    report = spark.read.schema(report.schema).parquet(path)
    files = spark.createDataFrame([(name,) for name in VALIDATION], "table string")
    missing = report.filter(F.col("rule") == "missing_file").select("table", F.lit(True).alias("missing"))
    per_file = (
        files.join(error_summary(report), "table", "left")
        .join(missing, "table", "left")
        .select(
            "table",
            F.coalesce("problems", F.lit(0)).cast("long").alias("problems"),
            "first_problems",
            F.coalesce("missing", F.lit(False)).alias("missing"),
        )
    )
    everything = Window.partitionBy()  # one row per file: seven rows
    summary = per_file.withColumn("total_problems", F.sum("problems").over(everything)).withColumn(
        "files_read", F.sum(F.when(~F.col("missing"), 1).otherwise(0)).over(everything)
    )
    return report, summary
