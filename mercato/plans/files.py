"""CSV files written from the star's tables, and read, checked and loaded again. :mod:`mercato.plans.files_sql`
says in plain SQL, from the tables alone, what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.frames import nan_to_null
from mercato.functions.names import initial, trim_to_null
from mercato.functions.temporal import date_prefix, mmss_micros, time_micros
from mercato.operators import quality
from mercato.operators.key_index import KeyIndex
from mercato.plans.dirty import _every, products_text, sales_text
from mercato.schema import TABLES
from mercato.session import scratch
from mercato.sources.csv import NULL_TOKENS, read_text_csv
from mercato.sources.star import Star

#: customers in a file of :func:`csv_records`
FILE_KEYS = 500


# ------------------------------------------------------------------------------- text of the tables, dirty
def customers_text(star: Star) -> DataFrame:
    k = "CustomerID"
    return star.customers.select(
        F.col(k).cast("string").alias(k), _every(k, "FirstName", (17, None)), "MiddleInitial", _every(k, "LastName", (19, "  "), (23, " Paz ")),
        _every(k, "CityID", (29, "x1"), (31, None)), _every(k, "Address", (37, "NA"), (41, "null")),
    )


def employees_text(star: Star) -> DataFrame:
    k = "EmployeeID"
    hired = star.employees.withColumn("HireDate", F.concat(F.date_format("HireDate", "yyyy-MM-dd"), F.lit(" 08:30:00.000")))
    return hired.withColumn("BirthDate", F.lit("1985-03-15 00:00:00.000")).select(
        F.col(k).cast("string").alias(k), "FirstName", "MiddleInitial", _every(k, "LastName", (13, None)),
        _every(k, "BirthDate", (7, "1985-02-30"), (11, "N/A")), _every(k, "Gender", (5, "XX")), _every(k, "CityID", (17, None)),
        _every(k, "HireDate", (3, "01/02/2020"), (19, None)),
    )


def cities_text(star: Star) -> DataFrame:
    k = "CityID"
    return star.cities.select(F.col(k).cast("string").alias(k), _every(k, "CityName", (5, None), (7, " ")), "Zipcode", _every(k, "CountryID", (11, "1.5")))


def countries_text(star: Star) -> DataFrame:
    k = "CountryID"
    return star.countries.select(F.col(k).cast("string").alias(k), _every(k, "CountryName", (3, None)), _every(k, "CountryCode", (4, "ABC")))


def categories_text(star: Star) -> DataFrame:
    k = "CategoryID"
    return star.categories.select(F.col(k).cast("string").alias(k), _every(k, "CategoryName", (4, None), (5, "")))


TEXTS = {
    "customers": customers_text, "employees": employees_text, "cities": cities_text, "countries": countries_text,
    "categories": categories_text, "products": products_text, "sales": sales_text,
}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def validator_files(star: Star) -> DataFrame:
    """Report rows of the file validator for the six files beside the sales (Q4)."""
    return _union([quality.validate_text(TEXTS[t](star), f"{t}.csv") for t in TEXTS if t != "sales"])


def conformed_entities(star: Star) -> DataFrame:
    """Errors of every dirty row of six entities by the loaders' rules (Q6, Q8, Q10)."""
    parts = []
    for t in ("customers", "employees", "cities", "countries", "categories", "sales"):
        found = quality.conform(_whole(TEXTS[t](star), t), t)
        key = F.col(TABLES[t].primary_key[0]).cast("string").alias("key")
        parts.append(found.where(F.size("errors") > 0).select(F.lit(t).alias("table"), key, F.array_join(F.array_sort("errors"), ",").alias("errors")))
    return _union(parts)


def strict_entities(star: Star) -> DataFrame:
    """Report rows of the strict rules for sales, people and places (Q14, Q15, Q16)."""
    parts = []
    for t in ("customers", "employees", "cities", "countries", "categories", "sales"):
        text = _whole(TEXTS[t](star), t)
        parts.append(quality.violations(text, t, TABLES[t].primary_key[0], quality.entity_rules(t, "strict")))
    return _union(parts).drop("message")


def _whole(text: DataFrame, table: str) -> DataFrame:
    """``text`` with all of the table's columns."""
    return text.select(*[F.col(c) if c in text.columns else F.lit(None).cast("string").alias(c) for c in TABLES[table].column_names])


# ------------------------------------------------------------------------------------------- CSV files
def _field(c: Column) -> Column:
    """A CSV field: quoted where it must be; null and empty are nothing."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    return F.coalesce(F.when(c.rlike('[",\n\r]'), quoted).otherwise(c), F.lit(""))


def write_csv(text: DataFrame, path: str) -> None:
    """``text`` as CSV files with a header each below ``path``."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    text.write.options(header=True, escape='"', emptyValue="", **spaces).csv(path)


def addressed_customers(star: Star) -> DataFrame:
    """Customers whose addresses hold commas, quotes and line ends, by rule."""
    k = F.col("CustomerID")
    street = F.concat(F.lit("Calle "), k.cast("string"))
    address = (
        F.when(k % 7 == 0, F.concat(street, F.lit('\nPiso 2, "B"'))).when(k % 11 == 0, F.concat(F.lit('"'), street, F.lit('"')))
        .when(k % 13 == 0, F.concat(F.lit("\n\n"), street, F.lit("\n"))).when(k % 5 == 0, F.lit("N/A")).when(k % 3 == 0, F.concat(street, F.lit(", Rosario")))
        .otherwise(street)
    )
    return star.customers.withColumn("Address", address)


def csv_records(star: Star) -> DataFrame:
    """Customers through CSV files of FILE_KEYS keys each, every other file with ``\\r\\n`` (also inside its quoted
    fields): the rows read back, with each record's number and first line in its file (S1, S2)."""
    spark = star.customers.sparkSession
    path, names = scratch(spark, "csv-records"), list(TABLES["customers"].file_columns)
    part = F.floor(F.col("CustomerID") / FILE_KEYS)
    rows = addressed_customers(star).select(part.alias("part"), "CustomerID", F.concat_ws(",", *[_field(F.col(c).cast("string")) for c in names]).alias("line"))
    heads = rows.select("part", F.lit(-1).cast("long").alias("CustomerID"), F.lit(",".join(names)).alias("line")).distinct()
    lines = rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "CustomerID")
    crlf = F.when(F.col("part") % 2 == 1, F.concat(F.regexp_replace("line", "\n", "\r\n"), F.lit("\r"))).otherwise(F.col("line"))
    lines.select("part", crlf.alias("line")).write.partitionBy("part").text(path)
    return read_text_csv(spark, path, names, numbers=True).drop("_unclosed").select(
        *[F.col(c).cast("long") if c.endswith("ID") else c for c in names], F.col("_record").alias("record"), F.col("_line").alias("line")
    )


def validated_folder(star: Star) -> DataFrame:
    """The validator over a folder of CSV files made from the tables, of which one lacks a column and one is
    missing: problems a file, its first five, and the totals (Q1, Q5, S3, S7)."""
    spark = star.customers.sparkSession
    folder = scratch(spark, "csv-folder")
    for t, text in TEXTS.items():
        if t != "categories":
            write_csv(text(star).drop("CountryID") if t == "cities" else text(star), f"{folder}/{t}.csv")
    _, summary = quality.validate_folder(spark, folder)
    shown = F.transform("first_problems", lambda p: F.concat_ws("|", F.coalesce(p["key"], F.lit("-")), p["column"], p["rule"]))
    return summary.select("table", "problems", F.array_join(shown, ";").alias("first_problems"), "missing", "total_problems", F.col("files_read").cast("long"))


def loaded_customers(star: Star) -> DataFrame:
    """Customers written as CSV, loaded through the error gate, and read back with the rejects (S4, S5, S6, Q7)."""
    spark = star.customers.sparkSession
    at = scratch(spark, "csv-load")
    text = customers_text(star).where("CustomerID % 31 <> 0")
    write_csv(text.select(*TABLES["customers"].file_columns), f"{at}/customers.csv")
    quality.load_csv_table(spark, f"{at}/customers.csv", "customers", f"{at}/out")
    names = TABLES["customers"].column_names
    good = spark.read.parquet(f"{at}/out").select(*names, F.lit("").alias("errors"))
    return good.unionByName(spark.read.parquet(f"{at}/out_rejects").select(*names, F.array_join("errors", ",").alias("errors")))


def replaced_customers(star: Star) -> DataFrame:
    """Two loads into one table and a third that fails its gate: rows and rejects of the second (S5, Q7)."""
    spark = star.customers.sparkSession
    at, text = scratch(spark, "csv-replace"), customers_text(star).where("CustomerID % 31 <> 0")
    loads = [text.where("CustomerID % 2 = 0"), text, text.withColumn("CityID", F.lit("x"))]
    for i, rows in enumerate(loads):
        write_csv(rows.select(*TABLES["customers"].file_columns), f"{at}/load{i}/customers.csv")
        try:
            quality.load_csv_snapshot(spark, f"{at}/load{i}/customers.csv", "customers", f"{at}/table")
        except quality.TooManyErrors:
            if i < 2:
                raise
    names = TABLES["customers"].column_names
    good = quality.loaded_rows(spark, f"{at}/table", "customers").select(*names, F.lit("").alias("errors"))
    return good.unionByName(quality.loaded_rejects(spark, f"{at}/table", "customers").select(*names, F.array_join("errors", ",").alias("errors")))


# ------------------------------------------------------------------------------------ arriving batches
def two_batch_duplicates(star: Star) -> DataFrame:
    """Sales keys of more than one row, from an index that got the sales in two batches, the second twice (Q17)."""
    spark = star.sales.sparkSession
    index = KeyIndex(spark, scratch(spark, "sales-keys"), ["SalesID"])
    odd = F.col("ProductID") % 2 == 1  # lines of one key fall into either batch
    for batch, rows in (("a", star.sales.where(odd)), ("b", star.sales.where(~odd)), ("b", star.sales.where(~odd))):
        index.add(rows, batch)
    return index.duplicates().select(F.col("key").cast("long").alias("SalesID"), "n")


def two_batch_orphans(star: Star) -> DataFrame:
    """References of arriving sales to products that no batch of products has brought: after the first batch of
    products, and after the second (J8)."""
    spark = star.sales.sparkSession
    index = KeyIndex(spark, scratch(spark, "product-keys"), ["ProductID"])
    found = []
    for batch, rows in (("1", star.products.where("ProductID % 3 <> 0")), ("2", star.products.where("ProductID % 3 = 0 AND ProductID % 5 <> 0"))):
        index.add(rows, batch)
        missing = index.missing(star.sales.select("ProductID")).select(F.lit(int(batch)).alias("batch"), F.col("key").cast("long").alias("ProductID"), "n")
        path = scratch(spark, "orphans")
        missing.write.parquet(path)  # as the index was after this batch
        found.append(spark.read.parquet(path))
    return _union(found)


# -------------------------------------------------------------------------------------- row functions
def null_tokens(star: Star) -> DataFrame:
    """Text that is null by its token and text that isn't (S3)."""
    k = F.col("CustomerID")
    said = F.element_at(F.array(*[F.lit(x) for x in ("", "NA", "N/A", "NULL", "null", " NA", "n/a", "None", "x")]), (k % 9 + 1).cast("int"))
    return star.customers.select("CustomerID", F.when(~said.isin(*NULL_TOKENS), said).alias("texto"))


def cleaned_people(star: Star) -> DataFrame:
    """Dates from text, trims, initials and NaN (F6, F13, F14)."""
    e = employees_text(star)
    k = F.col("EmployeeID").cast("long")
    padded = F.when(k % 2 == 0, F.concat(F.lit("  "), "MiddleInitial", F.lit("xyz "))).when(k % 5 == 0, F.lit("   ")).otherwise(F.col("MiddleInitial"))
    ratio = F.when(k % 4 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(None)).otherwise(k / F.lit(4.0))
    rows = e.select(
        k.alias("EmployeeID"), date_prefix("HireDate").alias("ingreso"), date_prefix("BirthDate").alias("nacimiento"),
        initial(padded).alias("inicial"), trim_to_null(F.when(k % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), "LastName"))).alias("apellido"),
        ratio.alias("cociente"),
    )
    return nan_to_null(rows)


def parsed_times(star: Star) -> DataFrame:
    """Times of day from text that is null, blank, good or faulty (P9, F7, F8)."""
    k = F.col("SalesID")
    said = (
        F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, F.lit("")).when(k % 11 == 0, F.lit("60:00")).when(k % 7 == 0, F.lit("10:05.1.2"))
        .when(k % 5 == 0, F.concat(F.lit("14:"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit(":59"))).when(k % 3 == 0, F.lit("7:5.1234567"))
        .otherwise(F.concat((k % 60).cast("string"), F.lit(":"), F.lpad((k % 59).cast("string"), 2, "0"), F.lit("."), (k % 10).cast("string")))
    )
    texto = F.col("texto")
    blank = F.when(texto.isNull() | (texto == ""), F.lit(None)).otherwise
    # the text is a step of its own: Spark doesn't write it out again for each mention
    return star.sales.select("SalesID", "ProductID", said.alias("texto")).select(
        "SalesID", "ProductID", texto, blank(mmss_micros(texto)).alias("minutos"), blank(time_micros(texto)).alias("hora")
    )


def run(fn):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from mercato.sources.star import load_star

        return fn(load_star(spark, sf_dir))

    return query


QUERIES = {
    "s1_s2_csv_records": run(csv_records),
    "s3_null_tokens": run(null_tokens),
    "s5_q7_load_customers": run(loaded_customers),
    "s5_q7_replaced_customers": run(replaced_customers),
    "q17_two_batch_duplicates": run(two_batch_duplicates),
    "j8_two_batch_orphans": run(two_batch_orphans),
    "q1_q5_s7_validated_folder": run(validated_folder),
    "q4_validator_files": run(validator_files),
    "q8_conform_entities": run(conformed_entities),
    "q14_q16_strict_entities": run(strict_entities),
    "f6_f13_f14_cleaned_people": run(cleaned_people),
    "p9_f7_f8_parsed_times": run(parsed_times),
}
