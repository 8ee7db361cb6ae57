"""CSV files of the star tables: read as text, normalise null tokens, convert, write Parquet.

Every column is first read as text in the file's column order (explicit schema, no inference),
so that bad values can be reported instead of failing the read; :mod:`mercato.operators.quality`
then checks and converts them. ``\\n`` and ``\\r\\n`` line ends both read correctly.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mercato.schema import LINE, RECORD, SURPLUS, TABLES, UNCLOSED, Table
from mercato.sources.records import parse_records, read_records

# FIXED VALUES: text read as null (only these; anything else stays text).
NULL_TOKENS = ("", "NA", "N/A", "NULL")


class MissingFile(Exception):
    """The CSV file does not exist (reported, not raised, by the validators)."""


def text_schema(columns: list[str] | tuple[str, ...]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def file_columns(table: Table) -> tuple[str, ...]:
    return table.file_columns or tuple(table.column_names)


def read_text_csv(
    spark: SparkSession, path: str, columns: list[str] | tuple[str, ...] | None = None, header: bool = True, numbers: bool = False
) -> DataFrame:
    """Read a CSV file (comma separated, optional ``"`` quotes, UTF-8, header row) with every column as
    text and the null tokens ``'' NA N/A NULL`` turned into null. Quoted fields may hold line ends, and the
    file is still read by many tasks (:mod:`mercato.sources.records`).

    With ``columns`` the file's column order is given explicitly (the header row is skipped, not
    used); without it the header names the columns. With ``numbers`` each row also has its first line and
    its number in its file (header: 1), and whether its quote isn't closed. Raises :class:`MissingFile` when
    nothing exists at ``path``.
    """
    try:
        if columns is None:
            columns = spark.read.option("header", header).option("quote", '"').option("escape", '"').csv(path).columns
        df = parse_records(read_records(spark, path, header), columns, numbers)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise MissingFile(path) from e
        raise
    return df.select(*[F.when(~F.col(c).isin(*NULL_TOKENS), F.col(c)).alias(c) for c in columns], *[LINE, RECORD, UNCLOSED] * numbers)


def read_table_csv(spark: SparkSession, path: str, table: str | Table, surplus: bool = False) -> DataFrame:
    """Read a star table's CSV file as text columns, reordered from file order to table order; with
    ``surplus`` the column SURPLUS has a row's first field beyond them, and UNCLOSED says whether its quote
    isn't closed."""
    t = TABLES[table] if isinstance(table, str) else table
    raw = read_text_csv(spark, path, (*file_columns(t), SURPLUS), numbers=surplus)
    return raw.select(*t.column_names, *[SURPLUS, UNCLOSED] * surplus)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Replace the table content at ``path`` (Parquet, Snappy)."""
    df.write.mode(mode).parquet(path)
