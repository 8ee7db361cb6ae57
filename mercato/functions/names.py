"""Person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions._util import col


def trim_to_null(value: str | Column) -> Column:
    """Trimmed text, or null when the text is null or blank."""
    t = F.trim(col(value))
    return F.when(F.length(t) > 0, t)


def initial(value: str | Column) -> Column:
    """Middle initial cut to its first character after trimming; null when blank."""
    return F.substring(trim_to_null(value), 1, 1)


def full_name_sql(first: str | Column, middle: str | Column, last: str | Column) -> Column:
    """Full name as the reports build it: ``First M. Last``, or ``First Last`` when the initial is null.

    Null first or last name gives null; an empty (not null) initial gives ``First . Last``.
    """
    return F.concat(
        col(first), F.lit(" "), F.coalesce(F.concat(col(middle), F.lit(". ")), F.lit("")), col(last)
    )


def full_name_model(first: str | Column, middle: str | Column, last: str | Column) -> Column:
    """Full name as the entity rules build it: trimmed parts, initial (first character) skipped when
    null or blank. Null when the first or last name is missing or blank."""
    f, la, mi = trim_to_null(first), trim_to_null(last), initial(middle)
    return F.when(
        f.isNotNull() & la.isNotNull(), F.concat_ws(" ", f, F.concat(mi, F.lit(".")), la)
    )
