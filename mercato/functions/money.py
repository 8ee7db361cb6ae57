"""Money arithmetic and money text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions._util import col


def net_value(quantity: str | Column, price: str | Column, discount: str | Column) -> Column:
    """Net sale value ``quantity * price * (1 - coalesce(discount, 0))`` in exact decimal arithmetic.

    A null discount counts as no discount. With Quantity INT, Price DECIMAL(10,4) and
    Discount DECIMAL(10,2) the result is DECIMAL(35,6) and its SUM DECIMAL(38,6).
    """
    return col(quantity) * col(price) * (F.lit(1) - F.coalesce(col(discount), F.lit(0)))


def money_text_es(value: str | Column) -> Column:
    """Money text with 2 decimals, '.' for thousands and ',' for decimals: ``1.234.567,90``.

    Rounds half-up first (``format_number`` alone rounds half-even).
    """
    return F.translate(F.format_number(F.round(col(value), 2), 2), ",.", ".,")


def segment_label(frequency_quartile: str | Column, value_quartile: str | Column) -> Column:
    """Customer segment label ``F<frequency quartile>-V<value quartile>``, e.g. ``F1-V4``."""
    return F.concat(
        F.lit("F"), col(frequency_quartile).cast("string"), F.lit("-V"), col(value_quartile).cast("string")
    )
