"""Product attributes: allergy flag and the detailed product description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mercato.functions._util import col
from mercato.functions.names import trim_to_null

# FIXED VALUES: allergy tokens (compared after trim and upper-casing).
ALLERGY_TRUE = "TRUE"
ALLERGY_FALSE = "FALSE"
ALLERGY_UNKNOWN = "UNKNOWN"


def allergy_flag(value: str | Column) -> Column:
    """'TRUE' -> true, 'FALSE' -> false, 'Unknown' / blank / null -> null (any case, trimmed).
    Any other text also gives null; :func:`allergy_is_valid` tells them apart."""
    u = F.upper(F.trim(col(value)))
    return F.when(u == ALLERGY_TRUE, F.lit(True)).when(u == ALLERGY_FALSE, F.lit(False))


def allergy_is_valid(value: str | Column) -> Column:
    """True when the allergy text is null or one of the accepted tokens."""
    u = F.upper(F.trim(col(value)))
    return col(value).isNull() | u.isin(ALLERGY_TRUE, ALLERGY_FALSE, ALLERGY_UNKNOWN, "")


# FIXED VALUES: description labels and shelf-life bands (0 / up to 7 / up to 30 / longer days).
_SEP = " | "
_L_PRODUCT = "Producto: "
_L_PRICE = "Precio: $"
_L_CATEGORY = "Categoría ID: "
_L_CLASS = "Clase: "
_L_VITALITY = "Vitalidad: "
_T_NOT_PERISHABLE = "Producto no perecedero"
_T_DAYS = " días"
_T_VERY_PERISHABLE = " (muy perecedero)"
_T_PERISHABLE = " (perecedero)"
_T_LONG_LIFE = " (larga duración)"
_T_ALLERGIC = "⚠️ PRODUCTO ALERGÉNICO"
_T_NOT_ALLERGIC = "No alergénico"
_L_MODIFIED = "Modificado: "


def product_description(
    name: str | Column,
    price: str | Column,
    category_id: str | Column,
    product_class: str | Column,
    vitality_days: str | Column,
    allergic: str | Column,
    modify_micros: str | Column,
) -> Column:
    """One-line product description; optional parts are left out when null.

    ``allergic`` is the parsed boolean (see :func:`allergy_flag`), ``modify_micros`` the time of
    day in microseconds. The price is shown with 2 decimals rounded half-even.
    """
    days = col(vitality_days)
    days_txt = F.concat(F.lit(_L_VITALITY), days.cast("string"), F.lit(_T_DAYS))
    vitality = (
        F.when(days.isNull(), F.lit(None).cast("string"))
        .when(days == 0, F.lit(_L_VITALITY + _T_NOT_PERISHABLE))
        .when(days <= 7, F.concat(days_txt, F.lit(_T_VERY_PERISHABLE)))
        .when(days <= 30, F.concat(days_txt, F.lit(_T_PERISHABLE)))
        .otherwise(F.concat(days_txt, F.lit(_T_LONG_LIFE)))
    )
    a = col(allergic)
    allergy = F.when(a == F.lit(True), F.lit(_T_ALLERGIC)).when(a == F.lit(False), F.lit(_T_NOT_ALLERGIC))
    us = col(modify_micros)
    secs = F.floor(us / 1_000_000)
    tenth = F.floor((us % 1_000_000) / 100_000)
    mmss = F.concat(
        F.lpad((F.floor(secs / 60) % 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((secs % 60).cast("string"), 2, "0"),
        F.when(tenth > 0, F.concat(F.lit("."), tenth.cast("string"))).otherwise(F.lit("")),
    )
    modified = F.when(us.isNotNull(), F.concat(F.lit(_L_MODIFIED), mmss))
    price_txt = F.bround(col(price), 2).cast("decimal(38,2)").cast("string")
    return F.concat_ws(
        _SEP,
        F.concat(F.lit(_L_PRODUCT), F.trim(col(name))),
        F.concat(F.lit(_L_PRICE), price_txt),
        F.concat(F.lit(_L_CATEGORY), col(category_id).cast("string")),
        F.concat(F.lit(_L_CLASS), trim_to_null(product_class)),
        vitality,
        allergy,
        modified,
    )
