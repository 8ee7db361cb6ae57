"""Column expressions for the business rules. All are built-in Spark expressions (no UDF),
so they stay inside whole-stage code generation."""

from mercato.functions.money import money_text_es, net_value, segment_label
from mercato.functions.names import full_name_model, full_name_sql, initial, trim_to_null
from mercato.functions.products import allergy_flag, allergy_is_valid, product_description
from mercato.functions.temporal import (
    date_prefix,
    mmss_micros,
    service_text,
    service_years,
    time_micros,
    time_text,
)
from mercato.functions.frames import nan_to_null

__all__ = [
    "allergy_flag",
    "allergy_is_valid",
    "date_prefix",
    "full_name_model",
    "full_name_sql",
    "initial",
    "mmss_micros",
    "money_text_es",
    "nan_to_null",
    "net_value",
    "product_description",
    "segment_label",
    "service_text",
    "service_years",
    "time_micros",
    "time_text",
    "trim_to_null",
]
