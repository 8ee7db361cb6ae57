"""Row-level business rules applied to whole tables (names, service years, product texts, times)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.names import full_name_model, full_name_sql
from mercato.functions.products import allergy_flag, product_description
from mercato.functions.temporal import mmss_micros, service_text, service_years, time_text
from mercato.sources.star import Star


def customer_names(star: Star) -> DataFrame:
    """Both full-name forms of every customer."""
    c = star.customers
    return c.select(
        "CustomerID",
        full_name_sql("FirstName", "MiddleInitial", "LastName").alias("NombreCompletoSQL"),
        full_name_model("FirstName", "MiddleInitial", "LastName").alias("NombreCompleto"),
    )


def employee_service(star: Star, as_of: dt.date) -> DataFrame:
    """Years of service and service text of every employee at ``as_of``."""
    e = star.employees
    return e.select(
        "EmployeeID",
        "HireDate",
        service_years("HireDate", as_of).alias("Antiguedad"),
        service_text("HireDate", as_of).alias("AntiguedadTexto"),
    )


def product_descriptions(star: Star) -> DataFrame:
    """Detailed one-line description of every product."""
    p = star.products
    return p.select(
        "ProductID",
        product_description(
            "ProductName", "Price", "CategoryID", "Class", "VitalityDays", allergy_flag("IsAllergic"), "ModifyDate"
        ).alias("Descripcion"),
    )


def event_minute_times(events: DataFrame) -> DataFrame:
    """Minutes:seconds.tenths text of each event time, parsed back to a time of day."""
    text = F.date_format("ts", "mm:ss.S")
    micros = mmss_micros(text)
    return events.select("event_id", text.alias("MinutoSegundo"), micros.alias("Micros"), time_text(micros).alias("Hora"))
