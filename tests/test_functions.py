import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from mercato.functions import (
    allergy_flag,
    allergy_is_valid,
    date_prefix,
    full_name_model,
    full_name_sql,
    initial,
    mmss_micros,
    money_text_es,
    nan_to_null,
    net_value,
    product_description,
    segment_label,
    service_text,
    service_years,
    time_micros,
    time_text,
)

AS_OF = dt.date(2025, 5, 30)


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_full_name_model_and_sql(spark):
    rows = [("María", "E", "González"), ("Luis", None, "Pérez"), ("Ana", "", "López"), ("  Eva ", "Bravo", " Ruiz"), (None, "X", "Y")]
    schema = "f string, m string, l string"
    assert one(spark, rows, schema, full_name_model("f", "m", "l")) == [
        "María E. González", "Luis Pérez", "Ana López", "Eva B. Ruiz", None
    ]
    assert one(spark, rows, schema, full_name_sql("f", "m", "l")) == [
        "María E. González", "Luis Pérez", "Ana . López", "  Eva  Bravo.  Ruiz", None
    ]
    assert one(spark, [("B",), (None,), ("  ",), (" xyz",)], "m string", initial("m")) == ["B", None, None, "x"]


def test_service_years_and_text(spark):
    rows = [(dt.date(2022, 3, 15),), (dt.date(2024, 4, 1),), (dt.date(2025, 1, 10),), (None,), (dt.date(2026, 1, 1),)]
    assert one(spark, rows, "h date", service_text("h", AS_OF)) == [
        "3 años de antigüedad.",
        "1 año de antigüedad.",
        "Menos de un año de antigüedad.",
        "Fecha de contratación no especificada.",
        "Menos de un año de antigüedad.",  # hire date after the as-of date: floored at 0
    ]
    # anniversary on 29 February: not reached on 28 February of a common year
    leap = [(dt.date(2024, 2, 29),)]
    assert one(spark, leap, "h date", service_years("h", dt.date(2025, 2, 28))) == [0]
    assert one(spark, leap, "h date", service_years("h", dt.date(2025, 3, 1))) == [1]


def test_dates_from_text(spark):
    rows = [("1985-03-15",), ("2020-06-01 00:00:00.000",), ("2020-13-01",), ("junk",), (None,)]
    assert one(spark, rows, "t string", date_prefix("t")) == [
        dt.date(1985, 3, 15), dt.date(2020, 6, 1), None, None, None
    ]


def test_minute_second_times(spark):
    rows = [("21:49.2",), ("15:30",), ("60:00",), ("1:2:3",), ("a:b",), ("00:00.1234567",), ("10:05.x",), (None,)]
    got = one(spark, rows, "t string", mmss_micros("t"))
    assert got == [(21 * 60 + 49) * 1_000_000 + 200_000, (15 * 60 + 30) * 1_000_000, None, None, None, 123_456, None, None]
    assert one(spark, [("14:30:00",), ("21:49.2",), ("24:00:00",)], "t string", time_micros("t")) == [
        (14 * 3600 + 30 * 60) * 1_000_000, (21 * 60 + 49) * 1_000_000 + 200_000, None
    ]
    assert one(spark, [(1309200000,), (0,), (None,)], "u long", time_text("u")) == ["00:21:49.200000", "00:00:00", None]


def test_allergy(spark):
    rows = [("TRUE",), (" false ",), ("Unknown",), ("",), (None,), ("maybe",)]
    assert one(spark, rows, "a string", allergy_flag("a")) == [True, False, None, None, None, None]
    assert one(spark, rows, "a string", allergy_is_valid("a")) == [True, True, True, True, True, False]


def test_money_and_net(spark):
    rows = [(Decimal("1234567.895000"),), (Decimal("0.125000"),), (Decimal("-5.000000"),)]
    assert one(spark, rows, "v decimal(38,6)", money_text_es("v")) == ["1.234.567,90", "0,13", "-5,00"]
    df = spark.createDataFrame([(3, Decimal("25.5000"), Decimal("0.10")), (2, Decimal("1.0000"), None)],
                               "q int, p decimal(10,4), d decimal(10,2)")
    assert [r[0] for r in df.select(net_value("q", "p", "d")).collect()] == [Decimal("68.850000"), Decimal("2.000000")]
    assert one(spark, [(1, 4)], "f long, v long", segment_label("f", "v")) == ["F1-V4"]


def test_product_descriptions(spark):
    rows = [
        ("Flour - Whole Wheat", Decimal("74.2988"), 3, "Medium", Decimal(0), "Unknown", "21:49.2"),
        ("Artichokes - Jerusalem", Decimal("65.4771"), 2, "Low", Decimal(27), "TRUE", "13:35.4"),
        ("Sobe - Tropical Energy", Decimal("12.3153"), 9, "High", Decimal(0), "TRUE", "23:48.2"),
        ("Half", Decimal("0.1250"), 1, " ", None, "FALSE", None),
    ]
    schema = "n string, p decimal(10,4), c int, k string, v decimal(3,0), a string, t string"
    got = one(spark, rows, schema, product_description("n", "p", "c", "k", "v", allergy_flag("a"), mmss_micros("t")))
    assert got == [
        "Producto: Flour - Whole Wheat | Precio: $74.30 | Categoría ID: 3 | Clase: Medium | "
        "Vitalidad: Producto no perecedero | Modificado: 21:49.2",
        "Producto: Artichokes - Jerusalem | Precio: $65.48 | Categoría ID: 2 | Clase: Low | "
        "Vitalidad: 27 días (perecedero) | ⚠️ PRODUCTO ALERGÉNICO | Modificado: 13:35.4",
        "Producto: Sobe - Tropical Energy | Precio: $12.32 | Categoría ID: 9 | Clase: High | "
        "Vitalidad: Producto no perecedero | ⚠️ PRODUCTO ALERGÉNICO | Modificado: 23:48.2",
        "Producto: Half | Precio: $0.12 | Categoría ID: 1 | No alergénico",
    ]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, y int")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(None, 1), (2.0, 2)]
