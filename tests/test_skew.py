"""Results under skew: one product, one customer and one seller each hold a third of all sales.

The optimised plans (aggregation before joins, distributed rank / ntile) must equal the plain SQL
formulation (join first, windows without partitioning) on the same data.
"""

import dataclasses

import pytest
from pyspark.sql import functions as F

from mercato.plans import reports


@pytest.fixture(scope="module")
def skewed_star(star):
    s = star.sales
    third = F.col("SalesID") % 3
    hot = s.withColumn("ProductID", F.when(third == 0, F.lit(1)).otherwise(F.col("ProductID"))).withColumn(
        "CustomerID", F.when(third == 1, F.lit(7)).otherwise(F.col("CustomerID"))
    ).withColumn("SalesPersonID", F.when(third == 2, F.lit(3)).otherwise(F.col("SalesPersonID")))
    return dataclasses.replace(star, sales=hot)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


NET = "s.Quantity * p.Price * (1 - COALESCE(s.Discount, 0))"


def test_top_products_under_skew(spark, skewed_star):
    skewed_star.register_views(prefix="k_")
    plain = spark.sql(f"""
        WITH vp AS (SELECT p.ProductID, p.ProductName, p.CategoryID, SUM({NET}) AS m
                    FROM k_sales s JOIN k_products p ON s.ProductID = p.ProductID
                    GROUP BY p.ProductID, p.ProductName, p.CategoryID),
             rk AS (SELECT vp.*, c.CategoryName, RANK() OVER (PARTITION BY c.CategoryName ORDER BY m DESC) AS r
                    FROM vp JOIN k_categories c ON vp.CategoryID = c.CategoryID)
        SELECT CategoryName, ProductName, m, CAST(r AS BIGINT), ProductID FROM rk WHERE r <= 3""")
    assert rows(reports.top_products_by_category(skewed_star)) == rows(plain)


def test_employee_ranking_under_skew(spark, skewed_star):
    skewed_star.register_views(prefix="k_")
    plain = spark.sql(f"""
        WITH v AS (SELECT e.EmployeeID, e.FirstName, e.LastName, SUM(s.Quantity) AS q, SUM({NET}) AS val
                   FROM k_sales s JOIN k_products p ON s.ProductID = p.ProductID
                   JOIN k_employees e ON s.SalesPersonID = e.EmployeeID
                   GROUP BY e.EmployeeID, e.FirstName, e.LastName)
        SELECT FirstName, LastName, q, val, CAST(RANK() OVER (ORDER BY val DESC) AS BIGINT) AS rv,
               CAST(RANK() OVER (ORDER BY q DESC) AS BIGINT) AS rq, EmployeeID FROM v""")
    got = reports.employee_ranking(skewed_star).select(
        "Nombre_Empleado", "Apellido_Empleado", "Cantidad_Total_Vendida", "Ranking_Por_Valor_Venta",
        "Ranking_Por_Cantidad_Vendida", "ID_Empleado",
    )
    assert rows(got) == rows(plain.drop("val"))


def test_customer_segments_under_skew(spark, skewed_star):
    skewed_star.register_views(prefix="k_")
    plain = spark.sql(f"""
        WITH r AS (SELECT c.CustomerID, COUNT(DISTINCT s.SalesID) AS f, SUM({NET}) AS v
                   FROM k_sales s JOIN k_products p ON s.ProductID = p.ProductID
                   JOIN k_customers c ON s.CustomerID = c.CustomerID GROUP BY c.CustomerID)
        SELECT CustomerID, f, CAST(NTILE(4) OVER (ORDER BY f DESC, CustomerID) AS BIGINT) AS qf,
               CAST(NTILE(4) OVER (ORDER BY v DESC, CustomerID) AS BIGINT) AS qv FROM r WHERE v > 0""")
    got = reports.customer_segments(skewed_star, limit=None).select(
        "ID_Cliente", "Frecuencia_Compras", "Cuartil_Frecuencia", "Cuartil_Valor"
    )
    assert rows(got) == rows(plain)
