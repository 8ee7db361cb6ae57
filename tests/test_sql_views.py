from mercato.plans import reports


def test_parameterised_sql_matches_report(spark, star):
    star.register_views(prefix="m_")
    sql = """
        SELECT e.EmployeeID AS ID_Empleado, p.ProductID AS ID_Producto,
               SUM(s.Quantity) AS q, SUM(s.Quantity * p.Price * (1 - IFNULL(s.Discount, 0))) AS v
        FROM m_sales s JOIN m_products p ON s.ProductID = p.ProductID
        JOIN m_employees e ON s.SalesPersonID = e.EmployeeID
        WHERE e.EmployeeID = :id
        GROUP BY e.EmployeeID, e.FirstName, e.MiddleInitial, e.LastName, p.ProductID, p.ProductName"""
    for emp in (3, 8):
        got = {(r.ID_Producto): (r.q, r.v) for r in spark.sql(sql, args={"id": emp}).collect()}
        exp = {
            r.ID_Producto: (r.Cantidad_Total_Vendida_Producto, r.Valor_Neto_Ventas_Producto)
            for r in reports.employee_product_summary(star, emp).collect()
        }
        assert got == exp and len(got) > 0


def test_named_sales_view(spark, star):
    reports.register_sales_view(star)
    rows = spark.sql(f"SELECT * FROM {reports.SALES_VIEW} ORDER BY ID_Venta LIMIT 5").collect()
    assert len(rows) == 5 and len(rows[0]) == 18
