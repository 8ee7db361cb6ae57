import pytest

from mercato.plans.spec import run_spec


@pytest.fixture(scope="module")
def tables(spark):
    clientes = spark.createDataFrame([(1, "Ana", 10), (2, "Luis", 20), (3, "Eva", 99)], "id long, nombre string, ciudad_id long")
    ventas = spark.createDataFrame([(1, 1, 5.0), (2, 1, 7.0), (3, 2, 1.0)], "id long, cliente_id long, total double")
    ciudades = spark.createDataFrame([(10, "Rosario"), (20, "Salta")], "id long, nombre string")
    productos = spark.createDataFrame(
        [(i, f"p{i}", 40.0 + 5 * i, 1 + i % 2, 1 if i != 3 else 0) for i in range(1, 15)],
        "id long, nombre string, precio double, categoria_id long, activo int",
    )
    categorias = spark.createDataFrame([(1, "A"), (2, "B")], "id long, categoria string")
    return {"clientes": clientes, "ventas": ventas, "ciudades": ciudades, "productos": productos, "categorias": categorias}


def test_basic(tables):
    out = run_spec(tables, {"select": ["nombre", "id"], "from": "Clientes"})
    assert out.columns == ["nombre", "id"] and out.count() == 3


def test_joins_inner_and_left(spark, star):
    out = run_spec(star.as_dict(), {
        "select": ["s.SalesID as venta", "ci.CityName as ciudad", "e.LastName as vendedor"], "from": "sales s",
        "joins": [("customers c", "s.CustomerID = c.CustomerID"), ("cities AS ci", "c.CityID = ci.CityID"),
                  ("employees e", "s.SalesPersonID = e.EmployeeID", "LEFT")],
    })
    star.register_views("t_")
    want = spark.sql("""SELECT s.SalesID, ci.CityName, e.LastName FROM t_sales s JOIN t_customers c USING (CustomerID)
        JOIN t_cities ci USING (CityID) LEFT JOIN t_employees e ON s.SalesPersonID = e.EmployeeID""")
    assert out.columns == ["venta", "ciudad", "vendedor"]
    got = sorted(map(repr, map(tuple, out.collect())))
    assert got == sorted(map(repr, map(tuple, want.collect()))) and any("None" in r for r in got)


def test_all_clauses_together(spark, star):
    spec = {
        "select": ["c.CategoryName as categoria", "COUNT(*) as lineas", "AVG(s.Quantity) as media"], "from": "sales s",
        "joins": [("products p", "p.ProductID = s.ProductID"), ("categories c", "p.CategoryID = c.CategoryID")],
        "where": ["s.Discount > 0.02 OR s.Discount IS NULL", "p.Class <> 'Low'"], "group_by": ["c.CategoryName"],
        "having": ["COUNT(*) > :least"], "order_by": ["media DESC", "categoria"], "limit": 4,
    }
    star.register_views("t_")
    want = spark.sql("""SELECT c.CategoryName, COUNT(*), AVG(s.Quantity) AS m FROM t_sales s JOIN t_products p USING (ProductID)
        JOIN t_categories c USING (CategoryID) WHERE (s.Discount > 0.02 OR s.Discount IS NULL) AND p.Class <> 'Low'
        GROUP BY c.CategoryName HAVING COUNT(*) > 10 ORDER BY m DESC, c.CategoryName LIMIT 4""")
    got = [tuple(r) for r in run_spec(star.as_dict(), spec, {"least": 10}).collect()]
    assert len(got) == 4 and got == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("clause", [
    {"where": ["id > 3) UNION ALL SELECT (99"]}, {"select": ["id FROM productos WHERE id = 1 UNION SELECT id"]}, {"where": ["id = 1; DROP TABLE x"]},
    {"order_by": ["id LIMIT 1"]}, {"group_by": ["id HAVING id > 1"]}, {"where": ["id = 1 /*"]}, {"having": ["1 = 1 ORDER BY id"]},
    {"from": "productos p, ventas"}, {"from": "productos p WHERE 1 = 0"}, {"joins": [("ventas v", "v.id = productos.id) CROSS JOIN (ventas")]},
])
def test_a_clause_cannot_add_another(tables, clause):
    with pytest.raises(ValueError):
        run_spec(tables, {"select": ["id"], "from": "productos", **clause})


def test_a_comment_ends_with_its_clause(tables):
    spec = {"select": ["id"], "from": "productos", "where": ["id > 1 -- more", "id < 4"], "order_by": ["id DESC NULLS LAST"]}
    assert [r.id for r in run_spec(tables, spec).collect()] == [3, 2]


@pytest.mark.parametrize("how", ["LEFT", "LEFT OUTER", "RIGHT"])
def test_outer_joins_of_a_hot_key(spark, how):
    few = spark.createDataFrame([(k, f"n{k}") for k in range(6)] + [(None, "x"), (0, "again")], "k long, name string")
    many = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN NULL WHEN id % 5 = 0 THEN 99 ELSE 1 + id % 4 END AS k")
    more = spark.createDataFrame([(k % 3, k) for k in range(40)], "k long, w long")
    tables = {"few": few, "many": many, "more": more}
    joins = [("many m", "f.k = m.k", how)] if how != "RIGHT" else [("few f", "m.k = f.k", how)]
    source = "few f" if how != "RIGHT" else "many m"
    spec = {"select": ["f.name", "m.id", "o.w"], "from": source, "joins": [*joins, ("more o", "f.k = o.k", "LEFT")]}
    for name, df in tables.items():
        df.createOrReplaceTempView(f"v_{name}")
    on = f"v_few f {how} JOIN v_many m ON f.k = m.k" if how != "RIGHT" else "v_many m RIGHT JOIN v_few f ON m.k = f.k"
    want = spark.sql(f"SELECT f.name, m.id, o.w FROM {on} LEFT JOIN v_more o ON f.k = o.k")
    got = run_spec(tables, spec)
    assert "__salt" in got._jdf.queryExecution().analyzed().toString() and got.columns == ["name", "id", "w"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_having_on_output_name_and_limit_zero(tables):
    spec = {
        "select": ["categoria_id", "SUM(precio) as s"], "from": "productos", "group_by": ["categoria_id"],
        "having": ["s > 300"], "order_by": ["categoria_id"],
    }
    assert [r.categoria_id for r in run_spec(tables, spec).collect()] == [1, 2]
    assert run_spec(tables, {"select": ["id"], "from": "productos", "limit": 0}).count() == 0


def test_order_by_an_aggregate(tables):
    spec = {"select": ["categoria_id"], "from": "productos p", "group_by": ["categoria_id"], "order_by": ["SUM(p.precio) DESC"]}
    assert [r.categoria_id for r in run_spec(tables, spec).collect()] == [1, 2]


def test_names_beyond_ascii_and_mixed_having(tables):
    spec = {
        "select": ["c.categoria as Categoría", "SUM(p.precio) as Total", "'ñ {x}' as texto"], "from": "productos p",
        "joins": [("categorias c", "p.categoria_id = c.id")], "where": ["p.precio > :least OR p.precio < 0"],
        "group_by": ["c.categoria"], "having": ["Total > 1 AND COUNT(*) > :n"], "order_by": ["Total DESC", "Categoría"],
    }
    rows = run_spec(tables, spec, {"least": 50, "n": 1}).collect()
    assert [(r["Categoría"], r["Total"], r["texto"]) for r in rows] == [("A", 510.0, "ñ {x}"), ("B", 480.0, "ñ {x}")]


def test_conditions_of_a_list_hold_together(tables):
    spec = {"select": ["id"], "from": "productos", "where": ["id = 1 OR id = 2", "activo = 1 AND id > 1"]}
    assert [r.id for r in run_spec(tables, spec).collect()] == [2]


def test_faulty_specifications(tables):
    for spec in ({}, {"select": ["x"]}, {"from": "clientes"}, {"select": ["x"], "from": "nadie"}, {"select": ["x"], "from": "clientes", "filter": []},
                 {"select": ["c.id"], "from": "clientes c", "joins": [("ventas v", "c.id = v.id", "CROSS")]}):
        with pytest.raises(ValueError):
            run_spec(tables, spec)


def test_filter_reaches_parquet_scan(spark, star):
    from mercato.plans.registry import SPEC_CITY_STAFF

    out = run_spec(star.as_dict(), SPEC_CITY_STAFF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(s_nationkey), EqualTo(s_nationkey,7)" in plan
