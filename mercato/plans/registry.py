"""Every registered query: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mercato.plans import duckdb_sql, reports
from mercato.sources.star import load_star

Query = Callable[[SparkSession, str], DataFrame]


def _star_query(fn, **kwargs) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load_star(spark, sf_dir), **kwargs)

    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Query] = {
    "r2_top_products_by_category": _star_query(reports.top_products_by_category, n=3),
    "r3_employee_ranking": _star_query(reports.employee_ranking),
    "r4_customer_segments": _star_query(reports.customer_segments, limit=50),
    "r4_customer_segments_all": _star_query(reports.customer_segments, limit=None),
    "r5_sales_detail_view": _star_query(reports.sales_detail_view),
    "r6_employee_product_summary": _star_query(reports.employee_product_summary, employee_id=duckdb_sql.R6_EMPLOYEE),
    "r7_expensive_products": _star_query(reports.price_list, min_price=50, ascending=False, limit=5),
    "r7_cheap_products": _star_query(reports.price_list, max_price=10, ascending=True, limit=3),
    "r8_city_staff": _star_query(reports.city_staff, city_id=duckdb_sql.R8_CITY, limit=5),
    "r9_load_counts": _star_query(reports.load_counts),
    "r10_products_per_category": _star_query(reports.products_per_category),
    "r10_sales_by_category_product": _star_query(reports.sales_by_category_product, limit=10),
    "r10_sales_by_category_product_all": _star_query(reports.sales_by_category_product, limit=None),
}

ORACLE_SQL: dict[str, str] = dict(duckdb_sql.QUERIES)


# ------------------------------------------------------------------ quality, functions, specs
import datetime as _dt  # noqa: E402

from mercato.operators import quality  # noqa: E402
from mercato.plans import dirty, dirty_sql, enrich  # noqa: E402
from mercato.plans.spec import run_spec  # noqa: E402
from mercato.sources.star import read_table  # noqa: E402

SERVICE_AS_OF = _dt.date(2025, 5, 30)


def _duplicate_keys(star):
    parts = [quality.duplicate_keys(df, name) for name, df in star.as_dict().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _schema_violations(star):
    parts = [quality.schema_violations(df, name) for name, df in star.as_dict().items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SPEC_CITY_STAFF = {
    "select": ["EmployeeID", "FirstName", "LastName", "HireDate"], "from": "employees",
    "where": [f"CityID = {duckdb_sql.R8_CITY}"], "order_by": ["HireDate DESC", "EmployeeID"], "limit": 5,
}
SPEC_SALES_BY_CATEGORY = {
    "select": ["c.CategoryName as Categoria", "p.ProductName as Producto", "SUM(s.Quantity) as TotalVendido"],
    "from": "sales s", "joins": [("products p", "s.ProductID = p.ProductID"), ("categories c", "p.CategoryID = c.CategoryID")],
    "group_by": ["c.CategoryName", "p.ProductName"], "order_by": ["Categoria ASC", "TotalVendido DESC", "Producto"], "limit": 10,
}
SPEC_CATEGORY_PRICES = {
    "select": ["c.CategoryName as Categoria", "COUNT(*) as total", "ROUND(AVG(p.Price), 2) as precio_promedio"],
    "from": "products p", "joins": [("categories c", "p.CategoryID = c.CategoryID")],
    "where": ["p.Price > 950", "p.Class = 'High'"], "group_by": ["c.CategoryName"], "having": ["COUNT(*) > 5"],
    "order_by": ["precio_promedio DESC", "Categoria"], "limit": 10,
}
SPEC_SELLERS_LEFT_JOIN = {
    "select": ["e.EmployeeID as EmployeeID", "COUNT(s.SalesID) as ventas", "SUM(s.Quantity) as unidades"],
    "from": "employees e", "joins": [("sales s", "s.SalesPersonID = e.EmployeeID", "LEFT")],
    "group_by": ["e.EmployeeID"], "having": ["ventas >= 0"],
}
# a name beyond ASCII, bound values, HAVING on an output name and an aggregate
SPEC_BOUND_VALUES = {
    "select": ["c.CategoryName as Categoría", "p.ProductName as Producto", "SUM(s.Quantity) as TotalVendido"],
    "from": "sales s", "joins": [("products p", "s.ProductID = p.ProductID"), ("categories c", "p.CategoryID = c.CategoryID")],
    "where": ["p.Price > :price"], "group_by": ["c.CategoryName", "p.ProductName"], "having": ["TotalVendido > :units AND COUNT(*) > 1"],
    "order_by": ["TotalVendido DESC", "Categoría", "Producto"], "limit": 20,
}


def _spec_query(spec: dict, params: dict | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_spec(load_star(spark, sf_dir).as_dict(), spec, params)

    return run


QUERIES.update(
    {
        "q17_duplicate_keys": _star_query(_duplicate_keys),
        "q18_schema_violations": _star_query(_schema_violations),
        "q19_row_counts": lambda spark, d: quality.row_count_check(load_star(spark, d).as_dict()),
        "q21_orphan_counts": lambda spark, d: quality.orphan_counts(load_star(spark, d).as_dict()),
        "f2_f3_customer_names": _star_query(enrich.customer_names),
        "f10_f11_employee_service": _star_query(enrich.employee_service, as_of=SERVICE_AS_OF),
        "f12_product_descriptions": _star_query(enrich.product_descriptions),
        "f7_f8_event_minute_times": lambda spark, d: enrich.event_minute_times(read_table(spark, d, "events")),
        "r1_spec_city_staff": _spec_query(SPEC_CITY_STAFF),
        "r1_spec_sales_by_category": _spec_query(SPEC_SALES_BY_CATEGORY),
        "r1_spec_category_prices": _spec_query(SPEC_CATEGORY_PRICES),
        "r1_spec_sellers_left_join": _spec_query(SPEC_SELLERS_LEFT_JOIN),
    }
)
QUERIES.update(
    {
        "q2_q3_validator": _star_query(dirty.validator),
        "q5_error_summary": _star_query(dirty.validator_summary),
        "q6_q16_conform": _star_query(dirty.conformed_products),
        "q6_q16_strict": _star_query(dirty.strict_products),
        "q18_schema_violations_dirty": _star_query(dirty.customer_schema_violations),
        "q21_orphan_counts_cut_parents": _star_query(dirty.cut_parent_orphans),
        "r7_cheapest_products": _star_query(reports.price_list, max_price=1000, ascending=True, limit=3),
        "r1_spec_bound_values": _spec_query(SPEC_BOUND_VALUES, {"price": 950, "units": 100}),
    }
)
ORACLE_SQL.update(dirty_sql.QUERIES)

SPOT_PRODUCTS = [1, 2, 3, 4, 5]
SPOT_SALES = [3, 4, 5, 13, 26, 32, 36, 37]

QUERIES.update(
    {
        "q20_spot_check_products": lambda spark, d: quality.spot_check(
            load_star(spark, d).products, "ProductID", SPOT_PRODUCTS, ["ProductID", "ProductName", "Price", "ModifyDate"],
            time_columns=("ModifyDate",),
        ),
        "q20_spot_check_sales": lambda spark, d: quality.spot_check(
            load_star(spark, d).sales, "SalesID", SPOT_SALES, ["SalesID", "ProductID", "TotalPrice", "SalesDate"], time_columns=("SalesDate",)
        ),
        "o2_first_customers": lambda spark, d: load_star(spark, d).customers.orderBy("CustomerID").limit(5),
    }
)

from mercato.plans import files, files_sql  # noqa: E402

QUERIES.update(files.QUERIES)
ORACLE_SQL.update(files_sql.QUERIES)
