"""User-level results: reports over the star schema and specification queries."""

from mercato.plans.reports import (
    city_staff,
    customer_segments,
    employee_product_summary,
    employee_ranking,
    load_counts,
    price_list,
    products_per_category,
    sales_by_category_product,
    sales_detail_view,
    top_products_by_category,
)
from mercato.plans.spec import run_spec

__all__ = [
    "city_staff",
    "customer_segments",
    "employee_product_summary",
    "employee_ranking",
    "load_counts",
    "price_list",
    "products_per_category",
    "run_spec",
    "sales_by_category_product",
    "sales_detail_view",
    "top_products_by_category",
]
