"""The analytic results over the star schema.

Plan shape notes (what each plan does at scale):

* Net value ``SUM(q * price * (1 - d))`` is computed as ``price * SUM(q * (1 - d))`` wherever the
  price is constant inside a group (it is, per product). That lets the fact table be aggregated
  *before* it meets the products table: the aggregation combines map-side (a product or seller
  holding a third of all sales collapses to one row per task) and the join then only sees one
  row per product (or per seller and product). Decimal arithmetic is exact, so the result equals
  the row-by-row sum to the last digit.
* Global rankings and quartiles use :mod:`mercato.operators.windows` (no single-partition window).
* Small dimension tables are broadcast only behind a row-count check; large ones are shuffle joined.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.money import money_text_es, net_value, segment_label
from mercato.functions.names import full_name_sql
from mercato.operators.joins import has_at_most
from mercato.operators.windows import Numbering, numbered, top_n_per_group
from mercato.sources.star import Star

_DQ = "__dq"  # SUM(Quantity * (1 - Discount)), the price-free part of the net value
_QTY = "__qty"


def _discount_unit(star: Star) -> int:
    """10 ** (scale of Discount): Quantity * (1 - Discount) is a whole number of these units."""
    return 10 ** star.sales.schema["Discount"].dataType.scale


def _sales_by(star: Star, keys: list[str], with_quantity: bool = False) -> DataFrame:
    """Per ``keys``: ``SUM(Quantity * (1 - Discount))`` counted exactly in discount units as a LONG
    (cents for DECIMAL(10,2)). Long sums stay on Spark's fast path; a DECIMAL(34,2) sum would run
    through BigDecimal. Overflow would need ~10^15 rows of one group; ANSI mode raises if it happens."""
    unit = _discount_unit(star)
    units = F.col("Quantity").cast("long") * (
        F.lit(unit) - F.coalesce((F.col("Discount") * F.lit(unit)).cast("long"), F.lit(0))
    )
    aggs = [F.sum(units).alias(_DQ)]
    if with_quantity:
        aggs.append(F.sum("Quantity").alias(_QTY))
    return star.sales.groupBy(*keys).agg(*aggs)


def _priced(per_product: DataFrame, products: DataFrame, *product_cols: str, unit: int = 100) -> DataFrame:
    """Join per-product partial sums to products and turn them into exact net values (``__net``,
    scale 6): ``units * Price / unit``."""
    p = products.select("ProductID", "Price", *product_cols)
    scale = len(str(unit)) - 1
    per_unit = F.lit(Decimal(1).scaleb(-scale))  # 0.01 for cents
    return per_product.join(p, "ProductID").withColumn(
        "__net", F.col(_DQ).cast("decimal(20,0)") * F.col("Price") * per_unit
    )


# --------------------------------------------------------------------------------------------- R2
def top_products_by_category(star: Star, n: int = 3) -> DataFrame:
    """Top-``n`` products by net sales inside each category (``rank()``, ties kept)."""
    per_product = _priced(
        _sales_by(star, ["ProductID"]), star.products, "ProductName", "CategoryID", unit=_discount_unit(star)
    )
    amounts = per_product.groupBy("ProductID", "ProductName", "CategoryID").agg(
        F.sum("__net").alias("Monto_Total_Ventas_Netas")
    )
    named = amounts.join(star.categories, "CategoryID")
    ranked = top_n_per_group(named, "CategoryName", "Monto_Total_Ventas_Netas", n, ascending=False, name="__rank")
    return ranked.select(
        F.col("CategoryName").alias("Categoria"),
        F.col("ProductName").alias("Producto"),
        F.col("Monto_Total_Ventas_Netas"),
        F.col("__rank").cast("long").alias("Ranking_en_Categoria"),
        F.col("ProductID").alias("ID_Producto"),
    ).orderBy("Categoria", "Ranking_en_Categoria", "ID_Producto")


# --------------------------------------------------------------------------------------------- R3
def employee_ranking(star: Star) -> DataFrame:
    """Sellers ranked by net sales value and by quantity sold (two ``rank()`` over all sellers)."""
    pairs = _sales_by(star, ["SalesPersonID", "ProductID"], with_quantity=True)
    per_seller = (
        _priced(pairs, star.products, unit=_discount_unit(star))
        .groupBy("SalesPersonID")
        .agg(F.sum(_QTY).alias(_QTY), F.sum("__net").alias("__net"))
    )
    e = star.employees.select("EmployeeID", "FirstName", "LastName")
    totals = (
        per_seller.join(e, per_seller.SalesPersonID == e.EmployeeID)
        .groupBy("EmployeeID", "FirstName", "LastName")
        .agg(
            F.sum(_QTY).cast("long").alias("Cantidad_Total_Vendida"),
            F.sum("__net").alias("Valor_Total_Ventas_Netas"),
        )
    )
    ranked = numbered(
        totals,
        Numbering("Ranking_Por_Valor_Venta", "Valor_Total_Ventas_Netas", False),
        Numbering("Ranking_Por_Cantidad_Vendida", "Cantidad_Total_Vendida", False),
    )
    return ranked.select(
        F.col("FirstName").alias("Nombre_Empleado"),
        F.col("LastName").alias("Apellido_Empleado"),
        "Cantidad_Total_Vendida",
        money_text_es("Valor_Total_Ventas_Netas").alias("Valor_Total_Ventas_Netas_Formato"),
        "Ranking_Por_Valor_Venta",
        "Ranking_Por_Cantidad_Vendida",
        F.col("EmployeeID").alias("ID_Empleado"),
    ).orderBy("Ranking_Por_Valor_Venta", "ID_Empleado")


# --------------------------------------------------------------------------------------------- R4
def customer_summary(star: Star) -> DataFrame:
    """Per customer: distinct sales (frequency) and net purchase value."""
    p = star.products.select("ProductID", "Price")
    s = star.sales.select("SalesID", "ProductID", "CustomerID", "Quantity", "Discount")
    per_customer = (
        s.join(p, "ProductID")
        .groupBy("CustomerID")
        .agg(
            F.countDistinct("SalesID").alias("Frecuencia_Compras"),
            F.sum(net_value("Quantity", "Price", "Discount")).alias("Valor_Total_Compras"),
        )
    )
    c = star.customers.select("CustomerID", "FirstName", "LastName")
    return per_customer.join(c, "CustomerID").groupBy("CustomerID", "FirstName", "LastName").agg(
        F.max("Frecuencia_Compras").cast("long").alias("Frecuencia_Compras"),  # a sale counts once
        F.sum("Valor_Total_Compras").alias("Valor_Total_Compras"),
    )


def customer_segments(star: Star, limit: int | None = 50) -> DataFrame:
    """Frequency / value quartiles (``ntile(4)``, quartile 1 = highest) over all customers with a
    positive purchase value, labelled ``F<f>-V<v>``; listed quartile 4 first, top ``limit`` rows
    (``None``: all). Ties inside a quartile boundary are broken by customer ID."""
    q = numbered(
        customer_summary(star).filter(F.col("Valor_Total_Compras") > 0),
        Numbering("Cuartil_Frecuencia", ["Frecuencia_Compras", "CustomerID"], [False, True], "ntile", 4),
        Numbering("Cuartil_Valor", ["Valor_Total_Compras", "CustomerID"], [False, True], "ntile", 4),
    )
    out = q.select(
        F.col("CustomerID").alias("ID_Cliente"),
        F.col("FirstName").alias("Nombre_Cliente"),
        F.col("LastName").alias("Apellido_Cliente"),
        "Frecuencia_Compras",
        money_text_es("Valor_Total_Compras").alias("Valor_Total_Compras_Formato"),
        "Cuartil_Frecuencia",
        "Cuartil_Valor",
        segment_label("Cuartil_Frecuencia", "Cuartil_Valor").alias("Segmento_FM"),
        "Valor_Total_Compras",
    ).orderBy(
        F.col("Cuartil_Valor").desc(),
        F.col("Cuartil_Frecuencia").desc(),
        F.col("Valor_Total_Compras").desc(),
        F.col("ID_Cliente").asc(),
    )
    if limit is not None:
        out = out.limit(limit)
    return out.drop("Valor_Total_Compras")


# --------------------------------------------------------------------------------------------- R5
#: sellers, of an ID and a name each, that are broadcast to the sales view
SELLER_ROWS = 1_000_000


def sales_detail_view(star: Star) -> DataFrame:
    """One row per sale with product, category, customer (city, country) and seller details.

    Sales without a seller are kept (left join). The fact is joined once per dimension, and what a join brings
    is shuffled with the fact by every later one. So names are put together before they are joined, customers
    come first (an order's lines, which lie together, stay together and compress), and what is broadcast, by a
    row-count check, comes after the last shuffle. Sellers too many for that come before the wider dimensions.
    """
    products = star.products.select("ProductID", "ProductName", "Price", "CategoryID").join(star.categories, "CategoryID")
    name = full_name_sql("FirstName", "MiddleInitial", "LastName")
    customers = star.customers.select("CustomerID", name.alias("c_name"), "CityID")
    sellers = star.employees.select("EmployeeID", name.alias("e_name"))
    few = has_at_most(sellers, SELLER_ROWS)

    def with_sellers(sales: DataFrame) -> DataFrame:
        return sales.join(F.broadcast(sellers) if few else sellers, F.col("SalesPersonID") == F.col("EmployeeID"), "left").drop("SalesPersonID")

    sales = star.sales if few else with_sellers(star.sales)
    sales = sales.join(customers, "CustomerID").join(products, "ProductID").join(star.cities, "CityID").join(star.countries, "CountryID")
    joined = with_sellers(sales) if few else sales
    return joined.select(
        F.col("SalesID").alias("ID_Venta"),
        F.col("SalesDate").alias("Hora_Minutos_Segundos_Venta"),
        F.col("ProductID").alias("ID_Producto"),
        F.col("ProductName").alias("Nombre_Producto"),
        F.col("CategoryID").alias("ID_Categoria"),
        F.col("CategoryName").alias("Nombre_Categoria"),
        F.col("CustomerID").alias("ID_Cliente"),
        F.col("c_name").alias("Nombre_Completo_Cliente"),
        F.col("CityName").alias("Ciudad_Cliente"),
        F.col("CountryName").alias("Pais_Cliente"),
        F.col("EmployeeID").alias("ID_Empleado_Vendedor"),
        F.col("e_name").alias("Nombre_Completo_Empleado_Vendedor"),
        F.col("Quantity").alias("Cantidad_Vendida"),
        F.col("Price").alias("Precio_Unitario_Producto_Lista"),
        F.col("Discount").alias("Descuento_Aplicado_Porcentaje"),
        net_value("Quantity", "Price", "Discount").alias("Venta_Neta_Calculada"),
        F.col("TotalPrice").alias("Precio_Total_Registrado_En_Venta"),
        F.col("TransactionNumber").alias("Numero_Transaccion"),
    )


SALES_VIEW = "VistaVentasGlobalesDetalladas"


def register_sales_view(star: Star, name: str = SALES_VIEW) -> DataFrame:
    """Register :func:`sales_detail_view` as a temporary view (``SELECT * FROM <name> ...`` in SQL)."""
    view = sales_detail_view(star)
    view.createOrReplaceTempView(name)
    return view


# --------------------------------------------------------------------------------------------- R6
def employee_product_summary(star: Star, employee_id: int) -> DataFrame:
    """Per product: quantity and net value sold by one seller, highest value first."""
    per_product = _sales_by(star, ["SalesPersonID", "ProductID"], with_quantity=True).filter(
        F.col("SalesPersonID") == F.lit(employee_id)
    )
    priced = _priced(per_product, star.products, "ProductName", unit=_discount_unit(star))
    e = star.employees.filter(F.col("EmployeeID") == F.lit(employee_id)).select(
        "EmployeeID", "FirstName", "MiddleInitial", "LastName"
    )
    grouped = priced.join(e, priced.SalesPersonID == e.EmployeeID)
    return (
        grouped.groupBy("EmployeeID", "FirstName", "MiddleInitial", "LastName", "ProductID", "ProductName")
        .agg(
            F.sum(_QTY).cast("long").alias("Cantidad_Total_Vendida_Producto"),
            F.sum("__net").alias("Valor_Neto_Ventas_Producto"),
        )
        .select(
            F.col("EmployeeID").alias("ID_Empleado"),
            full_name_sql("FirstName", "MiddleInitial", "LastName").alias("Nombre_Completo_Empleado"),
            F.col("ProductName").alias("Nombre_Producto"),
            "Cantidad_Total_Vendida_Producto",
            "Valor_Neto_Ventas_Producto",
            F.col("ProductID").alias("ID_Producto"),
        )
        .orderBy(F.col("Valor_Neto_Ventas_Producto").desc(), F.col("ID_Producto"))
    )


# --------------------------------------------------------------------------------------------- R7
def price_list(
    star: Star, min_price: float | None = None, max_price: float | None = None, ascending: bool = False, limit: int = 5
) -> DataFrame:
    """Products strictly above ``min_price`` and/or below ``max_price``, by price, top ``limit``
    (ties by product ID). On a materialised star the price filter reaches the Parquet scan; on the
    adapter's it doesn't, as ``Price`` is a cast of the stored column."""
    p = star.products
    if min_price is not None:
        p = p.filter(F.col("Price") > F.lit(min_price))
    if max_price is not None:
        p = p.filter(F.col("Price") < F.lit(max_price))
    order = F.col("Price").asc() if ascending else F.col("Price").desc()
    return p.orderBy(order, F.col("ProductID")).limit(limit).select("ProductName", "Price", "ProductID")


# --------------------------------------------------------------------------------------------- R8
def city_staff(star: Star, city_id: int, limit: int = 5) -> DataFrame:
    """Employees of one city, newest hires first (no hire date last), top ``limit``."""
    return (
        star.employees.filter(F.col("CityID") == F.lit(city_id))
        .orderBy(F.col("HireDate").desc_nulls_last(), F.col("EmployeeID"))
        .limit(limit)
        .select("EmployeeID", "FirstName", "LastName", "HireDate")
    )


# --------------------------------------------------------------------------------------------- R9
def load_counts(star: Star) -> DataFrame:
    """Row count of each of the seven tables (one row per table)."""
    parts = [
        df.select(F.lit(name).alias("Tabla"), F.count(F.lit(1)).alias("Filas"))
        for name, df in star.as_dict().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------------------------------------------- R10
def products_per_category(star: Star) -> DataFrame:
    """Number of products per category ID."""
    return star.products.groupBy("CategoryID").agg(F.count(F.lit(1)).alias("TotalProducts"))


def sales_by_category_product(star: Star, limit: int | None = 10) -> DataFrame:
    """Units sold per (category name, product name), by category then units (most first)."""
    per_product = star.sales.groupBy("ProductID").agg(F.sum("Quantity").alias(_QTY))
    named = per_product.join(star.products.select("ProductID", "ProductName", "CategoryID"), "ProductID").join(
        star.categories, "CategoryID"
    )
    out = (
        named.groupBy("CategoryName", "ProductName")
        .agg(F.sum(_QTY).cast("long").alias("TotalVendido"))
        .select(F.col("CategoryName").alias("Categoria"), F.col("ProductName").alias("Producto"), "TotalVendido")
        .orderBy(F.col("Categoria").asc(), F.col("TotalVendido").desc(), F.col("Producto").asc())
    )
    return out.limit(limit) if limit is not None else out
