"""The retail star schema as Spark DataFrames.

:func:`load_star` derives the seven star tables from the TPC-H-like test tables
(``lineitem orders part customer supplier nation region``), lazily: nothing is read until an
action, and Catalyst prunes every column and join a query does not use.

Mapping (one fact, six dimensions):

=============  ==============================================================================
sales          lineitem ⋈ orders on the order key. SalesID = l_orderkey*10 + l_linenumber,
               SalesPersonID = l_suppkey (null on every 20th order: sales without a seller),
               ProductID = l_partkey, CustomerID = o_custkey, Quantity = l_quantity,
               Discount = l_discount as DECIMAL(10,2) (null on line 7: no discount given),
               TotalPrice = l_extendedprice as DECIMAL(10,2), TransactionNumber = order key text,
               SalesDate = a time of day below an hour, by order key and line (null on line 6)
products       part; Price = p_retailprice as DECIMAL(10,4); class, shelf life, allergy and
               modification time derived from p_size / p_partkey
categories     distinct p_type, CategoryID = position in name order
customers      customer; 'Customer#000000001' -> FirstName 'Customer', LastName '000000001';
               MiddleInitial = first letter of c_mktsegment (null for every 3rd customer)
cities         nation (CityID = n_nationkey, CountryID = n_regionkey)
countries      region (CountryCode = first two letters of the name)
employees      supplier; HireDate = first ship date of the supplier's lines
=============  ==============================================================================

The test tables have no null discounts, no sales without a seller and no blank initials, so the
nulls above are made on purpose: they exercise the null rules, the left join and the name rules.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.joins import checked_broadcast
from mercato.operators.windows import sequence_ids

# one Star per (session, folder): building it runs the dimension size checks once
_LOADED: dict[tuple[int, str], "Star"] = {}

@dataclass(frozen=True)
class Star:
    sales: DataFrame
    products: DataFrame
    categories: DataFrame
    customers: DataFrame
    employees: DataFrame
    cities: DataFrame
    countries: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def register_views(self, prefix: str = "") -> None:
        """Register the seven tables as temporary views (for ``spark.sql`` users)."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(prefix + name)


def write_star(star: Star, path: str, mode: str = "overwrite") -> None:
    """Materialise the seven tables as Parquet under ``path/<table>`` (build once, query many).

    The fact is written sorted inside each file by product, so Parquet min/max statistics let
    product filters skip row groups.
    """
    for name, df in star.as_dict().items():
        out = df.sortWithinPartitions("ProductID") if name == "sales" else df
        out.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")


def read_star(spark: SparkSession, path: str) -> Star:
    """The seven tables written by :func:`write_star` (or by the CSV loader) under ``path``.

    Small dimensions are broadcast only after their row-count check, as in :func:`load_star`.
    """
    t = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in (f.name for f in fields(Star))}
    return Star(
        sales=t["sales"],
        products=t["products"],
        categories=checked_broadcast(t["categories"]),
        customers=t["customers"],
        employees=t["employees"],
        cities=checked_broadcast(t["cities"]),
        countries=checked_broadcast(t["countries"]),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition ``df`` on ``keys`` over all cores when its scan has fewer splits than cores.

    A Parquet row group cannot be split, so a small file written as one row group is read by one
    task and everything fused into that scan stage (joins, partial aggregation) runs on one core.
    Large inputs have many splits and are left as they are. Hash partitioning on the join key is
    deterministic (safe to recompute) and lets the following join on that key reuse it.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view of the plan (e.g. Spark Connect): leave the scan as is
        return df
    return df.repartition(cores, *keys) if splits < cores else df


def _split_name(name: str):
    c = F.col(name)
    first = F.substring_index(c, "#", 1)
    last = F.expr(f"substring({name}, instr({name}, '#') + 1)")
    return first, last


def load_star(spark: SparkSession, sf_dir: str, reuse: bool = True) -> Star:
    """Star tables derived from the parquet test tables in ``sf_dir``.

    Small dimensions (categories, cities, countries) are broadcast only after a row-count check;
    with ``reuse`` the Star (its lazy plans and those check results) is kept per session and folder.
    """
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if reuse and key in _LOADED:
        return _LOADED[key]
    star = star_from_tables(lambda n: read_table(spark, sf_dir, n))
    if reuse:
        _LOADED[key] = star
    return star


def star_from_tables(table) -> Star:
    lineitem, orders, part = spread(table("lineitem"), "l_orderkey"), spread(table("orders"), "o_orderkey"), table("part")
    customer, supplier = table("customer"), table("supplier")
    nation, region = table("nation"), table("region")

    line = F.col("l_linenumber")
    sales = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("SalesID"),
        F.when(F.col("l_orderkey") % 20 != 0, F.col("l_suppkey")).cast("long").alias("SalesPersonID"),
        F.col("l_partkey").cast("long").alias("ProductID"),
        F.col("o_custkey").cast("long").alias("CustomerID"),
        F.col("l_quantity").cast("int").alias("Quantity"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount").cast("decimal(10,2)")).alias("Discount"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("TotalPrice"),
        F.when(line != 6, ((F.col("l_orderkey").cast("long") * 41 + line) % 3600) * 1_000_000 + line * 100_000).cast("long").alias("SalesDate"),
        F.col("l_orderkey").cast("string").alias("TransactionNumber"),
    )

    categories = sequence_ids(
        part.select(F.col("p_type").alias("CategoryName")).distinct(), ["CategoryName"], "CategoryID"
    ).select("CategoryID", "CategoryName")

    size = F.col("p_size")
    key = F.col("p_partkey")
    products = part.join(categories, part.p_type == categories.CategoryName).select(
        key.cast("long").alias("ProductID"),
        F.col("p_name").alias("ProductName"),
        F.col("p_retailprice").cast("decimal(10,4)").alias("Price"),
        F.col("CategoryID"),
        F.when(size <= 15, "Low").when(size <= 35, "Medium").otherwise("High").alias("Class"),
        (((key * 37) % 3600) * 1_000_000 + (key % 10) * 100_000).cast("long").alias("ModifyDate"),
        F.when(key % 3 == 0, "Durable").when(key % 3 == 1, "Weak").otherwise("Unknown").alias("Resistant"),
        F.when(size % 3 == 0, "TRUE").when(size % 3 == 1, "FALSE").otherwise("Unknown").alias("IsAllergic"),
        F.when(size % 4 == 0, F.lit(0)).otherwise((size * 7) % 400).cast("decimal(3,0)").alias("VitalityDays"),
    )

    c_first, c_last = _split_name("c_name")
    customers = customer.select(
        F.col("c_custkey").cast("long").alias("CustomerID"),
        c_first.alias("FirstName"),
        F.when(F.col("c_custkey") % 3 != 0, F.substring("c_mktsegment", 1, 1)).alias("MiddleInitial"),
        c_last.alias("LastName"),
        F.lit(None).cast("string").alias("Address"),
        F.col("c_nationkey").cast("long").alias("CityID"),
    )

    first_ship = lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("HireDate"))
    s_first, s_last = _split_name("s_name")
    sk = F.col("s_suppkey")
    employees = supplier.join(first_ship, supplier.s_suppkey == first_ship.l_suppkey, "left").select(
        sk.cast("long").alias("EmployeeID"),
        s_first.alias("FirstName"),
        F.when(sk % 4 != 0, F.expr("chr(65 + s_suppkey % 26)")).alias("MiddleInitial"),
        s_last.alias("LastName"),
        F.lit(None).cast("date").alias("BirthDate"),
        F.when(sk % 2 == 0, "F").otherwise("M").alias("Gender"),
        F.col("s_nationkey").cast("long").alias("CityID"),
        F.col("HireDate"),
    )

    cities = checked_broadcast(nation.select(
        F.col("n_nationkey").cast("long").alias("CityID"),
        F.col("n_name").alias("CityName"),
        F.lit(None).cast("string").alias("Zipcode"),
        F.col("n_regionkey").cast("long").alias("CountryID"),
    ))
    countries = checked_broadcast(region.select(
        F.col("r_regionkey").cast("long").alias("CountryID"),
        F.col("r_name").alias("CountryName"),
        F.upper(F.substring("r_name", 1, 2)).alias("CountryCode"),
    ))
    return Star(sales, products, categories, customers, employees, cities, countries)
