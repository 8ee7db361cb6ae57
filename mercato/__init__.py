"""mercato: retail star-schema analytics on Apache Spark.

Sub-packages
------------
sources    readers for the star tables (test-table adapter, CSV files) and the Parquet sink
functions  column expressions for the business rules (money, names, dates, times, products)
operators  scale-safe building blocks (checked broadcast, orphans, global rank / ntile, quality rules)
plans      the user-level results (reports R2-R10, specification queries R1)
streaming  incremental CSV ingestion with the same rules
"""

__version__ = "0.1.0"
