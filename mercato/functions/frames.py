"""Whole-frame clean-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in floating-point columns (other columns cannot hold NaN)."""
    exprs = [
        F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*exprs)
