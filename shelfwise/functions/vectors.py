"""Dense-vector expressions over ARRAY<DOUBLE> columns (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """H6: sum(a[i] * b[i]); cosine when both sides are unit vectors."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0).cast("double"),
                       lambda acc, x: acc + x)


def norm2(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """H5: v / ||v||; a zero vector becomes NULL (there is no direction to keep)."""
    out = out or col
    return (df.withColumn("_norm", F.nullif(norm2(col), F.lit(0.0)))
            .withColumn(out, F.when(F.col("_norm").isNull(), F.lit(None))
                        .otherwise(F.transform(F.col(col).cast("array<double>"), lambda x: x / F.col("_norm"))))
            .drop("_norm"))


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")
