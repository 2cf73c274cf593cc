"""Result sinks: recommendation tables written as Parquet, partitioned by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_recommendations(recs: dict[str, DataFrame], path: str) -> None:
    """Write each variant's recommendation table under ``path/variant=<name>``.

    Dynamic partition overwrite replaces only the variants written now.
    """
    out = None
    for name, df in recs.items():
        d = df.withColumn("variant", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("variant").parquet(path))


def read_recommendations(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("variant") == variant) if variant else df
