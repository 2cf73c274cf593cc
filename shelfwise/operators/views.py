"""Read views over the model tables: model summary, per-user summary and interaction lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.ranking import topk_per_key


def model_info(spark: SparkSession, store: DataFrame, books: DataFrame, profiles: DataFrame,
               items: DataFrame, params: dict) -> DataFrame:
    """One row of model sizes (each an aggregate read as a scalar) and hyper-parameters."""
    m = store.agg(F.countDistinct("user_id").alias("n_users"), F.countDistinct("book_id").alias("n_items"),
                  F.sum((F.col("total") != 0).cast("long")).alias("nnz")).first()
    n_books = books.select("book_id").distinct().count()
    n_profiles = profiles.count()
    dim = items.agg(F.max(F.size("embedding"))).first()[0]
    row = dict(n_users=int(m["n_users"]), n_items=int(m["n_items"]), nnz=int(m["nnz"] or 0), n_books=int(n_books),
               n_profiles=int(n_profiles), embedding_dim=int(dim or 0))
    row.update({k: float(v) for k, v in params.items() if isinstance(v, (int, float))})
    cols = list(row)
    types = ", ".join(f"{c} {'bigint' if isinstance(row[c], int) else 'double'}" for c in cols)
    return spark.createDataFrame([tuple(row[c] for c in cols)], types)


def user_summary(store: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per user, number of books interacted with and the profile dimension (0 without one)."""
    n = store.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_interactions"))
    d = profiles.select("user_id", F.size("profile").alias("dimension"))
    return (n.join(d, "user_id", "left")
            .select("user_id", F.col("num_interactions").cast("bigint").alias("num_interactions"),
                    F.coalesce("dimension", F.lit(0)).cast("bigint").alias("dimension")))


def user_profile_view(store: DataFrame, profiles: DataFrame, top: int = 10) -> DataFrame:
    """Per user the summary plus the top-``top`` books by total strength (long form)."""
    s = user_summary(store, profiles)
    t = topk_per_key(store, "user_id", [F.col("total").desc(), F.col("book_id").asc()], top)
    return s.join(t.select("user_id", "rank", "book_id", F.col("total").alias("strength")), "user_id")


def user_interactions_view(store: DataFrame) -> DataFrame:
    """Every (user, book) ranked by total strength, with the per-type breakdown."""
    from pyspark.sql.window import Window
    w = Window.partitionBy("user_id").orderBy(F.col("total").desc(), F.col("book_id").asc())
    return store.withColumn("rank", F.row_number().over(w).cast("bigint")).select(
        "user_id", "rank", "book_id", "total", "rating", "history", "favorite")
