"""Catalogue and interaction loaders (the recommender's two source queries).

Both return lazy DataFrames; Parquet/JDBC scans get the soft-delete predicate and
the column selection pushed down by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERACTION_COLUMNS = ["user_id", "book_id", "ts", "strength", "type"]
BOOK_COLUMNS = ["book_id", "title", "description", "publisher", "publication_year",
                "authors_text", "genres_text"]


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default literal (plan-time, by name)."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
    return df


def first_present(df: DataFrame, candidates) -> str | None:
    """The first candidate column the frame has (e.g. rating_value, rating, strength)."""
    return next((c for c in candidates if c in df.columns), None)


def string_agg_distinct(col: str) -> Column:
    """Space-joined distinct non-null values, sorted; '' when none."""
    return F.coalesce(F.array_join(F.array_sort(F.collect_set(F.col(col))), " "), F.lit(""))


def live_books(books: DataFrame) -> DataFrame:
    """B1: keep rows whose is_deleted is FALSE (NULL drops out, as in SQL)."""
    return books.where(F.col("is_deleted") == F.lit(False))


def load_books(books: DataFrame, authors: DataFrame, book_authors: DataFrame,
               genres: DataFrame, book_genres: DataFrame) -> DataFrame:
    """Catalogue with space-joined distinct author and genre names.

    Each bridge is aggregated to one row per book before joining, so the
    authors x genres fan-out of a plain 4-way join never happens.
    """
    by_author = (book_authors.join(authors, "author_id")
                 .groupBy("book_id").agg(string_agg_distinct("author_name").alias("authors_text")))
    by_genre = (book_genres.join(genres, "genre_id")
                .groupBy("book_id").agg(string_agg_distinct("genre_name").alias("genres_text")))
    b = live_books(books).select("book_id", "title", "description", "publisher", "publication_year")
    return (b.join(by_author, "book_id", "left").join(by_genre, "book_id", "left")
            .select("book_id", "title", "description", "publisher", "publication_year",
                    F.coalesce("authors_text", F.lit("")).alias("authors_text"),
                    F.coalesce("genres_text", F.lit("")).alias("genres_text")))


def rating_strength(ratings: DataFrame) -> DataFrame:
    """B2: an explicit rating is its own strength."""
    return ratings.select("user_id", "book_id", F.col("created_at").alias("ts"),
                          F.col("rating_value").cast("double").alias("strength"),
                          F.lit("rating").alias("type"))


def history_strength_expr(progress: str = "progress") -> Column:
    """Reading progress 0-100 -> max(1, progress/100*5); unknown progress counts as half."""
    p = F.col(progress).cast("double")
    return F.greatest(F.lit(1.0), F.coalesce(p / F.lit(100.0), F.lit(0.5)) * F.lit(5.0)).cast("double")


def history_strength(reading_history: DataFrame) -> DataFrame:
    """B3 applied to the reading_history table."""
    return reading_history.select("user_id", "book_id", F.col("last_read_at").alias("ts"),
                                  history_strength_expr().alias("strength"), F.lit("history").alias("type"))


def favorite_strength(favorites: DataFrame) -> DataFrame:
    """A favourite weighs as a top rating."""
    return favorites.select("user_id", "book_id", F.col("added_at").alias("ts"),
                            F.lit(5.0).cast("double").alias("strength"), F.lit("favorite").alias("type"))


def load_interactions(ratings: DataFrame, reading_history: DataFrame, favorites: DataFrame) -> DataFrame:
    """A2/G1: one event log (user_id, book_id, ts, strength, type) from the three sources."""
    return (rating_strength(ratings)
            .unionByName(history_strength(reading_history))
            .unionByName(favorite_strength(favorites)))


def load_all(src) -> tuple[DataFrame, DataFrame]:
    """A3: both source queries, lazily."""
    return (load_books(src.books, src.authors, src.book_authors, src.genres, src.book_genres),
            load_interactions(src.ratings, src.reading_history, src.favorites))


def interactions_by_recency(interactions: DataFrame) -> DataFrame:
    """newest first with NULL timestamps first (PostgreSQL's DESC order), numbered.

    The order is one range-partitioned distributed sort; ``rn`` is its position.
    """
    from shelfwise.operators.ranking import global_row_number
    order = [F.col("ts").desc_nulls_first(), F.col("user_id").asc(), F.col("book_id").asc(),
             F.col("type").asc(), F.col("strength").asc()]
    return global_row_number(interactions, order, "rn")


class TableReader:
    """A4: read the source tables from Parquet folders or over JDBC.

    ``fmt='jdbc'`` reads ``schema.table`` from ``url``; when a numeric
    ``partition_column`` with bounds is given, the scan is split into
    ``num_partitions`` parallel range reads.
    """

    def __init__(self, spark: SparkSession, fmt: str = "parquet", base: str | None = None,
                 url: str | None = None, schema: str | None = None, properties: dict | None = None):
        self.spark, self.fmt, self.base = spark, fmt, base
        self.url, self.schema, self.properties = url, schema, dict(properties or {})

    def table(self, name: str, partition_column: str | None = None, lower: int | None = None,
              upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
        if self.fmt == "parquet":
            return self.spark.read.parquet(f"{self.base}/{name}")
        if self.fmt == "jdbc":
            qualified = f"{self.schema}.{name}" if self.schema else name
            if partition_column:
                return self.spark.read.jdbc(self.url, qualified, column=partition_column,
                                            lowerBound=lower, upperBound=upper,
                                            numPartitions=num_partitions, properties=self.properties)
            return self.spark.read.jdbc(self.url, qualified, properties=self.properties)
        return self.spark.read.format(self.fmt).load(f"{self.base}/{name}")

    def load_books(self) -> DataFrame:
        t = self.table
        return load_books(t("books"), t("authors"), t("book_authors"), t("genres"), t("book_genres"))

    def load_interactions(self) -> DataFrame:
        t = self.table
        return load_interactions(t("ratings"), t("reading_history"), t("favorites"))
