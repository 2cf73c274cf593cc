"""Adapter from the driver's testdata tables to the recommender's source schemas.

The same SQL text builds Spark DataFrames and, as a CTE prefix, the DuckDB
oracle. Every view reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# {K}: the book id carried in events.props (JSON).
_K = {
    "spark": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    "duckdb": "CAST(json_extract_string(props, '$.k') AS BIGINT)",
}

# (name, SELECT text). Order matters only for readability.
ADAPTER_VIEWS: list[tuple[str, str]] = [
    ("books", """
SELECT vec_id AS book_id, p_name AS title, p_type AS description, p_brand AS publisher,
       CAST(1950 + p_size AS INT) AS publication_year,
       CASE WHEN p_size = 50 THEN TRUE WHEN p_size = 49 THEN NULL ELSE FALSE END AS is_deleted
FROM embeddings LEFT JOIN part ON p_partkey = vec_id"""),
    ("authors", """
SELECT s_suppkey AS author_id, s_name AS author_name FROM supplier"""),
    ("book_authors", """
SELECT DISTINCT l_partkey AS book_id, l_suppkey AS author_id
FROM lineitem JOIN embeddings ON l_partkey = vec_id"""),
    ("genres", """
SELECT CAST(r_regionkey AS BIGINT) AS genre_id, r_name AS genre_name FROM region"""),
    ("book_genres", """
SELECT DISTINCT l_partkey AS book_id, CAST(n_regionkey AS BIGINT) AS genre_id
FROM lineitem JOIN embeddings ON l_partkey = vec_id
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""),
    ("ratings", """
SELECT user_id, {K} AS book_id, ts AS created_at,
       CAST(1 + CAST(floor(value) AS INT) % 5 AS INT) AS rating_value
FROM events WHERE event_type = 'purchase'"""),
    ("reading_history", """
SELECT user_id, {K} AS book_id, ts AS last_read_at,
       CASE WHEN event_type = 'view' THEN CAST(least(floor(value), 100) AS DOUBLE) END AS progress
FROM events WHERE event_type IN ('view', 'click')"""),
    ("favorites", """
SELECT user_id, {K} AS book_id, ts AS added_at FROM events WHERE event_type = 'signup'"""),
    ("feedback", """
SELECT event_id, ts, user_id, {K} AS book_id,
       CASE event_type WHEN 'purchase' THEN 'rating' WHEN 'view' THEN 'history'
                       WHEN 'click' THEN 'history' ELSE 'favorite' END AS event,
       CASE event_type WHEN 'purchase' THEN CAST(floor(value) AS INT) % 6
                       WHEN 'error' THEN 0 END AS rating_value
FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'"""),
    ("base_events", """
SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-25 00:00:00'"""),
    ("item_embeddings", """
SELECT vec_id AS book_id, embedding FROM embeddings"""),
    ("requests", """
SELECT c_custkey AS user_id FROM customer"""),
    ("docs", """
SELECT doc_id AS book_id, text, lang, source FROM documents"""),
]

# Boundary between the batch base log and the feedback stream in the fixtures.
FEEDBACK_START = "2024-01-25 00:00:00"


def view_sql(name: str, dialect: str) -> str:
    body = dict(ADAPTER_VIEWS)[name]
    return body.replace("{K}", _K[dialect]).strip()


def duckdb_prefix(names: list[str] | None = None) -> str:
    """``WITH`` clause holding the adapter views, for oracle SQL."""
    parts = [f"{n} AS ({view_sql(n, 'duckdb')})" for n, _ in ADAPTER_VIEWS
             if names is None or n in names]
    return "WITH " + ",\n".join(parts) + "\n"


# Raw tables each adapter view reads.
VIEW_DEPS = {
    "books": ("embeddings", "part"),
    "authors": ("supplier",),
    "book_authors": ("lineitem", "embeddings"),
    "genres": ("region",),
    "book_genres": ("lineitem", "embeddings", "supplier", "nation"),
    "ratings": ("events",), "reading_history": ("events",), "favorites": ("events",),
    "feedback": ("events",), "base_events": ("events",),
    "item_embeddings": ("embeddings",), "requests": ("customer",), "docs": ("documents",),
}


class Sources:
    """Lazy DataFrames in the source schemas the recommender reads.

    A view (and the raw tables under it) is resolved on first use only, so a
    query pays for the tables it reads and nothing else.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._raw: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def raw(self, table: str) -> DataFrame:
        if table not in self._raw:
            df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
            df.createOrReplaceTempView(table)
            self._raw[table] = df
        return self._raw[table]

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            for t in VIEW_DEPS[name]:
                # re-point the name at this folder's table (another Sources may have used it)
                self.raw(t).createOrReplaceTempView(t)
            df = self.spark.sql(view_sql(name, "spark"))
            df.createOrReplaceTempView(name)
            self._views[name] = df
        return self._views[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEW_DEPS:
            raise AttributeError(name)
        return self.view(name)


def register_raw(spark: SparkSession, sf_dir: str) -> None:
    for t in RAW_TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def load(spark: SparkSession, sf_dir: str) -> Sources:
    """The adapter views over ``sf_dir`` as lazily resolved DataFrames."""
    return Sources(spark, sf_dir)
