"""Diverse alternatives per book: least tag overlap, least similar, then best rated.

For every target book at once: among all other catalogue books take the
``head = max(limit, oversample)`` with the smallest (tag overlap, similarity),
then re-rank that head by (rating DESC, 1 - similarity DESC) and keep ``limit``.
Similarity is the item-vector dot product, or TF-IDF cosine over the tag
columns when some catalogue book has no vector (all-or-nothing, as C9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import tag_tokens
from shelfwise.operators.blockscore import Feature, block_pairs
from shelfwise.operators.content import item_vectors
from shelfwise.operators.ranking import topk_per_key
from shelfwise.operators.tfidf import corpus, tfidf, tfidf_vectors

# Candidate tag columns, in order of preference.
CANDIDATE_COLUMNS = ("genres_text", "tags", "tag_name", "categories", "category", "authors",
                     "title", "description", "summary")
DEFAULT_OVERSAMPLE = 10
DIVERSITY_COLUMNS = ["book_id", "rank", "candidate_id", "rating", "score", "tag_overlap", "similarity"]


def project_diversity_columns(books: DataFrame) -> DataFrame:
    """book_id plus whichever candidate tag columns the catalogue has (plan-time choice)."""
    return books.select("book_id", *[c for c in CANDIDATE_COLUMNS if c in books.columns])


def tag_columns_of(books: DataFrame) -> list[str]:
    return [c for c in CANDIDATE_COLUMNS if c in books.columns] or ["genres_text"]


def tag_sets(books: DataFrame, columns) -> DataFrame:
    """H4: (book_id, tags) distinct white-space tokens of the tag columns."""
    return books.select("book_id", F.array_distinct(tag_tokens(list(columns))).alias("tags"))


def mean_rating_all(interactions: DataFrame) -> DataFrame:
    """Mean per book over every event type (the hybrids' rating map).

    The value column is the first present of rating_value, rating, strength;
    rows with a NULL book or value are dropped (B10).
    """
    from shelfwise.sources.catalog import first_present
    col = first_present(interactions, ("rating_value", "rating", "strength"))
    if col is None:
        return interactions.sparkSession.createDataFrame([], "book_id bigint, avg_rating double")
    return (interactions.where(F.col("book_id").isNotNull() & F.col(col).isNotNull())
            .groupBy("book_id").agg(F.avg(F.col(col).cast("double")).alias("avg_rating")))


def mean_rating_only(interactions: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Mean strength over ``type = 'rating'`` rows; if none exist, a catalogue rating column.

    The fallback is decided at plan time from the column list plus one
    existence probe (``limit(1)``), not by collecting the map.
    """
    m = (interactions.where((F.col("type") == "rating") & F.col("strength").isNotNull())
         .groupBy("book_id").agg(F.avg("strength").alias("avg_rating")))
    if books is not None and not m.limit(1).count():
        for c in ("average_rating", "mean_rating", "rating"):
            if c in books.columns:
                return books.where(F.col(c).isNotNull()).select("book_id", F.col(c).cast("double").alias("avg_rating"))
    return m


def global_rating(rating_map: DataFrame) -> DataFrame:
    """Mean of the per-book means (NaN skipped), 0.0 when the map is empty."""
    return rating_map.agg(F.coalesce(F.avg(F.when(~F.isnan("avg_rating"), F.col("avg_rating"))),
                                     F.lit(0.0)).alias("global_rating"))


def rating_lookup(keys: DataFrame, key: str, rating_map: DataFrame) -> DataFrame:
    """Attach each key's rating, else (or when NaN) the global rating.

    The global rating is a scalar subquery over the same map, so no job of its own is run for it.
    """
    g = global_rating(rating_map).scalar()
    r = rating_map.select(F.col("book_id").alias(key), F.col("avg_rating").alias("_r"))
    return (keys.join(r, key, "left")
            .withColumn("rating", F.when(F.col("_r").isNull() | F.isnan("_r"), g).otherwise(F.col("_r")))
            .drop("_r"))


def align_embeddings(books: DataFrame, item_embeddings: DataFrame) -> DataFrame:
    """Per catalogue book, whether it has a vector; all must, or TF-IDF is used."""
    e = item_embeddings.select("book_id", F.lit(True).alias("has_embedding"))
    return (books.select("book_id").join(e, "book_id", "left")
            .select("book_id", F.coalesce("has_embedding", F.lit(False)).alias("has_embedding")))


def uses_embeddings(books: DataFrame, item_embeddings: DataFrame) -> bool:
    missing = books.select("book_id").join(item_embeddings.select("book_id"), "book_id", "left_anti")
    return missing.limit(1).count() == 0


def _head_key(m, lid, rid):
    # Smallest overlap first, then smallest similarity (|sim| <= 1 for unit vectors).
    return -(4.0 * m["overlap"] + m["sim"])


def rating_map_of(interactions: DataFrame, books: DataFrame | None = None, rating_source: str = "all") -> DataFrame:
    """The rating map of a log: ``rating_source`` is 'all' event types (D6) or 'rating' rows only."""
    if rating_source not in ("all", "rating"):
        raise ValueError("rating_source must be 'all' or 'rating'")
    return mean_rating_all(interactions) if rating_source == "all" else mean_rating_only(interactions, books)


def diversity_recommend(books: DataFrame, item_embeddings: DataFrame | None, rating_map: DataFrame | None = None,
                        limit: int = 5, oversample: int = DEFAULT_OVERSAMPLE,
                        tag_columns=None, use_tfidf: bool | None = None, *,
                        interactions: DataFrame | None = None, rating_source: str = "all") -> DataFrame:
    """L3 for every catalogue book (book_id, rank, candidate_id, rating, score, tag_overlap, similarity).

    Ratings come from ``rating_map``, or from a log's ``rating_source`` events.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be within 1-100")
    if rating_map is None:
        if interactions is None:
            raise ValueError("a rating map or interactions are needed")
        rating_map = rating_map_of(interactions, books, rating_source)
    head = max(limit, oversample)
    cols = list(tag_columns) if tag_columns else tag_columns_of(books)
    tags = tag_sets(books, cols).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if use_tfidf is None:
        use_tfidf = item_embeddings is None or not uses_embeddings(books, item_embeddings)
    if use_tfidf:
        docs = corpus(books, cols)
        vec = tfidf_vectors(tfidf(docs), docs)
        sim = Feature("sim", "sparse", "tfidf", "tfidf")
    else:
        vec = books.select("book_id").join(
            item_vectors(item_embeddings, normalize=True), "book_id")
        sim = Feature("sim", "dense", "embedding", "embedding")
    items = vec.join(tags, "book_id")
    cand = block_pairs(items, "book_id", items, "book_id", head,
                       [sim, Feature("overlap", "set", "tags", "tags")], _head_key,
                       emit=("sim", "overlap"), exclude_same_id=True)
    heads = topk_per_key(cand, "lid", [F.col("overlap").asc(), F.col("sim").asc(), F.col("rid").asc()], head, "hrank")
    rated = rating_lookup(heads, "rid", rating_map)
    ranked = topk_per_key(rated, "lid", [F.col("rating").desc(), (F.lit(1.0) - F.col("sim")).desc(),
                                         F.col("hrank").asc()], limit)
    return ranked.select(F.col("lid").alias("book_id"), "rank", F.col("rid").alias("candidate_id"), "rating",
                         (F.lit(1.0) - F.col("sim")).alias("score"),
                         F.col("overlap").cast("bigint").alias("tag_overlap"), F.col("sim").alias("similarity"))


def tag_overlap(pairs: DataFrame, tags: DataFrame, a: str = "book_id", b: str = "other_id") -> DataFrame:
    """Size of the tag-set intersection for given (a, b) pairs."""
    ta = tags.select(F.col("book_id").alias(a), F.col("tags").alias("_ta"))
    tb = tags.select(F.col("book_id").alias(b), F.col("tags").alias("_tb"))
    return (pairs.join(ta, a, "left").join(tb, b, "left")
            .withColumn("tag_overlap", F.size(F.array_intersect(F.coalesce("_ta", F.array()),
                                                                F.coalesce("_tb", F.array()))).cast("bigint"))
            .drop("_ta", "_tb"))
