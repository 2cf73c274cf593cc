"""Registered queries: sources, interactions, content model."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import content as C
from shelfwise.operators import interactions as I
from shelfwise.plans.oracle import sql
from shelfwise.plans.registry import register
from shelfwise.sources import catalog as S

# ---------------------------------------------------------------- A / B / C1 / D1


@register("load_books", sql("SELECT * FROM catalog", "catalog"))
def q_load_books(c):
    """A1: live catalogue with space-joined distinct authors and genres."""
    return c.books


@register("books_left_join", sql("SELECT * FROM catalog", "catalog"))
def q_books_left_join(c):
    """The 4-way left join (pre-aggregated bridges), same rows as A1."""
    s = c.src
    return S.load_books(s.books, s.authors, s.book_authors, s.genres, s.book_genres)


@register("string_agg_distinct", sql("""
SELECT b.book_id, coalesce(a.authors_text, '') AS authors_text, coalesce(g.genres_text, '') AS genres_text
FROM books b LEFT JOIN by_author a USING (book_id) LEFT JOIN by_genre g USING (book_id)""",
                                     "books", "by_author", "by_genre"))
def q_string_agg_distinct(c):
    """Per book (deleted ones included) the distinct author / genre names, '' when none."""
    s = c.src
    a = (s.book_authors.join(s.authors, "author_id").groupBy("book_id")
         .agg(S.string_agg_distinct("author_name").alias("authors_text")))
    g = (s.book_genres.join(s.genres, "genre_id").groupBy("book_id")
         .agg(S.string_agg_distinct("genre_name").alias("genres_text")))
    return (s.books.select("book_id").join(a, "book_id", "left").join(g, "book_id", "left")
            .select("book_id", F.coalesce("authors_text", F.lit("")).alias("authors_text"),
                    F.coalesce("genres_text", F.lit("")).alias("genres_text")))


@register("filter_soft_delete", sql("SELECT * FROM live", "live"))
def q_filter_soft_delete(c):
    """B1: books whose is_deleted is FALSE."""
    return S.live_books(c.src.books).select("book_id", "title", "description", "publisher", "publication_year")


@register("load_interactions", sql("SELECT * FROM inter", "inter"))
def q_load_interactions(c):
    """A2: the three-way interaction log."""
    return c.interactions


@register("union_all", sql("SELECT * FROM inter", "inter"))
def q_union_all(c):
    """G1: UNION ALL of ratings, reading history and favourites."""
    s = c.src
    return (S.rating_strength(s.ratings).unionByName(S.history_strength(s.reading_history))
            .unionByName(S.favorite_strength(s.favorites)))


@register("strength_rating", sql(
    "SELECT user_id, book_id, created_at AS ts, CAST(rating_value AS DOUBLE) AS strength FROM ratings", "ratings"))
def q_strength_rating(c):
    """B2: rating -> strength."""
    return S.rating_strength(c.src.ratings).select("user_id", "book_id", "ts", "strength")


@register("strength_history", sql("""
SELECT user_id, book_id, last_read_at AS ts, progress,
       CAST(greatest(CAST(1.0 AS DOUBLE), coalesce(progress / CAST(100.0 AS DOUBLE), CAST(0.5 AS DOUBLE)) * CAST(5.0 AS DOUBLE)) AS DOUBLE) AS strength
FROM reading_history""", "reading_history"))
def q_strength_history(c):
    """Reading progress -> strength (NULL progress counts as 50 %, floor 1.0)."""
    h = c.src.reading_history
    return h.select("user_id", "book_id", F.col("last_read_at").alias("ts"), "progress",
                    S.history_strength_expr().alias("strength"))


@register("strength_favorite", sql(
    "SELECT user_id, book_id, added_at AS ts, CAST(5.0 AS DOUBLE) AS strength FROM favorites", "favorites"))
def q_strength_favorite(c):
    """Favourite -> 5.0."""
    return S.favorite_strength(c.src.favorites).select("user_id", "book_id", "ts", "strength")


@register("interactions_by_recency", sql("""
SELECT *, CAST(row_number() OVER (ORDER BY ts DESC NULLS FIRST, user_id, book_id, type, strength) AS BIGINT) AS rn
FROM inter""", "inter"))
def q_interactions_by_recency(c):
    """ORDER BY ts DESC (NULLs first), position as rn."""
    return S.interactions_by_recency(c.interactions)


# ---------------------------------------------------------------- D2 / D3 / D9 / B6 / B7


@register("agg_strength", sql(
    "SELECT user_id, book_id, sum(strength) AS strength FROM inter GROUP BY user_id, book_id", "inter"))
def q_agg_strength(c):
    """Summed strength per (user, book)."""
    return I.agg_strength(c.interactions)


@register("interaction_store", sql("SELECT * FROM store", "store"))
def q_interaction_store(c):
    """D3: total and per-type strength per (user, book)."""
    return I.interaction_store(c.interactions)


@register("interaction_stats", sql("""
SELECT count(*) AS n_interactions, count(DISTINCT user_id) AS n_users, count(DISTINCT book_id) AS n_books,
       min(strength) AS min_strength, max(strength) AS max_strength, avg(strength) AS mean_strength,
       quantile_cont(strength, 0.5) AS median_strength
FROM inter""", "inter"))
def q_interaction_stats(c):
    """Strength min/max/mean/median and log sizes."""
    return I.interaction_stats(c.interactions)


@register("known_pairs", sql("""
SELECT i.* FROM inter i
WHERE i.user_id IN (SELECT user_id FROM inter WHERE ts < TIMESTAMP '2024-01-25 00:00:00')
  AND i.book_id IN (SELECT book_id FROM item_embeddings)""", "inter", "item_embeddings"))
def q_known_pairs(c):
    """Log rows whose user is known (has early history) and whose book has a vector."""
    inter = c.interactions
    users = inter.where(F.col("ts") < F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return I.known_pairs(inter, users, c.src.item_embeddings)


@register("exclude_seen", sql("""
SELECT r.user_id, r.book_id, r.score FROM (
  SELECT p.user_id, m.book_id, list_dot_product(p.p, m.e) AS score,
         row_number() OVER (PARTITION BY p.user_id ORDER BY round(list_dot_product(p.p, m.e), 12) DESC, m.book_id) AS rk
  FROM prof p, emb m
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.book_id = m.book_id)) r
WHERE r.rk <= 30""",
                                "prof", "emb", "seen"))
def q_exclude_seen(c):
    """Each user's 30 best-scored items among those not seen yet (exclude, then cut)."""
    store, items, profiles, seen = c.content
    return C.content_recommend(profiles, items, seen, 30).select("user_id", "book_id", "score")


# ---------------------------------------------------------------- content model

_PROFILE_LONG = "SELECT user_id, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM plong"


@register("user_profiles", sql(_PROFILE_LONG, "plong"))
def q_user_profiles(c):
    """Unit weighted-mean profile per user, long form (user_id, pos, value)."""
    store, items, profiles, seen = c.content
    return C.profiles_long(profiles)


_CONTENT_REC = """
SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, round(score, 6) AS score FROM (
  SELECT p.user_id, m.book_id, list_dot_product(p.p, m.e) AS score,
         row_number() OVER (PARTITION BY p.user_id ORDER BY round(list_dot_product(p.p, m.e), 12) DESC, m.book_id) AS rk
  FROM prof p, emb m
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.book_id = m.book_id)) t
WHERE rk <= 10"""


@register("content_recommend", sql(_CONTENT_REC, "prof", "emb", "seen"))
def q_content_recommend(c):
    """L1c (flagship): top-10 unseen books per user by profile . embedding."""
    store, items, profiles, seen = c.content
    return C.content_recommend(profiles, items, seen, 10)


@register("content_recommend_pruned", sql(_CONTENT_REC, "prof", "emb", "seen"))
def q_content_recommend_pruned(c):
    """L1c by clustered cells and bounds; equals content_recommend."""
    store, items, profiles, seen = c.content
    return C.content_recommend(profiles, items, seen, 10, pruned=True)


@register("user_item_scores", sql("""
SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, round(score, 6) AS score FROM (
  SELECT p.user_id, m.book_id, list_dot_product(p.p, m.e) AS score,
         row_number() OVER (PARTITION BY p.user_id ORDER BY round(list_dot_product(p.p, m.e), 12) DESC, m.book_id) AS rk
  FROM prof p, emb m) t""", "prof", "emb"))
def q_user_item_scores(c):
    """Profile . item for every user and every item, ranked per user (blocked scorer)."""
    store, items, profiles, seen = c.content
    return C.user_item_scores(profiles, items)


_SIMILAR = """
SELECT book_id, CAST(rk AS BIGINT) AS rank, similar_book_id, round(score, 6) AS score FROM (
  SELECT a.book_id, b.book_id AS similar_book_id, list_dot_product(a.e, b.e) AS score,
         row_number() OVER (PARTITION BY a.book_id ORDER BY round(list_dot_product(a.e, b.e), 12) DESC, b.book_id) AS rk
  FROM emb a, emb b WHERE a.book_id <> b.book_id AND list_dot_product(a.e, b.e) > 0) t
WHERE rk <= 10"""


@register("similar_items", sql(_SIMILAR, "emb"))
def q_similar_items(c):
    """L2: the 10 most similar other books per book, positive scores only."""
    return C.similar_items(C.item_vectors(c.src.item_embeddings, c.live), 10)


@register("similar_items_pruned", sql(_SIMILAR, "emb"))
def q_similar_items_pruned(c):
    """L2 by clustered cells and bounds; equals similar_items."""
    return C.similar_items(C.item_vectors(c.src.item_embeddings, c.live), 10, pruned=True)


@register("item_item_scores", sql("""
SELECT book_id, CAST(rk AS BIGINT) AS rank, other_id, round(score, 6) AS score FROM (
  SELECT a.book_id, b.book_id AS other_id, list_dot_product(a.e, b.e) AS score,
         row_number() OVER (PARTITION BY a.book_id ORDER BY round(list_dot_product(a.e, b.e), 12) DESC, b.book_id) AS rk
  FROM emb a, emb b WHERE a.book_id <> b.book_id) t
WHERE rk <= 20""", "emb"))
def q_item_item_scores(c):
    """Item x item similarity, self excluded (negatives kept), 20 per item."""
    items = C.item_vectors(c.src.item_embeddings, c.live)
    from shelfwise.operators.blockscore import exact_topk
    return exact_topk(items, "book_id", "embedding", items, "book_id", "embedding", 20,
                      exclude_same_id=True, out=("book_id", "rank", "other_id", "score"))
