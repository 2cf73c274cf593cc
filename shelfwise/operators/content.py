"""Content model: item vectors, user profiles, user->item and item->item top-k."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.vectors import l2_normalize
from shelfwise.operators.blockscore import block_topk, exact_topk
from shelfwise.operators.boundscore import Dot, bounded_topk
from shelfwise.operators.interactions import interaction_store, seen_pairs
from shelfwise.operators.ranking import rank_per_key, topk_per_key


def item_vectors(item_embeddings: DataFrame, books: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """(book_id, embedding ARRAY<DOUBLE>) of the catalogue's (live) books; optionally re-normalised to unit length."""
    v = item_embeddings.select("book_id", F.col("embedding").cast("array<double>").alias("embedding"))
    if books is not None:
        v = v.join(books.select("book_id"), "book_id", "left_semi")
    return l2_normalize(v, "embedding") if normalize else v


def user_profiles(store: DataFrame, items: DataFrame) -> DataFrame:
    """profile = unit(sum(total_b * e_b) / sum(total_b)) over books that have a vector.

    ``store`` is (user_id, book_id, total). The weighted mean is Spark ML's
    Summarizer, a partial aggregate: a user with a huge history is summed
    map-side like any other group. Strengths are non-negative by construction,
    so zero weights add nothing and are dropped first; a user whose weights sum
    to 0 gets no profile.
    """
    j = (store.select("user_id", "book_id", F.col("total").cast("double").alias("w"))
         .where(F.col("w") > 0)
         .join(items.select("book_id", array_to_vector("embedding").alias("v")), "book_id"))
    agg = (j.groupBy("user_id")
           .agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m"), F.sum("w").alias("wsum"))
           .where(F.col("wsum") != 0)
           .select("user_id", vector_to_array("m").alias("profile")))
    return l2_normalize(agg, "profile").where(F.col("profile").isNotNull())


def profiles_long(profiles: DataFrame) -> DataFrame:
    """(user_id, pos, value) long form of the profile vectors, 0-based pos."""
    return profiles.select("user_id", F.posexplode("profile").alias("pos", "value")) \
        .select("user_id", F.col("pos").cast("bigint").alias("pos"), "value")


def content_recommend(profiles: DataFrame, items: DataFrame, seen: DataFrame, k: int = 10, pruned: bool = False) -> DataFrame:
    """Per user, the k best unseen items by profile . item (user_id, rank, book_id, score).

    All items are candidates; the user's seen items are removed before the cut.
    ``pruned`` clusters the items first and passes over cells that can't reach a
    list: the same rows, worth it for catalogues that cost far more than a k-means.
    """
    if pruned:
        return bounded_topk(profiles, "user_id", "profile", items, "book_id", "embedding", Dot(), k,
                            exclude=seen.select("user_id", "book_id"), out=("user_id", "rank", "book_id", "score"))[0]
    return exact_topk(profiles, "user_id", "profile", items, "book_id", "embedding", k,
                      exclude=seen.select("user_id", "book_id"), out=("user_id", "rank", "book_id", "score"))


def user_item_scores(profiles: DataFrame, items: DataFrame, k: int | None = None) -> DataFrame:
    """Every item's dot for every user, seen or not, ranked per user; with ``k`` each user's ``k`` best only.

    The block scorer gives out its blocks of scores as it makes them, so no task
    holds more than a block and a share of the users; the ranks are a sort of
    each user's scores that can go to disk.
    """
    cand = block_topk(profiles, "user_id", "profile", items, "book_id", "embedding", k)
    order = [F.col("score").desc(), F.col("rid").asc()]
    ranked = rank_per_key(cand, "lid", order) if k is None else topk_per_key(cand, "lid", order, k)
    return ranked.select(F.col("lid").alias("user_id"), "rank", F.col("rid").alias("book_id"), "score")


def similar_items(items: DataFrame, k: int = 10, positive_only: bool = True, pruned: bool = False) -> DataFrame:
    """Per book, the k most similar other books by dot (score > 0 by default); ``pruned`` as in ``content_recommend``."""
    if pruned:
        own = items.select("book_id", F.col("book_id").alias("other"))
        found = bounded_topk(items, "book_id", "embedding", items, "book_id", "embedding", Dot(), k, exclude=own,
                             out=("book_id", "rank", "similar_book_id", "score"))[0]
        return found.where("score > 0") if positive_only else found
    return exact_topk(items, "book_id", "embedding", items, "book_id", "embedding", k,
                      exclude_same_id=True, min_score=0.0 if positive_only else None,
                      out=("book_id", "rank", "similar_book_id", "score"))


def profile_top_books(store: DataFrame, n: int = 20) -> DataFrame:
    """A user's top-n books by total strength, labelled ``book_<id>``."""
    r = topk_per_key(store, "user_id", [F.col("total").desc(), F.col("book_id").asc()], n)
    return r.select("user_id", "rank", "book_id", F.concat(F.lit("book_"), F.col("book_id").cast("string")).alias("label"),
                    F.col("total").alias("strength"))


def fit_content(interactions: DataFrame, item_embeddings: DataFrame, books: DataFrame):
    """Store, item vectors and profiles for a log (the content model's training).

    Only live books (``books``) have a vector in the model, so a deleted book
    neither shapes a profile nor is recommended; the store keeps the whole log.
    """
    store = interaction_store(interactions)
    items = item_vectors(item_embeddings, books)
    profiles = user_profiles(store, items)
    return store, items, profiles, seen_pairs(interactions)
