"""Registered queries: views, ranking primitives, trained models, persistence, training job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions.text import build_document
from shelfwise.functions.vectors import dot, l2_normalize
from shelfwise.operators import cf as CF
from shelfwise.operators import evaluation as E
from shelfwise.operators import hybrid as H
from shelfwise.operators import latent as LT
from shelfwise.operators import neural as NN
from shelfwise.operators import textsvd as SV
from shelfwise.operators import views as VW
from shelfwise.operators.content import content_recommend, fit_content, item_vectors, profile_top_books, profiles_long, user_profiles
from shelfwise.operators.encode import encode_items, hashed_tfidf_encode
from shelfwise.operators.popularity import popularity
from shelfwise.operators.ranking import dense_id_map, topk_per_key
from shelfwise.plans import training as TR
from shelfwise.plans.oracle import sql
from shelfwise.plans.registry import register
from shelfwise.session import disk_freed, scratch_path


def _cf(c):
    return c.memo("als", lambda: CF.als_train(c.interactions))


def _latent(c):
    return c.memo("latent", lambda: LT.latent_train(c.interactions))


def _neural(c):
    return c.memo("neural", lambda: NN.neural_train(c.interactions))


@register("model_info", sql("""
SELECT (SELECT count(DISTINCT user_id) FROM store) AS n_users, (SELECT count(DISTINCT book_id) FROM store) AS n_items,
       (SELECT count(*) FROM store WHERE total <> 0) AS nnz, (SELECT count(DISTINCT book_id) FROM catalog) AS n_books,
       (SELECT count(*) FROM prof) AS n_profiles, (SELECT max(len(e)) FROM emb) AS embedding_dim,
       CAST(0.4 AS DOUBLE) AS alpha, CAST(64 AS DOUBLE) AS als_factors, CAST(30 AS DOUBLE) AS als_iterations,
       CAST(0.01 AS DOUBLE) AS als_regularization""", "store", "catalog", "prof", "emb"))
def q_model_info(c):
    """Sizes and hyper-parameters of a saved model, read back from its tables and metadata; one row."""
    store, items, profiles, seen = c.content
    base = scratch_path(c.spark, f"models-{uuid.uuid4().hex[:8]}")
    TR.save_models(c.spark, base, {"store": store, "profiles": profiles, "item_vectors": items, "books": c.books.select("book_id")},
                   {"alpha": H.ALS.alpha, **CF.defaults()})
    m = TR.load_models(c.spark, base)
    return VW.model_info(c.spark, m.tables["store"], m.tables["books"], m.tables["profiles"], m.tables["item_vectors"], m.metadata)


@register("user_summary", sql("""
SELECT s.user_id, CAST(count(*) AS BIGINT) AS num_interactions, CAST(coalesce(any_value(len(p.p)), 0) AS BIGINT) AS dimension
FROM store s LEFT JOIN prof p USING (user_id) GROUP BY s.user_id""", "store", "prof"))
def q_user_summary(c):
    """Books per user and profile dimension."""
    store, items, profiles, seen = c.content
    return VW.user_summary(store, profiles)


_TOPSTORE = """
SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, total FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, book_id) AS rk FROM store) t WHERE rk <= {n}"""


@register("profile_keywords", sql(f"""
SELECT user_id, rank, book_id, 'book_' || CAST(book_id AS VARCHAR) AS label, round(total, 6) AS strength
FROM ({_TOPSTORE.format(n=20)}) x""", "store"))
def q_profile_keywords(c):
    """Each user's 20 strongest books, labelled book_<id>."""
    store, items, profiles, seen = c.content
    return profile_top_books(store, 20)


@register("user_profile_view", sql(f"""
SELECT x.user_id, u.num_interactions, u.dimension, x.rank, x.book_id, round(x.total, 6) AS strength
FROM ({_TOPSTORE.format(n=10)}) x JOIN (
  SELECT s.user_id, CAST(count(*) AS BIGINT) AS num_interactions, CAST(coalesce(any_value(len(p.p)), 0) AS BIGINT) AS dimension
  FROM store s LEFT JOIN prof p USING (user_id) GROUP BY s.user_id) u USING (user_id)""", "store", "prof"))
def q_user_profile_view(c):
    """Per-user summary with the top-10 books."""
    store, items, profiles, seen = c.content
    return VW.user_profile_view(store, profiles, 10)


@register("user_interactions_view", sql("""
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY total DESC, book_id) AS BIGINT) AS rank,
       book_id, round(total, 6) AS total, round(rating, 6) AS rating, round(history, 6) AS history,
       round(favorite, 6) AS favorite FROM store""", "store"))
def q_user_interactions_view(c):
    """Every user's books by total strength with the per-type breakdown."""
    store, items, profiles, seen = c.content
    return VW.user_interactions_view(store)


@register("topk_per_user", sql("""
SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, round(strength, 6) AS score FROM (
  SELECT user_id, book_id, sum(strength) AS strength,
         row_number() OVER (PARTITION BY user_id ORDER BY sum(strength) DESC, book_id) AS rk
  FROM inter GROUP BY user_id, book_id) t WHERE rk <= 5""", "inter"))
def q_topk_per_user(c):
    """Each user's 5 strongest books (window with WindowGroupLimit)."""
    from shelfwise.operators.interactions import agg_strength
    r = topk_per_key(agg_strength(c.interactions), "user_id", [F.col("strength").desc(), F.col("book_id").asc()], 5)
    return r.select("user_id", "rank", "book_id", F.col("strength").alias("score"))


@register("dense_id_map", sql("""
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT user_id FROM inter) t""", "inter"))
def q_dense_id_map(c):
    """Sorted distinct user ids -> 0..n-1."""
    return dense_id_map(c.interactions.select("user_id"), "user_id", "idx")


@register("l2_normalize", sql("""
SELECT book_id, CAST(pos AS BIGINT) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY book_id)), 6) AS value
FROM (SELECT book_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM emb) t""", "emb"))
def q_l2_normalize(c):
    """H5: every item vector scaled to unit length (long form)."""
    v = item_vectors(c.src.item_embeddings, c.live)
    n = l2_normalize(v, "embedding")
    return n.select("book_id", F.posexplode("embedding").alias("pos", "value")).select(
        "book_id", F.col("pos").cast("bigint").alias("pos"), "value")


@register("dot", sql("""
SELECT s.user_id, s.book_id, round(list_dot_product(p.p, m.e), 6) AS score
FROM store s JOIN prof p USING (user_id) JOIN emb m USING (book_id)""", "store", "prof", "emb"))
def q_dot(c):
    """H6: affinity profile . item of every user to each book they interacted with."""
    store, items, profiles, seen = c.content
    return (store.select("user_id", "book_id").join(profiles, "user_id").join(items, "book_id")
            .select("user_id", "book_id", dot("profile", "embedding").alias("score")))


# ---------------------------------------------------------------- trained models (rows-only checks)


@register("als_train")
def q_als_train(c):
    """Implicit ALS factors (kind, id, factor norm) for every user and item."""
    m = _cf(c)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    return (m.user_factors().select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), norm.alias("norm"))
            .unionByName(m.item_factors().select(F.lit("item").alias("kind"), F.col("book_id").alias("id"),
                                                 norm.alias("norm"))))


@register("als_recommend")
def q_als_recommend(c):
    """Top-10 unseen books per CF user from the ALS factors."""
    store, items, profiles, seen = c.content
    return CF.als_recommend(_cf(c), seen, 10)


@register("hybrid_recommend_als")
def q_hybrid_recommend_als(c):
    """L1a live: ALS + content hybrid for every customer."""
    store, items, profiles, seen = c.content
    return H.hybrid_recommend(c.src.requests, CF.als_candidates(_cf(c), seen, 30),
                              H.content_candidates(profiles, items, seen, 30), popularity(c.interactions), seen,
                              10, H.ALS)


@register("latent_train")
def q_latent_train(c):
    """The latent model's head coefficients (one row per coefficient)."""
    m = _latent(c)
    rows = [(i, float(v)) for i, v in enumerate(m.coef)] + [(-1, m.intercept)]
    return c.spark.createDataFrame(rows, "coef_index int, value double")


@register("latent_score")
def q_latent_score(c):
    """Latent score of every observed (user, book) pair."""
    from shelfwise.operators.interactions import agg_strength
    return _latent(c).predict(agg_strength(c.interactions)).select("user_id", "book_id", "strength", "prediction")


@register("latent_recommend")
def q_latent_recommend(c):
    """I8: top-10 per user by the latent model, training pairs excluded before the cut."""
    return LT.latent_recommend(_latent(c), 10)


@register("hybrid_recommend_latent_live")
def q_hybrid_recommend_latent_live(c):
    """L1b live: latent + content hybrid for every customer."""
    store, items, profiles, seen = c.content
    cand = LT.latent_recommend(_latent(c), 20, exclude=seen).select("user_id", "book_id", F.col("score").alias("cf"))
    return H.hybrid_recommend(c.src.requests, cand, H.content_candidates(profiles, items, seen, 20),
                              popularity(c.interactions), seen, 10, H.LATENT)


@register("latent_evaluate")
def q_latent_evaluate(c):
    """MSE / RMSE, hit rate @5 and @10 and coverage of the latent model on the temporal test split."""
    split = E.temporal_split(c.interactions, 0.2)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    return LT.latent_evaluate(LT.latent_train(train), test, (5, 10))


@register("neural_train")
def q_neural_train(c):
    """I6 with the network: RMSE on the held-out pairs after each round, the linear head's at round 0."""
    rows = list(enumerate(float(x) for x in _neural(c).history))
    return c.spark.createDataFrame(rows, "round int, rmse double")


@register("neural_score")
def q_neural_score(c):
    """I7 with the network: score of every observed (user, book) pair."""
    from shelfwise.operators.interactions import agg_strength
    return _neural(c).predict(agg_strength(c.interactions)).select("user_id", "book_id", "strength", "prediction")


@register("neural_recommend")
def q_neural_recommend(c):
    """I8 with the network: top-10 per user by branch and bound, training pairs excluded before the cut."""
    return NN.neural_recommend(_neural(c), 10)


@register("neural_bounds")
def q_neural_bounds(c):
    """I8 with the network: the numbers of pairs that the bounds let through and passed over."""
    return NN.neural_recommend(_neural(c), 10, stats=True)[1]


@register("neural_evaluate")
def q_neural_evaluate(c):
    """I9 with the network: MSE / RMSE beside the linear head's, hit rate and coverage on the temporal test split."""
    split = E.temporal_split(c.interactions, 0.2)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    return NN.neural_evaluate(NN.neural_train(train), test)


@register("recommender_invariants", sql("""
SELECT model, users, rows, CAST(0 AS BIGINT) AS seen_rows, CAST(0 AS BIGINT) AS rank_faults, CAST(0 AS BIGINT) AS order_faults
FROM (VALUES ('als'), ('latent'), ('neural')) v(model), (
  SELECT CAST(count(*) AS BIGINT) AS users, CAST(sum(n) AS BIGINT) AS rows FROM (
    SELECT t.user_id, least(10, (SELECT count(DISTINCT book_id) FROM pairs WHERE s <> 0)
                                - count(*) FILTER (WHERE t.book_id IN (SELECT book_id FROM pairs WHERE s <> 0))) AS n
    FROM pairs t GROUP BY t.user_id HAVING bool_or(t.s <> 0)) x WHERE n > 0) y""".replace(
    "pairs", "(SELECT user_id, book_id, sum(strength) AS s FROM inter GROUP BY user_id, book_id)"), "inter"))
def q_recommender_invariants(c):
    """I1/I2/I6-I8 by what must hold: a list for every user with as many books as are left, none seen, dense ranks, falling scores."""
    store, items, profiles, seen = c.content
    lists = {"als": lambda: CF.als_recommend(_cf(c), seen, 10), "latent": lambda: LT.latent_recommend(_latent(c), 10),
             "neural": lambda: NN.neural_recommend(_neural(c), 10)}
    out = None
    for model, make in lists.items():
        with disk_freed(c.spark):
            recs = make().checkpoint(eager=True)
            known = recs.join(seen.select("user_id", "book_id"), ["user_id", "book_id"], "left_semi").count()
            users = recs.groupBy("user_id").agg(
                F.count("*").alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"),
                F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("x"))  # ten rows at most
            falls = F.size(F.filter(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.get("x", i)["score"] > F.get("x", i - 1)["score"]))
            row = users.agg(F.count("*").alias("users"), F.sum("n").alias("rows"), F.lit(known).cast("bigint").alias("seen_rows"),
                            F.sum(((F.col("n") != F.col("last")) | (F.col("n") != F.col("ranks"))).cast("bigint")).alias("rank_faults"),
                            F.sum(F.when(F.col("n") > 1, falls).otherwise(0).cast("bigint")).alias("order_faults"))
            row = row.select(F.lit(model).alias("model"), "*").checkpoint(eager=True)
            out = row if out is None else out.unionByName(row)
            del recs, users, row
    return out


@register("cross_validate")
def q_cross_validate(c):
    """5-fold cross-validation of the latent model."""
    return LT.cross_validate(c.interactions)


@register("grid_search")
def q_grid_search(c):
    """Grid over the head's weight decay, 3-fold CV, minimising RMSE."""
    return LT.grid_search(c.interactions, {"reg": [1e-5, 1e-1]})


@register("content_encode")
def q_content_encode(c):
    """Built-in encoder (hashed TF-IDF of the built document) for every live book."""
    return hashed_tfidf_encode(c.books).select("book_id", F.size("embedding").alias("dim"),
                                               F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
                                               .alias("norm2"))


@register("content_encode_table", sql("""
SELECT book_id, CAST(pos AS BIGINT) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY book_id)), 6) AS value
FROM (SELECT book_id, unnest(e) AS v, generate_subscripts(e, 1) - 1 AS pos FROM emb WHERE book_id IN (SELECT book_id FROM catalog)) t""",
                                      "emb", "catalog"))
def q_content_encode_table(c):
    """I3 form (a): unit vectors of the live books from the table of vectors, long form."""
    v = encode_items(c.books, c.src.item_embeddings)
    return v.select("book_id", F.posexplode("embedding").alias("pos", "value")).select(
        "book_id", F.col("pos").cast("bigint").alias("pos"), "value")


def _projection(c):
    return c.memo("projection", lambda: SV.fit_projection(c.books.select(build_document().alias("document"))))


@register("content_encode_svd")
def q_content_encode_svd(c):
    """I3 form (b): dense unit vectors of the live books, learned from their texts, long form."""
    v = SV.project(c.books, _projection(c))
    return v.select("book_id", F.posexplode("embedding").alias("pos", "value")).select(
        "book_id", F.col("pos").cast("bigint").alias("pos"), "value")


@register("content_encode_model")
def q_content_encode_model(c):
    """I3 form (c) and U1: the same vectors by the saved projection, loaded by each worker for ``predict_batch_udf``, long form."""
    base = scratch_path(c.spark, f"models-{uuid.uuid4().hex[:8]}")
    path = TR.save_models(c.spark, base, {"projection": _projection(c).table(c.books)}, {"dim": _projection(c).dim})
    v = SV.model_vectors(c.books, f"{path}/projection")
    return v.select("book_id", F.posexplode("embedding").alias("pos", "value")).select(
        "book_id", F.col("pos").cast("bigint").alias("pos"), "value")


@register("content_encode_invariants", sql("""
SELECT CAST(count(*) AS BIGINT) AS books, CAST(count(*) AS BIGINT) AS unit_vectors, CAST(count(*) AS BIGINT) AS same_by_model,
       CAST(0 AS DOUBLE) AS orthogonality_gap, CAST(0 AS BIGINT) AS singular_faults
FROM catalog""", "catalog"))
def q_content_encode_invariants(c):
    """I3/U1 by what must hold: a unit vector for each live book, the same from the saved model, an orthonormal projection, and
    over all books again: no projected column shorter than its singular value, the first one equal to it, all together at most the rows' length."""
    import numpy as np
    projection = _projection(c)
    base = scratch_path(c.spark, f"models-{uuid.uuid4().hex[:8]}")
    path = TR.save_models(c.spark, base, {"projection": projection.table(c.books)}, {"dim": projection.dim})
    one, two = SV.project(c.books, projection), SV.model_vectors(c.books, f"{path}/projection").withColumnRenamed("embedding", "other")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    gap = F.aggregate(F.zip_with("embedding", "other", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    again = SV.column_lengths(c.books.select(build_document().alias("document")), projection)
    faults = int((again < projection.singular * (1 - 1e-9)).sum()) + int(abs(again[0] / projection.singular[0] - 1) > 1e-6)
    energy = float((again ** 2).sum())
    flat = float(np.abs(projection.components.T @ projection.components - np.eye(projection.dim)).max())
    return one.join(two, "book_id").agg(
        F.count("*").alias("books"), F.sum((F.abs(length - 1) < 1e-9).cast("bigint")).alias("unit_vectors"),
        F.sum((gap < 1e-9).cast("bigint")).alias("same_by_model"), F.lit(flat).alias("orthogonality_gap"),
        (F.lit(faults) + F.when(F.lit(energy) <= F.count("*") * (1 + 1e-9), 0).otherwise(1)).cast("bigint").alias("singular_faults"))


@register("content_recommend_encoded")
def q_content_recommend_encoded(c):
    """I3 form (b) to L1c: text -> learned dense vectors -> profiles -> the 10 best unseen books per user."""
    items = encode_items(c.books)
    store, _, _, seen = c.content
    return content_recommend(user_profiles(store, items), items, seen, 10)


@register("artifact_roundtrip", sql("""
SELECT 'profile' AS kind, user_id AS a, CAST(pos AS BIGINT) AS b, round(value, 6) AS value FROM plong
UNION ALL SELECT 'store', user_id, book_id, round(total, 6) FROM store
UNION ALL SELECT 'popularity', book_id, CAST(0 AS BIGINT), CAST(cnt AS DOUBLE) FROM pop""", "plong", "store", "pop"))
def q_artifact_roundtrip(c):
    """A5: save the content model's tables, load them back; profiles, store and popularity as (kind, a, b, value)."""
    store, items, profiles, seen = c.content
    base = scratch_path(c.spark, f"models-{uuid.uuid4().hex[:8]}")
    TR.save_models(c.spark, base, {"store": store, "profiles": profiles, "popularity": popularity(c.interactions)}, {"alpha": 0.4})
    t = TR.load_models(c.spark, base).tables
    return (profiles_long(t["profiles"]).select(F.lit("profile").alias("kind"), F.col("user_id").alias("a"), F.col("pos").alias("b"), "value")
            .unionByName(t["store"].select(F.lit("store").alias("kind"), F.col("user_id").alias("a"), F.col("book_id").alias("b"),
                                           F.col("total").alias("value")))
            .unionByName(t["popularity"].select(F.lit("popularity").alias("kind"), F.col("book_id").alias("a"), F.lit(0).cast("bigint").alias("b"),
                                                F.col("cnt").cast("double").alias("value"))))


@register("train_job")
def q_train_job(c):
    """Split, train (content, ALS, popularity, ratings), save, evaluate - the metric table."""
    base = scratch_path(c.spark, f"train-{uuid.uuid4().hex[:8]}")
    return TR.train_job(c.spark, c.books, c.interactions, c.src.item_embeddings, base)


@register("train_latent_job")
def q_train_latent_job(c):
    """L9 for the latent model: split, train, save, evaluate at 5 and 10 with coverage."""
    base = scratch_path(c.spark, f"train-{uuid.uuid4().hex[:8]}")
    return TR.train_latent_job(c.spark, c.books, c.interactions, c.src.item_embeddings, base)


@register("latent_model_info")
def q_latent_model_info(c):
    """D17 for the latent model: sizes, parameters and last metrics of the saved version."""
    base = scratch_path(c.spark, f"train-{uuid.uuid4().hex[:8]}")
    TR.train_latent_job(c.spark, c.books, c.interactions, c.src.item_embeddings, base)
    return TR.model_report(c.spark, base)


@register("sample_recommendations")
def q_sample_recommendations(c):
    """Hybrid recommendations with titles for the first 3 test users of the temporal split, trained on its train part."""
    split = E.temporal_split(c.interactions, 0.2)
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    store, items, profiles, seen = fit_content(train, c.src.item_embeddings, c.live)
    users = E.sample_users(test, 3)
    recs = H.hybrid_recommend(users, CF.als_candidates(CF.als_train(train), seen, 15, users),
                              H.content_candidates(profiles.join(users, "user_id", "left_semi"), items, seen, 15),
                              popularity(train), seen, 5, H.ALS)
    return E.rec_titles(recs, c.books)
