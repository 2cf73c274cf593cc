"""Hybrid recommendation: blend collaborative and content candidates per user, else popularity.

Two variants share one plan:

* ``"als"`` - 3 x limit candidates per source; when both lists exist, each is
  min-max scaled inside the user's list and blended with alpha (default 0.4);
  a lone source keeps its raw scores.
* ``"latent"`` - 2 x limit candidates; whenever either list exists both are
  min-max scaled and blended (alpha default 0.6); a missing side counts 0.

Users with no candidate at all get the k most popular unseen books.
Output: (user_id, rank, book_id, score, cf, content, pop, path).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.operators.blockscore import exact_topk
from shelfwise.operators.popularity import unseen_popular
from shelfwise.operators.ranking import minmax_per_key, topk_per_key
from shelfwise.session import ensure_checkpoint_dir

HYBRID_COLUMNS = ["user_id", "rank", "book_id", "score", "cf", "content", "pop", "path"]


@dataclass(frozen=True)
class Variant:
    alpha: float
    factor: int            # candidates per source = factor * limit
    blend_lone: bool       # min-max + weight a single available source


ALS = Variant(alpha=0.4, factor=3, blend_lone=False)
LATENT = Variant(alpha=0.6, factor=2, blend_lone=True)


def standin_cf_score(u, b):
    """Deterministic CF score used where no trained model is wanted (exact tests)."""
    return ((u * 31 + b * 17) % 101) / 101.0


def standin_cf_candidates(interactions: DataFrame, seen: DataFrame, m: int) -> DataFrame:
    """Top-m unseen CF-universe books per CF user under ``standin_cf_score``.

    CF users / items are the ones present in the training log, as for ALS.
    """
    users = interactions.select("user_id").distinct()
    items = interactions.select("book_id").distinct()
    return exact_topk(users, "user_id", None, items, "book_id", None, m, exclude=seen.select("user_id", "book_id"),
                      score_fn=standin_cf_score, out=("user_id", "rank", "book_id", "cf")).drop("rank")


def blend(cf: DataFrame, content: DataFrame, variant: Variant, alpha: float | None = None) -> DataFrame:
    """E2 + C3: min-max each user's lists, full outer join, per-user path and score.

    ``cf`` is (user_id, book_id, cf), ``content`` is (user_id, book_id, content).
    Returns (user_id, book_id, score, cf, content, pop, path) before the cut.
    """
    a = variant.alpha if alpha is None else alpha
    null = F.lit(None).cast("double")
    cfn = minmax_per_key(cf, "user_id", "cf", "cf_n").select(
        "user_id", "book_id", "cf", "cf_n", null.alias("content"), null.alias("ct_n"))
    ctn = minmax_per_key(content, "user_id", "content", "ct_n").select(
        "user_id", "book_id", null.alias("cf"), null.alias("cf_n"), "content", "ct_n")
    # The full outer join on (user, book), written as union + group-by: both
    # inputs are already partitioned by user (their windows), which the
    # aggregate and every later per-user window can reuse without a shuffle.
    j = (cfn.unionByName(ctn).groupBy("user_id", "book_id")
         .agg(*[F.max(c).alias(c) for c in ("cf", "cf_n", "content", "ct_n")]))
    w = Window.partitionBy("user_id")
    has_cf = F.max(F.col("cf").isNotNull().cast("int")).over(w) > 0
    has_ct = F.max(F.col("content").isNotNull().cast("int")).over(w) > 0
    j = j.withColumn("_hcf", has_cf).withColumn("_hct", has_ct)
    mixed = F.lit(a) * F.coalesce("cf_n", F.lit(0.0)) + (F.lit(1.0) - F.lit(a)) * F.coalesce("ct_n", F.lit(0.0))
    both = F.col("_hcf") & F.col("_hct")
    if variant.blend_lone:
        path = F.when(both, "blend").when(F.col("_hcf"), "cf").otherwise("content")
        score, r_cf, r_ct = mixed, F.coalesce("cf_n", F.lit(0.0)), F.coalesce("ct_n", F.lit(0.0))
    else:
        path = F.when(both, "blend").when(F.col("_hcf"), "cf").otherwise("content")
        score = F.when(both, mixed).when(F.col("_hcf"), F.col("cf")).otherwise(F.col("content"))
        r_cf = F.when(both, F.coalesce("cf_n", F.lit(0.0))).when(F.col("_hcf"), F.col("cf")).otherwise(F.lit(0.0))
        r_ct = F.when(both, F.coalesce("ct_n", F.lit(0.0))).when(F.col("_hcf"), F.lit(0.0)).otherwise(F.col("content"))
    return j.select("user_id", "book_id", score.alias("score"), r_cf.alias("cf"), r_ct.alias("content"),
                    F.lit(0.0).alias("pop"), path.alias("path"))


def hybrid_recommend(requests: DataFrame, cf_candidates: DataFrame, content_candidates: DataFrame,
                     pop: DataFrame, seen: DataFrame, limit: int = 10, variant: Variant = ALS,
                     alpha: float | None = None) -> DataFrame:
    """L1a / L1b for every requested user at once.

    ``cf_candidates`` / ``content_candidates`` are each user's top
    ``variant.factor * limit`` unseen books, (user_id, book_id, cf|content).
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    blended = blend(cf_candidates, content_candidates, variant, alpha)
    users = requests.select("user_id").distinct()
    # The blended lists (limit rows per user) are kept, so both scorers run once
    # and popularity lists are made for the users without one only.
    ensure_checkpoint_dir(requests.sparkSession)
    ranked = topk_per_key(blended.join(users, "user_id", "left_semi"), "user_id",
                          [F.col("score").desc(), F.col("book_id").asc()], limit).checkpoint(eager=True)
    cold = users.join(ranked.select("user_id").distinct(), "user_id", "left_anti")
    popular = unseen_popular(cold, pop, seen, limit).select(
        "user_id", "rank", "book_id", "score", F.lit(0.0).alias("cf"), F.lit(0.0).alias("content"),
        F.col("score").alias("pop"), F.lit("popularity").alias("path"))
    return ranked.select(*HYBRID_COLUMNS).unionByName(popular.select(*HYBRID_COLUMNS))


def content_candidates(profiles: DataFrame, items: DataFrame, seen: DataFrame, m: int) -> DataFrame:
    """Top-m unseen books per user by profile . item, as (user_id, book_id, content)."""
    from shelfwise.operators.content import content_recommend
    return content_recommend(profiles, items, seen, m).select("user_id", "book_id", F.col("score").alias("content"))


__all__ = ["ALS", "LATENT", "Variant", "blend", "hybrid_recommend", "standin_cf_candidates",
           "content_candidates", "standin_cf_score"]
