"""Collaborative filtering with Spark ML ALS (implicit feedback) and exact top-k from its factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blockscore import exact_topk
from shelfwise.operators.interactions import agg_strength
from shelfwise.operators.ranking import dense_id_map
from shelfwise.session import disk_freed, ensure_checkpoint_dir

# ALS defaults of the implicit recommender.
ALS_FACTORS = 64
ALS_ITERATIONS = 30
ALS_REGULARIZATION = 0.01
ALS_SEED = 42
# An iteration ships each user's factors to every block of items: a checkpoint lets its shuffle files go.
CHECKPOINT_ITERATIONS = 1


def defaults() -> dict[str, float]:
    """The hyper-parameters of ``als_train`` as metadata."""
    return {"als_factors": ALS_FACTORS, "als_iterations": ALS_ITERATIONS, "als_regularization": ALS_REGULARIZATION}


@dataclass
class CFModel:
    """Factors by the log's own ids: (user_id, features) and (book_id, features), as the fit or a table gives them."""
    users: DataFrame
    items: DataFrame

    def user_factors(self) -> DataFrame:
        return _double(self.users)

    def item_factors(self) -> DataFrame:
        return _double(self.items)


def _double(factors: DataFrame) -> DataFrame:
    return factors.withColumn("features", F.col("features").cast("array<double>"))


def _factors(factors: DataFrame, ids: DataFrame, index: str, name: str) -> DataFrame:
    """Kept in single precision, as fitted, and apart from the fit, whose blocks can go."""
    return factors.withColumnRenamed("id", index).join(ids, index).select(name, "features").checkpoint(eager=True)


def als_train(interactions: DataFrame, rank: int = ALS_FACTORS, max_iter: int = ALS_ITERATIONS,
              reg: float = ALS_REGULARIZATION, seed: int = ALS_SEED, implicit: bool = True,
              alpha: float = 1.0) -> CFModel:
    """ALS on the summed strength per (user, book); zero sums are not observations.

    Spark ALS needs 32-bit ids, so users and items are re-indexed by E4 first.
    Each iteration is checkpointed to the shared checkpoint folder.
    """
    spark = interactions.sparkSession
    ensure_checkpoint_dir(spark)
    with disk_freed(spark):
        return _fit(interactions, rank, max_iter, reg, seed, implicit, alpha)


def _fit(interactions: DataFrame, rank: int, max_iter: int, reg: float, seed: int, implicit: bool, alpha: float) -> CFModel:
    # Read by both id maps and by the fit: computed once.
    m = agg_strength(interactions).where(F.col("strength") != 0).checkpoint(eager=True)
    users = dense_id_map(m.select("user_id"), "user_id", "uidx").withColumn("uidx", F.col("uidx").cast("int"))
    items = dense_id_map(m.select("book_id"), "book_id", "iidx").withColumn("iidx", F.col("iidx").cast("int"))
    data = m.join(users, "user_id").join(items, "book_id")
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, implicitPrefs=implicit, alpha=alpha, seed=seed,
              userCol="uidx", itemCol="iidx", ratingCol="strength", nonnegative=False,
              coldStartStrategy="drop", checkpointInterval=CHECKPOINT_ITERATIONS)
    model = als.fit(data)
    return CFModel(_factors(model.userFactors, users, "uidx", "user_id"), _factors(model.itemFactors, items, "iidx", "book_id"))


def als_recommend(model: CFModel, seen: DataFrame, k: int = 10, users: DataFrame | None = None) -> DataFrame:
    """Top-k CF-universe books per known user, seen books removed before the cut.

    At most ``items - seen`` books come back (the safe-n rule). Scoring is the
    blocked exact scorer over the factor tables, not a user x item cross join.
    """
    uf = model.user_factors()
    if users is not None:
        uf = uf.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return exact_topk(uf, "user_id", "features", model.item_factors(), "book_id", "features", k,
                      exclude=seen.select("user_id", "book_id"), out=("user_id", "rank", "book_id", "score"))


def als_candidates(model: CFModel, seen: DataFrame, m: int, users: DataFrame | None = None) -> DataFrame:
    """(user_id, book_id, cf) candidates for the hybrid."""
    return als_recommend(model, seen, m, users).select("user_id", "book_id", F.col("score").alias("cf"))
