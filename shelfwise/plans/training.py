"""Batch training jobs and model persistence (immutable version folders, published by one rename)."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import evaluation as E
from shelfwise.operators import hybrid as H
from shelfwise.operators.cf import ALS_FACTORS, ALS_ITERATIONS, ALS_REGULARIZATION, CFModel, als_candidates, als_train
from shelfwise.operators.content import content_recommend, fit_content
from shelfwise.operators.diversity import mean_rating_all, project_diversity_columns
from shelfwise.operators.latent import LATENT_DIM, LATENT_ITERATIONS, LATENT_REG, LatentModel, latent_evaluate, latent_recommend, latent_train
from shelfwise.operators.popularity import popularity
from shelfwise.session import ensure_checkpoint_dir


def _path(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of a path in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_models(spark: SparkSession, base: str, tables: dict[str, DataFrame], metadata: dict, version: str | None = None) -> str:
    """A5: write every table (Parquet) and the metadata, then publish them as ``base/v=<version>``.

    The folder is written under another name and renamed once it is whole, so a
    reader sees all of a version or nothing of it. Versions are never rewritten;
    the newest is the one with the greatest name (UTC time and a random part).
    """
    version = version or f"{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{time.time_ns() % 10 ** 9:09d}-{uuid.uuid4().hex[:6]}"
    draft, path = f"{base}/.draft-{uuid.uuid4().hex}", f"{base}/v={version}"
    for name, df in tables.items():
        df.write.parquet(f"{draft}/{name}")
    meta = {"tables": sorted(tables), "params": metadata}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "metadata string").write.parquet(f"{draft}/metadata")
    store, target = _path(spark, path)
    if store.exists(target) or not store.rename(_path(spark, draft)[1], target):
        raise FileExistsError(f"version {version} can't be published in {base}")
    return path


@dataclass
class SavedModel:
    """A published version: its tables and parameters."""
    tables: dict[str, DataFrame]
    metadata: dict

    def cf(self) -> CFModel | None:
        t = self.tables
        return CFModel(t["user_factors"], t["item_factors"]) if "user_factors" in t else None

    def latent(self) -> LatentModel | None:
        p = self.metadata
        if "latent_coef" not in p:
            return None
        return LatentModel(self.cf(), p["latent_coef"], p["latent_intercept"], self.tables["seen"].select("user_id", "book_id"))

    def recommend(self, users: DataFrame, k: int = 10) -> DataFrame:
        """Hybrid recommendations for users, by the saved tables alone."""
        t = self.tables
        variant = H.LATENT if "latent_coef" in self.metadata else H.ALS
        m = variant.factor * k
        if variant is H.LATENT:
            cf = latent_recommend(self.latent(), m, users=users).select("user_id", "book_id", F.col("score").alias("cf"))
        else:
            cf = als_candidates(self.cf(), t["seen"], m, users)
        own = t["profiles"].join(users.select("user_id").distinct(), "user_id", "left_semi")
        content = (content_recommend(own, t["item_vectors"], t["seen"], m)
                   .select("user_id", "book_id", F.col("score").alias("content")))
        return H.hybrid_recommend(users, cf, content, t["popularity"], t["seen"], k, variant, self.metadata.get("alpha"))


def versions(spark: SparkSession, base: str) -> list[str]:
    """Published versions, oldest first."""
    store, path = _path(spark, base)
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(n[2:] for n in names if n.startswith("v="))


def load_models(spark: SparkSession, base: str, version: str | None = None) -> SavedModel:
    """A5: a published version, by default the newest. A missing or broken table raises."""
    if version is None:
        found = versions(spark, base)
        if not found:
            raise FileNotFoundError(f"no model version in {base}")
        version = found[-1]
    path = f"{base}/v={version}"
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["metadata"])
    return SavedModel({name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta["params"])


def save_metrics(spark: SparkSession, base: str, version: str, metrics: DataFrame) -> DataFrame:
    """The metric table of a version, kept beside it."""
    path = f"{base}/metrics/v={version}"
    metrics.write.mode("overwrite").parquet(path)
    return spark.read.schema(metrics.schema).parquet(path)


def model_report(spark: SparkSession, base: str, version: str | None = None) -> DataFrame:
    """A version's table sizes, parameters and last metrics as (kind, name, value) rows."""
    version = version or versions(spark, base)[-1]
    saved = load_models(spark, base, version)
    rows = [("rows", name, float(df.count())) for name, df in saved.tables.items()]
    rows += [("parameter", k, float(v)) for k, v in saved.metadata.items() if isinstance(v, (int, float))]
    out = spark.createDataFrame(rows, "kind string, name string, value double")
    store, path = _path(spark, f"{base}/metrics/v={version}")
    if not store.exists(path):
        return out
    m = spark.read.parquet(f"{base}/metrics/v={version}")
    return out.unionByName(m.select(F.lit("metric").alias("kind"), F.col("metric").alias("name"), "value"))


def _split(interactions: DataFrame, evaluate: bool):
    """(train, test or None)"""
    if not evaluate:
        return interactions, None
    split = E.temporal_split(interactions, 0.2)
    return tuple(split.where(F.col("split") == s).drop("split") for s in ("train", "test"))


def _tables(train: DataFrame, books: DataFrame, item_embeddings: DataFrame) -> dict[str, DataFrame]:
    store, items, profiles, seen = fit_content(train, item_embeddings, books)
    return {"store": store, "item_vectors": items, "profiles": profiles, "seen": seen, "popularity": popularity(train),
            "rating_map": mean_rating_all(train), "books": project_diversity_columns(books)}


def train_job(spark: SparkSession, books: DataFrame, interactions: DataFrame, item_embeddings: DataFrame,
              out_base: str, evaluate: bool = True, k: int = 10, alpha: float = 0.4,
              rank: int = ALS_FACTORS, max_iter: int = ALS_ITERATIONS, reg: float = ALS_REGULARIZATION,
              coverage_users: int | None = None) -> DataFrame:
    """Load -> (split) -> train content, ALS, popularity, ratings -> save -> (evaluate what was saved).

    Returns the metric table (empty without ``evaluate``). Lists are made for the
    test users and for the users that coverage is measured on: all of the
    training log, or its first ``coverage_users``. Retraining is the same call on
    a fresh log.
    """
    ensure_checkpoint_dir(spark)
    train, test = _split(interactions, evaluate)
    cf = als_train(train, rank=rank, max_iter=max_iter, reg=reg)
    tables = _tables(train, books, item_embeddings) | {"user_factors": cf.user_factors(), "item_factors": cf.item_factors()}
    path = save_models(spark, out_base, tables, {"alpha": alpha, "als_factors": rank, "als_iterations": max_iter, "als_regularization": reg})
    if test is None:
        return spark.createDataFrame([], "metric string, k bigint, value double")
    version = path.rsplit("v=", 1)[1]
    saved = load_models(spark, out_base, version)
    sampled = E.sample_users(train, coverage_users)
    recs = saved.recommend(test.select("user_id").union(sampled).distinct(), k).checkpoint(eager=True)
    known = train.select("user_id").unionByName(saved.tables["profiles"].select("user_id")).distinct()
    return save_metrics(spark, out_base, version, E.ranking_metrics(recs, E.ground_truth(test), known, k).unionByName(
        E.catalog_coverage(recs, train, books, k=k, users=sampled)))


def train_latent_job(spark: SparkSession, books: DataFrame, interactions: DataFrame, item_embeddings: DataFrame,
                     out_base: str, evaluate: bool = True, ks: tuple[int, ...] = (5, 10), alpha: float = 0.6,
                     rank: int = LATENT_DIM, max_iter: int = LATENT_ITERATIONS, reg: float = LATENT_REG) -> DataFrame:
    """L9 for the latent model: as ``train_job``, evaluated at each k with coverage."""
    ensure_checkpoint_dir(spark)
    train, test = _split(interactions, evaluate)
    model = latent_train(train, rank=rank, max_iter=max_iter, reg=reg)
    tables = _tables(train, books, item_embeddings) | {"user_factors": model.cf.user_factors(), "item_factors": model.cf.item_factors()}
    path = save_models(spark, out_base, tables, {"alpha": alpha, "latent_dim": rank, "latent_iterations": max_iter, "latent_reg": reg,
                                                 "latent_coef": model.coef, "latent_intercept": model.intercept})
    if test is None:
        return spark.createDataFrame([], "metric string, k bigint, value double")
    version = path.rsplit("v=", 1)[1]
    return save_metrics(spark, out_base, version, latent_evaluate(load_models(spark, out_base, version).latent(), test, ks))
