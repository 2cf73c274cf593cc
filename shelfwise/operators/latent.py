"""Second collaborative family: latent factors with a learned interaction head.

Explicit ALS (squared loss on summed strength) gives user/item factors p, q.
A regression head on [p*q, p, q] (the generalised-matrix-factorisation branch
plus linear user and item terms) is fitted on the observed pairs. Its score
is again a dot product of augmented vectors

    s(u, i) = <h * p_u, q_i> + <a, p_u> + <b, q_i> + c
            = <[h * p_u, <a, p_u> + c, 1], [q_i, 1, <b, q_i>]>

so every item can be scored for every user with the blocked exact scorer and
no user x item row ever exists.

The head is solved from sums over the pairs (X'X, X'y, y'y), which one pass
gives for any weight decay; the squared error on held-out pairs follows from
their sums in the same way. So cross-validation and grid search fit ALS once for
each fold and setting that ALS sees, and a decay costs a small solve.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blockscore import exact_topk
from shelfwise.operators.cf import CFModel, als_train
from shelfwise.operators.evaluation import catalog_coverage, fold_assign, mse_rmse, pair_hit_rate
from shelfwise.operators.interactions import agg_strength, known_pairs, seen_pairs
from shelfwise.operators.paircells import blocks, pair_cells, scored
from shelfwise.session import disk_freed, ensure_checkpoint_dir

# Defaults of the latent recommender.
LATENT_DIM = 64
LATENT_ITERATIONS = 20
LATENT_REG = 1e-5


@dataclass
class LatentModel:
    cf: CFModel
    coef: list[float]
    intercept: float
    training: DataFrame     # (user_id, book_id) pairs seen in training

    def _parts(self):
        r = len(self.coef) // 3
        return self.coef[:r], self.coef[r:2 * r], self.coef[2 * r:]

    def user_vectors(self) -> DataFrame:
        h, a, _ = self._parts()
        p = F.col("features")
        lin = F.aggregate(F.zip_with(p, F.array(*[F.lit(x) for x in a]), lambda x, y: x * y), F.lit(0.0),
                          lambda s, x: s + x) + F.lit(self.intercept)
        hp = F.zip_with(p, F.array(*[F.lit(x) for x in h]), lambda x, y: x * y)
        return self.cf.user_factors().select("user_id", F.concat(hp, F.array(lin, F.lit(1.0))).alias("vec"))

    def item_vectors(self) -> DataFrame:
        _, _, b = self._parts()
        q = F.col("features")
        lin = F.aggregate(F.zip_with(q, F.array(*[F.lit(x) for x in b]), lambda x, y: x * y), F.lit(0.0),
                          lambda s, x: s + x)
        return self.cf.item_factors().select("book_id", F.concat(q, F.array(F.lit(1.0), lin)).alias("vec"))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """I7 on given pairs: (…, prediction); pairs with an unknown user or item are dropped."""
        h, a, b = (np.array(x) for x in self._parts())
        constant = self.intercept
        names = ["book_id", "user_id", *(c for c in pairs.columns if c not in ("book_id", "user_id"))]
        return scored(pairs.select(*names), self.cf, lambda p, q: (p * q) @ h + p @ a + q @ b + constant)


@dataclass(frozen=True)
class HeadSums:
    """Sums over pairs with rows x = [p*q, p, q, 1] and targets y: X'X, X'y and y'y."""
    xx: np.ndarray
    xy: np.ndarray
    yy: float

    @property
    def n(self) -> int:
        return int(round(self.xx[-1, -1])) if self.xx.size else 0

    def solve(self, reg: float) -> tuple[list[float], float]:
        """(coefficients, intercept) of least squares with decay ``reg`` on coefficients of standardised features and targets.

        The decay is divided by the targets' deviation, as Spark ML's linear
        regression does; a feature without variance gets 0.
        """
        if not self.n:
            raise ValueError("no observed pair to train on")
        mean, ybar = self.xx[-1, :-1] / self.n, self.xy[-1] / self.n
        cov = self.xx[:-1, :-1] / self.n - np.outer(mean, mean)
        sd, ysd = np.sqrt(np.maximum(np.diag(cov), 0)), math.sqrt(max(self.yy / self.n - ybar * ybar, 0))
        use = np.flatnonzero(sd > 1e-12 * (1 + np.abs(mean)))
        coef = np.zeros(len(mean))
        if ysd > 0 and len(use):
            r = cov[np.ix_(use, use)] / np.outer(sd[use], sd[use])
            target = (self.xy[use] / self.n - mean[use] * ybar) / (sd[use] * ysd)
            coef[use] = np.linalg.lstsq(r + reg / ysd * np.eye(len(use)), target, rcond=None)[0] * ysd / sd[use]
        return coef.tolist(), float(ybar - coef @ mean)

    def mse(self, coef: list[float], intercept: float) -> float:
        """Mean squared error of a head over the pairs; NaN without a pair."""
        w = np.array([*coef, intercept])
        return max(float(self.yy - 2 * w @ self.xy + w @ self.xx @ w) / self.n, 0.0) if self.n else math.nan


def head_sums(pairs: DataFrame, cf: CFModel) -> HeadSums:
    """The sums over (user_id, book_id, strength) with factors, in one pass; a partition sends one vector of their fixed size."""
    rows = pair_cells(pairs.select("user_id", "book_id", F.col("strength").cast("double").alias("y")), cf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in blocks(batches):
            y = b.column("y").to_numpy(zero_copy_only=False)
            for at in range(0, len(y), 4096):
                part = slice(at, at + 4096)
                p, q = b.factors(part)
                x = np.concatenate([p * q, p, q, np.ones((len(p), 1)), y[part, None]], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.record_batch([pa.array([total.ravel().tolist()])], names=["v"])

    one = rows.mapInArrow(run, "v array<double>").groupBy(F.lit(0).alias("all")).agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()
    if one is None:
        return HeadSums(np.zeros((0, 0)), np.zeros(0), 0.0)
    all_ = one["v"].toArray()
    all_ = all_.reshape(math.isqrt(len(all_)), -1)
    return HeadSums(all_[:-1, :-1], all_[:-1, -1], float(all_[-1, -1]))


def latent_train(interactions: DataFrame, rank: int = LATENT_DIM, max_iter: int = LATENT_ITERATIONS,
                 reg: float = LATENT_REG, seed: int = 42, als_reg: float = 0.1) -> LatentModel:
    """Explicit ALS factors, then a least-squares head on [p*q, p, q] (weight decay = reg)."""
    cf = als_train(interactions, rank=rank, max_iter=max_iter, reg=als_reg, seed=seed, implicit=False)
    coef, intercept = head_sums(agg_strength(interactions), cf).solve(reg)
    return LatentModel(cf, coef, intercept, seen_pairs(interactions))


def latent_recommend(model: LatentModel, k: int = 10, exclude: DataFrame | None = None,
                     users: DataFrame | None = None) -> DataFrame:
    """I8: top-k per user over all CF items, excluding training pairs ∪ ``exclude`` before the cut."""
    ex = model.training if exclude is None else model.training.unionByName(
        exclude.select("user_id", "book_id")).distinct()
    uv = model.user_vectors()
    if users is not None:
        uv = uv.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return exact_topk(uv, "user_id", "vec", model.item_vectors(), "book_id", "vec", k,
                      exclude=ex.select("user_id", "book_id"), out=("user_id", "rank", "book_id", "score"))


def latent_evaluate(model: LatentModel, test: DataFrame, k: int | tuple[int, ...] = 10) -> DataFrame:
    """MSE / RMSE on known held-out pairs (summed strength), hit rate per held-out row and coverage, at each k.

    Coverage is the share of the training log's books that the test users' lists hold.
    """
    ks = (k,) if isinstance(k, int) else tuple(k)
    ensure_checkpoint_dir(test.sparkSession)
    known = known_pairs(test, model.cf.users, model.cf.items)
    truth = agg_strength(known).checkpoint(eager=True)
    err = mse_rmse(model.predict(truth))
    users = known.select("user_id").distinct()
    recs = latent_recommend(model, max(ks), users=users).checkpoint(eager=True)
    for n in ks:
        err = err.unionByName(pair_hit_rate(recs, known, n).withColumn("metric", F.lit(f"hit_rate@{n}")))
        cover = catalog_coverage(recs, model.training, num_samples=None, k=n, users=users)
        err = err.unionByName(cover.withColumn("metric", F.lit(f"coverage@{n}")))
    return err


@dataclass
class _Fold:
    """One fold's factors, sums and held-out rows: what every weight decay shares."""
    cf: CFModel
    train: DataFrame
    test: DataFrame
    sums: HeadSums
    held_out: HeadSums

    def model(self, reg: float) -> LatentModel:
        coef, intercept = self.sums.solve(reg)
        return LatentModel(self.cf, coef, intercept, seen_pairs(self.train))


def _folds(interactions: DataFrame, n_splits: int, seed: int, rank: int = LATENT_DIM, max_iter: int = LATENT_ITERATIONS, als_reg: float = 0.1):
    """One ALS fit for each fold."""
    folds = fold_assign(interactions, n_splits, seed)
    for f in range(n_splits):
        train, test = folds.where(F.col("fold") != f).drop("fold"), folds.where(F.col("fold") == f).drop("fold")
        cf = als_train(train, rank=rank, max_iter=max_iter, reg=als_reg, seed=seed + f, implicit=False)
        fold = _Fold(cf, train, test, head_sums(agg_strength(train), cf), head_sums(agg_strength(test), cf))
        del cf
        yield f, fold
        del fold


def cross_validate(interactions: DataFrame, n_splits: int = 5, seed: int = 42, k: int = 10, reg: float = LATENT_REG, **params) -> DataFrame:
    """K folds by row hash; per fold train on the rest, evaluate on the fold."""
    out = None
    with disk_freed(interactions.sparkSession):
        for f, fold in _folds(interactions, n_splits, seed, **params):
            # A few rows: made while the fold's tables are there, which can go then.
            m = latent_evaluate(fold.model(reg), fold.test, k).withColumn("fold", F.lit(f)).checkpoint(eager=True)
            out = m if out is None else out.unionByName(m)
            del fold
    return out.select("fold", "metric", "k", "value")


def grid_search(interactions: DataFrame, grid: dict, n_splits: int = 3, metric: str = "rmse",
                seed: int = 42, k: int = 10) -> DataFrame:
    """Cartesian grid; mean CV score (NaN folds skipped); minimise rmse/mse, else maximise.

    ALS is fitted once for each fold and each setting of the parameters that it
    sees; for rmse and mse all values of ``reg`` are judged from the fold's sums.
    The first setting wins ties (strict improvement only). Returns every setting
    with its mean score and ``is_best``.
    """
    if not grid:
        raise ValueError("param grid is empty")
    names = sorted(grid)
    settings = [dict(zip(names, values)) for values in itertools.product(*[grid[n] for n in names])]
    scores: dict[int, list[float]] = {i: [] for i in range(len(settings))}
    outer = lambda p: tuple((n, v) for n, v in p.items() if n != "reg")
    for shared in dict.fromkeys(map(outer, settings)):
        own = [i for i, p in enumerate(settings) if outer(p) == shared]
        for _, fold in _folds(interactions, n_splits, seed, **dict(shared)):
            for i in own:
                model = fold.model(settings[i].get("reg", LATENT_REG))
                if metric in ("rmse", "mse"):
                    value = fold.held_out.mse(model.coef, model.intercept)
                    scores[i].append(math.sqrt(value) if metric == "rmse" else value)
                else:
                    rows = latent_evaluate(model, fold.test, k).where(F.col("metric") == metric).select("value").collect()
                    scores[i] += [r["value"] for r in rows]
    means = []
    for i in range(len(settings)):
        good = [v for v in scores[i] if v is not None and not math.isnan(v)]
        means.append(sum(good) / len(good) if good else math.nan)
    lower, best = metric.startswith(("rmse", "mse")), None
    for i, s in enumerate(means):
        if not math.isnan(s) and (best is None or (s < means[best] if lower else s > means[best])):
            best = i
    data = [(str(sorted(p.items())), float(s), i == best) for i, (p, s) in enumerate(zip(settings, means))]
    return interactions.sparkSession.createDataFrame(data, "params string, avg_score double, is_best boolean")


__all__ = ["HeadSums", "LatentModel", "head_sums", "latent_train", "latent_recommend", "latent_evaluate", "cross_validate",
           "grid_search"]
