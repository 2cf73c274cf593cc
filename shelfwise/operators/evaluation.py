"""Offline evaluation as DataFrame jobs: splits, folds, ranking metrics, coverage, errors.

Metrics come back as long tables (metric, k, value) so several runs union cleanly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.operators.ranking import global_row_number

SPLIT_ORDER = ("user_id", "book_id", "type", "strength")


def _cut(n: int, test_ratio: float) -> int:
    if not 0.0 <= test_ratio <= 1.0:
        raise ValueError("test_ratio must be within [0, 1]")
    return int(n * (1 - test_ratio))


def temporal_split(interactions: DataFrame, test_ratio: float = 0.2, ts_col: str = "ts") -> DataFrame:
    """Oldest ``int(n * (1 - ratio))`` rows are train, the rest test (NULL ts sort last).

    Equal timestamps are ordered by (user_id, book_id, type, strength). Rows are
    counted by day; only the day that the cut falls on is sorted.
    """
    order = [F.col(ts_col).asc_nulls_last()] + [F.col(c).asc() for c in SPLIT_ORDER]
    return _split_at(interactions, test_ratio, F.coalesce(F.to_date(ts_col).cast("string"), F.lit("~")), order)


def _split_at(rows: DataFrame, test_ratio: float, bucket: Column, order: list[Column]) -> DataFrame:
    """``split`` by position in ``order``, whose first key rises with the text ``bucket``.

    One aggregate gives the bucket that the cut falls in (a row for each bucket
    reaches the driver: a day, or a hash prefix of four digits). All other rows
    are told by their bucket; that bucket's rows alone are sorted and numbered.
    """
    counts = {r["b"]: r["n"] for r in rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut, before = _cut(sum(counts.values()), test_ratio), 0
    for b in sorted(counts):
        if before + counts[b] > cut:
            break
        before += counts[b]
    else:
        return rows.withColumn("split", F.lit("train"))
    inside = global_row_number(rows.where(bucket == b), order, "_rn")
    inside = inside.withColumn("split", F.when(F.col("_rn") <= cut - before, "train").otherwise("test")).drop("_rn")
    outside = rows.where(bucket != b).withColumn("split", F.when(bucket < b, "train").otherwise("test"))
    return outside.unionByName(inside)


def hash_key(seed: int, cols=("user_id", "book_id", "ts", "type", "strength")):
    """A row's md5 over the seed and its fields.

    Timestamps enter as their wall-clock text with microseconds, which does not
    depend on the session time zone for TIMESTAMP_NTZ values.
    """
    parts = [F.lit(str(seed))]
    for c in cols:
        x = F.col(c)
        if c == "ts":
            x = F.date_format(F.col(c).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        parts.append(F.coalesce(x.cast("string"), F.lit("")))
    return F.md5(F.concat_ws("|", *parts))


def random_split(interactions: DataFrame, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Shuffle by a seeded row hash, cut at ``int(n * (1 - ratio))`` (exact sizes).

    The hash is over (user_id, book_id, ts, type); rows with one hash are ordered by strength.
    """
    h = hash_key(seed, ("user_id", "book_id", "ts", "type"))
    rows = interactions.withColumn("_h", h)
    return _split_at(rows, test_ratio, F.substring("_h", 1, 4), [F.col("_h").asc(), F.col("strength").asc()]).drop("_h")


def fold_assign(interactions: DataFrame, n_splits: int = 5, seed: int = 42,
                cols=("user_id", "book_id", "ts", "type")) -> DataFrame:
    """fold = first 32 bits of the seeded row hash mod n_splits (no shuffle at all)."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    h = F.conv(F.substring(hash_key(seed, cols), 1, 8), 16, 10).cast("bigint")
    return interactions.withColumn("fold", F.pmod(h, F.lit(n_splits)).cast("int"))


def ground_truth(test: DataFrame) -> DataFrame:
    """Each user's set of held-out books, long form (user_id, book_id)."""
    return test.select("user_id", "book_id").where(F.col("book_id").isNotNull()).distinct()


def _d(r):
    """1 / log2(r + 1): the rank discount."""
    return F.lit(1.0) / F.log2(r.cast("double") + F.lit(1.0))


def per_user_ranking(recs: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per evaluated user: n recs, m hits, hit, ndcg_ref, ndcg_std (recs ranked 1..n <= k).

    ndcg_ref is the reference's form (truth = the sorted hit list, with tied
    scores averaged): h/m + ((m-h)/(n-m)) * D(m+1..n) / D(1..m), where h counts
    hits among the first m places; 1 when n = m; 0 without hits. ndcg_std is
    DCG over the recs divided by the ideal DCG of min(|truth|, k) hits.
    """
    r = recs.where(F.col("rank") <= k).select("user_id", "rank", "book_id")
    t = truth.select("user_id", "book_id", F.lit(1).alias("_hit"))
    j = r.join(t, ["user_id", "book_id"], "left").withColumn("hit", F.coalesce("_hit", F.lit(0)))
    m = F.sum("hit").over(Window.partitionBy("user_id"))
    j = j.withColumn("m", m)
    agg = j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("m").alias("m"),
        F.sum(F.when((F.col("rank") <= F.col("m")) & (F.col("hit") == 1), 1).otherwise(0)).alias("h"),
        F.sum(F.when(F.col("rank") <= F.col("m"), _d(F.col("rank"))).otherwise(0.0)).alias("d_in"),
        F.sum(F.when(F.col("rank") > F.col("m"), _d(F.col("rank"))).otherwise(0.0)).alias("d_out"),
        F.sum(F.when(F.col("hit") == 1, _d(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    n_true = truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_true"))
    agg = agg.join(n_true, "user_id", "left")
    # ideal DCG of min(n_true, k) hits: sum of discounts over ranks 1..min(n_true, k)
    idcg = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_true"), F.lit(k)).cast("int")), F.lit(0.0),
                       lambda acc, x: acc + _d(x))
    ref = (F.when(F.col("m") == 0, F.lit(0.0)).when(F.col("n") == F.col("m"), F.lit(1.0))
           .otherwise(F.col("h") / F.col("m")
                      + (F.col("m") - F.col("h")) / (F.col("n") - F.col("m")) * F.col("d_out") / F.col("d_in")))
    return agg.select("user_id", "n", "m", (F.col("m") > 0).cast("int").alias("hit"),
                      ref.alias("ndcg_ref"), (F.col("dcg") / idcg).alias("ndcg_std"))


def evaluated_users(truth: DataFrame, known_users: DataFrame, recs: DataFrame) -> DataFrame:
    """D13 per test user: status evaluated / cold_start / no_recs."""
    tu = truth.select("user_id").distinct()
    known = known_users.select("user_id").distinct().withColumn("_known", F.lit(True))
    has = recs.select("user_id").distinct().withColumn("_recs", F.lit(True))
    return (tu.join(known, "user_id", "left").join(has, "user_id", "left")
            .select("user_id", F.when(F.col("_known").isNull(), "cold_start")
                    .when(F.col("_recs").isNull(), "no_recs").otherwise("evaluated").alias("status")))


def _metric_rows(row_df: DataFrame, k: int, names) -> DataFrame:
    stack = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    return row_df.selectExpr(f"stack({len(names)}, {stack}) AS (metric, value)").select(
        "metric", F.lit(k).cast("bigint").alias("k"), "value")


def ranking_metrics(recs: DataFrame, truth: DataFrame, known_users: DataFrame, k: int = 10) -> DataFrame:
    """HR@k, NDCG@k (reference and standard), users evaluated / skipped."""
    status = evaluated_users(truth, known_users, recs)
    ev = status.where(F.col("status") == "evaluated").select("user_id")
    per = per_user_ranking(recs.join(ev, "user_id", "left_semi"), truth.join(ev, "user_id", "left_semi"), k)
    row = per.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_rate"),
                  F.coalesce(F.avg("ndcg_ref"), F.lit(0.0)).alias("ndcg_ref"),
                  F.coalesce(F.avg("ndcg_std"), F.lit(0.0)).alias("ndcg_std"))
    counts = status.agg(F.sum((F.col("status") == "evaluated").cast("int")).alias("users_evaluated"),
                        F.sum((F.col("status") != "evaluated").cast("int")).alias("users_skipped"))
    names = ["hit_rate", "ndcg_ref", "ndcg_std"]
    return _metric_rows(row, k, names).unionByName(
        _metric_rows(counts.select(F.coalesce("users_evaluated", F.lit(0)).alias("users_evaluated"),
                                   F.coalesce("users_skipped", F.lit(0)).alias("users_skipped")),
                     k, ["users_evaluated", "users_skipped"]))


def sample_users(interactions: DataFrame, num_samples: int | None) -> DataFrame:
    """users in order of first appearance (min ts, then id); the first ``num_samples``."""
    first = interactions.groupBy("user_id").agg(F.min("ts").alias("_t"))
    if num_samples is None:
        return first.select("user_id")
    return first.orderBy(F.col("_t").asc_nulls_last(), "user_id").limit(num_samples).select("user_id")


def catalog_coverage(recs: DataFrame, interactions: DataFrame, catalogue: DataFrame | None = None,
                     num_samples: int | None = None, k: int = 10, users: DataFrame | None = None) -> DataFrame:
    """Distinct books recommended to the users / distinct books in the log.

    The users are ``users``, or those of the log: all, or the first
    ``num_samples``; ``recs`` should have been made for them. May exceed 1
    (content can recommend never-read books). ``coverage_catalog`` is the share
    of the catalogue that was recommended.
    """
    users = sample_users(interactions, num_samples) if users is None else users.select("user_id").distinct()
    rec_items = recs.where(F.col("rank") <= k).join(users, "user_id", "left_semi").select("book_id").distinct()
    # Two counts, read as scalars (one number each crosses to the driver).
    n_rec = rec_items.count()
    n_log = interactions.select("book_id").distinct().count()
    out = [("coverage", float(n_rec) / n_log if n_log else 0.0)]
    if catalogue is not None:
        n_cat = catalogue.select("book_id").distinct().count()
        hit = rec_items.join(catalogue.select("book_id"), "book_id", "left_semi").count()
        out.append(("coverage_catalog", float(hit) / n_cat if n_cat else 0.0))
    return recs.sparkSession.createDataFrame([(m, k, v) for m, v in out], "metric string, k bigint, value double")


def pair_hit_rate(recs: DataFrame, test_pairs: DataFrame, k: int = 10) -> DataFrame:
    """Share of held-out (user, item) rows whose item is in the user's top-k."""
    r = recs.where(F.col("rank") <= k).select("user_id", "book_id", F.lit(1).alias("_hit"))
    j = test_pairs.select("user_id", "book_id").join(r, ["user_id", "book_id"], "left")
    row = j.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(0.0)).alias("pair_hit_rate"))
    return _metric_rows(row, k, ["pair_hit_rate"])


def safe_number(c):
    """NULL for NaN and +-inf, the value otherwise (for reporting metrics)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None)).otherwise(x)


def safe_metrics(metrics: DataFrame) -> DataFrame:
    """B13 applied to a (metric, k, value) table."""
    return metrics.withColumn("value", safe_number("value"))


def mse_rmse(predictions: DataFrame, label: str = "strength", pred: str = "prediction") -> DataFrame:
    """Sample-weighted MSE and RMSE; NaN when there is no row."""
    row = predictions.agg(F.avg(F.pow(F.col(pred) - F.col(label), 2)).alias("mse"))
    row = row.select(F.coalesce("mse", F.lit(float("nan"))).alias("mse"))
    row = row.withColumn("rmse", F.sqrt("mse"))
    return _metric_rows(row, 0, ["mse", "rmse"])


def rec_titles(recs: DataFrame, books: DataFrame) -> DataFrame:
    """Attach the title (50 characters, 'Unknown' when absent)."""
    t = books.select("book_id", "title")
    return (recs.join(t, "book_id", "left")
            .withColumn("title", F.coalesce(F.substring("title", 1, 50), F.lit("Unknown"))))


def ndcg_discount_sum(a: int, b: int) -> float:
    """D(a..b) on the driver, for tests."""
    return sum(1.0 / math.log2(r + 1) for r in range(a, b + 1))
