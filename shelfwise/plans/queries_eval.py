"""Registered queries: splits, folds and offline metrics of the hybrid recommender."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import evaluation as E
from shelfwise.operators import hybrid as H
from shelfwise.operators import popularity as P
from shelfwise.operators.content import fit_content
from shelfwise.plans.oracle import BLOCKS, sql
from shelfwise.plans.queries_reco import hybrid_blocks
from shelfwise.plans.registry import register

_MD5 = ("md5(concat_ws('|', '42', coalesce(CAST(user_id AS VARCHAR), ''), coalesce(CAST(book_id AS VARCHAR), ''), "
        "coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ''), coalesce(type, '')))")
_CUT = "CAST(floor((SELECT count(*) FROM inter_all) * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)"

SPLIT_BLOCKS = {
    "inter_all": BLOCKS["inter"],
    "tsplit": (f"""
SELECT *, CASE WHEN row_number() OVER (ORDER BY ts ASC NULLS LAST, user_id, book_id, type, strength) <= {_CUT}
               THEN 'train' ELSE 'test' END AS split FROM inter_all""", ("inter_all",)),
    "inter": ("SELECT user_id, book_id, ts, strength, type FROM tsplit WHERE split = 'train'", ("tsplit",)),
    "test": ("SELECT user_id, book_id, ts, strength, type FROM tsplit WHERE split = 'test'", ("tsplit",)),
    "requests": ("SELECT DISTINCT user_id FROM test", ("test",)),
    "truth": ("SELECT DISTINCT user_id, book_id FROM test WHERE book_id IS NOT NULL", ("test",)),
}


def _eval_blocks(k: int = 10) -> dict:
    b = dict(SPLIT_BLOCKS)
    b.update(hybrid_blocks(30, 0.4, False, k))
    b.update({
        "known": ("SELECT user_id FROM cfu UNION SELECT user_id FROM prof", ("cfu", "prof")),
        "status": ("""
SELECT u.user_id, CASE WHEN u.user_id NOT IN (SELECT user_id FROM known) THEN 'cold_start'
                       WHEN u.user_id NOT IN (SELECT user_id FROM hyb) THEN 'no_recs' ELSE 'evaluated' END AS status
FROM (SELECT DISTINCT user_id FROM truth) u""", ("truth", "known", "hyb")),
        "rj": (f"""
SELECT h.user_id, h.rk, CASE WHEN t.book_id IS NULL THEN 0 ELSE 1 END AS hit
FROM hyb h LEFT JOIN truth t ON t.user_id = h.user_id AND t.book_id = h.book_id
WHERE h.rk <= {k} AND h.user_id IN (SELECT user_id FROM status WHERE status = 'evaluated')""",
               ("hyb", "truth", "status")),
        "rm": ("SELECT *, sum(hit) OVER (PARTITION BY user_id) AS m FROM rj", ("rj",)),
        "pu": ("""
SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(max(m) AS DOUBLE) AS m,
       CAST(sum(CASE WHEN rk <= m AND hit = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS h,
       sum(CASE WHEN rk <= m THEN 1 / log2(rk + 1) ELSE 0 END) AS d_in,
       sum(CASE WHEN rk > m THEN 1 / log2(rk + 1) ELSE 0 END) AS d_out,
       sum(CASE WHEN hit = 1 THEN 1 / log2(rk + 1) ELSE 0 END) AS dcg
FROM rm GROUP BY user_id""", ("rm",)),
        "idc": (f"""
SELECT t.user_id, sum(1 / log2(g.r + 1)) AS idcg
FROM (SELECT user_id, count(*) AS n_true FROM truth GROUP BY user_id) t, range(1, {k + 1}) g(r)
WHERE g.r <= least(t.n_true, {k}) GROUP BY t.user_id""", ("truth",)),
        "metrics": (f"""
SELECT 'hit_rate' AS metric, CAST({k} AS BIGINT) AS k, coalesce(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 0) AS value FROM pu
UNION ALL
SELECT 'ndcg_ref', {k}, coalesce(avg(CASE WHEN m = 0 THEN 0 WHEN n = m THEN 1
                                          ELSE h / m + (m - h) / (n - m) * d_out / d_in END), 0) FROM pu
UNION ALL
SELECT 'ndcg_std', {k}, coalesce(avg(dcg / idcg), 0) FROM pu JOIN idc USING (user_id)
UNION ALL
SELECT 'users_evaluated', {k}, CAST(count(*) FILTER (WHERE status = 'evaluated') AS DOUBLE) FROM status
UNION ALL
SELECT 'users_skipped', {k}, CAST(count(*) FILTER (WHERE status <> 'evaluated') AS DOUBLE) FROM status""",
                    ("pu", "idc", "status")),
    })
    return b


def _metric_sql(names) -> str:
    lst = ", ".join(f"'{n}'" for n in names)
    return sql(f"SELECT metric, k, round(value, 6) AS value FROM metrics WHERE metric IN ({lst})",
               extra=_eval_blocks())


class _Split:
    """Temporal split of the whole log and the hybrid trained on its train part."""

    def __init__(self, c):
        self.c = c
        inter = c.interactions
        self.split = c.memo("tsplit", lambda: E.temporal_split(inter, 0.2))
        self.train = self.split.where(F.col("split") == "train").drop("split")
        self.test = self.split.where(F.col("split") == "test").drop("split")

    def model(self):
        def build():
            store, items, profiles, seen = fit_content(self.train, self.c.src.item_embeddings, self.c.live)
            cf = H.standin_cf_candidates(self.train, seen, 30)
            ct = H.content_candidates(profiles, items, seen, 30)
            users = self.test.select("user_id").distinct()
            # The recommendation table is a result: materialise it once, then
            # every metric reads it instead of re-running both scorers.
            recs = H.hybrid_recommend(users, cf, ct, P.popularity(self.train), seen, 10, H.ALS) \
                .checkpoint(eager=True)
            known = self.train.select("user_id").unionByName(profiles.select("user_id")).distinct()
            return recs, known
        return self.c.memo("eval_model", build)


def _split(c) -> _Split:
    return c.memo("split_obj", lambda: _Split(c))


def _metrics(c):
    s = _split(c)
    recs, known = s.model()
    return c.memo("metrics", lambda: E.ranking_metrics(recs, E.ground_truth(s.test), known, 10))


@register("temporal_split", sql("SELECT user_id, book_id, ts, type, strength, split FROM tsplit", extra=SPLIT_BLOCKS))
def q_temporal_split(c):
    """Oldest 80 % of the log is train, the newest 20 % test."""
    return _split(c).split.select("user_id", "book_id", "ts", "type", "strength", "split")


@register("random_split", sql(f"""
SELECT user_id, book_id, ts, type, strength,
       CASE WHEN row_number() OVER (ORDER BY {_MD5}, strength) <= {_CUT} THEN 'train' ELSE 'test' END AS split
FROM inter_all""", extra={"inter_all": BLOCKS["inter"]}))
def q_random_split(c):
    """Seeded hash shuffle, then the same 80/20 cut."""
    return E.random_split(c.interactions, 0.2, 42).select("user_id", "book_id", "ts", "type", "strength", "split")


@register("fold_assign", sql(f"""
SELECT user_id, book_id, ts, type, strength,
       CAST(CAST(('0x' || substr({_MD5}, 1, 8)) AS BIGINT) % 5 AS INTEGER) AS fold FROM inter_all""",
                             extra={"inter_all": BLOCKS["inter"]}))
def q_fold_assign(c):
    """5 folds by a seeded row hash."""
    return E.fold_assign(c.interactions, 5, 42).select("user_id", "book_id", "ts", "type", "strength", "fold")


@register("ground_truth", sql("SELECT user_id, book_id FROM truth", extra=SPLIT_BLOCKS))
def q_ground_truth(c):
    """Each test user's held-out books."""
    return E.ground_truth(_split(c).test)


@register("eval_hit_rate", _metric_sql(["hit_rate"]))
def q_eval_hit_rate(c):
    """HR@10 of the hybrid trained on the temporal train split."""
    return _metrics(c).where(F.col("metric") == "hit_rate")


@register("eval_ndcg", _metric_sql(["ndcg_ref", "ndcg_std"]))
def q_eval_ndcg(c):
    """NDCG@10, reference and standard forms."""
    return _metrics(c).where(F.col("metric").isin("ndcg_ref", "ndcg_std"))


@register("eval_users", _metric_sql(["users_evaluated", "users_skipped"]))
def q_eval_users(c):
    """Users evaluated / skipped (cold start or no recommendation)."""
    return _metrics(c).where(F.col("metric").isin("users_evaluated", "users_skipped"))


@register("evaluate_recommender", _metric_sql(["hit_rate", "ndcg_ref", "ndcg_std", "users_evaluated",
                                              "users_skipped"]))
def q_evaluate_recommender(c):
    """Split -> train -> recommend for every test user -> HR / NDCG / user counts."""
    return _metrics(c)


@register("eval_pair_hit_rate", sql("""
SELECT 'pair_hit_rate' AS metric, CAST(10 AS BIGINT) AS k,
       round(coalesce(avg(CASE WHEN h.book_id IS NULL THEN 0.0 ELSE 1.0 END), 0), 6) AS value
FROM test t LEFT JOIN (SELECT DISTINCT user_id, book_id FROM hyb WHERE rk <= 10) h
  ON h.user_id = t.user_id AND h.book_id = t.book_id""", extra=_eval_blocks()))
def q_eval_pair_hit_rate(c):
    """Share of held-out rows whose book is in the user's top-10."""
    s = _split(c)
    recs, known = s.model()
    return E.pair_hit_rate(recs, s.test, 10)


@register("eval_mse_rmse", sql("""
SELECT 'mse' AS metric, CAST(0 AS BIGINT) AS k, round(avg(power(p - strength, 2)), 6) AS value FROM pr
UNION ALL SELECT 'rmse', 0, round(sqrt(avg(power(p - strength, 2))), 6) FROM pr""",
                                extra={**SPLIT_BLOCKS, "pr": ("""
SELECT strength, 5 * ((user_id * 31 + book_id * 17) % 101) / CAST(101 AS DOUBLE) AS p FROM test
WHERE user_id IN (SELECT user_id FROM inter) AND book_id IN (SELECT book_id FROM inter)""", ("test", "inter"))}))
def q_eval_mse_rmse(c):
    """MSE / RMSE of 5 x the CF stand-in score against held-out strengths (known pairs)."""
    s = _split(c)
    from shelfwise.operators.interactions import known_pairs
    t = known_pairs(s.test, s.train, s.train)
    pred = F.lit(5) * ((F.col("user_id") * 31 + F.col("book_id") * 17) % 101) / F.lit(101.0)
    return E.mse_rmse(t.withColumn("prediction", pred))


_FULL_HYB = hybrid_blocks(30, 0.4, False, 10)


@register("sample_users", sql("""
SELECT user_id FROM (SELECT user_id, min(ts) AS t FROM inter GROUP BY user_id) f ORDER BY t NULLS LAST, user_id LIMIT 100""", "inter"))
def q_sample_users(c):
    """the first 100 users of the log, by first appearance."""
    return E.sample_users(c.interactions, 100)


@register("catalog_coverage", sql("""
SELECT 'coverage' AS metric, CAST(10 AS BIGINT) AS k,
       round((SELECT count(DISTINCT book_id) FROM hyb WHERE rk <= 10 AND user_id IN (SELECT user_id FROM inter))
             / CAST((SELECT count(DISTINCT book_id) FROM inter) AS DOUBLE), 6) AS value
UNION ALL
SELECT 'coverage_catalog', 10,
       round((SELECT count(DISTINCT book_id) FROM hyb WHERE rk <= 10 AND user_id IN (SELECT user_id FROM inter)
              AND book_id IN (SELECT book_id FROM catalog))
             / CAST((SELECT count(DISTINCT book_id) FROM catalog) AS DOUBLE), 6)""", "catalog", extra=_FULL_HYB))
def q_catalog_coverage(c):
    """Distinct books recommended to every logged user / distinct books in the log."""
    from shelfwise.plans.queries_reco import _cf_cands, _ct_cands
    store, items, profiles, seen = c.content
    recs = H.hybrid_recommend(c.src.requests, _cf_cands(c, 30), _ct_cands(c, 30),
                              P.popularity(c.interactions), seen, 10, H.ALS)
    return E.catalog_coverage(recs, c.interactions, c.books, num_samples=None, k=10)


@register("rec_titles", sql("""
SELECT h.user_id, CAST(h.rk AS BIGINT) AS rank, h.book_id, coalesce(substr(b.title, 1, 50), 'Unknown') AS title
FROM hyb h LEFT JOIN catalog b USING (book_id)""", "catalog", extra=_FULL_HYB))
def q_rec_titles(c):
    """Every customer's hybrid top-10 with titles ('Unknown' when missing)."""
    from shelfwise.plans.queries_reco import _cf_cands, _ct_cands
    store, items, profiles, seen = c.content
    recs = H.hybrid_recommend(c.src.requests, _cf_cands(c, 30), _ct_cands(c, 30),
                              P.popularity(c.interactions), seen, 10, H.ALS)
    return E.rec_titles(recs.select("user_id", "rank", "book_id"), c.books)
