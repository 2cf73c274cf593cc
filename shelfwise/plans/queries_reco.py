"""Registered queries: popularity, min-max, blending and the hybrid recommenders."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import hybrid as H
from shelfwise.operators import popularity as P
from shelfwise.operators.ranking import minmax_per_key
from shelfwise.plans.oracle import sql
from shelfwise.plans.registry import register

_UNSEEN = "NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = {u} AND s.book_id = {b})"


def _cands(m: int) -> dict:
    cf = "round(((u.user_id * 31 + i.book_id * 17) % 101) / CAST(101 AS DOUBLE), 12)"
    return {
        "cfu": ("SELECT DISTINCT user_id FROM inter", ("inter",)),
        "cfi": ("SELECT DISTINCT book_id FROM inter", ("inter",)),
        "cfc": (f"""
SELECT user_id, book_id, cf FROM (
  SELECT u.user_id, i.book_id, {cf} AS cf,
         row_number() OVER (PARTITION BY u.user_id ORDER BY {cf} DESC, i.book_id) AS rk
  FROM cfu u, cfi i WHERE {_UNSEEN.format(u='u.user_id', b='i.book_id')}) t WHERE rk <= {m}""",
                ("cfu", "cfi", "seen")),
        "ctc": (f"""
SELECT user_id, book_id, content FROM (
  SELECT p.user_id, e.book_id, round(list_dot_product(p.p, e.e), 12) AS content,
         row_number() OVER (PARTITION BY p.user_id ORDER BY round(list_dot_product(p.p, e.e), 12) DESC, e.book_id) AS rk
  FROM prof p, emb e WHERE {_UNSEEN.format(u='p.user_id', b='e.book_id')}) t WHERE rk <= {m}""",
                ("prof", "emb", "seen")),
    }


def _mm(src: str, col: str, out: str) -> str:
    w = "OVER (PARTITION BY user_id)"
    return (f"SELECT *, CASE WHEN max({col}) {w} = min({col}) {w} THEN CAST(1.0 AS DOUBLE) "
            f"ELSE ({col} - min({col}) {w}) / (max({col}) {w} - min({col}) {w}) END AS {out} FROM {src}")


def _blend_blocks(m: int, alpha: float, lone: bool) -> dict:
    a = f"CAST({alpha!r} AS DOUBLE)"
    mixed = f"{a} * coalesce(cf_n, 0) + (CAST(1.0 AS DOUBLE) - {a}) * coalesce(ct_n, 0)"
    path = "CASE WHEN hcf AND hct THEN 'blend' WHEN hcf THEN 'cf' ELSE 'content' END"
    if lone:
        score, rcf, rct = mixed, "coalesce(cf_n, 0)", "coalesce(ct_n, 0)"
    else:
        score = f"CASE WHEN hcf AND hct THEN {mixed} WHEN hcf THEN cf ELSE content END"
        rcf = "CASE WHEN hcf AND hct THEN coalesce(cf_n, 0) WHEN hcf THEN cf ELSE 0 END"
        rct = "CASE WHEN hcf AND hct THEN coalesce(ct_n, 0) WHEN hcf THEN 0 ELSE content END"
    b = _cands(m)
    b.update({
        "cfn": (_mm("cfc", "cf", "cf_n"), ("cfc",)),
        "ctn": (_mm("ctc", "content", "ct_n"), ("ctc",)),
        "hj": ("""
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.book_id, b.book_id) AS book_id,
       a.cf, a.cf_n, b.content, b.ct_n
FROM cfn a FULL OUTER JOIN ctn b ON a.user_id = b.user_id AND a.book_id = b.book_id""", ("cfn", "ctn")),
        "hf": ("""
SELECT *, max(CASE WHEN cf IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS hcf,
          max(CASE WHEN content IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS hct
FROM hj""", ("hj",)),
        "hs": (f"""
SELECT user_id, book_id, CAST({score} AS DOUBLE) AS score, CAST({rcf} AS DOUBLE) AS cf,
       CAST({rct} AS DOUBLE) AS content, CAST(0.0 AS DOUBLE) AS pop, {path} AS path FROM hf""", ("hf",)),
    })
    return b


def hybrid_blocks(m: int, alpha: float, lone: bool, limit: int = 10) -> dict:
    """Oracle blocks ending in ``hyb`` (user_id, rk, book_id, score, cf, content, pop, path)."""
    b = _blend_blocks(m, alpha, lone)
    b["hr"] = (f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id) AS rk
               FROM hs WHERE user_id IN (SELECT user_id FROM requests)) t WHERE rk <= {limit}""", ("hs", "requests"))
    b["hp"] = (f"""
SELECT * FROM (
  SELECT r.user_id, p.book_id, CAST(p.cnt AS DOUBLE) AS score, CAST(0.0 AS DOUBLE) AS cf,
         CAST(0.0 AS DOUBLE) AS content, CAST(p.cnt AS DOUBLE) AS pop, 'popularity' AS path,
         row_number() OVER (PARTITION BY r.user_id ORDER BY p.cnt DESC, p.book_id) AS rk
  FROM (SELECT DISTINCT user_id FROM requests WHERE user_id NOT IN (SELECT user_id FROM hs)) r, pop p
  WHERE {_UNSEEN.format(u='r.user_id', b='p.book_id')}) t WHERE rk <= {limit}""", ("requests", "hs", "pop", "seen"))
    cols = "user_id, rk, book_id, score, cf, content, pop, path"
    b["hyb"] = (f"SELECT {cols} FROM hr UNION ALL SELECT {cols} FROM hp", ("hr", "hp"))
    return b


def _hybrid_sql(m: int, alpha: float, lone: bool, limit: int = 10) -> str:
    cols = ("user_id, CAST(rk AS BIGINT) AS rank, book_id, round(score, 6) AS score, round(cf, 6) AS cf, "
            "round(content, 6) AS content, round(pop, 6) AS pop, path")
    return sql(f"SELECT {cols} FROM hyb", extra=hybrid_blocks(m, alpha, lone, limit))


def _cf_cands(c, m):
    store, items, profiles, seen = c.content
    return c.memo(("cfc", m), lambda: H.standin_cf_candidates(c.interactions, seen, m))


def _ct_cands(c, m):
    store, items, profiles, seen = c.content
    return c.memo(("ctc", m), lambda: H.content_candidates(profiles, items, seen, m))


@register("popularity", sql("SELECT book_id, cnt FROM pop", "pop"))
def q_popularity(c):
    """Interaction rows per book."""
    return P.popularity(c.interactions)


@register("popular_topk", sql("""
SELECT CAST(rk AS BIGINT) AS rank, book_id, cnt FROM (
  SELECT book_id, cnt, row_number() OVER (ORDER BY cnt DESC, book_id) AS rk FROM pop) t WHERE rk <= 10""", "pop"))
def q_popular_topk(c):
    """the 10 most popular books."""
    return P.popular_topk(P.popularity(c.interactions), 10)


@register("popularity_recommend", sql(f"""
SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, CAST(cnt AS DOUBLE) AS score, cnt FROM (
  SELECT r.user_id, p.book_id, p.cnt, row_number() OVER (PARTITION BY r.user_id ORDER BY p.cnt DESC, p.book_id) AS rk
  FROM requests r, pop p WHERE {_UNSEEN.format(u='r.user_id', b='p.book_id')}) t WHERE rk <= 10""",
                                      "requests", "pop", "seen"))
def q_popularity_recommend(c):
    """L1d: every customer's 10 most popular unseen books (the cold-start path)."""
    store, items, profiles, seen = c.content
    return P.unseen_popular(c.src.requests, P.popularity(c.interactions), seen, 10)


@register("minmax_normalize", sql(
    "SELECT user_id, book_id, round(content, 6) AS content, round(ct_n, 6) AS ct_n FROM (" + _mm("ctc", "content", "ct_n") + ") t",
    extra={k: v for k, v in _cands(30).items() if k == "ctc"}))
def q_minmax_normalize(c):
    """Min-max of each user's 30 content candidates (all-equal lists -> 1.0)."""
    return minmax_per_key(_ct_cands(c, 30), "user_id", "content", "ct_n")


@register("blend_full_outer", sql(
    "SELECT user_id, book_id, round(score, 6) AS score, round(cf, 6) AS cf, round(content, 6) AS content, "
    "round(pop, 6) AS pop, path FROM hs", extra=_blend_blocks(30, 0.4, False)))
def q_blend_full_outer(c):
    """Full outer join of CF and content candidates, missing side 0, blended (alpha 0.4)."""
    return H.blend(_cf_cands(c, 30), _ct_cands(c, 30), H.ALS)


@register("hybrid_recommend", _hybrid_sql(30, 0.4, False))
def q_hybrid_recommend(c):
    """ALS-variant hybrid over every customer (deterministic CF stand-in)."""
    store, items, profiles, seen = c.content
    return H.hybrid_recommend(c.src.requests, _cf_cands(c, 30), _ct_cands(c, 30),
                              P.popularity(c.interactions), seen, 10, H.ALS)


@register("hybrid_recommend_latent", _hybrid_sql(20, 0.6, True))
def q_hybrid_recommend_latent(c):
    """Latent-variant hybrid over every customer (deterministic CF stand-in)."""
    store, items, profiles, seen = c.content
    return H.hybrid_recommend(c.src.requests, _cf_cands(c, 20), _ct_cands(c, 20),
                              P.popularity(c.interactions), seen, 10, H.LATENT)


@register("recommendations_sink", sql(
    "SELECT user_id, CAST(rk AS BIGINT) AS rank, book_id, round(score, 6) AS score, 'als' AS variant FROM hyb",
    extra=hybrid_blocks(30, 0.4, False)))
def q_recommendations_sink(c):
    """Hybrid recommendations written as Parquet partitioned by variant, read back."""
    import uuid

    from shelfwise.session import scratch_path
    from shelfwise.sources.sinks import read_recommendations, write_recommendations
    store, items, profiles, seen = c.content
    recs = H.hybrid_recommend(c.src.requests, _cf_cands(c, 30), _ct_cands(c, 30),
                              P.popularity(c.interactions), seen, 10, H.ALS)
    path = scratch_path(c.spark, f"recs-{uuid.uuid4().hex[:8]}")
    write_recommendations({"als": recs.select("user_id", "rank", "book_id", "score")}, path)
    return read_recommendations(c.spark, path, "als")
