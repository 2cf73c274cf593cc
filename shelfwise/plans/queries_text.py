"""Registered queries: text functions, TF-IDF, ratings and diversity."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import text as X
from shelfwise.operators import content as C
from shelfwise.operators import diversity as V
from shelfwise.operators import tfidf as T
from shelfwise.plans.oracle import sql
from shelfwise.plans.registry import register

_NORM = ("coalesce(regexp_replace(regexp_replace(regexp_replace(lower({x}), '^\\s+|\\s+$', '', 'g'), "
         "'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), '')")
_TOK = "regexp_extract_all(lower({x}), '([\\p{{L}}\\p{{N}}_]+)', 1)"
_TAGS = "list_distinct(list_filter(string_split_regex(concat_ws(' ', {cols}), '\\s+'), lambda t: t <> ''))"
_DOC_PART = "CASE WHEN CAST({c} AS VARCHAR) IN ('', 'None') THEN NULL ELSE CAST({c} AS VARCHAR) END"
_DOC = "concat_ws(' ', " + ", ".join(_DOC_PART.format(c=c) for c in X.DOCUMENT_COLUMNS) + ")"

_TFIDF_BLOCKS = {
    "tdoc": ("SELECT book_id, concat_ws(' ', genres_text, title, description) AS doc FROM catalog", ("catalog",)),
    "ttok": (f"SELECT book_id, unnest({_TOK.format(x='doc')}) AS term FROM tdoc", ("tdoc",)),
    "ttf": ("SELECT book_id, term, count(*) AS tf FROM ttok GROUP BY book_id, term", ("ttok",)),
    "tdf": ("SELECT term, count(*) AS df FROM ttf GROUP BY term", ("ttf",)),
    "tw": ("""
SELECT f.book_id, f.term, f.tf * (ln((1 + (SELECT count(*) FROM tdoc)) / CAST(1 + d.df AS DOUBLE)) + 1) AS w
FROM ttf f JOIN tdf d USING (term)""", ("ttf", "tdf", "tdoc")),
    "tfw": ("SELECT book_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY book_id)) AS weight FROM tw", ("tw",)),
}


def _ctx_items(c):
    return c.memo("items", lambda: C.item_vectors(c.src.item_embeddings, c.live))


def _div_books(c):
    return c.memo("div_books", lambda: V.project_diversity_columns(c.books))


@register("normalize_text", sql(f"SELECT doc_id, {_NORM.format(x='text')} AS norm FROM documents", "documents"))
def q_normalize_text(c):
    """H1: normalised text of every document."""
    return c.raw("documents").select("doc_id", X.normalize_text("text").alias("norm"))


@register("fold_diacritics", sql("SELECT doc_id, strip_accents(text) AS folded FROM documents", "documents"))
def q_fold_diacritics(c):
    """H2: every document with diacritics removed."""
    return c.raw("documents").select("doc_id", X.fold_diacritics("text").alias("folded"))


@register("build_document", sql(f"SELECT book_id, {_NORM.format(x=_DOC)} AS document FROM catalog", "catalog"))
def q_build_document(c):
    """H3: the normalised search document of every live book."""
    return c.books.select("book_id", X.build_document().alias("document"))


@register("tag_tokens", sql(
    "SELECT book_id, list_sort(" + _TAGS.format(cols="genres_text, title, description") + ") AS tags FROM catalog",
    "catalog"))
def q_tag_tokens(c):
    """H4: distinct white-space tags of genres_text, title and description per live book."""
    return V.tag_sets(c.books, ["genres_text", "title", "description"]).select(
        "book_id", F.array_sort("tags").alias("tags"))


@register("word_tokens", sql(f"""
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct, min(tok) AS first_tok, max(tok) AS last_tok
FROM (SELECT doc_id, unnest({_TOK.format(x='text')}) AS tok FROM documents) t GROUP BY doc_id""", "documents"))
def q_word_tokens(c):
    """H8: per document, token count, distinct tokens and the smallest/largest token."""
    t = c.raw("documents").select("doc_id", F.explode(X.word_tokens("text")).alias("tok"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.countDistinct("tok").alias("n_distinct"),
                                   F.min("tok").alias("first_tok"), F.max("tok").alias("last_tok"))


@register("tfidf", sql("SELECT book_id, term, round(weight, 6) AS weight FROM tfw", extra=_TFIDF_BLOCKS))
def q_tfidf(c):
    """I4: TF-IDF weights over the catalogue's tag columns (genres, title, description)."""
    return T.tfidf(T.corpus(c.books, ["genres_text", "title", "description"]))


@register("tfidf_documents", sql(
    "SELECT book_id, term, round(weight, 6) AS weight FROM tfw",
    extra={**_TFIDF_BLOCKS, "tdoc": ("SELECT doc_id AS book_id, text AS doc FROM documents", ("documents",))}))
def q_tfidf_documents(c):
    """I4 on whole documents: TF-IDF of every document's full text."""
    docs = c.raw("documents").select(F.col("doc_id").alias("book_id"), F.col("text").alias("doc"))
    return T.tfidf(docs)


_TFIDF_SIMILAR = sql("""
SELECT book_id, CAST(rk AS BIGINT) AS rank, other_id, round(score, 6) AS score FROM (
  SELECT a.book_id, b.book_id AS other_id, coalesce(s.score, 0) AS score,
         row_number() OVER (PARTITION BY a.book_id ORDER BY round(coalesce(s.score, 0), 12) DESC, b.book_id) AS rk
  FROM tdoc a JOIN tdoc b ON a.book_id <> b.book_id
  LEFT JOIN (SELECT x.book_id AS a, y.book_id AS b, sum(x.weight * y.weight) AS score
             FROM tfw x JOIN tfw y ON x.term = y.term GROUP BY 1, 2) s ON s.a = a.book_id AND s.b = b.book_id) t
WHERE rk <= 10""", extra=_TFIDF_BLOCKS)


@register("tfidf_similarity", _TFIDF_SIMILAR)
def q_tfidf_similarity(c):
    """10 most TF-IDF-cosine-similar other books per live book."""
    docs = T.corpus(c.books, ["genres_text", "title", "description"])
    return T.tfidf_similarity(T.tfidf_vectors(T.tfidf(docs), docs), 10)


@register("tfidf_similarity_lists", _TFIDF_SIMILAR)
def q_tfidf_similarity_lists(c):
    """I5 by inverted lists; equals tfidf_similarity."""
    docs = T.corpus(c.books, ["genres_text", "title", "description"])
    return T.tfidf_similarity(T.tfidf_vectors(T.tfidf(docs), docs), 10, lists=True)


_RMAP = {"rmap": ("SELECT book_id, avg(strength) AS avg_rating FROM inter GROUP BY book_id", ("inter",)),
         "rmap_r": ("SELECT book_id, avg(strength) AS avg_rating FROM inter WHERE type = 'rating' GROUP BY book_id",
                    ("inter",))}


@register("mean_rating_all", sql("SELECT book_id, round(avg_rating, 6) AS avg_rating FROM rmap", extra=_RMAP))
def q_mean_rating_all(c):
    """Mean strength per book, all event types."""
    return V.mean_rating_all(c.interactions)


@register("mean_rating_only", sql("SELECT book_id, round(avg_rating, 6) AS avg_rating FROM rmap_r", extra=_RMAP))
def q_mean_rating_only(c):
    """Mean strength per book over rating events."""
    return V.mean_rating_only(c.interactions, c.books)


@register("global_rating", sql("SELECT round(coalesce(avg(avg_rating), 0), 6) AS global_rating FROM rmap",
                               extra=_RMAP))
def q_global_rating(c):
    """Mean of the per-book means."""
    return V.global_rating(V.mean_rating_all(c.interactions))


@register("rating_lookup", sql("""
SELECT l.book_id, round(coalesce(r.avg_rating, (SELECT coalesce(avg(avg_rating), 0) FROM rmap)), 6) AS rating
FROM catalog l LEFT JOIN rmap r USING (book_id)""", "catalog", extra=_RMAP))
def q_rating_lookup(c):
    """Every live book's mean rating, else the global rating."""
    return V.rating_lookup(c.books.select("book_id"), "book_id", V.mean_rating_all(c.interactions))


@register("project_diversity_columns", sql("SELECT book_id, genres_text, title, description FROM catalog", "catalog"))
def q_project_diversity_columns(c):
    """book_id plus the candidate tag columns present in the catalogue."""
    return _div_books(c)


@register("align_embeddings", sql("""
SELECT l.book_id, (e.book_id IS NOT NULL) AS has_embedding
FROM catalog l LEFT JOIN item_embeddings e USING (book_id)""", "catalog", "item_embeddings"))
def q_align_embeddings(c):
    """Whether each live book has a vector (all must, or diversity uses TF-IDF)."""
    return V.align_embeddings(c.books, c.src.item_embeddings)


@register("tag_overlap", sql("""
SELECT s.book_id, s.similar_book_id AS other_id, CAST(len(list_intersect(a.tags, b.tags)) AS BIGINT) AS tag_overlap
FROM (SELECT book_id, similar_book_id FROM (
        SELECT a.book_id, b.book_id AS similar_book_id,
               row_number() OVER (PARTITION BY a.book_id ORDER BY round(list_dot_product(a.e, b.e), 12) DESC, b.book_id) AS rk
        FROM emb a, emb b WHERE a.book_id <> b.book_id AND list_dot_product(a.e, b.e) > 0) t WHERE rk <= 10) s
JOIN dtag a ON a.book_id = s.book_id JOIN dtag b ON b.book_id = s.similar_book_id""",
                             "emb", extra={"dtag": ("SELECT book_id, " + _TAGS.format(cols="genres_text, title, description")
                                                    + " AS tags FROM catalog", ("catalog",))}))
def q_tag_overlap(c):
    """Shared tags between each live book and its 10 most similar books."""
    sims = C.similar_items(_ctx_items(c), 10).select("book_id", F.col("similar_book_id").alias("other_id"))
    tags = V.tag_sets(c.books, ["genres_text", "title", "description"])
    return V.tag_overlap(sims.join(tags.select("book_id"), "book_id", "left_semi")
                         .join(tags.select(F.col("book_id").alias("other_id")), "other_id", "left_semi"), tags)


def _div_sql(sim_block: str, sim_deps: tuple, limit: int = 5, head: int = 10, more: dict | None = None) -> str:
    extra = dict(_RMAP)
    extra.update(more or {})
    extra["dtag"] = ("SELECT book_id, " + _TAGS.format(cols="genres_text, title, description")
                     + " AS tags FROM catalog", ("catalog",))
    extra["dsim"] = (sim_block, sim_deps)
    extra["dpair"] = ("""
SELECT s.a AS book_id, s.b AS cid, CAST(len(list_intersect(x.tags, y.tags)) AS BIGINT) AS ov, s.sim
FROM dsim s JOIN dtag x ON x.book_id = s.a JOIN dtag y ON y.book_id = s.b""", ("dsim", "dtag"))
    extra["dhead"] = (f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY ov, round(sim, 12), cid) AS hr FROM dpair) t
WHERE hr <= {head}""", ("dpair",))
    extra["drated"] = ("""
SELECT h.*, coalesce(r.avg_rating, (SELECT coalesce(avg(avg_rating), 0) FROM rmap)) AS rating
FROM dhead h LEFT JOIN rmap r ON r.book_id = h.cid""", ("dhead", "rmap"))
    return sql(f"""
SELECT book_id, CAST(rk AS BIGINT) AS rank, cid AS candidate_id, round(rating, 6) AS rating,
       round(1 - round(sim, 12), 6) AS score, ov AS tag_overlap, round(sim, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY rating DESC, 1 - round(sim, 12) DESC, hr) AS rk FROM drated) t
WHERE rk <= {limit}""", extra=extra)


@register("diversity_recommend", _div_sql("""
SELECT a.book_id AS a, b.book_id AS b, list_dot_product(a.e, b.e) / (a.n * b.n) AS sim
FROM (SELECT book_id, e, sqrt(list_dot_product(e, e)) AS n FROM emb WHERE book_id IN (SELECT book_id FROM catalog)) a,
     (SELECT book_id, e, sqrt(list_dot_product(e, e)) AS n FROM emb WHERE book_id IN (SELECT book_id FROM catalog)) b
WHERE a.book_id <> b.book_id""", ("emb", "catalog")))
def q_diversity_recommend(c):
    """L3: 5 diverse alternatives per live book (embedding similarity, tags of genres/title/description)."""
    return V.diversity_recommend(_div_books(c), c.src.item_embeddings, limit=5, interactions=c.interactions)


@register("diversity_recommend_tfidf", _div_sql("""
SELECT a.book_id AS a, b.book_id AS b, coalesce(s.score, 0) AS sim
FROM tdoc a JOIN tdoc b ON a.book_id <> b.book_id
LEFT JOIN (SELECT x.book_id AS a, y.book_id AS b, sum(x.weight * y.weight) AS score
           FROM tfw x JOIN tfw y ON x.term = y.term GROUP BY 1, 2) s ON s.a = a.book_id AND s.b = b.book_id""",
                                                  ("tdoc", "tfw"), more=_TFIDF_BLOCKS))
def q_diversity_recommend_tfidf(c):
    """L3, TF-IDF form: similarity is TF-IDF cosine over the tag columns."""
    return V.diversity_recommend(_div_books(c), None, V.mean_rating_all(c.interactions), 5, use_tfidf=True)
