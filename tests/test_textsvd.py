"""Text vectors: the randomised SVD against numpy's, and the saved model against the projection."""

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import textsvd as S
from shelfwise.plans.training import load_models, save_models
from shelfwise.session import scratch_path


def corpus(n, words, topics, seed):
    """Texts whose words come mostly from one topic's, some empty or null."""
    rng = random.Random(seed)
    own = [[f"w{t}_{i}" for i in range(words)] for t in range(topics)]
    texts = []
    for i in range(n):
        t = rng.randrange(topics)
        texts.append(" ".join(rng.choice(own[t]) if rng.random() < 0.8 else rng.choice(own[rng.randrange(topics)]) for _ in range(rng.randint(1, 20))))
    return texts + ["", None, " ", texts[0], texts[0]]


def dense(texts, size):
    features = [S.text_features(t, size) for t in texts]
    n, a = len(texts), np.zeros((len(texts), size))
    for i, f in enumerate(features):
        np.add.at(a[i], f, 1.0)
    a *= np.log((1 + n) / (1 + (a > 0).sum(0))) + 1
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, norm, out=np.zeros_like(a), where=norm > 0)


def frame(spark, texts, parts=5):
    return spark.createDataFrame(list(enumerate(texts)), "book_id long, document string").repartition(parts)


def test_features_are_the_same_on_both_sides(spark):
    texts = corpus(40, 9, 3, 1) + ["é ü  ñ", "a  b "]
    got = frame(spark, texts).select("book_id", S.term_features("document", 97).alias("f")).collect()
    assert {r["book_id"]: list(r["f"]) for r in got} == {i: S.text_features(t, 97) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n, words, topics, dim", [(60, 4, 3, 40), (300, 40, 6, 5), (3, 5, 1, 8)])
def test_singular_values_are_numpys(spark, n, words, topics, dim):
    texts = corpus(n, words, topics, n)
    a = dense(texts, 512)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    rank = int((s > 1e-8).sum())
    got = S.fit_projection(frame(spark, texts), dim=dim, num_features=512, passes=8)
    k = min(dim, rank)
    # Exact where the sketch holds all directions, else up to the decay of eight passes.
    assert got.dim == k and np.allclose(got.singular, s[:k], rtol=1e-6 if rank <= dim + S.OVERSAMPLE else 1e-4)
    assert np.allclose(got.components.T @ got.components, np.eye(k), atol=1e-9)
    # The same directions, as far as singular values lie apart.
    own = [i for i in range(k) if all(abs(s[i] - s[j]) > 0.05 for j in range(min(k + 1, len(s))) if j != i)]
    assert np.allclose(np.abs((vt[own] * got.components[:, own].T).sum(1)), 1, atol=1e-3)


def test_no_documents_and_no_terms(spark):
    for texts in ([], ["", None, "  "]):
        got = S.fit_projection(frame(spark, texts) if texts else frame(spark, ["x"]).limit(0), num_features=64)
        assert got.dim == 0


def books(spark, texts):
    cols = "book_id long, title string, description string, authors_text string, genres_text string, publisher string, publication_year int"
    return spark.createDataFrame([(i, t, None, "someone" if i % 2 else None, "", "None", None) for i, t in enumerate(texts)], cols)


def test_saved_model_gives_the_projections_vectors(spark):
    b = books(spark, corpus(80, 10, 4, 9))
    docs = b.select("book_id", S.build_document().alias("document"))
    projection = S.fit_projection(docs, dim=6, num_features=256)
    base = scratch_path(spark, f"projection-{uuid.uuid4().hex}")
    path = save_models(spark, base, {"projection": projection.table(b)}, {"dim": projection.dim})
    again = S.TextProjection.load(f"{path}/projection")
    assert np.array_equal(again.idf, projection.idf) and np.array_equal(again.components, projection.components)
    assert load_models(spark, base).tables["projection"].count() == 256
    one = {r["book_id"]: r["embedding"] for r in S.project(b, projection).collect()}
    two = {r["book_id"]: r["embedding"] for r in S.model_vectors(b, f"{path}/projection", batch_size=7).collect()}
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i], atol=1e-12) for i in one)
    texts = [r["document"] for r in docs.orderBy("book_id").collect()]
    expected = dense(texts, 256) @ projection.components
    norm = np.linalg.norm(expected, axis=1, keepdims=True)
    assert np.allclose(np.array([one[i] for i in range(len(texts))]), expected / np.where(norm > 0, norm, 1), atol=1e-9)
    assert b.where(F.col("title").isNull()).count() == 1
