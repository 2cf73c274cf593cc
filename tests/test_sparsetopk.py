"""Sparse top-k by inverted lists against scoring all pairs."""

import numpy as np
import pytest

from shelfwise.operators.sparsetopk import sparse_topk

VECTORS = "book_id long, v struct<idx: array<bigint>, val: array<double>>"


def made_up(n, terms, seed, common=0):
    """Rows of Zipf-like terms, some equal, some empty; ``common`` terms stand in almost every row."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        idx = np.unique(np.minimum(rng.zipf(1.4, rng.integers(1, 9)), terms) + common)
        idx = np.concatenate([np.flatnonzero(rng.random(common) < 0.9), idx])
        val = rng.random(len(idx)) + 0.05
        rows.append((i * 3, idx, val / np.linalg.norm(val)))
    rows[5:8] = [(r[0], rows[4][1], rows[4][2]) for r in rows[5:8]]
    rows[9] = (rows[9][0], np.zeros(0, np.int64), np.zeros(0))
    return rows


def slow(rows, k):
    size = max(int(i.max()) for _, i, _ in rows if len(i)) + 1
    m = np.zeros((len(rows), size))
    for j, (_, idx, val) in enumerate(rows):
        m[j, idx] = val
    ids, score = [r[0] for r in rows], np.round(m @ m.T, 12)
    return {i: sorted((-score[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k] for a, i in enumerate(ids)}


@pytest.mark.parametrize("n, terms, common, k, share", [(150, 60, 0, 5, 0.25), (150, 400, 2, 3, 0.25), (150, 60, 1, 5, 10.0), (6 + 5, 5, 0, 30, 0.25)])
def test_against_all_pairs(spark, n, terms, common, k, share):
    rows = made_up(n, terms, n + terms, common)
    df = spark.createDataFrame([(i, {"idx": a.tolist(), "val": v.tolist()}) for i, a, v in rows], VECTORS).repartition(3)
    found, counts = sparse_topk(df, "book_id", "v", k, list_share=share)
    got = {}
    for r in found.collect():
        got.setdefault(r["lid"], []).append((r["rank"], r["rid"], r["score"]))
    for i, want in slow(rows, k).items():
        own = sorted(got[i])
        assert [x[0] for x in own] == list(range(1, len(want) + 1))
        assert [x[1] for x in own] == [b for _, b in want]
        assert np.allclose([x[2] for x in own], [-s for s, _ in want], atol=1e-9)
    rows_, pairs, dense = counts.first()
    assert rows_ == n and pairs < n * (n - 1)
    assert share < 1 or dense == 0


def test_common_terms_make_few_candidates(spark):
    rng = np.random.default_rng(1)
    # Pairs of near twins that share rare terms, and a light term that all rows have.
    rows = [(i, np.array([0, 1 + i // 6, 200 + i // 3]), np.array([0.05, 0.7, 0.7])) for i in range(120)]
    df = spark.createDataFrame([(i, {"idx": a.tolist(), "val": (v * rng.uniform(0.9, 1.1)).tolist()}) for i, a, v in rows], VECTORS)
    found, counts = sparse_topk(df, "book_id", "v", 2)
    assert found.count() == 240
    _, pairs, dense = counts.first()
    assert dense == 0 and pairs <= 120 * 5


def test_empty(spark):
    found, counts = sparse_topk(spark.createDataFrame([], VECTORS), "book_id", "v", 3)
    assert found.isEmpty()


def test_pairs_do_not_grow_with_the_square_of_the_rows(spark, monkeypatch):
    from shelfwise.operators import sparsetopk
    monkeypatch.setattr(sparsetopk, "LIST_ROWS", 70)
    rows = made_up(600, 40, 7)
    df = spark.createDataFrame([(i, {"idx": a.tolist(), "val": v.tolist()}) for i, a, v in rows], VECTORS)
    found, counts = sparse_topk(df, "book_id", "v", 3, list_share=10.0)
    got = {(r["lid"], r["rank"]): r["rid"] for r in found.collect()}
    assert got == {(i, j + 1): b for i, want in slow(rows, 3).items() for j, (_, b) in enumerate(want)}
    _, pairs, dense = counts.first()
    assert pairs <= 600 * 70 and dense > 0
