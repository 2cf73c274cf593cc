"""The non-linear head against plain numpy, its bounds, and its exact top-k against scoring all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import neural as N
from shelfwise.operators.boundscore import Boxes, Dot, bounded_topk, item_cells
from shelfwise.operators.content import content_recommend, similar_items
from shelfwise.operators.cf import CFModel
from shelfwise.operators.latent import LatentModel

PAIR = "p array<double>, q array<double>, y double, held boolean"


def random_head(dim, rng, hidden=(10, 6)):
    head = N.start_head(dim, hidden, rng.normal(size=3 * dim), 0.3, (1.5, 0.7, 2.0), 3)
    return head.filled(np.concatenate([head.flat()[:-3] + rng.normal(size=head.flat().size - 3) * 0.3, head.scale]))


def test_linear_head_is_where_training_starts():
    rng = np.random.default_rng(0)
    coef, p, q = rng.normal(size=12), rng.normal(size=(9, 4)), rng.normal(size=(9, 4))
    head = N.start_head(4, (8, 4), coef, 0.5, (2.0, 3.0, 0.1))
    assert np.allclose(head.score(p, q), np.concatenate([p * q, p, q], axis=1) @ coef + 0.5)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    head, p, q, y = random_head(5, rng), rng.normal(size=(7, 5)), rng.normal(size=(7, 5)), rng.normal(size=7)
    loss = lambda h: float(((h.layers(p, q)[0] - y) ** 2).mean())
    flat, grad = head.flat(), np.concatenate([g.ravel() for g in head.gradient(p, q, y)])
    for i in rng.choice(len(flat) - 3, 60, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert grad[i] == pytest.approx((loss(head.filled(up)) - loss(head.filled(down))) / 2e-6, rel=1e-3, abs=1e-6)


def cells_of(groups):
    centre = [g.mean(0) for g in groups]
    radius = [[np.linalg.norm(g - c, axis=1).max()] for g, c in zip(groups, centre)]
    return Boxes(np.array([g.min(0) for g in groups]), np.array([g.max(0) for g in groups]), np.array(centre), np.array(radius))


def test_dot_bounds():
    rng = np.random.default_rng(3)
    p, groups = rng.normal(size=(30, 8)), [rng.normal(size=8) + rng.normal(size=(n, 8)) * s for n, s in ((1, 1), (9, 0.1), (40, 2))]
    bound = Dot().bound(Dot().users(p), cells_of(groups))
    best = np.array([(p @ g.T).max(1) for g in groups]).T
    assert (bound >= best - 1e-12).all() and np.allclose(bound[:, 0], best[:, 0])


def test_block_scores_and_bounds():
    rng = np.random.default_rng(2)
    head, p, q = random_head(6, rng), rng.normal(size=(20, 6)), rng.normal(size=(40, 6))
    full = head.score(np.repeat(p, 40, axis=0), np.tile(q, (20, 1))).reshape(20, 40)
    assert np.allclose(head.pairs(head.users(p), head.items(q)), full)
    for width in (40, 5, 1):
        boxes = [q[i:i + width] for i in range(0, 40, width)]
        bound = head.bound(head.users(p), cells_of(boxes))
        best = np.array([full[:, i:i + width].max(1) for i in range(0, 40, width)]).T
        assert (bound >= best - 1e-9).all()
        assert width > 1 or np.allclose(bound, best)  # of a point, the score itself


def xor_rows(n, seed):
    """Strengths that turn on whether two coordinates of different sides agree in sign: no product p_i * q_i shows it."""
    rng = np.random.default_rng(seed)
    p, q = rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
    y = 2.0 * ((p[:, 0] > 0) ^ (q[:, 1] > 0)) + 0.1 * rng.normal(size=n)
    return p, q, y, np.arange(n) % 10 == 0


def test_one_partition_is_plain_numpy(spark):
    p, q, y, held = xor_rows(600, 5)
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), float(c), bool(d)) for a, b, c, d in zip(p, q, y, held)], PAIR).coalesce(1).checkpoint()
    start = N.start_head(4, (8, 4), scale=(1.0, 1.0, float(y.std())))
    got, history = N.train_head(rows, start, 3, 64, 0.01)
    head, errors, heads = start, [], []
    for _ in range(4):
        heads.append(head)
        errors.append(np.sqrt(((head.score(p[held], q[held]) - y[held]) ** 2).mean()))
        head, *_ = N.local_round(head, [(p, q, y, held)], 64, 0.01, N.LATENT_REG)
    assert np.allclose(history, errors) and np.allclose(got.flat(), heads[int(np.argmin(errors))].flat())


def test_network_learns_what_the_linear_head_cannot(spark):
    p, q, y, held = xor_rows(12000, 6)
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), float(c), bool(d)) for a, b, c, d in zip(p, q, y, held)], PAIR).repartition(4).checkpoint()
    x = np.concatenate([p * q, p, q, np.ones((len(p), 1))], axis=1)
    coef = np.linalg.lstsq(x[~held], y[~held], rcond=None)[0]
    linear = np.sqrt(((x[held] @ coef - y[held]) ** 2).mean())
    head = N.start_head(4, (32, 16), coef[:-1], coef[-1], (1.0, 1.0, float(y.std())))
    best, history = N.train_head(rows, head, 12, 64, 0.005)
    assert history[0] == pytest.approx(linear, rel=1e-6)
    assert min(history) < 0.6 * linear and N.chosen_rounds(history) == int(np.argmin(history))
    rmse = np.sqrt(((best.score(p[held], q[held]) - y[held]) ** 2).mean())
    assert rmse == pytest.approx(min(history), rel=1e-9)


def test_bounded_topk_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    head = random_head(4, rng)
    centres = rng.normal(size=(12, 4)) * 3
    items = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 4)) * 0.05
    items[500:520] = items[500]  # equal scores go to the smaller id
    users = rng.normal(size=(70, 4)) * 2
    skip = [(u, int(i)) for u in range(0, 70, 2) for i in rng.choice(900, 300, replace=False)]
    left = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_id long, features array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "book_id long, features array<double>")
    ex = spark.createDataFrame(skip, "user_id long, book_id long")
    recs, counts = bounded_topk(left, "user_id", "features", right, "book_id", "features", head, 10, exclude=ex, cell_items=32)
    got = {(r["lid"], r["rank"]): (r["rid"], r["score"]) for r in recs.collect()}
    full = np.round(head.pairs(head.users(users), head.items(items)), 12)
    for u, i in skip:
        full[u, i] = -np.inf
    for u in range(70):
        best = sorted(range(900), key=lambda i: (-full[u, i], i))[:10]
        assert [got[u, r + 1][0] for r in range(10)] == best
        assert np.allclose([got[u, r + 1][1] for r in range(10)], full[u, best], atol=1e-9)
    scored, skipped = counts.first()
    assert scored + skipped == 70 * 900 and skipped > 0.5 * 70 * 900
    cells = item_cells(right, "book_id", "features", 32).collect()
    assert sorted(i for c in cells for i in c["ids"]) == list(range(900))


def test_bounded_topk_of_empty_sides(spark):
    head = N.start_head(2, (4, 2))
    none = spark.createDataFrame([], "id long, v array<double>")
    one = spark.createDataFrame([(1, [0.0, 1.0])], "id long, v array<double>")
    for a, b in ((none, one), (one, none), (none, none)):
        recs, counts = bounded_topk(a, "id", "v", b, "id", "v", head, 3)
        assert recs.isEmpty()
    recs, counts = bounded_topk(one, "id", "v", one, "id", "v", head, 3)
    assert [tuple(r)[:3] for r in recs.collect()] == [(1, 1, 1)]


def test_model_predicts_and_recommends(spark):
    rng = np.random.default_rng(8)
    head = random_head(3, rng)
    factors = lambda n, name: spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(n)], f"{name} long, features array<double>")
    cf = CFModel(factors(6, "user_id").checkpoint(), factors(9, "book_id").checkpoint())
    seen = spark.createDataFrame([(0, 1), (0, 2), (5, 8)], "user_id long, book_id long")
    model = N.NeuralModel(cf, head, seen, LatentModel(cf, [0.0] * 9, 0.0, seen), [])
    pairs = spark.range(8).select(F.col("id").alias("user_id")).crossJoin(spark.range(9).select(F.col("id").alias("book_id")))
    scores = {(r["user_id"], r["book_id"]): r["prediction"] for r in model.predict(pairs).collect()}
    assert len(scores) == 54  # users 6 and 7 are unknown
    recs = N.neural_recommend(model, 4).collect()
    assert len(recs) == 24
    for u in range(6):
        left = sorted((i for i in range(9) if (u, i) not in {(0, 1), (0, 2), (5, 8)}), key=lambda i: -scores[u, i])[:4]
        assert [r["book_id"] for r in sorted(recs, key=lambda r: r["rank"]) if r["user_id"] == u] == left


def test_rounds_need_a_clear_gain():
    nan = float("nan")
    assert N.chosen_rounds([2.0, 1.5, 1.6]) == 1 and N.chosen_rounds([2.0, 1.99, 1.995]) == 0
    assert N.chosen_rounds([2.0, 2.5]) == 0 and N.chosen_rounds([nan, nan]) == 0 and N.chosen_rounds([1.0]) == 0


def test_pruned_lists_equal_the_block_scorers(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 6))
    items = centres[rng.integers(0, 10, 700)] + rng.normal(size=(700, 6)) * 0.05
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    books = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "book_id long, embedding array<double>").checkpoint()
    users = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 6)))], "user_id long, profile array<double>").checkpoint()
    seen = spark.createDataFrame([(u, int(b)) for u in range(0, 40, 3) for b in rng.choice(700, 50, replace=False)], "user_id long, book_id long")
    rows = lambda df: sorted(tuple(x if not isinstance(x, float) else round(x, 9) for x in r) for r in df.collect())
    assert rows(content_recommend(users, books, seen, 5, pruned=True)) == rows(content_recommend(users, books, seen, 5))
    assert rows(similar_items(books, 4, pruned=True)) == rows(similar_items(books, 4))
    _, counts = bounded_topk(users, "user_id", "profile", books, "book_id", "embedding", Dot(), 5, cell_items=32)
    scored, skipped = counts.first()
    assert scored + skipped == 40 * 700 and skipped > scored


def test_centres_of_some_items_find_the_same_lists(spark, monkeypatch):
    from shelfwise.operators import boundscore
    monkeypatch.setattr(boundscore, "FIT_ROWS", 40)
    X = np.random.default_rng(8).standard_normal((300, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    found, counts = bounded_topk(df, "id", "v", df, "id", "v", Dot(), 4, cell_items=16)
    want = np.argsort(-np.round(X @ X.T, 12), axis=1, kind="stable")[:, :4]
    assert {(r.lid, r.rank): r.rid for r in found.collect()} == {(i, j + 1): want[i, j] for i in range(300) for j in range(4)}
    scored, skipped = counts.first()
    assert scored + skipped == 300 * 300


def test_cells_that_no_bound_rules_out_are_scored_fast():
    """All pairs of random vectors: lists of one query after the other took over 10 s."""
    import time

    import pyarrow as pa

    from shelfwise.operators import boundscore
    X = np.random.default_rng(9).standard_normal((20000, 32))
    lists = lambda rows: pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))
    own = pa.array([[i] for i in range(3000)], pa.list_(pa.int64()))
    task = boundscore._Task(Dot(), 10, [pa.record_batch([pa.array(np.arange(3000)), own, lists(X[:3000])], names=["id", "ids", "vectors"])])
    cells = X[:19968].reshape(-1, 128, 32)
    centre = cells.mean(1)
    far = np.sqrt(((cells - centre[:, None]) ** 2).sum(2)).max(1)
    start = time.perf_counter()
    task.see(pa.record_batch([pa.array(np.arange(19968).reshape(-1, 128).tolist()), lists(cells.reshape(len(cells), -1)), lists(cells.min(1)),
                              lists(cells.max(1)), lists(centre), lists(far[:, None])], names=["ids", "vectors", *boundscore.BOX]))
    assert time.perf_counter() - start < 5
    assert task.scored + task.skipped == 3000 * 19968
