"""Rules without a query of their own: defaults, bounds, safe numbers, exclusions, persistence, readers."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.text import fold_diacritics
from shelfwise.operators import evaluation as E
from shelfwise.operators.blockscore import exact_topk
from shelfwise.operators.cf import CFModel
from shelfwise.operators.diversity import diversity_recommend, mean_rating_only, rating_map_of
from shelfwise.operators.encode import encode_items, model_encode
from shelfwise.operators.interactions import exact_median, interaction_store, interaction_store_map
from shelfwise.operators.latent import LatentModel, grid_search, latent_recommend
from shelfwise.operators.popularity import unseen_popular
from shelfwise.operators.ranking import topk_per_key
from shelfwise.plans import training as TR
from shelfwise.sources import catalog as S
from shelfwise.sources import testdata
from shelfwise.streaming import feedback as FB
from tests.conftest import SF0001


def test_defaults(spark):
    df = S.ensure_columns(spark.range(1), {"id": 5, "type": "rating", "strength": 1.0})
    assert [tuple(r) for r in df.collect()] == [(0, "rating", 1.0)]
    assert S.first_present(df, ("rating_value", "strength", "id")) == "strength"
    assert S.first_present(df, ("x",)) is None


def test_bounds(spark):
    one = spark.createDataFrame([(1, 1.0)], "book_id long, avg_rating double")
    books = spark.createDataFrame([(1, "a")], "book_id long, genres_text string")
    for limit in (0, 101):
        with pytest.raises(ValueError):
            diversity_recommend(books, None, one, limit)
    with pytest.raises(ValueError):
        diversity_recommend(books, None)
    with pytest.raises(ValueError):
        rating_map_of(books, rating_source="some")
    for size in (9, 1001):
        with pytest.raises(ValueError):
            FB.buffer_trigger(spark.range(1), size)
    with pytest.raises(ValueError):
        topk_per_key(spark.range(1), "id", [F.col("id")], 0)
    with pytest.raises(ValueError):
        grid_search(spark.range(1), {})
    with pytest.raises(ValueError):
        E.fold_assign(spark.range(1), 1)
    with pytest.raises(ValueError):
        E.temporal_split(spark.createDataFrame([], "ts timestamp"), 1.5)


def test_safe_numbers(spark):
    df = spark.createDataFrame([("a", 1, v) for v in (1.5, math.nan, math.inf, -math.inf, None)], "metric string, k long, value double")
    assert [r.value for r in E.safe_metrics(df).collect()] == [1.5, None, None, None, None]


def test_sample_users_in_order_of_appearance(spark):
    rows = [(5, "2024-01-02"), (7, "2024-01-01"), (5, "2024-01-09"), (6, "2024-01-01"), (9, None)]
    df = spark.createDataFrame(rows, "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r.user_id for r in E.sample_users(df, 3).collect()] == [6, 7, 5]
    assert {r.user_id for r in E.sample_users(df, None).collect()} == {5, 6, 7, 9}


def test_latent_lists_exclude_training_and_given_pairs(spark):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "user_id long, features array<double>")
    items = spark.createDataFrame([(i, [float(i), float(-i)]) for i in range(6)], "book_id long, features array<double>")
    training = spark.createDataFrame([(1, 5), (1, 4)], "user_id long, book_id long")
    more = spark.createDataFrame([(1, 3), (2, 0)], "user_id long, book_id long")
    model = LatentModel(CFModel(users, items), [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], 0.0, training)
    got = {}
    for r in latent_recommend(model, 3, exclude=more).orderBy("rank").collect():
        got.setdefault(r.user_id, []).append((r.book_id, r.score))
    assert got == {1: [(2, 2.0), (1, 1.0), (0, 0.0)], 2: [(1, -1.0), (2, -2.0), (3, -3.0)]}


def test_median(spark):
    rng = np.random.default_rng(0)
    for values in ([3.0], [1.0, 2.0], rng.normal(0, 1, 4001).tolist(), rng.lognormal(0, 9, 2000).tolist(), [7.0] * 50 + [1.0] * 50):
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
        assert exact_median(df, "v", few=20, bins=7) == float(np.median(values))
    assert exact_median(spark.createDataFrame([], "v double"), "v") is None


def test_splits_against_a_full_sort(spark):
    import datetime
    rng = np.random.default_rng(1)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(int(u), int(b), t0 + datetime.timedelta(hours=int(h)) if h % 11 else None, float(u % 3), "rating")
            for u, b, h in rng.integers(0, 200, (400, 3))]
    df = spark.createDataFrame(rows, "user_id long, book_id long, ts timestamp_ntz, strength double, type string")
    order = sorted(rows, key=lambda r: (r[2] is None, r[2] or t0, r[0], r[1], r[4], r[3]))
    for ratio in (0.0, 0.02, 0.25, 0.99, 1.0):
        got = E.temporal_split(df, ratio).collect()
        cut = int(400 * (1 - ratio))
        assert sorted(map(str, (tuple(r)[:5] for r in got if r.split == "train"))) == sorted(map(str, order[:cut]))
        assert sum(r.split == "train" for r in E.random_split(df, ratio).collect()) == cut


def test_unseen_popular_with_long_histories(spark):
    rng = np.random.default_rng(2)
    pop = {b: int(c) for b, c in enumerate(rng.integers(1, 9, 60))}
    ranked = sorted(pop, key=lambda b: (-pop[b], b))
    seen = {1: set(ranked[:50]), 2: set(ranked[::2]), 3: set(ranked), 5: {ranked[-1]}}
    got = {}
    df = unseen_popular(spark.createDataFrame([(u,) for u in range(6)], "user_id long"), spark.createDataFrame(list(pop.items()), "book_id long, cnt long"),
                        spark.createDataFrame([(u, b) for u, s in seen.items() for b in s], "user_id long, book_id long"), 4)
    for r in df.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.book_id)
    want = {u: [b for b in ranked if b not in seen.get(u, ())][:4] for u in range(6)}
    assert got == {u: v for u, v in want.items() if v}


def test_fold_diacritics_in_many_scripts(spark):
    golden = [("Xin chào Việt Nam", "Xin chao Viet Nam"), ("й Ё", "и Е"), ("ά ΐ ὕ", "α ι υ"), ("が ガ", "か カ"), ("กินดี", "กินดี"),
              ("हिन्दी", "हिनदी"), ("각", "\u1100\u1161\u11a8"), ("đ Đ", "đ Đ"), ("≠", "="), (None, None)]
    df = spark.createDataFrame(golden, "t string, want string")
    for r in df.select("want", fold_diacritics("t").alias("got")).collect():
        assert r.got == r.want


def test_fold_diacritics_of_long_texts(spark):
    # Eight million characters took over a minute when each met a class of all marks and one of all letters.
    rows = [(i, "Tiếng Việt và cà phê, naïve café. plain words " * 2200) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(4).cache()
    df.count()
    start = time.perf_counter()
    got = df.select(fold_diacritics("t").alias("f")).groupBy("f").count().collect()
    assert time.perf_counter() - start < 12
    assert [(r.f, r["count"]) for r in got] == [("Tieng Viet va ca phe, naive cafe. plain words " * 2200, 80)]


def test_live_books_only(spark):
    import __spark_entry__ as Q
    src = testdata.load(spark, SF0001)
    live = {r.book_id for r in S.live_books(src.books).collect()}
    dead = {r.book_id for r in src.books.collect()} - live
    assert dead
    q = Q.queries()
    assert not dead & {r.book_id for r in q["content_recommend"](spark, SF0001).collect()}
    similar = q["similar_items"](spark, SF0001).collect()
    assert not dead & ({r.book_id for r in similar} | {r.similar_book_id for r in similar})


def test_rating_only_falls_back_to_the_catalogue(spark):
    log = spark.createDataFrame([(1, 2.0, "history")], "book_id long, strength double, type string")
    books = spark.createDataFrame([(1, 4.5), (2, None)], "book_id long, mean_rating double")
    assert [tuple(r) for r in mean_rating_only(log, books).collect()] == [(1, 4.5)]
    assert [tuple(r) for r in rating_map_of(log).collect()] == [(1, 2.0)]


def test_store_map(spark):
    log = spark.createDataFrame([(1, 2, None, 3.0, "rating"), (1, 2, None, 2.0, "rating"), (1, 2, None, 1.0, "history")],
                                "user_id long, book_id long, ts timestamp, strength double, type string")
    r = interaction_store_map(log).first()
    assert (r.total, r.details) == (6.0, {"rating": 5.0, "history": 1.0}) and interaction_store(log).first().total == 6.0


def _length_model():
    def predict(texts):
        return np.stack([[len(t), 1.0] for t in texts]).astype("float32")
    return predict


def test_encoders(spark):
    books = spark.createDataFrame([(1, "Ab", "x", "", "", "", 2000), (2, "Long title", None, "", "", "", None)],
                                  "book_id long, title string, description string, authors_text string, genres_text string, publisher string, publication_year int")
    raw = {r.book_id: r.embedding for r in model_encode(books, _length_model, 2).collect()}
    assert raw == {1: [float(len("ab x 2000")), 1.0], 2: [float(len("long title")), 1.0]}
    for df in (encode_items(books), encode_items(books, make_predict_fn=_length_model, dim=2)):
        for r in df.collect():
            assert math.isclose(sum(x * x for x in r.embedding), 1.0)
    table = spark.createDataFrame([(1, [3.0, 4.0]), (9, [1.0, 0.0])], "book_id long, embedding array<double>")
    assert [tuple(r) for r in encode_items(books, table).collect()] == [(1, [0.6, 0.8])]


def test_table_reader_and_load_all(spark, tmp_path):
    src = testdata.load(spark, SF0001)
    for t in ("books", "authors", "book_authors", "genres", "book_genres", "ratings", "reading_history", "favorites"):
        src.view(t).write.parquet(str(tmp_path / t))
    reader = S.TableReader(spark, base=str(tmp_path))
    books, log = S.load_all(src)
    assert sorted(map(tuple, reader.load_books().collect()), key=str) == sorted(map(tuple, books.collect()), key=str)
    assert sorted(map(tuple, reader.load_interactions().collect()), key=str) == sorted(map(tuple, log.collect()), key=str)


def _log(spark, n=400):
    rng = np.random.default_rng(3)
    import datetime
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(int(u), int(b), t0 + datetime.timedelta(minutes=i), float(1 + b % 5), "rating") for i, (u, b) in enumerate(rng.integers(0, 20, (n, 2)))]
    return spark.createDataFrame(rows, "user_id long, book_id long, ts timestamp_ntz, strength double, type string")


def test_jobs_and_loaded_models(spark, tmp_path):
    from shelfwise.operators.cf import als_recommend, als_train
    from shelfwise.operators.interactions import seen_pairs
    log = _log(spark)
    emb = spark.createDataFrame([(b, [float(b % 3), 1.0]) for b in range(20)], "book_id long, embedding array<double>")
    books = spark.createDataFrame([(b, f"t{b}", "d", "p", 2000, "", "") for b in range(19)],
                                  "book_id long, title string, description string, publisher string, publication_year int, authors_text string, genres_text string")
    base = str(tmp_path / "m")
    m = {(r.metric, r.k): r.value for r in TR.train_job(spark, books, log, emb, base, k=5, rank=4, max_iter=3).collect()}
    assert m["coverage", 5] > 0
    saved = TR.load_models(spark, base)
    cf, seen = saved.cf(), saved.tables["seen"]
    assert saved.metadata["als_factors"] == 4 and cf.user_factors().count() > 0
    fitted = als_train(log, rank=4, max_iter=3)
    path = TR.save_models(spark, base, {"user_factors": fitted.user_factors(), "item_factors": fitted.item_factors()}, {"a": 1}, "z")
    loaded = TR.load_models(spark, base)
    assert path.endswith("v=z") and loaded.metadata == {"a": 1}
    lists = lambda f: sorted((r.user_id, r.rank, r.book_id, round(r.score, 9)) for r in als_recommend(f, seen_pairs(log), 5).collect())
    assert lists(fitted) == lists(loaded.cf())
    with pytest.raises(FileExistsError):
        TR.save_models(spark, base, {}, {}, "z")
    with pytest.raises(FileNotFoundError):
        TR.load_models(spark, str(tmp_path / "none"))
    with pytest.raises(Exception):
        TR.load_models(spark, base, "gone")
    users = spark.createDataFrame([(1,), (777,)], "user_id long")
    recs = saved.recommend(users, 4).collect()
    assert {r.user_id for r in recs} == {1, 777} and {r.path for r in recs if r.user_id == 777} == {"popularity"}
    base = str(tmp_path / "l")
    m = {(r.metric, r.k) for r in TR.train_latent_job(spark, books, log, emb, base, rank=3, max_iter=2).collect()}
    report = {(r.kind, r.name): r.value for r in TR.model_report(spark, base).collect()}
    assert report["parameter", "latent_dim"] == 3 and report["rows", "user_factors"] == 20 and report["metric", "rmse"] > 0
    assert {x for x, _ in m} == {"mse", "rmse", "hit_rate@5", "hit_rate@10", "coverage@5", "coverage@10"}
    assert TR.load_models(spark, base).recommend(users, 4).where("user_id = 1").count() == 4


def test_coverage_counts_the_users_that_lists_are_made_for(spark, tmp_path):
    """Early users who never come back still count."""
    import datetime
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(u, b, t0 + datetime.timedelta(days=u), 1.0 + b, "rating") for u in range(10) for b in range(3)]
    log = spark.createDataFrame(rows, "user_id long, book_id long, ts timestamp_ntz, strength double, type string")
    emb = spark.createDataFrame([(b, [1.0, float(b)]) for b in range(6)], "book_id long, embedding array<double>")
    books = spark.createDataFrame([(b, "t", "d", "p", 2000, "", "") for b in range(6)],
                                  "book_id long, title string, description string, publisher string, publication_year int, authors_text string, genres_text string")
    m = {r.metric: r.value for r in TR.train_job(spark, books, log, emb, str(tmp_path / "m"), k=3, rank=2, max_iter=2, coverage_users=4).collect()}
    assert m["coverage"] == 1.0 and m["coverage_catalog"] == 0.5


def _feedback(spark, rows):
    import datetime
    t0 = datetime.datetime(2024, 2, 1)
    return spark.createDataFrame([(i, t0 + datetime.timedelta(minutes=i), u, b, e, v) for i, u, b, e, v in rows], FB.FEEDBACK_SCHEMA)


def test_an_epoch_that_runs_again(spark, tmp_path):
    table = str(tmp_path / "t")
    write = FB.write_epoch(table)
    first = _feedback(spark, [(1, 1, 7, "rating", 4), (2, 1, 7, "rating", 2), (3, 2, 8, "favorite", None), (4, 2, 8, "nonsense", None)])
    second = _feedback(spark, [(5, 1, 7, "rating", 5), (6, 3, 7, "history", None)])
    write(first, 0)
    # Epoch 1 broke off after its changes were written: it doesn't count until it is whole.
    write(second, 1)
    (tmp_path / "t" / "done" / "epoch=1").rename(tmp_path / "broken")
    pop = spark.createDataFrame([(7, 10)], "book_id long, cnt long")
    state = lambda: (sorted((r.user_id, r.book_id, r.type, r.strength, r.n_events) for r in FB.read_latest(spark, table).collect()),
                     sorted(map(tuple, FB.read_popularity(spark, table, pop).collect())))
    assert state() == ([(1, 7, "rating", 2.0, 2), (2, 8, "favorite", 5.0, 1)], [(7, 12), (8, 1)])
    write(second, 1)
    whole = ([(1, 7, "rating", 5.0, 3), (2, 8, "favorite", 5.0, 1), (3, 7, "history", 1.0, 1)], [(7, 14), (8, 1)])
    assert state() == whole
    write(first, 0)
    assert state() == whole
    assert FB.compact(spark, table) == 1 and FB.compact(spark, table) is None and state() == whole
    write(_feedback(spark, [(7, 1, 7, "rating", 1)]), 2)
    assert state()[0][0] == (1, 7, "rating", 1.0, 4)
    assert spark.read.parquet(f"{table}/rejects").count() == 1


def test_online_learning_stops_and_goes_on(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    _feedback(spark, [(1, 1, 7, "rating", 4)]).write.parquet(src)
    base = spark.createDataFrame([(1, 7, "rating", 2.0), (1, 8, "history", 1.0)], "user_id long, book_id long, type string, strength double")
    items = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "book_id long, embedding array<double>")
    job = FB.OnlineLearning(spark, src, table, str(tmp_path / "c"), base, items)
    job.flush()
    assert not job.enabled
    old = spark.createDataFrame([(1, [1.0, 0.0])], "user_id long, profile array<double>")
    profile = lambda: FB.read_profiles(spark, table, old).first().profile
    assert np.allclose(profile(), np.array([4.0, 1.0]) / math.sqrt(17))
    _feedback(spark, [(2, 1, 7, "rating", 1)]).write.mode("append").parquet(src)
    job.enable(files_per_trigger=1)
    assert job.enabled
    job.query.processAllAvailable()
    job.disable()
    assert not job.enabled and np.allclose(profile(), np.array([1.0, 1.0]) / math.sqrt(2))


def test_scorer_runs_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from shelfwise.session import get_session
from shelfwise.plans.registry import QUERIES
spark = get_session("local[2]", 2)
assert QUERIES["content_recommend"](spark, {SF0001!r}).count() > 0
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_callers_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "32m")
    try:
        items = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id long, v array<double>")
        assert exact_topk(items, "id", "v", items, "id", "v", 1).count() == 2 and spark.conf.get(key) == "32m"
    finally:
        spark.conf.set(key, old)
