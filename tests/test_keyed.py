"""JSON intake, keyed feedback state and profiles kept as sums, against plain dictionaries and recomputation."""

import json
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from shelfwise.operators.content import user_profiles
from shelfwise.session import scratch_path
from shelfwise.streaming import feedback as FB
from shelfwise.streaming import keyed as KS
from shelfwise.streaming.intake import parse_feedback

LINES = [
    ('{"event_id": 1, "ts": "2024-01-01 10:00:00", "user_id": 1, "book_id": 2, "event": "rating", "rating_value": 4}', None),
    ('{"user_id": "7", "book_id": 2, "event": "history", "device": {"os": "x"}, "tags": [1, 2]}', None),
    ('{"user_id": 7, "book_id": 2, "event": "favorite", "rating_value": null}', None),
    ('  {"user_id": 7, "book_id": 2, "event": "rating", "rating_value": 9}', FB.REJECT_RANGE),
    ('{"user_id": 7, "book_id": 2, "event": "rating"}', FB.REJECT_RATING),
    ('{"user_id": 7, "book_id": 2, "event": "share"}', FB.REJECT_EVENT),
    ('{"user_id": 7, "book_id": 2}', FB.REJECT_EVENT),
    ('{"user_id": 7.5, "book_id": 2, "event": "history"}', "bad_type"),
    ('{"user_id": 7, "book_id": "two", "event": "history"}', "bad_type"),
    ('{"user_id": 7, "book_id": 2, "event": {"a": 1}}', "bad_type"),
    ('{"user_id": 7, "book_id": 2, "event": "history", "ts": "yesterday"}', "bad_type"),
    ('{"user_id": 7, "book_id": 2, "event": "rating", "rating_value": [4]}', "bad_type"),
    ('{"book_id": 2, "event": "history"}', "missing_user"),
    ('{"user_id": 7, "book_id": null, "event": "history"}', "missing_book"),
    ('{"user_id": 7, "book_id": 2, "event": "hist', "malformed"),
    ("not json", "malformed"), ("", "malformed"), ("   ", "malformed"), ("5", "malformed"), ("null", "malformed"),
    ('[{"user_id": 7, "book_id": 2, "event": "history"}]', "malformed"),
    ('"{}"', "malformed"), ("{}", "missing_user"),
]


def test_every_line_is_judged(spark):
    got = FB.feedback_strength(parse_feedback(spark.createDataFrame([(x,) for x, _ in LINES], "value string"))).collect()
    assert {r["raw"]: r["reject_reason"] for r in got} == dict(LINES) and len(got) == len(LINES)
    assert all((r["strength"] is None) == (r["reject_reason"] is not None) for r in got)
    one = next(r for r in got if r["event_id"] == 1)
    assert (one["user_id"], one["book_id"], one["event"], one["strength"], str(one["ts"])) == (1, 2, "rating", 4.0, "2024-01-01 10:00:00")


def folder(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def write_lines(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def events(n, seed, users=6, books=9):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        e = {"event_id": i, "ts": f"2024-02-{rng.randint(1, 20):02d} 08:00:{rng.randint(0, 3):02d}.{rng.randint(0, 2)}", "user_id": rng.randrange(users),
             "book_id": rng.randrange(books), "event": rng.choice(["rating", "favorite", "favorite", "history"])}
        if e["event"] == "rating":
            e["rating_value"] = rng.randint(1, 5)
        elif e["event"] == "favorite" and rng.random() < 0.5:
            e["rating_value"] = 0
        out.append(e)
    return out


def strength(e):
    return {"rating": lambda: float(e["rating_value"]), "favorite": lambda: 0.0 if e.get("rating_value") == 0 else 5.0, "history": lambda: 1.0}[e["event"]]()


def newest(seen):
    last = {}
    for e in seen:
        k = (e["user_id"], e["book_id"], e["event"])
        last[k] = max(last.get(k, ("", -1, 0.0)), (e["ts"].ljust(26, "0"), e["event_id"], strength(e)))
    return {k: v[2] for k, v in last.items()}


def run(spark, source, base, **more):
    for query in KS.keyed_stream(spark, source, f"{base}/table", f"{base}/checkpoint", json=True, **more):
        query.awaitTermination()
    return f"{base}/table"


def test_state_goes_on_after_a_restart(spark):
    base, source, all_ = folder(spark, "keyed"), folder(spark, "lines"), events(300, 1)
    lines = [x for x, reason in LINES if reason]
    for i, part in enumerate((all_[:100], all_[100:103], all_[103:])):
        write_lines(spark, source, [json.dumps(e) for e in part] + lines[3 * i:3 * i + 3])
        table = run(spark, source, base)
        # An epoch holds the batch's keys and no others.
        keys = spark.read.parquet(f"{table}/changes").where(F.col("epoch") == i)
        assert {tuple(r) for r in keys.select("user_id", "book_id", "type").collect()} == {(e["user_id"], e["book_id"], e["event"]) for e in part}
        assert keys.agg(F.sum("n_events")).first()[0] == len(part)
    got = {(r["user_id"], r["book_id"], r["type"]): r["strength"] for r in FB.read_latest(spark, table).collect()}
    assert got == newest(all_)
    old = {(r["user_id"], r["book_id"], r["type"]): r["old"] for r in spark.read.parquet(f"{table}/changes").where("epoch = 1").collect()}
    before = newest(all_[:100])
    assert old == {k: before.get(k) for k in old}
    rejects = spark.read.parquet(f"{table}/rejects")
    assert rejects.count() == 9 and {r["raw"] for r in rejects.collect()} == set(lines[:9])
    assert FB.read_popularity(spark, table, spark.createDataFrame([], "book_id long, cnt long")).agg(F.sum("cnt")).first()[0] == 300


def test_sums_equal_recomputed_profiles(spark):
    rng, base, source, all_ = np.random.default_rng(4), folder(spark, "keyed"), folder(spark, "lines"), events(1000, 2, users=8)
    items = spark.createDataFrame([(b, rng.normal(size=5).tolist()) for b in range(8)], "book_id long, embedding array<double>").checkpoint()  # book 8 has none
    log = spark.createDataFrame([(int(u), int(b), t, float(rng.integers(0, 4)) + 0.1) for u in range(1, 10) for b in rng.choice(9, 4, replace=False)
                                 for t in ("rating", "favorite")], "user_id long, book_id long, type string, strength double").checkpoint()
    start, per_book = KS.base_sums(log, items), log.groupBy("user_id", "book_id").agg(F.sum("strength").alias("total"))
    profiles = user_profiles(per_book, items)

    def check(seen):
        got = {r["user_id"]: np.array(r["profile"]) for r in KS.read_keyed_profiles(spark, table, start, profiles).collect()}
        latest = spark.createDataFrame([(*k, v) for k, v in newest(seen).items()], "user_id long, book_id long, type string, strength double")
        touched = latest.select("user_id").distinct()
        expected = FB.profile_refresh(per_book, FB.apply_latest(log, latest), touched, items)
        want = {r["user_id"]: np.array(r["profile"]) for r in expected.collect()}
        assert got and got.keys() == want.keys()
        assert all(np.allclose(got[u], want[u], atol=1e-9) for u in got)

    for i, cut in enumerate((10, 500, 1000)):
        write_lines(spark, source, [json.dumps(e) for e in all_[(0, 10, 500)[i]:cut]])
        table = run(spark, source, base, base_details=log, items=items)
        check(all_[:cut])
        if i == 1:
            assert KS.rebuild_sums(spark, table, items) == 1
            check(all_[:cut])
            assert KS.rebuild_sums(spark, table, items) is None


def test_weights_that_are_gone_leave_the_base_profile(spark):
    base, source = folder(spark, "keyed"), folder(spark, "lines")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "book_id long, embedding array<double>").checkpoint()
    log = spark.createDataFrame([(5, 1, "favorite", 5.0), (6, 2, "history", 1.0)], "user_id long, book_id long, type string, strength double").checkpoint()
    write_lines(spark, source, [json.dumps({"user_id": 5, "book_id": 1, "event": "favorite", "rating_value": 0}),
                                json.dumps({"user_id": 9, "book_id": 77, "event": "history"})])
    table = run(spark, source, base, base_details=log, items=items)
    profiles = user_profiles(log.select("user_id", "book_id", F.col("strength").alias("total")), items)
    got = {r["user_id"]: r["profile"] for r in KS.read_keyed_profiles(spark, table, KS.base_sums(log, items), profiles).collect()}
    assert got == {5: [1.0, 0.0]}  # user 9's book has no vector, user 6 wasn't touched


def test_state_is_kept_by_buckets_of_keys(spark, monkeypatch):
    """As many groups as buckets, however many keys; each key still has its own newest event."""
    monkeypatch.setattr(KS, "KEY_BUCKETS", 3)
    base, source, all_ = folder(spark, "keyed"), folder(spark, "lines"), events(200, 5)
    for e in all_:
        e["user_id"] += (1 << 60) + 1  # more digits than a double has
    for part in (all_[:120], all_[120:]):
        write_lines(spark, source, [json.dumps(e) for e in part])
        queries = KS.keyed_stream(spark, source, f"{base}/table", f"{base}/checkpoint", json=True)
        for q in queries:
            q.awaitTermination()
        assert queries[0].lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    got = {(r["user_id"], r["book_id"], r["type"]): r["strength"] for r in FB.read_latest(spark, f"{base}/table").collect()}
    assert got == newest(all_) and len(got) > 3
