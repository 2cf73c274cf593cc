"""Pairs in cells against a plain join: same pairs, same numbers, and no factors beside each pair."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import neural as N
from shelfwise.operators import paircells as PC
from shelfwise.operators.cf import CFModel, als_train

DIM = 5


def factors(spark, n, name, rng, kind):
    m = rng.normal(size=(n, DIM)).astype(np.float32 if kind == "float" else np.float64)
    return m, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, features array<{kind}>").checkpoint()


@pytest.fixture(scope="module", params=["float", "double"])
def model(spark, request):
    rng = np.random.default_rng(0)
    (p, users), (q, items) = factors(spark, 40, "user_id", rng, request.param), factors(spark, 25, "book_id", rng, request.param)
    return p, q, CFModel(users, items)


def log(spark):
    """Pairs with both factors, twice some, and pairs with unknown or null ids."""
    rng = np.random.default_rng(1)
    rows = [(int(u), int(b), float(rng.integers(1, 6)), f"n{u}") for u in range(0, 44, 2) for b in rng.choice(28, 15, replace=False)]
    return rows + rows[:30] + [(None, 3, 1.0, None), (3, None, 2.0, "x"), (4, 5, None, None)]


@pytest.mark.parametrize("side_bytes,task_pairs", [(1 << 25, 1 << 16), (300, 8), (120, 1)])
def test_scores_of_cells_are_those_of_a_join(spark, model, monkeypatch, side_bytes, task_pairs):
    monkeypatch.setattr(PC, "SIDE_BYTES", side_bytes)
    monkeypatch.setattr(PC, "TASK_PAIRS", task_pairs)
    p, q, cf = model
    rows = log(spark)
    pairs = spark.createDataFrame(rows, "user_id long, book_id long, strength double, note string").repartition(3)
    got = PC.scored(pairs, cf, lambda a, b: (a * b).sum(1))
    assert got.columns == [*pairs.columns, "prediction"]
    want = [(u, b, s, n, round(float(p[u].astype(float) @ q[b].astype(float)), 6)) for u, b, s, n in rows
            if u is not None and b is not None and u < 40 and b < 25]
    found = [(r.user_id, r.book_id, r.strength, r.note, round(r.prediction, 6)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_ids_without_pairs_and_few_pairs_in_a_large_grid(spark, model):
    p, q, cf = model
    pairs = spark.createDataFrame([(1, 2, "a"), (39, 24, "b"), (77, 1, "c")], "user_id long, book_id long, note string")
    cells = PC.in_cells(pairs, cf, (6, 5), (3, 40, 25))  # far more ids than pairs: only those needed are sent
    assert {r["side"]: r["n"] for r in cells.groupBy("side").agg(F.count("*").alias("n")).collect()} == {0: 2, 1: 3, 2: 3}
    out = cells.mapInArrow(lambda x: map(_told, PC.blocks(x)), "note string, s double")
    assert {r.note: round(r.s, 6) for r in out.collect()} == {"a": round(float(p[1].astype(float) @ q[2]), 6), "b": round(float(p[39].astype(float) @ q[24]), 6)}


def _told(b):
    import pyarrow as pa
    x, y = b.factors()
    return pa.record_batch([b.column("note"), pa.array((x * y).sum(1))], names=["note", "s"])


@pytest.mark.parametrize("partition_rows", [1 << 16, 40])
def test_training_rows_hold_factors_once_for_each_cell(spark, model, monkeypatch, partition_rows):
    monkeypatch.setattr(PC, "PACKED_PAIRS", 7)
    monkeypatch.setattr(PC, "PACKED_FACTORS", 3)
    p, q, cf = model
    rows = {(u, b): s for u, b, s, _ in log(spark) if s is not None}
    pairs = spark.createDataFrame([(u, b, s, (u or 0) % 4 == 0) for (u, b), s in rows.items()], "user_id long, book_id long, strength double, held boolean")
    table = N.pair_rows(pairs, cf, partition_rows)
    assert (table.rdd.getNumPartitions() == 1) == (partition_rows > 1000)
    # Factors beside each pair were 2 * DIM numbers a pair.
    kept = table.agg(F.sum(F.size(F.coalesce("p", F.array())) + F.size(F.coalesce("q", F.array())))).first()[0]
    one, columns = PC.grid_of_cells(max(1, round(len(rows) / partition_rows)), 40, 25)
    assert kept == DIM * (40 * columns + 25 * one)
    for part in table.rdd.glom().collect():
        sizes = [len(r["u"]) for r in part if r["u"] is not None]
        assert all(n == 7 for n in sizes[:-1])
    blocks = table.mapInArrow(_listed, "p array<double>, q array<double>, y double, held boolean").collect()
    found = sorted((tuple(np.round(r.p, 6)), tuple(np.round(r.q, 6)), r.y, r.held) for r in blocks)
    want = sorted((tuple(np.round(p[u].astype(float), 6)), tuple(np.round(q[b].astype(float), 6)), s, u % 4 == 0) for (u, b), s in rows.items()
                  if u is not None and b is not None and u < 40 and b < 25)
    assert found == want


def _listed(batches):
    import pyarrow as pa
    for p, q, y, held in N._packed_blocks(batches):
        yield pa.record_batch([pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(q.tolist(), pa.list_(pa.float64())), pa.array(y), pa.array(held)],
                              names=["p", "q", "y", "held"])


def test_packed_rows_train_as_plain_ones(spark, model):
    """One cell: the same head as from rows with factors beside each pair, in the same order."""
    p, q, cf = model
    rows = {(u, b): s for u, b, s, _ in log(spark) if u is not None and b is not None and s is not None and u < 40 and b < 25}
    pairs = spark.createDataFrame([(u, b, s, u % 4 == 0) for (u, b), s in rows.items()], "user_id long, book_id long, strength double, held boolean")
    h = F.xxhash64("user_id", "book_id")
    plain = (pairs.join(cf.user_factors().withColumnRenamed("features", "p"), "user_id").join(cf.item_factors().withColumnRenamed("features", "q"), "book_id")
             .coalesce(1).sortWithinPartitions(F.xxhash64(h), h).select("p", "q", F.col("strength").alias("y"), "held").checkpoint())
    head = N.start_head(DIM, (8, 4), scale=(1.0, 1.0, 1.5))
    (a, x), (b, y) = N.train_head(N.pair_rows(pairs, cf), head, 3, 32, 0.01), N.train_head(plain, head, 3, 32, 0.01)
    assert np.allclose(x, y, rtol=1e-12) and np.allclose(a.flat(), b.flat(), rtol=1e-10)


def test_grids():
    for cells, users, items in ((1, 10, 10), (340, 540_000, 100), (340, 540_000, 36_000), (62_500, 10 ** 8, 10 ** 7), (340, 100, 540_000)):
        rows, columns = PC.grid_of_cells(cells, users, items)
        assert 0.5 * cells <= rows * columns <= 2 * cells
        assert users * columns + items * rows <= 1.5 * min(users * c + items * cells / c for c in range(1, cells + 1)) + users + items
    assert PC.grid_of_bytes(10, 10, 10, 512, 8) == (1, 1)
    rows, columns = PC.grid_of_bytes(22_000_000, 540_000, 36_000, 512, 8)
    assert columns == 1 and rows == 9


def test_fit_leaves_no_shuffle_files(spark):
    tracked = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    rng = np.random.default_rng(5)
    rows = [(int(u), int(b), float(rng.integers(1, 6))) for u in range(30) for b in rng.choice(20, 8, replace=False)]
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = tracked()
    cf = als_train(spark.createDataFrame(rows, "user_id long, book_id long, strength double"), rank=3, max_iter=8, implicit=False)
    until = time.time() + 30
    while tracked() > before + 2 and time.time() < until:
        time.sleep(0.5)
    assert tracked() <= before + 2  # two for each iteration, and those of the joins, before
    assert cf.user_factors().count() == 30 and cf.item_factors().schema["features"].dataType.simpleString() == "array<double>"
