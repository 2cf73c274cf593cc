import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfwise.llm import sharding, simhash
from shelfwise.llm.components import components
from shelfwise.llm.queries import SHARDS, op2_simhash_near_dedup
from tests.conftest import SF0001
from tests.llm import helpers


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values, max_bits):
    """Root of each value by all pairs."""
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    values = sorted(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= max_bits:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def expected(rows, max_bits=2):
    prints = [slow_fingerprint(t) for _, t in rows]
    root = roots(prints, max_bits)
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    return Counter((d, f"{p:016x}", least.get(root[p])) for (d, _), p in zip(rows, prints))


def test_query_against_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    got = op2_simhash_near_dedup(spark, SF0001).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == expected(rows)


def test_odd_rows(spark):
    want = expected([(r[0], r[1]) for r in helpers.rows()])
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
        kept = simhash.drop_near_duplicates(df)
        assert kept.columns == df.columns
        groups = {(c if c is not None else "none") for _, _, c in want}
        ids = [r["doc_id"] for r in kept.collect()]
        assert Counter(ids) == Counter(None if g == "none" else g for g in groups)
    assert simhash.near_duplicates(helpers.empty(spark)).collect() == []
    assert simhash.drop_near_duplicates(helpers.empty(spark)).collect() == []


@pytest.mark.parametrize("max_bits, limit", [(0, 64), (1, 2), (2, 64), (2, 3), (3, 2), (3, 64)])
def test_links_of_dense_and_spread_values(spark, max_bits, limit):
    rng = random.Random(max_bits)
    values = {rng.getrandbits(64) for _ in range(40)} | {0}
    for center in list(values)[:4]:
        for _ in range(60):
            v = center
            for b in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << b
            values.add(v)
        values |= {center ^ 1 << b for b in range(0, 64, 9)}
    signed = [(simhash._signed(v),) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), max_bits, limit).collect()
    unsigned = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links]
    assert all((a ^ b).bit_count() <= max_bits for a, b in unsigned)
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in unsigned:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == roots(values, max_bits)


def test_pivots_discard_no_link():
    pivots = simhash.Pivots(2)
    rng = random.Random(1)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        keys = []
        for x in (a, b):
            base = (x ^ pivots.base).bit_count()
            keys.append([tuple((x ^ p).bit_count() - base for p in own) for own in pivots.inside])
        assert any(all(keys[0][i] == keys[1][i] for i in c) for c in pivots.choices)
        assert all(abs((a ^ p).bit_count() - (b ^ p).bit_count()) <= 2 for p in pivots.whole)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(500, 500), (600, 601), (601, 600), (None, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 600: 600, 601: 600, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sharding_table():
    size = sharding.table_size(64)
    table = sharding.fill_table(SHARDS)
    assert len(table) == size and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(SHARDS[:-1], size)
    moved = sum(a != b for a, b in zip(table, fewer)) / size
    assert 1 / 64 <= moved < 5 / 64
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


def test_sharding_odd_rows_and_plan(spark):
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        out = sharding.place(df, "doc_id", SHARDS)
        rows = out.collect()
        assert len(rows) == len(helpers.rows())
        assert set(out.columns) == {*df.columns, "slot", "shard"}
        by_id = {}
        for r in rows:
            assert by_id.setdefault(r["doc_id"], r["shard"]) == r["shard"] and r["shard"] in SHARDS
    assert sharding.place(helpers.empty(spark), "doc_id", SHARDS).collect() == []
    plan = sharding.place(spark.range(10).withColumnRenamed("id", "doc_id"), "doc_id", SHARDS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan
