"""Line dedup: the filter against a list, the index against plain dictionaries, the query against its SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np

from shelfwise.llm import line_dedup
from shelfwise.llm.common import shared_folder
from shelfwise.llm.cuckoo import CuckooFilter
from shelfwise.llm.queries import ORACLE, op12_line_dedup
from tests.conftest import SF0001
from tests.llm import helpers

SCHEMA = "doc_id long, text string"


def slow_key(line, least=20):
    line = line.strip(" \t\n\x0b\x0c\r")
    line = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return line if len(line) >= least else None


def slow_clean(rows, docs, least=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, text) of ``docs`` under an index that holds ``rows``."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None and (k := slow_key(line, least)):
                holders[k].add(doc_id)
    out = Counter()
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        gone = [(k := slow_key(x, least)) is not None and len(holders[k]) >= min_docs and doc_id in holders[k] and doc_id != max(holders[k])
                for x in lines]
        kept = None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g)
        out[doc_id, len(lines), sum(gone), kept] += 1
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    pool = [f"a common line number {i} of the pool" for i in range(30)] + ["short", "", "  ", "É" * 19, "É" * 20, "x" * 20]
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))] + [f"a line of document {i} alone, nobody else's"]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.2 else f" {x}\t" if rng.random() < 0.2 else x for x in lines)))
    return rows


def cleaned(index, spark, rows):
    out = index.clean(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return Counter(map(tuple, out))


def test_filter_against_a_set():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 3000):
        hashes = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        one = CuckooFilter(n)
        one.insert(hashes[: n // 2])
        one.insert(hashes[n // 2:])
        one = CuckooFilter.from_bytes(one.to_bytes())
        assert one.contains(hashes).all() and one.n == n
        one.delete(hashes[::3])
        left = np.delete(hashes, np.s_[::3])
        assert one.contains(left).all()
        others = rng.integers(0, 1 << 63, 20000, dtype=np.int64).astype(np.uint64)
        assert one.contains(others).mean() < 0.002
        one.delete(left)
        assert not one.slots.any() and not len(one.rest)


def test_filter_keeps_equal_prints_apart():
    one = CuckooFilter(8)
    same = np.full(30, 77, np.uint64)
    one.insert(same)
    assert len(one.rest) == 22
    one.delete(same[:29])
    assert one.contains(same[:1]).all()
    one.delete(same[:1])
    assert not one.contains(same[:1]).any()


def test_inserts_and_deletions_against_dictionaries(spark):
    rows = corpus(60)
    a, b, c = rows[:25], rows[25:40], rows[40:]
    index = line_dedup.LineIndex(spark, shared_folder(spark, "lines"), shards=5)
    index.insert(spark.createDataFrame(a, SCHEMA))
    assert cleaned(index, spark, rows) == slow_clean(a, rows)
    index.insert(spark.createDataFrame(b + c, SCHEMA))
    assert cleaned(index, spark, rows) == slow_clean(rows, rows)
    index.delete(spark.createDataFrame(a[5:] + c, SCHEMA))
    index = line_dedup.LineIndex(spark, index.folder)  # opened again from its files
    assert index.shards == 5 and len(index.parts) == 3
    left = a[:5] + b
    assert cleaned(index, spark, rows) == slow_clean(left, rows)
    # Deleting what isn't in changes nothing; after deleting the rest no key is left.
    index.delete(spark.createDataFrame(c, SCHEMA))
    assert cleaned(index, spark, rows) == slow_clean(left, rows)
    index.delete(spark.createDataFrame(left, SCHEMA))
    assert index.counts().isEmpty() and index.refs().isEmpty()
    for shard in range(5):
        files = line_dedup.FilterFiles(index._filters())
        assert files.get("seen", shard).n == files.get("repeated", shard).n == 0


def test_full_filters_are_built_again(spark):
    index = line_dedup.LineIndex(spark, shared_folder(spark, "lines"), shards=2)
    rows = corpus(90, seed=5)
    index.insert(spark.createDataFrame(rows[:4], SCHEMA))
    before = line_dedup.FilterFiles(index._filters()).get("seen", 0).capacity
    index.insert(spark.createDataFrame(rows[4:], SCHEMA))
    assert line_dedup.FilterFiles(index._filters()).get("seen", 0).capacity > before
    assert cleaned(index, spark, rows) == slow_clean(rows, rows)


def test_common_line_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows = [(i, f"this line stands in every document\nbut this line stands in {i // 4} alone\nown line {i} " + "y" * 20) for i in range(40)]
    for n in (1, 4, 1000):
        monkeypatch.setattr(line_dedup, "COMMON_KEYS", n)
        index = line_dedup.LineIndex(spark, shared_folder(spark, "lines")).insert(spark.createDataFrame(rows, SCHEMA))
        assert cleaned(index, spark, rows) == slow_clean(rows, rows)


def test_rows_of_every_kind(spark):
    rows = [(r[0], r[1]) for r in helpers.rows()]
    out = line_dedup.dedup_lines(helpers.clashing(spark))
    assert set(out.columns) == set(helpers.clashing(spark).columns) | {"n_lines", "n_dropped"}
    got = Counter(map(tuple, out.select("doc_id", "n_lines", "n_dropped", "text").collect()))
    assert got == slow_clean(rows, rows)
    assert line_dedup.dedup_lines(helpers.empty(spark)).isEmpty()
    index = line_dedup.LineIndex(spark, shared_folder(spark, "lines"))
    assert cleaned(index, spark, rows[:2]) == slow_clean([], rows[:2])
    index.delete(helpers.docs(spark))
    assert index.counts().isEmpty()


def test_query_against_sql_and_dictionaries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, op12_line_dedup(spark, SF0001).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    assert got == Counter(con.execute(ORACLE["op12_line_dedup"]).fetchall())
    slow = Counter()
    for (d, n, g, text), k in slow_clean(rows, rows).items():
        slow[d, n, g, hashlib.sha256((text or "").encode()).hexdigest()] += k
    assert got == slow
