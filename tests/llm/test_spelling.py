"""Spelling variants: the index against comparing all pairs, the query against its SQL and a plain form."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import spelling
from shelfwise.llm.queries import ORACLE, op13_spelling_groups
from tests.conftest import SF0001
from tests.llm import helpers


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_vocabulary(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def slow_variants(words):
    out, forms = set(), {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return out


def made_up(seed, n, letters):
    rng = random.Random(seed)
    words = {}
    while len(words) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(6, 11)))
        words[w] = rng.choice([5, 6, 30, 160, 900, 5000])
        for _ in range(rng.randint(0, 3)):  # variants of it
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]])
            if len(v) >= 6:
                words.setdefault(v, rng.choice([5, 6, 30, 160]))
    return words


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "eéèÉ×ÿ𝒳"])
def test_index_against_all_pairs(letters):
    rng = random.Random(len(letters))
    for n in (0, 1, 63, 64, 200):
        words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)})
        queries = words[:70] + ["".join(rng.choice(letters + "z") for _ in range(rng.randint(1, 10))) for _ in range(40)] + ["", "zz", "zz"]
        q, w = spelling.PositionIndex(words).near(queries)
        assert sorted(zip(q.tolist(), w.tolist())) == sorted(
            (i, j) for i, a in enumerate(queries) if a for j, b in enumerate(words) if one_edit(a, b))


def test_steps_of_queries_give_the_same(monkeypatch):
    words = list(made_up(4, 300, "abcd"))
    whole = sorted(zip(*(x.tolist() for x in spelling.PositionIndex(words).near(words))))
    monkeypatch.setattr(spelling, "QUERIES", 17)
    assert sorted(zip(*(x.tolist() for x in spelling.PositionIndex(words).near(words)))) == whole


@pytest.mark.parametrize("block, slice_", [(1 << 20, 1 << 14), (500, 1 << 14), (500, 3)])
def test_variants_in_blocks_and_slices(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(spelling, "BLOCK_CHARS", block)
    monkeypatch.setattr(spelling, "SLICE_WORDS", slice_)
    words = made_up(7, 150, "abc") | {"aaaaaa" + "".join(random.Random(i).choices("abcde", k=3)): 5 + 40 * (i % 9) for i in range(60)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(got) == len(words) and set(map(tuple, got)) == slow_variants(words)


def test_long_chain_of_forms(spark):
    word, words = "abcdefgh", {}
    for i in range(9):
        words[word[:i] + "z" * i + word[i:]] = 5 ** (i + 1)
    words = {f"chained{'z' * i}": 5 ** (i + 1) for i in range(9)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert set(map(tuple, got)) == slow_variants(words) and {r["root"] for r in got} == {"chained" + "z" * 8}


def test_rows_of_every_kind(spark):
    rows = [(r[0], r[1]) for r in helpers.rows()] + [(i, "Straße ÉCLAIR éclair x×÷y'abcdef-abcdef" * 9) for i in (400, 400, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.spelling_groups(frame.select(F.lit("x").alias("word"), F.lit(1).alias("n"), "*")).collect()
    assert set(map(tuple, got)) == slow_variants(slow_vocabulary(rows)) and got
    assert spelling.spelling_groups(helpers.empty(spark)).isEmpty()
    assert spelling.spelling_groups(helpers.docs(spark).where("length(text) < 5")).isEmpty()


def test_query_against_sql_and_plain_form(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_spelling_groups(spark, SF0001).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    sql = con.execute(ORACLE["op13_spelling_groups"]).fetchall()
    assert Counter(map(tuple, got)) == Counter(sql)
    assert set(map(tuple, got)) == slow_variants(slow_vocabulary(rows))
