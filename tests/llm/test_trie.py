"""The z-fast trie against plain prefix sets, the query against its SQL and a plain form."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from shelfwise.llm import prefix_trie
from shelfwise.llm.queries import ORACLE, op11_conversation_trie
from tests.conftest import SF0001

TURNS = "conv_id long, turn int, role string, text string"
STRINGS = f"first long, length int, path {prefix_trie.PATH}"


def prints(seq):
    """A made-up fingerprint for each prefix."""
    return [(zlib.crc32(repr(seq[:d]).encode()), zlib.adler32(repr(seq[:d]).encode()), d) for d in range(1, len(seq) + 1)]


def slow_nodes(seqs):
    """{(parent, depth, prefix)} of the compacted trie, without its root."""
    after = defaultdict(set)
    for s in seqs:
        for d in range(len(s)):
            after[s[:d]].add(s[d])
    stops = {p for p in after if len(after[p]) > 1} | set(seqs)
    out = set()
    for p in stops - {()}:
        parent = max((d for d in range(1, len(p)) if p[:d] in stops), default=0)
        out.add((parent, len(p), p))
    return out


def sequences(rng, n, letters, longest):
    out = {()}
    while len(out) < n:
        s = list(rng.choice(sorted(out)))[:rng.randint(0, longest)] + [rng.choice(letters) for _ in range(rng.randint(0, longest // 3))]
        out.add(tuple(s[:longest]))
    return sorted(out, key=lambda s: rng.random())


def test_two_fattest(spark):
    rows = [(a, b) for a in range(0, 70, 3) for b in range(a + 1, 140)]
    got = spark.createDataFrame(rows, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_batches_against_prefix_sets(spark):
    rng = random.Random(2)
    seqs = sequences(rng, 160, "abc", 40)
    trie, done = prefix_trie.ZFastTrie(spark), []
    for batch in (seqs[:1], seqs[1:40], seqs[40:]):
        trie.insert(spark.createDataFrame([(i, len(s), prints(s)) for i, s in enumerate(batch)], STRINGS))
        done += batch
        got = {(r["parent"], r["depth"], r["th"], r["tl"], r["tc"], tuple(map(tuple, r["edge"]))) for r in trie.nodes.collect()}
        expected = set()
        for parent, depth, p in slow_nodes(done):
            path = prints(p)
            expected.add((parent, depth, *(path[parent - 1] if parent else (0, 0, 0)), tuple(path[parent:])))
        assert got == expected
    # Where other sequences leave the trie.
    prefixes = {s[:d] for s in done for d in range(len(s) + 1)}
    stops = {p: parent for parent, _, p in slow_nodes(done)} | {(): 0}
    others = sequences(rng, 120, "abcd", 45)
    rows = trie.locate(spark.createDataFrame([(i, len(s), prints(s)) for i, s in enumerate(others)], STRINGS)).collect()
    assert len(rows) == len(others)
    for r in rows:
        s = others[r["first"]]
        assert r["matched"] == max(d for d in range(len(s) + 1) if s[:d] in prefixes)
        assert r["low"] == max(d for d in range(len(s) + 1) if s[:d] in stops)
        assert (r["exit"] is not None) == (r["matched"] > r["low"])


def slow_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            turns[conv].append(((turn is not None, turn or 0), role or "", hashlib.md5(text.encode()).hexdigest(), text))
    own = {c: [(t[1], t[3]) for t in sorted(v)] for c, v in turns.items()}
    members = defaultdict(set)
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].add(c)
    kids = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += kids[p] == 0
    out = Counter()
    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in ids if rebuilt[c] == p))
        out[min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), kids[p], leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def test_conversations_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 8)
    rng = random.Random(5)
    rows = [(None, 0, "user", "nobody's"), (None, None, None, None)]
    for c in list(range(0, 60)) + list(range(200, 230)) + [731, 799]:
        # Many equal beginnings, whole copies, prefixes of others, ties, nulls and empty texts.
        n = rng.randint(1, 9)
        rows += [(c, rng.choice([t, t, t, 1, None]), rng.choice(["user", "user", None, ""]), rng.choice(["hello", "hello", None, "", "à bientôt 𝒳"]))
                 for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(400, 420) for t in range(7)]
    rows += [(500, t, "user", f"turn {t}") for t in range(150)] + [(501, t, "user", f"turn {t}") for t in range(120)]
    rows += rows[:40]
    expected = slow_trie(rows)
    frame = spark.createDataFrame(rows, TURNS).withColumn("first", F.lit("x")).withColumn("d", F.lit(1)).withColumn("length", F.lit(2))
    got = Counter(map(tuple, prefix_trie.conversation_trie(frame).collect()))
    assert got == expected
    con = duckdb.connect()
    con.register("conversations", frame.select("conv_id", "turn", "role", "text").toArrow())
    assert Counter(con.execute(ORACLE["op11_conversation_trie"]).fetchall()) == expected


def test_no_conversation_and_no_turn(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], TURNS)).isEmpty()
    # Conversations whose own turns all give way to a base that isn't there.
    rows = [(c, 0, "user", "x") for c in (101, 102, 103, 104, 105, 106)]
    got = Counter(map(tuple, prefix_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()))
    assert got == slow_trie(rows) and any(r[1] == 0 and r[3] == 6 for r in got)


def test_query_against_plain_form(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(map(tuple, op11_conversation_trie(spark, SF0001).collect())) == slow_trie(rows)
