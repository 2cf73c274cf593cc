import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, wavelet
from shelfwise.llm.common import shared_folder
from shelfwise.llm.queries import TOKENIZER, op1_best_fit_packing, op9_token_files
from shelfwise.llm.tokens import TextEncoder
from tests.conftest import SF0001
from tests.llm import helpers


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(TOKENIZER)


def plain(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


ODD = ["a  b", "", " x", "x ", "a\n\nb c", "a \n b", "a\tb c\xa0d é  f", "a\nb c\nd\n e's  it'll", "<|endoftext|> b a<|endoftext|>b",
       "\nfoo bar\nbaz", "foo bar\n", "x " * 10, None, "é è\nç", "a, b.c ,d", "...", "日本 語\u3000x", "x\x1f y\x85 z", "1 2  3", " \n "]


@pytest.mark.parametrize("parts, size", [(1_000_000, 2 << 20), (40, 7)])
def test_encoder_equals_the_tokenizer(tok, parts, size):
    enc = TextEncoder(TOKENIZER, max_parts=parts, step_bytes=size)
    texts = ODD + [helpers.prose(i, 200) for i in range(8)] + ODD
    for _ in range(3):
        ids, counts = enc.encode(texts)
        at = 0
        for text, n in zip(texts, counts):
            assert ids[at:at + n].tolist() == plain(tok, text), text
            at += n


def check_packing(rows, expected, capacity):
    """``expected``: Counter of (doc_id, ids with the end)."""
    bins = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, own in docs.items():
        want = Counter()
        for (d, ids), n in expected.items():
            if d != doc:
                continue
            k = -(-len(ids) // capacity)
            first = len(ids) - (k - 1) * capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())] += n
        assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own) == want
    return len(bins)


def test_packing_of_odd_rows(spark, tok):
    want = Counter((d, tuple(plain(tok, t) + [2])) for d, t, *_ in helpers.rows())
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        got = packing.pack_documents(df, TOKENIZER, 256).collect()
        bins = check_packing(got, want, 256)
        total = sum(len(ids) * n for (_, ids), n in want.items())
        assert bins <= -(-total // 256) + 3
    assert packing.pack_documents(helpers.empty(spark), TOKENIZER).collect() == []


def test_packing_query(spark, tok):
    want = Counter((r["doc_id"], tuple(plain(tok, r["text"]) + [2])) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect())
    bins = check_packing(op1_best_fit_packing(spark, SF0001).collect(), want, 1024)
    assert bins <= 1.02 * -(-sum(len(ids) * n for (_, ids), n in want.items()) // 1024)


def test_kept_ids_are_the_pieces(spark, tok):
    got = packing.cut_pieces(helpers.docs(spark).where("doc_id < 5"), TOKENIZER, 64, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_plan_is_that_of_one_bin_at_a_time():
    def fullest(left, capacity):
        longest = max(left)
        best = {0: ()}
        pool = sorted(left.elements())
        pool.remove(longest)
        for n in pool:
            for total, own in list(best.items()):
                if total + n <= capacity - longest and total + n not in best:
                    best[total + n] = own + (n,)
        return longest + max(best)

    rng = np.random.default_rng(3)
    for _ in range(15):
        counts = Counter(rng.integers(1, 30, 40).tolist())
        plan = packing.plan_bins(dict(counts), 30)
        left = Counter(counts)
        for bins, copies in plan:
            for _ in range(bins):
                assert sum(n * k for n, k in copies.items()) == fullest(left, 30)
                left.subtract(copies)
                assert min(left.values()) >= 0
                left = +left
        assert not left
    assert packing.plan_bins({}, 8) == []
    assert len(packing.plan_bins({n: 10 ** 12 + n for n in range(1, 1025)}, 1024)) < 7100


def test_a_hot_length_is_numbered_in_buckets(spark):
    pieces = spark.range(5000).selectExpr("id AS doc_id", "CAST(IF(id % 3 = 0, 7, 1 + id % 16) AS LONG) AS length")
    got = packing.pack(pieces, 16, bucket_rows=100, group_buckets=3).collect()
    assert len(got) == 5000
    places = Counter((r["sequence_id"], r["offset"] + i) for r in got for i in range(r["length"]))
    assert set(places.values()) == {1} and max(o for _, o in places) < 16
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 17)], "doc_id long, length long"), 16)


def test_wavelet_matrix_against_lists():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (700, 1), (3000, 900), (1000, 60000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        file = wavelet.TokenFile.from_bytes(wavelet.TokenFile.build([None, 5], np.asarray([n, 0]), ids, block_ids=512).to_bytes())
        assert file.doc_ids == [None, 5] and file.lengths.tolist() == [n, 0]
        assert file.decode().tolist() == ids.tolist()
        assert file.access(np.arange(n)).tolist() == ids.tolist()
        for token in {*ids[:5].tolist(), 3, 70000}:
            places = np.flatnonzero(ids == token).tolist()
            assert file.count(token) == len(places)
            assert file.count(token, n // 2) == sum(p < n // 2 for p in places)
            assert [file.select(token, k) for k in range(len(places))] == places
            with pytest.raises(IndexError):
                file.select(token, len(places))


def files_of(rows, tok):
    """Rows that a reader must find, by ascending id."""
    out, at = [], 0
    for d, t in rows:
        ids = np.asarray(plain(tok, t) + [0], dtype="<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_query(spark, tok):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect())
    got = op9_token_files(spark, SF0001)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == files_of(docs, tok)


def test_token_files_of_odd_rows(spark, tok):
    rows = [(r[0], r[1] or "") for r in helpers.rows()]
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        folder = shared_folder(spark, "tokens-test")
        files = wavelet.write_shards(df, folder, TOKENIZER, shard_bytes=40_000, shard_ids=20_000)
        assert files.count() > 3
        got = sorted(map(tuple, wavelet.read_shards(files, folder).collect()), key=lambda r: r[1])
        assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((d is not None, d or 0) for d, _ in rows)
        assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
        want = Counter((d, n, crc) for d, _, n, crc in files_of(rows, tok))
        assert Counter((r[0], r[2], r[3]) for r in got) == want
    assert wavelet.token_files(helpers.empty(spark), TOKENIZER).collect() == []


def test_file_starts_in_runs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "RUN_PARTS", 3)
    rng = np.random.default_rng(8)
    rows = [(f"f{p}-{s}", p, s, int(rng.integers(1, 1 << 40))) for p in range(0, 40, 2) for s in range(int(rng.integers(1, 4)))]
    files = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "file string, part long, seq long, n_tokens long")
    starts = wavelet.file_starts(files)
    want, at = {}, 0
    for name, *_, n in rows:
        want[name], at = at, at + n
    assert dict(map(tuple, starts.collect())) == want
    plan = starts._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and all("_run" in line.split("],")[1] for line in plan.splitlines() if " Window [" in line)
