from collections import Counter

import corpus_pipeline
from shelfwise.llm import langid
from shelfwise.llm.queries import TOKENIZER
from tests.llm import helpers
from tests.llm.test_dedup import roots, slow_fingerprint
from tests.llm.test_filters import diagonal_overlaps, numbered, slow_measure
from tests.llm.test_tokens import check_packing, plain

SF = "/root/testdata/sf0.01"


def test_stages_against_lists(spark):
    """Each stage on what the one before kept, against its plain form."""
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF))
        assert kept[-1].columns == columns, name
    kept[1:] = [spark.createDataFrame(k.collect(), docs.schema) for k in kept[1:]]
    rows = [[tuple(r) for r in k.select("doc_id", "text").collect()] for k in kept]

    model = langid.train(docs)
    found, score = model.predict([t for _, t in rows[0]], model.table())
    assert Counter(rows[1]) == Counter(r for r, lang, s in zip(rows[0], found, score) if lang != "und" and s >= 0.3)
    assert Counter(rows[2]) == Counter(r for r in rows[1] if slow_measure(r[1])["kept"])
    prints = [slow_fingerprint(t) for _, t in rows[2]]
    root = roots(prints, 2)
    first = {}
    for (d, _), p in zip(rows[2], prints):
        first[root[p]] = min(d, first.get(root[p], d))
    assert sorted(d for d, _ in rows[3]) == sorted(first.values())
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = numbered([t for _, t in rows[3]] + items)
    leaks = {d for (d, _), own in zip(rows[3], words) if any(diagonal_overlaps(own, b) for b in words[len(rows[3]):])}
    assert leaks and sorted(d for d, _ in rows[4]) == sorted(d for d, _ in rows[3] if d not in leaks)

    tok = Tokenizer.from_file(TOKENIZER)
    want = Counter((d, tuple(plain(tok, t) + [2])) for d, t in rows[4])
    check_packing(corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect(), want, 1024)


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(key).collect())) == Counter(map(tuple, docs.select(key).collect()))


def test_odd_rows_go_through(spark):
    sf = "/root/testdata/sf0.001"
    for docs in (helpers.docs(spark), helpers.clashing(spark), helpers.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, sf)
            assert docs.columns == before.columns or "sequence_id" in docs.columns
        assert docs.count() >= 0
