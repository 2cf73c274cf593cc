import math
import random
from collections import Counter

import numpy as np
import pytest

from shelfwise.llm import cnn, decontam, langid, repetition, urls
from shelfwise.llm.queries import URL_RULES, op5_language_id, op7_quality_classifier, op8_url_filters
from tests.llm import helpers

SF001 = "/root/testdata/sf0.01"


# ---- quality rules

def slow_measure(text):
    text = text or ""
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]

    def covered(n):
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        twice = Counter(grams)
        return {j for i, g in enumerate(grams) if twice[g] > 1 for j in range(i, i + n)}

    chars = sum(map(len, words))
    lines, seen, dup, dup_chars = text.split("\n"), set(), 0, 0
    for line in lines:
        own = sum(map(len, line.split(" ")))
        if line in seen and own:
            dup, dup_chars = dup + 1, dup_chars + own
        seen.add(line)
    out = {"n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
           "n_repeat_words": len(covered(8)), "dup_line_chars": dup_chars}
    for n in repetition.NGRAM_SHARES:
        out[f"dup_{n}gram_chars"] = sum(len(words[i]) for i in covered(n))
    out["base_failed"] = len(words) < 20 or 100 * out["n_repeat_words"] > 30 * len(words)
    out["kept"] = not (out["base_failed"] or 100 * dup_chars > repetition.LINE_SHARE * chars
                       or any(100 * out[f"dup_{n}gram_chars"] > s * chars for n, s in repetition.NGRAM_SHARES.items()))
    return out


def test_repetition_against_lists(spark):
    rng = random.Random(0)
    texts = [r[1] for r in helpers.rows() if r[0] != 109]
    for _ in range(60):  # few words, so many repeats and overlaps
        texts.append(" ".join(rng.choice("a bb ccc # dd\n é".split(" ")) for _ in range(rng.randint(0, 90))))
    texts += ["x " * 40, "a b c d e f g h i j " * 5, "line one is here\n\nline one is here\n\n"]
    got = repetition.measure_texts(texts)
    for i, text in enumerate(texts):
        assert {k: v[i] for k, v in got.items()} == slow_measure(text), text
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        rows = repetition.measure(df).collect()
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in helpers.rows())
        kept = repetition.keep(df)
        assert kept.columns == df.columns and kept.schema == df.schema
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["kept"])
    assert repetition.measure(helpers.empty(spark)).collect() == repetition.keep(helpers.empty(spark)).collect() == []


# ---- decontamination

def numbered(texts):
    """Each text's words as numbers, equal for equal words."""
    number = {}
    return [np.array([number.setdefault(w, len(number)) for w in decontam.words_of(t)], dtype=np.int64) for t in texts]


def diagonal_overlaps(d, b):
    """Rows (doc_word, item_word, n_words, n_same) of word numbers, by every diagonal and without a mask."""
    if len(b) < decontam.MIN_ITEM_WORDS:
        return []
    w = min(decontam.WINDOW, len(b))
    # same[s, i]: is word i of the item that of the document, with the item's first word at place s - len(b)?
    padded = np.concatenate([np.full(len(b), -1), d, np.full(len(b), -1)])
    same = np.lib.stride_tricks.sliding_window_view(padded, len(b))[:len(d) + len(b)] == b
    some = np.flatnonzero(100 * same.sum(axis=1) >= decontam.SAME_PERCENT * w)
    out = []
    for s in some.tolist():
        shift = s - len(b)
        lo, hi = max(0, -shift), min(len(b), len(d) - shift)
        cover = {i + j for i in range(lo, hi - w + 1) if 100 * same[s, i:i + w].sum() >= decontam.SAME_PERCENT * w for j in range(w)}
        if cover:
            out.append((shift + min(cover), min(cover), len(cover), int(sum(same[s, i] for i in cover))))
    return out


def slow_overlaps(doc, item):
    return diagonal_overlaps(*numbered([doc, item]))


def leaky(spark):
    rng = random.Random(4)
    items = [(i, helpers.prose(900 + i, n)) for i, n in enumerate((8, 10, 12, 16, 25, 60, 200))]
    items += [(50, None), (51, ""), (52, "too short"), (None, helpers.prose(3, 30)), (4, items[4][1])]
    rows = helpers.rows()
    for k, (_, text) in enumerate(items[:7]):
        words = text.split()
        for j, (a, b, swaps) in enumerate(((0, len(words), 0), (0, len(words), len(words) // 8), (0, 30, 2), (3, 14, 0), (0, 7, 0))):
            part = words[a:b]
            for i in rng.sample(range(len(part)), min(swaps, len(part))):
                part[i] = "changed"
            text = helpers.prose(k, 20) + " " + ", ".join(part).upper() + ". " + helpers.prose(j, 15)
            rows.append((1000 + 10 * k + j, text, "en", "s", 1))
    return rows, items


def test_decontamination_against_every_diagonal(spark):
    rows, items = leaky(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter({(d, i, *o): 1 for d, t, *_ in rows for i, b in items for o in slow_overlaps(t, b)})
    docs = spark.createDataFrame(rows, helpers.DOCS)
    assert Counter(map(tuple, decontam.contaminated(docs, bench).collect())) == want
    found = {d for d, *_ in want}
    assert {1000 + 10 * k + j for k in range(7) for j in (0,)} <= found
    assert {1000 + 10 * k + 1 for k in range(3, 7)} <= found
    texts = {t for d, t, *_ in rows if any(slow_overlaps(t, b) for _, b in items)}
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in rows if r[1] not in texts)
    clash = decontam.drop_contaminated(helpers.clashing(spark), bench)
    assert Counter(r["doc_id"] for r in clash.collect()) == Counter(r[0] for r in helpers.rows() if r[1] not in texts)


def test_decontamination_of_empty_tables(spark):
    rows, items = leaky(spark)
    bench, none = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(helpers.empty(spark), bench).collect() == []
    assert decontam.contaminated(helpers.docs(spark), none).collect() == []
    assert decontam.drop_contaminated(helpers.docs(spark), none).count() == len(helpers.rows())


def test_masks_hit_all_windows_of_three_substitutions():
    from itertools import combinations
    for bad in combinations(range(decontam.WINDOW), 3):
        assert any(not any(i + j in bad for j, c in enumerate(m) if c == "1")
                   for m in decontam.MASKS for i in range(decontam.WINDOW - len(m) + 1)), bad


# ---- language ID

def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = op5_language_id(spark, SF001).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["lang_pred"] != "und"]
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_of_odd_rows(spark):
    model = langid.train(spark.read.parquet(f"{SF001}/documents.parquet"))
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        got = langid.predict(df, model).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in helpers.rows())
        und = {100, 101, 102, 103}
        assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
        assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == und | {None}
        kept = langid.keep(df, model, 0.0)
        assert kept.schema == df.schema and not und & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(helpers.empty(spark)).collect() == []
    none = langid.train(helpers.docs(spark).where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.predict(helpers.docs(spark), none).collect()} == {"und"}
    one = langid.predict(helpers.docs(spark), langid.train(helpers.docs(spark).where("lang = 'en'"))).where("doc_id = 1").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)


def test_features_count_every_ngram_across_pieces(monkeypatch):
    text = helpers.prose(8, 300) + " É" * 20
    whole = langid._counts(text)
    monkeypatch.setattr(langid, "PIECE_CHARS", 97)
    parts = langid._counts(text)
    assert [a.tolist() for a in whole] == [a.tolist() for a in parts]
    assert whole[1].sum() == sum(len(text) + 2 - n + 1 for n in langid.ORDERS)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    scores = rng.normal(0, 4, (4000, 3))
    labels = np.array([rng.choice(3, p=langid.softmax(s / 2.5)) for s in scores])
    assert abs(langid.fit_temperature(scores, labels) - 2.5) < 0.25


# ---- quality classifier

def test_quality_classifier_held_out(spark):
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    got = op7_quality_classifier(spark, SF001)
    assert got.count() == 1000
    held = got.join(labels, "doc_id").where("held_out").collect()
    ones, zeros = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in got.collect())


def test_scores_pool_all_chunks(monkeypatch):
    net = cnn.Network(1)
    tables = net.tables()
    texts = [helpers.prose(i, 10 + 150 * i) for i in range(6)] + ["", None, "a", "abcdef", "é" * 700]

    def slow(text):
        data = list((text or "").encode())
        data += [0] * (cnn.WIDTH - len(data))
        r = [sum(tables[j, data[p + j]].astype(float) for j in range(cnn.WIDTH)) for p in range(len(data) - cnn.WIDTH + 1)]
        maxima = np.array([np.max(r[i:i + cnn.CHUNK], axis=0) for i in range(0, len(r), cnn.CHUNK)])
        _, logit = net.head(np.concatenate([maxima.max(axis=0), maxima.mean(axis=0)])[None])
        return 1 / (1 + math.exp(-logit[0]))

    want = [slow(t) for t in texts]
    assert np.allclose(net.scores(texts, tables), want, atol=1e-5)
    monkeypatch.setattr(cnn, "BLOCK_BYTES", 600)
    assert np.allclose(net.scores(texts, tables), want, atol=1e-5)


def test_gradients_are_those_of_the_loss():
    net = cnn.Network(2)
    rows = [(1, cnn._bytes(helpers.prose(1, 200))), (0, cnn._bytes("!! ABC")), (1, cnn._bytes(""))]

    def loss():
        p = net.scores([d.tobytes().decode() for _, d in rows], net.tables().astype(np.float64))
        return -np.mean([math.log(q if y else 1 - q) for (y, _), q in zip(rows, p)])

    grads = cnn._gradients(net, rows)
    for name, at in (("w2", (3, 0)), ("w1", (5, 2)), ("b1", (1,)), ("filters", (2, 3, 4)), ("bytes", (ord("a"), 2))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-5
        up = loss()
        net.p[name][at] = old - 1e-5
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 2e-3


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, None), (2, None, None), (107, 0, 0), (107, 0, 0), (999, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    for df in (helpers.docs(spark), helpers.clashing(spark)):
        got = cnn.classify(df, labels).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in helpers.rows())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (100, 101)}) == 1
    assert cnn.classify(helpers.empty(spark), labels).collect() == []
    for q, want in ((None, 0.5), (1, 1.0)):
        got = cnn.classify(helpers.docs(spark), labels.where("quality = 1" if q else "quality > 50")).collect()
        assert all(abs(r["score"] - want) < 1e-3 for r in got)


# ---- URL filters

def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = path = ""
    i = 0
    while i < len(rest) and rest[i] not in "/?#":
        i += 1
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:i])
    path = rest[i:].split("?")[0].split("#")[0]
    return host, path


def slow_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [None, "", "no scheme", "http://", "://x.net/", "HTTP://WWW.Example.NET/EN/1", "http://example.net/en/1", "http://a.example.net/en", "http://net",
            "http://net/", "http://x.net?q=/", "http://notexample.com/de/1", "https://example.com/de/a?b=c#d", "http://org/fr/", "http://a.org/fr?x", "http://É.ORG/fr/é",
            "http://a\nb.net/x\ny", "http://x://y.net/", "http://u@example.net:80/en/", "http://" + "a." * 500 + "net/" + "p/" * 3000, "http://casino.example.com/en/"]


def test_url_query(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    got = op8_url_filters(spark, SF001).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = slow_split(pages[r["page_id"]])
        rule, verdict = slow_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if rule else r["verdict"] in ("allow", "block")
    free = [r for r in got if r["rule"] is None]
    listed = [r for r in free if set(r["host"].replace("-", ".").split(".")) & set(urls.BLOCK_WORDS)]
    assert listed and np.mean([r["verdict"] == "block" for r in listed]) > 0.9
    assert np.mean([r["verdict"] == "allow" for r in free if r not in listed]) > 0.9


def test_odd_urls(spark):
    rows = [(i, u, "h", "r", "l") for i, u in enumerate(ODD_URLS)] + [(None, "http://x.net/", "h", "r", "l"), (3, "http://", "h", "r", "l")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, label string")
    got = urls.judge(df, URL_RULES).collect()
    want = Counter()
    for i, u, *_ in rows:
        host, path = slow_split(u)
        want[(i, host, path, slow_rule(host, path)[0])] += 1
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == want
    assert urls.judge(df.limit(0), URL_RULES).collect() == []
    alike = urls.judge(df.where("page_id < 3"), URL_RULES).collect()
    assert [r["verdict"] for r in alike] == ["allow"] * 3
    with pytest.raises(ValueError):
        urls.judge(df, [("maybe", "net", "/")])
    tie = urls.judge(df.where("page_id = 7"), [("block", "example.net", "/e"), ("allow", "a.example.net", "/"), ("allow", "example.net", "/en")]).first()
    assert tie["rule"] == "a.example.net/"
