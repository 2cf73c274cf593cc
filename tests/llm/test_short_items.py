from collections import Counter
from itertools import combinations

from shelfwise.llm import decontam
from tests.llm import helpers


def every_diagonal(doc, item):
    """Rows (doc_word, item_word, n_words, n_same) of an item of 8 to 16 words, without a mask."""
    d, b = decontam.words_of(doc), decontam.words_of(item)
    for shift in range(len(d) - len(b) + 1):
        same = sum(x == y for x, y in zip(d[shift:], b))
        if 100 * same >= decontam.SAME_PERCENT * len(b):
            yield shift, 0, len(b), same


def test_plan_hits_all_substitutions_of_short_items():
    plan = decontam._plan(list(range(decontam.MIN_ITEM_WORDS, 40)), decontam.MASKS)
    assert sorted(plan) == list(range(8, 17)) and plan[16] == decontam.LONG_MASKS
    for n, masks in plan.items():
        assert set(masks) <= set(decontam.MASKS)
        for bad in combinations(range(n), n // 5):
            assert any(not any(i + j in bad for j, c in enumerate(m) if c == "1")
                       for m in masks for i in range(n - len(m) + 1)), (n, bad)


def test_short_items_with_substitutions(spark):
    items = [(n, helpers.prose(500 + n, n)) for n in range(8, 17)]
    rows = []
    for n, text in items:
        for bad in list(combinations(range(n), n // 5)) + [tuple(range(n // 5 + 1))]:
            part = ["changed" if i in bad else w for i, w in enumerate(text.split())]
            rows.append((len(rows), helpers.prose(n, 5) + " " + " ".join(part) + " " + helpers.prose(n + 50, 5), "en", "s", 1))
    docs, bench = spark.createDataFrame(rows, helpers.DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = Counter((d, i, *o) for d, t, *_ in rows for i, b in items for o in every_diagonal(t, b))
    assert len({d for d, *_ in want}) == len(rows) - len(items)
    assert Counter(map(tuple, decontam.contaminated(docs, bench).collect())) == want
    assert decontam.drop_contaminated(docs, bench).count() == len(items)
