"""Rows that every operator must take: nulls, empty and long texts, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns named like those that the operators add or use inside.
CLASHING = ("fp _uid _fp slot shard length kept score _text_hash _slot _shard _bad_id _bad_hash _h _r _line_doc _line_drops n_lines "
            "segment item hash doc bucket block first path d h l").split()
CLASH = DOCS + "".join(f", {c} string" for c in CLASHING)


def prose(seed, n=60, words=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def rows():
    """(doc_id, text, lang, source, n_chars)"""
    out = [(i, prose(i, 30 + 7 * i), "en", "s", i) for i in range(12)]
    out += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "   \n\t ", None, "s", 6), (103, "!!! 123 ###", "en", "s", 11),
            (104, "one", "en", "s", 3), (105, "one two", "en", "s", 7), (None, prose(5, 65), None, "s", 1), (None, None, None, None, None),
            (106, out[3][1], "en", "s", 3), (3, out[3][1], "en", "s", 3), (3, out[3][1], "en", "s", 3),
            (107, prose(9, 40) + "\n" + "same line here again\n" * 30, "en", "s", 1), (108, "ÉÈ ñandú  über\xa0straße\u2003x\x1fy", "fr", "s", 1),
            (109, prose(77, 30000), "en", "s", 1)]
    return out


def clashing(spark):
    return spark.createDataFrame([r + ("x",) * len(CLASHING) for r in rows()], CLASH)


def docs(spark):
    return spark.createDataFrame(rows(), DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)
