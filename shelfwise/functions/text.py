"""Text functions as JVM-side column expressions; only ``fold_diacritics`` needs Python.

Character classes are spelled ``\\p{L}\\p{N}_`` rather than ``\\w`` so Java, RE2
and Python agree on what a word character is (letters, numbers, underscore;
combining marks are not word characters).
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_WS_EDGES = r"(?U)^\s+|\s+$"
_NOT_WORD_OR_SPACE = r"(?U)[^\p{L}\p{N}_\s]"
_WS_RUN = r"(?U)\s+"
_WORD = r"([\p{L}\p{N}_]+)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(c) -> Column:
    """H1: lower -> strip -> non-word/non-space to ' ' -> collapse white space.

    NULL or '' gives ''. There is no final trim, so text ending in punctuation
    keeps one trailing space.
    """
    x = F.lower(_c(c))
    x = F.regexp_replace(x, _WS_EDGES, "")
    x = F.regexp_replace(x, _NOT_WORD_OR_SPACE, " ")
    x = F.regexp_replace(x, _WS_RUN, " ")
    return F.coalesce(x, F.lit(""))


class _Folded(dict):
    """A code point's form without diacritics, found when first asked for: its NFD minus marks of a combining class other than 0.

    Letters without a canonical decomposition (such as U+0111) are left alone,
    as NFD leaves them, and so are signs that fall apart into marks only. A mark
    is combining if its class isn't 0: Thai and Devanagari vowel signs, whose
    class is 0, stay. As marks go, their order within a text doesn't matter, so
    a text is folded code point by code point.
    """

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if not unicodedata.combining(x))
        self[cp] = base if base or unicodedata.combining(ch) else ch
        return self[cp]


_FOLDED = _Folded()


def _fold(texts: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else t.translate(_FOLDED) for t in texts.to_pylist()], pa.string())


def fold_diacritics(c) -> Column:
    """H2: drop diacritics (NFD minus marks of a combining class other than 0), in any script.

    Spark has no normalisation, and its regular expressions try a class of
    thousands of letters one after the other; Python folds a batch of texts with
    a lookup for each letter.
    """
    return F.arrow_udf(_fold, "string")(_c(c))


def _keep(c) -> Column:
    """NULL for the parts build_document skips: NULL, '' and the literal 'None'."""
    s = _c(c).cast("string")
    return F.when(s.isNull() | (s == "") | (s == "None"), F.lit(None)).otherwise(s)


DOCUMENT_COLUMNS = ("title", "description", "authors_text", "genres_text", "publisher", "publication_year")


def build_document(cols=DOCUMENT_COLUMNS) -> Column:
    """H3: space-joined non-empty metadata fields, normalised with H1."""
    return normalize_text(F.concat_ws(" ", *[_keep(c) for c in cols]))


def tag_tokens(cols) -> Column:
    """H4: white-space split of the tag columns; case and punctuation kept; NULLs skipped."""
    joined = F.concat_ws(" ", *[_c(c) for c in cols])
    return F.filter(F.split(joined, _WS_RUN), lambda t: t != F.lit(""))


def word_tokens(c) -> Column:
    """H8: lower-cased unicode word tokens (single characters included)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(_WORD), 1)
