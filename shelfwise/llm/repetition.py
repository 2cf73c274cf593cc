"""Repetition rules: characters inside duplicated word n-grams and duplicated lines.

All n-grams of a length are hashed at once: with x the mixed numbers of the
words and M odd, cumulative sums of x[i] * M^i give each window's polynomial hash
by one subtraction and one product with M^-i, modulo 2^64. Windows of several
documents are sorted together, each document's with its own salt.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
BASE_N = 8
# A document goes if duplicated n-grams of a length hold more than this share (%) of its characters in words,
# or lines that repeat an earlier line do.
NGRAM_SHARES = {5: 50, 7: 40, 10: 30}
LINE_SHARE = 30

_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_powers = (np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(M^i, M^-i) for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = tuple(np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size, m, dtype=np.uint64))])
                            for m in (_M, _M_INVERSE))
    return _powers[0][:n], _powers[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _covered(numbers: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each n: whether a word stands in an n-word window that its document has twice or more.

    ``numbers`` are those of the words of documents in a row; ``ends`` where each document ends.
    """
    n_words = len(numbers)
    begins = np.concatenate([[0], ends[:-1]])
    counts = ends - begins
    last = np.repeat(ends, counts)
    place = np.arange(n_words)
    up, down = _power(n_words)
    salt = _mix(np.repeat(np.arange(len(ends), dtype=np.uint64), counts))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(numbers.astype(np.uint64)) * up)])
        out = {}
        for n in lengths:
            at = place[:max(0, n_words - n + 1)]
            at = at[at + n <= last[at]]
            window = _mix((sums[at + n] - sums[at]) * down[at] ^ salt[at])
            ordered = np.sort(window)
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            marks = np.zeros(n_words + 1, dtype=np.int64)
            if len(twice):
                twice = np.unique(twice)
                near = np.searchsorted(twice, window)
                hit = at[twice[np.minimum(near, len(twice) - 1)] == window]
                marks[hit] += 1
                marks[hit + n] -= 1
            out[n] = np.cumsum(marks[:-1]) > 0
    return out


def measure_texts(texts: list[str | None], ngram_shares: dict[int, int] = NGRAM_SHARES,
                  line_share: int = LINE_SHARE) -> dict[str, np.ndarray]:
    """The measures and verdicts of texts, by column."""
    found, ends, lens = [], [], []
    symbols, dup_lines, line_chars = [], [], []
    for text in texts:
        text = text or ""
        words = WORD.findall(text)
        number: dict[str, int] = {}
        found += [number.setdefault(w, len(number)) for w in words]
        lens += map(len, words)
        ends.append(len(found))
        symbols.append(sum(map(text.count, SYMBOLS)))
        seen, again, chars = set(), 0, 0
        lines = text.split("\n")
        if len(lines) > 1:
            for line in lines:
                if line in seen:
                    own = sum(map(len, WORD.findall(line)))
                    again += own > 0
                    chars += own
                else:
                    seen.add(line)
        dup_lines.append(again)
        line_chars.append(chars)
    ends_a, lens_a = np.asarray(ends, dtype=np.int64), np.asarray(lens, dtype=np.int64)
    covered = _covered(np.asarray(found, dtype=np.int64), ends_a, (BASE_N, *(n for n in ngram_shares if n != BASE_N)))

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(x)])[ends_a]]).astype(np.int64))

    n_words, word_chars = per_text(np.ones(len(lens_a), dtype=np.int64)), per_text(lens_a)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": np.asarray(symbols, dtype=np.int64),
           "n_dup_lines": np.asarray(dup_lines, dtype=np.int64), "n_repeat_words": per_text(covered[BASE_N])}
    out["base_failed"] = (n_words < 20) | (100 * out["n_repeat_words"] > 30 * n_words)
    dup = {"dup_line_chars": np.asarray(line_chars, dtype=np.int64)} | {
        f"dup_{n}gram_chars": per_text(covered[n] * lens_a) for n in ngram_shares}
    over = 100 * dup["dup_line_chars"] > line_share * word_chars
    for n, share in ngram_shares.items():
        over |= 100 * dup[f"dup_{n}gram_chars"] > share * word_chars
    out["kept"] = ~out["base_failed"] & ~over
    return out | dup


def measure(docs: DataFrame, ngram_shares: dict[int, int] = NGRAM_SHARES, line_share: int = LINE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept and the covered characters.

    A null or empty text has no words, so it fails the base rules; a null id stays
    null; repeated rows each have a row. Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            cols = measure_texts(batch.column("text").to_pylist(), ngram_shares, line_share)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, cols.values())], names=["doc_id", *cols])

    kinds = {"base_failed": "boolean", "kept": "boolean"}
    names = list(measure_texts([], ngram_shares, line_share))
    schema = ", ".join(["doc_id long", *(f"{n} {kinds.get(n, 'long')}" for n in names)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def keep(docs: DataFrame, ngram_shares: dict[int, int] = NGRAM_SHARES, line_share: int = LINE_SHARE) -> DataFrame:
    """The rows of ``docs`` whose ``text`` the rules keep, with all their columns.

    Null and empty texts have no words and go; repeated rows are judged alike, and ids play no part.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            kept = measure_texts(batch.column("text").to_pylist(), ngram_shares, line_share)["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def repetition_sql(ngram_shares: dict[int, int] = NGRAM_SHARES, line_share: int = LINE_SHARE) -> str:
    """DuckDB SQL of ``measure`` over ``documents`` with distinct ids, by the words themselves."""
    lengths = sorted({BASE_N, *ngram_shares})
    grams = "".join(f""",
g{n} AS (SELECT doc_id, i, string_agg(w, ' ') OVER nxt AS g, count(*) OVER nxt AS m FROM w
  WINDOW nxt AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
h{n} AS (SELECT doc_id, i, m = {n} AND count(*) OVER (PARTITION BY doc_id, g, m) > 1 AS hit FROM g{n}),
c{n} AS (SELECT doc_id, i, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c FROM h{n})"""
                    for n in lengths)
    sums = ", ".join(f"coalesce(sum(length(w)) FILTER (c{n}.c), 0)::BIGINT AS dup_{n}gram_chars" for n in ngram_shares)
    joins = " ".join(f"JOIN c{n} USING (doc_id, i)" for n in lengths)
    over = " OR ".join([f"100 * dup_line_chars > {line_share} * word_chars",
                        *(f"100 * dup_{n}gram_chars > {s} * word_chars" for n, s in ngram_shares.items())])
    names = ", ".join(f"coalesce(dup_{n}gram_chars, 0) AS dup_{n}gram_chars" for n in ngram_shares)
    space = r"[\x20\x09-\x0D]+"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s){grams},
p AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars,
  count(*) FILTER (c{BASE_N}.c) AS n_repeat_words, {sums} FROM w {joins} GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
r AS (SELECT doc_id, length(regexp_replace(line, '{space}', '', 'g')) AS chars,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l),
q AS (SELECT doc_id, count(*) FILTER (again AND chars > 0) AS n_dup_lines,
  coalesce(sum(chars) FILTER (again), 0)::BIGINT AS dup_line_chars FROM r GROUP BY doc_id),
a AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, dup_line_chars, {names}
  FROM d LEFT JOIN p USING (doc_id) JOIN q USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND NOT ({over}) AS kept FROM b
"""
