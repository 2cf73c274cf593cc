"""Spelling variants, found with a bit-sliced position index.

Over a block of words, ``PositionIndex`` has a bitset for each (position, letter):
the words with that letter there. Reading a query letter by letter, four bitsets
follow all words of the block at once, 64 to a machine word:

* zero: no error so far; the next letter is met at the same position;
* replaced: one letter was replaced; the next one is met at the same position;
* dropped: the query has a letter more; the next one is met one position earlier;
* added: the word has a letter more; the next one is met one position later.

Queries are read as a trie, so that a shared prefix is read once, and machine
words whose four sets are empty are left behind.

Words at one edit (lengths m and m, or m and m + 1) share their first m // 2
letters or their last m - m // 2. So Spark deals words out by these halves:
blocks of many halves, and for a half with too many words a block for each pair
of a slice of them (as the index) and a slice (as queries).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import steps, written

MIN_CHARS = 6
MIN_COUNT = 5
RATIO = 5
# Occurrences whose checksum this divides lose a letter.
SLIP = 199
# Words that a task counts before it passes them on.
HELD_WORDS = 200_000
# Letters in a block of halves, and words of one half before it is sliced.
BLOCK_CHARS = 1 << 20
SLICE_WORDS = 1 << 14
# Queries that one step reads through an index.
QUERIES = 2048

# Bytes of a lower-cased text; A-Z are gone by then.
RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_CHARS)


def text_words(doc_id: int | None, text: str | None) -> Counter:
    """A text's words of ``MIN_CHARS`` code points or more, after the slips; a null id reads as an empty text."""
    lowered = (text or "").encode("utf-8", "replace").lower().decode()  # bytes.lower() changes A-Z only
    # A maximal run shorter than MIN_CHARS can't give a word.
    runs = Counter(RUN.findall(lowered) if len(lowered) < 1 << 22 else (m[0] for m in RUN.finditer(lowered)))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in list(runs):
        h = zlib.crc32(run.encode(), start)
        if h % SLIP == 0:
            n, at = runs.pop(run), h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) >= MIN_CHARS:
                # A slip can give a run that the text has as well, which may slip or not by its own checksum.
                runs[run, "slip"] += n
    out = Counter()
    for run, n in runs.items():
        out[run if isinstance(run, str) else run[0]] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur ``MIN_COUNT`` times or more over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in steps(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in text_words(doc_id, text).items():
                    held[word] += n
            if len(held) > HELD_WORDS:
                yield _counts(held)
                held = Counter()
        yield _counts(held)

    counts = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


class PositionIndex:
    """Bitsets of the words with a letter at a position, for words of bounded length."""

    def __init__(self, words: list[str]):
        self.words = words
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.width = -(-len(words) // 64)
        self.letters = _letters(words)
        self.alphabet = np.unique(self.letters[self.letters > 0])

    def _bits(self, where: np.ndarray) -> np.ndarray:
        """Rows of booleans, one for each word, as rows of 64-bit words."""
        packed = np.packbits(where, axis=-1, bitorder="little")
        pad = self.width * 8 - packed.shape[-1]
        return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)]).view("<u8")

    def at(self, position: int) -> np.ndarray:
        """A bitset for each letter of the alphabet, and an empty one after them."""
        out = np.zeros((len(self.alphabet) + 1, self.width), np.uint64)
        if 0 <= position < self.letters.shape[1]:
            out[:-1] = self._bits(self.letters[:, position] == self.alphabet[:, None])
        return out

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) numbers of all pairs that differ by exactly one edit."""
        order = sorted(range(len(queries)), key=queries.__getitem__)
        found = [self._near(queries, np.array(order[i:i + QUERIES])) for i in range(0, len(order), QUERIES)]
        if not found or not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _near(self, queries: list[str], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts = [queries[i] for i in order]
        letters, lengths = _letters(texts), np.array([len(t) for t in texts], np.int64)
        code = np.searchsorted(self.alphabet, letters)
        known = np.minimum(code, len(self.alphabet) - 1)
        code = np.where(self.alphabet[known] == letters, known, len(self.alphabet))
        # A state: the prefix's node, a machine word and its four sets.
        node, word = np.zeros(self.width, np.int64), np.arange(self.width)
        every = self._bits(np.ones(len(self.words), bool))
        zero, replaced, dropped, added = every, np.zeros_like(every), np.zeros_like(every), every
        # The node of each query's prefix so far; queries are sorted, so nodes are runs of them.
        at_node = np.zeros(len(texts), np.int64)
        before, here, after = self.at(-1), self.at(0), self.at(1)
        pairs_q, pairs_w = [], []
        for i in range(letters.shape[1]):
            live = lengths > i
            if not live.any() or not len(node):
                break
            rows = np.flatnonzero(live)
            step = np.stack([at_node[rows], letters[rows, i]])
            new = np.concatenate([[True], (step[:, 1:] != step[:, :-1]).any(axis=0)])
            at_node = np.full(len(texts), -1)
            at_node[rows] = np.cumsum(new) - 1
            parent, letter = step[0, new], code[rows[new], i]
            # Each state goes on with every letter that follows its prefix.
            first, last = np.searchsorted(parent, node), np.searchsorted(parent, node, "right")
            times = last - first
            state = np.repeat(np.arange(len(node)), times)
            child = np.arange(len(state)) - np.repeat(np.cumsum(times) - times, times) + first[state]
            word, c = word[state], letter[child]
            z, r, d, a = zero[state], replaced[state], dropped[state], added[state]
            same = here[c, word]
            longer, longer_next = self._bits(self.lengths > i), self._bits(self.lengths > i + 1)
            zero = z & same
            replaced = r & same | z & ~same & longer[word]
            dropped = d & before[c, word] | z
            added = a & after[c, word] | zero & longer_next[word]
            keep = (zero | replaced | dropped | added) != 0
            node, word = child[keep], word[keep]
            zero, replaced, dropped, added = zero[keep], replaced[keep], dropped[keep], added[keep]
            before, here, after = here, after, self.at(i + 2)
            ends = rows[lengths[rows] == i + 1]
            if len(ends):
                hit = (replaced & self._bits(self.lengths == i + 1)[word] | dropped & self._bits(self.lengths == i)[word]
                       | added & self._bits(self.lengths == i + 2)[word])
                some = np.flatnonzero(hit)
                bits = np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                at, bit = np.nonzero(bits)
                nodes, words = node[some[at]], word[some[at]] * 64 + bit
                # Equal queries end at one node; nodes ascend along the sorted queries.
                low, high = np.searchsorted(at_node[ends], nodes), np.searchsorted(at_node[ends], nodes, "right")
                times = high - low
                which = np.repeat(np.arange(len(nodes)), times)
                q = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + low[which]
                pairs_q.append(order[ends[q]])
                pairs_w.append(words[which])
        if not pairs_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(pairs_q), np.concatenate(pairs_w)


def _letters(words: list[str]) -> np.ndarray:
    """Code points, a row for each word, with zeros after its end."""
    width = max(map(len, words), default=1) or 1
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of different words (word, n) at one edit, in both directions, once."""
    size = F.char_length("word")

    def halves(m: Column, longer: int) -> Column:
        head = (m / 2).cast("int")
        return F.array(F.struct(m.alias("m"), F.lit(0).alias("side"), F.substring("word", F.lit(1), head).alias("part")),
                       F.struct(m.alias("m"), F.lit(1).alias("side"), F.substring("word", head + longer + 1, size).alias("part")))

    rows = words.withColumn("half", F.explode(F.concat(halves(size, 0), halves(size - 1, 1)))).select("word", "n", "half.*")
    rows = written(rows, "spelling-halves")
    counts = rows.groupBy("m", "side", "part").agg(F.count("*").alias("words"))
    hot = written(counts.where(F.col("words") > SLICE_WORDS), "spelling-hot")
    chars = rows.agg(F.sum(F.char_length("word"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    rows = rows.join(hot, ["m", "side", "part"], "left")
    key = F.xxhash64("m", "side", "part")
    plain = (rows.where("words IS NULL")
             .select("word", "n", "m", F.pmod(key, F.lit(blocks)).alias("block"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("role")))
    slices = F.ceil(F.col("words") / SLICE_WORDS).cast("int")
    mine = F.pmod(F.xxhash64("word"), slices).cast("int")
    every = F.sequence(F.lit(0), slices - 1)
    roles = F.concat(F.transform(every, lambda x: F.struct(mine.alias("i"), x.alias("j"), F.lit(1).alias("role"))),
                     F.transform(every, lambda x: F.struct(x.alias("i"), mine.alias("j"), F.lit(2).alias("role"))))
    sliced = rows.where("words IS NOT NULL").select("word", "n", "m", key.alias("block"), F.explode(roles).alias("x")).select("word", "n", "m", "block", "x.*")

    def run(table: pa.Table) -> pa.Table:
        m, role, words = table.column("m").to_numpy(), table.column("role").to_numpy(), table.column("word").to_pylist()
        out, n = [], table.column("n")
        for size in np.unique(m).tolist():
            index, query = np.flatnonzero((m == size) & (role != 2)), np.flatnonzero((m == size) & (role != 1))
            # A word has a row for each of its halves that fell into this block.
            index = np.array(list({words[i]: i for i in index.tolist()}.values()), np.int64)
            query = np.array(list({words[i]: i for i in query.tolist()}.values()), np.int64)
            q, w = PositionIndex([words[i] for i in index]).near([words[i] for i in query])
            out.append(np.stack([query[q], index[w]]))
        at = np.concatenate(out, axis=1)
        return pa.table({"word": table.column("word").take(at[0]), "near": table.column("word").take(at[1]), "near_n": n.take(at[1])})

    found = plain.unionByName(sliced).groupBy("block", "i", "j").applyInArrow(run, "word string, near string, near_n long")
    return found.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of (word, n)."""
    words = written(words, "spelling-words")
    best = near_pairs(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    isform = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", F.when(isform, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(isform, -F.col("best.less")).alias("form_n"))
    out = written(out, "spelling-forms")
    return out.join(_roots(out, ratio), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root) of the words with a form, by doubling: counts grow ``ratio``-fold along a chain, which bounds the rounds."""
    roots = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most, least = forms.where("form IS NOT NULL").agg(F.max("form_n"), F.min("n")).first()
    chain = 0 if most is None else int(math.log(max(most / max(least, 1), 1), ratio)) + 1
    for _ in range(math.ceil(math.log2(chain)) if chain > 1 else 0):
        roots = written(roots, "spelling-roots")
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return roots


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` (doc_id, text) with their forms; null and empty texts have no words, repeated rows count each."""
    return variants(vocabulary(docs))


def spelling_sql() -> str:
    """DuckDB SQL of ``spelling_groups``: checksums byte by byte, near words by deleting each letter."""
    return f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
           lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
counted AS (
  SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h
  FROM runs WHERE length(run) >= {MIN_CHARS} GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2),
             lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM counted, crc_table),
slipped AS (
  SELECT CASE WHEN crc % {SLIP} = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, n
  FROM hashed),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
ranked AS (
  SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= {RATIO} * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chain AS (
  SELECT word, word AS last, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON c.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(last, d) AS root FROM chain GROUP BY word) c ON f.word = c.word
"""
