"""Benchmark decontamination by spaced-seed hashing.

A mask of word positions, some of them ignored, slides over documents and
benchmark items; its hash doesn't change when a word at an ignored position
does. The first two masks below hit every 16-word stretch with three substitutions
at most, and with the others every item of 8 to 15 words of which at least 80 % are
the same. Documents' hashes pass a Bloom filter of the items' hashes (of fixed size,
so the benchmark may grow), survivors are joined with the items, and each
diagonal that a hit lies on - document position less item position - is verified
word by word: an overlap is every window of 16 item words (or the whole item, if
shorter) of which at least 80 % are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name, steps, written

LONG_MASKS = ("11101011", "11001000111")
MASKS = LONG_MASKS + ("111111", "11010111", "1111011", "11100111", "110110011")
WINDOW, SAME_PERCENT, MIN_ITEM_WORDS = 16, 80, 8
# The Bloom filter: bits for each hash of an item, and at most (16 MB).
BITS_PER_HASH, MAX_BITS = 1024, 1 << 27
PUNCTUATION = "!\"'(),-.:;?[]{}"

_DROP = PUNCTUATION.encode()


def words_of(text: str | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return (text or "").encode().lower().translate(None, _DROP).split()


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def seeds(texts: list[str | None], masks: tuple[str, ...]):
    """(words of each text, where each ends, [(mask's number, places, hashes)]) over all words in a row."""
    words = [words_of(t) for t in texts]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    h = xxhash.xxh3_64_intdigest
    x = np.asarray([h(w) for own in words for w in own], dtype=np.uint64)
    last = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    found = []
    with np.errstate(over="ignore"):
        for k, mask in enumerate(masks):
            span = len(mask)
            at = np.arange(max(0, len(x) - span + 1))
            at = at[at + span <= last[at]]
            value = np.full(len(at), k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for j, bit in enumerate(mask):
                if bit == "1":
                    value = value * np.uint64(0xD6E8FEB86659FD93) + x[at + j]
            found.append((k, at, _mix(value)))
    return words, ends, found


def _plan(lengths: list[int], masks: tuple[str, ...]) -> dict[int, tuple[str, ...]]:
    """The masks for items of each length (``WINDOW`` for longer ones), which together hit every pattern of substitutions.

    Masks count in their order, those that hit nothing more are left out; what
    none hits in a short item gets a mask of the item's length each.
    """
    out = {}
    for n in sorted({min(n, WINDOW) for n in lengths}):
        left, used = list(combinations(range(n), n * (100 - SAME_PERCENT) // 100)), []
        for mask in masks:
            places = [{at + j for j, bit in enumerate(mask) if bit == "1"} for at in range(n - len(mask) + 1)]
            rest = [bad for bad in left if all(p.intersection(bad) for p in places)]
            if len(rest) < len(left):
                left, used = rest, used + [mask]
        if n < WINDOW:
            used += ["".join("0" if j in bad else "1" for j in range(n)) for bad in left]
        out[n] = tuple(used)
    return out


def _item_seeds(items: DataFrame, masks: tuple[str, ...], plan: dict[int, tuple[str, ...]]) -> DataFrame:
    """(item, mask, item_word, hash) of every mask that ``plan`` has for an item's length, at every place of the item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            _, ends, found = seeds(batch.column("text").to_pylist(), masks)
            begins = np.concatenate([[0], ends[:-1]])
            length = np.minimum(ends - begins, WINDOW)
            for k, at, value in found:
                own = np.searchsorted(ends, at, side="right")
                meant = np.isin(length[own], [n for n, used in plan.items() if masks[k] in used])
                own, at, value = own[meant], at[meant], value[meant]
                yield pa.record_batch([batch.column("item").take(pa.array(own)), pa.array(np.full(len(at), k, dtype=np.int32)),
                                       pa.array((at - begins[own]).astype(np.int32)), pa.array(value.view(np.int64))],
                                      names=["item", "mask", "item_word", "hash"])

    return items.mapInArrow(run, "item long, mask int, item_word int, hash long")


def _bloom(hashes: DataFrame) -> np.ndarray:
    """The words of a Bloom filter of the column ``hash``: as many bits as hashes need, at most ``MAX_BITS``."""
    n = max(1, hashes.count())
    size = min(MAX_BITS, 1 << max(12, (n * BITS_PER_HASH - 1).bit_length()))
    bits = F.explode(F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(size - 1).cast("long")) for s in (0, 18, 37)])).alias("bit")
    rows = (hashes.select(bits).groupBy(F.shiftrightunsigned("bit", 5).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toPandas())
    out = np.zeros(size >> 5, dtype=np.uint32)
    out[rows["at"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out


def _passes(bloom: np.ndarray, value: np.ndarray) -> np.ndarray:
    mask, at = np.uint64(len(bloom) * 32 - 1), np.arange(len(value))
    for shift in (0, 18, 37):
        bit = value[at] >> np.uint64(shift) & mask
        at = at[(bloom[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)]
    return at


def _segments(docs: DataFrame, masks: tuple[str, ...], bloom, flank: int) -> DataFrame:
    """Stretches of documents around possible hits: doc, hash of text, first word, words, hits.

    Hits less than two flanks apart share a stretch, so all of a diagonal of an
    item of ``flank`` words at most lies in one.
    """
    hit = pa.list_(pa.struct([("mask", pa.int32()), ("word", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bloom.value
        for batch in steps(batches):
            words, ends, found = seeds(batch.column("text").to_pylist(), masks)
            begins = np.concatenate([[0], ends[:-1]])
            passed = [(k, at[i], value[i]) for k, at, value in found for i in [_passes(table, value)]]
            at = np.concatenate([a for _, a, _ in passed])
            order = np.argsort(at, kind="stable")
            at = at[order]
            kinds = np.concatenate([np.full(len(a), k) for k, a, _ in passed])[order]
            value = np.concatenate([v for *_, v in passed])[order].view(np.int64)
            if not len(at):
                continue
            own = np.searchsorted(ends, at, side="right")
            cuts = np.flatnonzero((np.diff(own) > 0) | (np.diff(at) > 2 * flank)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                i = int(own[a])
                first = max(int(begins[i]), int(at[a]) - flank)
                end = min(int(ends[i]), int(at[b - 1]) + flank)
                text = b" ".join(words[i][first - int(begins[i]):end - int(begins[i])])
                hits = [{"mask": int(k), "word": int(p) - first, "hash": int(v)} for k, p, v in zip(kinds[a:b], at[a:b], value[a:b])]
                rows.append((i, first - int(begins[i]), text.decode(), hits))
            index, start, text, hits = map(list, zip(*rows))
            yield pa.record_batch([batch.column("doc").take(pa.array(index)), batch.column("text_hash").take(pa.array(index)),
                                   pa.array(start, pa.int32()), pa.array(text), pa.array(hits, hit)],
                                  names=["doc", "text_hash", "start", "words", "hits"])

    return docs.mapInArrow(run, "doc long, text_hash long, start int, words string, hits array<struct<mask:int, word:int, hash:long>>")


def overlaps(words: list, item: list, shift: int, window: int = WINDOW, same_percent: int = SAME_PERCENT) -> tuple[int, int, int, int] | None:
    """(first word in the text, in the item, words, same words) covered on a diagonal, or None.

    ``shift`` is the text's place of the item's first word. Windows lie inside both.
    """
    window = min(window, len(item))
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    if not window or b - a < window:
        return None
    same = np.fromiter((words[shift + i] == item[i] for i in range(a, b)), dtype=np.int64, count=b - a)
    sums = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(100 * (sums[window:] - sums[:-window]) >= same_percent * window)
    if not len(good):
        return None
    marks = np.zeros(b - a + 1, dtype=np.int64)
    np.add.at(marks, good, 1)
    np.add.at(marks, good + window, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return int(shift + a + good[0]), int(a + good[0]), int(covered.sum()), int(same[covered].sum())


def _find(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], min_item_words: int) -> DataFrame:
    """Rows (doc, text_hash, item, place of the item's first word, overlap), distinct."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc"), "text", F.xxhash64("text").alias("text_hash"))
    counted = F.size(F.expr(f"regexp_extract_all(translate(text, {_sql_text(PUNCTUATION)}, ''), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))
    # An item is known by its id and text, as ids may be null or come twice.
    items = (items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
             .withColumns({"n": counted, "item": F.xxhash64("item_id", "text")}).where(F.col("n") >= min_item_words)
             .dropDuplicates(["item"]))
    shape = items.agg(F.max("n"), F.collect_set(F.least("n", F.lit(WINDOW)))).first()
    plan = _plan(shape[1], masks)
    masks = tuple(dict.fromkeys(m for used in plan.values() for m in used)) or masks
    item_seeds = written(_item_seeds(items, masks, plan), "item-seeds")
    bloom = spark.sparkContext.broadcast(_bloom(item_seeds.select("hash")))
    found = _segments(docs, masks, bloom, (shape[0] or 0) + max(map(len, masks)))
    found = written(found.withColumn("segment", F.monotonically_increasing_id()), "segments")

    hits = found.select("segment", F.explode("hits").alias("h")).select("segment", "h.mask", "h.word", "h.hash")
    diagonals = (hits.join(item_seeds, ["mask", "hash"]).select("segment", "item", (F.col("word") - F.col("item_word")).alias("shift"))
                 .distinct())
    pairs = (diagonals.join(found.select("segment", "doc", "text_hash", "start", "words"), "segment")
             .join(items.select("item", "item_id", "text"), "item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (text, words, shift, start) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "words", "shift", "start")))):
                got = overlaps(words.encode().split(), words_of(text), shift)
                if got:
                    rows.append((i, got[0] + start, *got[1:]))
            at, *cols = zip(*rows) if rows else ((),) * 5
            keys = [batch.column(c).take(pa.array(at, pa.int32())) for c in ("doc", "text_hash", "item_id")]
            yield pa.record_batch(keys + [pa.array(c, pa.int64()) for c in cols],
                                  names=["doc_id", "text_hash", "item_id", "doc_word", "item_word", "n_words", "n_same"])

    return pairs.select("doc", "text_hash", "item_id", "start", "words", "shift", "text").mapInArrow(
        run, "doc_id long, text_hash long, item_id long, doc_word long, item_word long, n_words long, n_same long")


def _sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_item_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """A row for each verified overlap: doc_id, item_id, doc_word, item_word (first words), n_words, n_same.

    Documents without one have no row. Texts that are null or have no words
    overlap nothing; items of less than ``min_item_words`` words are too short
    to tell; null ids are carried; a repeated document or item gives its rows once.
    Other columns are not read.
    """
    return _find(docs, benchmark, masks, min_item_words).drop("text_hash").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_item_words: int = MIN_ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns; rows are told apart by doc_id and text.

    Null and empty texts overlap nothing, so their rows stay; a row without a
    doc_id goes if its own text overlaps. The ids to drop are written first, so
    that the planner sees how few they are and needn't shuffle the texts.
    """
    h, bad_id, bad_hash = (free_name(docs, x) for x in ("_text_hash", "_bad_id", "_bad_hash"))
    bad = _find(docs, benchmark, masks, min_item_words).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_hash)).distinct()
    bad = written(bad, "contaminated")
    out = docs.withColumn(h, F.xxhash64("text"))
    out = out.join(bad, bad[bad_hash].eqNullSafe(out[h]) & bad[bad_id].eqNullSafe(out["doc_id"].cast("long")), "left_anti")
    return out.select(*docs.columns)


def contaminated_sql(min_item_words: int = MIN_ITEM_WORDS) -> str:
    """DuckDB SQL of ``contaminated`` for items of any length, without masks: every diagonal with enough equal words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    drop = PUNCTUATION.replace("'", "''")

    def words(table, key):
        return (f"SELECT DISTINCT {key} AS id, list_filter(string_split_regex(translate(translate(coalesce(text, ''), '{upper}', '{lower}'), "
                f"'{drop}', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM {table}")

    return f"""
WITH d AS ({words('documents', 'doc_id')}),
b AS (SELECT * FROM ({words('benchmark', 'item_id')}) WHERE len(ws) >= {min_item_words}),
ds AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
bs AS (SELECT id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM b),
g AS (SELECT ds.id AS doc, bs.id AS item, ds.i - bs.i AS shift FROM ds JOIN bs USING (w) GROUP BY doc, item, shift
      HAVING 100 * count(*) >= {SAME_PERCENT} * least({WINDOW}, any_value(n))),
p AS (SELECT doc, item, shift, least({WINDOW}, len(b.ws)) AS win, unnest(range(greatest(0, -shift), least(len(b.ws), len(d.ws) - shift))) AS i,
  d.ws AS dw, b.ws AS bw FROM g JOIN d ON d.id = doc JOIN b ON b.id = item),
e AS (SELECT doc, item, shift, win, i, (dw[shift + i + 1] = bw[i + 1])::INT AS same FROM p),
f AS (SELECT *, sum(same) OVER w AS s, count(*) OVER w AS n FROM e
  WINDOW w AS (PARTITION BY doc, item, shift ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
c AS (SELECT *, bool_or(n = win AND 100 * s >= {SAME_PERCENT} * win) OVER (PARTITION BY doc, item, shift ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS cov FROM f)
SELECT doc AS doc_id, item AS item_id, min(i + shift)::BIGINT AS doc_word, min(i)::BIGINT AS item_word,
  count(*) AS n_words, sum(same)::BIGINT AS n_same
FROM c WHERE cov GROUP BY doc, item, shift
"""
