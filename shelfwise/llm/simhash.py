"""SimHash near-duplicates, found by pivot distance tables.

Fingerprints linked at d bits or fewer have, to any reference fingerprint
(pivot), Hamming distances that differ by d at most. Two kinds of pivots are
used, all fixed by a seed:

* block pivots equal a base pivot outside one block of bits and are random
  inside it. A fingerprint's distances to them, less that to the base, depend on
  its bits in the block alone. With d + 3 blocks, two linked fingerprints have
  the same distances for all pivots of at least 3 blocks; so every choice of 3
  blocks gives a key, and linked fingerprints meet under one of the keys.
* whole pivots are random; pairs that met are discarded when their greatest
  coordinate difference exceeds d, and survivors are verified bit by bit.

Only distinct fingerprints are compared. A key that more than ``group_limit``
fingerprints share isn't paired: each of them is sent to every value at one bit
(and itself; d/2 bits in general) from it, and values that meet link their
members to the least - exact, and with as many rows as members.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import free_name, steps, written
from shelfwise.llm.components import components

SEED = 42
SHARED_BLOCKS = 3
PIVOTS_PER_BLOCK = 8
WHOLE_PIVOTS = 8
GROUP_LIMIT = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint, as a signed number; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes split at the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [h64(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [h64(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1:].tolist())]
    count = np.zeros(64, dtype=np.int64)
    values = np.asarray(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 18):
        part = values[at:at + (1 << 18)].view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(values), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, name: str, shingle: int = 3, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or some of its columns) and the fingerprint of ``text`` as the long column ``name``."""
    kept = [f for f in docs.schema.fields if columns is None or f.name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            found = pa.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.record_batch([*(batch.column(f.name) for f in kept), found], names=[*(f.name for f in kept), name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{name}` long"])
    return docs.select(*dict.fromkeys([f.name for f in kept] + ["text"])).mapInArrow(run, schema)


class Pivots:
    """Blocks, reference fingerprints and the expressions of their distance tables."""

    def __init__(self, max_bits: int, per_block: int = PIVOTS_PER_BLOCK, whole: int = WHOLE_PIVOTS):
        rng = random.Random(SEED)
        n = max_bits + SHARED_BLOCKS
        cuts = [64 * i // n for i in range(n + 1)]
        self.blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        self.base = rng.getrandbits(64)
        self.inside = [[self.base & ~mask | rng.getrandbits(64) & mask for _ in range(per_block)] for mask in self.blocks]
        self.whole = [rng.getrandbits(64) for _ in range(whole)]
        self.choices = list(combinations(range(n), SHARED_BLOCKS))

    @staticmethod
    def _distance(fp: Column, pivot: int) -> Column:
        return F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))))

    def block_keys(self, fp: Column) -> list[Column]:
        """For each block, its pivots' distances less the base's, as one number."""
        base = self._distance(fp, self.base)
        keys = []
        for pivots in self.inside:
            key = F.lit(0).cast("long")
            for p in pivots:
                key = key * 128 + (self._distance(fp, p) - base + 64)
            keys.append(key)
        return keys

    def coordinates(self, fp: Column) -> Column:
        """The distances to the whole pivots, eight bits each."""
        out = F.lit(0).cast("long")
        for p in self.whole[:8]:
            out = F.shiftleft(out, 8).bitwiseOR(self._distance(fp, p).cast("long"))
        return out

    def near(self, a: Column, b: Column, max_bits: int) -> Column:
        """Whether no coordinate differs by more than ``max_bits``."""
        byte = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255).cast("long"))
        ok = F.lit(True)
        for i in range(min(8, len(self.whole))):
            ok = ok & (F.abs(byte(a, i) - byte(b, i)) <= max_bits)
        return ok


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fingerprints: DataFrame, max_bits: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b) between distinct fingerprints (one long column ``fp``) that join exactly those at ``max_bits`` or fewer.

    Pairs under common keys stand for themselves. Members of a larger group are
    linked, through the value between them, to the least member that meets there;
    such a pair may differ by ``max_bits`` at most as well.
    """
    pivots = Pivots(max_bits)
    keys = fingerprints.withColumn("_b", F.array(*pivots.block_keys(F.col("fp"))))
    tables = F.array(*[F.struct(F.lit(i).alias("choice"), F.xxhash64(*[F.col("_b")[b] for b in c]).alias("key"))
                       for i, c in enumerate(pivots.choices)])
    rows = (keys.select("fp", pivots.coordinates(F.col("fp")).alias("at"), F.explode(tables).alias("t"))
            .select("fp", "at", "t.choice", "t.key"))
    shared = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(shared, ["choice", "key"]), "simhash-met")

    few = met.where(F.col("n") <= group_limit)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
                   & (F.col("a.fp") < F.col("b.fp")) & pivots.near(F.col("a.at"), F.col("b.at"), max_bits)
                   & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits))
    pairs = pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    many = met.where(F.col("n") > group_limit).select("fp").distinct()
    radius = max_bits // 2
    flips = [0, *(sum(1 << i for i in c) for k in range(1, radius + 1) for c in combinations(range(64), k))]
    around = many.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(x)) for x in flips]),
                                                     lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))
    if max_bits % 2:  # for an odd distance the middle is an edge: its least end's value stands for both
        around = (around.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(1 << i)) for i in range(64)]),
                                                            lambda x: F.struct(x.alias("bit"), F.col("value").bitwiseAND(F.bitwise_not(x)).alias("value")))).alias("e"))
                  .select("fp", F.xxhash64("e.bit", "e.value").alias("value")).distinct())
    least = around.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    through = around.join(least, "value").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return pairs.union(through).distinct()


def _groups(marked: DataFrame, fp: str, max_bits: int, group_limit: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint that has a link."""
    distinct = marked.select(F.col(fp).alias("fp")).distinct()
    return components(links(distinct, max_bits, group_limit)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex) and component_id, the least doc_id reachable by links.

    A null or empty text, and one without words, has fingerprint zero and is
    linked like any other. Repeated rows are copies of each other. Null ids are
    passed over for the component's id, which is null only if all its ids are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = written(with_fingerprints(docs, "fp", shingle, ["doc_id"]), "simhash-fp")
    first = marked.groupBy("fp").agg(F.min("doc_id").alias("doc"))
    roots = first.join(_groups(marked, "fp", max_bits, group_limit), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("doc").alias("component_id"))
    names = roots.join(ids, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The row with the least doc_id of each component, with all its columns; null ids come last, of equal ids one stays.

    A null or empty text is linked like any other. The numbers of the rows that
    go are written first: where they are few, the planner needn't shuffle the texts.
    """
    uid = free_name(docs, "_uid")
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")  # so that the numbers stay
    marked = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(uid).alias("u"), "text")
    marked = written(with_fingerprints(marked, "fp", shingle, ["doc_id", "u"]), "simhash-fp")
    small = marked.select("fp", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "u").alias("id"))
    first = small.groupBy("fp").agg(F.min("id").alias("id"))
    roots = first.join(_groups(small, "fp", max_bits, group_limit), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    stays = roots.groupBy("root").agg(F.min("id").alias("id"))
    stays = roots.select("fp", "root").join(stays, "root").select("fp", F.col("id.u").alias("stays"))
    gone = written(marked.join(stays, "fp").where("u <> stays").select(F.col("u").alias(uid)), "simhash-gone")
    return rows.join(gone, uid, "left_anti").select(*docs.columns)
