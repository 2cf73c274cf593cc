"""Best-fit packing by minimum bin slack.

Pieces differ only in their length, and there are at most ``capacity`` lengths.
So bins are planned over the counts of the lengths, however many pieces there
are: the longest length left opens a bin, a bitset subset-sum programme over the
available lengths finds the combination that leaves the least slack, and it is
removed as often as the counts allow - the same bins that removing it once at a
time would give. Pieces are then numbered within their length, in salted
buckets, and find their bin and place by that number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import ENCODE_BYTES, steps, written
from shelfwise.llm.tokens import encoder

# Pieces of one length that one task numbers.
BUCKET_ROWS = 1_000
# Buckets of a length that are summed up at once.
GROUP_BUCKETS = 1_000


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bit, if kept).

    A document is its text's ids and then ``end_id``; a null or empty text gives
    the end id alone. One longer than ``capacity`` is cut into pieces of that
    many ids, of which the first may be shorter. Null ids and repeated rows are
    documents like any other. Other columns are not read.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in steps(batches, limit=ENCODE_BYTES):
            ids, counts = enc.encode(batch.column("text"))
            cols: list[list] = [[] for _ in fields]
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts):
                own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4")
                at += n
                first = len(own) % capacity or capacity
                cuts = [0, *range(first, len(own) + 1, capacity)] if len(own) > capacity else [0, len(own)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    data = own[a:b].tobytes()
                    for col, value in zip(cols, (doc, k, a, b - a, zlib.crc32(data), data)):
                        col.append(value)
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, copies of each length in one of them), for counts of lengths from 1 to ``capacity``."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    plan = []
    while left:
        longest = next(iter(left))
        copies = {longest: 1}
        room = capacity - longest
        full, mask = 1 << room, (2 << room) - 1
        reach, trail = 1, []
        for n, c in left.items():
            if n > room:
                continue
            c = min(c - (n == longest), room // n)
            step = 1
            while c > 0 and not reach & full:
                take = min(step, c)
                trail.append((n, take, reach))
                reach |= (reach << n * take) & mask
                c -= take
                step *= 2
            if reach & full:
                break
        total = reach.bit_length() - 1
        for n, take, before in reversed(trail):
            if not before >> total & 1:
                total -= n * take
                copies[n] = copies.get(n, 0) + take
        bins = min(left[n] // k for n, k in copies.items())
        plan.append((bins, copies))
        for n, k in copies.items():
            left[n] -= bins * k
            if not left[n]:
                del left[n]
    return plan


def _lookup(plan: list[tuple[int, dict[int, int]]], capacity: int) -> dict[int, np.ndarray]:
    """For each length, a row for each kind of bin that holds it: first number, copies, first bin, offset."""
    rows: dict[int, list] = {}
    given: dict[int, int] = {}
    base = 0
    for bins, copies in plan:
        offset = 0
        for n, k in copies.items():
            rows.setdefault(n, []).append((given.get(n, 0), k, base, offset))
            given[n] = given.get(n, 0) + bins * k
            offset += n * k
        base += bins
    return {n: np.asarray(r, dtype=np.int64) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 1024, bucket_rows: int = BUCKET_ROWS, group_buckets: int = GROUP_BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column ``length`` of 1 to ``capacity``.

    Every row is placed once, repeated rows too; a bin's offsets have no gap. No
    rows give no bins. What the driver holds are counts of at most ``capacity``
    lengths and a plan of at most capacity * ln(capacity) kinds of bins. The
    columns ``sequence_id`` and ``offset`` must be free.
    """
    pieces = written(pieces.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    table = _lookup(plan_bins(counts, capacity), capacity)

    buckets = F.array(*[F.lit(max(1, -(-counts.get(n, 0) // bucket_rows))) for n in range(capacity + 1)])
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_uid"), F.get(buckets, F.col("length").cast("int")).cast("long")))
    sizes = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    # Pieces before a bucket, in two steps: a length with many buckets isn't summed up in one task.
    sizes = sizes.withColumn("_group", F.floor(F.col("_bucket") / group_buckets))
    groups = sizes.groupBy("length", "_group").agg(F.sum("_n").alias("_all"))
    groups = groups.select("length", "_group", (F.sum("_all").over(Window.partitionBy("length").orderBy("_group")) - F.col("_all")).alias("_first"))
    inner = F.sum("_n").over(Window.partitionBy("length", "_group").orderBy("_bucket")) - F.col("_n")
    before = sizes.withColumn("_inner", inner).join(groups, ["length", "_group"]).select("length", "_bucket", (F.col("_first") + F.col("_inner")).alias("_before"))
    place = Window.partitionBy("length", "_bucket").orderBy("_uid")
    numbered = (pieces.withColumn("_row", F.row_number().over(place) - 1).join(before, ["length", "_bucket"])
                .withColumn("_row", F.col("_row") + F.col("_before")))

    kept = [f for f in pieces.schema.fields if f.name not in ("_uid", "_bucket")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("_row").to_numpy()
            length = batch.column("length").to_numpy()
            seq, off = np.zeros(len(number), dtype=np.int64), np.zeros(len(number), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                t = table[int(length[own[0]])]
                at = np.searchsorted(t[:, 0], number[own], side="right") - 1
                turn, copy = np.divmod(number[own] - t[at, 0], t[at, 1])
                seq[own] = t[at, 2] + turn
                off[own] = t[at, 3] + copy * length[own]
            yield pa.record_batch([batch.column(f.name) for f in kept] + [pa.array(seq), pa.array(off)],
                                  names=[f.name for f in kept] + ["sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    columns = [*(f.name for f in kept), "_row"]
    return numbered.select(*columns).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """``cut_pieces`` and ``pack``: every piece of every document with its sequence and place."""
    return pack(cut_pieces(docs, tokenizer, capacity, end_id, keep_ids), capacity)
