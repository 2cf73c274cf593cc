"""Token files: a wavelet matrix per shard, written by tasks and read back.

A file holds the ids of many documents in a row, in blocks that fit a processor's
cache. A block's distinct ids are numbered, and the numbers' bits are kept as
planes, most significant first; under each plane, positions are stably parted by
the bit. With ranks of the planes, one file answers: the token at a place, how
often a token comes before a place, and where its k-th occurrence is.

    bytes 0-7    b"SWTOKEN1"
    bytes 8-15   length of the JSON header, little-endian
    header       for each section, its type, offset and shape
    sections     doc ids, null marks, document lengths; then for each block its
                 number of ids, distinct ids, zeros of each plane, planes (64-bit
                 words), ranks (ones before each 256 bits), all little-endian
"""

from __future__ import annotations

import json
import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import ENCODE_BYTES, new_folder, shared_folder, steps, write_file, written
from shelfwise.llm.tokens import encoder

MAGIC = b"SWTOKEN1"
# Text of one writing task at most (small inputs are dealt to TASKS_PER_CORE tasks), and ids after which it begins another file.
TASK_BYTES, SHARD_IDS = 256 << 20, 6_000_000
# Text that is worth a task of its own, and ids of one reading task at most.
SMALL_BYTES, READ_IDS = 4 << 20, 64_000_000
TASKS_PER_CORE = 8
BLOCK_IDS = 1 << 18
# Writing tasks whose files are numbered together.
RUN_PARTS = 1024


class WaveletMatrix:
    """Access, counting and occurrence lookup over a sequence of ids; positions and ids may be arrays."""

    def __init__(self, n, symbols, zeros, words, ranks):
        self.n, self.symbols, self.zeros, self.words, self.ranks = n, symbols, zeros, words, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        if n:
            seen = np.zeros(int(ids.max()) + 1, dtype=bool)
            seen[ids] = True
            symbols = np.flatnonzero(seen).astype(np.uint32)
            number = np.zeros(len(seen), dtype=np.uint16 if len(symbols) <= 1 << 16 else np.uint32)
            number[symbols] = np.arange(len(symbols))
            at = number[ids]
        else:
            symbols, at = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.uint16)
        planes = max(len(symbols) - 1, 0).bit_length()
        blocks = n // 256 + 1
        words = np.zeros((planes, blocks * 4), dtype=np.uint64)
        ranks = np.zeros((planes, blocks), dtype=np.uint32)
        zeros = np.zeros(planes, dtype=np.int64)
        for p in range(planes):
            bit = (at >> (planes - 1 - p) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words[p].view(np.uint8)[:len(packed)] = packed
            ones = np.bitwise_count(words[p]).reshape(-1, 4).sum(axis=1)
            ranks[p, 1:] = np.cumsum(ones)[:-1]
            zeros[p] = n - int(ones.sum())
            at = np.concatenate([np.compress(~bit, at), np.compress(bit, at)])  # many times faster than by a mask
        return cls(n, symbols, zeros, words, ranks)

    def _ones(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane p before each position."""
        block, word = i >> 8, i >> 6
        out = self.ranks[p, block].astype(np.int64)
        for k in range(4):
            w = (block << 2) + k
            bits = self.words[p, w]
            part = bits & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
            out += np.where(w < word, np.bitwise_count(bits), np.where(w == word, np.bitwise_count(part), 0))
        return out

    def _bit(self, p: int, i: np.ndarray) -> np.ndarray:
        return (self.words[p, i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def access(self, places) -> np.ndarray:
        """Ids at places."""
        i = np.asarray(places, dtype=np.int64)
        value = np.zeros(i.shape, dtype=np.int64)
        for p in range(len(self.zeros)):
            bit, ones = self._bit(p, i), self._ones(p, i)
            value = value << 1 | bit
            i = np.where(bit, self.zeros[p] + ones, i - ones)
        return self.symbols[value]

    def _range(self, token: int, end: int) -> tuple[int, int, int]:
        """(number, begin, end) of a token's range under the last plane, among the first ``end`` ids."""
        s = int(np.searchsorted(self.symbols, token))
        if s == len(self.symbols) or self.symbols[s] != token:
            return -1, 0, 0
        a, b = 0, end
        for p in range(len(self.zeros)):
            ones = self._ones(p, np.asarray([a, b], dtype=np.int64))
            if s >> (len(self.zeros) - 1 - p) & 1:
                a, b = (self.zeros[p] + ones).tolist()
            else:
                a, b = a - int(ones[0]), b - int(ones[1])
        return s, a, b

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before a place, or in all."""
        _, a, b = self._range(token, self.n if end is None else end)
        return b - a

    def select(self, token: int, k) -> np.ndarray:
        """Places of occurrences number k (from 0) of a token."""
        s, a, b = self._range(token, self.n)
        i = a + np.asarray(k, dtype=np.int64)
        if np.any((i < a) | (i >= b)):
            raise IndexError("no such occurrence")
        for p in reversed(range(len(self.zeros))):
            one = bool(s >> (len(self.zeros) - 1 - p) & 1)
            i = self._place(p, one, i - self.zeros[p] if one else i)
        return i

    def _place(self, p: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Position of one (or zero) number k in plane p, by bisection over its ranks."""
        lo, hi = np.zeros(k.shape, dtype=np.int64), np.full(k.shape, self.n, dtype=np.int64)
        while np.any(lo + 1 < hi):
            mid = lo + hi >> 1
            ones = self._ones(p, mid)
            left = (ones if one else mid - ones) > k
            lo, hi = np.where(left, lo, mid), np.where(left, mid, hi)
        return lo

    def decode(self) -> np.ndarray:
        """All ids, by joining what each plane parted, last plane first."""
        at = np.zeros(self.n, dtype=np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for p in reversed(range(len(self.zeros))):
            bit = np.unpackbits(self.words[p].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(at)
            up[np.flatnonzero(~bit)] = at[:self.zeros[p]]
            up[np.flatnonzero(bit)] = at[self.zeros[p]:] | at.dtype.type(1 << (len(self.zeros) - 1 - p))
            at = up
        return self.symbols[at] if self.n else np.empty(0, dtype=np.uint32)


class TokenFile:
    """Documents and their ids, in blocks of at most ``BLOCK_IDS``; places count through all blocks."""

    def __init__(self, doc_ids: list, lengths: np.ndarray, blocks: list[WaveletMatrix]):
        self.doc_ids, self.lengths, self.blocks = doc_ids, lengths, blocks
        self.firsts = np.concatenate([[0], np.cumsum([b.n for b in blocks], dtype=np.int64)])

    @classmethod
    def build(cls, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, block_ids: int = BLOCK_IDS) -> TokenFile:
        return cls(doc_ids, lengths, [WaveletMatrix.build(ids[i:i + block_ids]) for i in range(0, len(ids), block_ids)])

    def access(self, places) -> np.ndarray:
        """Ids at places."""
        places = np.asarray(places, dtype=np.int64)
        own = np.searchsorted(self.firsts, places, side="right") - 1
        out = np.zeros(places.shape, dtype=np.uint32)
        for k in np.unique(own):
            out[own == k] = self.blocks[k].access(places[own == k] - self.firsts[k])
        return out

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before a place, or in all."""
        end = int(self.firsts[-1]) if end is None else end
        return sum(b.count(token, min(b.n, end - int(first))) for b, first in zip(self.blocks, self.firsts) if first < end)

    def select(self, token: int, k: int) -> int:
        """Place of occurrence number k (from 0) of a token."""
        for block, first in zip(self.blocks, self.firsts):
            n = block.count(token)
            if 0 <= k < n:
                return int(first) + int(block.select(token, k))
            k -= n
        raise IndexError("no such occurrence")

    def decode(self) -> np.ndarray:
        return np.concatenate([b.decode() for b in self.blocks]) if self.blocks else np.empty(0, dtype=np.uint32)

    def to_bytes(self) -> bytes:
        null = np.asarray([d is None for d in self.doc_ids], dtype=bool)
        parts = [np.asarray([d or 0 for d in self.doc_ids], dtype="<i8"), null.astype("u1"), self.lengths.astype("<i8")]
        for b in self.blocks:
            parts += [np.asarray([b.n], dtype="<i8"), b.symbols.astype("<u4"), b.zeros.astype("<i8"), b.words.astype("<u8"), b.ranks.astype("<u4")]
        sections, at = [], 0
        for a in parts:
            sections.append([a.dtype.str, at, list(a.shape)])
            at += a.nbytes
        head = json.dumps(sections).encode()
        return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *(a.tobytes() for a in parts)])

    @classmethod
    def from_bytes(cls, data) -> TokenFile:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        end = 16 + int.from_bytes(data[8:16], "little")
        ids, null, lengths, *rest = [np.frombuffer(data, dtype, int(np.prod(shape)), end + at).reshape(shape)
                                     for dtype, at, shape in json.loads(bytes(data[16:end]))]
        blocks = [WaveletMatrix(int(n[0]), *part) for n, *part in (rest[i:i + 5] for i in range(0, len(rest), 5))]
        return cls([None if empty else d for d, empty in zip(ids.tolist(), null.tolist())], lengths, blocks)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0,
                 shard_bytes: int = TASK_BYTES, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order; a row per file: file, part, seq, n_docs, n_tokens.

    ``folder`` must be a new one that all tasks reach. A file is written under another
    name and then renamed, so a task that runs again finds its own file or none.
    Null ids come first; rows with the same id are in the order of their texts'
    hash and text. A null text is an empty one: its document is the end id.
    Other columns are not read. No rows give no files. A task takes ``shard_bytes``
    of text at most, but for one longer text, and writes a file for about
    ``shard_ids`` ids.
    """
    new_folder(folder)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ["doc_id", "_hash"]
    parts = max(size // shard_bytes, min(size // SMALL_BYTES, TASKS_PER_CORE * docs.sparkSession.sparkContext.defaultParallelism)) + 1
    dealt = (docs.withColumn("_hash", F.xxhash64("text")).repartitionByRange(parts, *keys)
             .sortWithinPartitions(*keys, "text").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        own: list[tuple[list, np.ndarray, np.ndarray]] = []
        seq = total = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, total
            ids = np.concatenate([x[2] for x in own])
            names, lengths = [d for x in own for d in x[0]], np.concatenate([x[1] for x in own])
            own.clear()
            file = f"part-{part:06d}-{seq:04d}.tokens"
            write_file(folder, file, [TokenFile.build(names, lengths, ids).to_bytes()])
            row = pa.record_batch([pa.array([x]) for x in (file, part, seq, len(names), len(ids))],
                                  names=["file", "part", "seq", "n_docs", "n_tokens"])
            seq, total = seq + 1, 0
            return row

        for batch in steps(batches, limit=ENCODE_BYTES):
            ids, counts = enc.encode(batch.column("text"))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id)
            own.append((batch.column("doc_id").to_pylist(), counts + 1, ids))
            total += len(ids)
            if total >= shard_ids:
                yield flush()
        if own:
            yield flush()

    return written(dealt.mapInArrow(run, "file string, part long, seq long, n_docs long, n_tokens long"), "token-files")


def file_starts(files: DataFrame) -> DataFrame:
    """file, first: the ids before each file in all.

    Files are summed within runs of ``RUN_PARTS`` writing tasks; over the runs, a
    row each, goes a scalar subquery, so no task takes all files.
    """
    files = files.withColumn("_run", F.col("part") - F.col("part") % RUN_PARTS)
    runs = files.groupBy("_run").agg(F.sum("n_tokens").alias("_ids"))
    every = runs.agg(F.collect_list(F.struct(F.col("_run").alias("at"), "_ids"))).scalar()
    earlier = F.filter("_every", lambda r: r["at"] < F.col("_run"))
    runs = runs.withColumn("_every", every).select("_run", F.aggregate(earlier, F.lit(0).cast("long"), lambda s, r: s + r["_ids"]).alias("_before"))
    own = F.sum("n_tokens").over(Window.partitionBy("_run").orderBy("part", "seq"))
    return (files.withColumn("_upto", own).join(runs, "_run")
            .select("file", (F.col("_before") + F.col("_upto") - F.col("n_tokens")).alias("first")))


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it in all), n_tokens, ids_crc32.

    ``files`` is what ``write_shards`` returned. A reading task gets files in a row,
    of about ``READ_IDS`` ids.
    """
    n, total = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n = max(1, min(n, max(TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism, total // READ_IDS)))
    task = F.least(F.floor(F.col("first") / F.lit(max(total, 1) / n)), F.lit(n - 1)).cast("int")
    dealt = file_starts(files).repartitionById(n, task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, first in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(posixpath.join(root, file)) as f:
                    found = TokenFile.from_bytes(f.read_buffer())
                data = memoryview(found.decode().astype("<u4")).cast("B")
                lengths = found.lengths
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(data[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.record_batch([pa.array(found.doc_ids, pa.int64()), pa.array(first + ends - lengths),
                                       pa.array(lengths), pa.array(crc, pa.int64())],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the documents' token files and returns what a reader finds in them."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, tokenizer, end_id), folder)
