"""Line dedup that stays reversible: sharded cuckoo filters over exact reference tables.

A line's key is its text, stripped and lower-cased in ASCII; keys of enough code
points are known by 128 bits of XXH3 (with 10^12 different keys, the chance of
any collision is about 10^-15). A ``LineIndex`` is a folder with one version for
each batch of documents inserted or deleted:

* ``refs``: (shard, key, doc_id, n): how often the batch's documents refer to a
  key; deletions are negative. Their sums are the exact reference counts.
* ``counts``: (shard, key, n_docs, holder) of each key that the batch touched:
  the documents that now refer to it and the largest id among them. A key's row
  in the newest version is the one that holds.
* ``filters``: for each shard that changed, one cuckoo filter of the keys that
  any document refers to (``seen``) and one of those that ``min_docs`` or more
  do (``repeated``).

Inserting looks up old counts only for keys that ``seen`` lets through, and
cleaning joins only references that ``repeated`` lets through. The filters never
miss a key, and what they let through wrongly falls out in the exact join.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfwise.llm.common import free_name, shared_folder, steps, write_file, written
from shelfwise.llm.cuckoo import CuckooFilter

WHITE = b" \t\n\x0b\x0c\r"
# A shard's filters take some 5 MB each for so many keys.
SHARD_KEYS = 1 << 20
# At most so many of the most common keys are joined by broadcast, the others by a shuffle.
COMMON_KEYS = 1000
REF = "shard int, key binary, doc_id long, n long"
# Keys are dealt to so many slots, and slots to shards.
SLOTS = 1 << 30


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte key of an ASCII-lower-cased line, None if it is too short."""
    line = line.strip(WHITE)
    if len(line) < min_chars or len(line) < 4 * min_chars and len(line.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(line)


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line; a null text is one empty line."""
    return [line_key(x, min_chars) for x in (text or "").encode("utf-8", "replace").lower().split(b"\n")]


def halves(keys: pa.Array) -> np.ndarray:
    """Each 16-byte key as two numbers: the filters' hash and the one that deals it out."""
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    """(shard, key, doc_id, n) for each row's keys, with the slot as the shard; rows without a doc_id have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            keys, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = {k for k in line_keys(text, min_chars) if k}
                keys += found
                ids += [doc_id] * len(found)
            keys = pa.array(keys, pa.binary())
            slot = (halves(keys)[:, 1] % SLOTS).astype(np.int32)
            yield pa.record_batch([pa.array(slot), keys, pa.array(ids, pa.int64()), pa.array(np.ones(len(keys), np.int64))],
                                  names=["shard", "key", "doc_id", "n"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, REF)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = pa.array(halves(batch.column("key"))[:, 0].view(np.int64))
        yield pa.record_batch([batch.column("shard"), hashes, batch.column("n_docs"), batch.column("n_before")],
                              names=["shard", "hash", "n_docs", "n_before"])


class FilterFiles:
    """A task's reader of filter files: a shard's newest one, with a few of them kept."""

    def __init__(self, folders: list[str]):
        self.folders, self.kept = folders, OrderedDict()

    def get(self, kind: str, shard: int) -> CuckooFilter:
        if (kind, shard) not in self.kept:
            found = CuckooFilter(0)
            for folder in reversed(self.folders):
                store, root = fs.FileSystem.from_uri(folder)
                path = f"{root}/{kind}-{shard:07d}"
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    with store.open_input_stream(path) as f:
                        found = CuckooFilter.from_bytes(f.read())
                    break
            while len(self.kept) > 3:
                self.kept.popitem(last=False)
            self.kept[kind, shard] = found
        return self.kept[kind, shard]


def probe(rows: DataFrame, folders: list[str], kind: str) -> DataFrame:
    """The rows (with shard and key) that the filters of ``kind`` let through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = FilterFiles(folders)
        for batch in batches:
            shard = batch.column("shard").to_numpy(zero_copy_only=False)
            hashes = halves(batch.column("key"))[:, 0]
            keep = np.zeros(len(shard), bool)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                keep[at] = files.get(kind, s).contains(hashes[at])
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, rows.schema)


class LineIndex:
    """An index in ``folder``, a new one or one written before, at its newest version."""

    def __init__(self, spark: SparkSession, folder: str, min_chars: int = 20, min_docs: int = 3, shards: int = 0):
        """``shards`` 0: set at the first insert, one for each ``SHARD_KEYS`` references. An older index keeps its settings."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.min_chars, self.min_docs, self.shards = min_chars, min_docs, shards
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        done = sorted(f.base_name.split("-") for f in found if f.base_name.startswith("done-"))
        self.parts = [f"v{x[1]}-{x[5]}" for x in done]
        if done:
            self.min_chars, self.min_docs, self.shards = map(int, done[-1][2:5])

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{p}/{name}" for p in self.parts])

    def _filters(self) -> list[str]:
        return [f"{self.folder}/{p}/filters" for p in self.parts]

    def refs(self) -> DataFrame:
        """(shard, key, doc_id, n) with the references that hold now."""
        rows = self._read("refs")
        if len(self.parts) == 1:
            return rows
        return rows.groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")).where("n > 0")

    def counts(self) -> DataFrame:
        """(shard, key, n_docs, holder) of the keys that documents refer to now."""
        rows = self._read("counts")
        if len(self.parts) > 1:
            newest = F.max(F.struct("version", "n_docs", "holder")).alias("x")
            rows = rows.groupBy("shard", "key").agg(newest).select("shard", "key", "x.n_docs", "x.holder")
        return rows.where("n_docs > 0").select("shard", "key", "n_docs", "holder")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Adds the lines of ``docs`` (doc_id, text); rows without an id or a text have none to add.

        Rows that repeat a doc_id are one document, whose references count the
        rows: deleting takes as many rows.
        """
        return self._apply(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes out the references of ``docs`` (doc_id, text), as far as they are in."""
        return self._apply(docs, -1)

    def _apply(self, docs: DataFrame, sign: int) -> LineIndex:
        raw = written(references(docs, self.min_chars), "line-refs")
        self.shards = self.shards or max(1, -(-raw.count() // SHARD_KEYS))
        part = f"v{len(self.parts):06d}-{uuid.uuid4().hex}"
        at = f"{self.folder}/{part}"
        # Dealt by ranges: a task needs few shards' filters, and a common key's references lie in many tasks.
        batch = (raw.withColumn("shard", F.col("shard") % self.shards).repartitionByRange("shard", "key", "doc_id")
                 .groupBy("shard", "key", "doc_id").agg(F.sum("n").alias("n")))
        if sign < 0:
            has = self.refs().withColumnRenamed("n", "has") if self.parts else batch.limit(0).withColumnRenamed("n", "has")
            batch = (batch.join(has, ["shard", "key", "doc_id"]).withColumn("n", -F.least("n", "has")).drop("has")
                     .repartitionByRange("shard", "key", "doc_id"))
        batch.sortWithinPartitions("shard", "key").write.parquet(f"{at}/refs")
        batch = self.spark.read.schema(REF).parquet(f"{at}/refs").withColumn("was", F.lit(0).cast("long"))
        if self.parts:
            known = probe(batch.select("shard", "key").distinct(), self._filters(), "seen")
            before = self.refs().join(known, ["shard", "key"], "left_semi").withColumn("was", F.col("n"))
            batch = (batch.unionByName(before).groupBy("shard", "key", "doc_id")
                     .agg(F.sum("n").alias("n"), F.sum("was").alias("was")))
        (batch.groupBy("shard", "key")
         .agg(F.sum((F.col("n") > 0).cast("long")).alias("n_docs"), F.max(F.when(F.col("n") > 0, F.col("doc_id"))).alias("holder"),
              F.sum((F.col("was") > 0).cast("long")).alias("n_before"))
         .withColumn("version", F.lit(len(self.parts))).write.parquet(f"{at}/counts"))
        self._write_filters(at)
        self.parts.append(part)
        settings = f"{self.min_chars}-{self.min_docs}-{self.shards}"
        write_file(self.folder, f"done-{len(self.parts) - 1:06d}-{settings}-{part.split('-')[1]}", [b""])
        return self

    def _write_filters(self, at: str) -> None:
        """New filters for the shards that a version's counts touch; full ones are built again from all counts."""
        before, target = self._filters(), f"{at}/filters"
        kinds = (("seen", 1), ("repeated", self.min_docs))

        def update(key: tuple, table: pa.Table) -> pa.Table:
            shard, files, full = key[0].as_py(), FilterFiles(before), False
            now, was = (table.column(c).to_numpy() for c in ("n_docs", "n_before"))
            hashes = table.column("hash").to_numpy().view(np.uint64)
            filters = {}
            for kind, least in kinds:
                add, drop = hashes[(now >= least) & (was < least)], hashes[(now < least) & (was >= least)]
                one = files.get(kind, shard)
                one = one if one.n else CuckooFilter(len(add))
                full |= one.n + len(add) > one.capacity
                filters[kind] = one, add, drop
            for kind, (one, add, drop) in ({} if full else filters).items():
                one.delete(drop)
                one.insert(add)
                write_file(target, f"{kind}-{shard:07d}", [one.to_bytes()])
            return pa.table({"shard": pa.array([shard], pa.int32()), "full": [full]})

        def build(key: tuple, table: pa.Table) -> pa.Table:
            now, hashes = table.column("n_docs").to_numpy(), table.column("hash").to_numpy().view(np.uint64)
            for kind, least in kinds:
                one = CuckooFilter(2 * int((now >= least).sum()))
                one.insert(hashes[now >= least])
                write_file(target, f"{kind}-{key[0].as_py():07d}", [one.to_bytes()])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())})

        hashed = "shard int, hash long, n_docs long, n_before long"
        touched = self.spark.read.parquet(f"{at}/counts").select("shard", "key", "n_docs", "n_before").mapInArrow(_hashed, hashed)
        full = written(touched.groupBy("shard").applyInArrow(update, "shard int, full boolean"), "line-shards").where("full")
        if self.parts and not full.isEmpty():
            self.parts.append(at.rsplit("/", 1)[1])
            live = self.counts().join(full, "shard", "left_semi").withColumn("n_before", F.lit(0).cast("long"))
            self.parts.pop()
            live = live.select("shard", "key", "n_docs", "n_before").mapInArrow(_hashed, hashed)
            written(live.groupBy("shard").applyInArrow(build, "shard int"), "line-shards")

    def drops(self) -> DataFrame:
        """(doc_id, key): the keys that ``min_docs`` or more documents refer to, for each of these but the holder."""
        if not self.parts:
            return self.spark.createDataFrame([], "doc_id long, key binary")
        refs = self.refs().select("shard", "key", "doc_id")
        hits = written(probe(refs, self._filters(), "repeated").select("key", "doc_id"), "line-hits")
        heavy = self.counts().where(F.col("n_docs") >= self.min_docs).select("key", "n_docs", "holder")
        # More documents than this have at most COMMON_KEYS keys in common, whatever the input.
        limit = hits.count() // COMMON_KEYS
        common = heavy.where(F.col("n_docs") > limit).select("key", F.col("holder").alias("first"))
        others = heavy.where(F.col("n_docs") <= limit).select("key", "holder")
        hits = hits.join(F.broadcast(common), "key", "left")
        return (hits.where("first IS NOT NULL").withColumnRenamed("first", "holder")
                .unionByName(hits.where("first IS NULL").drop("first").join(others, "key"))
                .where("doc_id <> holder").select("doc_id", "key"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the lines of ``drops`` gone from ``text``, and columns n_lines and n_dropped (they replace others).

        A null text stays null, with one (empty) line; rows without a doc_id
        and documents that aren't in the index keep all lines. The remaining
        lines are joined by a newline as they were.
        """
        least, id_, drop = self.min_chars, free_name(docs, "_line_doc"), free_name(docs, "_line_drops")
        lists = self.drops().groupBy(F.col("doc_id").alias(id_)).agg(F.collect_list("key").alias(drop))
        rows = docs.drop("n_lines", "n_dropped")
        out = StructType([*rows.schema.fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches):
                texts, n_lines, n_dropped = batch.column("text").to_pylist(), [], []
                for i, keys in enumerate(batch.column(drop).to_pylist()):
                    lines = (texts[i] or "").split("\n")
                    n_lines.append(len(lines))
                    if keys:
                        keys = set(keys)
                        kept = [x for x, k in zip(lines, line_keys(texts[i], least)) if k not in keys]
                        texts[i] = "\n".join(kept)
                        n_dropped.append(len(lines) - len(kept))
                    else:
                        n_dropped.append(0)
                found = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.record_batch([found[f.name] if f.name in found else batch.column(f.name) for f in out.fields], names=out.names)

        return rows.join(lists, rows["doc_id"] == lists[id_], "left").drop(id_).mapInArrow(run, out)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` cleaned by a new index of all their lines."""
    index = LineIndex(docs.sparkSession, shared_folder(docs.sparkSession, "lines"), min_chars, min_docs)
    return index.insert(docs).clean(docs)


def line_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of the cleaned documents; a null text hashes as an empty one."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def line_digests_sql(min_chars: int = 20, min_docs: int = 3) -> str:
    """DuckDB SQL of ``line_digests``: lines and their counts without filters or hashes."""
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row_id, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (SELECT *, translate(trim(line, {white}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
heavy AS (SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= {min_chars} AND doc_id IS NOT NULL
          GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
marked AS (SELECT k.*, h.holder IS NOT NULL AND k.doc_id <> h.holder AS gone FROM keyed k LEFT JOIN heavy h ON k.key = h.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(gone, false)), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
