"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The C library's own call for that, where it has one; numpy's and Python's arrays come from it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
# Text that one step of a Python task holds as Python objects.
STEP_BYTES = 1 << 20
# Text that the word encoder takes at once: a larger step repeats more words.
ENCODE_BYTES = 2 << 20


def held_out(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id's text is divisible by ``modulus``; a null id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 0, F.lit(True))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and read again after a loss."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made and run inside lose their shuffle files when they end, not at some later collection of garbage.

    For queries whose result is used once; the setting is put back afterwards.
    """
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of Arrow batches with about ``limit`` bytes of ``text`` each, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch, sizes
        release()


def release() -> None:
    """Gives freed memory back, else a worker, which later stages use again, keeps what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def new_folder(folder: str) -> str:
    """``folder``, which must not be there yet: files in it would count as written."""
    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(folder)
    return folder


def bounded_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, label) of at most ``per_label`` rows of each label, those whose id has the least hash.

    A label's count gives the share of hashes that is looked at, so only about
    ``per_label`` rows of a label meet in a task.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    rows = rows.select("doc_id", label).withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)))
    if counts:
        shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * per_label + 50) / n) * (1 << 31))])
        rows = rows.where(F.col("_h") < shares[F.col(label)])
    first = Window.partitionBy(label).orderBy("_h", "doc_id")
    return (rows.distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= per_label)
            .select("doc_id", label))


def write_file(folder: str, file: str, parts: Iterable[bytes]) -> None:
    """Writes a file into a folder that all tasks reach: under another name first, then renamed.

    A task that runs again finds its own file whole, with the same bytes, and leaves it.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    draft, target = f"{root}/.{file}.{uuid.uuid4().hex}", f"{root}/{file}"
    with store.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    if store.get_file_info(target).type == fs.FileType.NotFound:
        store.move(draft, target)
    else:
        store.delete_file(draft)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
