"""Ranking building blocks: per-key top-k, per-key min-max, global numbering, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_ROW_BITS = 33  # monotonically_increasing_id packs the partition index above bit 33


def topk_per_key(df: DataFrame, key: str | list[str], order: list[Column], k: int,
                 rank_col: str = "rank") -> DataFrame:
    """The first k rows of each key by ``order`` (ties must be broken in ``order``).

    ``row_number() <= k`` lets Catalyst insert a WindowGroupLimit below the
    window, so each task keeps only k rows per key before the final sort.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w))
            .where(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def rank_per_key(df: DataFrame, key: str | list[str], order: list[Column], rank_col: str = "rank") -> DataFrame:
    """All rows of each key, numbered from 1 by ``order``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def minmax_per_key(df: DataFrame, key: str | list[str], score: str, out: str) -> DataFrame:
    """(s - min) / (max - min) within each key; a constant list maps to 1.0."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi == lo, F.lit(1.0)).otherwise((F.col(score) - lo) / (hi - lo)))


def global_row_number(df: DataFrame, order: list[Column], out: str = "rn") -> DataFrame:
    """1-based position of every row in one total order, without a single-partition window.

    The frame is range-partitioned and sorted (distributed), checkpointed to the
    shared checkpoint folder so both passes below see the same partitions, then
    numbered as partition offset + position inside the partition. Only the
    per-partition counts (one row per partition) are combined globally.
    """
    from shelfwise.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), _ROW_BITS)
    counts = s.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.shiftright(F.col("_mid"), _ROW_BITS), _ROW_BITS)
    return (s.withColumn("_pid", pid)
            .join(F.broadcast(offsets), "_pid")   # one row per partition: bounded by the partition count
            .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + pos + 1).cast("bigint"))
            .drop("_pid", "_off", "_mid"))


def dense_id_map(ids: DataFrame, id_col: str, out: str = "idx") -> DataFrame:
    """Sorted distinct ids -> 0..n-1 (and, read backwards, the inverse map)."""
    d = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return (global_row_number(d, [F.col(id_col).asc()], "_rn")
            .select(id_col, (F.col("_rn") - 1).cast("int" if out == "idx32" else "bigint").alias(out)))


def unique_ids(values: DataFrame, col: str, out: str = "uid") -> DataFrame:
    """Distinct values of ``col`` with a unique (not consecutive) BIGINT id, fixed once.

    ``monotonically_increasing_id`` is unique but depends on the partitioning,
    so the mapping is checkpointed (one job) and every later use sees the same ids.
    """
    from shelfwise.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(values.sparkSession)
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    return d.withColumn(out, F.monotonically_increasing_id()).checkpoint(eager=True)
