"""Exact top-k under any score that can bound itself over a box of items (branch and bound).

Items are clustered and dealt to cells of bounded size; a cell has the least and
greatest value of each coordinate of its items, their centre and the radius
around it. Queries are dealt to groups and
stream cells past them, like in ``blockscore``. Before a cell is scored, the
score's upper bound over its box is computed for all queries of a block at
once, and only queries whose k-th best score so far doesn't exceed the bound
meet the cell's items. Cells come in the order of their bound for a middle
query, so that the k-th best scores rise early.

The score object has ``users(vectors)`` and ``items(vectors)``, both tuples of
arrays with a row for each, ``pairs(users, items)``, ``bound(users, boxes)`` and
``block``, the number of queries that meet a cell at once, as ``neural.Head``
and ``Dot`` do.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blockscore import GROUP_BYTES, TIE_DECIMALS, Best, _firsts, _lists, _Skip
from shelfwise.operators.ranking import topk_per_key
from shelfwise.session import ensure_checkpoint_dir

CELL_ITEMS = 128
MAX_CLUSTERS = 1024
FIT_ROWS = 1 << 15          # items that the cluster centres are fitted on, at most; every item is dealt to a cell
BOUND_CELLS = 64            # cells whose bounds are computed at once
SLACK = 1e-9                # bounds are sums in another order than scores
BOX = ("low", "high", "centre", "radius")
SCHEMA = "lid bigint, rid bigint, score double, scored bigint, skipped bigint"


class Boxes(NamedTuple):
    """Cells' boxes and balls, a row each; a radius is a list of one number."""
    low: np.ndarray
    high: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, rows: slice = slice(None)) -> Boxes:
        return cls(*(_lists(batch.column(c), np.float64)[1].reshape(batch.num_rows, -1)[rows] for c in BOX))

    def part(self, rows: slice) -> Boxes:
        return Boxes(*(x[rows] for x in self))


class Dot:
    """The dot product: at most query . centre + |query| * radius (Cauchy-Schwarz), and at most what the box allows."""

    block = 1024

    def users(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return p, np.linalg.norm(p, axis=1)

    def items(self, q: np.ndarray) -> tuple[np.ndarray]:
        return (q,)

    def pairs(self, users: tuple[np.ndarray, np.ndarray], items: tuple[np.ndarray]) -> np.ndarray:
        return users[0] @ items[0].T

    def bound(self, users: tuple[np.ndarray, np.ndarray], boxes: Boxes) -> np.ndarray:
        p, norm = users
        ball = p @ boxes.centre.T + norm[:, None] * boxes.radius[:, 0]
        box = p @ ((boxes.low + boxes.high) / 2).T + np.abs(p) @ ((boxes.high - boxes.low) / 2).T
        return np.minimum(ball, box)


def item_cells(items: DataFrame, id_col: str, vec_col: str, cell_items: int = CELL_ITEMS, seed: int = 42) -> DataFrame:
    """(cell, ids, vectors, low, high, centre, radius): items of a cluster, in cells of about ``cell_items``; ids ascend, vectors lie one after the other.

    Centres come from at most about ``FIT_ROWS`` items, picked by a hash of their ids. Boxes and radii
    are those of all of a cell's items, so centres decide how much is passed over, not what is found.
    """
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.withColumn("v", array_to_vector("vec")).checkpoint(eager=True)
    n = rows.count()
    k = min(MAX_CLUSTERS, -(-n // cell_items))
    if k > 1:
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) < FIT_ROWS) if n > FIT_ROWS else rows
        rows = KMeans(k=k, seed=seed, maxIter=5, featuresCol="v", predictionCol="cluster").fit(some).transform(rows)
    else:
        rows = rows.withColumn("cluster", F.lit(0))
    sizes = rows.groupBy("cluster").agg(F.ceil(F.count("*") / cell_items).alias("slices"))
    rows = rows.join(F.broadcast(sizes), "cluster").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    cells = rows.groupBy("cluster", "slice").agg(
        F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("x"), Summarizer.min(F.col("v")).alias("low"), Summarizer.max(F.col("v")).alias("high"),
        Summarizer.mean(F.col("v")).alias("centre"))
    cells = cells.select(F.xxhash64("cluster", "slice").alias("cell"), "x", *[vector_to_array(c).alias(c) for c in BOX[:3]])
    off = F.transform("x", lambda i: F.sqrt(F.aggregate(F.zip_with(i["vec"], "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)))
    return cells.select("cell", F.col("x.id").alias("ids"), F.flatten("x.vec").alias("vectors"), *BOX[:3], F.array(F.array_max(off)).alias("radius"))


class _Task:
    """The queries of a task and their best items so far."""

    def __init__(self, score, k: int, parts: list[pa.RecordBatch]):
        self.score, self.k = score, k
        self.ids = np.concatenate([p.column("id").to_numpy(zero_copy_only=False) for p in parts])
        vectors = np.concatenate([_lists(p.column("vectors"), np.float64)[1].reshape(p.num_rows, -1) for p in parts])
        self.users, self.dim = score.users(vectors), vectors.shape[1]
        self.skip = _Skip([_lists(p.column("ids"), np.int64) for p in parts])
        self.best = Best(len(self.ids), k)
        self.scored = self.skipped = 0

    def see(self, batch: pa.RecordBatch) -> None:
        """Takes in cells, in their order."""
        ptr, ids = _lists(batch.column("ids"), np.int64)
        items = self.score.items(_lists(batch.column("vectors"), np.float64)[1].reshape(-1, self.dim))
        boxes, block = Boxes.of(batch), self.score.block
        for first in range(0, batch.num_rows, BOUND_CELLS):
            some = slice(first, min(first + BOUND_CELLS, batch.num_rows))
            for a in range(0, len(self.ids), block):
                rows = slice(a, min(a + block, len(self.ids)))
                mine = tuple(x[rows] for x in self.users)
                bound = self.score.bound(mine, boxes.part(some))
                bound += SLACK * (1 + np.abs(bound))
                for c in range(bound.shape[1]):
                    at = slice(ptr[first + c], ptr[first + c + 1])
                    # Equal scores go to the smaller id, so a cell that only reaches the k-th best counts too.
                    meet = np.flatnonzero(bound[:, c] >= self.best.key[rows, -1])
                    n = at.stop - at.start
                    self.scored += len(meet) * n
                    self.skipped += (bound.shape[0] - len(meet)) * n
                    if len(meet):
                        users = mine if len(meet) == bound.shape[0] else tuple(x[meet] for x in mine)
                        self._meet(a + meet, users, ids[at], tuple(x[at] for x in items))

    def _meet(self, rows: np.ndarray, users: tuple, ids: np.ndarray, items: tuple) -> None:
        found, floor = self.score.pairs(users, items), self.best.key[rows, -1]
        hit = np.flatnonzero(found >= (floor - SLACK * (1 + np.abs(np.where(np.isfinite(floor), floor, 0))))[:, None])
        row, col = np.divmod(hit, len(ids))
        key = np.round(found[row, col], TIE_DECIMALS)
        at = np.flatnonzero(np.isfinite(key) & (key >= floor[row]))
        at = at[self.skip.allows(rows[row[at]], ids[col[at]], _firsts(ids)[col[at]])]
        self.best.offer(rows[row[at]], ids[col[at]], key[at], {})

    def rows(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.ids), 4096):
            i, j = np.nonzero(np.isfinite(self.best.key[a:a + 4096]))
            i += a
            none = pa.nulls(len(i), pa.int64())
            yield pa.record_batch([pa.array(self.ids[i], pa.int64()), pa.array(self.best.rid[i, j], pa.int64()), pa.array(self.best.key[i, j]), none, none],
                                  names=["lid", "rid", "score", "scored", "skipped"])
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([self.scored], pa.int64()),
                               pa.array([self.skipped], pa.int64())], names=["lid", "rid", "score", "scored", "skipped"])


def _task_fn(score, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, queries, task = None, [], None
        for batch in batches:
            tasks, sides = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "side"))
            ends = np.flatnonzero(np.concatenate([(np.diff(tasks) != 0) | (np.diff(sides) != 0), [True]])) + 1 if batch.num_rows else []
            start = 0
            for end in ends:
                part, t, side, start = batch.slice(start, int(end) - start), tasks[start], sides[start], int(end)
                if t != number:
                    if task is not None:
                        yield from task.rows()
                    number, queries, task = t, [], None
                if side == 0:
                    queries.append(part)
                elif queries:
                    if task is None:
                        task, queries = _Task(score, k, queries), [True]  # the task has what it needs of them
                    task.see(part)
        if task is not None:
            yield from task.rows()
    return run


def bounded_topk(left: DataFrame, left_id: str, left_vec: str, right: DataFrame, right_id: str, right_vec: str, score, k: int, *,
                 exclude: DataFrame | None = None, out=("lid", "rank", "rid", "score"), cell_items: int = CELL_ITEMS) -> tuple[DataFrame, DataFrame]:
    """(the best ``k`` right rows of each left row, the numbers of pairs scored and skipped), exact.

    ``exclude`` holds (lid, rid) pairs that must not come back. Ties go to the
    smaller id. A side without rows gives no rows.
    """
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    none = F.lit(None)
    L = left.select(F.col(left_id).cast("bigint").alias("id"), F.col(left_vec).cast("array<double>").alias("vectors"))
    if exclude is not None:
        ids = (exclude.select(F.col(exclude.columns[0]).cast("bigint").alias("id"), F.col(exclude.columns[1]).cast("bigint").alias("rid"))
               .groupBy("id").agg(F.collect_set("rid").alias("ids")))
        L = L.join(ids, "id", "left")
    else:
        L = L.withColumn("ids", none.cast("array<bigint>"))
    L = L.checkpoint(eager=True)
    n, size = L.agg(F.count("*"), F.sum((F.size("vectors") + F.coalesce(F.size("ids"), F.lit(0))) * 8)).first()
    a, r, b, s = out
    cells = item_cells(right, right_id, right_vec, cell_items).checkpoint(eager=True) if n else None
    if not n or cells.isEmpty():
        empty = spark.createDataFrame([], SCHEMA)
        return (empty.select(F.col("lid").alias(a), F.lit(0).alias(r), F.col("rid").alias(b), F.col("score").alias(s)),
                empty.agg(F.lit(0).cast("long").alias("scored"), F.lit(0).cast("long").alias("skipped")))
    middle = np.array(L.agg(vector_to_array(Summarizer.mean(array_to_vector("vectors")))).first()[0])
    order = spark.sparkContext.broadcast(score.users(middle[None, :]))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            bound = score.bound(order.value, Boxes.of(x))[0] if x.num_rows else np.zeros(0)
            yield x.append_column("first", pa.array(-bound, pa.float64()))

    R = cells.mapInArrow(ordered, "cell bigint, ids array<bigint>, vectors array<double>, " + "".join(f"{c} array<double>, " for c in BOX) + "first double")
    groups = max(1, -(-size // GROUP_BYTES))
    # Few queries: their groups are cut further, as a split of the cells would hide the best ones from most tasks.
    groups = max(groups, min(n, spark.sparkContext.defaultParallelism))
    L = L.select("id", "ids", "vectors", *[none.cast("array<double>").alias(c) for c in BOX], F.lit(0.0).alias("first"), F.lit(0).alias("side"),
                 F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("task"))
    R = R.select(F.col("cell").alias("id"), "ids", "vectors", *BOX, "first", F.lit(1).alias("side"),
                 F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("task"))
    rows = L.unionByName(R).repartitionById(groups, "task").sortWithinPartitions("task", "side", "first", "id")
    found = rows.mapInArrow(_task_fn(score, int(k)), SCHEMA).checkpoint(eager=True)
    ranked = topk_per_key(found.where("lid IS NOT NULL"), "lid", [F.col("score").desc(), F.col("rid").asc()], k)
    counts = found.where("lid IS NULL").agg(F.sum("scored").alias("scored"), F.sum("skipped").alias("skipped"))
    return ranked.select(F.col("lid").alias(a), F.col("rank").alias(r), F.col("rid").alias(b), F.col("score").alias(s)), counts


__all__ = ["Boxes", "Dot", "bounded_topk", "item_cells"]
