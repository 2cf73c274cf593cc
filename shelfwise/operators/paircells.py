"""Pairs of a user and an item together with both factors, without a copy of the factors for each pair.

A join would write a user's and an item's factors beside every pair and shuffle
them. Here users are dealt to rows and items to columns of a grid by a hash of
their ids, and a pair belongs to the cell where its two meet. A cell gets its
users' factors and its items' factors once each, then its pairs, a batch at a
time. So a user crosses the network once for each column (or each cell that it
has a pair in, where that is less), an item once for each row, and no pair
carries a factor. A hot user's pairs are spread over the columns and a hot
item's over the rows.

Like in an inner join, a pair whose user or item has no factors is left out. An
id has its factors once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.blockscore import _lists
from shelfwise.operators.cf import CFModel

SIDE_BYTES = 32 * 1024 * 1024   # of one side's factors that a task holds
TASK_PAIRS = 1 << 16            # with fewer pairs than this for each, further tasks aren't worth it


class Block(NamedTuple):
    """Some pairs of a cell: their columns, the cell's factors (a row for each user, and item) and the pairs' rows in them."""
    pairs: pa.StructArray
    p: np.ndarray
    q: np.ndarray
    u: np.ndarray
    i: np.ndarray

    def column(self, name: str) -> pa.Array:
        return self.pairs.flatten()[self.pairs.type.get_field_index(name)]

    def factors(self, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The users' and the items' factors of the pairs, in double precision."""
        return self.p[self.u[rows]].astype(np.float64, copy=False), self.q[self.i[rows]].astype(np.float64, copy=False)


def _sizes(pairs: DataFrame, cf: CFModel) -> tuple[int, int, int]:
    """The numbers of pairs, users and items."""
    return pairs.count(), cf.users.count(), cf.items.count()


def grid_of_cells(cells: int, users: int, items: int) -> tuple[int, int]:
    """(rows, columns) of a grid of about ``cells`` cells for which users times columns plus items times rows is small."""
    columns = min(cells, max(1, round(math.sqrt(cells * items / max(1, users)))))
    return max(1, round(cells / columns)), columns


def grid_of_bytes(pairs: int, users: int, items: int, width: int, cores: int) -> tuple[int, int]:
    """(rows, columns) so that a task holds ``SIDE_BYTES`` of a side at most, and cores have work where there are pairs enough."""
    rows, columns = (max(1, -(-n * width // SIDE_BYTES)) for n in (users, items))
    wanted = min(cores, -(-pairs // TASK_PAIRS))
    return max(rows, -(-wanted // columns)), columns


def _sent(side: DataFrame, key: str, own: Column, others: Column, other: int, pairs: DataFrame, many: bool) -> DataFrame:
    """(cell, id, vec) of one side's factors: to all cells of its row or column, or to those alone that hold a pair of the id."""
    if many:
        need = pairs.select(key, "cell").distinct()
        return side.join(need, key).select("cell", F.col(key).cast("bigint").alias("id"), "vec")
    every = side.withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))) if other > 1 else side.withColumn("_o", F.lit(0))
    return every.select((own + others).cast("int").alias("cell"), F.col(key).cast("bigint").alias("id"), "vec")


def in_cells(pairs: DataFrame, cf: CFModel, grid: tuple[int, int], sizes: tuple[int, int, int], order: list[Column] = ()) -> DataFrame:
    """Rows for ``blocks``, a partition for each cell: users' factors, items' factors, then the pairs by ``order``."""
    rows, columns = grid
    n, users, items = sizes
    r, c = (F.pmod(F.xxhash64(F.col(x).cast("bigint")), F.lit(m)) for x, m in (("user_id", rows), ("book_id", columns)))
    kind = "array<float>" if {cf.users.schema["features"].dataType.simpleString(), cf.items.schema["features"].dataType.simpleString()} == {"array<float>"} \
        else "array<double>"
    sorted_by = [f"o{k}" for k in range(len(order))]
    told = pairs.where(F.col("user_id").isNotNull() & F.col("book_id").isNotNull()).select(
        (r * columns + c).cast("int").alias("cell"), F.col("user_id").cast("bigint").alias("u"), F.col("book_id").cast("bigint").alias("i"),
        F.struct(*pairs.columns).alias("pair"), *[x.alias(o) for x, o in zip(order, sorted_by)])
    ids = told.select(F.col("u").alias("user_id"), F.col("i").alias("book_id"), "cell")
    p, q = (x.select(x.columns[0], F.col("features").cast(kind).alias("vec")) for x in (cf.users.select("user_id", "features"), cf.items.select("book_id", "features")))
    sides = [_sent(p, "user_id", r * columns, F.col("_o"), columns, ids, users * columns > n).withColumn("side", F.lit(0)),
             _sent(q, "book_id", c, F.col("_o") * columns, rows, ids, items * rows > n).withColumn("side", F.lit(1)),
             told.withColumn("side", F.lit(2))]
    out = sides[0].unionByName(sides[1]).unionByName(sides[2], allowMissingColumns=True)
    return out.repartitionById(rows * columns, "cell").sortWithinPartitions("cell", "side", *sorted_by).select("cell", "side", "id", "vec", "u", "i", "pair")


def _factors(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """(ascending ids, their factors)"""
    ids = np.concatenate([x.column("id").to_numpy(zero_copy_only=False) for x in parts])
    m = np.concatenate([x.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(x.num_rows, -1) for x in parts])
    order = np.argsort(ids, kind="stable")
    return ids[order], m[order]


def _at(known: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where ids are among known ones, whether they are)"""
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return at, known[at] == ids


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """The pairs of rows made by ``in_cells``, an Arrow batch of a cell at a time."""
    cell, sides, ready = None, ([], []), None
    for batch in batches:
        cells, kinds = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "side"))
        ends = np.flatnonzero(np.concatenate([(np.diff(cells) != 0) | (np.diff(kinds) != 0), [True]])) + 1 if batch.num_rows else []
        start = 0
        for end in ends:
            part, now, side, start = batch.slice(start, int(end) - start), cells[start], kinds[start], int(end)
            if now != cell:
                cell, sides, ready = now, ([], []), None
            if side < 2:
                sides[side].append(part)
                continue
            if ready is None and sides[0] and sides[1]:
                ready, sides = (_factors(sides[0]), _factors(sides[1])), ([], [])
            if ready is None:  # no pair of this cell has both factors
                continue
            (uid, p), (iid, q) = ready
            (u, known), (i, also) = (_at(x, part.column(c).to_numpy(zero_copy_only=False)) for x, c in ((uid, "u"), (iid, "i")))
            known &= also
            if known.all():
                yield Block(part.column("pair"), p, q, u, i)
            elif known.any():
                yield Block(part.column("pair").filter(pa.array(known)), p, q, u[known], i[known])


def pair_cells(pairs: DataFrame, cf: CFModel) -> DataFrame:
    """Rows for ``blocks`` of (user_id, book_id, …), in cells as large as a task may hold."""
    sizes = _sizes(pairs, cf)
    one = cf.users.select(F.size("features").alias("n")).first()
    width = 8 * max(1, one["n"] if one else 0)
    return in_cells(pairs, cf, grid_of_bytes(*sizes, width, pairs.sparkSession.sparkContext.defaultParallelism), sizes)


def scored(pairs: DataFrame, cf: CFModel, score) -> DataFrame:
    """The pairs that have factors, with ``prediction`` = ``score(users' factors, items' factors)`` on rows of numpy arrays."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            found = np.concatenate([score(*b.factors(slice(a, a + 4096))) for a in range(0, len(b.u), 4096)])
            yield pa.record_batch([*b.pairs.flatten(), pa.array(found, pa.float64())], names=[*names, "prediction"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pair_cells(pairs, cf).mapInArrow(run, f"{schema}, prediction double")


# ---------------------------------------------------------------- kept pairs, read many times

PACKED = "dim int, p array<{0}>, q array<{0}>, u array<int>, i array<int>, y array<double>, held array<boolean>"
PACKED_FACTORS = 4096       # users or items whose factors make a row
PACKED_PAIRS = 10_000       # pairs that make a row


def packed(cells: DataFrame) -> DataFrame:
    """Rows made by ``in_cells`` of pairs (user_id, book_id, y, held), packed: rows of factors, then rows of pairs as numbers of these."""
    kind = cells.schema["vec"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.list_(pa.float32() if kind == "float" else pa.float64())] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.float64()), pa.list_(pa.bool_())]
        names = ["p", "q", "u", "i", "y", "held"]

        def row(dim: int, **values: pa.Array) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(values[n])], pa.int32()), values[n].cast(t.value_type)) if n in values else pa.array([None], t)
                     for n, t in zip(names, types)]
            return pa.record_batch([pa.array([dim], pa.int32()), *lists], names=["dim", *names])

        waiting, count, now, dim = [], 0, None, 0

        def some(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, count
            while count >= least and count:
                whole = [pa.concat_arrays(x) for x in zip(*waiting)]
                yield row(dim, **{n: x.slice(0, PACKED_PAIRS) for n, x in zip(names[2:], whole)})
                waiting = [[x.slice(PACKED_PAIRS) for x in whole]]
                count = len(whole[0]) - min(len(whole[0]), PACKED_PAIRS)

        for b in blocks(batches):
            if b.p is not now:
                yield from some(1)
                now, dim, waiting = b.p, b.p.shape[1], []
                for name, m in (("p", b.p), ("q", b.q)):
                    for a in range(0, len(m), PACKED_FACTORS):
                        yield row(dim, **{name: pa.array(m[a:a + PACKED_FACTORS].ravel())})
            waiting.append([pa.array(b.u.astype(np.int32)), pa.array(b.i.astype(np.int32)), b.column("y"), b.column("held")])
            count += len(b.u)
            yield from some(PACKED_PAIRS)
        yield from some(1)

    return cells.mapInArrow(run, PACKED.format(kind))


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(p, q, u, i, y, held) of each packed row of pairs; p and q are the cell's factors."""
    p, q, whole = [], [], None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            values = {n: row.column(n).flatten() for n in ("p", "q", "u", "i", "y", "held")}
            if len(values["u"]):
                if p:
                    whole, p, q = (np.concatenate(p), np.concatenate(q)), [], []
                yield *whole, *(values[n].to_numpy(zero_copy_only=False) for n in ("u", "i", "y", "held"))
            else:
                for name, kept in (("p", p), ("q", q)):
                    if len(values[name]):
                        kept.append(values[name].to_numpy(zero_copy_only=False).reshape(-1, row.column("dim")[0].as_py()))


__all__ = ["Block", "blocks", "grid_of_bytes", "grid_of_cells", "in_cells", "pair_cells", "packed", "scored", "unpacked"]
