"""Exact sparse top-k by inverted lists: terms that can't lift a pair into a list make no candidates.

For rows of non-negative term weights and their dot product:

1. Champions: each term's few heaviest rows. A row's strongest terms meet their
   champions, and what these terms alone add up to is a lower bound of a pair's
   score; the k-th best of a row's bounds bounds its list from below.
2. A row's terms are added up from the most common on, each with the greatest
   weight that the term has anywhere. As long as the sum stays below the row's
   bound, these terms alone can't lift a pair into its list: a candidate shares
   one of the others.
3. Candidates come from the inverted lists of those others only, and are scored
   in full from both rows' vectors.

Rows whose other terms have lists longer than ``LIST_SHARE`` of all rows or
``LIST_ROWS``, added up, would meet a good part of all rows anyway: they go to the block scorer, which
makes no pairs. Lists that come short are filled with rows of score 0 in the
order of their ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.blockscore import TIE_DECIMALS, _lists, exact_topk
from shelfwise.operators.ranking import topk_per_key
from shelfwise.session import ensure_checkpoint_dir

STRONG_TERMS = 8
LIST_SHARE = 0.25
LIST_ROWS = 2048            # and at most so many, else the pairs would grow with the square of the rows
SLACK = 1e-9


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lid, rid, score) of pairs with both vectors (ids ascending): terms of both are met by one sort."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            n = part.num_rows
            sides = []
            for side in ("l", "r"):
                ptr, idx = _lists(part.column(f"{side}idx"), np.int64)
                sides.append((np.repeat(np.arange(n), np.diff(ptr)), idx, _lists(part.column(f"{side}val"), np.float64)[1]))
            terms, code = np.unique(np.concatenate([sides[0][1], sides[1][1]]), return_inverse=True)
            cut = len(sides[0][1])
            left = sides[0][0] * len(terms) + code[:cut]
            right = sides[1][0] * len(terms) + code[cut:]
            order = np.argsort(left, kind="stable")
            found = np.searchsorted(left[order], right)
            hit = np.flatnonzero(found < cut) if cut else np.zeros(0, np.int64)
            hit = hit[left[order[found[hit]]] == right[hit]]
            score = np.bincount(sides[1][0][hit], sides[0][2][order[found[hit]]] * sides[1][2][hit], n)
            yield pa.record_batch([part.column("lid"), part.column("rid"), pa.array(np.round(score, TIE_DECIMALS))], names=["lid", "rid", "score"])


def sparse_topk(vectors: DataFrame, id_col: str, vec_col: str, k: int, out=("lid", "rank", "rid", "score"),
                list_share: float = LIST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(the ``k`` best other rows of each row, the numbers of rows, of pairs scored and of rows left to the block scorer), exact.

    ``vectors`` has STRUCT<idx, val> columns with positive weights and distinct
    indices. Ties go to the smaller id; rows without terms score 0 with all.
    """
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(f"{vec_col}.idx").alias("idx"),
                          F.col(f"{vec_col}.val").alias("val")).checkpoint(eager=True)
    n = rows.count()
    flat = rows.select("id", F.explode(F.arrays_zip("idx", "val")).alias("x")).select("id", F.col("x.idx").alias("term"), F.col("x.val").alias("w"))
    terms = flat.groupBy("term").agg(F.count("*").alias("df"), F.max("w").alias("top"))
    flat = flat.join(terms, "term").checkpoint(eager=True)

    # 1. Lower bounds from champions.
    best = topk_per_key(flat.where("df > 1"), "term", [F.col("w").desc(), F.col("id").asc()], k + 1)
    best = best.select("term", F.col("id").alias("other"), F.col("w").alias("wo"))
    strong = topk_per_key(flat.where("df > 1"), "id", [(F.col("w") * F.col("top")).desc(), F.col("term").asc()], STRONG_TERMS)
    bounds = (strong.select("id", "term", "w").join(best, "term").where("id <> other")
              .groupBy("id", "other").agg(F.sum(F.col("w") * F.col("wo")).alias("low")))
    bounds = (topk_per_key(bounds, "id", [F.col("low").desc(), F.col("other").asc()], k).groupBy("id")
              .agg(F.count("*").alias("n"), F.min("low").alias("low")).where(F.col("n") >= k).select("id", "low"))

    # 2. Terms that a candidate must share one of.
    so_far = Window.partitionBy("id").orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, 0)
    needed = (flat.where("df > 1").withColumn("sum", F.sum(F.col("w") * F.col("top")).over(so_far)).join(bounds, "id", "left")
              .where(F.col("sum") * (1 + SLACK) + SLACK >= F.coalesce("low", F.lit(0.0))).select("id", "term", "df"))
    lengths = needed.groupBy("id").agg(F.sum("df").alias("length"))
    many = lengths.where(F.col("length") > max(min(list_share * n, LIST_ROWS), 64)).select("id").checkpoint(eager=True)
    needed = needed.join(many, "id", "left_anti")

    # 3. Candidates from their lists, scored in full.
    pairs = (needed.select(F.col("id").alias("lid"), "term").join(flat.select(F.col("id").alias("rid"), "term"), "term")
             .where("lid <> rid").select("lid", "rid").distinct())
    both = (pairs.join(rows.select(F.col("id").alias("lid"), F.col("idx").alias("lidx"), F.col("val").alias("lval")), "lid")
            .join(rows.select(F.col("id").alias("rid"), F.col("idx").alias("ridx"), F.col("val").alias("rval")), "rid"))
    scored = both.select("lid", "rid", "lidx", "lval", "ridx", "rval").mapInArrow(_dots, "lid bigint, rid bigint, score double").checkpoint(eager=True)
    lists = topk_per_key(scored, "lid", [F.col("score").desc(), F.col("rid").asc()], k).select("lid", "rid", "score")

    # Short lists: the least ids hold enough rows that aren't in them.
    short = (rows.select(F.col("id").alias("lid")).join(many.withColumnRenamed("id", "lid"), "lid", "left_anti")
             .join(lists.groupBy("lid").agg(F.collect_list("rid").alias("has")), "lid", "left").where(F.coalesce(F.size("has"), F.lit(0)) < k))
    least = [r["id"] for r in rows.select("id").orderBy("id").limit(2 * k + 1).collect()]
    fill = (short.withColumn("has", F.concat(F.coalesce("has", F.array().cast("array<bigint>")), F.array("lid")))
            .select("lid", F.explode(F.array_except(F.lit(least).cast("array<bigint>"), "has")).alias("rid")).withColumn("score", F.lit(0.0)))
    lists = topk_per_key(lists.unionByName(fill), "lid", [F.col("score").desc(), F.col("rid").asc()], k)
    dense = exact_topk(vectors.join(many.withColumnRenamed("id", id_col), id_col, "left_semi"), id_col, vec_col, vectors, id_col, vec_col, k,
                       exclude_same_id=True, kind="sparse")
    ranked = lists.select("lid", "rank", "rid", "score").unionByName(dense)
    counts = scored.agg(F.lit(n).cast("bigint").alias("rows"), F.count("*").alias("pairs"), F.lit(many.count()).cast("bigint").alias("dense_rows"))
    a, r, b, s = out
    return ranked.select(F.col("lid").alias(a), F.col("rank").alias(r), F.col("rid").alias(b), F.col("score").alias(s)), counts
