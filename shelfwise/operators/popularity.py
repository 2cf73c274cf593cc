"""Popularity: counts, global top-n, and per-user top-n minus seen (cold-start path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfwise.operators.ranking import global_row_number, topk_per_key

# Ranks up to this many times the requested n are joined by broadcast (a fixed,
# parameter-bounded table); users who need deeper ranks use a shuffle join.
HEAD_FACTOR = 20


def popularity(interactions: DataFrame) -> DataFrame:
    """Interaction rows per book (every event counts, not distinct users)."""
    return interactions.groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt"))


def ranked_popularity(pop: DataFrame) -> DataFrame:
    """(book_id, cnt, prank): position in (cnt DESC, book_id ASC), distributed numbering."""
    return global_row_number(pop, [F.col("cnt").desc(), F.col("book_id").asc()], "prank")


def popular_topk(pop: DataFrame, n: int = 10) -> DataFrame:
    """the n most popular books (rank, book_id, cnt). TakeOrderedAndProject keeps n per task."""
    top = pop.orderBy(F.col("cnt").desc(), F.col("book_id").asc()).limit(n)
    return topk_per_key(top.withColumn("_g", F.lit(0)), "_g",
                        [F.col("cnt").desc(), F.col("book_id").asc()], n).select("rank", "book_id", "cnt")


def unseen_popular(users: DataFrame, pop: DataFrame, seen: DataFrame, k: int = 10) -> DataFrame:
    """L1d: per user, the k most popular books the user has not seen.

    The answer lies in the first ``k`` + s ranks, where s counts the seen books
    that stand before the k-th unseen one: a user's i-th seen book, at rank p,
    has p - i unseen books before it, so it counts if p - i < k. Each user asks
    for these rank slots, joins the ranked popularity table on the slot number,
    drops seen pairs and keeps the first k. Slots up to ``HEAD_FACTOR*k`` join a
    broadcast head table of at most that many rows; deeper ones shuffle-join.
    """
    ranked = ranked_popularity(pop)
    who = users.select("user_id").distinct()
    at = (seen.select("user_id", "book_id").join(who, "user_id", "left_semi").join(ranked.select("book_id", "prank"), "book_id")
          .select("user_id", "prank"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("prank"))
    before = (at.withColumn("_i", nth).where(F.col("prank") - F.col("_i") < k)
              .groupBy("user_id").agg(F.count(F.lit(1)).alias("n_before")))
    need = (who.join(before, "user_id", "left")
            .select("user_id", (F.lit(k) + F.coalesce("n_before", F.lit(0))).alias("need")))
    slots = need.select("user_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need").cast("bigint")))
                        .alias("prank"))
    head_n = HEAD_FACTOR * k
    head = slots.where(F.col("prank") <= head_n).join(
        F.broadcast(ranked.where(F.col("prank") <= head_n)), "prank")
    tail = slots.where(F.col("prank") > head_n).join(ranked.where(F.col("prank") > head_n), "prank")
    cand = head.unionByName(tail).join(seen.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")
    return (topk_per_key(cand, "user_id", [F.col("prank").asc()], k)
            .select("user_id", "rank", "book_id", F.col("cnt").cast("double").alias("score"), "cnt"))


def popularity_increment(pop: DataFrame, events: DataFrame) -> DataFrame:
    """+1 per new event (not per distinct user); a new book starts at its event count."""
    inc = events.groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt"))
    return pop.select("book_id", "cnt").unionByName(inc).groupBy("book_id").agg(F.sum("cnt").alias("cnt"))
