"""Interaction log operators: per-pair sums, the typed store, id filters, summary stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir

TYPES = ("rating", "history", "favorite")


def agg_strength(interactions: DataFrame) -> DataFrame:
    """Summed strength per (user, book) - the CF input matrix in long form."""
    return (interactions.groupBy("user_id", "book_id")
            .agg(F.sum("strength").alias("strength")))


def interaction_store(interactions: DataFrame) -> DataFrame:
    """D3: per (user, book) the summed strength of each event type and their total.

    One partial+final aggregation; a type the pair never had is NULL.
    """
    per_type = [F.sum(F.when(F.col("type") == t, F.col("strength"))).alias(t) for t in TYPES]
    return (interactions.groupBy("user_id", "book_id")
            .agg(F.sum("strength").alias("total"), *per_type))


def interaction_store_map(interactions: DataFrame) -> DataFrame:
    """D3 in the reference's nested form: details MAP<type, strength> plus total.

    The map is built from at most one row per (user, book, type), so it holds a
    handful of entries whatever the log size.
    """
    t = interactions.groupBy("user_id", "book_id", "type").agg(F.sum("strength").alias("s"))
    return (t.groupBy("user_id", "book_id")
            .agg(F.sum("s").alias("total"),
                 F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "s")))).alias("details")))


def seen_pairs(interactions: DataFrame) -> DataFrame:
    """Distinct (user_id, book_id) a user has touched (the exclusion set)."""
    return interactions.select("user_id", "book_id").distinct()


def known_pairs(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Rows whose user and item are both known to the model (two semi joins)."""
    return (df.join(users.select("user_id").distinct(), "user_id", "left_semi")
            .join(items.select("book_id").distinct(), "book_id", "left_semi"))


def exclude_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop candidate (user, book) pairs the user already interacted with."""
    return candidates.join(seen.select("user_id", "book_id"), ["user_id", "book_id"], "left_anti")


def interaction_stats(interactions: DataFrame) -> DataFrame:
    """Strength distribution and sizes of the log, one row.

    The median is exact, found by counting (``exact_median``).
    """
    row = interactions.agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("book_id").alias("n_books"),
        F.min("strength").alias("min_strength"),
        F.max("strength").alias("max_strength"),
        F.avg("strength").alias("mean_strength"),
    )
    return row.withColumn("median_strength", F.lit(exact_median(interactions, "strength")).cast("double"))


def exact_median(df: DataFrame, col: str, few: int = 10_000, bins: int = 1000) -> float | None:
    """The median of a numeric column (mean of the two middle values; nulls and NaN left out).

    Values are counted once; then rounds of ``bins`` counts narrow the interval
    that holds the middle ranks, until it has at most ``few`` distinct values.
    No task and no driver step holds more than these.
    """
    ensure_checkpoint_dir(df.sparkSession)
    v = F.col(col).cast("double")
    counts = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v)).groupBy("v").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    s = counts.agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d")).first()
    if not s["n"]:
        return None
    lo, hi, before, distinct = s["lo"], s["hi"], 0, s["d"]
    ranks = ((s["n"] - 1) // 2, s["n"] // 2)  # from 0
    while distinct > few and hi > lo:
        step = (hi - lo) / bins
        b = F.least(F.floor((F.col("v") - lo) / step), F.lit(bins - 1))
        rows = sorted(counts.where(F.col("v").between(lo, hi)).groupBy(b.alias("b")).agg(
            F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d")).collect(), key=lambda r: r["b"])
        kept, upto = [], before
        for r in rows:
            if upto + r["n"] > ranks[0] and upto <= ranks[1]:
                kept.append((upto, r))
            upto += r["n"]
        new = (kept[0][1]["lo"], kept[-1][1]["hi"])
        if new == (lo, hi):
            break
        before, (lo, hi), distinct = kept[0][0], new, sum(r["d"] for _, r in kept)
    out, upto = [], before
    for r in counts.where(F.col("v").between(lo, hi)).orderBy("v").toLocalIterator():
        out += [r["v"] for rank in ranks if upto <= rank < upto + r["n"]]
        upto += r["n"]
        if len(out) == 2:
            break
    return sum(out) / 2
