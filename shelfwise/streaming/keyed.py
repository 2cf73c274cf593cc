"""Feedback with keyed state: the newest event of each (user, book, type) lives in the state store, by buckets of keys.

A batch hands on only the keys that it touched, each with the strength before
and after, so what follows costs as much as the change and never reads an
earlier batch: profiles are kept as sums, and a changed strength adds

    (new - old) * vector  to a user's sum of vectors,  (new - old)  to the sum of weights.

A key without state starts from the strength in the base log, which is looked up
in the buckets of the users at hand alone. Epochs are written like those of
``feedback.write_epoch`` and the same readers serve them:

    <table>/changes/epoch=N      the touched keys
    <table>/popularity/epoch=N   events per book
    <table>/sums/epoch=N         what a user's sums change by
    <table>/done/epoch=N         written last
    <table>/base_strengths       strengths of the base log, by buckets of users
    <table>/sums_base/upto=N     sums of the users touched up to N, computed anew (rebuild_sums)
    <table>/rejects              rejected events, by a query of their own
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfwise.functions.vectors import l2_normalize
from shelfwise.streaming.feedback import _epochs, _fs, _numbers, feedback_source, feedback_strength, read_latest, valid_events

BASE_BUCKETS = 64
# Groups that the keys' state is kept in; a stream goes on with the number that it began with.
KEY_BUCKETS = 1 << 12
# Sums of weights below this are rounding: the user's weights are gone.
LEAST_WEIGHT = 1e-9

_KEYED = "user_id string, book_id string, type string, strength double, at string, event_id bigint, n_events bigint, old double"
# A bucket's keys as JSON: [[user, book, type], [time, id, strength]] of each.
_STATE = "keys string"
_SUMS = "user_id bigint, w double, s array<double>"
_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _newest_of_bucket(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket's keys in a batch against its state: each key's newest event by (time, id), the strength before, the number of events."""
    kept = {tuple(k): tuple(event) for k, event in json.loads(state.get[0])} if state.exists else {}
    best, count = {}, {}
    for part in parts:
        for k, event in zip(zip(part["user_id"], part["book_id"], part["type"]), zip(part["at"], part["event_id"].tolist(), part["strength"].tolist())):
            best[k] = max(best.get(k, event), event)
            count[k] = count.get(k, 0) + 1
    rows = []
    for k, event in best.items():
        old = kept.get(k)
        kept[k] = at, event_id, strength = event if old is None else max(event, old)
        rows.append((*k, strength, at, event_id, count[k], math.nan if old is None else old[2]))
    state.update((json.dumps([*kept.items()]),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _KEYED.split(", ")])


def changed_keys(events: DataFrame) -> DataFrame:
    """The keys touched by each batch of a stream of events: (user_id, book_id, type, strength, at, event_id, n_events, old).

    ``old`` is null for a key seen for the first time. Times compare to the
    microsecond; an event without one, or without an id, is the oldest. Keys lie
    in the state by buckets, as a call for a group costs as much as many hundred
    keys: a batch rewrites the buckets that it touches.
    """
    keys = ("user_id", "book_id", "type")
    valid = valid_events(feedback_strength(events)).select(
        "user_id", "book_id", F.col("event").alias("type"), "strength",
        F.coalesce(F.date_format("ts", _TIME), F.lit("")).alias("at"), F.coalesce("event_id", F.lit(-1).cast("bigint")).alias("event_id"))
    # As text an id may be null and has all its digits in pandas.
    rows = valid.select(*[F.col(c).cast("string") for c in keys], "strength", "at", "event_id",
                        F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int").alias("bucket"))
    out = rows.groupBy("bucket").applyInPandasWithState(_newest_of_bucket, _KEYED, _STATE, "update", GroupStateTimeout.NoTimeout)
    old = F.when(~F.isnan("old"), F.col("old")).alias("old")
    return out.select(*[F.col(c).cast("bigint") for c in keys[:2]], "type", "strength", "at", "event_id", "n_events", old)


def write_base_strengths(table: str, base_details: DataFrame) -> None:
    """The base log's strength per (user, book, type), by buckets of users; written once."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BASE_BUCKETS)).cast("int")
    path = f"{table}/base_strengths"
    store, target = _fs(base_details.sparkSession, path)
    if not store.exists(target):
        (base_details.select("user_id", "book_id", "type", "strength", bucket.alias("bucket")).repartition(BASE_BUCKETS, "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}.draft"))
        if not store.rename(_fs(base_details.sparkSession, f"{path}.draft")[1], target):
            raise FileExistsError(path)


def _base_of(spark: SparkSession, table: str, users: DataFrame) -> DataFrame:
    """Base strengths in the buckets of some users (at most ``BASE_BUCKETS`` numbers reach the driver)."""
    bucket = F.pmod(F.xxhash64("user_id"), F.lit(BASE_BUCKETS)).cast("int")
    some = [r[0] for r in users.select(bucket.alias("b")).distinct().collect()]
    rows = spark.read.schema("user_id bigint, book_id bigint, type string, strength double, bucket int").parquet(f"{table}/base_strengths")
    return rows.where(F.col("bucket").isin(some)).drop("bucket")


def _weighted_sums(strengths: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, w, s): sums of the column ``by`` and of ``by`` times the book's vector, over books that have one."""
    rows = strengths.join(items.select("book_id", "embedding"), "book_id")
    rows = rows.select("user_id", "by", array_to_vector(F.transform("embedding", lambda x: x * F.col("by"))).alias("v"))
    return rows.groupBy("user_id").agg(F.sum("by").alias("w"), vector_to_array(Summarizer.sum(F.col("v"))).alias("s"))


def write_keyed_epoch(table: str, items: DataFrame | None = None):
    """foreachBatch sink of ``changed_keys``; an epoch that runs again replaces its own folders with the same rows."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, part: str) -> DataFrame:
            path = f"{table}/{part}/epoch={epoch}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        last_at = F.struct(F.expr("try_cast(at AS timestamp_ntz)").alias("ts"), F.col("event_id"))
        keys = put(batch.select("user_id", "book_id", "type", "strength", last_at.alias("last_at"), "n_events", "old"), "changes")
        put(keys.groupBy("book_id").agg(F.sum("n_events").alias("cnt")), "popularity")
        if items is not None:
            first = keys.where("old IS NULL")
            base = _base_of(spark, table, first).withColumnRenamed("strength", "base")
            keys = keys.join(base, ["user_id", "book_id", "type"], "left")
            by = F.col("strength") - F.coalesce("old", "base", F.lit(0.0))
            change = _weighted_sums(keys.select("user_id", "book_id", by.alias("by")), items)
            put(keys.select("user_id").distinct().join(change, "user_id", "left"), "sums")
        put(spark.range(1), "done")
    return write


def keyed_stream(spark: SparkSession, source_dir: str, table: str, checkpoint: str, files_per_trigger: int | None = None,
                 available_now: bool = True, base_details: DataFrame | None = None, items: DataFrame | None = None, json: bool = False) -> list:
    """J1-J3 with state: starts the query of the changed keys and that of the rejects, and returns both.

    With ``base_details`` and ``items`` profiles are kept as sums. A query
    started again on its checkpoint goes on where it was.
    """
    if (base_details is None) != (items is None):
        raise ValueError("profiles need both base details and item vectors")
    if base_details is not None:
        write_base_strengths(table, base_details)
    source = lambda: feedback_source(spark, source_dir, files_per_trigger, json)
    keys = (changed_keys(source()).writeStream.outputMode("update").foreachBatch(write_keyed_epoch(table, items))
            .option("checkpointLocation", f"{checkpoint}/keys"))
    rejects = (feedback_strength(source()).where("reject_reason IS NOT NULL").writeStream.format("parquet")
               .option("path", f"{table}/rejects").option("checkpointLocation", f"{checkpoint}/rejects"))
    when = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return [q.trigger(**when).start() for q in (keys, rejects)]


def base_sums(base_details: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, w, s) of the base log: what profiles start from."""
    return _weighted_sums(base_details.where("strength > 0").withColumnRenamed("strength", "by"), items)


def rebuild_sums(spark: SparkSession, table: str, items: DataFrame) -> int | None:
    """Computes the sums of all touched users anew from strengths, so that rounding adds up over the epochs since only; published by one rename."""
    done, bases = _numbers(spark, f"{table}/done", "epoch"), _numbers(spark, f"{table}/sums_base", "upto")
    if not done or (bases and bases[-1] >= done[-1]):
        return None
    latest = read_latest(spark, table, done[-1]).withColumn("new", F.lit(True))
    touched = latest.select("user_id").distinct()
    base = (spark.read.parquet(f"{table}/base_strengths").drop("bucket").join(touched, "user_id", "left_semi")
            .join(latest.select("user_id", "book_id", "type"), ["user_id", "book_id", "type"], "left_anti"))
    strengths = latest.select("user_id", "book_id", F.col("strength").alias("by")).unionByName(base.select("user_id", "book_id", F.col("strength").alias("by")))
    draft = f"{table}/.draft-{uuid.uuid4().hex}"
    touched.join(_weighted_sums(strengths, items), "user_id", "left").write.parquet(draft)
    store, target = _fs(spark, f"{table}/sums_base/upto={done[-1]}")
    store.mkdirs(target.getParent())
    if not store.rename(_fs(spark, draft)[1], target):
        raise FileExistsError(str(target))
    return done[-1]


def read_sums(spark: SparkSession, table: str, start: DataFrame) -> DataFrame:
    """(user_id, w, s) of the touched users: the sums that they start from (``base_sums``, or those rebuilt) and all changes since."""
    bases = _numbers(spark, f"{table}/sums_base", "upto")
    rows = _epochs(spark, table, "sums", bases[-1] if bases else None, _SUMS).drop("epoch")
    if bases:
        again = spark.read.schema(_SUMS).parquet(f"{table}/sums_base/upto={bases[-1]}")
        late = rows.select("user_id").distinct().join(again, "user_id", "left_anti")
        rows = rows.unionByName(again).unionByName(start.join(late, "user_id", "left_semi").select("user_id", "w", "s"))
    else:
        rows = rows.unionByName(start.join(rows.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "w", "s"))
    some = rows.where("s IS NOT NULL").groupBy("user_id").agg(
        F.sum("w").alias("w"), vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return rows.select("user_id").distinct().join(some, "user_id", "left")


def read_keyed_profiles(spark: SparkSession, table: str, start: DataFrame, base_profiles: DataFrame) -> DataFrame:
    """(user_id, profile) of the touched users from their sums; one whose weights are gone keeps its base profile."""
    sums = read_sums(spark, table, start)
    new = l2_normalize(sums.where(F.col("w") > LEAST_WEIGHT).select("user_id", F.transform("s", lambda x: x / F.col("w")).alias("profile")), "profile")
    new = new.where("profile IS NOT NULL")
    old = base_profiles.join(sums.select("user_id"), "user_id", "left_semi").join(new.select("user_id"), "user_id", "left_anti")
    return new.unionByName(old.select("user_id", "profile"))


__all__ = ["base_sums", "changed_keys", "keyed_stream", "read_keyed_profiles", "read_sums", "rebuild_sums", "write_keyed_epoch"]
