"""Feedback intake and online refresh: batch twins and the Structured Streaming job.

Event -> strength (validated), then per (user, book, event type) the newest
event's strength *replaces* the stored one (other types are kept), the touched
users' profiles are recomputed and popularity grows by one per event. Events
are ordered by (ts, event_id).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.content import user_profiles
from shelfwise.operators.interactions import TYPES
from shelfwise.operators.ranking import global_row_number
from shelfwise.streaming.intake import parse_feedback

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("book_id", T.LongType()),
    T.StructField("event", T.StringType()),
    T.StructField("rating_value", T.IntegerType()),
])

# Event names accepted by the intake.
EVENTS = ("rating", "favorite", "history")
# Why an event is rejected.
REJECT_EVENT = "unknown_event"
REJECT_RANGE = "rating_out_of_range"
REJECT_RATING = "rating_missing"
DEFAULT_BUFFER = 100


def feedback_strength(events: DataFrame) -> DataFrame:
    """(event_id, user_id, book_id, event, strength, reject_reason); rejects have NULL strength.

    Events of the JSON intake keep their line as ``raw``; what it found wrong comes before the rules here.
    """
    v = F.col("rating_value")
    reason = (F.when(~F.col("event").isin(*EVENTS) | F.col("event").isNull(), F.lit(REJECT_EVENT))
              .when(v.isNotNull() & ((v < 0) | (v > 5)), F.lit(REJECT_RANGE))
              .when((F.col("event") == "rating") & (v.isNull() | (v < 1)), F.lit(REJECT_RATING)))
    more = []
    if "intake_reason" in events.columns:
        reason, more = F.coalesce("intake_reason", reason), ["raw"]
    strength = (F.when(F.col("event") == "rating", v.cast("double"))
                .when(F.col("event") == "favorite", F.when(v == 0, F.lit(0.0)).otherwise(F.lit(5.0)))
                .otherwise(F.lit(1.0)))
    return events.select("event_id", "ts", "user_id", "book_id", "event",
                         F.when(reason.isNull(), strength).alias("strength"), reason.alias("reject_reason"), *more)


def valid_events(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("reject_reason").isNull()).drop("reject_reason")


def type_details(interactions: DataFrame) -> DataFrame:
    """Per (user, book, type) summed strength: the store's details in long form."""
    return (interactions.groupBy("user_id", "book_id", F.col("type"))
            .agg(F.sum("strength").alias("strength")))


def latest_per_key(valid: DataFrame) -> DataFrame:
    """J2 state: per (user, book, event) the newest strength, its (ts, event_id) and the event count."""
    return (valid.groupBy("user_id", "book_id", F.col("event").alias("type"))
            .agg(F.max_by("strength", F.struct("ts", "event_id")).alias("strength"),
                 F.max(F.struct("ts", "event_id")).alias("last_at"),
                 F.count(F.lit(1)).alias("n_events")))


def apply_latest(base_details: DataFrame, latest: DataFrame) -> DataFrame:
    """Replace base details by the newest feedback per type; pivot to the store layout."""
    d = (base_details.select("user_id", "book_id", "type", F.col("strength").alias("_b"))
         .join(latest.select("user_id", "book_id", "type", F.col("strength").alias("_n")),
               ["user_id", "book_id", "type"], "full")
         .select("user_id", "book_id", "type", F.coalesce("_n", "_b").alias("strength")))
    per_type = [F.sum(F.when(F.col("type") == t, F.col("strength"))).alias(t) for t in TYPES]
    return d.groupBy("user_id", "book_id").agg(F.sum("strength").alias("total"), *per_type)


def profile_refresh(base_store: DataFrame, new_store: DataFrame, touched: DataFrame, items: DataFrame) -> DataFrame:
    """Profiles of touched users from the new store; a user whose new profile is
    undefined (weights sum to 0) keeps the old one."""
    t = touched.select("user_id").distinct()
    new = user_profiles(new_store.join(t, "user_id", "left_semi"), items)
    old = user_profiles(base_store.join(t, "user_id", "left_semi"), items)
    return new.unionByName(old.join(new.select("user_id"), "user_id", "left_anti"))


def buffer_trigger(valid: DataFrame, buffer_size: int = DEFAULT_BUFFER, force: bool = False) -> DataFrame:
    """J5 batch twin: events in arrival order; update k applies events (k-1)*B+1 .. k*B.

    Without ``force`` the last partial buffer is held (applied = false).
    """
    if not 10 <= buffer_size <= 1000:
        raise ValueError("buffer_size must be within 10-1000")
    n = valid.count()
    full = n // buffer_size
    r = global_row_number(valid, [F.col("ts").asc(), F.col("event_id").asc()], "_rn")
    upd = F.ceil(F.col("_rn") / F.lit(buffer_size)).cast("bigint")
    applied = F.lit(True) if force else (upd <= F.lit(full))
    return r.select("event_id", upd.alias("update_no"), applied.alias("applied"))


def buffer_status(valid: DataFrame, buffer_size: int = DEFAULT_BUFFER, enabled: bool = True) -> DataFrame:
    """Pending events after the full buffers were applied, capacity and fullness (one row)."""
    pend = F.pmod(F.count(F.lit(1)), F.lit(buffer_size)).cast("bigint")
    return valid.agg(pend.alias("buffer_size")).select(
        F.lit(enabled).alias("enabled"), "buffer_size", F.lit(buffer_size).cast("bigint").alias("buffer_capacity"),
        (F.lit(enabled) & (F.col("buffer_size") >= buffer_size)).alias("buffer_full"))


# ----------------------------------------------------------------- streaming job
#
# <table>/changes/epoch=N      newest feedback per (user, book, type) of the batch
# <table>/popularity/epoch=N   events per book
# <table>/profiles/epoch=N     touched users' profiles (null: weights sum to 0)
# <table>/rejects/epoch=N      rejected events with the reason
# <table>/done/epoch=N         written last: readers see an epoch by this mark only
# <table>/base/upto=N          changes of the epochs up to N in one table (compact)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """N of the folders <folder>/<name>=N, ascending."""
    store, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(f"{name}="))


def _epochs(spark: SparkSession, table: str, part: str, after: int | None, schema: str) -> DataFrame:
    """Rows of a part in the finished epochs above ``after``, with the column epoch."""
    known = [n for n in _numbers(spark, f"{table}/done", "epoch") if after is None or n > after]
    if not known:
        return spark.createDataFrame([], f"{schema}, epoch bigint")
    paths = [f"{table}/{part}/epoch={n}" for n in known]
    df = spark.read.option("basePath", f"{table}/{part}").schema(f"{schema}, epoch bigint").parquet(*paths)
    return df


_CHANGE = ("user_id bigint, book_id bigint, type string, strength double, "
           "last_at struct<ts: timestamp_ntz, event_id: bigint>, n_events bigint")


def _newest(changes: DataFrame) -> DataFrame:
    return (changes.groupBy("user_id", "book_id", "type")
            .agg(F.max_by("strength", "last_at").alias("strength"), F.max("last_at").alias("last_at"),
                 F.sum("n_events").alias("n_events")))


def read_latest(spark: SparkSession, table: str, upto: int | None = None) -> DataFrame:
    """Newest feedback per (user, book, type) in all finished epochs (or those up to one), over the newest base."""
    bases = [n for n in _numbers(spark, f"{table}/base", "upto") if upto is None or n <= upto]
    rows = _epochs(spark, table, "changes", bases[-1] if bases else None, _CHANGE)
    if upto is not None:
        rows = rows.where(F.col("epoch") <= upto)
    rows = rows.drop("epoch")
    if bases:
        rows = rows.unionByName(spark.read.schema(_CHANGE).parquet(f"{table}/base/upto={bases[-1]}"))
    return _newest(rows)


def read_profiles(spark: SparkSession, table: str, base_profiles: DataFrame) -> DataFrame:
    """Profiles of the users that the stream touched; one whose weights sum to 0 keeps its base profile."""
    rows = _epochs(spark, table, "profiles", None, "user_id bigint, profile array<double>")
    last = rows.groupBy("user_id").agg(F.max_by("profile", "epoch").alias("_new"))
    old = base_profiles.select("user_id", F.col("profile").alias("_old"))
    return (last.join(old, "user_id", "left").select("user_id", F.coalesce("_new", "_old").alias("profile"))
            .where(F.col("profile").isNotNull()))


def read_popularity(spark: SparkSession, table: str, base: DataFrame) -> DataFrame:
    """Base counts and one for each event of the finished epochs."""
    rows = _epochs(spark, table, "popularity", None, "book_id bigint, cnt bigint")
    return (base.select("book_id", "cnt").unionByName(rows.select("book_id", "cnt"))
            .groupBy("book_id").agg(F.sum("cnt").alias("cnt")))


def compact(spark: SparkSession, table: str) -> int | None:
    """Merges the finished epochs into a new base, apart from the stream; published by one rename."""
    done = _numbers(spark, f"{table}/done", "epoch")
    bases = _numbers(spark, f"{table}/base", "upto")
    if not done or (bases and bases[-1] >= done[-1]):
        return None
    draft = f"{table}/.draft-{uuid.uuid4().hex}"
    read_latest(spark, table, done[-1]).write.parquet(draft)
    store, target = _fs(spark, f"{table}/base/upto={done[-1]}")
    store.mkdirs(target.getParent())
    if not store.rename(_fs(spark, draft)[1], target):
        raise FileExistsError(str(target))
    return done[-1]


def write_epoch(table: str, base_details: DataFrame | None = None, items: DataFrame | None = None):
    """foreachBatch sink: appends a batch's changes as one epoch; nothing that is there is rewritten.

    An epoch that runs again (after a crash at any point) replaces its own
    folders alone, with the same rows; it counts once its mark is written. With
    ``base_details`` and ``items`` the touched users' profiles are recomputed
    from the base and all changes so far.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def put(df: DataFrame, part: str) -> None:
            df.write.mode("overwrite").parquet(f"{table}/{part}/epoch={epoch}")

        scored = feedback_strength(batch).persist()
        try:
            valid = valid_events(scored)
            put(latest_per_key(valid), "changes")
            put(valid.groupBy("book_id").agg(F.count(F.lit(1)).alias("cnt")), "popularity")
            put(scored.where(F.col("reject_reason").isNotNull()), "rejects")
            if items is not None:
                touched = valid.select("user_id").distinct()
                now = spark.read.schema(_CHANGE).parquet(f"{table}/changes/epoch={epoch}")
                earlier = read_latest(spark, table, epoch - 1).select(*now.columns)
                latest = _newest(earlier.unionByName(now).join(touched, "user_id", "left_semi"))
                store = apply_latest(base_details.join(touched, "user_id", "left_semi"), latest)
                put(touched.join(user_profiles(store, items), "user_id", "left"), "profiles")
            put(spark.range(1), "done")
        finally:
            scored.unpersist()
    return write


def feedback_source(spark: SparkSession, source_dir: str, files_per_trigger: int | None = None, json: bool = False) -> DataFrame:
    """A stream of the feedback files in a folder, Parquet or JSON lines."""
    src = spark.readStream
    if files_per_trigger is not None:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    return parse_feedback(src.text(source_dir)) if json else src.schema(FEEDBACK_SCHEMA).parquet(source_dir)


def feedback_stream(spark: SparkSession, source_dir: str, table: str, checkpoint: str,
                    files_per_trigger: int | None = None, available_now: bool = True,
                    base_details: DataFrame | None = None, items: DataFrame | None = None, json: bool = False):
    """Stream feedback files -> validate -> change log, profiles and popularity in ``table``.

    The query keeps no state: a batch is reduced to its newest row per key and
    readers merge epochs. ``available_now`` processes everything present (the
    forced flush); otherwise the query keeps running on a processing-time trigger.
    ``json`` reads JSON lines instead of Parquet.
    """
    w = (feedback_source(spark, source_dir, files_per_trigger, json).writeStream.foreachBatch(write_epoch(table, base_details, items))
         .option("checkpointLocation", checkpoint))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


class OnlineLearning:
    """Enable / disable online learning = start / stop the feedback stream.

    Disabling never drops events: they stay in the source folder and are
    applied when the stream is enabled again (its checkpoint remembers what was
    read).
    """

    def __init__(self, spark: SparkSession, source_dir: str, table: str, checkpoint: str,
                 base_details: DataFrame | None = None, items: DataFrame | None = None):
        self.args = (spark, source_dir, table, checkpoint)
        self.model = {"base_details": base_details, "items": items}
        self.query = None

    @property
    def enabled(self) -> bool:
        return self.query is not None and self.query.isActive

    def enable(self, files_per_trigger: int | None = None) -> OnlineLearning:
        self.disable()
        self.query = feedback_stream(*self.args, files_per_trigger, False, **self.model)
        return self

    def flush(self) -> None:
        """Force an update now: process everything present, then stop (availableNow)."""
        self.disable()
        feedback_stream(*self.args, None, True, **self.model).awaitTermination()

    def disable(self) -> None:
        if self.enabled:
            self.query.stop()
        self.query = None
