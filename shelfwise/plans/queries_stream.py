"""Registered queries: feedback intake, online refresh (batch twins) and the streaming job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.operators.content import item_vectors, profiles_long, user_profiles
from shelfwise.operators.interactions import interaction_store
from shelfwise.operators.popularity import popularity, popularity_increment
from shelfwise.plans.oracle import profile_blocks, sql
from shelfwise.plans.registry import register
from shelfwise.session import scratch_path
from shelfwise.sources.testdata import FEEDBACK_START
from shelfwise.streaming import feedback as FB
from shelfwise.streaming import keyed as KS
from shelfwise.streaming.intake import parse_feedback

_CUTOFF = f"TIMESTAMP '{FEEDBACK_START}'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FB_BLOCKS = {
    "fs": (f"""
SELECT event_id, ts, user_id, book_id, event,
       CASE WHEN reason IS NULL THEN
            CASE WHEN event = 'rating' THEN CAST(rating_value AS DOUBLE)
                 WHEN event = 'favorite' THEN CASE WHEN rating_value = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST(5.0 AS DOUBLE) END
                 ELSE CAST(1.0 AS DOUBLE) END END AS strength,
       reason AS reject_reason
FROM (SELECT *, CASE WHEN event IS NULL OR event NOT IN ('rating', 'favorite', 'history') THEN {_q(FB.REJECT_EVENT)}
                     WHEN rating_value IS NOT NULL AND (rating_value < 0 OR rating_value > 5) THEN {_q(FB.REJECT_RANGE)}
                     WHEN event = 'rating' AND (rating_value IS NULL OR rating_value < 1) THEN {_q(FB.REJECT_RATING)}
                END AS reason FROM feedback) t""", ("feedback",)),
    "fv": ("SELECT * FROM fs WHERE reject_reason IS NULL", ("fs",)),
    "flat": ("""
SELECT user_id, book_id, event AS type, strength FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, book_id, event ORDER BY ts DESC, event_id DESC) AS rn FROM fv) t
WHERE rn = 1""", ("fv",)),
    "binter": (f"SELECT * FROM inter WHERE ts < {_CUTOFF}", ("inter",)),
    "bdet": ("SELECT user_id, book_id, type, sum(strength) AS strength FROM binter GROUP BY 1, 2, 3", ("binter",)),
    "nstore": ("""
SELECT user_id, book_id, sum(strength) AS total,
       sum(CASE WHEN type = 'rating' THEN strength END) AS rating,
       sum(CASE WHEN type = 'history' THEN strength END) AS history,
       sum(CASE WHEN type = 'favorite' THEN strength END) AS favorite
FROM (SELECT coalesce(n.user_id, b.user_id) AS user_id, coalesce(n.book_id, b.book_id) AS book_id,
             coalesce(n.type, b.type) AS type, coalesce(n.strength, b.strength) AS strength
      FROM flat n FULL OUTER JOIN bdet b ON n.user_id = b.user_id AND n.book_id = b.book_id AND n.type = b.type) t
GROUP BY user_id, book_id""", ("flat", "bdet")),
}

def _refresh_blocks() -> dict:
    b = dict(_FB_BLOCKS)
    b["touched"] = ("SELECT DISTINCT user_id FROM fv", ("fv",))
    b["tnew"] = ("SELECT * FROM nstore WHERE user_id IN (SELECT user_id FROM touched)", ("nstore", "touched"))
    b["bstore"] = ("""
SELECT user_id, book_id, sum(strength) AS total FROM binter
WHERE user_id IN (SELECT user_id FROM touched) GROUP BY user_id, book_id""", ("binter", "touched"))
    b.update(profile_blocks("n_", "tnew"))
    b.update(profile_blocks("o_", "bstore"))
    return b


class _Feedback:
    def __init__(self, c):
        self.c = c
        cut = F.lit(FEEDBACK_START).cast("timestamp_ntz")
        self.base = c.interactions.where(F.col("ts") < cut)
        self.scored = FB.feedback_strength(c.src.feedback)
        self.valid = FB.valid_events(self.scored)


def _fb(c) -> _Feedback:
    return c.memo("fb", lambda: _Feedback(c))


@register("feedback_source", sql("SELECT * FROM feedback", "feedback"))
def q_feedback_source(c):
    """Feedback events in the intake schema."""
    s = c.src.feedback
    return s.select(*[F.col(f.name).cast(f.dataType) for f in FB.FEEDBACK_SCHEMA.fields])


@register("feedback_strength", sql("SELECT event_id, user_id, book_id, event, strength, reject_reason FROM fs",
                                   extra=_FB_BLOCKS))
def q_feedback_strength(c):
    """Event -> strength, with the rejection reason for invalid events."""
    return _fb(c).scored.select("event_id", "user_id", "book_id", "event", "strength", "reject_reason")


@register("feedback_latest", sql("SELECT * FROM nstore", extra=_FB_BLOCKS))
def q_feedback_latest(c):
    """Base store (log before the cut-off) with the newest feedback per type replacing it."""
    f = _fb(c)
    return FB.apply_latest(FB.type_details(f.base), FB.latest_per_key(f.valid))


PROFILE_REFRESH = sql("""
SELECT user_id, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM n_plong
UNION ALL
SELECT user_id, CAST(pos AS BIGINT) AS pos, round(value, 6) AS value FROM o_plong
WHERE user_id NOT IN (SELECT user_id FROM n_plong)""", extra=_refresh_blocks())


@register("profile_refresh", PROFILE_REFRESH)
def q_profile_refresh(c):
    """Recomputed profiles of the users touched by feedback (long form)."""
    f = _fb(c)
    new_store = FB.apply_latest(FB.type_details(f.base), FB.latest_per_key(f.valid))
    items = item_vectors(c.src.item_embeddings, c.live)
    return profiles_long(FB.profile_refresh(interaction_store(f.base), new_store, f.valid, items))


POPULARITY_INCREMENT = sql("""
SELECT coalesce(b.book_id, n.book_id) AS book_id, coalesce(b.cnt, 0) + coalesce(n.cnt, 0) AS cnt
FROM (SELECT book_id, count(*) AS cnt FROM binter GROUP BY book_id) b
FULL OUTER JOIN (SELECT book_id, count(*) AS cnt FROM fv GROUP BY book_id) n ON b.book_id = n.book_id""",
                           extra=_FB_BLOCKS)


@register("popularity_increment", POPULARITY_INCREMENT)
def q_popularity_increment(c):
    """Base popularity + 1 per applied feedback event."""
    f = _fb(c)
    return popularity_increment(popularity(f.base), f.valid)


@register("buffer_trigger", sql("""
SELECT event_id, CAST(ceil(rn / CAST(100 AS DOUBLE)) AS BIGINT) AS update_no,
       ceil(rn / CAST(100 AS DOUBLE)) <= floor((SELECT count(*) FROM fv) / CAST(100 AS DOUBLE)) AS applied
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM fv) t""", extra=_FB_BLOCKS))
def q_buffer_trigger(c):
    """Update number of every valid event with a buffer of 100; the last partial buffer is held."""
    return FB.buffer_trigger(_fb(c).valid, 100)


@register("buffer_status", sql("""
SELECT TRUE AS enabled, CAST(count(*) % 100 AS BIGINT) AS buffer_size, CAST(100 AS BIGINT) AS buffer_capacity,
       (count(*) % 100) >= 100 AS buffer_full FROM fv""", extra=_FB_BLOCKS))
def q_buffer_status(c):
    """Pending events, capacity and fullness after the full buffers were applied."""
    return FB.buffer_status(_fb(c).valid, 100)


def _streamed(c) -> str:
    """The table folder of the streaming job, run over the feedback events as files."""
    f = _fb(c)
    run = scratch_path(c.spark, f"feedback-{uuid.uuid4().hex[:8]}")
    src = f"{run}/source"
    # The intake folder: feedback events as files, a day or more in each, so the
    # stream sees several micro-batches.
    (c.src.feedback.select(*[F.col(x.name).cast(x.dataType) for x in FB.FEEDBACK_SCHEMA.fields])
     .repartition(F.to_date("ts")).write.parquet(src))
    FB.feedback_stream(c.spark, src, f"{run}/table", f"{run}/checkpoint", files_per_trigger=2,
                       base_details=FB.type_details(f.base), items=item_vectors(c.src.item_embeddings, c.live)).awaitTermination()
    return f"{run}/table"


@register("feedback_stream", sql("SELECT * FROM nstore", extra=_FB_BLOCKS))
def q_feedback_stream(c):
    """The streaming job over the feedback events as files; equals feedback_latest."""
    f = _fb(c)
    return FB.apply_latest(FB.type_details(f.base), FB.read_latest(c.spark, _streamed(c)))


@register("feedback_stream_profiles", PROFILE_REFRESH)
def q_feedback_stream_profiles(c):
    """Profiles that the streaming job refreshed; equals profile_refresh."""
    f = _fb(c)
    items = item_vectors(c.src.item_embeddings, c.live)
    base = user_profiles(interaction_store(f.base), items)
    return profiles_long(FB.read_profiles(c.spark, _streamed(c), base))


@register("feedback_stream_popularity", POPULARITY_INCREMENT)
def q_feedback_stream_popularity(c):
    """Popularity with the streaming job's events; equals popularity_increment."""
    return FB.read_popularity(c.spark, _streamed(c), popularity(_fb(c).base))


def _json_files(c, run: str) -> str:
    """The feedback events as files of JSON lines, a day or more in each."""
    events = c.src.feedback.select(*[F.col(x.name).cast(x.dataType) for x in FB.FEEDBACK_SCHEMA.fields])
    lines = events.select(F.to_json(F.struct(*[F.col(f.name).cast("string") if f.name == "ts" else F.col(f.name) for f in FB.FEEDBACK_SCHEMA.fields]))
                          .alias("value"), F.to_date("ts").alias("day"))
    lines.repartition("day").select("value").write.text(f"{run}/source")
    return f"{run}/source"


@register("feedback_json_intake", sql("SELECT event_id, user_id, book_id, event, strength, reject_reason FROM fs", extra=_FB_BLOCKS))
def q_feedback_json_intake(c):
    """A6 as JSON lines: each line's event with its strength or the reason for its rejection; equals feedback_strength."""
    source = _json_files(c, scratch_path(c.spark, f"intake-{uuid.uuid4().hex[:8]}"))
    return FB.feedback_strength(parse_feedback(c.spark.read.text(source))).select(
        "event_id", "user_id", "book_id", "event", "strength", "reject_reason")


def _keyed(c) -> str:
    """The table folder of the keyed job, run over JSON lines and stopped in the middle: a second run goes on from the checkpoint."""
    f = _fb(c)
    run = scratch_path(c.spark, f"keyed-{uuid.uuid4().hex[:8]}")
    args = dict(files_per_trigger=2, base_details=FB.type_details(f.base), items=item_vectors(c.src.item_embeddings, c.live), json=True)
    source, half = _json_files(c, run), f"{run}/half"
    store, path = FB._fs(c.spark, source)
    files = sorted(s.getPath().toString() for s in store.listStatus(path) if s.getPath().getName().startswith("part-"))
    for part in (files[:len(files) // 2], files[len(files) // 2:]):
        store.mkdirs(FB._fs(c.spark, half)[1])
        for file in part:
            store.rename(FB._fs(c.spark, file)[1], FB._fs(c.spark, f"{half}/{file.rsplit('/', 1)[1]}")[1])
        for query in KS.keyed_stream(c.spark, half, f"{run}/table", f"{run}/checkpoint", **args):
            query.awaitTermination()
    return f"{run}/table"


@register("feedback_keyed_stream", sql("SELECT * FROM nstore", extra=_FB_BLOCKS))
def q_feedback_keyed_stream(c):
    """J1/J2 with keyed state, over JSON lines and a restart in the middle; equals feedback_latest."""
    return FB.apply_latest(FB.type_details(_fb(c).base), FB.read_latest(c.spark, _keyed(c)))


@register("feedback_keyed_profiles", PROFILE_REFRESH)
def q_feedback_keyed_profiles(c):
    """J3 from sums kept by changes; equals profile_refresh."""
    f = _fb(c)
    items = item_vectors(c.src.item_embeddings, c.live)
    start = KS.base_sums(FB.type_details(f.base), items)
    return profiles_long(KS.read_keyed_profiles(c.spark, _keyed(c), start, user_profiles(interaction_store(f.base), items)))


@register("feedback_keyed_popularity", POPULARITY_INCREMENT)
def q_feedback_keyed_popularity(c):
    """J4 from the keyed job's events; equals popularity_increment."""
    return FB.read_popularity(c.spark, _keyed(c), popularity(_fb(c).base))
