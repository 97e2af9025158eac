"""Streams drained over the given tables (ST*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.plans.base import REGISTRY, Archive, plan
from tapeloom.plans.decisions import ALL
from tapeloom.session import work_dir
from tapeloom.streaming import increments as ST


def _fresh(a: Archive) -> str:
    return f"{work_dir(a.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@plan("ST1_hopping_stats", """SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, count(*) AS rows FROM (
 SELECT user_id, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) t WHERE start >= TIMESTAMP '2024-01-01' GROUP BY 1, 2""")
def st1(a: Archive):
    out = _fresh(a)
    events = ST.read_table_stream(a.spark, a.folder, "events")
    stats = ST.hopping_stats(events, ["user_id"], "ts", "value", "2 hours", "1 hour", F.lit("2024-01-01 00:00:00"))
    ST.run_updates(stats, f"{out}/rows", f"{out}/checkpoint")
    rows = ST.latest_updates(a.spark, f"{out}/rows", ["user_id", "start"])
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("mean", 6).alias("mean"),
                       F.round("variance", 4).alias("variance"), "rows")


@plan("ST2_new_recordings", """SELECT id AS recording_id, 'clap' AS step, CASE WHEN audio_path IS NULL OR duration_seconds IS NULL THEN 'failed' ELSE 'success' END AS status,
 CASE WHEN audio_path IS NULL THEN 'no audio_path' WHEN duration_seconds IS NULL THEN 'no duration_seconds' END AS error_message FROM recordings""")
def st2(a: Archive):
    out = _fresh(a)
    stream = a.view("recordings", orders=ST.read_table_stream(a.spark, a.folder, "orders"))
    def work(recs):
        return recs.select(F.col("id").alias("recording_id"), F.lit(None).cast("string").alias("error"))

    ST.run_new_recordings(stream, out, f"{out}/checkpoint", "clap", "1", F.lit("2024-01-01").cast("timestamp_ntz"), work)
    return ST.step_log(a.spark, out).newest().select("recording_id", "step", "status", "error_message")


@plan("ST3_decision_stream")
def st3(a: Archive):
    out = _fresh(a)
    stream = a.view("decision_log", orders=ST.read_table_stream(a.spark, a.folder, "orders")).filter(F.col("kind").isin(ALL))
    ST.run_decisions(stream, a.recordings, a.sessions, a.songs, a.candidates, out, f"{out}/checkpoint")
    tables = ST.decision_tables(a.spark, out, a.recordings, a.songs, a.candidates)
    recs = tables["recordings"].newest()
    fresh = tables["songs"].newest().filter("title LIKE 'Jam — %'").select(F.col("id").alias("song_id"), F.lit("new jam").alias("_new"))
    return recs.join(fresh, "song_id", "left").select(
        "id", F.coalesce("_new", F.col("song_id").cast("string")).alias("song"), "content_type", "content_type_source",
        F.regexp_replace("audio_path", r"_jam-[^/]*\.mp3$", "_new-jam.mp3").alias("audio_path"))


# The stream must end where the batch does: same twin.
REGISTRY["ST3_decision_stream"].sql = REGISTRY["W_mixed_decisions"].sql
