"""Series, windows and feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.vectors import pack_f32, unpack_f32
from tapeloom.operators import series as A
from tapeloom.operators.similarity import apply_model
from tapeloom.plans.base import Archive, plan

HOUR = 3600.0
LENGTHS_SQL = "(SELECT recording_id, CAST(floor(max(t) / 3600) AS BIGINT) - 2 AS n FROM frames GROUP BY 1 HAVING floor(max(t) / 3600) > 2)"
GRID_SQL = f"(SELECT recording_id, n, unnest(range(0, n)) AS second FROM {LENGTHS_SQL} l)"
BIN_SQL = "greatest(least(CAST(floor(t / 3600) AS BIGINT), n - 1), 0)"


def _lengths(a: Archive):
    """Bin count per recording; two bins short, so the last frames are clipped into the last bin."""
    n = F.floor(F.max("t") / HOUR).cast("long") - 2
    return a.frames.groupBy("recording_id").agg(n.alias("n")).filter("n > 0")


@plan("A1_bin_frames", f"""SELECT g.recording_id, g.second, round(coalesce(avg(f.value), 0), 9) AS value FROM {GRID_SQL} g
 LEFT JOIN (SELECT fr.recording_id, {BIN_SQL} AS b, value FROM frames fr JOIN {LENGTHS_SQL} l USING (recording_id)) f
 ON f.recording_id = g.recording_id AND f.b = g.second GROUP BY 1, 2""")
def a1(a: Archive):
    return A.bin_frames(a.frames, "recording_id", "t", "value", _lengths(a), HOUR).withColumn("value", F.round("value", 9))


@plan("A2_bin_vectors", f"""SELECT g.recording_id, g.second, round(coalesce(avg(f.value), 0), 9) AS d0, round(coalesce(avg(f.value * 2 - 1), 0), 9) AS d1,
 round(coalesce(avg(f.frame_id % 12), 0), 9) AS d2 FROM {GRID_SQL} g
 LEFT JOIN (SELECT fr.recording_id, {BIN_SQL} AS b, value, frame_id FROM frames fr JOIN {LENGTHS_SQL} l USING (recording_id)) f
 ON f.recording_id = g.recording_id AND f.b = g.second GROUP BY 1, 2""")
def a2(a: Archive):
    rows = a.frames.withColumn("v", F.array(F.col("value"), F.col("value") * 2 - 1, (F.col("frame_id") % 12).cast("double")))
    out = A.bin_vectors(rows, "recording_id", "t", "v", 3, _lengths(a), HOUR)
    return out.select("recording_id", "second", *[F.round(F.get("vector", i), 9).alias(f"d{i}") for i in range(3)])


WINDOWS_SQL = """SELECT id AS recording_id, round(k * CAST(10 AS DOUBLE), 3) AS start_seconds,
 CAST(round(CAST(CAST(least(k * CAST(10 AS DOUBLE) + 20, duration_seconds) AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) AS end_seconds
 FROM (SELECT id, duration_seconds, unnest(range(0, CAST(ceil(duration_seconds / 10) AS BIGINT))) AS k FROM recordings WHERE duration_seconds > 0
 AND id NOT IN (SELECT recording_id FROM segments)) t"""


@plan("A3_make_segments", WINDOWS_SQL)
def a3(a: Archive):
    return A.make_segments(a.recordings, a.segments)


@plan("A3_missing_duration", "SELECT id AS recording_id, 'no duration_seconds' AS error FROM recordings WHERE duration_seconds IS NULL")
def a3b(a: Archive):
    return A.missing_duration(a.recordings)


SECONDS_SQL = "(SELECT recording_id, CAST(floor(t / 3600) AS BIGINT) AS second, value, frame_id FROM frames)"


def _seconds(a: Archive):
    return a.frames.withColumn("second", F.floor(F.col("t") / HOUR).cast("long"))


@plan("A4_segment_stats", f"""SELECT s.id AS segment_id, s.recording_id, round(avg(f.value), 9) AS mean, round(var_pop(f.value), 6) AS variance
 FROM segments s JOIN {SECONDS_SQL} f ON f.recording_id = s.recording_id AND f.second >= floor(s.start_seconds) AND f.second < ceil(s.end_seconds) GROUP BY 1, 2""")
def a4(a: Archive):
    return A.segment_stats(_seconds(a), a.segments).withColumn("mean", F.round("mean", 9)).withColumn("variance", F.round("variance", 6))


@plan("A4_segment_vector_stats", f"""SELECT s.id AS segment_id, round(avg(f.value), 9) AS m0, round(var_pop(f.value), 6) AS v0, round(avg(f.frame_id % 12), 9) AS m1,
 round(var_pop(f.frame_id % 12), 6) AS v1
 FROM segments s JOIN {SECONDS_SQL} f ON f.recording_id = s.recording_id AND f.second >= floor(s.start_seconds) AND f.second < ceil(s.end_seconds) GROUP BY 1""")
def a4b(a: Archive):
    rows = _seconds(a).withColumn("v", F.array(F.col("value"), (F.col("frame_id") % 12).cast("double")))
    out = A.segment_vector_stats(rows, a.segments, "v", 2)
    return out.select("segment_id", *[
        c for i in range(2) for c in (F.round(F.get("mean", i), 9).alias(f"m{i}"), F.round(F.get("variance", i), 6).alias(f"v{i}"))])


GAIN_SQL = """SELECT d.recording_id, CASE WHEN p > 1e-8 THEN 0.95 / p ELSE 1.0 END AS gain FROM (SELECT DISTINCT recording_id FROM frames) d
 LEFT JOIN (SELECT recording_id, quantile_cont(abs(value), 0.995) AS p FROM frames WHERE frame_id % 10 = 0 GROUP BY 1) q USING (recording_id)"""


@plan("A5_norm_gain", f"SELECT recording_id, round(CAST(gain AS DOUBLE), 9) AS gain FROM ({GAIN_SQL}) g")
def a5(a: Archive):
    return A.norm_gain(a.frames, "recording_id", "frame_id", "value").withColumn("gain", F.round("gain", 9))


@plan("A5_apply_gain", f"""SELECT f.frame_id, round(greatest(least(value * CAST(gain AS DOUBLE), 1), -1), 9) AS y FROM frames f JOIN ({GAIN_SQL}) g USING (recording_id)""")
def a5b(a: Archive):
    gains = A.norm_gain(a.frames, "recording_id", "frame_id", "value")
    return A.apply_gain(a.frames, gains, "recording_id", "value", "y").select("frame_id", F.round("y", 9).alias("y"))


@plan("A6_peak_and_db", """SELECT frame_id, round(value / greatest(0.001, max(abs(value)) OVER w) * 0.999, 12) AS y,
 round(20 * log10(value + 1e-9) - 20 * log10(max(value + 1e-9) OVER w), 6) AS db FROM frames WINDOW w AS (PARTITION BY recording_id)""")
def a6(a: Archive):
    peaks = A.peak_normalise(a.frames, "recording_id", "value", "y")
    both = A.to_db(peaks, "recording_id", "value", "db")
    return both.select("frame_id", F.round("y", 12).alias("y"), F.round("db", 6).alias("db"))


@plan("A7_downsample_mean", """SELECT recording_id, CAST(floor(t / 7) AS BIGINT) AS t, round(avg(level), 9) AS level FROM levels GROUP BY 1, 2 HAVING count(*) = 7""")
def a7(a: Archive):
    return A.downsample_mean(a.levels, "recording_id", "t", "level", 7).withColumn("level", F.round("level", 9))


@plan("A8_pad_or_truncate", """SELECT vec_id, len(v) AS n, round(list_sum(v), 6) AS total FROM (SELECT vec_id,
 list_concat(CAST(embedding[1:40 + vec_id % 40] AS DOUBLE[]), CAST(list_transform(range(70), lambda x: -100) AS DOUBLE[]))[1:70] AS v FROM embeddings) t""")
def a8(a: Archive):
    part = F.slice("embedding", F.lit(1), (F.lit(40) + F.col("vec_id") % 40).cast("int"))
    v = A.pad_or_truncate(F.transform(part, lambda x: x.cast("double")), 70, -100.0)
    rows = a.table("embeddings").withColumn("v", v)
    return rows.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda x, y: x + y), 6).alias("total"))


@plan("A9_series_cut", """SELECT vec_id, round(coalesce(list_sum(CAST(embedding[1:vec_id % 80] AS DOUBLE[])), 0), 6) AS head,
 round(coalesce(list_sum(CAST(embedding[vec_id % 80 + 1:] AS DOUBLE[])), 0), 6) AS tail FROM embeddings""")
def a9(a: Archive):
    head, tail = A.series_cut(F.col("embedding"), F.col("vec_id") % 80 + 0.5)
    def total(c):
        return F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y.cast("double")), 6)

    return a.table("embeddings").select("vec_id", total(head).alias("head"), total(tail).alias("tail"))


SILENCE_SQL = """SELECT recording_id, min(t) AS start, max(t) + 1 AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY t)
 - row_number() OVER (PARTITION BY recording_id, level < -40 ORDER BY t) AS island FROM levels) x WHERE level < -40 GROUP BY recording_id, island HAVING max(t) + 1 - min(t) >= 3"""


def _silences(a: Archive):
    return A.silence_intervals(a.levels, "recording_id", "t", "level", 1.0, -40.0, 3.0)


@plan("A10_silence_intervals", SILENCE_SQL)
def a10(a: Archive):
    return _silences(a)


@plan("A11_active_segments", f"""WITH si AS ({SILENCE_SQL}), to_ AS (SELECT recording_id, max(t) + 1 AS total FROM levels GROUP BY 1),
 b AS (SELECT recording_id, CAST(0 AS DOUBLE) AS x FROM to_ UNION SELECT recording_id, total FROM to_ UNION SELECT recording_id, start FROM si UNION SELECT recording_id, "end" FROM si),
 iv AS (SELECT recording_id, x AS s, lead(x) OVER (PARTITION BY recording_id ORDER BY x) AS e FROM b)
 SELECT recording_id, round(s, 3) AS start, round(e, 3) AS "end" FROM iv WHERE e - s >= 5 AND NOT EXISTS
 (SELECT 1 FROM si WHERE si.recording_id = iv.recording_id AND abs(si.start - iv.s) < 0.01)""")
def a11(a: Archive):
    totals = a.levels.groupBy("recording_id").agg((F.max("t") + 1.0).alias("total"))
    return A.active_segments(_silences(a), totals, "recording_id", 5.0)


@plan("S10_float_bytes", "SELECT vec_id, len(embedding) * 4 AS n_bytes, true AS same FROM embeddings")
def s10(a: Archive):
    rows = a.table("embeddings").withColumn("blob", pack_f32("embedding"))
    return rows.select("vec_id", F.length("blob").cast("long").alias("n_bytes"), (unpack_f32("blob") == F.col("embedding")).alias("same"))


def _load_toy():
    """Stand-in for a model: two numbers per text, and a failure on texts without a space."""
    def model(texts):
        if any(" " not in t for t in texts):
            raise ValueError("no words")
        return [[float(len(t)), float(t.count(" "))] for t in texts]

    return model


@plan("V13_apply_model", """SELECT doc_id, CASE WHEN contains(text, ' ') THEN CAST(length(text) AS DOUBLE) END AS n_chars,
 CASE WHEN contains(text, ' ') THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS n_spaces,
 CASE WHEN NOT contains(text, ' ') THEN 'no words' END AS error FROM documents""")
def v13(a: Archive):
    out = apply_model(a.table("documents"), _load_toy, "text", "doc_id")
    return out.select("doc_id", F.get("embedding", 0).cast("double").alias("n_chars"), F.get("embedding", 1).cast("double").alias("n_spaces"), "error")
