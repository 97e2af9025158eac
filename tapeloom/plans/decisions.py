"""Decisions and maintenance (W*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import workflow as W
from tapeloom.operators.summaries import outcome_summary
from tapeloom.plans.base import Archive, plan
from tapeloom.session import store


REC = ["id", "song_id", "content_type", "content_type_source"]


def _decided(a: Archive, kinds: list[str]):
    """Decisions of some kinds, resolved once for all that follows from them."""
    return store(W.resolve(a.decisions.filter(F.col("kind").isin(kinds)), a.candidates), "decisions")


def _applied(a: Archive, kinds: list[str]):
    d = _decided(a, kinds)
    jams = W.decision_jams(d, a.recordings, a.candidates)
    ses = a.recordings.select(F.col("id").alias("recording_id"), "session_id").join(
        a.sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date")), "session_id", "left")
    new = W.create_jams(jams.join(ses, "recording_id"), a.songs, "session_date", "seq")
    return d, new, W.apply_to_recordings(a.recordings, d, a.candidates, new.withColumn("slug", F.lit("new-jam")), a.songs)


# A recording's file after the last decision that named an existing song.
NAMED = "CASE WHEN {slug} IS NULL OR r.audio_path IS NULL THEN r.audio_path ELSE concat('recordings/', r.id, '_', {slug}, '.mp3') END AS audio_path"


# One decision kind at a time: what the last such decision of each recording leaves behind.
LAST = "(SELECT * FROM decisions WHERE kind = '{kind}' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq DESC) = 1)"
KNOWN = LAST.replace("'{kind}'", "'{kind}' AND candidate_id IN (SELECT id FROM candidates)")
FIRST = LAST.replace("DESC", "ASC")


@plan("W1_classify", """WITH d AS (SELECT * FROM decisions WHERE kind = 'classify'),
 l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq DESC) = 1),
 s AS (SELECT * FROM d WHERE content_type = 'song_take' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq DESC) = 1),
 j AS (SELECT DISTINCT recording_id FROM d WHERE content_type = 'jam')
 SELECT r.id, coalesce(l.content_type, r.content_type) AS content_type, CASE WHEN l.seq IS NOT NULL THEN 'human' ELSE r.content_type_source END AS content_type_source,
 CASE WHEN s.seq IS NULL AND r.song_id IS NULL AND j.recording_id IS NOT NULL THEN 'new jam' ELSE CAST(coalesce(s.song_id, r.song_id) AS STRING) END AS song
 FROM recordings r LEFT JOIN l ON l.recording_id = r.id LEFT JOIN s ON s.recording_id = r.id LEFT JOIN j ON j.recording_id = r.id""")
def w1(a: Archive):
    _, new, recs = _applied(a, ["classify"])
    fresh = new.select(F.col("id").alias("song_id"), F.lit("new jam").alias("_new"))
    return recs.join(fresh, "song_id", "left").select(
        "id", "content_type", "content_type_source", F.coalesce("_new", F.col("song_id").cast("string")).alias("song"))


@plan("W2_batch_classify", f"""SELECT r.id, coalesce(l.content_type, r.content_type) AS content_type, CASE WHEN l.seq IS NOT NULL THEN 'human' ELSE r.content_type_source END AS content_type_source
 FROM recordings r LEFT JOIN {LAST.format(kind='batch_classify')} l ON l.recording_id = r.id""")
def w2(a: Archive):
    return _applied(a, ["batch_classify"])[2].select("id", "content_type", "content_type_source")


@plan("W2_updated_count", "SELECT count(*) AS updated FROM decisions WHERE kind = 'batch_classify' AND recording_id IN (SELECT id FROM recordings)")
def w2b(a: Archive):
    return W.batch_classified(a.decisions, a.recordings)


@plan("P12_rejected_decisions", """SELECT seq, kind, CASE WHEN content_type = 'nonsense' THEN 'invalid content_type' ELSE 'song_take needs song_id' END AS reason
 FROM decision_log WHERE content_type = 'nonsense' OR (kind = 'classify' AND content_type = 'song_take' AND song_id IS NULL)""")
def p12(a: Archive):
    return W.check_decisions(a.decisions)[1].select("seq", "kind", "reason")


@plan("W3_assign_song", f"""SELECT r.id, coalesce(l.song_id, r.song_id) AS song_id, CASE WHEN l.seq IS NOT NULL THEN 'song_take' ELSE r.content_type END AS content_type,
 CASE WHEN l.seq IS NOT NULL THEN 'human' ELSE r.content_type_source END AS content_type_source, {NAMED.format(slug='p.slug')}
 FROM recordings r LEFT JOIN {LAST.format(kind='assign')} l ON l.recording_id = r.id LEFT JOIN (SELECT d.recording_id, s.slug FROM decisions d JOIN songs s ON s.id = d.song_id
 WHERE kind = 'assign' QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq DESC) = 1) p ON p.recording_id = r.id""")
def w3(a: Archive):
    return _applied(a, ["assign"])[2].select(*REC, "audio_path")


def _statuses(a: Archive, kinds: list[str]):
    out = W.apply_to_candidates(a.candidates, _decided(a, kinds))
    return out.select("id", "status", F.date_format("reviewed_at", "yyyy-MM-dd").alias("reviewed"))


@plan("W3_assign_candidates", f"""SELECT c.id, CASE WHEN c.status = 'pending' AND f.seq IS NOT NULL THEN CASE WHEN c.song_id = f.song_id THEN 'accepted' ELSE 'rejected' END ELSE c.status END AS status,
 CASE WHEN c.status = 'pending' THEN strftime(f.at, '%Y-%m-%d') END AS reviewed FROM candidates c LEFT JOIN {FIRST.format(kind='assign')} f ON f.recording_id = c.recording_id""")
def w3b(a: Archive):
    return _statuses(a, ["assign"])


@plan("W4_unassign_song", f"""SELECT r.id, CASE WHEN l.seq IS NULL THEN r.song_id END AS song_id, CASE WHEN l.seq IS NULL OR r.content_type <> 'song_take' THEN r.content_type END AS content_type,
 CASE WHEN l.seq IS NULL OR r.content_type <> 'song_take' THEN r.content_type_source END AS content_type_source FROM recordings r LEFT JOIN {LAST.format(kind='unassign')} l ON l.recording_id = r.id""")
def w4(a: Archive):
    return _applied(a, ["unassign"])[2].select(*REC)


@plan("W4_unassign_candidates", f"""SELECT c.id, CASE WHEN l.seq IS NOT NULL THEN 'pending' ELSE c.status END AS status, CAST(NULL AS STRING) AS reviewed
 FROM candidates c LEFT JOIN {LAST.format(kind='unassign')} l ON l.recording_id = c.recording_id""")
def w4b(a: Archive):
    return _statuses(a, ["unassign"])


@plan("W5_accept_recordings", f"""SELECT r.id, CASE WHEN l.seq IS NOT NULL THEN c.song_id ELSE r.song_id END AS song_id, CASE WHEN l.seq IS NOT NULL THEN 'song_take' ELSE r.content_type END AS content_type,
 CASE WHEN l.seq IS NOT NULL THEN 'human' ELSE r.content_type_source END AS content_type_source, {NAMED.format(slug='p.slug')}
 FROM recordings r LEFT JOIN {KNOWN.format(kind='accept')} l ON l.recording_id = r.id
 LEFT JOIN candidates c ON c.id = l.candidate_id LEFT JOIN (SELECT k.recording_id, s.slug FROM decisions d JOIN candidates k ON k.id = d.candidate_id JOIN songs s ON s.id = k.song_id
 WHERE kind = 'accept' QUALIFY row_number() OVER (PARTITION BY k.recording_id ORDER BY seq DESC) = 1) p ON p.recording_id = r.id""")
def w5(a: Archive):
    return _applied(a, ["accept"])[2].select(*REC, "audio_path")


@plan("W5_accept_candidates", f"""SELECT c.id, CASE WHEN l.seq IS NULL THEN c.status WHEN l.candidate_id = c.id THEN 'accepted' ELSE 'rejected' END AS status,
 strftime(l.at, '%Y-%m-%d') AS reviewed FROM candidates c LEFT JOIN {KNOWN.format(kind='accept')} l ON l.recording_id = c.recording_id""")
def w5b(a: Archive):
    return _statuses(a, ["accept"])


@plan("W6_reject_candidates", """SELECT c.id, CASE WHEN l.seq IS NULL THEN c.status ELSE 'rejected' END AS status, strftime(l.at, '%Y-%m-%d') AS reviewed FROM candidates c LEFT JOIN
 (SELECT * FROM decisions WHERE kind = 'reject' QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY seq DESC) = 1) l ON l.candidate_id = c.id""")
def w6(a: Archive):
    return _statuses(a, ["reject"])


@plan("W6_remaining_candidates", """WITH after AS (SELECT c.id, c.recording_id, c.song_id, c.confidence, c.rank,
 CASE WHEN c.id IN (SELECT candidate_id FROM decisions WHERE kind = 'reject') THEN 'rejected' ELSE c.status END AS status FROM candidates c)
 SELECT x.id, x.recording_id, x.song_id, s.title AS song_title, x.confidence, x.rank, x.status FROM after x LEFT JOIN songs s ON s.id = x.song_id WHERE x.status <> 'rejected'
 AND x.recording_id IN (SELECT recording_id FROM candidates WHERE id IN (SELECT candidate_id FROM decisions WHERE kind = 'reject'))""")
def w6_remaining(a: Archive):
    d = _decided(a, ["reject"])
    out = W.remaining_candidates(W.apply_to_candidates(a.candidates, d), d, a.songs)
    return out.select("id", "recording_id", "song_id", "song_title", "confidence", "rank", "status")


@plan("W7_revert", f"""SELECT r.id, CASE WHEN l.seq IS NULL THEN r.song_id END AS song_id, CASE WHEN l.seq IS NULL THEN r.content_type END AS content_type,
 CASE WHEN l.seq IS NULL THEN r.content_type_source END AS content_type_source FROM recordings r LEFT JOIN {LAST.format(kind='revert')} l ON l.recording_id = r.id""")
def w7(a: Archive):
    return _applied(a, ["revert"])[2].select(*REC)


@plan("W7_revert_candidates", f"""SELECT c.id, CASE WHEN l.seq IS NOT NULL THEN 'pending' ELSE c.status END AS status, strftime(l.at, '%Y-%m-%d') AS reviewed
 FROM candidates c LEFT JOIN {LAST.format(kind='revert')} l ON l.recording_id = c.recording_id""")
def w7b(a: Archive):
    return _statuses(a, ["revert"])


ALL = ["classify", "batch_classify", "assign", "unassign", "accept", "reject", "revert"]


# All kinds at once: the state walked through every decision in order, one step per row.
@plan("W_mixed_decisions", """WITH d AS (SELECT d.*, c.song_id AS csong, s.slug, row_number() OVER (PARTITION BY d.recording_id ORDER BY seq) AS k FROM decisions d LEFT JOIN candidates c ON c.id = d.candidate_id
 LEFT JOIN songs s ON s.id = CASE WHEN d.kind = 'accept' THEN c.song_id ELSE d.song_id END WHERE d.kind IN ('classify', 'batch_classify', 'assign', 'unassign', 'revert') OR d.kind = 'accept' AND c.id IS NOT NULL),
 walk AS (SELECT r.id, CAST(0 AS BIGINT) AS k, CAST(r.song_id AS STRING) AS song, r.content_type, r.content_type_source, r.audio_path FROM recordings r
 UNION ALL SELECT w.id, d.k, CASE WHEN kind IN ('unassign', 'revert') THEN NULL WHEN kind = 'assign' THEN CAST(d.song_id AS STRING) WHEN kind = 'accept' THEN CAST(d.csong AS STRING)
  WHEN kind = 'classify' AND d.content_type = 'song_take' THEN CAST(d.song_id AS STRING) WHEN kind = 'classify' AND d.content_type = 'jam' THEN coalesce(w.song, 'new jam') ELSE w.song END,
  CASE WHEN kind IN ('assign', 'accept') THEN 'song_take' WHEN kind = 'revert' THEN NULL WHEN kind = 'unassign' THEN nullif(w.content_type, 'song_take') ELSE d.content_type END,
  CASE WHEN kind = 'revert' THEN NULL WHEN kind = 'unassign' THEN CASE WHEN w.content_type = 'song_take' THEN NULL ELSE w.content_type_source END ELSE 'human' END,
  CASE WHEN w.audio_path IS NULL THEN NULL WHEN kind = 'classify' AND d.content_type = 'jam' AND w.song IS NULL THEN concat('recordings/', w.id, '_new-jam.mp3')
   WHEN d.slug IS NOT NULL AND (kind IN ('assign', 'accept') OR kind = 'classify' AND d.content_type = 'song_take') THEN concat('recordings/', w.id, '_', d.slug, '.mp3') ELSE w.audio_path END
  FROM walk w JOIN d ON d.recording_id = w.id AND d.k = w.k + 1)
 SELECT id, song, content_type, content_type_source, audio_path FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def w_mixed(a: Archive):
    _, new, recs = _applied(a, ALL)
    fresh = new.select(F.col("id").alias("song_id"), F.lit("new jam").alias("_new"))
    return recs.join(fresh, "song_id", "left").select(
        "id", F.coalesce("_new", F.col("song_id").cast("string")).alias("song"), "content_type", "content_type_source", "audio_path")


@plan("W_mixed_candidates", """WITH d AS (SELECT d.*, row_number() OVER (PARTITION BY d.recording_id ORDER BY seq) AS k FROM decisions d
 WHERE d.kind IN ('assign', 'unassign', 'revert') OR d.kind IN ('accept', 'reject') AND d.candidate_id IN (SELECT id FROM candidates)),
 walk AS (SELECT c.id, c.recording_id, c.song_id, CAST(0 AS BIGINT) AS k, c.status, CAST(NULL AS TIMESTAMP) AS stamp FROM candidates c
 UNION ALL SELECT w.id, w.recording_id, w.song_id, d.k, CASE kind WHEN 'assign' THEN CASE WHEN w.status <> 'pending' THEN w.status WHEN w.song_id = d.song_id THEN 'accepted' ELSE 'rejected' END
  WHEN 'accept' THEN CASE WHEN d.candidate_id = w.id THEN 'accepted' ELSE 'rejected' END WHEN 'reject' THEN CASE WHEN d.candidate_id = w.id THEN 'rejected' ELSE w.status END ELSE 'pending' END,
  CASE kind WHEN 'assign' THEN CASE WHEN w.status = 'pending' THEN d.at ELSE w.stamp END WHEN 'reject' THEN CASE WHEN d.candidate_id = w.id THEN d.at ELSE w.stamp END
  WHEN 'unassign' THEN NULL ELSE d.at END FROM walk w JOIN d ON d.recording_id = w.recording_id AND d.k = w.k + 1)
 SELECT id, status, strftime(stamp, '%Y-%m-%d') AS reviewed FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1""")
def w_mixed_candidates(a: Archive):
    return _statuses(a, ALL)


SPLIT_SQL = """plan AS (SELECT d.recording_id, (SELECT s.start_seconds FROM segments s WHERE s.recording_id = d.recording_id ORDER BY abs(s.start_seconds - d.split_at), s.start_seconds LIMIT 1) AS cut,
 r.audio_path, coalesce(r.duration_seconds, 0) AS dur, r.start_offset_seconds, r.end_offset_seconds FROM (SELECT * FROM decisions WHERE kind = 'split'
 QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY seq) = 1) d JOIN recordings r ON r.id = d.recording_id),
 judged AS (SELECT *, CASE WHEN audio_path IS NULL THEN 'no audio' WHEN cut IS NULL THEN 'no segments' WHEN cut <= 1 OR cut >= dur - 1 THEN 'too close to an end' END AS error FROM plan),
 good AS (SELECT *, unnest([0, 1]) AS part FROM judged WHERE error IS NULL)"""


@plan("W8_split_plan", f"WITH {SPLIT_SQL} SELECT recording_id, cut, error FROM judged")
def w8(a: Archive):
    return W.split_plan(a.recordings, a.segments, a.decisions).drop("at")


def _split(a: Archive):
    plan_ = W.split_plan(a.recordings, a.segments, a.decisions)
    series = a.table("embeddings").select(F.col("vec_id").alias("recording_id"), F.lit("rms").alias("feature_name"), F.col("embedding").alias("values"))
    return W.split_recordings(a.recordings, a.segments, series, a.processing_log, a.candidates, plan_)


@plan("W8_split_recordings", f"""WITH {SPLIT_SQL} SELECT CAST(CASE part WHEN 0 THEN coalesce(start_offset_seconds, 0) ELSE coalesce(start_offset_seconds, 0) + cut END AS DOUBLE) AS start_offset_seconds,
 CASE part WHEN 0 THEN coalesce(start_offset_seconds, 0) + cut ELSE coalesce(nullif(end_offset_seconds, 0), coalesce(start_offset_seconds, 0) + dur) END AS end_offset_seconds,
 CASE part WHEN 0 THEN cut ELSE dur - cut END AS duration_seconds FROM good
 UNION ALL SELECT start_offset_seconds, end_offset_seconds, duration_seconds FROM recordings WHERE id NOT IN (SELECT recording_id FROM good)""")
def w8b(a: Archive):
    return _split(a)["recordings"].select("start_offset_seconds", "end_offset_seconds", "duration_seconds")


@plan("W8_split_segments", f"""WITH {SPLIT_SQL} SELECT s.id, s.start_seconds - CASE WHEN part = 1 THEN cut ELSE 0 END AS start_seconds, s.end_seconds - CASE WHEN part = 1 THEN cut ELSE 0 END AS end_seconds
 FROM segments s JOIN good g ON g.recording_id = s.recording_id AND (s.start_seconds < cut) = (part = 0)
 UNION ALL SELECT id, start_seconds, end_seconds FROM segments WHERE recording_id NOT IN (SELECT recording_id FROM good)""")
def w8c(a: Archive):
    return _split(a)["segments"].select("id", "start_seconds", "end_seconds")


@plan("W8_split_series", f"""WITH {SPLIT_SQL} SELECT round(list_sum(v), 6) AS total, len(v) AS n FROM (SELECT CASE part WHEN 0 THEN CAST(e.embedding[1:CAST(floor(cut) AS BIGINT)] AS DOUBLE[])
 ELSE CAST(e.embedding[CAST(floor(cut) AS BIGINT) + 1:] AS DOUBLE[]) END AS v FROM embeddings e JOIN good g ON g.recording_id = e.vec_id
 UNION ALL SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id NOT IN (SELECT recording_id FROM good)) t""")
def w8d(a: Archive):
    total = F.when(F.size("values") > 0, F.round(F.aggregate("values", F.lit(0.0), lambda x, y: x + y.cast("double")), 6))
    return _split(a)["series"].select(total.alias("total"), F.size("values").cast("long").alias("n"))


@plan("W8_split_log", f"""WITH {SPLIT_SQL} SELECT step, version, status, count(*) AS n FROM (SELECT step, version, status FROM processing_log WHERE recording_id NOT IN (SELECT recording_id FROM good)
 UNION ALL SELECT unnest(['ingest', 'librosa', 'clap']), '1', 'success' FROM good) t GROUP BY 1, 2, 3""")
def w8e(a: Archive):
    return _split(a)["processing_log"].groupBy("step", "version", "status").agg(F.count(F.lit(1)).alias("n"))


# New slugs in order: the n-th new row of a base gets the n-th number that is not taken.
SLUG_SQL = """(SELECT o_orderkey AS seq, concat('Song ', o_custkey % 40) AS title, concat('song-', o_custkey % 40) AS base FROM orders)"""
TAKEN_SQL = "(SELECT concat('song-', p_partkey % 40, CASE WHEN p_partkey < 80 THEN '' ELSE concat('-', 2 * (p_partkey // 40)) END) AS slug FROM part)"


@plan("W11_unique_slugs", f"""WITH want AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) AS j FROM {SLUG_SQL} w),
 num AS (SELECT base, unnest(range(0, m + (SELECT count(*) // 40 + 2 FROM part))) AS k FROM (SELECT base, max(j) AS m FROM want GROUP BY 1) b),
 free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS j FROM num WHERE CASE WHEN k = 0 THEN base ELSE concat(base, '-', k) END NOT IN (SELECT slug FROM {TAKEN_SQL} t))
 SELECT w.seq, w.title, CASE WHEN k = 0 THEN w.base ELSE concat(w.base, '-', k) END AS slug FROM want w JOIN free USING (base, j)""")
def w11(a: Archive):
    want = a.table("orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Song "), (F.col("o_custkey") % 40).cast("string")).alias("title"))
    taken = a.table("part").selectExpr("p_partkey AS id", "concat('song-', CAST(p_partkey % 40 AS STRING), CASE WHEN p_partkey < 80 THEN '' ELSE "
                            "concat('-', CAST(2 * (p_partkey div 40) AS STRING)) END) AS slug")
    return W.unique_slugs(want.withColumn("base", W.slugify(F.col("title"))), "base", "seq", taken).select("seq", "title", "slug")


@plan("W9_create_songs", """WITH want AS (SELECT o_orderkey AS seq, o_custkey % 40 AS k, row_number() OVER (ORDER BY substring(sha256(CAST(o_orderkey AS STRING)), 1, 3), o_orderkey) AS i,
 row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS j FROM orders)
 SELECT (SELECT max(id) FROM songs) + i AS id, concat('Song ', k) AS title, concat('song-', k, CASE WHEN j > 0 THEN concat('-', j) ELSE '' END) AS slug,
 'original' AS song_type FROM want""")
def w9(a: Archive):
    want = a.table("orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("Song "), (F.col("o_custkey") % 40).cast("string")).alias("title"), F.lit("original").alias("song_type"))
    return W.create_songs(want, a.songs)


@plan("W10_unnamed_jams", """WITH u AS (SELECT r.id, s.date, row_number() OVER (PARTITION BY s.date ORDER BY r.id) AS j FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id
 WHERE content_type = 'jam' AND song_id IS NULL)
 SELECT id AS recording_id, concat('Jam — ', coalesce(date, 'unknown'), CASE WHEN had + j > 1 THEN concat(' #', had + j) ELSE '' END) AS title FROM (SELECT u.*,
 (SELECT count(*) FROM sessions s WHERE id % 3 = 0 AND starts_with(lower(concat('JAM — ', s.date, ' late')), lower(concat('Jam — ', coalesce(u.date, 'unknown'))))) AS had FROM u) t""")
def w10(a: Archive):
    songs = a.sessions.filter("id % 3 = 0").select(
        "id", F.concat(F.lit("JAM — "), "date", F.lit(" late")).alias("title"), F.concat(F.lit("old-"), F.col("id").cast("string")).alias("slug"),
        F.lit("jam").alias("song_type"))
    rows = W.create_jams(W.unnamed_jams(a.recordings, a.sessions), songs, "session_date", "recording_id")
    return rows.select("recording_id", "title")


LINK_SQL = """(SELECT id, title, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS slug FROM recordings WHERE song_id IS NULL AND origin = 'pretrimmed' AND title IS NOT NULL
 UNION ALL SELECT id, title, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') FROM recordings WHERE id % 4 = 0 AND song_id IS NOT NULL AND origin = 'pretrimmed' AND title IS NOT NULL)"""


@plan("W12_link_titles", f"""SELECT l.id AS recording_id, l.slug, CASE WHEN l.slug IN (SELECT concat('tema-', id) FROM songs) THEN 'known' ELSE 'created' END AS outcome FROM {LINK_SQL} l""")
def w12(a: Archive):
    recs = a.recordings.withColumn("song_id", F.when(F.col("id") % 4 != 0, F.col("song_id")))
    songs = a.songs.select("id", "title", F.concat(F.lit("tema-"), F.col("id").cast("string")).alias("slug"), "song_type")
    created, links = W.link_titles(recs, songs)
    pool = songs.select(F.col("id").alias("song_id"), "slug", F.lit("known").alias("outcome")).unionByName(
        created.select(F.col("id").alias("song_id"), "slug", F.lit("created").alias("outcome")))
    return links.join(pool, "song_id").select("recording_id", "slug", "outcome")


BACKFILL_SQL = """(SELECT r.id, r.content_type AS was, g.song_type, CASE WHEN r.content_type IS NOT NULL THEN 'already_set' WHEN g.song_type IS NULL THEN 'no_song' ELSE 'updated' END AS outcome,
 coalesce(r.content_type, CASE WHEN g.song_type IN ('original', 'cover') THEN 'song_take' WHEN g.song_type = 'jam' THEN 'jam' END) AS content_type,
 CASE WHEN r.content_type IS NULL AND g.song_type IS NOT NULL THEN 'ingest' ELSE r.content_type_source END AS content_type_source
 FROM recordings r LEFT JOIN songs g ON g.id = r.song_id WHERE r.origin = 'pretrimmed')"""


@plan("W13_backfill_types", f"SELECT id, content_type, content_type_source, outcome FROM {BACKFILL_SQL} b")
def w13(a: Archive):
    return W.backfill_content_type(a.recordings, a.songs).select("id", "content_type", "content_type_source", "outcome")


@plan("G16_backfill_summary", f"SELECT outcome, count(*) AS n FROM {BACKFILL_SQL} b GROUP BY 1")
def g16(a: Archive):
    return outcome_summary(W.backfill_content_type(a.recordings, a.songs))


@plan("W14_backfill_durations", """SELECT r.id, coalesce(r.duration_seconds, CASE WHEN r.id % 2 = 0 THEN CAST(r.id % 977 AS DOUBLE) + 0.125 END) AS duration_seconds,
 CASE WHEN r.duration_seconds IS NOT NULL THEN 'kept' WHEN r.id % 2 = 0 AND r.audio_path IS NOT NULL THEN 'updated' ELSE 'skipped' END AS outcome
 FROM recordings r WHERE r.audio_path IS NOT NULL OR r.duration_seconds IS NOT NULL OR r.id % 2 = 1 UNION ALL
 SELECT r.id, NULL, 'skipped' FROM recordings r WHERE r.audio_path IS NULL AND r.duration_seconds IS NULL AND r.id % 2 = 0""")
def w14(a: Archive):
    probes = a.recordings.filter("audio_path is not null and id % 2 = 0").select("audio_path", ((F.col("id") % 977).cast("double") + 0.125).alias("seconds"))
    return W.backfill_duration(a.recordings, probes).select("id", "duration_seconds", "outcome")


AUTO_SQL = """(SELECT id, CASE WHEN conf > 0.7 THEN 'skipped_high_conf' WHEN d < 10 THEN 'count_in' WHEN rms < 0.005 THEN 'silence' WHEN d < 120 AND rms < 0.03 AND var < 0.001 THEN 'tuning'
 WHEN d > 180 AND rms > 0.04 AND conf < 0.3 THEN 'jam' ELSE 'left_null' END AS outcome FROM (SELECT r.id, coalesce(duration_seconds, 0) AS d, coalesce(c.conf, 0) AS conf, m.rms, m.var
 FROM recordings r LEFT JOIN (SELECT recording_id, max(confidence) AS conf FROM candidates WHERE status <> 'rejected' GROUP BY 1) c ON c.recording_id = r.id
 LEFT JOIN (SELECT recording_id, avg(mean_rms) AS rms, var_pop(mean_rms) AS var FROM segments GROUP BY 1) m ON m.recording_id = r.id
 WHERE song_id IS NULL AND (content_type IS NULL OR content_type_source = 'auto')) t)"""


@plan("W15_auto_classify", f"SELECT id, outcome FROM {AUTO_SQL} a")
def w15(a: Archive):
    return W.auto_classify(a.recordings, a.candidates, a.segments).select("id", "outcome")


@plan("G16_classify_summary", f"SELECT outcome, count(*) AS n FROM {AUTO_SQL} a GROUP BY 1")
def g16b(a: Archive):
    return outcome_summary(W.auto_classify(a.recordings, a.candidates, a.segments))


@plan("W16_write_series", """SELECT vec_id AS recording_id, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS factor, round(list_sum(CAST(embedding AS DOUBLE[])) * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 5) AS total FROM embeddings""")
def w16(a: Archive):
    stored = a.table("embeddings").select(F.col("vec_id").alias("recording_id"), F.lit("rms").alias("feature_name"), F.lit(1).alias("factor"), F.col("embedding").alias("values"))
    fresh = stored.filter("recording_id % 3 = 0").withColumn("factor", F.lit(2)).withColumn("values", F.transform("values", lambda x: x * 2))
    total = F.aggregate("values", F.lit(0.0), lambda x, y: x + y.cast("double"))
    return W.write_series(stored, fresh).select("recording_id", "factor", F.round(total, 5).alias("total"))


@plan("W16_write_segment_stats", """SELECT id, CASE WHEN id % 4 = 0 THEN 0.5 ELSE mean_rms END AS mean_rms, mean_spectral_centroid FROM segments""".replace("0.5", "CAST(0.5 AS DOUBLE)"))
def w16b(a: Archive):
    stats = a.segments.filter("id % 4 = 0").select(F.col("id").alias("segment_id"), F.lit(0.5).alias("mean_rms"))
    return W.write_segment_stats(a.segments, stats, ["mean_rms"]).select("id", "mean_rms", "mean_spectral_centroid")


SCOPE_SQL = """(SELECT id, CASE WHEN audio_path IS NULL THEN 'no audio_path' WHEN duration_seconds IS NULL THEN 'no duration_seconds' END AS error FROM recordings
 WHERE (starts_with(source, 'Temas/') OR starts_with(source, 'Jams/')) AND id NOT IN (SELECT recording_id FROM processing_log WHERE step = 'ingest' AND version = '1' AND status = 'success'))"""


def _tiers(a: Archive):
    tiers = a.spark.createDataFrame([(1, "Temas"), (2, "Jams/"), (3, "Old")], "tier int, prefix string")
    return W.tier_paths(tiers, [1, 2])


@plan("W19_dry_run", f"SELECT id, error FROM {SCOPE_SQL} s")
def w19(a: Archive):
    return W.step_scope(a.recordings, a.processing_log, "ingest", "1", _tiers(a)).select("id", "error")


@plan("W18_run_step", f"""SELECT id AS recording_id, 'ingest' AS step, '1' AS version, CASE WHEN error IS NOT NULL OR id % 10 = 3 THEN 'failed' ELSE 'success' END AS status,
 CASE WHEN error IS NOT NULL THEN error WHEN id % 10 = 3 THEN 'cannot read' END AS error_message FROM {SCOPE_SQL} s""")
def w18(a: Archive):
    def work(recs):
        return recs.select(F.col("id").alias("recording_id"), F.when(F.col("id") % 10 == 3, "cannot read").alias("error"))

    _, log = W.run_step(a.recordings, a.processing_log, "ingest", "1", F.lit("2024-01-01").cast("timestamp_ntz"), work, _tiers(a))
    return log.drop("completed_at")


@plan("W17_log_entries", """SELECT recording_id, 'clap' AS step, '2' AS version, '2024-01-01' AS day, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'skipped' THEN 'skipped' ELSE 'success' END AS status,
 CASE WHEN status = 'failed' THEN 'boom' END AS error_message FROM processing_log""")
def w17(a: Archive):
    results = a.processing_log.select(
        "recording_id", F.when(F.col("status") == "failed", "boom").alias("error"), (F.col("status") == "skipped").alias("skipped"))
    return W.log_entries(results, "clap", "2", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn(
        "day", F.date_format("completed_at", "yyyy-MM-dd")).drop("completed_at")


@plan("W19_changed_rows", f"SELECT id, 'changed' AS change FROM {BACKFILL_SQL} b WHERE outcome = 'updated'")
def w19b(a: Archive):
    after = W.backfill_content_type(a.recordings, a.songs).select(*REC)
    return W.changed_rows(a.recordings.filter("origin = 'pretrimmed'").select(*REC), after, "id")
