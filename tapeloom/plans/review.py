"""Lookups, review workflow and summaries over the archive (J*, G*, T*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.labels import settled
from tapeloom.operators import lookups as J
from tapeloom.operators import summaries as S
from tapeloom.plans.base import Archive, half_up, plan
from tapeloom.sources.store import top_n


def _candidate_text(c: str):
    return F.coalesce(F.array_join(F.transform(c, lambda s: F.concat_ws(
        ":", s["rank"].cast("string"), s.candidate_id.cast("string"), s.song_id.cast("string"), s.status, s.song_title,
        s.nearest_recording_id.cast("string"), F.coalesce(s.nearest_audio_path, F.lit("")), F.coalesce(s.nearest_session_date, F.lit("")))), ","), F.lit(""))


REVIEW_SQL = """SELECT r.id, r.title, r.origin, r.duration_seconds, s.date AS session_date, r.song_id, g.title AS song_title,
 r.audio_path, r.content_type, r.content_type_source, coalesce(c.candidates, '') AS candidates,
 CAST(round(CAST(round(m.mean_rms, 12) AS DECIMAL(38, 12)), 9) AS DOUBLE) AS mean_rms, round(m.centroid, 6) AS mean_spectral_centroid
 FROM {rows} r LEFT JOIN sessions s ON s.id = r.session_id LEFT JOIN songs g ON g.id = r.song_id
 LEFT JOIN (SELECT recording_id, string_agg(concat(rank, ':', k.id, ':', k.song_id, ':', status, ':', g.title, ':', nearest_recording_id, ':',
   coalesce(n.audio_path, ''), ':', coalesce(s.date, '')), ',' ORDER BY rank, k.id) AS candidates
   FROM candidates k JOIN songs g ON g.id = k.song_id LEFT JOIN recordings n ON n.id = nearest_recording_id
   LEFT JOIN sessions s ON s.id = n.session_id WHERE status <> 'rejected' GROUP BY 1) c ON c.recording_id = r.id
 LEFT JOIN (SELECT recording_id, avg(mean_rms) AS mean_rms, avg(mean_spectral_centroid) AS centroid FROM segments GROUP BY 1) m
   ON m.recording_id = r.id"""


def _shown(df):
    return df.withColumn("candidates", _candidate_text("candidates")).withColumn("mean_rms", settled(F.col("mean_rms"), 9)).withColumn(
        "mean_spectral_centroid", F.round("mean_spectral_centroid", 6))


@plan("T1_review_queue", REVIEW_SQL.format(rows="""(SELECT r.* FROM recordings r LEFT JOIN (SELECT recording_id, confidence
 FROM candidates WHERE rank = 1) b ON b.recording_id = r.id WHERE song_id IS NULL AND origin = 'vad_segment'
 AND content_type IS NULL ORDER BY coalesce(b.confidence, -1) DESC, r.id LIMIT 50)"""))
def t1(a: Archive):
    return _shown(S.review_queue(a.recordings, a.sessions, a.songs, a.candidates, a.segments))


for _status, _sort, _where, _order in [
    ("auto", "duration", "content_type_source = 'auto'", "r.duration_seconds ASC NULLS FIRST"),
    ("all", "date", "true", "s.date ASC NULLS FIRST"),
]:
    @plan(f"T1_review_queue_{_status}_by_{_sort}", REVIEW_SQL.format(rows=f"""(SELECT r.* FROM recordings r
 LEFT JOIN sessions s ON s.id = r.session_id WHERE song_id IS NULL AND origin = 'vad_segment' AND {_where}
 ORDER BY {_order}, r.id LIMIT 50 OFFSET 20)"""))
    def t1_other(a: Archive, status=_status, sort=_sort):
        return _shown(S.review_queue(a.recordings, a.sessions, a.songs, a.candidates, a.segments, status, sort, 50, 20))


VIEW_SQL = """SELECT r.id, r.title, r.origin, r.duration_seconds, s.date AS session_date, r.song_id, g.title AS song_title, r.audio_path
 FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id LEFT JOIN songs g ON g.id = r.song_id"""


@plan("J1_recording_view", VIEW_SQL)
def j1(a: Archive):
    return J.recording_view(a.recordings, a.sessions, a.songs)


TAKES_SQL = """SELECT g.id, g.title, g.slug, g.song_type, g.cover_of, CAST(0 AS BIGINT) AS page, count(v.id) AS takes,
 coalesce(string_agg(concat(v.id, ':', v.origin, ':', coalesce(v.session_date, '')), ',' ORDER BY v.id) FILTER (WHERE v.id IS NOT NULL), '') AS recordings
 FROM songs g LEFT JOIN (%s) v ON v.song_id = g.id WHERE g.song_type IN (%s) GROUP BY 1, 2, 3, 4, 5 ORDER BY g.title"""


def _takes(a: Archive, types):
    rows = J.songs_with_takes(a.songs, J.recording_view(a.recordings, a.sessions, a.songs), types)
    nested = J.nest_takes(rows, "id", page=100000)
    text = F.array_join(F.transform("recordings", lambda r: F.concat_ws(
        ":", r.recording_id.cast("string"), r.origin, F.coalesce(r.session_date, F.lit("")))), ",")
    return nested.withColumn("takes", F.size("recordings").cast("long")).withColumn("recordings", text).orderBy("title")


@plan("J2_songs_with_takes", TAKES_SQL % (VIEW_SQL, "'original', 'cover'"))
def j2(a: Archive):
    return _takes(a, ["original", "cover"])


@plan("J3_jams_with_takes", TAKES_SQL % (VIEW_SQL, "'jam'"))
def j3(a: Archive):
    return _takes(a, ["jam"])


@plan("J4_sessions_with_counts", """SELECT s.*, coalesce(c.n, 0) AS recording_count FROM sessions s LEFT JOIN
 (SELECT session_id, count(*) AS n FROM recordings GROUP BY 1) c ON c.session_id = s.id ORDER BY date DESC""")
def j4(a: Archive):
    return J.sessions_with_counts(a.sessions, a.recordings)


@plan("J5_session_detail", f"""SELECT s.id AS session_id, s.date, s.date_uncertain, s.notes, v.id AS recording_id,
 v.title AS recording_title, v.origin, v.duration_seconds, v.song_id, v.song_title, v.audio_path
 FROM sessions s LEFT JOIN ({VIEW_SQL.replace('SELECT r.id', 'SELECT r.session_id, r.id')}) v ON v.session_id = s.id""")
def j5(a: Archive):
    return J.session_detail(a.sessions, a.recordings, a.songs)


@plan("J6_all_songs", "SELECT id, title, slug, song_type, cover_of FROM songs ORDER BY lower(title), id")
def j6(a: Archive):
    return J.all_songs(a.songs)


CANDIDATE_SQL = """SELECT c.id, c.recording_id, c.song_id, g.title AS song_title, c.confidence, c.rank, c.status,
 c.nearest_recording_id, n.audio_path AS nearest_audio_path, s.date AS nearest_session_date FROM candidates c
 JOIN songs g ON g.id = c.song_id LEFT JOIN recordings n ON n.id = c.nearest_recording_id LEFT JOIN sessions s ON s.id = n.session_id"""


@plan("J7_candidate_view", CANDIDATE_SQL)
def j7(a: Archive):
    return J.candidate_view(a.candidates, a.songs, a.recordings, a.sessions)


@plan("J8_review_rows", REVIEW_SQL.format(rows="recordings"))
def j8(a: Archive):
    return _shown(J.review_rows(a.recordings, a.sessions, a.songs, a.candidates, a.segments))


@plan("J9_best_candidate", """SELECT r.id, c.confidence AS best_confidence FROM recordings r
 LEFT JOIN candidates c ON c.recording_id = r.id AND c.rank = 1""")
def j9(a: Archive):
    return J.best_candidate(a.recordings.select("id"), a.candidates)


@plan("J10_needs_processing", """SELECT id, source FROM recordings WHERE id NOT IN (SELECT recording_id FROM processing_log
 WHERE step = 'librosa' AND version = '1' AND status = 'success')""")
def j10(a: Archive):
    return J.needs_processing(a.recordings.select("id", "source"), a.processing_log, "librosa", "1")


@plan("J17_placed_assignments", """SELECT c.segment_id, c.cluster_id, p.x, p.y FROM clusters c JOIN points p USING (segment_id)""")
def j17(a: Archive):
    return J.placed_assignments(a.clusters.select("segment_id", "cluster_id"), a.points)


@plan("J17_unplaced_count", "SELECT count(*) AS missing FROM clusters WHERE segment_id NOT IN (SELECT segment_id FROM points)")
def j17b(a: Archive):
    return J.unplaced(a.clusters, a.points)


@plan("J19_nearest_start", """SELECT d.seq, d.recording_id, d.split_at, (SELECT s.start_seconds FROM segments s
 WHERE s.recording_id = d.recording_id ORDER BY abs(s.start_seconds - d.split_at), s.start_seconds LIMIT 1) AS nearest
 FROM decisions d WHERE d.kind = 'split'""")
def j19(a: Archive):
    asked = a.decisions.filter("kind = 'split'").select("seq", "recording_id", "split_at")
    return J.nearest_start(a.segments, asked)


@plan("J20_nearest_point", """WITH q AS (SELECT o_orderkey AS id, (o_custkey * 13 % 1000) / CAST(100 AS DOUBLE) AS x,
 (o_orderkey * 17 % 1000) / CAST(100 AS DOUBLE) AS y FROM orders),
 near AS (SELECT q.id, p.segment_id, round(sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)), 9) AS d
 FROM q JOIN points p ON p.x BETWEEN q.x - 0.05 AND q.x + 0.05 AND p.y BETWEEN q.y - 0.05 AND q.y + 0.05)
 SELECT id, segment_id AS point_id, d AS distance FROM near WHERE d < 0.05
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, segment_id) = 1""")
def j20(a: Archive):
    q = a.table("orders").selectExpr(
        "o_orderkey AS id", "(o_custkey * 13 % 1000) / 100D AS x", "(o_orderkey * 17 % 1000) / 100D AS y")
    return J.nearest_point(q, a.points.withColumnRenamed("segment_id", "id"), 0.05)


@plan("G1_review_stats", """SELECT 'total' AS kind, 'total' AS name, count(*) AS n FROM recordings
 UNION ALL SELECT 'total', 'classified', count(content_type) FROM recordings
 UNION ALL SELECT 'total', 'unclassified', count(*) - count(content_type) FROM recordings
 UNION ALL SELECT 'total', 'pending_candidates', count(*) FROM candidates WHERE status = 'pending'
 UNION ALL SELECT 'by_type', content_type, count(*) FROM recordings WHERE content_type IS NOT NULL GROUP BY content_type
 UNION ALL SELECT 'by_source', content_type_source, count(*) FROM recordings WHERE content_type_source IS NOT NULL GROUP BY content_type_source""")
def g1(a: Archive):
    return S.review_stats(a.recordings, a.candidates)


ACOUSTICS_SQL = """SELECT cluster_id, avg(mean_rms) AS mean_rms, avg(mean_spectral_centroid) AS mean_centroid
 FROM clusters WHERE cluster_id <> -1 GROUP BY 1"""


@plan("G4_cluster_acoustics", f"SELECT cluster_id, {half_up('mean_rms', 9)} AS mean_rms, round(mean_centroid, 6) AS mean_centroid FROM ({ACOUSTICS_SQL}) t")
def g4(a: Archive):
    return S.cluster_acoustics(a.clusters).select(
        "cluster_id", settled(F.col("mean_rms"), 9).alias("mean_rms"), F.round("mean_centroid", 6).alias("mean_centroid"))


@plan("G5_normalised_levels", f"""SELECT cluster_id, round((mean_rms - min(mean_rms) OVER ()) / (max(mean_rms) OVER () - min(mean_rms) OVER ()) * 100, 6)
 AS rms_pct FROM ({ACOUSTICS_SQL}) t""")
def g5(a: Archive):
    return S.normalise_over(S.cluster_acoustics(a.clusters), "mean_rms", "rms_pct").select("cluster_id", F.round("rms_pct", 6).alias("rms_pct"))


PURITY_SQL = """SELECT cluster_id, CAST(sum(n) AS BIGINT) AS total, arg_min(effective_type, {'a': -n, 'b': effective_type}) AS dominant_type,
 CAST(floor(max(n) / sum(n) * 100 + 0.5) AS BIGINT) AS dominant_pct,
 string_agg(concat(effective_type, ': ', n), ' | ' ORDER BY n DESC, effective_type) AS breakdown
 FROM (SELECT cluster_id, effective_type, count(*) AS n FROM clusters GROUP BY 1, 2) t GROUP BY 1"""


@plan("G6_cluster_purity", PURITY_SQL)
def g6(a: Archive):
    return S.cluster_purity(a.clusters)


@plan("G7_cluster_sizes", """SELECT CAST(sum(n) AS BIGINT) AS n_segments, count(*) FILTER (cluster_id <> -1) AS n_clusters,
 CAST(coalesce(sum(n) FILTER (cluster_id = -1), 0) AS BIGINT) AS noise_count,
 avg(n) FILTER (cluster_id <> -1) AS size_mean, median(n) FILTER (cluster_id <> -1) AS size_median, min(n) FILTER (cluster_id <> -1) AS size_min,
 max(n) FILTER (cluster_id <> -1) AS size_max, coalesce(sum(n) FILTER (cluster_id = -1), 0) / sum(n) AS noise_fraction
 FROM (SELECT cluster_id, count(*) AS n FROM clusters GROUP BY 1) t""")
def g7(a: Archive):
    return S.cluster_sizes(a.clusters)


@plan("G8_cluster_cards", f"""WITH ac AS ({ACOUSTICS_SQL}), pc AS (SELECT *, (mean_rms - min(mean_rms) OVER ()) / (max(mean_rms) OVER () - min(mean_rms) OVER ()) * 100 AS rp,
 (mean_centroid - min(mean_centroid) OVER ()) / (max(mean_centroid) OVER () - min(mean_centroid) OVER ()) * 100 AS cp FROM ac), pu AS ({PURITY_SQL})
 SELECT cluster_id, concat(CASE WHEN rp >= 67 THEN 'loud' WHEN rp <= 33 THEN 'quiet' ELSE 'mid-level' END, ' · ',
 CASE WHEN cp >= 67 THEN 'bright' WHEN cp <= 33 THEN 'dark' ELSE 'neutral' END, ' · mostly ', dominant_type) AS label FROM pc JOIN pu USING (cluster_id)""")
def g8(a: Archive):
    return S.cluster_cards(a.clusters).select("cluster_id", "label")


@plan("G10_song_totals", """SELECT g.id, g.title, coalesce(t.n, 0) AS takes, round(coalesce(t.d, 0), 6) AS total_seconds FROM songs g LEFT JOIN
 (SELECT song_id, count(*) AS n, sum(coalesce(duration_seconds, 0)) AS d FROM recordings GROUP BY 1) t ON t.song_id = g.id""")
def g10(a: Archive):
    return S.song_totals(a.songs, a.recordings).withColumn("total_seconds", F.round("total_seconds", 6))


@plan("G13_visible_count", """SELECT effective_type, count(*) AS points, effective_type NOT IN ('jam', 'cover') AS visible FROM clusters GROUP BY 1""")
def g13(a: Archive):
    return S.visible_count(a.clusters, ["jam", "cover"])


@plan("G14_recording_levels", f"""SELECT recording_id, {half_up('avg(mean_rms)', 9)} AS mean_rms, {half_up('var_pop(mean_rms)', 9)} AS rms_variance,
 round(CASE WHEN count(mean_rms) > 0 THEN avg(mean_spectral_centroid) END, 6) AS mean_centroid FROM segments GROUP BY 1""")
def g14(a: Archive):
    return S.recording_levels(a.segments).select(
        "recording_id", settled(F.col("mean_rms"), 9).alias("mean_rms"), settled(F.col("rms_variance"), 9).alias("rms_variance"),
        F.round("mean_centroid", 6).alias("mean_centroid"))


@plan("G15_best_confidence", """SELECT r.id, coalesce(max(c.confidence), 0) AS best_confidence FROM recordings r LEFT JOIN candidates c
 ON c.recording_id = r.id AND c.status <> 'rejected' GROUP BY 1""")
def g15(a: Archive):
    return S.best_confidence(a.recordings.select("id"), a.candidates)


@plan("P22_jam_listing", """SELECT g.id, g.title, r.id AS recording_id, r.duration_seconds, r.session_id FROM songs g LEFT JOIN
 (SELECT * FROM recordings QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY id) = 1) r ON r.song_id = g.id WHERE song_type = 'jam'""")
def p22(a: Archive):
    return S.jam_listing(a.songs, a.recordings)


@plan("T2_top_candidates", """SELECT recording_id, song_id, confidence, rk AS rank FROM (SELECT recording_id, song_id, confidence,
 row_number() OVER (PARTITION BY recording_id ORDER BY confidence DESC, song_id) AS rk FROM candidates) t WHERE rk <= 2""")
def t2(a: Archive):
    return top_n(a.candidates.select("recording_id", "song_id", "confidence"), ["recording_id"],
                 [F.desc("confidence"), F.asc("song_id")], 2)


@plan("T3_sample_per_cluster", """SELECT * FROM clusters QUALIFY row_number() OVER (PARTITION BY cluster_id
 ORDER BY md5(concat(segment_id, ':42')), segment_id) <= 5""")
def t3(a: Archive):
    return S.sample_per_group(a.clusters, "cluster_id", "segment_id", 5)


@plan("T8_sections", """SELECT DISTINCT split_part(path, '/', 1) AS section FROM archive_paths""")
def t8(a: Archive):
    return a.archive_paths.select(F.get(F.split("path", "/"), 0).alias("section")).distinct()
