"""Segmentation into passages and their summaries (Q*, G2, G3, G11, J16, J21, T4-T7, S11-S14)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tapeloom.operators import lookups as J
from tapeloom.operators import sequence as Q
from tapeloom.operators import summaries as S
from tapeloom.operators.similarity import mean_vectors
from tapeloom.plans.base import Archive, half_up, plan
from tapeloom.session import work_dir
from tapeloom.sources import store

META = ["recording_title", "audio_path", "session_date", "song_title", "effective_type"]
COS = "list_cosine_similarity({a}, {b})"

# Novelty by definition: the signed sum over all pairs of the window.
NOVELTY_SQL = """SELECT c.recording_id, c.segment_id, c.idx, c.n, CASE WHEN c.n >= @MIN THEN p.novelty ELSE 0 END AS novelty FROM indexed c JOIN (
 SELECT recording_id, center, sum(sim * CASE WHEN (ai < center) = (bi < center) THEN 1 ELSE -1 END) AS novelty FROM (
 SELECT recording_id, ai, bi, sim, unnest(range(greatest(ai, bi) - 3, least(ai, bi) + 5)) AS center FROM (
 SELECT a.recording_id, a.idx AS ai, b.idx AS bi, list_cosine_similarity(a.embedding, b.embedding) AS sim
 FROM indexed a JOIN indexed b ON a.recording_id = b.recording_id AND abs(a.idx - b.idx) < 8) s) t GROUP BY 1, 2) p
 ON p.recording_id = c.recording_id AND p.center = c.idx"""
CURVE_SQL = NOVELTY_SQL.replace("@MIN", "6")

PEAKS_SQL = """SELECT recording_id, CAST(floor((idx + nidx - 1) / 2) AS BIGINT) AS idx, v AS height FROM (
 SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, lead(idx) OVER w AS nidx FROM (
 SELECT * FROM (SELECT recording_id, idx, v, lag(v) OVER (PARTITION BY recording_id ORDER BY idx) AS before, h FROM (
 SELECT recording_id, idx, round(novelty, 9) AS v, avg(round(novelty, 9)) OVER (PARTITION BY recording_id) + 0.5 * stddev_pop(round(novelty, 9)) OVER (PARTITION BY recording_id) AS h
 FROM curve WHERE n >= 3) a) b WHERE before IS NULL OR before <> v) c WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) d WHERE pv < v AND nv < v AND v >= h"""
# Greedy spacing: highest first, later one on a tie, as a fold over the ordered list.
BOUNDS_SQL = """SELECT recording_id, unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([idx] ORDER BY height DESC, idx DESC)),
 lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: abs(a - x[1]) < 3)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS idx FROM peaks GROUP BY 1"""
CHAIN_SQL = f"curve AS ({CURVE_SQL}), peaks AS ({PEAKS_SQL}), bounds AS ({BOUNDS_SQL})"
MEMBERS_SQL = f"""{CHAIN_SQL}, members AS (SELECT i.*, CAST(count(b.idx) OVER (PARTITION BY i.recording_id ORDER BY i.idx) AS BIGINT) AS grp
 FROM indexed i LEFT JOIN bounds b ON b.recording_id = i.recording_id AND b.idx = i.idx AND b.idx > 0)"""
PASSAGES_SQL = f"""{MEMBERS_SQL}, found AS (SELECT m.recording_id, m.grp, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds, count(*) AS segment_count,
 round(max(end_seconds) - min(start_seconds), 2) AS duration, {half_up('avg(mean_rms)', 6)} AS mean_rms, {half_up('avg(mean_spectral_centroid)', 2)} AS mean_spectral_centroid
 FROM members m GROUP BY 1, 2)"""


def curve(a: Archive):
    return Q.silence_short(Q.novelty_curve(a.with_vectors(Q.index_segments(a.placed))))


def bounds(a: Archive, c=None):
    return Q.pick_boundaries(c if c is not None else curve(a), 0.5, 3)


def members(a: Archive):
    return Q.assign_passages(Q.index_segments(a.placed), bounds(a))


@plan("Q1_novelty_curve", f"WITH curve AS ({NOVELTY_SQL.replace('@MIN', '0')}) SELECT recording_id, segment_id, idx, round(novelty, 6) AS novelty FROM curve")
def q1(a: Archive):
    c = Q.novelty_curve(a.with_vectors(Q.index_segments(a.placed)))
    return c.select("recording_id", "segment_id", "idx", F.round("novelty", 6).alias("novelty"))


@plan("Q2_boundaries", f"WITH {CHAIN_SQL} SELECT recording_id, idx FROM bounds")
def q2(a: Archive):
    return bounds(a).select("recording_id", "idx")


@plan("Q3_peaks_before_spacing", f"WITH curve AS ({CURVE_SQL}), peaks AS ({PEAKS_SQL}) SELECT recording_id, idx, round(height, 6) AS height FROM peaks")
def q3(a: Archive):
    return Q.local_peaks(curve(a), 0.5).withColumn("height", F.round("height", 6))


@plan("Q4_passages", f"""WITH {PASSAGES_SQL} SELECT row_number() OVER (ORDER BY recording_id, grp) - 1 AS passage_id, f.*, f.grp AS passage_type, t.recording_title, t.audio_path,
 t.session_date, t.song_title, t.effective_type FROM found f JOIN rec_types t USING (recording_id)""")
def q4(a: Archive):
    return Q.extract_passages(members(a))


@plan("Q4_passage_segments", f"WITH {MEMBERS_SQL} SELECT recording_id, grp, string_agg(segment_id, ',' ORDER BY idx) AS segment_ids FROM members GROUP BY 1, 2")
def q4b(a: Archive):
    lists = Q.passage_segment_lists(members(a))
    return lists.select("recording_id", "grp", F.array_join(F.col("segment_ids").cast("array<string>"), ",").alias("segment_ids"))


@plan("Q4_passage_vectors", f"""WITH {MEMBERS_SQL}, d AS (SELECT recording_id, grp, k, avg(x) AS x FROM (SELECT recording_id, grp, unnest(range(1, 65)) AS k, unnest(u) AS x FROM
 (SELECT recording_id, grp, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM members) a) b GROUP BY 1, 2, 3),
 l AS (SELECT recording_id, grp, sqrt(sum(x * x)) AS len FROM d GROUP BY 1, 2)
 SELECT d.recording_id, d.grp, round(d.x / l.len, 6) AS first FROM d JOIN l USING (recording_id, grp) WHERE k = 1""")
def q4c(a: Archive):
    return Q.passage_vectors(a.with_vectors_by_chunk(members(a).select("recording_id", "grp", "idx", "vec_row"))).select("recording_id", "grp", F.round(F.get("embedding", 0), 6).alias("first"))


@plan("Q5_passage_ids", "SELECT recording_id, grp, passage_id FROM passages")
def q5(a: Archive):
    return blocks(a).select("recording_id", "grp", "passage_id")


STATS_SQL = f"""WITH {CHAIN_SQL}, lists AS (SELECT recording_id, idx // 4096 AS page, string_agg(idx, ',' ORDER BY idx) AS boundaries FROM bounds WHERE idx > 0 GROUP BY 1, 2),
 stats AS (SELECT c.recording_id, t.recording_title, max(c.n) AS n_segments, round(avg(novelty), 4) AS novelty_mean, round(stddev_pop(novelty), 4) AS novelty_std,
 round(max(novelty), 4) AS novelty_max, max(c.n) < 6 AS single_passage, 1 + (SELECT count(*) FROM bounds b WHERE b.recording_id = c.recording_id AND b.idx > 0) AS n_passages
 FROM curve c JOIN rec_types t USING (recording_id) GROUP BY 1, 2)
 SELECT s.*, coalesce(l.page, 0) AS page, coalesce(l.boundaries, '') AS boundaries FROM stats s LEFT JOIN lists l USING (recording_id)"""


def _stats(a: Archive):
    c = curve(a)
    cuts = bounds(a, c)
    titles = a.recordings.select(F.col("id").alias("recording_id"), F.col("title").alias("recording_title"))
    return Q.stats_with_boundaries(Q.recording_stats(c, cuts, titles), cuts)


def _shown_stats(df):
    return df.withColumn("boundaries", F.array_join(F.col("boundaries").cast("array<string>"), ","))


@plan("Q6_recording_stats", STATS_SQL)
def q6(a: Archive):
    return _shown_stats(_stats(a))


# Change points: the open group's start is carried along the ordered list.
CHANGE_SQL = """dist AS (SELECT recording_id, segment_id, idx, n, CASE WHEN idx > 0 THEN round(1 - list_cosine_similarity(embedding, lag(embedding) OVER (PARTITION BY recording_id ORDER BY idx)), 9) END AS distance FROM indexed),
 starts AS (SELECT recording_id, list_reduce(list_prepend([CAST(0 AS BIGINT)], list([idx, CASE WHEN distance > 1.0 THEN 1 ELSE 0 END] ORDER BY idx)[2:]),
  lambda acc, x: CASE WHEN (x[2] = 1 OR x[1] - acc[-1] >= 6) AND x[1] - acc[-1] >= 3 THEN list_append(acc, x[1]) ELSE acc END) AS s FROM dist GROUP BY 1),
 raw AS (SELECT d.*, len(list_filter(s, lambda v: v <= d.idx)) AS g, len(s) AS gs, s[-1] AS last FROM dist d JOIN starts USING (recording_id)),
 merged AS (SELECT *, CASE WHEN g = gs AND g > 1 AND n - last < 3 THEN g - 1 ELSE g END AS mg FROM raw),
 sized AS (SELECT *, count(*) OVER w AS size, min(idx) OVER w AS first FROM merged WINDOW w AS (PARTITION BY recording_id, mg)),
 cuts AS (SELECT recording_id, mg, arg_max(idx, {'d': distance, 'i': -idx}) AS cut FROM sized WHERE size > 6 AND n > 3 AND idx > first GROUP BY 1, 2),
 fin AS (SELECT s.*, coalesce(s.idx >= c.cut, false) AS half FROM sized s LEFT JOIN cuts c USING (recording_id, mg)),
 groups_ AS (SELECT recording_id, segment_id, idx, dense_rank() OVER (PARTITION BY recording_id ORDER BY mg, half) - 1 AS grp FROM fin)"""


def _change_members(a: Archive):
    indexed = a.with_vectors(Q.index_segments(a.placed))
    return Q.change_points(Q.step_distances(indexed), 1.0, 3, 6)


@plan("Q7_change_points", f"WITH {CHANGE_SQL} SELECT recording_id, segment_id, idx, grp FROM groups_")
def q7(a: Archive):
    return _change_members(a).select("recording_id", "segment_id", "idx", "grp")


POINTS_SQL = f"""SELECT {{m}}g.recording_id, g.grp, {half_up('avg(p.x)', 5)} AS x, {half_up('avg(p.y)', 5)} AS y, min(i.start_seconds) AS start_seconds, max(i.end_seconds) AS end_seconds,
 count(*) AS segment_count, {half_up('avg(i.mean_rms)', 6)} AS mean_rms, {half_up('avg(i.mean_spectral_centroid)', 2)} AS mean_spectral_centroid,
 round(max(i.end_seconds) - min(i.start_seconds), 2) AS duration FROM groups_ g JOIN indexed i USING (recording_id, segment_id)"""


def _point_members(a: Archive):
    wide = a.placed.select("segment_id", "start_seconds", "end_seconds", "mean_rms", "mean_spectral_centroid", *META)
    return _change_members(a).join(wide, "segment_id")


@plan("Q8_passage_points", f"""WITH {CHANGE_SQL}, pts AS ({POINTS_SQL.format(m='')} LEFT JOIN points p ON p.segment_id = g.segment_id GROUP BY 1, 2)
 SELECT p.*, row_number() OVER (ORDER BY p.recording_id, p.grp) - 1 AS passage_id, t.recording_title, t.audio_path, t.session_date, t.song_title, t.effective_type
 FROM pts p JOIN rec_types t USING (recording_id) WHERE x IS NOT NULL""")
def q8(a: Archive):
    placed, _ = Q.passage_points(_point_members(a), a.points, META)
    return Q.number_points(placed)


@plan("J16_unplaced_passages", f"""WITH {CHANGE_SQL} SELECT count(*) AS dropped FROM (SELECT recording_id, grp, count(x) AS c FROM groups_ g LEFT JOIN
 (SELECT * FROM points WHERE segment_id % 3 = 0) p USING (recording_id, segment_id) GROUP BY 1, 2) t WHERE c = 0""")
def j16(a: Archive):
    _, lost = Q.passage_points(_point_members(a), a.points.filter("segment_id % 3 = 0"), META)
    return lost.agg(F.count(F.lit(1)).alias("dropped"))


MAPS = {"all": ("All segments", None), "left": ("Left half", "x < 5"), "right": ("Right half", "x >= 5")}


def _stored_maps(a: Archive) -> str:
    """Three maps of the points and their catalog, written once for a session and folder."""
    def write(root: str) -> None:
        for name, (label, rule) in MAPS.items():
            coords = (a.points.filter(rule) if rule else a.points).select("segment_id", "x", "y")
            store.write_map(a.spark, root, name, coords, label, {"where": rule, "least": 0.5})
    return _written(a, "maps", write)


@plan("Q9_points_of_all_maps", f"""WITH {CHANGE_SQL}, maps AS (SELECT unnest(['all', 'left', 'right']) AS map_name),
 pts AS ({POINTS_SQL.format(m='m.map_name, ')} CROSS JOIN maps m LEFT JOIN points p ON p.segment_id = g.segment_id AND (m.map_name = 'all' OR (p.x < 5) = (m.map_name = 'left')) GROUP BY 1, 2, 3)
 SELECT map_name, CASE map_name WHEN 'all' THEN 'All segments' WHEN 'left' THEN 'Left half' ELSE 'Right half' END || ' (passages)' AS label,
 row_number() OVER (PARTITION BY map_name ORDER BY recording_id, grp) - 1 AS passage_id, recording_id, grp, x, y, segment_count FROM pts WHERE x IS NOT NULL""")
def q9(a: Archive):
    root = _stored_maps(a)
    coords, catalog = store.read_maps(a.spark, root), store.read_catalog(a.spark, root)
    names = catalog.select(F.col("name").alias("map_name"), F.concat("label", F.lit(" (passages)")).alias("label"))
    every = names.agg(F.sort_array(F.collect_list("map_name"))).scalar()  # the catalog has a row per map
    members = _point_members(a).withColumn("map_name", F.explode(every))
    placed, _ = Q.passage_points(members, coords, META, "map_name")
    return Q.number_points(placed, "map_name").join(names, "map_name").select(
        "map_name", "label", "passage_id", "recording_id", "grp", "x", "y", "segment_count")


@plan("S12_map_catalog", """SELECT name, label, count, filters_where FROM (SELECT 'all' AS name, 'All segments' AS label, count(*) AS count, CAST(NULL AS STRING) AS filters_where FROM points
 UNION ALL SELECT 'left', 'Left half', count(*), 'x < 5' FROM points WHERE x < 5 UNION ALL SELECT 'right', 'Right half', count(*), 'x >= 5' FROM points WHERE x >= 5) t ORDER BY name""")
def s12_maps(a: Archive):
    return store.read_catalog(a.spark, _stored_maps(a)).select("name", "label", "count", F.col("filters.where").alias("filters_where")).orderBy("name")


@plan("Q10_polylines", """SELECT recording_id, CAST(0 AS BIGINT) AS page, string_agg(printf('%.1f:%.3f:%.3f', start_seconds, x, y), ' ' ORDER BY start_seconds, segment_id) AS points
 FROM points JOIN (SELECT segment_id, effective_type FROM clusters) c USING (segment_id) WHERE effective_type NOT IN ('jam') GROUP BY 1""")
def q10(a: Archive):
    pts = a.points.join(a.clusters.select("segment_id", "effective_type"), "segment_id")
    lines = Q.polylines(pts, ["jam"])
    return lines.withColumn("points", F.array_join(F.transform(
        "points", lambda p: F.format_string("%.1f:%.3f:%.3f", p.start_seconds, p.x, p.y)), " "))


# --- summaries over plain blocks of four segments ---------------------------------------------------

def blocks(a: Archive):
    indexed = Q.index_segments(a.placed).withColumn("grp", F.floor(F.col("idx") / 4))
    return Q.extract_passages(indexed)


@plan("G2_passage_types", f"""SELECT p.passage_type, count(*) AS count, count(DISTINCT recording_id) AS n_recordings, {half_up('avg(duration)', 1)} AS mean_duration, {half_up('avg(mean_rms)', 6)} AS mean_rms,
 {half_up('avg(mean_spectral_centroid)', 2)} AS mean_spectral_centroid, max(s.top_songs) AS top_songs FROM passages p LEFT JOIN (
 SELECT passage_type, string_agg(concat(song_title, '=', c), ', ' ORDER BY c DESC, song_title) AS top_songs FROM (SELECT passage_type, song_title, count(*) AS c FROM passages
 WHERE song_title IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY passage_type ORDER BY count(*) DESC, song_title) <= 5) x GROUP BY 1) s
 ON s.passage_type = p.passage_type GROUP BY 1""")
def g2(a: Archive):
    return S.passage_types(blocks(a)).withColumn("top_songs", F.array_join(F.transform(
        "top_songs", lambda s: F.concat(s.title, F.lit("="), s["count"].cast("string"))), ", "))


@plan("G3_distribution", "SELECT round(avg(duration), 6) AS mean, min(duration) AS min, max(duration) AS max, median(duration) AS median FROM passages")
def g3(a: Archive):
    return S.distribution(blocks(a), "duration").withColumn("mean", F.round("mean", 6))


@plan("G11_scale_domains", """SELECT min(coalesce(mean_rms, 0)) AS rms_min, max(coalesce(mean_rms, 0)) AS rms_max, min(coalesce(mean_spectral_centroid, 0)) AS centroid_min,
 max(coalesce(mean_spectral_centroid, 0)) AS centroid_max, min(CAST(substr(session_date, 1, 4) AS INT)) AS year_min, max(CAST(substr(session_date, 1, 4) AS INT)) AS year_max,
 list_sort(list(duration) FILTER (duration > 0))[CAST(floor(count(*) FILTER (duration > 0) * 0.1) AS BIGINT) + 1] AS duration_p10,
 list_sort(list(duration) FILTER (duration > 0))[CAST(floor(count(*) FILTER (duration > 0) * 0.9) AS BIGINT) + 1] AS duration_p90 FROM passages""")
def g11(a: Archive):
    return S.scale_domains(blocks(a))


RUN = store.run_name(8, 0.5)
WRITTEN: dict[tuple[str, str, str], str] = {}  # what a session has written of a folder


def _written(a: Archive, kind: str, write) -> str:
    key = (a.spark.sparkContext.applicationId, a.folder, kind)
    if key not in WRITTEN:
        root = f"{work_dir(a.spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        write(root)
        WRITTEN[key] = root
    return WRITTEN[key]


def _stored_run(a: Archive) -> str:
    """The five tables of a run, and the types of a second run that has no configuration."""
    def write(root: str) -> None:
        indexed = Q.index_segments(a.placed).withColumn("grp", F.floor(F.col("idx") / 4))
        found = Q.extract_passages(indexed)
        store.write_run(root, RUN, {"passages": found})
        found = store.read_run(a.spark, root, "passages", RUN).drop("run")
        vectors = mean_vectors(a.with_vectors_by_chunk(indexed.select("recording_id", "grp", "idx", "vec_row")), ["recording_id", "grp"], "embedding", "vector", normalize=False)
        vectors = vectors.join(found.select("recording_id", "grp", "passage_id"), ["recording_id", "grp"])
        store.write_run(root, RUN, {
            "passage_types": S.passage_types(found), "recording_stats": _stats(a),
            "config": Q.run_config(RUN, found, 8, 0.5, Q.MIN_SEGMENTS, Q.MIN_PASSAGE_SECONDS, F.lit("2024-01-01").cast("timestamp_ntz"))})
        store.export_vectors(vectors, "passage_id", "vector", f"{root}/passage_embeddings/run={RUN}")
        store.write_run(root, "odd", {"passage_types": S.passage_types(found.filter("passage_id % 2 = 1"))})
    return _written(a, "runs", write)


def _run_table(a: Archive, name: str):
    return store.read_run(a.spark, _stored_run(a), name, RUN)


@plan("J21_by_type", "SELECT passage_id, recording_id, start_seconds FROM passages WHERE passage_type = 3")
def j21(a: Archive):
    return J.passages_by_type(store.read_runs(a.spark, _stored_run(a), "passages"), RUN, 3).select("passage_id", "recording_id", "start_seconds")


@plan("J21_by_recording", "SELECT passage_id, recording_id, start_seconds FROM passages WHERE recording_id = 5 ORDER BY start_seconds")
def j21b(a: Archive):
    return J.passages_by_recording(store.read_runs(a.spark, _stored_run(a), "passages"), RUN, 5).select("passage_id", "recording_id", "start_seconds")


SAMPLED = ["passage_id", "recording_id", "passage_type", "start_seconds", "end_seconds", "segment_count"]


@plan("T4_one_per_recording", f"""SELECT {', '.join(SAMPLED)} FROM (SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY recording_id
 ORDER BY md5(concat(passage_id, ':42')), passage_id) = 1) p ORDER BY md5(concat(recording_id, ':42')), recording_id LIMIT 15""")
def t4(a: Archive):
    return S.one_per_recording(_run_table(a, "passages")).select(*SAMPLED)


@plan("T5_similar_passages", f"""SELECT {', '.join(SAMPLED)} FROM passages WHERE passage_type = 2 AND recording_id <> 5
 ORDER BY md5(concat(passage_id, ':42')), passage_id LIMIT 10""")
def t5(a: Archive):
    return S.similar_passages(_run_table(a, "passages"), 2, 5).select(*SAMPLED)


@plan("T6_most_segmented", "SELECT recording_id, count(*) AS n_passages FROM passages GROUP BY 1 ORDER BY n_passages DESC, recording_id LIMIT 20")
def t6(a: Archive):
    return S.most_segmented(_run_table(a, "passages").groupBy("recording_id").agg(F.count(F.lit(1)).alias("n_passages")))


@plan("T7_types_by_size", "SELECT passage_type, count(*) AS count FROM passages GROUP BY 1 ORDER BY count DESC, passage_type")
def t7(a: Archive):
    return S.types_by_size(_run_table(a, "passage_types").select("passage_type", "count"))


@plan("S13_list_runs", """SELECT 'ssm-k8-t0p5' AS name, 0 AS n_clusters, 'ssm' AS method, count(*) AS passage_count, count(DISTINCT passage_type) AS type_count FROM passages
 UNION ALL SELECT 'odd', 0, 'unknown', count(*), count(DISTINCT passage_type) FROM passages WHERE passage_id % 2 = 1""")
def s13(a: Archive):
    root = _stored_run(a)
    return store.list_runs(store.read_runs(a.spark, root, "passage_types"), store.read_runs(a.spark, root, "config")).withColumn(
        "n_clusters", F.col("n_clusters").cast("int"))


@plan("S11_written_run", "SELECT 'ssm-k8-t0p5' AS run, passage_id, recording_id, duration FROM passages")
def s11(a: Archive):
    return _run_table(a, "passages").select("run", "passage_id", "recording_id", "duration")


@plan("S11_run_types", f"SELECT 'ssm-k8-t0p5' AS run, passage_type, count(*) AS count, count(DISTINCT recording_id) AS n_recordings, {half_up('avg(duration)', 1)} AS mean_duration FROM passages GROUP BY 2")
def s11_types(a: Archive):
    return _run_table(a, "passage_types").select("run", "passage_type", "count", "n_recordings", "mean_duration")


@plan("S11_run_stats", STATS_SQL.replace("SELECT s.*,", "SELECT 'ssm-k8-t0p5' AS run, s.*,"))
def s11_stats(a: Archive):
    return _shown_stats(_run_table(a, "recording_stats"))


@plan("S11_run_config", """SELECT 'ssm-k8-t0p5' AS run, 'ssm' AS method, 'ssm-k8-t0p5' AS run_name, 8 AS kernel_size, count(DISTINCT recording_id) AS n_recordings, count(*) AS n_passages FROM passages""")
def s11_config(a: Archive):
    return _run_table(a, "config").select("run", "method", "run_name", "kernel_size", "n_recordings", "n_passages")


@plan("G9_compare_runs", """SELECT 'm' || cluster_id % 2 AS method, CAST(cluster_id + 2 AS BIGINT) AS n_clusters, cluster_id AS run,
 round(count(*) FILTER (effective_type = 'jam') / count(*) * 100, 1) AS noise_pct FROM clusters WHERE cluster_id >= 0 GROUP BY cluster_id ORDER BY 1, 2""")
def g9(a: Archive):
    runs = a.clusters.filter("cluster_id >= 0").groupBy("cluster_id").agg(
        (F.count_if(F.col("effective_type") == "jam") / F.count(F.lit(1))).alias("noise_fraction"))
    runs = runs.select(F.concat(F.lit("m"), (F.col("cluster_id") % 2).cast("string")).alias("method"),
                       (F.col("cluster_id") + 2).alias("n_clusters"), F.col("cluster_id").alias("run"), "noise_fraction")
    return S.compare_runs(runs).drop("noise_fraction")


@plan("S14_passage_vectors", """SELECT passage_id, round(s, 6) AS total FROM (SELECT p.passage_id, sum(list_sum(i.embedding)) / max(p.segment_count) AS s FROM passages p JOIN indexed i
 ON i.recording_id = p.recording_id AND i.idx // 4 = p.grp GROUP BY 1) t""")
def s14(a: Archive):
    total = F.aggregate("vector", F.lit(0.0), lambda x, y: x + y)
    return _run_table(a, "passage_embeddings").select("passage_id", F.round(total, 6).alias("total"))
