"""Passages as states: runs, transitions, scores and reports (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import sequence as Q
from tapeloom.operators import similarity as V
from tapeloom.operators import states as D
from tapeloom.operators.ordered import ordinal
from tapeloom.plans.base import Archive, plan
from tapeloom.plans.passages import blocks


def _clusters_sql(k: int) -> str:
    """The rounds of D12 one after another: a centre's segments, then their mean."""
    unit = "list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y))))"
    parts = [f"u AS (SELECT segment_id, {unit} AS u FROM seg_vec WHERE embedding IS NOT NULL)",
             "h AS (SELECT u AS m, min(md5(CAST(segment_id AS STRING))) AS h FROM u GROUP BY 1)",
             f"m0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, m FROM h QUALIFY c < {k})"]
    for r in range(D.CLUSTER_ROUNDS + 1):
        parts.append(f"a{r} AS (SELECT segment_id, any_value(u) AS u, arg_min(c, {{'d': round(list_dot_product(m, m) - 2 * list_dot_product(u, m), 9), 'c': c}}) AS c "
                     f"FROM u, m{r} GROUP BY segment_id)")
        parts.append(f"m{r + 1} AS (SELECT c, list(v ORDER BY d) AS m FROM (SELECT c, d, round(avg(u[d]), 9) AS v FROM a{r}, range(1, 65) t(d) GROUP BY c, d) x GROUP BY c "
                     f"UNION ALL SELECT c, m FROM m{r} WHERE c NOT IN (SELECT c FROM a{r}))")
    return f"WITH {', '.join(parts)} SELECT segment_id, c AS cluster_id FROM a{D.CLUSTER_ROUNDS}"


@plan("D12_cluster_segments", _clusters_sql(8))
def d12(a: Archive):
    return D.cluster_segments(a.with_vectors(a.placed), 8)


@plan("D1_neighbour_novelty", """SELECT query_id, round(avg(1 - s), 6) AS novelty FROM (SELECT x.vec_id AS query_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]),
 CAST(y.embedding AS DOUBLE[])), 9) AS s FROM embeddings x, embeddings y WHERE x.vec_id <> y.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY
 round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 9) DESC, y.vec_id) <= 10) t GROUP BY 1""")
def d1(a: Archive):
    v = a.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return D.neighbour_novelty(V.knn(v, v, 10, skip_self=True)).withColumn("novelty", F.round("novelty", 6))


STATES_SQL = """(SELECT id AS segment_id, recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_seconds, id) - 1 AS idx, (id * 7 // 3) % 3 AS state FROM segments)"""
SMOOTH_SQL = f"""(SELECT recording_id, segment_id, idx, state, (SELECT arg_max(v, {{'c': c, 'own': CASE WHEN v = w.state THEN 1 ELSE 0 END, 'low': -v}}) FROM
 (SELECT v, count(*) AS c FROM (SELECT unnest(w.near) AS v) u GROUP BY v) q) AS smooth FROM (SELECT *, list(state) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near
 FROM {STATES_SQL} s) w)"""


def _smoothed(a: Archive):
    rows = a.segments.select("recording_id", F.col("id").alias("segment_id"), "start_seconds", F.expr("(id * 7 div 3) % 3").alias("state"))
    indexed = ordinal(rows, ["recording_id"], "start_seconds", "segment_id", Q.TIME_CHUNK, "idx")
    return D.smooth_states(indexed)


@plan("D2_smooth_states", f"SELECT recording_id, segment_id, idx, smooth FROM {SMOOTH_SQL} s")
def d2(a: Archive):
    return _smoothed(a).select("recording_id", "segment_id", "idx", "smooth")


@plan("D2_state_runs", f"""SELECT recording_id, segment_id, CAST(sum(turn) OVER (PARTITION BY recording_id ORDER BY idx) AS BIGINT) AS grp FROM (SELECT *, CASE WHEN lag(smooth) OVER
 (PARTITION BY recording_id ORDER BY idx) <> smooth THEN 1 ELSE 0 END AS turn FROM {SMOOTH_SQL} s) t""")
def d2b(a: Archive):
    return D.state_runs(_smoothed(a)).select("recording_id", "segment_id", "grp")


@plan("D3_meta_states", """SELECT id, CASE WHEN starts_with(source, 'Assajos/') AND duration_seconds < 120 THEN 'Interstitial' ELSE 'Musical' END AS meta_state FROM recordings""")
def d3(a: Archive):
    return a.recordings.select("id", D.meta_state(F.startswith("source", F.lit("Assajos/")), F.col("duration_seconds")).alias("meta_state"))


STEPS_SQL = """(SELECT passage_id, recording_id, grp, passage_type, song_title, lead(passage_id) OVER w AS successor_id, lead(passage_type) OVER w AS next_type,
 CASE grp * 3 // count(*) OVER (PARTITION BY recording_id) WHEN 0 THEN 'beginning' WHEN 1 THEN 'middle' ELSE 'end' END AS position FROM passages WINDOW w AS (PARTITION BY recording_id ORDER BY grp))"""


@plan("D4_successors", f"SELECT passage_id, successor_id, next_type, position FROM {STEPS_SQL} s")
def d4(a: Archive):
    return D.successors(blocks(a)).select("passage_id", "successor_id", "next_type", "position")


KIND_SQL = f"(SELECT *, passage_id % 5 AS state, (successor_id % 5) AS next_state FROM {STEPS_SQL} z)"


def _steps(a: Archive):
    return D.successors(blocks(a)).withColumn("state", F.col("passage_id") % 5).withColumn("next_state", F.col("successor_id") % 5)


LEARNED_SQL = f"""(SELECT state, next_state, n AS weight, n / sum(n) OVER (PARTITION BY state) AS probability FROM (SELECT state, next_state, CAST(count(*) AS DOUBLE) AS n FROM {KIND_SQL} s
 WHERE next_state IS NOT NULL GROUP BY 1, 2) t)"""
BY_SONG_SQL = f"""(SELECT state, next_state, w AS weight, w / sum(w) OVER (PARTITION BY state) AS probability FROM (SELECT state, next_state, sum(share) AS w FROM (SELECT song_title, state, next_state,
 count(*) / sum(count(*)) OVER (PARTITION BY song_title) AS share FROM {KIND_SQL} s WHERE next_state IS NOT NULL GROUP BY 1, 2, 3) a GROUP BY 1, 2) t)"""


@plan("D5_transitions", f"SELECT state, next_state, weight, round(probability, 9) AS probability FROM {LEARNED_SQL} t")
def d5(a: Archive):
    return D.transitions(_steps(a), "state", "next_state").withColumn("probability", F.round("probability", 9))


@plan("D5_transitions_by_song", f"SELECT state, next_state, round(weight, 6) AS weight, round(probability, 6) AS probability FROM {BY_SONG_SQL} t")
def d5b(a: Archive):
    out = D.transitions(_steps(a), "state", "next_state", "song_title")
    return out.withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))


@plan("D5_initial_distribution", f"SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS probability FROM {KIND_SQL} s WHERE grp = 0 GROUP BY 1")
def d5c(a: Archive):
    return D.initial_distribution(_steps(a), "state").withColumn("probability", F.round("probability", 9))


@plan("D6_blended_transitions", f"""SELECT state, next_state, round(0.7 * coalesce(l.probability, 0) + 0.3 * coalesce(m.probability, 0), 6) AS probability
 FROM {LEARNED_SQL} l FULL JOIN {BY_SONG_SQL} m USING (state, next_state)""".replace("0.7 *", "CAST(0.7 AS DOUBLE) *").replace("0.3 *", "CAST(0.3 AS DOUBLE) *"))
def d6(a: Archive):
    steps = _steps(a)
    both = D.blend(D.transitions(steps, "state", "next_state"), D.transitions(steps, "state", "next_state", "song_title"), "state", "next_state", 0.3)
    return both.withColumn("probability", F.round("probability", 6))


@plan("D7_score_passages", """WITH inv AS (SELECT vec_id AS passage_id, CAST(embedding AS DOUBLE[]) AS o, CAST(embedding[1:12] AS DOUBLE[]) AS c, 2000 + vec_id % 20 AS year, CAST(20 + vec_id % 300 AS DOUBLE) AS duration,
 CASE WHEN vec_id % 7 = 0 THEN vec_id % 11 END AS ago FROM embeddings), q AS (SELECT o, c FROM inv WHERE passage_id = 0),
 sc AS (SELECT passage_id, list_cosine_similarity(inv.o, q.o) - coalesce(1 / (1 + ago), 0) - 0.5 * abs(ln(greatest(duration, 1) / 120)) + 0.5 * (passage_id = 1)::INT
 + 0.5 * list_cosine_similarity(inv.c, q.c) + 0.25 / (1 + abs(year - 2012)) AS score FROM inv, q)
 SELECT passage_id, round(score, 6) AS score, round(exp(score - max(score) OVER ()) / (SELECT sum(exp(score - (SELECT max(score) FROM sc))) FROM sc), 9) AS probability FROM sc""")
def d7(a: Archive):
    e = a.table("embeddings")
    now = [float(x) for x in e.filter("vec_id = 0").select("embedding").head().embedding]
    inv = e.select(
        F.col("vec_id").alias("passage_id"), F.col("embedding").alias("opening"), F.slice("embedding", 1, 12).alias("chroma"), (2000 + F.col("vec_id") % 20).alias("year"),
        (20 + F.col("vec_id") % 300).cast("double").alias("duration"), F.when(F.col("vec_id") % 7 == 0, F.col("vec_id") % 11).alias("plays_ago"))
    out = D.score_passages(inv, now, now[:12], 2012, 1, 120.0)
    return out.select("passage_id", F.round("score", 6).alias("score"), F.round("probability", 9).alias("probability"))


@plan("D8_session_calendar", """SELECT substr(s.date, 1, 7) AS month, count(*) AS sessions, CAST(coalesce(sum(n), 0) AS BIGINT) AS recordings, round(coalesce(sum(d) / 3600, 0), 6) AS hours
 FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, sum(duration_seconds) AS d FROM recordings GROUP BY 1) r ON r.session_id = s.id GROUP BY 1""")
def d8(a: Archive):
    return D.session_calendar(a.sessions, a.recordings).withColumn("hours", F.round("hours", 6))


@plan("D9_state_sequence", """SELECT recording_id, CAST(0 AS BIGINT) AS page, string_agg(passage_type, '>' ORDER BY grp) AS states FROM passages GROUP BY 1""")
def d9(a: Archive):
    return D.state_sequence(blocks(a)).withColumn("states", F.array_join(F.col("states").cast("array<string>"), ">"))


@plan("D10_likely_copies", """WITH it AS (SELECT DISTINCT r.origin, s.date, lower(r.title) AS low FROM recordings r JOIN sessions s ON s.id = r.session_id WHERE r.title IS NOT NULL)
 SELECT a.date, a.low AS left_title, b.low AS right_title, CAST(levenshtein(a.low, b.low) AS INT) AS edits FROM it a JOIN it b ON a.date = b.date AND a.origin = 'pretrimmed'
 AND b.origin = 'vad_segment' AND levenshtein(a.low, b.low) <= 2""")
def d10(a: Archive):
    dates = a.sessions.select(F.col("id").alias("session_id"), "date")
    items = a.recordings.join(dates, "session_id").select(F.col("origin").alias("section"), "date", "title")
    return D.likely_copies(items, ("pretrimmed", "vad_segment"), 2)


@plan("D10_equal_contents", """SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def d10b(a: Archive):
    return D.equal_contents(a.table("documents"), "text", "doc_id")


@plan("D11_takes_in_order", """SELECT r.id, r.song_id, s.date AS session_date, row_number() OVER (PARTITION BY r.song_id ORDER BY s.date NULLS LAST, r.id) AS take_number
 FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id WHERE r.song_id IS NOT NULL""")
def d11(a: Archive):
    return D.takes_in_order(a.recordings, a.sessions)
