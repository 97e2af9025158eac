"""Similarity search, matching and projections (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.vectors import cosine_distance, l2_normalize
from tapeloom.operators import similarity as V
from tapeloom.operators.sequence import index_segments
from tapeloom.plans.base import Archive, plan

COSINE = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


def _vectors(a: Archive):
    return a.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@plan("V1_l2_normalize", """SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS length, round(u[1], 6) AS first FROM
 (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings) t""")
def v1(a: Archive):
    u = a.table("embeddings").withColumn("u", l2_normalize(F.col("embedding")))
    length = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    return u.select("vec_id", F.round(length, 6).alias("length"), F.round(F.get("u", 0), 6).alias("first"))


@plan("V2_cosine_distance", f"SELECT x.vec_id, round(1 - {COSINE.format(a='x.embedding', b='y.embedding')}, 6) AS distance FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def v2(a: Archive):
    x = a.table("embeddings").select("vec_id", "embedding")
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return x.join(y, "vec_id").select("vec_id", F.round(cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


KNN_SQL = f"""SELECT query_id, neighbour_id, round(s, 6) AS similarity, rk AS rank FROM (SELECT x.vec_id AS query_id, y.vec_id AS neighbour_id,
 {COSINE.format(a='x.embedding', b='y.embedding')} AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY {COSINE.format(a='x.embedding', b='y.embedding')} DESC, y.vec_id) AS rk
 FROM embeddings x, embeddings y @WHERE) t WHERE rk <= @K"""


@plan("V3_knn", KNN_SQL.replace("@WHERE", "").replace("@K", "5"))
def v3(a: Archive):
    v = _vectors(a)
    return V.knn(v, v, 5).withColumn("similarity", F.round("similarity", 6))


@plan("V10_knn_graph", KNN_SQL.replace("@WHERE", "WHERE x.vec_id <> y.vec_id").replace("@K", "15"))
def v10(a: Archive):
    v = _vectors(a)
    return V.knn(v, v, 15, skip_self=True).withColumn("similarity", F.round("similarity", 6))


@plan("V4_similar_segments", f"""SELECT c.segment_id, c.recording_id, c.start_seconds, c.end_seconds, t.recording_title, t.session_date, t.audio_path,
 round({COSINE.format(a='q.embedding', b='c.embedding')}, 6) AS score FROM seg_vec c JOIN rec_types t USING (recording_id), (SELECT embedding FROM seg_vec WHERE segment_id = 7) q
 WHERE c.segment_id <> 7 ORDER BY {COSINE.format(a='q.embedding', b='c.embedding')} DESC, c.segment_id LIMIT 10""")
def v4(a: Archive):
    return V.similar_segments(a.wide, 7, 10).select(
        "segment_id", "recording_id", "start_seconds", "end_seconds", "recording_title", "session_date", "audio_path",
        F.round("score", 6).alias("score"))


MATCH_SQL = f"""SELECT recording_id, song_id, nearest_recording_id, c AS confidence, row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, song_id) AS rank, 'pending' AS status
 FROM (SELECT q.vec_id AS recording_id, CAST(r.label AS BIGINT) AS song_id, max({COSINE.format(a='q.embedding', b='r.embedding')}) AS c,
 arg_max(r.vec_id, {{'c': {COSINE.format(a='q.embedding', b='r.embedding')}, 'i': -r.vec_id}}) AS nearest_recording_id
 FROM embeddings q, embeddings r WHERE q.vec_id % 3 = 0 AND r.vec_id % 3 <> 0 GROUP BY 1, 2) t QUALIFY rank <= 3"""


def _matches(a: Archive):
    v = _vectors(a)
    return V.match_songs(v.filter("id % 3 <> 0").withColumn("song_id", F.col("label")), v.filter("id % 3 = 0"), 3)


def _shown(df):
    return df.withColumn("confidence", F.round("confidence", 6)).withColumn("rank", F.col("rank").cast("long"))


@plan("V5_match_songs", f"SELECT recording_id, song_id, nearest_recording_id, round(confidence, 6) AS confidence, rank, status FROM ({MATCH_SQL}) m")
def v5(a: Archive):
    return _shown(_matches(a))


# recordings 0, 30, 60 ... get a new song each label, 1, 51, 101 ... lose theirs if they had one
NOW = "CASE WHEN vec_id % 30 = 0 THEN label + 100 WHEN vec_id % 3 <> 0 AND vec_id % 50 <> 1 THEN label END"


@plan("V5_rematch", f"""WITH now AS (SELECT vec_id, embedding, CAST({NOW} AS BIGINT) AS song FROM embeddings),
 best AS (SELECT q.vec_id AS recording_id, r.song AS song_id, max({COSINE.format(a='q.embedding', b='r.embedding')}) AS c,
 arg_max(r.vec_id, {{'c': {COSINE.format(a='q.embedding', b='r.embedding')}, 'i': -r.vec_id}}) AS nearest_recording_id
 FROM now q, now r WHERE q.song IS NULL AND r.song IS NOT NULL GROUP BY 1, 2)
 SELECT recording_id, song_id, nearest_recording_id, round(c, 6) AS confidence, row_number() OVER (PARTITION BY recording_id ORDER BY c DESC, song_id) AS rank,
 'pending' AS status FROM best QUALIFY rank <= 3""")
def v5_rematch(a: Archive):
    v = _vectors(a)
    now = v.withColumn("song_id", F.when(F.col("id") % 30 == 0, F.col("label") + 100).when((F.col("id") % 3 != 0) & (F.col("id") % 50 != 1), F.col("label")))
    changed = v.filter("id % 30 = 0 or (id % 3 <> 0 and id % 50 = 1)").select("id")
    return _shown(V.rematch_songs(_matches(a), now.filter("song_id is not null"), now.filter("song_id is null"), changed, 3))


OLD_SQL = """SELECT vec_id AS recording_id, CAST(label AS BIGINT) AS song_id, vec_id + 1 AS nearest_recording_id, CAST(0.5 AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS rank,
 CASE vec_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM embeddings"""


@plan("V6_refresh_candidates", f"""WITH old AS ({OLD_SQL}), m AS (SELECT * FROM ({MATCH_SQL}) z WHERE recording_id NOT IN (SELECT recording_id FROM old WHERE status <> 'pending'))
 SELECT recording_id, song_id, nearest_recording_id, round(confidence, 6) AS confidence, rank, status FROM m
 UNION ALL SELECT recording_id, song_id, nearest_recording_id, confidence, rank, status FROM old WHERE NOT (status = 'pending' AND recording_id IN (SELECT recording_id FROM m))""")
def v6(a: Archive):
    v = _vectors(a)
    old = v.select(
        F.col("id").alias("recording_id"), F.col("label").cast("long").alias("song_id"), (F.col("id") + 1).alias("nearest_recording_id"),
        F.lit(0.5).alias("confidence"), F.lit(1).alias("rank"),
        F.when(F.col("id") % 4 == 0, "accepted").when(F.col("id") % 4 == 1, "rejected").otherwise("pending").alias("status"))
    todo = V.refresh_scope(v.filter("id % 3 = 0"), old)
    found = V.match_songs(v.filter("id % 3 <> 0").withColumn("song_id", F.col("label")), todo, 3)
    return _shown(V.refresh_candidates(old, found))


@plan("V7_match_statistics", f"""SELECT round(min(confidence) FILTER (rank = 1), 6) AS min, round(quantile_cont(confidence, 0.25) FILTER (rank = 1), 6) AS p25,
 round(quantile_cont(confidence, 0.5) FILTER (rank = 1), 6) AS median, round(quantile_cont(confidence, 0.75) FILTER (rank = 1), 6) AS p75,
 round(max(confidence) FILTER (rank = 1), 6) AS max, count(*) FILTER (rank = 1) AS processed, count(*) AS inserted FROM ({MATCH_SQL}) m""")
def v7(a: Archive):
    out = V.match_statistics(_matches(a))
    return out.select(*[F.round(c, 6).alias(c) for c in ("min", "p25", "median", "p75", "max")], "processed", "inserted")


@plan("V8_similarity_band", """SELECT segment_id, idx, n_next, round(total, 6) AS total FROM (SELECT a.segment_id, a.idx, count(b.idx) AS n_next,
 coalesce(sum(list_cosine_similarity(a.embedding, b.embedding)), 0) AS total FROM indexed a LEFT JOIN indexed b ON b.recording_id = a.recording_id AND b.idx > a.idx AND b.idx <= a.idx + 7 GROUP BY 1, 2) t""")
def v8(a: Archive):
    band = V.similarity_band(index_segments(a.wide), 7)
    total = F.aggregate("cosines", F.lit(0.0), lambda x, y: x + y)
    return band.select("segment_id", "idx", F.size("cosines").cast("long").alias("n_next"), F.round(total, 6).alias("total"))


UNIT_SQL = "(SELECT recording_id, idx, n, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM indexed)"


@plan("V9_self_similarity_tiles", f"""WITH t AS (SELECT recording_id, idx, n, CASE WHEN n > 24 THEN n // 24 ELSE 1 END AS f, u FROM {UNIT_SQL} z),
 k AS (SELECT recording_id, idx // f AS tile, u, idx, f FROM t WHERE idx < n - n % f),
 pairs AS (SELECT a.recording_id, a.tile, b.tile AS other, avg(list_dot_product(a.u, b.u)) AS m FROM k a JOIN k b USING (recording_id) GROUP BY 1, 2, 3)
 SELECT recording_id, tile, string_agg(CAST(floor(round(greatest(least((round(m, 6) + 1) * 127.5, 255), 0), 6)) AS BIGINT), ',' ORDER BY other) AS pixels FROM pairs GROUP BY 1, 2""")
def v9(a: Archive):
    return V.ssm_tiles(a.wide, 24).withColumn("pixels", F.array_join(F.col("pixels").cast("array<string>"), ","))


@plan("V12_group_means", f"""SELECT label, round(m[1] / l, 6) AS first, round(m[64] / l, 6) AS last FROM (SELECT label, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS l FROM (
 SELECT label, list(v ORDER BY d) AS m FROM (SELECT label, d, avg(x) AS v FROM (SELECT label, unnest(u) AS x, unnest(range(1, 65)) AS d FROM (
 SELECT label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings) a) b GROUP BY 1, 2) c GROUP BY 1) e) g""")
def v12(a: Archive):
    return V.mean_vectors(a.table("embeddings"), ["label"], "embedding", "v").select(
        "label", F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 63), 6).alias("last"))


ROUNDS = 120  # as many as SQL does in a few seconds
LENGTH = "sqrt(list_sum(list_transform({v}, lambda z: z * z)))"
# The same rounds in SQL: C times each axis, less its parts along the axes before it, scaled to length one.
AXES_SQL = f"""unit AS (SELECT vec_id, list_transform(e, lambda x: x / {LENGTH.format(v='e')}) AS u FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) t),
 cov AS (SELECT list(line ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS line FROM (SELECT i, j, covar_samp(u[i], u[j]) AS v FROM unit, range(1, 65) a(i), range(1, 65) b(j)
  GROUP BY i, j) x GROUP BY i) y),
 walk AS (SELECT 0 AS k, list_transform(range(1, @DIMS + 1), lambda j: list_transform(range(1, 65), lambda i: cos(CAST(i * j AS DOUBLE)))) AS q
  UNION ALL SELECT k + 1, list_reduce(list_transform(q, lambda v: [list_transform(c, lambda line: list_dot_product(line, v))]),
   lambda done, y: list_concat(done, list_transform([list_reduce(list_concat(y, done), lambda v, b: list_transform(range(1, 65), lambda i: v[i] - list_dot_product(b, v) * b[i]))],
    lambda w: list_transform(w, lambda x: x / {LENGTH.format(v='w')}))), CAST([] AS DOUBLE[][]))
  FROM walk, cov WHERE k < {ROUNDS}),
 axes AS (SELECT list_transform(q, lambda v: list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda z: abs(z)), list_max(list_transform(v, lambda z: abs(z))))]))) AS q
  FROM walk WHERE k = {ROUNDS})"""


def _axes_sql(dims: int) -> str:
    coords = ", ".join(f"round(list_dot_product(u, q[{i}]), 5) + 0.0 AS c{i}" for i in range(1, dims + 1))
    return f"WITH RECURSIVE {AXES_SQL.replace('@DIMS', str(dims))} SELECT vec_id AS id, {coords} FROM unit, axes"


def _projected(a: Archive, dims: int):
    return V.project(_vectors(a), "id", "vector", dims, ROUNDS).select("id", *[F.get("coords", i).alias(f"c{i + 1}") for i in range(dims)])


@plan("V11_project_2d", _axes_sql(2))
def v11(a: Archive):
    return _projected(a, 2)


@plan("V11_reduce_20d", _axes_sql(20))
def v11b(a: Archive):
    return _projected(a, 20)
