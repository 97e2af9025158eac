"""Segmentation against dense NumPy and plain Python versions written from the definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import sequence as Q
from tapeloom.operators.similarity import similarity_band, ssm_tiles

LENGTHS = {1: 45, 2: 1, 3: 2, 4: 7, 5: 30, 6: 5}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows, vectors, sid = [], {}, 0
    for rec, n in LENGTHS.items():
        base = rng.normal(size=(6, 6))
        m = np.array([base[i // 5 % 6] + 0.7 * rng.normal(size=6) for i in range(n)]).astype("f4")
        if n > 6:
            m[3] = 0  # a zero vector
        vectors[rec] = m
        for i in range(n):
            sid += 1
            rows.append((sid, rec, i * 10.0, i * 10.0 + 20, [float(x) for x in m[i]], i / 100, float(i)))
    df = spark.createDataFrame(rows, "segment_id long, recording_id long, start_seconds double, end_seconds double, embedding array<float>, mean_rms double, mean_spectral_centroid double")
    return df.repartition(5).cache(), vectors


def unit(m):
    n = np.linalg.norm(m.astype("f8"), axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def dense_novelty(m, k):
    u, h = unit(m), k // 2
    s = u @ u.T
    out = []
    for i in range(len(m)):
        r = range(max(0, i - h), min(len(m), i + h))
        out.append(sum(s[a, b] * (1 if (a < i) == (b < i) else -1) for a in r for b in r))
    return np.array(out)


def peaks_of(x, height, distance):
    """Local maxima with plateaus, then height, then spacing by falling height."""
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if x[p] >= height]
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("kernel,chunk", [(8, 4096), (8, 5), (4, 1), (12, 3)])
def test_novelty(spark, data, kernel, chunk):
    df, vectors = data
    got = Q.novelty_curve(Q.index_segments(df, 70.0), kernel, chunk).orderBy("recording_id", "idx").toPandas()
    for rec, m in vectors.items():
        assert np.allclose(got[got.recording_id == rec].novelty, dense_novelty(m, kernel), atol=1e-9)


@pytest.mark.parametrize("distance,threshold,chunk", [(1, 0.0, 4), (3, 0.0, 4), (5, -0.5, 3), (3, 0.5, 4096)])
def test_boundaries(spark, distance, threshold, chunk):
    rng = np.random.default_rng(2)
    curves = {r: np.round(rng.integers(0, 5, size=n) * 0.5, 9) for r, n in {1: 60, 2: 2, 3: 9, 4: 200}.items()}
    curves[5] = np.array([0, 1, 1, 1, 1, 1, 1, 1, 0, 2, 2, 3, 3, 3, 2.0])
    rows = [(r, r * 1000 + i, i, len(c), float(v)) for r, c in curves.items() for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "recording_id long, segment_id long, idx long, n long, novelty double")
    got = {}
    for r in Q.pick_boundaries(df, threshold, distance, chunk).collect():
        got.setdefault(r.recording_id, []).append(r.idx)
    for rec, c in curves.items():
        want = [] if len(c) < 3 else peaks_of(c, c.mean() + threshold * c.std(), distance)
        assert sorted(got.get(rec, [])) == want


def walk(dist, n, threshold, least, most):
    """Groups of row numbers, straight from the rule."""
    if n <= least:
        return [list(range(n))]
    groups, cur = [], [0]
    for i in range(1, n):
        if (dist[i] > threshold or len(cur) >= most) and len(cur) >= least:
            groups.append(cur)
            cur = [i]
        else:
            cur.append(i)
    groups.append(cur)
    if len(groups) > 1 and len(groups[-1]) < least:
        last = groups.pop()
        groups[-1] += last
    out = []
    for g in groups:
        if len(g) > most:
            at = int(np.argmax([round(dist[i], 9) for i in g[1:]])) + 1
            out += [g[:at], g[at:]]
        else:
            out.append(g)
    return out


@pytest.mark.parametrize("threshold,least,most,chunk", [
    (0.3, 3, 20, 4096), (0.9, 3, 6, 4), (0.9, 3, 6, 1), (1.2, 2, 5, 7), (0.2, 4, 3, 5), (5.0, 3, 4, 6), (0.8, 1, 2, 3)])
def test_change_points(spark, data, threshold, least, most, chunk):
    df, vectors = data
    dist_df = Q.step_distances(Q.index_segments(df), 4)
    got = Q.change_points(dist_df, threshold, least, most, chunk).orderBy("recording_id", "idx").toPandas()
    for rec, m in vectors.items():
        u = unit(m)
        zero = ~m.any(axis=1)
        dist = [0.0] + [1.0 if zero[i] or zero[i - 1] else 1 - float(u[i] @ u[i - 1]) for i in range(1, len(m))]
        want = walk(dist, len(m), threshold, least, most)
        mine = got[got.recording_id == rec].groupby("grp").idx.apply(list).tolist()
        assert mine == want, rec


def test_passages_partition_every_recording(spark, data):
    df, _ = data
    wide = df.select("*", *[F.lit("x").alias(c) for c in Q.METADATA])
    indexed = Q.index_segments(wide)
    curve = Q.silence_short(Q.novelty_curve(indexed))
    members = Q.assign_passages(indexed, Q.pick_boundaries(curve, 0.0), 4)
    passages = Q.extract_passages(members).toPandas().sort_values("passage_id")
    assert passages.passage_id.tolist() == list(range(len(passages)))
    assert passages.groupby("recording_id").segment_count.sum().to_dict() == LENGTHS
    assert passages[passages.recording_id.isin([2, 3, 6])].groupby("recording_id").size().tolist() == [1, 1, 1]
    lists = Q.passage_segment_lists(members, page=3).toPandas()
    assert lists.segment_ids.map(len).max() <= 3 and lists.segment_ids.map(len).sum() == sum(LENGTHS.values())


def test_tiles_equal_block_means_of_the_full_matrix(spark, data):
    df, vectors = data
    got = ssm_tiles(df, 10).toPandas()
    for rec, m in vectors.items():
        n, u = len(m), unit(m)
        f = n // 10 if n > 10 else 1
        t = n - n % f
        full = (u @ u.T)[:t, :t].reshape(t // f, f, t // f, f).mean(axis=(1, 3))
        want = np.floor(np.round(np.clip((np.round(full, 6) + 1) * 127.5, 0, 255), 6)).astype(int)
        mine = np.array(got[got.recording_id == rec].sort_values("tile").pixels.tolist())
        assert (mine == want).all()


def test_band_of_the_similarity_matrix(spark, data):
    df, vectors = data
    got = similarity_band(Q.index_segments(df), 4, chunk=3).orderBy("recording_id", "idx").collect()
    for r in got:
        u = unit(vectors[r.recording_id])
        want = [float(u[r.idx] @ u[j]) for j in range(r.idx + 1, min(r.idx + 5, len(u)))]
        assert np.allclose(r.cosines, want)
    assert len(got) == sum(LENGTHS.values())


def walked(peaks, distance):
    """The greedy walk over all peaks: highest first, the later one of two equal ones."""
    kept = set()
    for h, i in sorted(((h, i) for i, h in peaks), reverse=True):
        if not any((i + d) in kept for d in range(1 - distance, distance)):
            kept.add(i)
    return kept


@pytest.mark.parametrize("distance,chunk,most", [(3, 16, 64), (7, 10, 40), (30, 8, 100), (5, 4096, 1 << 22)])
def test_spacing_by_rounds_is_the_greedy_walk(spark, distance, chunk, most):
    """Ramps up and down over many stretches, plateaus, noise and a single peak; no stretch ever holds a whole recording."""
    rng = np.random.default_rng(distance)
    at = np.cumsum(rng.integers(2, 6, 400))
    shapes = {
        1: np.arange(400.0), 2: -np.arange(400.0), 3: np.zeros(400), 4: rng.integers(0, 4, 400).astype(float), 5: rng.normal(size=400),
        6: np.abs(np.arange(400.0) - 200), 7: -np.abs(np.arange(400.0) - 200),
    }
    rows = [(r, int(i), float(h)) for r, hs in shapes.items() for i, h in zip(at, hs)] + [(8, 5, 1.0)]
    df = spark.createDataFrame(rows, "recording_id long, idx long, height double").repartition(5)
    got = {(r.recording_id, r.idx) for r in Q.space_peaks(df, distance, chunk, most).collect()}
    want = {(k, i) for k in {r[0] for r in rows} for i in walked([(i, h) for r, i, h in rows if r == k], distance)}
    assert got == want


def test_a_chain_of_a_million_peaks(spark):
    """One recording, rising all the way: settled in stretches of 4096, 65 536 and 2^20 positions, never in one piece."""
    n = 1_000_000
    df = spark.range(n).selectExpr("1L AS recording_id", "id * 2 AS idx", "cast(id as double) AS height")
    got = Q.space_peaks(df, 3, 4096, 1 << 20).agg(F.count("*"), F.min("idx"), F.sum("idx")).first()
    want = range(2 * (n - 1), -1, -4)  # from the top, every second peak
    assert tuple(got) == (len(want), want[-1], sum(want))


def test_vectors_join_last_and_rows_stay_the_same(spark, tmp_path):
    from tapeloom.plans.base import Archive

    source = "/root/testdata/sf0.001"
    for name in ("orders", "events", "embeddings", "part"):
        table = spark.read.parquet(f"{source}/{name}.parquet")
        key = table.columns[0]
        if name != "events":  # keys that come twice, and none
            table = table.unionByName(table.filter(f"{key} % 5 = 0")).unionByName(table.limit(3).withColumn(key, F.lit(None).cast(table.schema[key].dataType)))
        if name == "embeddings":
            table = table.withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.col("embedding")))
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    a = Archive(spark, str(tmp_path))
    assert "embedding" not in a.placed.columns
    numbered = a.with_vectors(Q.index_segments(a.placed))
    shown = ["segment_id", "recording_id", "start_seconds", "song_title", "embedding"]
    count = lambda df: {(*r[:4], tuple(r[4])): r[5] for r in df.groupBy(*shown).count().collect()}
    assert count(numbered) == count(a.wide) and numbered.count() > 0
