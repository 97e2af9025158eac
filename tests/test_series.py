import numpy as np
from pyspark.sql import functions as F

from tapeloom.operators import lookups as J
from tapeloom.operators import series as A


def test_segments_of_25_seconds(spark):
    recs = spark.createDataFrame([(1, 25.0), (2, None), (3, 10.0), (4, 0.0)], "id long, duration_seconds double")
    got = A.make_segments(recs).orderBy("recording_id", "start_seconds").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 20.0), (1, 10.0, 25.0), (1, 20.0, 25.0), (3, 0.0, 10.0)]
    assert [r.recording_id for r in A.missing_duration(recs).collect()] == [2]


def test_bins_without_frames_are_zero(spark):
    frames = spark.createDataFrame([(1, 0.2, 2.0), (1, 0.7, 4.0), (1, 2.1, 5.0), (1, 9.0, 7.0)], "k long, t double, v double")
    n = spark.createDataFrame([(1, 4)], "k long, n long")
    assert [r.value for r in A.bin_frames(frames, "k", "t", "v", n).orderBy("second").collect()] == [3.0, 0.0, 5.0, 7.0]


def test_segment_stats_follow_numpy(spark):
    x = np.random.default_rng(1).random(47)
    seconds = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording_id long, second long, value double")
    spans = [(1, 1, 0.0, 20.0), (2, 1, 10.0, 30.0), (3, 1, 33.5, 46.2), (4, 1, 40.0, 60.0), (5, 1, 60.0, 80.0)]
    segs = spark.createDataFrame(spans, "id long, recording_id long, start_seconds double, end_seconds double")
    got = {r.segment_id: r for r in A.segment_stats(seconds, segs).collect()}
    assert set(got) == {1, 2, 3, 4}
    for sid, _, s, e in spans[:4]:
        part = x[int(s):min(int(np.ceil(e)), 47)]
        assert np.allclose([got[sid]["mean"], got[sid].variance], [part.mean(), part.var()])


def test_silences_and_active_segments(spark):
    quiet = set(range(0, 6)) | set(range(50, 53)) | set(range(60, 70)) | set(range(115, 120))
    levels = spark.createDataFrame([(1, float(t), -60.0 if t in quiet else -10.0) for t in range(120)], "k long, t double, level double")
    silences = A.silence_intervals(levels, "k", "t", "level")
    assert sorted((r.start, r.end) for r in silences.collect()) == [(0.0, 6.0), (60.0, 70.0), (115.0, 120.0)]
    totals = spark.createDataFrame([(1, 120.0), (2, 45.0), (3, 20.0)], "k long, total double")
    got = sorted(tuple(r) for r in A.active_segments(silences, totals, "k").collect())
    assert got == [(1, 6.0, 60.0), (1, 70.0, 115.0), (2, 0.0, 45.0)]


def test_gain(spark):
    x = np.random.default_rng(7).normal(size=500)
    rows = [(1, i, float(v)) for i, v in enumerate(x)] + [(2, i, 0.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    got = {r.k: r.gain for r in A.norm_gain(df, "k", "i", "v").collect()}
    assert np.isclose(got[1], 0.95 / np.percentile(np.abs(x[::10]), 99.5)) and got[2] == 1.0


def test_small_array_operators(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    head, tail = A.series_cut(F.col("v"), F.lit(2.9))
    r = df.select(head.alias("h"), tail.alias("t"), A.pad_or_truncate(F.col("v"), 5, -100.0).alias("p"), A.pad_or_truncate(F.col("v"), 2, 0.0).alias("q")).head()
    assert (r.h, r.t, r.p, r.q) == ([1.0, 2.0], [3.0], [1.0, 2.0, 3.0, -100.0, -100.0], [1.0, 2.0])


def test_nearest_point_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    p = np.vstack([rng.random((150, 2)) * 10, 5 + rng.random((150, 2)) * 0.01, [[1, 1], [1, 1]]])
    q = np.vstack([rng.random((80, 2)) * 10, 5 + rng.random((40, 2)) * 0.02])
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double")
    qs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "id long, x double, y double")
    got = {r.id: r.point_id for r in J.nearest_point(qs, pts, 0.5).collect()}
    d = np.round(np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1)), 9)
    assert got == {i: int(d[i].argmin()) for i in range(len(q)) if d[i].min() < 0.5}


def test_nearest_point_in_a_dense_cell(spark):
    """100 000 points in one cell of the coarse grid, the queries far from most of them: cells are cut, few rows are joined, and the answers are exact."""
    rng = np.random.default_rng(9)
    xy = np.round(np.r_[rng.random((50_000, 2)) * 0.01, 0.5 + rng.random((49_990, 2)) * 0.4, np.full((10, 2), 0.25)], 6)
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double").repartition(6)
    at = np.r_[rng.random((300, 2)), np.full((50, 2), 0.2), [[0.25, 0.25], [-0.4, 0.3], [5.0, 5.0], [0.0, 1.99]]]
    qs = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(999, None, 1.0), (998, float("nan"), 0.1)], "id long, x double, y double")
    got = {r.id: (r.point_id, r.distance) for r in J.nearest_point(qs, pts, 1.0).collect()}
    for i, q in enumerate(at):
        d = np.round(np.sqrt(((xy - q) ** 2).sum(axis=1)), 9)
        assert got.get(i) == ((int(d.argmin()), d.min()) if d.min() < 1.0 else None)
    spots = pts.groupBy("x", "y").agg(F.min("id").alias("point_id")).selectExpr("point_id", "x AS _x", "y AS _y")
    levels, leaves = J.grid_tree(spots, 1.0, 64)
    assert len(levels) > 3 and leaves.groupBy("_level", "_cx", "_cy").count().filter("count > 64").count() == 0
    assert leaves.count() == spots.count()
    places = qs.filter("id < 998").selectExpr("id AS _q", "x", "y")
    joined = J.cells_in_reach(places, levels, 1.0, 64).join(leaves, ["_level", "_cx", "_cy"])
    assert joined.count() < 354 * 64 * 12  # of 35 million pairs in the coarse cell
