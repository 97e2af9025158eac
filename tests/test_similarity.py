import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.vectors import cosine_distance, l2_normalize, pack_f32, unpack_f32
from tapeloom.operators import neighbours as N
from tapeloom.operators import similarity as V


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(90, 5)).astype("f4")
    m[10] = m[20] = m[30]  # exact copies
    m[40] = 0
    rows = [(i, [float(x) for x in v], int(i % 7)) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, vector array<float>, song_id long").repartition(4).cache(), m.astype("f8")


def sims(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n == 0, 1, n)
    return np.round(u @ u.T, 9)


@pytest.mark.parametrize("pivots,block,same", [(1, 1000, True), (5, 40, False), (256, 13, True), (20, 1, True)])
def test_knn_does_not_depend_on_pivots_and_blocks(vectors, pivots, block, same):
    df, m = vectors
    got = V.knn(df, df if same else df.select("*"), 4, skip_self=True, pivots=pivots, block_rows=block).orderBy("query_id", "rank").collect()
    s = sims(m)
    want = []
    for q in range(90):
        order = sorted((i for i in range(90) if i != q), key=lambda i: (-s[q, i], i))[:4]
        want += [(q, i, r + 1) for r, i in enumerate(order)]
    assert [(r.query_id, r.neighbour_id, r["rank"]) for r in got] == want


@pytest.mark.parametrize("pivots,block", [(1, 1000), (30, 17), (4, 5)])
def test_match_songs(vectors, pivots, block):
    df, m = vectors
    s = sims(m)
    got = V.match_songs(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0").drop("song_id"), 3, pivots, block).orderBy("recording_id", "rank").collect()
    want = []
    for q in range(0, 90, 3):
        best = {}
        for i in range(90):
            if i % 3:
                if i % 7 not in best or s[q, i] > best[i % 7][0]:
                    best[i % 7] = (s[q, i], i)
        for r, (song, (_, ref)) in enumerate(sorted(best.items(), key=lambda kv: (-kv[1][0], kv[0]))[:3]):
            want.append((q, song, ref, r + 1))
    assert [(r.recording_id, r.song_id, r.nearest_recording_id, r["rank"]) for r in got] == want


def clusters(spark, n=3000, centres=40, dims=8, seed=6):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    m = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * 0.02
    m[: n // 3] = m[0]  # a third of all rows are copies
    return spark.createDataFrame([(i, [float(x) for x in v], int(i % 50)) for i, v in enumerate(m)], "id long, vector array<double>, song_id long"), m


def test_most_blocks_are_skipped_and_hot_rows_are_dealt_out(spark):
    """On vectors with structure few blocks are within a query's threshold; a third of copies does not make one large block."""
    df, m = clusters(spark)
    rows = df.select("id", F.col("id").alias("grp"), "vector")
    laid = N.lay_out(rows, pivots=64, block_rows=100)
    sizes = [r["count"] for r in laid.rows.groupBy("group").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 160 and int(laid.layout.parts.max()) >= 10
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -1)
    floor = np.sort(s, axis=1)[:, -5]
    near = laid.layout.within(u[1000:], floor[1000:])
    assert near.mean() < 0.12
    for i in range(0, 2000, 37):  # every row at least as good lies in a block that is met
        blocks = {int(b) for b in laid.layout.block_of[laid.layout.cells(u[s[1000 + i] >= floor[1000 + i]])]}
        assert blocks <= set(np.flatnonzero(near[i]).tolist())
    got = V.knn(df, df, 5, skip_self=True, pivots=64, block_rows=100).filter("query_id >= 900 and query_id < 1100").collect()
    want = {(q, int(i), r + 1) for q in range(900, 1100) for r, i in enumerate(np.lexsort((np.arange(3000), -s[q]))[:5])}
    assert {(r.query_id, r.neighbour_id, r["rank"]) for r in got} == want


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0, 1e-9]), (6, [float("inf"), 0.0]), (7, [-1.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {(r.query_id, r.neighbour_id, r.similarity) for r in V.knn(df, df, 9).collect()}
    unit = {1: (1.0, 0.0), 4: (0.0, 0.0), 5: (1.0, 1e-9), 7: (-1.0, 0.0)}
    assert got == {(a, b, round(x[0] * y[0] + x[1] * y[1], 9)) for a, x in unit.items() for b, y in unit.items()}
    assert V.knn(df.limit(0), df, 3).count() == 0 and V.knn(df, df.limit(0), 3).count() == 0


def kept(matches):
    return {(r.recording_id, r.song_id, r.nearest_recording_id, round(r.confidence, 9), r["rank"], r.status) for r in matches.collect()}


@pytest.mark.parametrize("pivots,block", [(16, 50), (3, 1000)])
def test_rematch_equals_a_full_match(spark, pivots, block):
    """A new song, changed vectors, lost, moved and newly labelled recordings: the updated table is that of matching all again."""
    df, m = clusters(spark, n=600, centres=25, seed=8)
    size = dict(pivots=pivots, block_rows=block)
    before = N.store(V.match_songs(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), 3, **size), "before")
    # 4: gone; 7: another vector; 10: another song; 12: now labelled with a new song; 15: another vector; 1000: new, of a new song; 1002: new
    turned = F.transform("vector", lambda x: -x)
    after = (
        df.filter("id <> 4").withColumn("vector", F.when(F.col("id").isin(7, 15), turned).otherwise(F.col("vector")))
        .withColumn("song_id", F.when(F.col("id") == 10, 33).when(F.col("id") == 12, 70).otherwise(F.col("song_id")))
        .unionByName(df.filter("id in (400, 402)").withColumn("song_id", F.lit(71).cast("long")).withColumn("id", F.col("id") + 600)))
    labeled = after.filter("id % 3 <> 0 or id in (12)")
    unlabeled = after.filter("id % 3 = 0 and id not in (12)")
    changed = spark.createDataFrame([(i,) for i in (4, 7, 10, 12, 15, 1000, 1002)], "id long")
    got = V.rematch_songs(before, labeled, unlabeled, changed, 3, **size)
    want = V.match_songs(labeled, unlabeled, 3, **size)
    assert kept(got) == kept(want) and got.columns == want.columns
    assert kept(want) != kept(before)
    assert kept(V.rematch_songs(before, df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), changed.limit(0), 3, **size)) == kept(before)


def test_rematch_reads_few_recordings_again(spark):
    """A new song that is near some recordings only: only their rows change, and all others keep what is stored."""
    df, m = clusters(spark, n=600, centres=25, seed=8)
    before = N.store(V.match_songs(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), 3), "before")
    new = df.filter("id = 401").select(F.lit(2000).cast("long").alias("id"), "vector", F.lit(99).cast("long").alias("song_id"))
    got = V.rematch_songs(before, df.filter("id % 3 <> 0").unionByName(new), df.filter("id % 3 = 0"), new.select("id"), 3)
    rows, old = kept(got), kept(before)
    touched = {r[0] for r in rows if r[1] == 99}
    assert touched and {r for r in rows if r[0] not in touched} == {r for r in old if r[0] not in touched}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    third = {r[0]: r[3] for r in old if r[4] == 3}
    assert touched == {i for i in range(0, 600, 3) if round(float(u[i] @ u[401]), 9) > third[i]}


def test_similar_segments_errors(spark, vectors):
    df = vectors[0].select(F.col("id").alias("segment_id"), F.when(F.col("id") != 5, F.col("vector")).alias("embedding"))
    with pytest.raises(LookupError):
        V.similar_segments(df, 1000)
    with pytest.raises(ValueError):
        V.similar_segments(df, 5)
    got = V.similar_segments(df, 10, 2).collect()
    assert [r.segment_id for r in got] == [20, 30]


def test_zero_vectors_and_codec(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([3.0, 4.0], [6.0, 8.0])], "a array<float>, b array<float>")
    rows = df.select(cosine_distance(F.col("a"), F.col("b")).alias("d"), l2_normalize(F.col("a")).alias("u"), unpack_f32(pack_f32("a")).alias("r")).collect()
    assert rows[0].d == 1.0 and abs(rows[1].d) < 1e-12
    assert rows[0].u == [0.0, 0.0] and np.allclose(rows[1].u, [0.6, 0.8]) and rows[1].r == [3.0, 4.0]


def test_projection_matches_the_covariance_axes(vectors):
    df, m = vectors
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = m / np.where(n == 0, 1, n)
    _, axes = np.linalg.eigh(np.cov(u.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    got = np.array([r.coords for r in V.project(df, "id", "vector", 2).orderBy("id").collect()])
    assert np.allclose(got, u @ axes, atol=2e-5)


def test_axes_of_repeated_and_constant_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.0] if i % 2 else [0.0, 1.0, 0.0]) for i in range(10)], "id long, vector array<double>")
    got = np.array([r.coords for r in V.project(df, "id", "vector", 2).orderBy("id").collect()])
    assert np.allclose(np.abs(got[:, 0]), np.sqrt(0.5), atol=1e-5) and got[0, 0] == -got[1, 0]
    with pytest.raises(ValueError):
        V.project(df, "id", "vector", 4)
    with pytest.raises(ValueError):
        V.project(df.limit(0), "id", "vector", 2)


def test_model_failures_stay_with_their_row(spark):
    def load():
        def model(xs):
            if any(x < 0 for x in xs):
                raise ValueError("negative")
            return [[float(x)] for x in xs]

        return model

    df = spark.createDataFrame([(i, -1 if i == 7 else i) for i in range(20)], "id long, x long")
    got = {r.id: r for r in V.apply_model(df, load, "x", "id", batch_size=4).collect()}
    assert got[7].error == "negative" and got[7].embedding is None
    assert all(got[i].error is None and got[i].embedding == [float(i)] for i in range(20) if i != 7)


@pytest.mark.parametrize("groups", [7, 8192])
def test_a_block_is_met_in_strips_of_bounded_size(groups):
    """However many rows a block has, a task holds a fixed number of similarities; the answer is that of the whole matrix."""
    rng = np.random.default_rng(8)
    left, right = rng.normal(size=(600, 4)), rng.normal(size=(8192, 4))
    def table(m, **more):
        return pa.table({"id": np.arange(len(m)), "vector": pa.array(list(m), pa.list_(pa.float64())), **more})

    queries, corpus = table(left), table(right, grp=np.arange(8192) % groups)
    tracemalloc.start()
    at, grp, ids, sim = N._meet(queries, corpus, 3, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    unit = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right)]
    whole = np.round(unit[0] @ unit[1].T, 9)
    for q in (0, 63, 64, 511, 512, 599):
        best = {}
        for i in np.lexsort((np.arange(8192), -whole[q])):
            best.setdefault(i % groups, i)
        want = sorted(best.items(), key=lambda x: (-whole[q, x[1]], x[0]))[:3]
        mine = at == q
        assert list(zip(grp[mine], ids[mine])) == want and np.allclose(sim[mine], [whole[q, i] for _, i in want], atol=2e-9)
