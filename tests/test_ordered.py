"""Chunked helpers equal plain windows, whatever the chunk width."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ordered as O
from tapeloom.operators.quantiles import exact_quantiles, values_at


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out = []
    for key, n in [(1, 57), (2, 1), (3, 23)]:
        t = sorted(rnd.sample(range(300), n))
        out += [(key, float(x), i + key * 1000, rnd.choice([None, 1, 2, 5])) for i, x in enumerate(t)]
    return pd.DataFrame(out, columns=["key", "t", "id", "v"]).astype({"v": "Int64"})


@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_helpers_match_pandas(spark, rows, width):
    df = spark.createDataFrame([(int(k), float(t), int(i), None if pd.isna(v) else int(v)) for k, t, i, v in rows.itertuples(index=False)], "key long, t double, id long, v long")
    got = O.ordinal(df, ["key"], "t", "id", width, "idx", "n")
    got = O.running_total(got, ["key"], "t", "id", F.coalesce("v", F.lit(0)), width, "run")
    got = O.neighbour(got, ["key"], "t", "id", ["id"], width, "prev")
    got = O.neighbour(got, ["key"], "t", "id", ["id"], width, "next", ahead=True)
    got = O.carry_forward(got, ["key"], "t", "id", F.col("v"), width, "held")
    pdf = got.select("id", "idx", "n", "run", F.col("prev.id").alias("prev"), F.col("next.id").alias("next"), "held").toPandas().set_index("id").sort_index()
    g = rows.sort_values(["key", "t"]).groupby("key")
    want = pd.DataFrame({
        "idx": g.cumcount(), "n": g["id"].transform("size"), "run": rows["v"].fillna(0).groupby(rows["key"]).cumsum(),
        "prev": g["id"].shift(1), "next": g["id"].shift(-1), "held": g["v"].ffill(),
    }).set_index(rows["id"]).sort_index()
    for c in want:
        assert [None if pd.isna(x) else int(x) for x in pdf[c]] == [None if pd.isna(x) else int(x) for x in want[c]], c


@pytest.mark.parametrize("size", [1, 4, 100])
def test_adjacent_crosses_chunk_edges(spark, size):
    df = spark.range(30).select((F.col("id") % 2).alias("key"), F.floor(F.col("id") / 2).alias("idx"), "id")
    got = O.adjacent(df, ["key"], "idx", ["id"], "p", size=size)
    got = O.adjacent(got, ["key"], "idx", ["id"], "q", ahead=True, size=size)
    for r in got.collect():
        assert (r.p.id if r.p else None) == (r.id - 2 if r.idx > 0 else None)
        assert (r.q.id if r.q else None) == (r.id + 2 if r.idx < 14 else None)


def test_running_total_from_smaller_table(spark):
    df = spark.range(40).select(F.lit(1).alias("key"), F.col("id").alias("idx"), F.when(F.col("id").isin(3, 17, 39), 1).alias("cut"))
    cuts = df.filter("cut is not null")
    got = O.running_total(df, ["key"], "idx", "idx", F.coalesce("cut", F.lit(0)), 5.0, "grp", cuts).orderBy("idx").collect()
    assert [r.grp for r in got] == [sum(c <= i for c in (3, 17, 39)) for i in range(40)]


def test_consecutive_ids(spark):
    df = spark.createDataFrame([(k, k % 4 + 1) for k in range(0, 900, 7)], "recording_id long, c long")
    got = {r.recording_id: r.first for r in O.consecutive_ids(df, "recording_id", "c", "first", size=4).collect()}
    at = 0
    for k in range(0, 900, 7):
        assert got[k] == at
        at += k % 4 + 1


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = [(1, float(x)) for x in rng.lognormal(size=501)] + [(2, 4.0)] * 7 + [(3, None), (3, 2.5)]
    df = spark.createDataFrame(data, "k long, x double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "x", {"a": 0.0, "b": 0.25, "c": 0.995, "d": 1.0}).collect()}
    for k in (1, 2, 3):
        xs = [x for kk, x in data if kk == k and x is not None]
        assert np.allclose([got[k][c] for c in "abcd"], np.percentile(xs, [0, 25, 99.5, 100]))
    # Large groups, with copies and far outliers, go through the sketch.
    big = np.r_[rng.normal(size=60000), np.full(30000, 0.25), 1e30, -1e18]
    one = exact_quantiles(spark.createDataFrame([(float(x),) for x in big], "x double").repartition(6), [], "x", {"a": 0.0, "b": 0.5, "c": 0.7, "d": 0.995, "e": 1.0}).head()
    assert np.allclose([one[c] for c in "abcde"], np.percentile(big, [0, 50, 70, 99.5, 100]))
    at = values_at(df.filter("k = 1"), ["k"], "x", {"p": F.floor(F.col("_n") * F.lit(0.9))}).head().p
    assert at == sorted(x for k, x in data if k == 1)[int(501 * 0.9)]


@pytest.mark.parametrize("steps", [256, 1 << 16])
def test_quantiles_of_a_key_with_all_rows(spark, steps):
    """Values of every size and sign, copies, and a thick cluster that takes several rounds; nothing but counts is shuffled."""
    rng = np.random.default_rng(12)
    tight = 1.0 + rng.integers(0, 1 << 20, 20_000) * 2.0 ** -50
    xs = np.r_[tight, rng.normal(size=5000) * 10.0 ** rng.integers(-300, 300, 5000), np.zeros(500), -0.0, 1e308, -1e308, np.inf, -np.inf, 5e-324]
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(xs)], "x double").repartition(7)
    probs = {f"p{i}": i / 40 for i in range(1, 40)}
    got = exact_quantiles(df, [], "x", probs, steps).head()
    want = np.percentile(xs, [100 * p for p in probs.values()])
    assert all(got[n] == pytest.approx(w, rel=1e-12, abs=0) for n, w in zip(probs, want))
    ends = values_at(df.withColumn("k", F.lit(1)), ["k"], "x", {"a": F.lit(0), "z": F.col("_n") - 1}, steps).head()
    assert (ends.a, ends.z) == (-np.inf, np.inf)


def test_a_position_that_is_missed_raises(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, None), (None, 4.0)], "k long, x double")
    assert [tuple(r) for r in values_at(df, ["k"], "x", {"a": F.lit(1)}).collect()] == [(1, 2.0)]
    with pytest.raises(Exception, match="outside the group"):
        values_at(df, ["k"], "x", {"a": F.col("_n")}).collect()
    with pytest.raises(ValueError, match="still open"):
        exact_quantiles(spark.range(5000).selectExpr("1.0 + id * pow(2D, -50) AS x"), [], "x", {"a": 0.5}, steps=2).collect()
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (float("nan"),)], "x double")
    row = exact_quantiles(nan, [], "x", {"a": 0.0, "z": 1.0}).head()
    assert row.a == 1.0 and np.isnan(row.z)


def test_ids_run_on_over_hashed_keys(spark):
    """Keys of 64 bits anywhere, negative ones too: no task orders all of them, and the ids are those of one sorted pass."""
    df = spark.range(30_000).select(F.xxhash64("id").alias("recording_id"), (F.col("id") % 5).alias("c"))
    out = O.consecutive_ids(df, "recording_id", "c", "first", size=512)
    got = {r.recording_id: r.first for r in out.collect()}
    at = 0
    for r in sorted(df.collect()):
        assert got[r.recording_id] == at
        at += r.c
    assert O.consecutive_ids(df.limit(0), "recording_id", "c", "first").count() == 0


def test_chunks_of_a_hot_key_leave_its_task(spark):
    """Rows that lie by key, as after a join without broadcast: windows must still run per chunk, in several tasks."""
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").cast("double").alias("t"), "id")
        by_key = rows.repartition("k")
        out = O.ordinal(by_key, ["k"], "t", "id", 4096.0)
        hot = out.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).agg(
            F.count(F.lit(1)).alias("n"), F.max("idx").alias("last")).collect()
        assert len(hot) > 1 and sum(r.n for r in hot) == 13_334 and max(r.last for r in hot) == 13_333
        for made in (O.running_total(by_key, ["k"], "t", "id", F.lit(1), 4096.0, "s"), O.neighbour(by_key, ["k"], "t", "id", ["id"], 4096.0, "n"),
                     O.carry_forward(by_key, ["k"], "t", "id", F.col("id"), 4096.0, "c"), O.adjacent(out, ["k"], "idx", ["id"], "a")):
            plan = made._jdf.queryExecution().executedPlan().toString()
            assert "_chunk" in plan and "REPARTITION_BY_COL" in plan
    finally:
        for name in off:
            spark.conf.unset(name)
