"""Importance resampling against a plain version that hashes every feature by itself."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import resampling
from tapeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(rows, target):
    s = collections.Counter(bucket(f) for _, t in rows for f in features(t)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc, text in rows:
        n_words, own = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    fit = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[:5 * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_against_plain(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    target = [t for t, in duckdb.sql(f"SELECT text FROM '{FOLDER}/benchmark.parquet'").fetchall()]
    got = found(QUERIES["op12_importance_sample"](spark, FOLDER))
    assert got == plain(rows, target) and any(r[4] for r in got)


def test_odd_rows(spark, monkeypatch):
    """Nulls, white space, words longer than the table, equal rows, ties and clashing columns, in small batches."""
    monkeypatch.setattr(resampling, "BATCH_SPANS", 1000)
    rng = random.Random(3)
    some = ["word", "Élan", "x9", "é" * 40, "long" * 100, "UPPER", "naïve", "日本語"]
    made = [(i, " ,".join(rng.choices(some, k=rng.randint(1, 60)))) for i in range(150)]
    rows = made + [(None, made[0][1]), (None, None), (3, None), (4, ""), (5, " \t\n--"), (6, "z" * 70_000), (7, "one"), *[made[9]] * 40,
                   (8, "w " * 3000)]
    columns = "doc_id long, text string, score string, weight string, rank int, n_words string, _at string, _slot int"
    docs = spark.createDataFrame([(i, t, "x", "x", 1, "x", "x", 1) for i, t in rows], columns).repartition(5)
    target = ["word Élan x9", None, "", "long" * 100 + " upper"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert found(resampling.resample(docs, items)) == plain(rows, target)
    assert found(resampling.resample(docs, items.limit(0))) == plain(rows, [])
    assert resampling.resample(docs.limit(0), items).count() == 0


def test_equal_rows_are_split_and_ranked_once(spark, tmp_path):
    """A third of all rows are one row: ranks are still 1 to the draw, in tasks of their own."""
    spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 3 = 0, 50L, id % 100) AS score").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = resampling.ranked(rows, "score", 1800, ["doc_id"]).where("rank IS NOT NULL").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1801))
    assert [(-r["score"], r["doc_id"]) for r in got] == sorted((-r["score"], r["doc_id"]) for r in rows.collect())[:1800]


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.lists(st.tuples(st.integers(0, 399), st.integers(1, 400)), min_size=1, max_size=20),
       st.sampled_from([1, 2, 7, 64]))
def test_checksums(data, spans, reach):
    spans = [(a % len(data), min(len(data), a % len(data) + n)) for a, n in spans]
    table = resampling.PositionTable(reach)
    got = table.crc(np.frombuffer(data, np.uint8), *(np.array(c) for c in zip(*spans)))
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]


@pytest.mark.parametrize("size", [63, 64, 65, 128, 129, 100_001])
def test_long_spans(size):
    data = bytes(random.Random(size).randbytes(size))
    got = resampling.PositionTable().crc(np.frombuffer(data, np.uint8), np.array([0]), np.array([size]))
    assert got[0] == zlib.crc32(data)
