"""Registered queries against their SQL twins on the smallest tables; ALL_QUERIES=1 runs every one."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["J2_songs_with_takes", "S2_classify_sections", "A1_bin_frames", "A11_active_segments", "V5_match_songs", "Q4_passages",
          "Q8_passage_points", "G2_passage_types", "W_mixed_decisions", "W11_unique_slugs", "D6_blended_transitions"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_twin(spark, duck, name):
    df = queries()[name](spark, FOLDER)
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(names, cur.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0
