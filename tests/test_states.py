"""Titles that are nearly equal, against comparing all pairs."""

import random

import pytest

from tapeloom.operators import states as D


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_likely_copies_equal_all_pairs(spark, distance):
    """Short and long titles, repeated grams, one letter alphabets, equal and empty titles, several dates."""
    rng = random.Random(distance)
    titles = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for alphabet in ("ab", "abc", "é日a", "abcdefgh") for _ in range(25)]
    titles += ["a" * n for n in range(12)] + ["Tema de Maig", "tema de maig", "tema de maig 2", "tmea de maig"]
    rows = [(rng.choice(["l", "r", "x"]), rng.choice(["2001-01-01", "2001-01-02"]), t) for t in titles for _ in range(2)]
    items = spark.createDataFrame(rows + [("l", None, "a"), ("r", "2001-01-01", None)], "section string, date string, title string")
    got = {tuple(r) for r in D.likely_copies(items, ("l", "r"), distance).select("date", "left_title", "right_title", "edits").collect()}
    want = {(d, a.lower(), b.lower(), n) for s, d, a in rows if s == "l" for z, e, b in rows if z == "r" and e == d
            if (n := edits(a.lower(), b.lower())) <= distance}
    assert got == want


def test_what_all_titles_share_brings_nobody_together(spark):
    """400 by 400 titles on one date that differ in their number only: few pairs are compared and no match is lost."""
    rng = random.Random(4)
    left = [f"tema numero {rng.randrange(10 ** 6):06d}" for _ in range(400)]
    right = [f"tema numero {rng.randrange(10 ** 6):06d}" for _ in range(380)] + [t[:14] + "x" + t[15:] for t in left[:20]]
    rows = [(0, "d", t) for t in set(left)] + [(1, "d", t) for t in set(right)]
    titles = spark.createDataFrame(rows, "side int, date string, low string")
    pairs = {(r.left_title, r.right_title) for r in D.copy_candidates(titles, 2).collect()}
    assert len(pairs) < 0.05 * 400 * 400
    assert {(a, b) for a in left for b in right if edits(a, b) <= 2} <= pairs


def test_first_vectors_of_clusters_are_found_without_grouping_vectors(spark):
    import hashlib

    vectors = [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]
    rows = [(i, vectors[0] if i % 50 else vectors[1 + i % 100 // 50]) for i in range(500)]
    rows += [(i, vectors[0]) for i in range(500)]  # ids that come twice
    df = spark.createDataFrame(rows, "segment_id long, u array<double>")
    first = {}
    for i, u in rows:
        h = hashlib.md5(str(i).encode()).hexdigest()
        first[tuple(u)] = min(first.get(tuple(u), h), h)
    want = [list(u) for u, _ in sorted(first.items(), key=lambda x: x[1])]
    assert D._first_vectors(df, 2) == want[:2] and D._first_vectors(df, 8) == want
    assert D._first_vectors(df.limit(0), 8) == []
