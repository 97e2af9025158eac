"""The near-duplicate stage of the pipeline on planted copies, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import near_text, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def plain_kept(rows):
    rows = sorted(rows)
    sets, parent = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            both = len(sets[i] & sets[j])
            if both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [rows[i][0] for i in range(len(rows)) if find(i) == i]


def planted(seed=5):
    r, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    common = " ".join(r.choice(words) for _ in range(30))
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.choice([4, 30, 100, 300]))]
        rows.append(" ".join(base))
        for edits in (1, 2, 3, 5, 7, 9, 12):  # a changed word changes up to five shingles
            copy = list(base)
            for at in r.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    rows += [f"{common} {' '.join(r.choice(words) for _ in range(k))}" for k in (3, 4, 5, 6, 7, 8, 60, 60)] * 2
    rows += ["", "  ", None, rows[0].upper(), "a b", "A  b", "a b c"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_stage_drops_planted_copies(spark):
    base = [f"v{i}" for i in range(104)]  # 100 shingles
    rows = [(0, " ".join(base))]
    for i, k in enumerate((1, 2, 5, 11, 20), 1):  # k new words at the end: similarity (100 - k) / (100 + k), or 100 / (100 + k)
        rows += [(i, " ".join(base + [f"n{i}_{j}" for j in range(k)])), (10 + i, " ".join(base[:-k] + [f"m{i}_{j}" for j in range(k)]))]
    rows.append((99, " ".join(base + [f"o{j}" for j in range(26)])))  # 100 / 126
    got = {r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()}
    assert got == set(plain_kept(rows)) and {0, 99} <= got and not got & {1, 2, 3, 4, 5, 11, 12, 13, 14}


@pytest.mark.parametrize("counters", [1 << 22, 1 << 16])
def test_stage_equals_all_pairs(spark, monkeypatch, counters):
    monkeypatch.setattr(near_text, "COUNTERS", counters)
    rows = planted()
    got = corpus_pipeline.near(spark, frame(spark, rows), "")
    assert got.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)


def test_stage_on_many_copies_of_one_text(spark):
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i % 60] + [f"y{i}"] + base[i % 60 + 1:])) for i in range(300)]  # about 0.8 and below, each to each
    rows.append((1000, " ".join(base)))
    got = corpus_pipeline.near(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == plain_kept(rows)
    assert corpus_pipeline.near(spark, frame(spark, rows).where(F.lit(False)), "").count() == 0


def test_stage_links_by_simhash_too(spark):
    often = " ".join(["one sentence that comes again and again in these texts here"] * 80)  # few different shingles, most of the weight

    def tail(k, n):
        return " ".join(f"t{k}_{i}" for i in range(n))

    a, b = f"{often} {tail(1, 30)}", f"{often} {tail(2, 30)}"
    c = f"{often} {often} {tail(2, 30)}"  # the shingles of b
    rows = [(4, a), (5, b), (6, c), (7, tail(3, 60)), (8, tail(4, 60))]
    sets = [plain_set(t) for t in (a, b)]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    assert bin(simhash.fingerprint(a) ^ simhash.fingerprint(b)).count("1") <= 3
    name, stage = corpus_pipeline.STAGES[2]
    assert name == "SimHash near-dedup"
    assert sorted(r["doc_id"] for r in stage(spark, frame(spark, rows), "").collect()) == [4, 7, 8]
    assert stage(spark, frame(spark, rows).where(F.lit(False)), "").count() == 0
