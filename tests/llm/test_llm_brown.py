"""The class model: its counts and base against plain versions, its gains against whole likelihoods, its scores on held-out texts."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tapeloom.llm import brown
from tapeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def left_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def plain_base(rows):
    tokens = [(doc, left_out(doc), [*WORD.findall((text or "").translate(LOWER)), None]) for doc, text in rows]
    counts = collections.Counter(t for _, out, own in tokens if not out for t in own)
    total, different = sum(counts.values()), len(counts)
    below = total + 0.5 * (different + 1)
    return sorted(((doc, out, len(own), sum(counts[t] > 0 for t in own), total,
                    round(math.fsum(math.log10((counts[t] + 0.5) / below) for t in own), 6)) for doc, out, own in tokens), key=str)


def base(df):
    rows = df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score").collect()
    return sorted(((*r[:5], round(r[5], 6)) for r in rows), key=str)


def test_query_against_plain(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = QUERIES["op13_class_scores"](spark, FOLDER).persist()
    assert base(got) == plain_base(rows)
    sums = {r["held_out"]: r for r in got.groupBy("held_out").agg({"score": "sum", "base_score": "sum"}).collect()}
    assert set(sums) == {True, False}
    for r in sums.values():
        assert r["sum(base_score)"] < r["sum(score)"] < 0  # the classes tell more than frequencies alone, also on held-out texts
    got.unpersist()


def test_odd_rows(spark):
    rows = [(None, "a b a"), (None, None), (1, ""), (2, " \n\t"), (2, "a b A É é"), (3, "only" * 5000), (4, "w " * 5000), *[(9, "a b")] * 30,
            *[(i, f"new{i} a b" if left_out(i) else "a b c") for i in range(20, 60)]]
    columns = "doc_id long, text string, held_out string, row int, units string, word string, times int, n string"
    docs = spark.createDataFrame([(i, t, "x", 1, "x", "x", 1, "x") for i, t in rows], columns)
    for share in (brown.COUNT_SHARE, 0.01):  # with and without words that only the join knows
        got = brown.score_texts(docs, rounds=2, count_share=share, unit_share=max(share, brown.UNIT_SHARE))
        assert base(got) == plain_base(rows)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["perplexity"] > 1 for r in got.collect())
    assert brown.score_texts(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "x y") for i in range(50) if left_out(i)], "doc_id long, text string")  # nothing to learn from
    assert base(brown.score_texts(only)) == plain_base([(i, "x y") for i in range(50) if left_out(i)])
    with pytest.raises(ValueError):
        brown.score_texts(docs, unit_share=2.0 ** -16)


def grammar(docs, seed=1):
    """Texts of three kinds of words in a fixed turn; which word of a kind stands is chance."""
    rng = random.Random(seed)
    kinds = [[f"{k}{i:03d}" for i in range(60)] for k in ("den", "ver", "adj")]
    return [(i, " ".join(rng.choice(kinds[j % 3]) for j in range(rng.randint(5, 40)))) for i in range(docs)]


def test_classes_of_a_grammar(spark):
    """Exchange finds the kinds: words of one class are of one kind, likelihood rises, and held-out texts gain about log10(3) a word."""
    rows = grammar(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = brown.score_texts(docs, classes=7).collect()
    assert base(brown.score_texts(docs, classes=7)) == plain_base(rows)
    held = [r for r in got if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.4
    numbered = docs.withColumn("held_out", brown.held_out()).withColumn("row", docs.doc_id)
    counts = brown.token_counts(numbered)
    vocabulary = brown.frequent(counts, sum(len(t.split()) + 1 for _, t in rows))
    seqs = brown.store(brown.sequences(numbered, vocabulary, len(rows)), "seqs")
    classes, n, seen = brown.exchange(seqs, vocabulary.units, 7)
    assert max(seen) > seen[0] and n.sum() == sum(len(t.split()) + 1 for _, t in rows)
    kinds = collections.defaultdict(set)
    for i, w in enumerate(vocabulary.words):
        kinds[classes[i + 1]].add(w[:3])
    assert all(len(v) == 1 for v in kinds.values())


def test_contexts_and_transitions(spark):
    """Sums over tasks equal a walk over all texts."""
    rng = np.random.default_rng(5)
    classes = np.append(0, rng.integers(1, 5, 11)).astype(np.int32)
    lines = [rng.integers(1, 12, rng.integers(0, 30)) for _ in range(80)]
    df = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in lines], "units binary").repartition(5)
    want, steps = np.zeros((12, 11), np.int64), np.zeros((5, 5), np.int64)
    for x in lines:
        line = [0, *x.tolist(), 0]
        for a, b in zip(line, line[1:]):
            want[b, classes[a]] += 1
            want[a, 5 + classes[b]] += 1
            want[a, 10] += a == b
            steps[classes[a], classes[b]] += 1
    context = brown.contexts(df, classes, 5)
    got = np.zeros_like(want)
    for r in context.collect():
        got[r["unit"]] += np.frombuffer(r["counts"], "<i8")
    assert (got == want).all() and (brown.transitions(context, classes, 5) == steps).all()


def test_gain_is_exact():
    """The gain of a move is the difference of the likelihoods before and after it."""
    rng = np.random.default_rng(11)
    pairs = rng.integers(0, 4, (9, 9)) * rng.integers(0, 3, (9, 9))  # unit after unit
    classes = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2])

    def table(of):
        n = np.zeros((4, 4), np.int64)
        np.add.at(n, (of[:, None].repeat(9, 1), of[None, :].repeat(9, 0)), pairs)
        return n

    for unit in range(1, 9):
        before = np.bincount(classes, weights=pairs[:, unit], minlength=4).astype(np.int64)
        after = np.bincount(classes, weights=pairs[unit], minlength=4).astype(np.int64)
        best, gain = brown.best_move(table(classes), int(classes[unit]), before, after, int(pairs[unit, unit]))
        others = {c: brown.likelihood(table(np.where(np.arange(9) == unit, c, classes))) for c in (1, 2, 3)}
        assert gain == pytest.approx(max(others.values()) - others[int(classes[unit])], abs=1e-9)
        assert others[best] == pytest.approx(max(others.values()), abs=1e-9)


def test_probabilities_add_up():
    """Over all words of all classes and one unseen word of each class, every state gives one."""
    classes, sizes = np.array([0, 1, 2, 1, 2, 3]), np.array([1, 1, 1, 3, 2, 0])
    n = np.array([[0, 5, 3, 0], [4, 2, 9, 0], [4, 8, 1, 0], [0, 0, 0, 0]])
    made = brown.model(classes, n, sizes)
    tokens, different = n.sum(axis=0), np.bincount(classes, weights=sizes, minlength=4)
    words = tokens + 0.5 * (different + 1)  # smoothed counts of a class's words and the unseen one
    for state in range(4):
        assert sum(10 ** made.step[state, c] * words[c] / 10 ** made.mass[c] for c in range(4)) == pytest.approx(1)
