"""Spelling groups against a plain version that compares all pairs of words."""

import collections
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapeloom.llm import spelling
from tapeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))




def plain(rows, letters=5, least=3, factor=2):
    counts = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= letters and c >= least}
    near = collections.defaultdict(set)  # by words with a hole, each candidate compared
    met = collections.defaultdict(list)
    for w in n:
        met[w].append(w)
        for cut in {w[:i] + w[i + 1:] for i in range(len(w))}:
            met[cut].append(w)
    for group in met.values():
        for a in group:
            near[a].update(b for b in group if is_near(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_against_plain(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    got = found(QUERIES["op11_spelling_variants"](spark, FOLDER))
    assert got == plain(rows) and any(r[1] for r in got)


def test_odd_rows(spark):
    words = ("casas " * 3 + "casaé " * 6 + "casaas " * 12 + "caasas " * 12 + "aaaaaa " * 4 + "aaaaa " * 9 + "caso× " * 3 +
             "CASAS-Casas " + "x" * 3000 + " " + "x" * 2999 + " ") * 3
    rows = [(None, words), (1, words), (1, words), (2, ""), (3, None), (-4, "Casas casaz " * 40), (5, "word1word2_word3 " * 9)]
    columns = "doc_id long, text string, word string, n int, id string, path string"
    docs = spark.createDataFrame([(i, t, "z", 1, "z", "z") for i, t in rows], columns)
    assert found(spelling.group_spellings(docs)) == plain(rows)
    assert found(spelling.group_spellings(docs, least_letters=1, least_count=1)) == plain(rows, letters=1, least=1)
    assert spelling.group_spellings(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_spellings(docs, factor=1)


def test_chain_of_forms_and_many_stretches(spark, monkeypatch):
    """Seven steps from the rarest word to its root, and prefixes that go on over many stretches of a trie."""
    monkeypatch.setattr(spelling, "STRETCH", 5)
    chain = ["abcdefgh", "abcdefg", "abcdef", "abcde", "abcdX".lower(), "abcyx", "abzyx", "awzyx"]
    text = " ".join(" ".join([w] * (3 * 2 ** k)) for k, w in enumerate(chain))
    more = " ".join(f"abc{x}{y}{z} " * 3 for x in "abcdef" for y in "pqrst" for z in "mno")
    rows = [(7, text), (8, more), (9, more.replace("abc", "abb"))]
    assert found(spelling.group_spellings(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_trie_numbers(spark):
    """Equal prefixes have equal numbers and different ones different numbers, however the words are cut."""
    words = sorted({f"{a}{b}" for a in ("pre", "prefix", "p", "") for b in ("a", "ab", "abc", "b", "fix", "fixed", "é", "z" * 50)})
    paths = spelling.trie_paths(spark.createDataFrame([(w,) for w in words], "word string"), 7).collect()
    assert sorted(r["word"] for r in paths) == words
    number = {}
    for r in paths:
        assert len(r["path"]) == len(r["word"])
        for i, x in enumerate(r["path"]):
            assert number.setdefault(r["word"][:i + 1], x) == x
    assert len(set(number.values())) == len(number)
    whole = [number[w] for w in words]
    assert whole == sorted(whole)


@settings(max_examples=200, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9))
def test_common_prefix(a, b):
    size = spelling.common(a, b)
    assert a[:size] == b[:size] and (size == min(len(a), len(b)) or a[size] != b[size])
