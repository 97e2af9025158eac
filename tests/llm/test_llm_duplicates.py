"""Line dedup, SimHash near-duplicates and decontamination against plain versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import decontaminate, line_dedup, simhash
from tapeloom.llm.components import connected_components
from tapeloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, n_chars int, n_lines string, digest string, fp string, hash string, _keep long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "x", "x", "x", "x", 1) for i, t in rows], COLUMNS)


def plain_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    held = collections.defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 20:
                    held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or i == gone[key(x)]]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


A, B, C = "A line that many documents share.", "Another line of some length, twice.", "short line"
LINES = [(1, f"{A}\n{B}\nown text of one"), (2, f"  {A.upper()} \t\n{C}"), (3, f"{A}\n{A}\n{C}"), (4, f"{B}\n{C}"), (5, None), (6, ""),
         (7, f"é{A} "), (None, A), (1, f"{A}\n{B}\nown text of one"), (8, "x" * 200_000 + "\n" + A), (9, "\n" * 50)]


@pytest.mark.parametrize("bits", [1 << 28, 64])
def test_line_dedup_odd_rows(spark, bits):
    got = line_dedup.drop_repeated_lines(frame(spark, LINES), filter_bits=bits, counts=True)
    assert got.columns == ["doc_id", "text", "n_chars", "digest", "fp", "hash", "_keep", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, plain_lines(LINES)))
    assert all(r["n_chars"] == len(r["text"] or "") for r in got.collect())
    assert line_dedup.drop_repeated_lines(frame(spark, LINES)).columns == frame(spark, LINES).columns


def test_line_dedup_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in plain_lines(rows))
    assert sorted(tuple(r) for r in QUERIES["op3_line_dedup"](spark, FOLDER).collect()) == want
    assert sum(w[2] for w in want) > 0


def test_only_suspects_leave_the_filter(spark):
    rows = [(i, f"a line of its own, number {i:06d}\nshared by pairs, number {i // 2:06d}") for i in range(200)]
    held = line_dedup.twice_seen(frame(spark, rows).select("text"), 20, 1 << 20).collect()
    marked = sum(int(np.unpackbits(np.frombuffer(r["twice"], np.uint8)).sum()) for r in held)
    assert 100 < marked <= 2 * 100 + 20  # two bits for each pair, and few others


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(prints):
    a, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash_query(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    prints = [plain_print(t) for _, t in rows]
    roots = plain_components(prints)
    want = [(i, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, roots)]
    assert sorted(tuple(r) for r in QUERIES["op10_simhash"](spark, FOLDER).collect()) == want


def test_links_join_all_within_the_radius(spark):
    r = random.Random(3)
    prints = set()
    for _ in range(60):  # clouds: many near one centre, chains, and differences in one region only
        centre = r.getrandbits(64)
        prints.add(centre)
        for _ in range(r.choice([1, 5, 60])):
            centre_ = centre if r.random() < 0.7 else r.choice(sorted(prints))
            prints.add(centre_ ^ sum({1 << b for b in r.sample(range(64), r.randint(1, 4))}))
            region = 16 * r.randrange(4)
            prints.add(centre_ ^ sum({1 << b for b in r.sample(range(region, region + 16), 3)}))
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"))
    found = links.collect()
    assert all(bin((x["a"] ^ x["b"]) & (1 << 64) - 1).count("1") <= 3 and x["a"] != x["b"] for x in found)
    roots = {x["node"]: x["root"] for x in connected_components(links).collect()}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for (s,), p, k in zip(signed, prints, plain_components(prints)):
        groups[roots.get(s, s)].add(p)
        want[k].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_variants_come_back():
    prints = np.array([0, 1, (1 << 64) - 1, 0x0123456789ABCDEF, 1 << 63], np.uint64)
    buckets, tails = simhash.variants(prints)
    assert len(buckets) == 5 * 4 * 49
    assert set(simhash.restore(buckets, tails).tolist()) == set(prints.tolist())
    assert (simhash.restore(buckets, tails).reshape(4, 5, 49) == prints[None, :, None]).all()


def test_near_duplicates_odd_rows(spark):
    words = " ".join(f"word{i}" for i in range(400))
    rows = [(5, words), (2, words.upper()), (9, words + "  "), (3, None), (4, " \n"), (7, "two words"), (8, "Two\tWords"), (7, "two words"), (None, words),
            (6, "long " * 100_000), (None, "alone and unlike all else here")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
    assert len(got) == len(rows) and by[5] == by[2] == by[9] == {2} and by[3] == by[4] == {3} and by[7] == by[8] == {7} and by[6] == {6}
    assert by[None] == {2, None}
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "6", "7", "None"]


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 500)] + [(1400, 1400), (1001, 1000)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(path + hub, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(500)}}


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[1:]


def test_myers_against_the_table():
    r = random.Random(2)
    for _ in range(200):
        item, text = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (90, 120))
        assert decontaminate.myers(item, text) == plain_distance(item, text)


def test_all_matches_within_the_budget_are_found():
    r = random.Random(4)
    items = [(i, "".join(r.choice("abcde ") for _ in range(r.randint(5, 120)))) for i in range(20)]
    index = decontaminate.Items(items, 0.1)
    for _ in range(150):
        i, item = r.choice(items)
        item = list(decontaminate.plain(item))
        for _ in range(r.randint(0, 14)):
            at = r.randrange(len(item)) if item else 0
            item[at:at + r.randint(0, 1)] = r.choice(["", "x", "y"])
        text = decontaminate.plain("zzz " * r.randint(0, 3) + "".join(item) + " zzz" * r.randint(0, 3))
        found = {index.items[n][0]: d for n, d, _, _ in index.find(text)}
        for (i, p), k in zip(index.items, index.edits):
            if k:
                low = min(plain_distance(p, text), default=k + 1)
                assert found.get(i) == (low if low <= k else None)


def test_leaks_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog, and then it sleeps under the old oak tree until noon."
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "tiny", "x"), (1, item, "x")], "item_id long, text string, doc_id string")
    near = item.replace("quick", "quack").upper().replace(" ", "\n ")
    rows = [(1, f"Before it. {item} And after."), (2, near), (3, None), (4, ""), (5, item[:60]), (6, "a tiny one"), (7, "tinystuff"), (None, item), (1, item),
            (8, "filler words " * 50_000 + item)]
    docs = frame(spark, rows)
    got = sorted(decontaminate.find_leaks(docs, bench).collect(), key=str)
    assert collections.Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == {
        (1, 1, 0): 2, (2, 1, 1): 1, (6, 4, 0): 1, (None, 1, 0): 1, (8, 1, 0): 1}
    spans = {r["doc_id"]: (r["first_char"], r["last_char"]) for r in got if r["doc_id"] in (2, 6, 8)}
    assert spans[2] == (0, len(near) - 2) and spans[6] == (2, 5) and spans[8][0] == 13 * 50_000
    kept = decontaminate.drop_leaking(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 7]
    assert decontaminate.find_leaks(docs, bench, block_chars=50).count() == len(got)
    assert decontaminate.drop_leaking(docs, bench.where(F.lit(False))).count() == len(rows)
    assert decontaminate.find_leaks(docs, bench.where(F.lit(False))).count() == 0


def test_leaks_query(spark):
    docs = [(r["doc_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [(r["item_id"], decontaminate.plain(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    whole = {(d, i) for d, t in docs for i, p in items if p in t}
    got = QUERIES["op9_benchmark_leaks"](spark, FOLDER).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["distance"] == 0} == whole and whole


def test_empty_tables(spark):
    none = frame(spark, LINES).where(F.lit(False))
    assert line_dedup.drop_repeated_lines(none, counts=True).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    bench = spark.createDataFrame([(1, "some benchmark item")], "item_id long, text string")
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.drop_leaking(none, bench).count() == 0


def test_items_of_one_id_fall_into_many_blocks(spark):
    items = spark.createDataFrame([(None if i % 2 else 7, f"item number {i:04d} of many") for i in range(400)], "item_id long, text string")
    blocks = list(decontaminate._blocks(items, 1000))
    assert sum(map(len, blocks)) == 400 and max(sum(len(t) for _, t in b) for b in blocks) <= 2500


def test_columns_of_the_caller_are_kept_whatever_their_names(spark):
    """Names the operators use themselves: none is overwritten or ambiguous."""
    names = ["_id", "_hash", "id", "hash", "row", "group", "_doc", "_gone", "gone", "digest", "component_id"]
    line = "a line that three documents share, word for word"
    rows = [(i, f"{line}\nown text number {i} of its kind", *(f"{n}{i}" for n in names)) for i in range(4)] + [(9, "own text", *names), (10, "own text", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert all(got[i][n] == f"{n}{i}" for i in range(4) for n in names) and line not in got[0]["text"] and line in got[3]["text"]
    kept = {r["doc_id"]: r for r in simhash.keep_one(docs.where("doc_id in (0, 9, 10)")).collect()}
    assert set(kept) == {0, 9} and all(kept[0][n] == f"{n}0" and kept[9][n] == n for n in names)
    assert simhash.keep_one(docs).columns == docs.columns and line_dedup.drop_repeated_lines(docs).columns == docs.columns
