"""Token files, flat token scan and packing against the tokenizers library itself."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import packing, token_files, token_scan
from tapeloom.llm.common import new_folder
from tapeloom.llm.queries import QUERIES
from tapeloom.llm.tokens import WordIds, default_vocabulary, slices

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "It's  O'NEIL's 'tis we'll\tgo", "a\x1cb\x85c\xa0d", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>",
       "é é İstanbul ß Straße 漢字かな 👩‍👩‍👧", "x" * 3000, "12345 3.14 !!!??? ### --", "́ start", "long " * 5000, "don't 'S 'LL", "tab\tin\x0bword\x0c"]
COLUMNS = "doc_id long, text string, tokens string, part string, piece string, length string, start string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def odd_docs(spark):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x") for i, t in enumerate(ODD)] + [(3, "again", *"xxxxx"), (3, "again", *"xxxxx"),
                                 (None, "no id", *"xxxxx")], COLUMNS)


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(numbers):
    return zlib.crc32(np.array(numbers, "<u4").tobytes())


def test_word_ids_equal_the_library(spark, tokenizer):
    words = WordIds(default_vocabulary())
    texts = [t or "" for t in ODD] + [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("text").collect()]
    r = random.Random(1)
    texts += ["".join(r.choice("aB'é1 .\n\t<|>́漢 \x1f") for _ in range(60)) for _ in range(300)]
    latin = [chr(c) for c in [10, *range(0x20, 0x7F), *range(0xA1, 0x100)]]
    texts += ["".join(r.choices(latin, k=r.randint(1, 40))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == ids(tokenizer, t), repr(t[:80])


def test_long_texts_are_split_at_white_space():
    for text in ("ab cd\nef " * 50, "x" * 100, "x" * 30 + " " + "y" * 5, "", "a b"):
        parts = list(slices(text, 7))
        assert "".join(parts) == text and all(p[-1] in " \n" for p in parts[:-1])
        assert all(len(p) <= 7 + max(map(len, text.replace("\n", " ").split(" "))) + 1 for p in parts)


def test_token_files_query(spark, tokenizer):
    want, at = [], 0
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect():
        own = ids(tokenizer, r["text"]) + [2]
        want.append((r["doc_id"], at, len(own), crc(own)))
        at += len(own)
    assert sorted(tuple(r) for r in QUERIES["op8_token_files"](spark, FOLDER).collect()) == want


def test_token_files_odd_rows_and_selective_reads(spark, tokenizer):
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(odd_docs(spark), folder, default_vocabulary(), end_id=2)
    files = token_files.open_token_files(spark, folder)
    rows = token_files.token_starts(files).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] + sorted([*range(len(ODD)), 3, 3])
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(r["tokens"]) and r["tokens"][-1] == 2
        at += r["n_tokens"]
    assert files.where("doc_id = 4").first()["tokens"] == ids(tokenizer, ODD[4]) + [2]
    plan = files.where("doc_id = 4").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan


def test_token_files_encodings_and_page_index(spark):
    import glob

    import pyarrow.parquet as pq

    folder = new_folder(spark, "tokens")
    token_files.write_token_files(spark.read.parquet(f"{FOLDER}/documents.parquet"), folder, default_vocabulary())
    meta = pq.ParquetFile(glob.glob(f"{folder}/*.parquet")[0]).metadata.row_group(0)
    by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and by["doc_id"].has_column_index and by["doc_id"].has_offset_index
    assert "RLE_DICTIONARY" in by["tokens.list.element"].encodings


def test_token_counts_query(spark, tokenizer):
    want = {r["doc_id"]: len(ids(tokenizer, r["text"])) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = QUERIES["op2_token_counts"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
    assert sum(r["n_tokens"] + 1 for r in got) == max(r["start"] + r["n_tokens"] + 1 for r in got)


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_scan_stitches_blocks_and_files(spark, tmp_path, block_bytes):
    r = random.Random(block_bytes)
    stream = [r.choice([7, 7, 7, 7, 9]) for _ in range(400)] + [7, 7]
    cuts, files = [0, 90, 90, 200, 402], []
    for n, (a, b) in enumerate(itertools.pairwise(cuts)):
        (tmp_path / f"{n}.bin").write_bytes(np.array(stream[a:b], "<u2").tobytes())
        files.append((n, str(tmp_path / f"{n}.bin"), 2 * (b - a)))
    df = spark.createDataFrame(files, "file_no long, file string, n_bytes long")
    got = token_scan.token_counts(df, str(tmp_path), end_id=9, width=2, block_bytes=block_bytes).orderBy("start").collect()
    ends = [i for i, x in enumerate(stream) if x == 9]
    want = [(a + 1, b - a - 1, True) for a, b in itertools.pairwise([-1, *ends])] + [(ends[-1] + 1, len(stream) - ends[-1] - 1, False)]
    assert [(x["start"], x["n_tokens"], x["closed"]) for x in got] == want


def test_counts_of_odd_rows(spark, tokenizer):
    got = token_scan.document_counts(odd_docs(spark), default_vocabulary(), 49408, block_bytes=64).collect()
    want = [(i, len(ids(tokenizer, t))) for i, t in enumerate(ODD)] + [(3, 1), (3, 1), (None, len(ids(tokenizer, "no id")))]
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(str, want))


def check_bins(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark, tokenizer):
    want = []
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        own = ids(tokenizer, r["text"]) + [0]
        want += [(r["doc_id"], n, a, len(own[a:a + 2048]), crc(own[a:a + 2048])) for n, a in enumerate(range(0, len(own), 2048))]
    got = QUERIES["op5_best_fit_packing"](spark, FOLDER).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert check_bins(got, 2048) <= 1.02 * -(-sum(w[3] for w in want) // 2048)


def test_packing_odd_rows_and_sequences(spark, tokenizer):
    placed = packing.pack_documents(odd_docs(spark), default_vocabulary(), capacity=64, end_id=0)
    assert placed.where("ids_crc32 <> crc32(ids)").count() == 0
    narrow = packing.pack_documents(odd_docs(spark), default_vocabulary(), capacity=64, end_id=0, ids=False)
    assert sorted(narrow.collect(), key=str) == sorted(placed.drop("ids").collect(), key=str)
    rows = placed.collect()
    check_bins(rows, 64)
    assert sum(r["length"] for r in rows) == sum(len(ids(tokenizer, r["text"])) + 1 for r in odd_docs(spark).collect())
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(placed).collect()}
    for r in rows:
        assert made[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]].tolist() == np.frombuffer(r["ids"], "<u4").tolist()


def least_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1:]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_plan_against_brute_force():
    r = random.Random(5)
    for _ in range(60):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        plan = packing.plan_bins(dict(collections.Counter(sizes)), 20)
        used = collections.Counter()
        for combination, times in plan:
            assert sum(n * k for n, k in combination.items()) <= 20
            for n, k in combination.items():
                used[n] += k * times
        assert used == collections.Counter(sizes) and sum(t for _, t in plan) <= least_bins(sizes, 20) + 1
    room = packing.fullest({7: 3, 5: 1, 3: 4}, 20)
    assert sum(n * k for n, k in room.items()) == 20


def test_empty_tables(spark):
    none = odd_docs(spark).where(F.lit(False))
    folder = new_folder(spark, "tokens")
    token_files.write_token_files(none, folder, default_vocabulary())
    assert token_files.token_starts(token_files.id_digests(token_files.open_token_files(spark, folder))).count() == 0
    assert packing.pack_documents(none, default_vocabulary()).count() == 0
    assert token_scan.document_counts(none, default_vocabulary(), 49408).count() == 0
