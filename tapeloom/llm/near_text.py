"""Near-duplicate documents by the Jaccard similarity of their five-word shingles, exactly, and by SimHash.

Two texts link if their sets of shingles of ``SHINGLE`` words have a Jaccard similarity of ``SIMILARITY`` or more, and, where
asked, if ``simhash`` puts them into one component. Similar sets of ``n`` shingles share one of the first ``n - ceil(SIMILARITY * n) + 1`` of
each, in any order that is the same for all texts (prefix filter); shingles that few texts hold come first, by a table of
``COUNTERS`` counters of the corpus. The table only orders: whatever it counts, no link is lost. How far on a shared shingle
stands bounds what can be shared.

Not all pairs that share a shingle are formed. First each text is held against one head of the shingle; texts this joins
need no further look at each other, and neither do texts that SimHash joins. Then texts of a shingle in different components
are held against each other. Every link of shingles is verified on whole sets. SimHash alone cannot do this: at 0.8 about ten
of 64 bits differ, far beyond its radius of three; it joins texts of few bits apart that the shingles leave apart.

Cases: null and empty texts and those of white space are alike. Fewer than five words are one shingle. Exact copies are
one text, whatever their ids. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm import simhash
from tapeloom.llm.common import arrow_schema, discard, store, texts
from tapeloom.llm.components import connected_components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
COUNTERS, SLICE = 1 << 22, 1 << 16
PREFIXES = "h bigint, node bigint, n int, place int"


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of ``width`` words, in order of size."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = max(1, len(each) - width + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(width, len(each))):
        out = (out ^ each[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _counts(rows: DataFrame, width: int) -> bytes:
    """In how many texts the shingles of each counter occur, up to 65535."""
    schema = arrow_schema("slice int, part binary")

    def give(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        held = {s: np.minimum(p, 65535).astype("<u2").tobytes() for s, p in sorted(parts.items())}
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.binary())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for text in batch.column(0):
                seen[shingles(text.as_py(), width) & np.uint64(COUNTERS - 1)] += 1
        yield give({s: p for s, p in enumerate(seen.reshape(-1, SLICE)) if p.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(part.as_py(), "<u2").astype(np.uint32)
                sums[s] = sums[s] + own if s in sums else own
        yield give(sums)

    parts = rows.select("text").mapInArrow(count, "slice int, part binary").repartition("slice").mapInArrow(add, "slice int, part binary")
    out = np.zeros((COUNTERS // SLICE, SLICE), "<u2")
    for r in parts.collect():  # the table of counters, the same size for any corpus
        out[r["slice"]] = np.frombuffer(r["part"], "<u2")
    return out.tobytes()


def _prefixes(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """``h, node, n, place``: the first shingles of each text, without those that no other text can hold."""
    held = rows.sparkSession.sparkContext.broadcast(_counts(rows, width))
    schema = arrow_schema(PREFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, parts, size = np.frombuffer(held.value, "<u2"), set(), [], 0

        def give():
            columns = [np.concatenate(c) for c in zip(*parts)]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if node in seen:
                    continue
                seen.add(node)
                own = shingles(text.as_py(), width)
                n, often = len(own), counts[own & np.uint64(COUNTERS - 1)]
                first = np.lexsort((own, often))[:n - math.ceil(round(similarity * n, 9)) + 1]
                place = np.flatnonzero(often[first] > 1).astype(np.int32)
                if len(place):
                    k = len(place)
                    parts.append((own[first[place]].view(np.int64), np.full(k, node, np.int64), np.full(k, n, np.int32), place))
                    size += k
                if size >= 1 << 17:
                    yield give()
                    size = 0
        if parts:
            yield give()

    return rows.select("node", "text").mapInArrow(run, PREFIXES)


def _verified(pairs: DataFrame, rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of nodes whose whole sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                for node, text in ((a, x), (b, y)):
                    if node not in sets:
                        if len(sets) >= 64:
                            sets.clear()
                        sets[node] = shingles(text.as_py(), width)
                    if node == a:
                        one = sets[node]
                keep.append(jaccard(one, sets[b]) >= similarity - 1e-12)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    own = store(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "near-texts")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    out = store(both.mapInArrow(run, "a bigint, b bigint"), "near-links")
    discard(own)
    return out


def _fits(similarity: float):
    """Whether texts (n, place) and (n2, place2) can be similar if this is the first shingle they share."""
    shared = F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    return shared * (1 + similarity) + 1e-6 >= similarity * (F.col("n") + F.col("n2"))


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def similar_links(rows: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """Links ``a, b`` between different texts (columns ``node, text``) that join all that are similar; ``known`` links are among them."""
    prefixes = store(_prefixes(rows, width, similarity), "prefixes")
    heads = prefixes.groupBy("h").agg(F.min(F.struct("n", "node", "place")).alias("_k"), F.min("node").alias("_a"), F.max("node").alias("_b"))
    heads = store(heads.where("_a <> _b").select("h", F.col("_k.n").alias("n2"), F.col("_k.node").alias("head"), F.col("_k.place").alias("place2")), "heads")
    shared = store(prefixes.join(heads, "h"), "shared")
    discard(prefixes)
    first = store(shared.where("node <> head").where(_fits(similarity)).select(*_pair("node", "head")).distinct(), "pairs")
    joined = _verified(first, rows, width, similarity)
    if known is not None:
        joined = joined.unionByName(known)
    roots = connected_components(joined).select("node", F.col("root").alias("_r"))
    named = shared.select("h", "node", "n", "place").join(roots, "node", "left").withColumn("c", F.coalesce("_r", "node")).drop("_r")
    named = store(named, "named")
    mixed = store(named.groupBy("h").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a <> _b").select("h"), "mixed")
    rest = store(named.join(mixed, "h").dropDuplicates(["h", "node"]), "rest")
    other = rest.select("h", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("c").alias("c2"))
    second = rest.join(other, "h").where("node < node2 AND c <> c2").where(_fits(similarity)).select(*_pair("node", "node2")).distinct()
    second = store(second.join(first, ["a", "b"], "left_anti"), "pairs")
    links = joined.unionByName(_verified(second, rows, width, similarity))
    for done in (heads, shared, named, mixed, rest, first, second):
        discard(done)
    return links


def simhash_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a, b`` between the hashes of different texts: each of a SimHash component with the least of it."""
    classes = simhash.near_duplicates(docs, id_col, text_col).select("hash", "group").distinct()
    least = classes.groupBy("group").agg(F.min("hash").alias("a"), F.max("hash").alias("_b")).where("a <> _b").select("group", "a")
    return store(classes.join(least, "group").where("hash <> a").select("a", F.col("hash").alias("b")), "simhash-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_simhash: bool = False) -> DataFrame:
    """``doc_id, hash, group`` for each row: the text's own hash and the least hash of its component, of both kinds of links with ``with_simhash``."""
    rows = texts(docs, id_col, text_col).withColumn("node", F.xxhash64("text"))
    known = simhash_links(docs, id_col, text_col) if with_simhash else None
    roots = connected_components(similar_links(rows.select("node", "text"), known=known))
    if known is not None:
        discard(known)
    named = rows.select("doc_id", F.col("node").alias("hash")).join(roots.withColumnRenamed("node", "hash"), "hash", "left")
    return named.select("doc_id", "hash", F.coalesce("root", "hash").alias("group"))
