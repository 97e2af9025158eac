"""Near-duplicate documents by 64-bit SimHash and ball hashing that meets in the middle.

Fingerprints link at ``RADIUS`` = 3 or fewer differing bits. Half of that is one flip and a half: each different
fingerprint gives out all variants within one flip, and the odd bit is left to a region of 16 bits that the variant
leaves out, for each of the four regions in turn (4 x 49 = 196 variants). Two fingerprints within three bits of each
other meet in at least one variant: if a region holds exactly one of the differing bits, or none, at most two remain
outside and one flip from each side closes them; if all three lie in one region, the unflipped variants are equal.

Fingerprints that meet are sorted by what they have in the region. No pairs of a group are formed: those with equal
regions differ in at most two bits and hang on the first of them; two groups whose regions differ in one bit are linked
by one pair; unflipped members whose regions differ in three bits are looked up by those bits. Every link is verified by
counting bits. A group of equal regions has 49 members at most, whatever the corpus, so no copies make a hot key: exact
copies are one fingerprint, summed up before.

Cases: a null or empty text, or one of white space, has fingerprint 0 and is linked like any other. Fewer than three
words are one shingle. Rows with equal or null id keep their rows; a null id is never a component's smallest (a
component of null ids only has a null one). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import arrow_schema, discard, store, texts
from tapeloom.llm.components import connected_components

RADIUS, WIDTH, REGION = 3, 64, 16
OUTSIDE = WIDTH - REGION
SHINGLE, SEED = 3, 42
VARIANTS = "bucket bigint, tail int"
LINKS = "a bigint, b bigint"


def fingerprint(text: str) -> int:
    """SimHash of the shingles of ``SHINGLE`` words, repeats included, as an unsigned number."""
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(s) for s in zip(*(words[i:] for i in range(SHINGLE)))] or [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
    ones = np.zeros(WIDTH, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash, fp`` for each row: the text's own hash and its fingerprint as a signed long."""
    columns = "doc_id bigint, hash bigint, fp bigint"
    schema = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made)], schema=schema)

    rows = texts(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return rows.mapInArrow(run, columns)


def variants(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (region number, the bits outside it with one flip at most) and tail (bits of the region, flipped bit)."""
    flips = np.concatenate([np.uint64(1) << np.arange(OUTSIDE, dtype=np.uint64), np.zeros(1, np.uint64)])
    buckets, tails = [], []
    for r in range(WIDTH // REGION):
        low = np.uint64((1 << REGION * r) - 1)
        inside = (prints >> np.uint64(REGION * r)) & np.uint64((1 << REGION) - 1)
        rest = prints >> np.uint64(REGION * r)
        outside = (prints & low) | ((rest >> np.uint64(REGION)) << np.uint64(REGION * r))
        buckets.append(((outside[:, None] ^ flips) | np.uint64(r << OUTSIDE)).ravel())
        tails.append(((inside[:, None] << np.uint64(6)) | np.arange(OUTSIDE + 1, dtype=np.uint64)).ravel())
    return np.concatenate(buckets).view(np.int64), np.concatenate(tails).astype(np.int32)


def restore(buckets: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The fingerprints that gave these variants."""
    bucket, tail = buckets.view(np.uint64), tails.astype(np.uint64)
    flip = tail & np.uint64(63)
    at = (bucket >> np.uint64(OUTSIDE)) * np.uint64(REGION)
    outside = bucket & np.uint64((1 << OUTSIDE) - 1)
    outside = np.where(flip < OUTSIDE, outside ^ (np.uint64(1) << np.minimum(flip, np.uint64(OUTSIDE - 1))), outside)
    low = (np.uint64(1) << at) - np.uint64(1)
    high = np.where(at < OUTSIDE, (outside >> at) << np.minimum(at + np.uint64(REGION), np.uint64(WIDTH - 1)), np.uint64(0))
    return (outside & low) | ((tail >> np.uint64(6)) << at) | high


def met(buckets: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Verified links among whole buckets, sorted by bucket and tail; enough to join all that are within the radius."""
    same = buckets[1:] == buckets[:-1]
    many = np.append(same, False) | np.append(False, same)
    buckets, tails = buckets[many], tails[many]
    if not len(buckets):
        return np.zeros((0, 2), np.uint64)
    prints = restore(buckets, tails)
    number = np.cumsum(np.append(0, buckets[1:] != buckets[:-1])).astype(np.int64)
    key = (number << REGION) | (tails >> 6)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    head = np.repeat(first, np.diff(np.append(first, len(key))))
    pairs = [(head, np.arange(len(key)))]  # equal regions

    def meet(keys: np.ndarray, rows: np.ndarray, change: int) -> None:
        wanted = keys ^ change
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = (keys[at] == wanted) & (wanted > keys)
        pairs.append((rows[hit], rows[at[hit]]))

    for bit in range(REGION):
        meet(key[first], first, 1 << bit)
    still = np.flatnonzero((tails & 63) == OUTSIDE)
    shared = np.diff(number[still]) == 0
    still = still[np.append(shared, False) | np.append(False, shared)] if len(still) else still
    if len(still):
        for bits in combinations(range(REGION), RADIUS):
            meet(key[still], still, sum(1 << b for b in bits))
    a, b = (prints[np.concatenate(side)] for side in zip(*pairs))
    near = (a != b) & (np.bitwise_count(a ^ b) <= RADIUS)
    found = np.stack([np.minimum(a, b)[near], np.maximum(a, b)[near]], axis=1)
    return np.unique(found, axis=0)


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` between different fingerprints (column ``fp``, each once) that join all within the radius."""
    made, linked = arrow_schema(VARIANTS), arrow_schema(LINKS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in variants(fps[at:at + 2000])], schema=made)

    def collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int32))

        def links(buckets, tails):
            found = met(buckets, tails).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=linked)

        for batch in batches:
            if not len(batch):
                continue
            kept = tuple(np.concatenate([k, batch.column(i).to_numpy()]) for i, k in enumerate(kept))
            last = np.searchsorted(kept[0], kept[0][-1])  # the last bucket may go on in the next batch
            yield links(kept[0][:last], kept[1][:last])
            kept = (kept[0][last:], kept[1][last:])
        yield links(*kept)

    spread = prints.select("fp").mapInArrow(emit, VARIANTS).repartition("bucket").sortWithinPartitions("bucket", "tail")
    return spread.mapInArrow(collide, LINKS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash, fp, component_id, group`` for each row; ``group`` is the least fingerprint of the component."""
    rows = store(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = store(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")), "prints")
    roots = connected_components(near_links(prints))
    named = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    smallest = named.groupBy("group").agg(F.min("_first").alias("component_id"))
    classes = store(named.join(smallest, "group").select("fp", "group", "component_id"), "classes")
    discard(prints)
    return rows.join(classes, "fp").select("doc_id", "hash", "fp", "component_id", "group")


def fingerprint_text(fp) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (a null one last), then of the smallest text hash."""
    last = F.lit((1 << 63) - 1)
    found = find(docs, id_col, text_col)
    kept = found.groupBy("group").agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), F.col("hash").alias("hash"))).alias("_k"))
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("row")  # columns of the caller may have any name
    rows = docs.select(own, F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"))
    return rows.join(kept.select("_k.id", "_k.hash"), ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).select("row.*")
