"""Documents drawn by how much their word runs look like a target collection.

Features are the runs of one to three consecutive words, hashed into ``BUCKETS`` by the CRC-32 of their UTF-8 bytes. The
log ratio of a bucket's share in the target and in the corpus is its gain; a document weighs the sum of the gains of its
features, and the highest weights after Gumbel noise are a draw without replacement in proportion to the weights.

CRC-32 is linear over bits: the checksum of a string is that of as many zero bytes, XORed with one number for each byte
that depends only on the byte and its distance from the end. Those numbers stand in one table, so all features of a
batch of texts are hashed at once: look up a number for each byte of each span, then ``bitwise_xor.reduceat`` over the
spans. Spans longer than the table fold blocks of its length: what came before moves on by a block of zeros (four table
look-ups, again by linearity) and takes up the next block. Spans overlap, so they are laid out a bounded number of bytes
at a time.

Two passes over the texts: one to count buckets (each task hands on one number per bucket), one to weigh. Ranks need no
window over all rows: scores are summed up in slots, only the slots that can hold a drawn document are sorted, by ranges,
and each task's rows follow on those of the tasks before it.

Cases: a null or empty text has no features, weight 0 and is never drawn if ``least_words`` is above 0. A null id gets the
noise of an empty one and comes last among equal scores. Rows with equal id and text have equal scores and ranks of their
own. Equal scores go to the smaller id, then to the fewer features. An empty table gives an empty one; without a target
text all gains follow from the corpus alone. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import arrow_schema, store, texts

BUCKETS, LONGEST_RUN = 10_000, 3
SEED, LEAST_WORDS, SHARE = 42, 20, 5
REACH = 64  # bytes from the end that have numbers of their own
BATCH_TEXT, BATCH_SPANS = 1 << 20, 1 << 21  # bytes of text and of spans worked on at a time
SLOTS = 4096
WEIGHED = "doc_id bigint, n_features bigint, n_words bigint, weight bigint, score bigint"

# Bytes of words once A-Z are lower case: digits, a-z and all of longer UTF-8 forms.
IN_WORD = np.zeros(256, bool)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True


class PositionTable:
    """CRC-32 of many spans of one buffer."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.table = np.array([crc32(bytes([b]) + bytes(d)) ^ crc32(bytes(1 + d)) for d in range(reach) for b in range(256)], np.uint32)
        self.zeros = np.array([crc32(bytes(n)) for n in range(reach + 1)], np.uint32)
        moved = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
        for _ in range(reach):
            moved = (moved >> np.uint32(8)) ^ self.table[moved & np.uint32(255)]
        self.onward = moved.reshape(4, 256)  # a number after ``reach`` more zero bytes, by each of its own bytes

    def move(self, x: np.ndarray) -> np.ndarray:
        out = self.onward[0][x & np.uint32(255)]
        for k in range(1, 4):
            out = out ^ self.onward[k][(x >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _contributions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR over the bytes of each span, none empty and none longer than the reach."""
        sizes = ends - starts
        total = np.cumsum(sizes)
        out = np.empty(len(sizes), np.uint32)
        a = 0
        while a < len(sizes):
            done = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, done + BATCH_SPANS, "right")))
            size = sizes[a:b]
            first = total[a:b] - size - done
            step = np.arange(int(total[b - 1] - done))
            place = step + np.repeat(starts[a:b] - first, size)
            left = np.repeat(first + size - 1, size) - step
            out[a:b] = np.bitwise_xor.reduceat(self.table[(left << 8) | buf[place]], first)
            a = b
        return out

    def crc(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of ``buf[start:end]`` for each span; no span is empty."""
        sizes = ends - starts
        out = np.empty(len(sizes), np.uint32)
        short = sizes <= self.reach
        out[short] = self._contributions(buf, starts[short], ends[short]) ^ self.zeros[sizes[short]]
        if not short.all():
            out[~short] = self._folded(buf, starts[~short], ends[~short])
        return out

    def _folded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        blocks = -(-sizes // self.reach)
        first = np.cumsum(blocks) - blocks
        number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        stop = np.repeat(ends, blocks) - (np.repeat(blocks, blocks) - 1 - number) * self.reach
        parts = self._contributions(buf, np.maximum(stop - self.reach, np.repeat(starts, blocks)), stop)
        held = np.zeros(len(sizes), np.uint32)
        for k in range(int(blocks.max())):
            on = np.flatnonzero(blocks > k)
            held[on] = self.move(held[on]) ^ parts[first[on] + k]
        lengths, which = np.unique(sizes, return_inverse=True)
        return held ^ np.array([crc32(bytes(int(n))) for n in lengths], np.uint32)[which]


def words_of(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts joined by single spaces: the bytes, where words start and end, and the number of each word's text."""
    offsets = np.cumsum([0] + [len(t) + 1 for t in batch[:-1]])
    raw = np.frombuffer((b"\n".join(batch) + b"\n").lower(), np.uint8)
    inside = IN_WORD[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    kept = inside.copy()
    kept[ends] = True  # the byte after a word stands for the space
    buf = raw[kept]
    buf[~inside[kept]] = 0x20
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - sizes - 1
    return buf, begin, begin + sizes, np.searchsorted(offsets, starts, "right") - 1


class Features:
    """Buckets of the word runs of texts."""

    def __init__(self, buckets: int = BUCKETS, longest: int = LONGEST_RUN):
        self.buckets, self.longest, self.table = buckets, longest, PositionTable()

    def of(self, batch: list[bytes], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Buckets and text numbers of the features, some words at a time; whether they are single words."""
        buf, starts, ends, doc = words_of(batch)
        for a in range(0, len(starts), size):
            for n in range(1, self.longest + 1):
                b = min(a + size, len(starts) - n + 1)
                if b > a:
                    one = doc[a:b] == doc[a + n - 1:b + n - 1]
                    crc = self.table.crc(buf, starts[a:b][one], ends[a + n - 1:b + n - 1][one])
                    yield (crc % np.uint32(self.buckets)).astype(np.int64), doc[a:b][one], n == 1


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of about ``BATCH_TEXT`` bytes; a longer text comes with those before it."""
    ids, held, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1)):
            ids.append(doc.as_py())
            held.append(text.as_py().encode())
            size += len(held[-1])
            if size >= BATCH_TEXT:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN, id_col: str = "doc_id",
                  text_col: str = "text") -> list[int]:
    """Number of features of all texts in each bucket; the driver gets ``buckets`` numbers."""
    columns = "bucket int, n bigint"
    schema = arrow_schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, sums = Features(buckets, longest), np.zeros(buckets, np.int64)
        for _, held in _gathered(batches):
            for found, _, _ in features.of(held):
                sums += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[used])], schema=schema)

    summed = texts(docs, id_col, text_col).mapInArrow(run, columns).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for row in summed.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares, rounded down."""
    size, s_all, t_all = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return np.array([
        math.floor(1000 * math.log(((t + 1.0) * (s_all + size)) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus, target)
    ], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise of an id, a thousand times and rounded down."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = SEED, longest: int = LONGEST_RUN, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight, score`` for each row."""
    schema = arrow_schema(WEIGHED)
    held_gain = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held_gain.value
        features = Features(len(gain), longest)
        for ids, held in _gathered(batches):
            number, words, weight = (np.zeros(len(ids), np.int64) for _ in range(3))
            for found, doc, single in features.of(held):
                count = np.bincount(doc, minlength=len(ids))
                number += count
                if single:
                    words += count
                low = int(doc[0]) if len(doc) else 0  # texts come in order
                summed = np.zeros(len(ids), np.int64)
                if len(doc):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    summed[doc[first]] = np.add.reduceat(gain[found], first)
                weight[low:] += summed[low:]
            score = weight + np.array([noise(i, seed) for i in ids], np.int64)
            columns = [pa.array(ids, pa.int64()), *map(pa.array, (number, words, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, WEIGHED)


def ranked(rows: DataFrame, score: str, draw: int, order: list) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``draw`` by falling ``score`` (a long), then ``order``; null for all others.

    ``rows`` is read several times and must give the same rows each time, in the same places.
    """
    none = F.lit(None).cast("long")
    low, high = rows.agg(F.min(score), F.max(score)).first()
    if draw <= 0 or low is None:
        return rows.withColumn("rank", none)
    width = (high - low) // SLOTS + 1
    slot = F.floor((F.col(score) - F.lit(low)) / F.lit(width)).cast("int")
    left, floor = draw, 0
    for row in rows.groupBy(slot.alias("_slot")).count().orderBy(F.desc("_slot")).collect():  # SLOTS rows at most
        left, floor = left - row["count"], row["_slot"]
        if left <= 0:
            break
    above = rows.where(slot >= floor).withColumn("_row", F.monotonically_increasing_id())  # parts rows that are equal
    above = store(above.orderBy(F.desc(score), *order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ranks")
    part = F.shiftright("_at", 33).cast("int").alias("_part")
    before, starts = 0, []
    for row in above.groupBy(part).count().orderBy("_part").collect():  # a row per task
        starts.append((row["_part"], before))
        before += row["count"]
    start = rows.sparkSession.createDataFrame(starts, "_part int, _before bigint")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    above = above.withColumn("_part", part).join(start, "_part").withColumn("rank", F.when(place <= draw, place))
    below = rows.where(F.col(score).isNull() | (slot < floor)).withColumn("rank", none)
    return above.select(*rows.columns, "rank").unionByName(below)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             buckets: int = BUCKETS, longest: int = LONGEST_RUN, id_col: str = "doc_id", text_col: str = "text",
             target_id_col: str = "item_id", target_text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, n_words, weight, score, rank`` for each row of ``docs``.

    ``share`` percent (rounded down) of the documents with at least ``least_words`` words are drawn.
    """
    corpus = bucket_counts(docs, buckets, longest, id_col, text_col)
    wanted = bucket_counts(target, buckets, longest, target_id_col, target_text_col)
    scored = store(weigh(docs, gains(corpus, wanted), seed, longest, id_col, text_col), "weights")
    fit = F.col("n_words") >= least_words
    draw = share * scored.where(fit).count() // 100
    order = [F.asc_nulls_last("doc_id"), "n_features"]
    drawn = ranked(scored.where(fit), "score", draw, order)
    return drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
