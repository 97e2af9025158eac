"""Packing documents into sequences by minimum bin slack.

Lengths run from 1 to the capacity, so all that decides the bins is one count per length: at most ``capacity`` numbers,
whatever the corpus. The plan is made from them: for the longest length left, a subset-sum over the other lengths, kept
as the bits of one integer, finds the fullest combination that fits; it is taken as often as its lengths last. Each
round uses up one length of it, so a plan has at most ``capacity * ln(capacity)`` rounds and is a few thousand rows.
Pieces then look up their place by their rank among the pieces of equal length.

Ranks need no window over a length (a third of all pieces may have the same): each task numbers its own pieces, and one
row per task and length says how many came before.

Cases: a null or empty text is its end id alone. Only documents longer than the capacity are cut; the last piece may be
shorter. Rows with equal id are packed as documents of their own; a null id stays null. An empty table gives an empty
one. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, store, texts
from tapeloom.llm.tokens import word_ids

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, part bigint, rank bigint"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids; ``ids`` are little-endian unsigned 32-bit numbers.

    ``rank`` counts pieces of equal length inside ``part``, the task that made them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, out = word_ids(vocabulary), TaskContext.get().partitionId(), Rows(PIECES)
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = words.encode(text) + end
                for piece, at in enumerate(range(0, len(coded), 4 * capacity)):
                    ids = coded[at:at + 4 * capacity]
                    n = len(ids) // 4
                    out.add(doc, piece, at // 4, n, ids, crc32(ids), part, seen[n], size=len(ids) + 64)
                    seen[n] += 1
                if out.full():
                    yield from out.take()
        yield from out.take()

    return texts(docs, id_col, text_col).mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths with the largest sum that ``room`` holds, each used as often as ``counts`` allows at most."""
    steps: list[tuple[int, int]] = []  # (size, sums reachable before it)
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach & goal:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many bins get each."""
    left, plan = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        left[first] -= 1
        used = fullest({n: c for n, c in left.items() if c}, capacity - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((used, times))
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Per length and first rank: number of the first bin, pieces of this length in a bin, place of the first of them."""
    rows, bins, done = [], 0, {}
    for used, times in plan:
        at = 0
        for n in sorted(used, reverse=True):
            rows.append(((n << 44) | done.get(n, 0), bins, used[n], at))
            done[n] = done.get(n, 0) + used[n] * times
            at += n * used[n]
        bins += times
    rows.sort()
    return dict(zip(("key", "bin", "uses", "at"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written pieces (columns ``length``, ``part``, ``rank`` and any others)."""
    by_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    by_task = store(by_task, "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_bins(counts, capacity)))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    by_task = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(by_task, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("rank"))
    keep = [c for c in pieces.columns if c not in ("part", "rank")]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in keep) + ", sequence_id bigint, offset bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            key = (length.astype(np.int64) << 44) | rank
            i = np.searchsorted(s["key"], key, side="right") - 1
            turn = key - s["key"][i]
            sequence, offset = s["bin"][i] + turn // s["uses"][i], s["at"][i] + turn % s["uses"][i] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)],
                                             names=[*keep, "sequence_id", "offset"])

    return ranked.select(*keep, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset`` for every piece of every document.

    Without ``ids`` only narrow columns are placed; the ids stay where they are written.
    """
    pieces = store(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces", compression="zstd")
    return place_pieces(pieces if ids else pieces.drop("ids"), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` with pieces in place; a bin holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
