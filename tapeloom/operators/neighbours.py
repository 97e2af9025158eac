"""Exact best matches by cosine without comparing every block with every block.

The angle between unit vectors is a metric. A few rows of the corpus serve as pivots; every row lies in the cell of its
nearest pivot, and inside the cell in a ring of about the same angle to it. Rings are gathered into blocks of bounded
size along a tour of the pivots; a ring with more rows than a block holds (copies of one vector, say) is dealt out by id.
What is kept of all this is a few numbers per ring, bounded by the number of pivots and ring widths.

A query first meets the one block it falls into. Its k-th best match there is a threshold, and only blocks that may hold
something at least as good are met after that: by the triangle inequality a row of a ring is no closer than the gap between the
query's angle to the pivot and the ring, and no closer than the half of the sphere that is nearer to that pivot than to
the query's own. Both bounds are exact, so the answer is that of comparing all pairs, whatever the pivots; on data
without any structure nothing can be left out and the work is that of comparing all blocks, with nothing emitted beyond the best.

Matches are kept as a state (the k best groups of each query) that later changes of either side are merged into: unchanged
queries meet only new or changed rows, and only those blocks of them that can reach their stored k-th best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import matrix, unit_rows
from tapeloom.session import store
from tapeloom.sources.store import top_n

PIVOTS = 256
RINGS = 64  # ring slots for each radian
BLOCK_ROWS, LEAST_ROWS = 8192, 256
STRIP_ROWS = 512
STRIP_CELLS = 1 << 19  # similarities a task holds at a time, whatever the size of a block
TIE_DECIMALS = 9
SLACK = 1e-7  # radians that rounding may be off
SLOTS = int(math.pi * RINGS) + 1

LISTS = "grp array<bigint>, neighbour_id array<bigint>, similarity array<double>"
FOUND = "query_id bigint, grp bigint, neighbour_id bigint, similarity double"
FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("grp", pa.int64()), ("neighbour_id", pa.int64()), ("similarity", pa.float64())])


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


@dataclass
class Layout:
    """Rings of the corpus and the blocks they lie in; numbers per pivot, slot and ring only."""

    pivots: np.ndarray  # unit vectors
    block_of: np.ndarray  # (pivot, slot) -> block, -1 where no row lies
    cell: np.ndarray  # of each ring; rings of a block follow each other
    block: np.ndarray
    low: np.ndarray  # smallest and largest angle to the pivot
    high: np.ndarray
    parts: np.ndarray  # groups each block is dealt out to

    @property
    def first(self) -> np.ndarray:
        """Number of the first group of each block."""
        return np.cumsum(self.parts) - self.parts

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each row and the slot of the angle to it."""
        cell, nearest = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for at in range(0, len(unit), STRIP_ROWS):
            cosines = unit[at:at + STRIP_ROWS] @ self.pivots.T
            cell[at:at + STRIP_ROWS], nearest[at:at + STRIP_ROWS] = cosines.argmax(axis=1), cosines.max(axis=1)
        return cell, (angles(nearest) * RINGS).astype(np.int64)

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Least angle between each row and anything in each ring."""
        cosines = unit @ self.pivots.T
        own = cosines.argmax(axis=1)
        away = angles(cosines)[:, self.cell]
        gap = np.maximum(away - self.high, self.low - away)
        apart = np.sqrt(np.maximum(2 - 2 * self.pivots @ self.pivots.T, 0))[own][:, self.cell]
        height = (cosines[np.arange(len(unit)), own][:, None] - cosines[:, self.cell]) / np.where(apart > 1e-6, apart, np.inf)
        return np.maximum(np.maximum(gap, np.arcsin(np.clip(height, 0.0, 1.0))) - SLACK, 0.0)

    def within(self, unit: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Which blocks may hold something of at least the similarity ``floor``, for each row."""
        rings = np.cos(self.bounds(unit)) >= floor[:, None] - 2 * 10.0 ** -TIE_DECIMALS
        return np.logical_or.reduceat(rings, np.flatnonzero(np.diff(self.block, prepend=-1)), axis=1)

    def home(self, unit: np.ndarray) -> np.ndarray:
        """The block each row falls into, or the closest one."""
        block = self.block_of[self.cells(unit)]
        lost = np.flatnonzero(block < 0)
        for at in range(0, len(lost), STRIP_ROWS):
            rows = lost[at:at + STRIP_ROWS]
            block[rows] = self.block[self.bounds(unit[rows]).argmin(axis=1)]
        return block


def _tour(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which neighbours are close: always on to the nearest one left."""
    cosines, order, left = pivots @ pivots.T, [0], np.ones(len(pivots), bool)
    for _ in range(len(pivots) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, cosines[order[-1]], -np.inf).argmax()))
    return np.array(order)


def _layout(pivots: np.ndarray, rows: list, block_rows: int) -> Layout:
    """``rows``: cell, slot, number of rows, smallest and largest angle."""
    place = np.argsort(_tour(pivots))
    block_of, rings, parts, filled = np.full((len(pivots), SLOTS), -1), [], [], block_rows
    for cell, slot, n, low, high in sorted(rows, key=lambda r: (place[r[0]], r[1])):
        if filled + n > block_rows:
            parts.append(-(-n // block_rows))
            filled = 0
        filled += n
        block = len(parts) - 1
        block_of[cell, slot] = block
        if rings and rings[-1][0] == cell and rings[-1][1] == block:
            rings[-1][3] = high
        else:
            rings.append([cell, block, low, high])
    cell, block, low, high = (np.array(c) for c in zip(*rings))
    return Layout(pivots, block_of, cell, block, low, high, np.array(parts))


def _unit(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    return unit_rows(matrix(table, "vector"))


def _clean(rows: DataFrame) -> DataFrame:
    """Vectors whose cosines are numbers; others match nothing."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)


@dataclass
class Corpus:
    layout: Layout | None  # None if there are no rows
    rows: DataFrame  # id, grp, vector, group


def lay_out(corpus: DataFrame, pivots: int = PIVOTS, block_rows: int | None = None) -> Corpus:
    """Blocks of ``id, grp, vector``: rows that compete within ``grp`` (their own id for single rows)."""
    corpus = _clean(corpus.select("id", "grp", "vector"))
    spark = corpus.sparkSession
    chosen = corpus.select("vector", F.xxhash64("id").alias("_h")).orderBy("_h").limit(pivots).collect()
    if not chosen:
        return Corpus(None, corpus.withColumn("group", F.lit(0).cast("long")))
    points = unit_rows(np.array([r["vector"] for r in chosen], np.float64))
    bare = Layout(points, *[np.zeros(0)] * 6)
    kind = corpus.schema["vector"].dataType.simpleString()
    held = spark.sparkContext.broadcast(bare)  # ``pivots`` vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch)
            cell, slot = held.value.cells(unit)
            angle = angles((unit * held.value.pivots[cell]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(slot, pa.int32()), pa.array(angle)],
                                             names=["id", "grp", "vector", "cell", "slot", "angle"])

    rows = corpus.select(F.col("id").cast("long"), F.col("grp").cast("long"), "vector")
    cells = store(rows.mapInArrow(assign, f"id bigint, grp bigint, vector {kind}, cell int, slot int, angle double"), "cells")
    sums = cells.groupBy("cell", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    size = block_rows or max(LEAST_ROWS, min(BLOCK_ROWS, -(-sum(r["n"] for r in sums) // spark.sparkContext.defaultParallelism)))
    layout = _layout(points, [tuple(r) for r in sums], size)
    blocks = layout.block_of
    table = spark.createDataFrame(
        [(r["cell"], r["slot"], int(layout.first[b]), int(layout.parts[b])) for r in sums for b in (blocks[r["cell"], r["slot"]],)],
        "cell int, slot int, _first long, _parts long")
    group = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))
    return Corpus(layout, cells.join(table, ["cell", "slot"]).select("id", "grp", "vector", group.alias("group")))


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest entries per row, equal entries by column."""
    k = min(k, sims.shape[1])
    floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
    rows, cols = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
    order = np.lexsort((cols, -sims[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep]


def _meet(queries: pa.Table, corpus: pa.Table, k: int, skip_self: bool, floor: np.ndarray | None = None):
    """Row number, group, row and similarity of the best ``k`` groups of each query, in order of the query rows."""
    out = [[np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]]
    if queries.num_rows and corpus.num_rows:
        corpus = corpus.sort_by([("grp", "ascending"), ("id", "ascending")])
        ids, groups = corpus.column("id").to_numpy(), corpus.column("grp").to_numpy()
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(groups)])
        qids, left, right = queries.column("id").to_numpy(), _unit(queries), _unit(corpus)
        strip = min(STRIP_ROWS, max(1, STRIP_CELLS // len(ids)))
        for at in range(0, len(qids), strip):
            sims = left[at:at + strip] @ right.T
            np.round(sims, TIE_DECIMALS, out=sims)
            if skip_self:
                sims[qids[at:at + strip][:, None] == ids[None, :]] = -np.inf
            if floor is not None:
                sims[sims < floor[at:at + strip][:, None]] = -np.inf
            if len(starts) == len(ids):
                rows, cols = _best(sims, k)
                found = (groups[cols], ids[cols], sims[rows, cols])
            else:
                tops = np.maximum.reduceat(sims, starts, axis=1)
                rows, cols = _best(tops, k)
                here = np.where(sims == np.repeat(tops, sizes, axis=1), np.arange(len(ids)), len(ids))
                first = np.minimum.reduceat(here, starts, axis=1)  # the smallest id among equals
                found = (groups[starts[cols]], ids[first[rows, cols]], tops[rows, cols])
            for part, values in zip(out, (rows + at, *found)):
                part.append(values)
    return tuple(np.concatenate(p) for p in out)


def _chunks(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``group, _chunks``: how many tasks the queries of a group are dealt out to."""
    return rows.groupBy(F.col(group).alias("group")).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("long").alias("_chunks"))


def _paired(queries: DataFrame, corpus: DataFrame, size: int):
    """Queries and corpus by (group, chunk), so that no task gets more than about ``size`` rows of either."""
    chunks = store(_chunks(queries, "group", size), "chunks")
    lhs = queries.join(chunks, "group").withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.col("_chunks"))).drop("_chunks")
    rhs = corpus.join(chunks, "group").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
    # own column identities, as both sides may come from one table
    lhs, rhs = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (lhs, rhs))
    return lhs.groupBy("group", "chunk").cogroup(rhs.groupBy("group", "chunk"))


def _visits(queries: DataFrame, corpus: Corpus, k: int, skip_self: bool, size: int) -> DataFrame:
    """Rows of ``FOUND`` from the blocks each query (id, vector, floor, home, visits) still has to meet."""
    layout = corpus.layout
    table = queries.sparkSession.createDataFrame(
        [(b, int(f), int(p)) for b, (f, p) in enumerate(zip(layout.first, layout.parts))], "block int, _first long, _parts long")
    stops = queries.select("id", F.explode("visits").alias("block"), "home").join(table, "block").select(
        "id", "home", F.explode(F.sequence("_first", F.col("_first") + F.col("_parts") - 1)).alias("group")).where("group <> home")
    asked = stops.join(queries.select("id", "vector", "floor"), "id").select("id", "vector", "floor", "group")

    def block(q: pa.Table, c: pa.Table) -> pa.Table:
        at, groups, ids, sims = _meet(q, c, k, skip_self, q.column("floor").to_numpy())
        return pa.table([q.column("id").to_numpy()[at] if len(at) else at, groups, ids, sims], schema=FOUND_ARROW)

    return _paired(asked, corpus.rows, size).applyInArrow(block, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` groups of each query, each by its best row, with ``rank``; ties go to smaller numbers."""
    best = F.max_by(F.struct("neighbour_id", "similarity"), F.struct("similarity", -F.col("neighbour_id"))).alias("_b")
    groups = found.groupBy("query_id", "grp").agg(best).select("query_id", "grp", "_b.neighbour_id", "_b.similarity")
    return top_n(groups, ["query_id"], [F.desc("similarity"), F.asc("grp")], k)


def best_groups(queries: DataFrame | None, corpus: DataFrame, k: int, skip_self: bool = False, pivots: int = PIVOTS,
                block_rows: int | None = None, grouped: bool = True) -> DataFrame:
    """The ``k`` best groups of ``corpus`` (id, grp, vector) for each query (id, vector; None: the corpus itself).

    Output: query_id, grp, neighbour_id (the best row of the group), similarity, rank. Without ``grouped`` every row is its
    own group.
    """
    laid = lay_out(corpus, pivots, block_rows)
    spark, layout, size = corpus.sparkSession, laid.layout, block_rows or BLOCK_ROWS
    if layout is None:
        return spark.createDataFrame([], FOUND + ", rank int")
    held = spark.sparkContext.broadcast(layout)
    if queries is None:
        asked = laid.rows.select("id", "vector", "group")
    else:
        asked = home_groups(queries, laid)
    kind = asked.schema["vector"].dataType.simpleString()

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        layout = held.value
        at, groups, ids, sims = _meet(q, c, k, skip_self)
        n = q.num_rows
        ends = np.searchsorted(at, np.arange(n + 1), "left")
        full = np.diff(ends) >= k
        floor = np.full(n, -np.inf)
        floor[full] = sims[ends[1:][full] - 1]
        visits = [np.zeros(0, "i4")]
        sizes = np.zeros(n, "i8")
        unit = _unit(q) if n else np.zeros((0, 0))
        for a in range(0, n, STRIP_ROWS):
            near = layout.within(unit[a:a + STRIP_ROWS], floor[a:a + STRIP_ROWS])
            sizes[a:a + STRIP_ROWS] = near.sum(axis=1)
            visits.append(np.nonzero(near)[1].astype("i4"))
        def lists(values, ends, kind):
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

        stops = lists(np.concatenate(visits), np.append(0, np.cumsum(sizes)), pa.int32())
        return pa.table({
            "id": q.column("id"), "vector": q.column("vector"), "home": q.column("group"), "floor": pa.array(floor), "visits": stops,
            "grp": lists(groups, ends, pa.int64()), "neighbour_id": lists(ids, ends, pa.int64()), "similarity": lists(sims, ends, pa.float64()),
        })

    state = store(_paired(asked, laid.rows, size).applyInArrow(
        first, f"id bigint, vector {kind}, home bigint, floor double, visits array<int>, {LISTS}"), "first-best")
    near = state.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("grp", "neighbour_id", "similarity")).alias("_x"))
    near = near.select("query_id", "_x.grp", "_x.neighbour_id", "_x.similarity")
    found = near.unionByName(_visits(state, laid, k, skip_self, size))
    if grouped:
        return _merged(found, k)
    return top_n(found, ["query_id"], [F.desc("similarity"), F.asc("neighbour_id")], k)


def home_groups(queries: DataFrame, laid: Corpus) -> DataFrame:
    """``id, vector, group``: the one group each query meets first."""
    rows = _clean(queries.select(F.col("id").cast("long"), "vector"))
    kind, held = rows.schema["vector"].dataType.simpleString(), rows.sparkSession.sparkContext.broadcast(laid.layout)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = held.value.home(_unit(batch))
            groups = held.value.first[block] + np.abs(batch.column(0).to_numpy()) % held.value.parts[block]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(groups, pa.int64())], names=["id", "vector", "group"])

    return store(rows.mapInArrow(assign, f"id bigint, vector {kind}, group bigint"), "queries")


def update_groups(state: DataFrame, queries: DataFrame, corpus: DataFrame, changed: DataFrame, k: int, pivots: int = PIVOTS,
                  block_rows: int | None = None) -> DataFrame:
    """The result of ``best_groups(queries, corpus, k)`` after a change, from its result before (``state``).

    ``queries`` (id, vector) and ``corpus`` (id, grp, vector) are as they are now; ``changed`` (id) names every row of either
    side that is new, has another vector or group, or is gone. Queries that changed, or one of whose groups was held by a
    row that did, meet the whole corpus again. All others meet the changed rows only, from their stored k-th best on.
    """
    ids = store(changed.select(F.col("id").cast("long").alias("id")).distinct(), "changed")
    state = state.select("query_id", "grp", "neighbour_id", "similarity")
    lost = state.join(ids.withColumnRenamed("id", "neighbour_id"), "neighbour_id", "left_semi").select(F.col("query_id").alias("id"))
    known = state.select(F.col("query_id").alias("id")).distinct().join(ids.unionByName(lost).distinct(), "id", "left_anti")
    floors = state.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(float("-inf")).alias("floor"))
    rows = store(_clean(queries.select(F.col("id").cast("long"), "vector")).join(known.join(floors, "id"), "id", "left"), "queries")
    fresh, kept = rows.where("floor IS NULL"), rows.where("floor IS NOT NULL")
    again = best_groups(fresh.select("id", "vector"), corpus, k, pivots=pivots, block_rows=block_rows)
    stored = state.join(kept.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    laid = lay_out(corpus.join(ids, "id", "left_semi"), pivots, block_rows)
    if laid.layout is not None:
        held = rows.sparkSession.sparkContext.broadcast(laid.layout)
        kind = rows.schema["vector"].dataType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, STRIP_ROWS):
                    strip = batch.slice(at, STRIP_ROWS)
                    reach = held.value.within(_unit(strip), strip.column(2).to_numpy())
                    ends = np.append(0, np.cumsum(reach.sum(axis=1)))
                    stops = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.nonzero(reach)[1], pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*strip.columns, pa.array(np.full(len(reach), -1)), stops], names=["id", "vector", "floor", "home", "visits"])

        asked = store(kept.select("id", "vector", "floor").mapInArrow(
            near, f"id bigint, vector {kind}, floor double, home bigint, visits array<int>"), "asked")
        stored = stored.unionByName(_visits(asked, laid, k, False, block_rows or BLOCK_ROWS))
    return _merged(stored, k).unionByName(again)
