"""Ordered work over long sequences without one task per key.

A recording may hold a large share of all rows, so nothing here sorts a whole recording in one task.
Rows are cut into chunks of the ordering column; windows run inside (key, chunk), and what has to
cross a chunk edge travels through a table with one row per (key, chunk). Where positions have no gaps,
the rows at the edges are copied over instead and no second pass is needed.

Helpers that need such a table read their input twice; chains of them start from ``cut_lineage`` tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import store

CHUNK_ROWS = 4096


def _chunked(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("long"))


def _spread(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks of a key to tasks of their own. Rows that already lie by key would satisfy a window over (key, chunk) as
    they are, and a key with a third of all rows would be sorted in one task."""
    return rows.repartition(*keys, "_chunk")


def ordinal(
    df: DataFrame, keys: list[str], order: str, tie: str, width: float,
    out: str = "idx", total: str | None = None,
) -> DataFrame:
    """0-based position of each row of a key, and optionally the row count of the key."""
    rows = _chunked(df, order, width)
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_chunk")
    offsets = sizes.withColumn(
        "_before",
        F.coalesce(F.sum("_rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    if total:
        offsets = offsets.withColumn(total, F.sum("_rows").over(Window.partitionBy(*keys)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order, tie)
    return (
        _spread(rows, keys).withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets.drop("_rows"), [*keys, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_before", "_local", "_chunk")
    )


def running_total(
    df: DataFrame, keys: list[str], order: str, tie: str, value: Column, width: float, out: str,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the key up to and including the row.

    The sums of earlier chunks come from ``totals_from`` where a smaller table with the same non-zero
    values exists, so that ``df`` is read once.
    """
    rows = _chunked(df, order, width).withColumn("_v", value)
    source = rows if totals_from is None else _chunked(totals_from, order, width).withColumn("_v", value)
    sums = source.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_s"))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(order, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = _spread(rows, keys).withColumn("_local", F.sum("_v").over(inside))
    if totals_from is not None:
        # A chunk may have no row in the smaller table, so name the chunks that follow it.
        chunks = df.groupBy(*keys).agg(F.max(F.floor(F.col(order) / F.lit(width))).cast("long").alias("_last"))
        every = chunks.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), "_last"))).drop("_last")
        sums = every.join(sums, [*keys, "_chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_chunk", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    return (
        local.join(offsets, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_v", "_before", "_local", "_chunk")
    )


def adjacent(
    df: DataFrame, keys: list[str], idx: str, cols: list[str], out: str, ahead: bool = False, size: int = CHUNK_ROWS
) -> DataFrame:
    """Struct of ``cols`` of the row at the previous (or next) position; positions have no gaps."""
    rows = _spread(with_halo(df, idx, 0 if ahead else 1, 1 if ahead else 0, size), keys)
    w = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(idx) if ahead else F.asc(idx))
    return rows.withColumn(out, F.lag(F.struct(*cols)).over(w)).filter("_core").drop("_chunk", "_core")


def neighbour(
    df: DataFrame, keys: list[str], order: str, tie: str, cols: list[str], width: float,
    out: str, ahead: bool = False,
) -> DataFrame:
    """Struct of ``cols`` of the previous (or next) row of the key, null at the end."""
    rows = _chunked(df, order, width).withColumn("_pick", F.struct(*cols))
    edge = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*keys, "_chunk").agg(edge("_pick", F.struct(order, tie)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy(F.desc("_chunk") if ahead else F.asc("_chunk"))
    edges = edges.select(*keys, "_chunk", F.lag("_edge").over(along).alias("_outside"))
    if ahead:
        inside = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(order), F.desc(tie))
    else:
        inside = Window.partitionBy(*keys, "_chunk").orderBy(order, tie)
    return (
        _spread(rows, keys).withColumn("_inside", F.lag("_pick").over(inside))
        .join(edges, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_inside", "_outside"))
        .drop("_pick", "_inside", "_outside", "_chunk")
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: str, tie: str, value: Column, width: float, out: str
) -> DataFrame:
    """Last non-null ``value`` of the key up to and including the row."""
    rows = _chunked(df, order, width).withColumn("_v", value)
    lasts = rows.groupBy(*keys, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(order, tie))).alias("_last")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*keys, "_chunk", F.last("_last", ignorenulls=True).over(before).alias("_outside"))
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(order, tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        _spread(rows, keys).withColumn("_inside", F.last("_v", ignorenulls=True).over(inside))
        .join(lasts, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_inside", "_outside"))
        .drop("_v", "_inside", "_outside", "_chunk")
    )


def consecutive_ids(counts: DataFrame, key: str, count: str, out: str, size: int = CHUNK_ROWS) -> DataFrame:
    """First global id of each key when ids run on over keys in ascending order; keys may be any numbers.

    ``counts`` has one row per key. Rows are sorted by sampled ranges and written, so that each knows its task and place.
    Sums run inside chunks of ``size`` rows, over the chunks of a task, and over the tasks: one row per task meets in one window.
    """
    at = F.monotonically_increasing_id().alias("_at")  # task in the upper 31 bits, place in the lower 33
    rows = store(counts.orderBy(key).select("*", at), "ids")
    rows = rows.withColumn("_task", F.shiftright("_at", 33)).withColumn("_chunk", F.floor(F.col("_at") / F.lit(size)).cast("long"))
    chunks = rows.groupBy("_task", "_chunk").agg(F.sum(count).alias("_s"))
    tasks = chunks.groupBy("_task").agg(F.sum("_s").alias("_s"))

    def before(w, value: str) -> Column:
        return F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    chunks = chunks.select("_task", "_chunk", before(Window.partitionBy("_task").orderBy("_chunk"), "_s").alias("_chunks_before"))
    tasks = tasks.select("_task", before(Window.orderBy("_task"), "_s").alias("_tasks_before"))
    return (
        rows.withColumn("_local", before(Window.partitionBy("_task", "_chunk").orderBy("_at"), count))
        .join(chunks, ["_task", "_chunk"]).join(tasks, "_task")
        .withColumn(out, (F.col("_tasks_before") + F.col("_chunks_before") + F.col("_local")).cast("long"))
        .drop("_at", "_task", "_chunk", "_local", "_chunks_before", "_tasks_before")
    )


def with_halo(df: DataFrame, idx: str, rows_before: int, rows_after: int, size: int = CHUNK_ROWS) -> DataFrame:
    """Copy rows near a chunk edge into the neighbouring chunk; ``_core`` marks the original."""
    home = F.floor(F.col(idx) / size).cast("long")
    first = F.floor((F.col(idx) - rows_after) / size).cast("long")
    last = F.floor((F.col(idx) + rows_before) / size).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn(
        "_core", F.col("_chunk") == home
    )


def _changes(table: pa.Table, by: list[str]) -> np.ndarray:
    """Row numbers at which a new group starts."""
    n = table.num_rows
    differs = np.zeros(n, dtype=bool)
    if n:
        differs[0] = True
    for name in by:
        col = table.column(name).to_numpy()
        differs[1:] |= col[1:] != col[:-1]
    return np.flatnonzero(differs)


def map_groups(
    df: DataFrame, by: list[str], order: list[str],
    fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str,
) -> DataFrame:
    """Apply ``fn`` to Arrow tables of whole, ordered groups.

    One shuffle on ``by``, one sort inside the partitions. ``fn`` gets many groups at once with the
    row numbers at which they start, so it can work on whole columns. Groups must be bounded (chunks).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            cut = int(_changes(table, by)[-1])
            if cut:
                done = table.slice(0, cut).combine_chunks()
                yield from fn(done, _changes(done, by)).to_batches()
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            done = pa.Table.from_batches(held)
            yield from fn(done, _changes(done, by)).to_batches()

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """List column of equal-length vectors as a 2-D array in double."""
    col = table.column(column).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, zero rows kept."""
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norms == 0, 1.0, norms)
