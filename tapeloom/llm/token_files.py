"""Token ids as Parquet list columns that can be read selectively.

Rows are in ascending document order over the files and inside each; ids are dictionary coded, the numbers beside them
delta coded, row groups and pages are small and carry page indexes. So a range of documents is found by the statistics
of files, row groups and pages, and counts are read without touching ids.

Columns: ``doc_id``, ``part`` and ``begin`` (place of the first id among the ids of its part), ``n_tokens``, ``tokens``.

Cases: a null or empty text has the end id only. A null id comes first. Rows with equal id stay, in order of their
text's hash; equal rows are interchangeable. An empty table gives an empty one. Other columns are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import BATCH_BYTES, arrow_schema, texts
from tapeloom.llm.tokens import word_ids

FILE_SCHEMA = "doc_id bigint, part bigint, begin bigint, n_tokens int, tokens array<int>"
FILE_OPTIONS = {
    "parquet.writer.version": "v2",  # integers without a dictionary are delta coded
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#begin": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
}


def _encoder(vocabulary: str, end_id: int):
    schema = arrow_schema(FILE_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, begin = word_ids(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        names, begins, sizes, data, held = [], [], [], [], 0

        def flush():
            counts = np.array(sizes, np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(data), "<i4"))
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([part] * len(names), pa.int64()), pa.array(begins, pa.int64()),
                 pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), values).cast(pa.list_(pa.int32()))], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = ids.encode(text) + end
                names.append(doc)
                begins.append(begin)
                sizes.append(len(coded) // 4)
                data.append(coded)
                begin += sizes[-1]
                held += len(coded)
                if held >= BATCH_BYTES:
                    yield flush()
                    names, begins, sizes, data, held = [], [], [], [], 0
        if names:
            yield flush()

    return run


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, each closed by ``end_id``, into ``folder``."""
    rows = texts(docs, id_col, text_col).withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")
    rows.mapInArrow(_encoder(vocabulary, end_id), FILE_SCHEMA).write.options(**FILE_OPTIONS).parquet(folder)


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files as a table; a filter on ``doc_id`` reaches row groups and pages, unused columns are not read."""
    return spark.read.schema(FILE_SCHEMA).parquet(folder)


def token_starts(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (``files`` or what was made of them, with ``part`` and ``begin``) with ``start``: ids of all documents before.

    Narrow columns of the files are summed to one row for each part, and these in order; documents need no common order.
    """
    parts = files.groupBy("part").agg(F.max(F.col("begin") + F.col("n_tokens")).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = files if rows is None else rows
    return rows.join(parts, "part").withColumn("start", F.col("_before") + F.col("begin")).drop("_before")


def id_digests(files: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` (unsigned, over little-endian unsigned 32-bit ids) and the length of the list as read."""
    keep = [c for c in files.columns if c != "tokens"]
    schema = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in keep) + ", n_read bigint, ids_crc32 bigint"
    made = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ends = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
            crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], schema=made)

    return files.select(*keep, "tokens").mapInArrow(run, schema)
