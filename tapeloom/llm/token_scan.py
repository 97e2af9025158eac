"""Token counts of documents in flat token files that hold nothing but ids.

Files are read in blocks of fixed size. Each task searches its block for the end id with one vectorised comparison and
gives the places found. A running maximum over the blocks of a file, then over one row per file, says where the last
document before a block ended, which joins documents that cross blocks or files. No task sees a whole file.

``write_flat`` makes such files (ids as little-endian unsigned 16- or 32-bit numbers) and a table of which document is
the n-th of which file.

Cases: a null or empty text is a document of 0 ids. Ids after the last end id are an open document (``closed`` false).
Rows with equal or null id keep their rows. An empty table gives an empty one. A file's name is its attempt's own; a
repeated task writes another file, and only files named in the table of files are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import BATCH_BYTES, Rows, new_folder, store, texts
from tapeloom.llm.tokens import word_ids

WRITTEN = "file_no bigint, file string, nth bigint, doc_id bigint, n_bytes bigint"
FOUND = "file_no bigint, block bigint, begin bigint, n_ids bigint, ends array<bigint>"
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, vocabulary: str, end_id: int, width: int = 2, folder: str | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one flat file per task; one row per document, and one per file with ``nth`` null and its ``n_bytes``."""
    folder = folder or new_folder(docs.sparkSession, "flat")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, out = word_ids(vocabulary), TaskContext.get(), Rows(WRITTEN)
        store_, path = fs.FileSystem.from_uri(folder)
        store_.create_dir(path, recursive=True)
        name = f"{path}/part-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        kind, end, nth, size, held, bytes_held = f"<u{width}", np.array([end_id], "<u4").tobytes(), 0, 0, [], 0
        with store_.open_output_stream(name) as to:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.append(words.encode(text) + end)
                    bytes_held += len(held[-1])
                    out.add(task.partitionId(), name, nth, doc, None)
                    nth += 1
                    if bytes_held >= BATCH_BYTES:
                        size += to.write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
                        held, bytes_held = [], 0
                if out.full():
                    yield from out.take()
            size += to.write(np.frombuffer(b"".join(held), "<u4").astype(kind).tobytes())
        out.add(task.partitionId(), name, None, None, size)
        yield from out.take()

    df = texts(docs, id_col, text_col).mapInArrow(run, WRITTEN)
    out = store(df, "flat-rows")
    out._flat = folder
    return out


def scan_blocks(files: DataFrame, folder: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Places of ``end_id``, counted from the start of the file, for each block of ``files`` (file_no, file, n_bytes)."""
    step = block_bytes - block_bytes % width
    last = F.greatest(F.ceil(F.col("n_bytes") / step) - 1, F.lit(0))
    blocks = files.select("file_no", "file", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, _ = fs.FileSystem.from_uri(folder)
        out, name, source = Rows(FOUND), None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != name:
                    name, source = row["file"], store_.open_input_file(row["file"])
                ids = np.frombuffer(source.read_at(step, row["block"] * step), f"<u{width}")
                begin = row["block"] * step // width
                ends = np.flatnonzero(ids == end_id) + begin
                out.add(row["file_no"], row["block"], begin, len(ids), ends, size=8 * len(ends) + 64)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return blocks.repartition("file_no", "block").mapInArrow(run, FOUND)


def token_counts(files: DataFrame, folder: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file_no, nth, start, n_tokens, closed`` for each document of the files in order of ``file_no``.

    ``nth`` counts the ends in a file, ``start`` the ids and end ids of all files before the document, ``n_tokens`` its
    ids without the end id. An open last document belongs to the last file.
    """
    found = store(scan_blocks(files, folder, end_id, width, block_bytes), "found-ends")
    held = found.groupBy("file_no").agg(F.sum("n_ids").alias("_ids"), F.max(F.array_max("ends")).alias("_last"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_base", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)))
    held = held.withColumn("_carry", F.coalesce(F.max(F.col("_base") + F.col("_last")).over(earlier), F.lit(-1)))
    before = Window.partitionBy("file_no").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        found.withColumn("_prev", F.max(F.array_max("ends")).over(before))
        .withColumn("_nth", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .join(held, "file_no")
        .withColumn("_prev", F.coalesce(F.col("_prev") + F.col("_base"), F.col("_carry")))
    )
    closed = blocks.select("file_no", "_nth", "_base", "_prev", "ends", F.posexplode("ends").alias("_i", "_end")).select(
        "file_no", (F.col("_nth") + F.col("_i")).alias("nth"), (F.col("_end") + F.col("_base")).alias("_end"),
        F.when(F.col("_i") > 0, F.col("ends")[F.col("_i") - 1] + F.col("_base")).otherwise(F.col("_prev")).alias("_before"),
    ).select("file_no", "nth", (F.col("_before") + 1).alias("start"),
             (F.col("_end") - F.col("_before") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = held.agg(F.max("file_no").alias("file_no"), F.sum("_ids").alias("_all"), F.max(F.col("_base") + F.col("_last")).alias("_end"))
    ends = ends.withColumn("_end", F.coalesce("_end", F.lit(-1))).where(F.col("_all") - 1 > F.col("_end"))
    rest = ends.select("file_no", F.lit(None).cast("bigint").alias("nth"), (F.col("_end") + 1).alias("start"),
                       (F.col("_all") - F.col("_end") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def document_counts(docs: DataFrame, vocabulary: str, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write flat files, scan them, and give each document its count: ``doc_id, file_no, nth, start, n_tokens``."""
    rows = write_flat(docs, vocabulary, end_id, width, None, id_col, text_col)
    counts = token_counts(rows.where("nth IS NULL").select("file_no", "file", "n_bytes"), rows._flat, end_id, width, block_bytes)
    names = rows.where("nth IS NOT NULL").select("file_no", "nth", "doc_id")
    return names.join(counts.where("closed").drop("closed"), ["file_no", "nth"]).select("doc_id", "file_no", "nth", "start", "n_tokens")
