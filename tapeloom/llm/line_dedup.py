"""Lines that many documents share, found with two Bloom filters.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code
points found in at least ``min_docs`` documents lose all their lines except those in the largest document id.

1. Each task hashes the keys of its documents and hands on, per slice of the filters, which bits its keys set: in the
   first filter every key, in the second those it met in two documents. Merging a slice, a bit that two tasks set in
   the first filter is set in the second. So the second filter holds every key of two documents, and a few others.
2. It goes to all tasks; its size is the parameter ``filter_bits``, whatever the corpus. Only keys found in it shuffle,
   as (document, 128-bit digest), to be counted exactly. A fuller filter lets more keys through; answers stay exact.
3. Digests that are to go are listed per document and joined to the texts once.

A key in a third of all documents is summed up before it is shuffled, and its join can be split.

Cases: a null or empty text is one empty line and stays as it is. A null id is no holder and its text stays. Rows with
equal id are one document. An empty table gives an empty one. Other columns pass through; ``n_chars`` follows the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import Rows, store, texts

WHITE = " \t\n\x0b\x0c\r"
FILTER_BITS, SLICE_BITS = 1 << 28, 1 << 20  # 32 MB for each filter; parameters, not fitted to the input
BITS = "slice int, once binary, twice binary"


def line_digest(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of the line's key, none for short keys."""
    key = line.strip(WHITE)
    return hashlib.blake2b(key.encode().lower(), digest_size=16).digest() if len(key) >= min_chars else None


def _digests(text: str, min_chars: int) -> set[bytes]:
    return {d for line in text.split("\n") if (d := line_digest(line, min_chars))}


def _places(digests: np.ndarray, filter_bits: int) -> np.ndarray:
    """Two bits for each digest (given as two numbers), one row each."""
    return digests & np.uint64(filter_bits - 1)


def _numbers(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def twice_seen(docs: DataFrame, min_chars: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The second filter as rows ``slice, twice`` of packed bits; slices without bits are left out."""
    slice_bits = min(SLICE_BITS, filter_bits)
    slices = filter_bits // slice_bits

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            seen.append(_numbers([d for t in batch.column(0) for d in _digests(t.as_py(), min_chars)]))
        if not seen:
            return
        keys, times = np.unique(np.concatenate(seen), axis=0, return_counts=True)
        bits = _places(keys, filter_bits)
        once, twice = np.unique(bits), np.unique(bits[times > 1])
        edges = np.arange(slices + 1, dtype=np.uint64) * np.uint64(slice_bits)
        cut1, cut2, out = np.searchsorted(once, edges), np.searchsorted(twice, edges), Rows(BITS)
        for s in np.flatnonzero(np.diff(cut1)).tolist():
            a, b = once[cut1[s]:cut1[s + 1]], twice[cut2[s]:cut2[s + 1]]
            out.add(s, (a - edges[s]).astype("<u4").tobytes(), (b - edges[s]).astype("<u4").tobytes(), size=4 * (len(a) + len(b)) + 64)
            if out.full():
                yield from out.take()
        yield from out.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice, out = None, None, None, Rows("slice int, twice binary")
        for batch in batches:
            for s, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if s != now:
                    if now is not None and twice.any():
                        out.add(now, np.packbits(twice, bitorder="little").tobytes(), size=slice_bits // 8)
                    now, once, twice = s, np.zeros(slice_bits, bool), np.zeros(slice_bits, bool)
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
            if out.full():
                yield from out.take()
        if now is not None and twice.any():
            out.add(now, np.packbits(twice, bitorder="little").tobytes())
        yield from out.take()

    marked = docs.select("text").mapInArrow(mark, BITS).repartition("slice").sortWithinPartitions("slice")
    return marked.mapInArrow(merge, "slice int, twice binary")


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int = FILTER_BITS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` of the keys each document loses."""
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    slice_bits = min(SLICE_BITS, filter_bits)
    bits = np.zeros(filter_bits // 8, np.uint8)
    for r in twice_seen(rows, min_chars, filter_bits).collect():  # filter_bits in all
        at = r["slice"] * slice_bits // 8
        bits[at:at + slice_bits // 8] = np.frombuffer(r["twice"], np.uint8)
    second = spark.sparkContext.broadcast(bits)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Rows("doc_id bigint, digest binary"), second.value
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                digests = list(_digests(text.as_py(), min_chars))
                if digests:
                    p = _places(_numbers(digests), filter_bits)
                    hit = (held[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)
                    for i in np.flatnonzero(hit).tolist():
                        out.add(doc.as_py(), digests[i])
            if out.full():
                yield from out.take()
        yield from out.take()

    seen = store(rows.mapInArrow(suspects, "doc_id bigint, digest binary"), "suspect-lines")
    known = seen.groupBy("digest").agg(F.count_distinct("doc_id").alias("_n"), F.max("doc_id").alias("_keep"))
    # written, so that both sides of the join are plain reads and a digest of very many documents can be split
    known = store(known.where(F.col("_n") >= min_docs).select("digest", "_keep"), "shared-lines")
    return seen.join(known, "digest").where("doc_id < _keep").select("doc_id", "digest")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, filter_bits: int = FILTER_BITS,
                        counts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated lines; with ``counts``, also ``n_lines`` (before) and ``n_dropped``."""
    gone = repeated_lines(docs, min_chars, min_docs, filter_bits, id_col, text_col)
    gone = gone.groupBy("doc_id").agg(F.collect_set("digest").alias("gone"))
    rows = docs.drop("n_lines", "n_dropped") if counts else docs
    own = F.struct(*(F.col(c) for c in rows.columns)).alias("row")  # columns of the caller may have any name
    both = rows.select(own, F.col(id_col).cast("long").alias("doc_id")).join(gone, "doc_id", "left").select("row", "gone")
    at, size = rows.columns.index(text_col), "n_chars" in rows.columns and rows.columns.index("n_chars")
    schema = (rows.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long")}) if counts else rows).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, lost = [], [], []
            columns = batch.column(0).flatten()
            for text, gone_ in zip(columns[at], batch.column(1)):
                text, drop = text.as_py(), set(gone_.as_py() or ())
                lines = (text or "").split("\n")
                stay = [x for x in lines if line_digest(x, min_chars) not in drop] if drop else lines
                kept.append("\n".join(stay) if drop else text)
                total.append(len(lines))
                lost.append(len(lines) - len(stay))
            columns[at] = pa.array(kept, columns[at].type)
            if size is not False:
                same = [n if not d else len(t) for n, t, d in zip(columns[size].to_pylist(), kept, lost)]
                columns[size] = pa.array(same, columns[size].type)
            columns += [pa.array(total, pa.int64()), pa.array(lost, pa.int64())] if counts else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return both.mapInArrow(run, schema)
