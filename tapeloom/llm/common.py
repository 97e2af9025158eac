"""Written tables in the shared folder, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import discard, new_folder, store  # noqa: F401

BATCH_BYTES = 8 << 20  # what a task gathers before it hands a batch on


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under their own names; a null text is an empty one."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def with_text(docs: DataFrame, text, text_col: str = "text") -> DataFrame:
    """``docs`` with another text; ``n_chars``, if there, follows it."""
    out = docs.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def hash_share(hashed: Column, rows: int, total: int) -> Column:
    """Rows whose 64-bit hash lies in the lowest part that holds ``rows`` of ``total`` on average; all if there are no more."""
    if rows >= total:
        return F.lit(True)
    return hashed < F.lit(-(1 << 63) + (rows << 64) // total)


KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
         "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}


def arrow_schema(columns: str) -> pa.Schema:
    """Arrow's form of ``"name type, ..."``; tasks have no session to parse it with."""
    return pa.schema([(name, KINDS[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


class Rows:
    """Gathers output rows of a task and gives them as Arrow batches of bounded size."""

    def __init__(self, schema: str):
        self.schema = arrow_schema(schema)
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row, size: int = 64) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes >= BATCH_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema, strict=True)]
            self.rows, self.bytes = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
