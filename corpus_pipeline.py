"""A corpus from raw documents to packed sequences, a stage at a time.

Each stage gets the documents its predecessor kept and returns those it keeps, with the columns of ``documents``; the
last returns the pieces of packed sequences. Null and empty texts fail the quality rules and go there; cases of a stage
are those of its operator.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.common import discard, store, table
from tapeloom.llm.decontaminate import drop_leaking
from tapeloom.llm.line_dedup import drop_repeated_lines
from tapeloom.llm.near_text import near_duplicates
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.quality_rules import keep_good
from tapeloom.llm.simhash import keep_one
from tapeloom.llm.tokens import default_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base nor a learned rule rejects."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents share, which the largest id keeps; no document goes."""
    return drop_repeated_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are similar by 0.8 or more: the smallest id."""
    return keep_one(docs, find=near_duplicates)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of SimHash, as ``op10_simhash`` has them, and those of ``near`` join: the smallest id."""
    return keep_one(docs, find=partial(near_duplicates, with_simhash=True))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    placed = pack_documents(docs, default_vocabulary(), capacity=2048, end_id=0, ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", simhash),
    ("benchmark decontamination", benchmark),
    ("best-fit packing", pack),
]
ORACLE_SQL = None  # learned rules, XXH64 and token ids are beyond SQL; tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        discard(before)  # the table of the stage before, if one wrote it
    return STAGES[-1][1](spark, docs, sf_dir)
