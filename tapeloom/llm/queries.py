"""The operators as named queries over the given tables, with DuckDB twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.brown import score_texts
from tapeloom.llm.common import new_folder, table
from tapeloom.llm.decontaminate import find_leaks
from tapeloom.llm.html_text import extract_text
from tapeloom.llm.licenses import scan_licenses
from tapeloom.llm.line_dedup import drop_repeated_lines
from tapeloom.llm.packing import pack_documents
from tapeloom.llm.pii import personal_data
from tapeloom.llm.quality_rules import RATIOS, fit, judge
from tapeloom.llm.resampling import resample
from tapeloom.llm.simhash import fingerprint_text, near_duplicates
from tapeloom.llm.spelling import group_spellings
from tapeloom.llm.token_files import id_digests, open_token_files, token_starts, write_token_files
from tapeloom.llm.token_scan import document_counts
from tapeloom.llm.tokens import default_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "rule", *RATIOS)


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, counted between end ids in flat files; 49408 is the first number the vocabulary leaves free."""
    return document_counts(table(spark, sf_dir, "documents"), default_vocabulary(), end_id=49408)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = pack_documents(table(spark, sf_dir, "documents"), default_vocabulary(), capacity=2048, end_id=0, ids=False)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), folder, default_vocabulary(), end_id=2)
    files = open_token_files(spark, folder)
    read = token_starts(files, id_digests(files))
    return read.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = """WITH lines AS (
  SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(str_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id < s.keep AS gone FROM keyed k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_text("fp").alias("fingerprint"), "component_id")


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it; other documents have none."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(table(spark, sf_dir, "documents"))


@query
def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


@query
def op13_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
