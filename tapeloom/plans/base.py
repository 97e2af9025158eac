"""Archive entities as views over the given tables, and the query registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.ordered import CHUNK_ROWS, ordinal
from tapeloom.session import store
from tapeloom.sources.store import load_segments

# One text per view for both engines. @DAYS, @SECS, @LIST and @D are filled in per engine; names in
# braces are the tables or views read.
PATH = """CASE o_orderkey % 4 WHEN 0 THEN concat('Temas/Song-', CAST(o_custkey AS STRING), '/Song-',
  CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 8 = 0 THEN '_Demo' ELSE
  concat('_', CAST(CAST(o_orderdate AS DATE) AS STRING)) END, '.mp3')
  WHEN 1 THEN concat('Jams/', CAST(CAST(o_orderdate AS DATE) AS STRING), '/Jam-', CAST(o_custkey AS STRING), '%3f.mp3')
  WHEN 2 THEN concat('Assajos/', CAST(CAST(o_orderdate AS DATE) AS STRING), CASE WHEN o_orderkey % 8 = 2
  THEN ' ft guest/ZOOM0001_LR.WAV' ELSE '.WAV' END)
  ELSE concat('Old/12%3a12 - ', CAST(1 + o_custkey % 28 AS STRING), ' Març/Tema ', CAST(o_orderkey AS STRING),
  CASE WHEN o_orderkey % 8 = 3 THEN '.txt' ELSE '.MP3' END) END"""

VIEWS = {
    "sessions": """SELECT DISTINCT CAST(@DAYS AS BIGINT) AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) AS date,
  @DAYS % 97 = 0 AS date_uncertain, CASE WHEN @DAYS % 13 = 0 THEN 'ft guest' END AS notes FROM {orders}""",
    "songs": """SELECT p_partkey AS id, p_name AS title, concat(lower(replace(p_name, ' ', '-')), '-', CAST(p_partkey AS STRING)) AS slug,
  CASE p_partkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'cover' ELSE 'jam' END AS song_type,
  CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS cover_of FROM {part}""",
    "recordings": f"""SELECT id, session_id, song_id, title, @LIST(path) AS source_path, path AS source, audio_path,
  CASE WHEN origin = 'vad_segment' THEN offset_seconds END AS start_offset_seconds,
  CASE WHEN origin = 'vad_segment' THEN offset_seconds + duration_seconds END AS end_offset_seconds,
  duration_seconds, origin, content_type, content_type_source FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(@DAYS AS BIGINT) END AS session_id,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey * 4 + o_orderkey % 4) % (SELECT count(*) FROM {{part}}) END AS song_id,
  CASE WHEN o_orderkey % 7 <> 0 THEN concat('Tema ', CAST(o_custkey % 200 AS STRING)) END AS title,
  {PATH} AS path, CAST(o_custkey AS DOUBLE) AS offset_seconds,
  CASE WHEN o_orderkey % 13 <> 0 THEN concat('recordings/', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 2 = 0
  THEN '' ELSE concat('_take-', CAST(o_custkey AS STRING)) END, '.mp3') END AS audio_path,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'vad_segment' ELSE 'pretrimmed' END AS origin,
  CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice / @D(1000) END AS duration_seconds,
  CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 17 = 1 THEN NULL WHEN o_custkey % 3 = 2 THEN 'jam' ELSE 'song_take' END
  WHEN o_orderkey % 2 = 0 THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'banter' WHEN '2-HIGH' THEN 'tuning'
  WHEN '3-MEDIUM' THEN 'noodling' WHEN '4-NOT SPECIFIED' THEN 'jam' ELSE 'silence' END END AS content_type,
  CASE WHEN o_orderkey % 3 <> 0 THEN CASE WHEN o_orderkey % 17 <> 1 THEN 'ingest' END WHEN o_orderkey % 2 = 0 THEN
  CASE WHEN o_orderstatus = 'F' THEN 'human' ELSE 'auto' END END AS content_type_source FROM {{orders}}) t""",
    "segments": """SELECT id, recording_id, (i - 1) * @D(10) AS start_seconds, (i - 1) * @D(10) + @D(20) AS end_seconds, vec_id,
  mean_rms, mean_spectral_centroid FROM (
  SELECT event_id AS id, user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
  CASE WHEN event_id % 41 <> 0 THEN event_id % (SELECT count(*) FROM {embeddings}) END AS vec_id,
  CASE WHEN event_id % 29 <> 0 THEN value / @D(1000) END AS mean_rms,
  CASE WHEN event_id % 31 <> 0 THEN @D(500) + (event_id * 37) % 4000 END AS mean_spectral_centroid FROM {events}) e""",
    "candidates": """SELECT o_orderkey * 3 + r AS id, o_orderkey AS recording_id, (o_custkey * 4 + r) % (SELECT count(*) FROM {part}) AS song_id,
  o_orderkey + 1 AS nearest_recording_id, (1000 - ((o_orderkey * 37) % 700) - r * 100) / @D(1000) AS confidence,
  CAST(r AS BIGINT) AS rank, CASE WHEN (o_orderkey + r) % 5 = 0 THEN 'rejected' WHEN (o_orderkey + r) % 31 = 1 THEN 'accepted'
  ELSE 'pending' END AS status, CAST(NULL AS @TS) AS reviewed_at
  FROM (SELECT o_orderkey, o_custkey, @UNNEST(@LIST(1, 2, 3)) AS r FROM {orders} WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 <> 1) k""",
    "processing_log": """SELECT o_orderkey AS recording_id, CASE o_orderkey % 4 WHEN 0 THEN 'ingest' WHEN 1 THEN 'librosa' WHEN 2
  THEN 'clap' ELSE 'coverhunter' END AS step, CAST(1 + o_custkey % 2 AS STRING) AS version, CASE o_orderstatus WHEN 'F' THEN
  'success' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS status, o_orderdate AS completed_at,
  CAST(NULL AS STRING) AS error_message FROM {orders}""",
    "frames": "SELECT user_id AS recording_id, @SECS AS t, value, event_id AS frame_id FROM {events}",
    "archive_paths": f"SELECT {PATH} AS path, CAST(floor(o_totalprice) AS BIGINT) AS length FROM {{orders}}",
    "points": """SELECT id AS segment_id, recording_id, start_seconds, end_seconds, ((id * 7919) % 10007) / @D(1000) AS x,
  ((id * 10459) % 10009) / @D(1000) AS y FROM {segments} WHERE id % 17 <> 0""",
    "clusters": """SELECT id AS segment_id, id % 9 - 1 AS cluster_id, CASE (id * 7) % 5 WHEN 0 THEN 'original' WHEN 1 THEN 'cover'
  WHEN 2 THEN 'jam' WHEN 3 THEN 'non-musical' ELSE 'unreviewed' END AS effective_type, mean_rms, mean_spectral_centroid
  FROM {segments}""",
    "levels": """SELECT user_id AS recording_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * @D(1) AS t,
  value / @D(10) - @D(48) AS level FROM {events}""",
    # some are invalid: an unknown type, or a take without its song
    "decision_log": """SELECT o_orderkey AS seq, CASE o_orderkey % 9 WHEN 0 THEN 'assign' WHEN 1 THEN 'unassign' WHEN 2 THEN 'accept'
  WHEN 3 THEN 'reject' WHEN 4 THEN 'revert' WHEN 5 THEN 'batch_classify' WHEN 6 THEN 'split' ELSE 'classify' END AS kind,
  3 * k AS recording_id, CASE WHEN o_orderkey % 9 = 0 OR (o_orderkey % 9 = 7 AND o_orderkey % 13 <> 0) THEN o_orderkey % (SELECT count(*) FROM {part}) END AS song_id,
  CASE WHEN o_orderkey % 9 IN (2, 3) THEN 9 * k + 1 + o_orderkey % 3 END AS candidate_id,
  CASE o_orderkey % 9 WHEN 5 THEN CASE WHEN o_orderkey % 11 = 0 THEN 'nonsense' ELSE 'noodling' END WHEN 7 THEN 'song_take' WHEN 8 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'jam'
  ELSE 'banter' END END AS content_type, CASE WHEN o_orderkey % 9 = 6 THEN o_totalprice / @D(2000) END AS split_at,
  o_orderdate AS at FROM (SELECT *, (o_custkey * 10 + o_orderkey % 10) % (SELECT CAST(ceil(count(*) * 10 / 3.0) AS BIGINT) FROM {customer}) AS k FROM {orders}) t""",
}

SPARK_MACROS = {
    "@DAYS": "datediff(CAST(o_orderdate AS DATE), DATE'1994-12-31')",
    "@SECS": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / 1e6D)",
    "@LIST": "array", "@UNNEST": "explode", "@TS": "TIMESTAMP_NTZ",
}
SQL_MACROS = {
    "@DAYS": "datediff('day', DATE '1994-12-31', CAST(o_orderdate AS DATE))",
    "@SECS": "((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1000000 AS DOUBLE))",
    "@LIST": "list_value", "@UNNEST": "unnest", "@TS": "TIMESTAMP",
}
def half_up(expr: str, digits: int) -> str:
    """DuckDB text of the operators' rounding: half up in decimal, after dropping float noise."""
    return f"CAST(round(CAST(round({expr}, 12) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


# Views the SQL twins use on top of the entities. Text is DuckDB's.
SQL_VIEWS = {
    "decisions": "SELECT * FROM decision_log WHERE coalesce(content_type, '') <> 'nonsense' AND NOT (kind = 'classify' AND content_type = 'song_take' AND song_id IS NULL)",
    "seg_vec": """SELECT s.id AS segment_id, s.recording_id, s.start_seconds, s.end_seconds, s.mean_rms, s.mean_spectral_centroid,
  CAST(e.embedding AS DOUBLE[]) AS embedding FROM segments s JOIN embeddings e USING (vec_id) JOIN recordings r ON r.id = s.recording_id""",
    "indexed": """SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_seconds, segment_id) - 1 AS idx,
  count(*) OVER (PARTITION BY recording_id) AS n FROM seg_vec""",
    "blocks": f"""SELECT g.*, sum(1) OVER (PARTITION BY recording_id ORDER BY grp) AS _o FROM (
  SELECT i.recording_id, CAST(floor(i.idx / 4) AS BIGINT) AS grp, min(start_seconds) AS start_seconds, max(end_seconds) AS end_seconds,
  count(*) AS segment_count, {half_up('avg(mean_rms)', 6)} AS mean_rms, {half_up('avg(mean_spectral_centroid)', 2)} AS mean_spectral_centroid,
  round(max(end_seconds) - min(start_seconds), 2) AS duration FROM indexed i GROUP BY 1, 2) g""",
    "passages": """SELECT b.recording_id, b.grp, b.start_seconds, b.end_seconds, b.segment_count, b.mean_rms, b.mean_spectral_centroid,
  b.duration, b.grp AS passage_type, row_number() OVER (ORDER BY b.recording_id, b.grp) - 1 AS passage_id, v.session_date, v.song_title,
  v.effective_type FROM blocks b JOIN rec_types v USING (recording_id)""",
    "rec_types": """SELECT r.id AS recording_id, r.title AS recording_title, r.audio_path, r.origin, s.date AS session_date, g.title AS song_title,
  CASE WHEN content_type = 'song_take' THEN coalesce(song_type, 'unreviewed') WHEN content_type = 'jam' THEN 'jam'
  WHEN content_type IS NULL THEN 'unreviewed' ELSE 'non-musical' END AS effective_type
  FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id LEFT JOIN songs g ON g.id = r.song_id""",
}


def _fill(text: str, macros: dict[str, str]) -> str:
    text = re.sub(r"@D\((\d+)\)", r"CAST(\1 AS DOUBLE)", text)
    for name, value in macros.items():
        text = text.replace(name, value)
    return text


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it reads."""
    texts = {**{k: re.sub(r"\{(\w+)\}", r"\1", _fill(v, SQL_MACROS)) for k, v in VIEWS.items()}, **SQL_VIEWS}
    order: list[str] = []

    def visit(text: str, me: str | None = None) -> None:
        for name in texts:
            if name != me and name not in order and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(texts[name], name)
                order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ",\n".join(f"{name} AS ({texts[name]})" for name in order)
    return f"WITH RECURSIVE {views}" + (",\n" + sql[5:].lstrip() if sql.lstrip().upper().startswith("WITH ") else "\n" + sql)


class Archive:
    """The entities of one data folder; every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str, **inputs: DataFrame) -> DataFrame:
        text = _fill(VIEWS[name], SPARK_MACROS)
        names = set(re.findall(r"\{(\w+)\}", text))
        frames = {n: inputs[n] if n in inputs else self.table(n) for n in names}
        return self.spark.sql(text, **frames)

    @cached_property
    def sessions(self) -> DataFrame:
        return self.view("sessions")

    @cached_property
    def songs(self) -> DataFrame:
        return self.view("songs")

    @cached_property
    def recordings(self) -> DataFrame:
        return self.view("recordings")

    def _event_order(self) -> DataFrame:
        day = self.table("events").withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
        return ordinal(day, ["user_id"], "_t", "event_id", 86400e6, "_i").drop("_t")

    @cached_property
    def segments(self) -> DataFrame:
        e = self._event_order()
        start = F.col("_i") * F.lit(10.0)
        vectors = self.table("embeddings").agg(F.count(F.lit(1))).scalar()
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("recording_id"),
            start.alias("start_seconds"), (start + 20.0).alias("end_seconds"),
            F.when(F.col("event_id") % 41 != 0, F.col("event_id") % vectors).alias("vec_id"),
            F.when(F.col("event_id") % 29 != 0, F.col("value") / 1000.0).alias("mean_rms"),
            F.when(F.col("event_id") % 31 != 0, 500.0 + (F.col("event_id") * 37) % 4000).alias("mean_spectral_centroid"),
        )

    @cached_property
    def embedded(self) -> DataFrame:
        """Segments with ``embedding`` (null for some)."""
        vectors = self.table("embeddings").select("vec_id", "embedding")
        return self.segments.join(vectors, "vec_id", "left")

    @cached_property
    def wide(self) -> DataFrame:
        """Segments with embedding and recording metadata."""
        return load_segments(self.embedded, self.recordings, self.sessions, self.songs)

    @cached_property
    def vectors(self) -> DataFrame:
        """Vectors as a written table that numbers its rows, so that segments can refer to them."""
        rows = self.table("embeddings").filter("embedding is not null")
        return store(rows.select(F.monotonically_increasing_id().alias("vec_row"), "vec_id", "embedding"), "vectors")

    @cached_property
    def placed(self) -> DataFrame:
        """``wide`` with ``vec_row`` in place of the vector: ordering and joins move numbers, not vectors."""
        rows = self.segments.join(self.vectors.select("vec_id", "vec_row"), "vec_id")
        return load_segments(rows, self.recordings, self.sessions, self.songs, "vec_row")

    def with_vectors(self, rows: DataFrame) -> DataFrame:
        """Rows of ``placed`` with ``embedding``, to be called last."""
        return rows.join(self.vectors.select("vec_row", "embedding"), "vec_row").drop("vec_row")

    def with_vectors_by_chunk(self, indexed: DataFrame) -> DataFrame:
        """The same with rows near each other in one task, so that groups are summed up before they move."""
        return self.with_vectors(indexed).repartition("recording_id", F.floor(F.col("idx") / CHUNK_ROWS))

    @cached_property
    def levels(self) -> DataFrame:
        return self._event_order().select(
            F.col("user_id").alias("recording_id"), (F.col("_i") * F.lit(1.0)).alias("t"),
            (F.col("value") / 10.0 - 48.0).alias("level"),
        )

    @cached_property
    def candidates(self) -> DataFrame:
        return self.view("candidates")

    @cached_property
    def processing_log(self) -> DataFrame:
        return self.view("processing_log")

    @cached_property
    def frames(self) -> DataFrame:
        return self.view("frames")

    @cached_property
    def archive_paths(self) -> DataFrame:
        return self.view("archive_paths")

    @cached_property
    def points(self) -> DataFrame:
        return self.view("points", segments=self.segments)

    @cached_property
    def clusters(self) -> DataFrame:
        return self.view("clusters", segments=self.segments)

    @cached_property
    def decisions(self) -> DataFrame:
        """As they come in, invalid ones included; the operators check them."""
        return self.view("decision_log")


@dataclass
class Plan:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    """Register ``fn(archive)`` as a query with its DuckDB twin."""
    def wrap(fn: Callable[[Archive], DataFrame]):
        def build(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Archive(spark, folder))

        REGISTRY[name] = Plan(build, with_views(sql) if sql else None)
        return fn

    return wrap


def day_text(c: str):
    """Timestamp as text, equal in both engines."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
