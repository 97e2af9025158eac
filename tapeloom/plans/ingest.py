"""Inventory, names and ingest (S*, P*, J11-J15, A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import labels as L
from tapeloom.functions import text as T
from tapeloom.operators import lookups as J
from tapeloom.operators import series as A
from tapeloom.operators import workflow as W
from tapeloom.plans.base import Archive, plan
from tapeloom.sources import inventory as I
from tapeloom.sources import store

AUDIO_SQL = "regexp_matches(path, '(?i)[^/]\\.(mp3|wav|aif|aiff|m4a)$')"
STEM_SQL = "regexp_replace(regexp_extract({c}, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1')"
DECODE_SQL = "url_decode(replace({c}, '+', '%2B'))"
MONTHS_SQL = "(" + " UNION ALL ".join(f"SELECT '{m}' AS month, {n} AS number" for m, n in T.MONTHS.items()) + ")"

# Title case: upper after every non-letter, lower after a letter.
TITLE_SQL = """array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i > 1 AND
 regexp_matches(substr({c}, CAST(i - 1 AS BIGINT), 1), '\\pL') THEN lower(substr({c}, CAST(i AS BIGINT), 1))
 ELSE upper(substr({c}, CAST(i AS BIGINT), 1)) END), '')"""

ITEMS_SQL = f"""SELECT path, section, origin, date, coalesce(section = 'jams' AND date = '2015-01-01', false) AS date_uncertain, song_slug, song_type,
 CASE WHEN section = 'old' THEN raw_title ELSE {TITLE_SQL.format(c="spaced")} END AS title, notes FROM (
 SELECT *, regexp_replace({DECODE_SQL.format(c="song_slug")}, '[-_]+', ' ', 'g') AS spaced FROM (
 SELECT path, lower(split_part(path, '/', 1)) AS section, CASE WHEN path LIKE 'Assajos/%' THEN 'raw' ELSE 'pretrimmed' END AS origin,
 CASE split_part(path, '/', 1)
  WHEN 'Assajos' THEN nullif(regexp_extract(CASE WHEN len(string_split(path, '/')) = 2 THEN {STEM_SQL.format(c="path")}
    WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '(?i)_LR\\.') THEN split_part(path, '/', 2) ELSE '' END, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '')
  WHEN 'Jams' THEN nullif(regexp_extract(split_part(path, '/', 2), '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '')
  WHEN 'Temas' THEN nullif(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '_(\\d{{4}}-\\d{{2}}-\\d{{2}})(?:\\.|$)', 1), '')
  WHEN 'Old' THEN (SELECT printf('20%s-%02d-%02d', regexp_extract({DECODE_SQL.format(c="split_part(path, '/', 2)")}, '^(\\d+):(\\d+)', 2), m.number,
    CAST(regexp_extract(split_part(path, '/', 2), '- (\\d+) ', 1) AS INT)) FROM {MONTHS_SQL} m WHERE m.month = lower(split_part(split_part(path, '/', 2), ' ', 4))) END AS date,
 CASE split_part(path, '/', 1) WHEN 'Jams' THEN {DECODE_SQL.format(c=STEM_SQL.format(c="path"))} WHEN 'Temas' THEN split_part(path, '/', 2) END AS song_slug,
 CASE split_part(path, '/', 1) WHEN 'Jams' THEN 'jam' WHEN 'Temas' THEN 'original' END AS song_type,
 {DECODE_SQL.format(c=STEM_SQL.format(c="path"))} AS raw_title,
 CASE WHEN path LIKE 'Assajos/%/%' THEN nullif(trim(regexp_extract(split_part(path, '/', 2), '\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+(.+)', 1)), '') END AS notes
 FROM archive_paths WHERE {AUDIO_SQL}) t) u WHERE date IS NOT NULL OR section = 'temas'"""


def items(a: Archive):
    return I.classify_sections(a.archive_paths)


@plan("S1_scan_paths", f"SELECT path, length FROM archive_paths WHERE {AUDIO_SQL}")
def s1(a: Archive):
    return I.scan_paths(a.archive_paths)


@plan("S2_classify_sections", ITEMS_SQL)
def s2(a: Archive):
    return items(a).drop("source_paths")


for _id, _section in [("S3_rehearsals", "assajos"), ("S4_jams", "jams"), ("S5_song_folders", "temas"), ("S6_old", "old")]:
    @plan(_id, f"SELECT * FROM ({ITEMS_SQL}) i WHERE section = '{_section}'")
    def section_items(a: Archive, section=_section):
        return items(a).filter(F.col("section") == section).drop("source_paths")


PARTS_SQL = """SELECT path, regexp_replace(path, '-\\d{4}\\.', '.') AS grp, CAST(regexp_extract(path, '-(\\d{4})\\.[^/]*$', 1) AS INT) AS part
 FROM (SELECT concat('Assajos/', CAST(CAST(o_orderdate AS DATE) AS STRING), '/ZOOM', o_custkey % 10, '_LR-', printf('%04d', 1 + o_orderkey % 3), '.WAV') AS path FROM orders) t"""


@plan("S7_split_file_groups", f"""SELECT grp AS "group", part, count(*) OVER (PARTITION BY grp) AS parts, path FROM ({PARTS_SQL}) t""")
def s7(a: Archive):
    files = a.table("orders").select(F.format_string(
        "Assajos/%s/ZOOM%d_LR-%04d.WAV", F.col("o_orderdate").cast("date").cast("string"), F.col("o_custkey") % 10, 1 + F.col("o_orderkey") % 3
    ).alias("path"))
    return I.split_file_groups(files)


LOCAL_SQL = "SELECT path, length + length % 3 // 2 AS length FROM archive_paths WHERE length % 5 <> 0"


def _diff(a: Archive):
    local = a.archive_paths.filter("length % 5 <> 0").selectExpr("path", "length + (length % 3) div 2 AS length")
    return I.manifest_diff(a.archive_paths, local)


DIFF_SQL = f"""SELECT r.path, r.length, CASE WHEN EXISTS (SELECT 1 FROM ({LOCAL_SQL}) l WHERE l.path = r.path AND l.length = r.length)
 THEN 'skip' ELSE 'download' END AS status FROM archive_paths r"""


@plan("S8_manifest_diff", DIFF_SQL)
def s8(a: Archive):
    return _diff(a)


@plan("S8_manifest_totals", f"SELECT status, count(*) AS files, round(CAST(sum(length) AS DOUBLE) / 1e9, 9) AS gigabytes FROM ({DIFF_SQL}) d GROUP BY 1")
def s8b(a: Archive):
    return I.manifest_totals(_diff(a)).withColumn("gigabytes", F.round("gigabytes", 9))


@plan("S9_load_segments", """SELECT i.segment_id, i.recording_id, i.start_seconds, i.end_seconds, i.mean_rms, i.mean_spectral_centroid, t.recording_title, t.audio_path, t.origin,
 t.session_date, t.song_title, t.effective_type, round(list_sum(i.embedding), 6) AS vector_sum FROM seg_vec i JOIN rec_types t USING (recording_id)""")
def s9(a: Archive):
    total = F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y.cast("double"))
    return a.wide.withColumn("vector_sum", F.round(total, 6)).drop("embedding")


@plan("S15_seed_songs", f"""SELECT DISTINCT split_part(path, '/', 2) AS slug, {TITLE_SQL.format(c="replace(split_part(path, '/', 2), '-', ' ')")} AS title, 'original' AS song_type
 FROM archive_paths WHERE path LIKE 'Temas/%' AND split_part(path, '/', 2) NOT IN (SELECT concat('Song-', id) FROM songs WHERE id % 4 = 0)""")
def s15(a: Archive):
    known = a.songs.filter("id % 4 = 0").select(F.concat(F.lit("Song-"), F.col("id").cast("string")).alias("slug"))
    return I.seed_songs(a.archive_paths, known)


# --- expressions -----------------------------------------------------------------------------------

@plan("P1_P2_dates_in_names", """SELECT path, nullif(regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS iso,
 nullif(regexp_extract(path, '_(\\d{4}-\\d{2}-\\d{2})(?:\\.|$)', 1), '') AS take FROM archive_paths""")
def p1(a: Archive):
    return a.archive_paths.select("path", T.iso_date(F.col("path")).alias("iso"), T.take_date(F.col("path")).alias("take"))


@plan("P3_old_folder_date", f"""SELECT path, (SELECT printf('20%s-%02d-%02d', '12', m.number, CAST(regexp_extract(path, '- (\\d+) ', 1) AS INT))
 FROM {MONTHS_SQL} m WHERE m.month = lower(regexp_extract(path, '- \\d+ ([^/]+)/', 1))) AS date FROM archive_paths WHERE path LIKE 'Old/%'""")
def p3(a: Archive):
    return a.archive_paths.filter("path LIKE 'Old/%'").select("path", T.old_folder_date(F.get(F.split("path", "/"), 1)).alias("date"))


@plan("P4_humanize", f"""SELECT doc_id, {TITLE_SQL.format(c="spaced")} AS title FROM (SELECT doc_id, regexp_replace(text, '[-_]+', ' ', 'g') AS spaced FROM
 (SELECT page_id AS doc_id, url AS text FROM pages) p) t""")
def p4(a: Archive):
    return a.table("pages").select(F.col("page_id").alias("doc_id"), T.humanize(F.col("url")).alias("title"))


@plan("P5_timecode", """SELECT o_orderkey, printf('%dh%02dm%02ds', s // 3600, s % 3600 // 60, s % 60) AS timecode
 FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS s FROM orders) t""")
def p5(a: Archive):
    return a.table("orders").select("o_orderkey", T.timecode(F.col("o_totalprice")).alias("timecode"))


def _label_sql(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(regexp_replace(strip_accents({c}), '[^A-Za-z0-9_-]', '-', 'g'), '-{{2,}}', '-', 'g'), '^-+|-+$', '', 'g'), '')"


@plan("P6_build_label", f"SELECT path, substr(concat_ws('_', {_label_sql('path')}, {_label_sql('CAST(length AS STRING)')}), 1, 100) AS label FROM archive_paths")
def p6(a: Archive):
    return a.archive_paths.select("path", T.build_label(F.col("path"), F.col("length").cast("string")).alias("label"))


@plan("P7_recording_labels", f"""SELECT id, label, concat('recordings/', id, CASE WHEN label <> '' THEN '_' ELSE '' END, label, '.mp3') AS path, bare FROM (SELECT r.id,
 substr(CASE WHEN origin = 'vad_segment' THEN concat_ws('_', {_label_sql(STEM_SQL.format(c="r.source"))}, concat(tc(coalesce(start_offset_seconds, 0)), '-', tc(coalesce(end_offset_seconds, 0))))
 ELSE concat_ws('_', {_label_sql('coalesce(g.slug, r.title)')}, s.date) END, 1, 100) AS label,
 coalesce(regexp_extract(r.audio_path, '([^/]*)$', 1) = concat(r.id, '.mp3'), false) AS bare
 FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id LEFT JOIN songs g ON g.id = r.song_id) t""".replace(
    "tc(coalesce(start_offset_seconds, 0))", "printf('%dh%02dm%02ds', CAST(floor(coalesce(start_offset_seconds, 0)) AS BIGINT) // 3600, CAST(floor(coalesce(start_offset_seconds, 0)) AS BIGINT) % 3600 // 60, CAST(floor(coalesce(start_offset_seconds, 0)) AS BIGINT) % 60)"
).replace(
    "tc(coalesce(end_offset_seconds, 0))", "printf('%dh%02dm%02ds', CAST(floor(coalesce(end_offset_seconds, 0)) AS BIGINT) // 3600, CAST(floor(coalesce(end_offset_seconds, 0)) AS BIGINT) % 3600 // 60, CAST(floor(coalesce(end_offset_seconds, 0)) AS BIGINT) % 60)"))
def p7(a: Archive):
    ses = a.sessions.select(F.col("id").alias("session_id"), "date")
    song = a.songs.select(F.col("id").alias("song_id"), F.col("slug"))
    rows = a.recordings.join(ses, "session_id", "left").join(song, "song_id", "left")
    label = T.recording_label(*[F.col(c) for c in ("origin", "source_path", "start_offset_seconds", "end_offset_seconds", "slug", "title", "date")])
    return rows.withColumn("label", label).select(
        "id", "label", T.output_path(F.col("id"), F.col("label")).alias("path"), T.is_bare_id(F.col("audio_path"), F.col("id")).alias("bare"))


@plan("P8_slugs", """SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS plain,
 regexp_replace(regexp_replace(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüç', 'aaaaaaeeeeiiiiooooouuuuc'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS folded FROM documents""")
def p8(a: Archive):
    return a.table("documents").select("doc_id", T.slugify(F.col("text")).alias("plain"), T.slugify_folded(F.col("text")).alias("folded"))


@plan("P9_effective_type", "SELECT recording_id, effective_type FROM rec_types")
def p9(a: Archive):
    song = a.songs.select(F.col("id").alias("song_id"), "song_type")
    return a.recordings.select("id", "song_id", "content_type").join(song, "song_id", "left").select(
        F.col("id").alias("recording_id"), L.effective_type(F.col("content_type"), F.col("song_type")).alias("effective_type"))


@plan("P10_filter_types", "SELECT recording_id, effective_type, origin FROM rec_types WHERE effective_type IN ('original', 'jam') AND origin IN ('pretrimmed')")
def p10(a: Archive):
    song = a.songs.select(F.col("id").alias("song_id"), "song_type")
    return a.recordings.select("id", "song_id", "content_type", "origin").join(song, "song_id", "left").select(
        F.col("id").alias("recording_id"), L.effective_type(F.col("content_type"), F.col("song_type")).alias("effective_type"), "origin",
    ).filter(F.col("effective_type").isin("original", "jam") & F.col("origin").isin("pretrimmed"))


@plan("P11_fill_titles", """SELECT r.id, coalesce(r.title, CASE WHEN s.date IS NOT NULL THEN g.title || ' (' || s.date || ')' ELSE g.title END) AS title
 FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id LEFT JOIN songs g ON g.id = r.song_id""")
def p11(a: Archive):
    v = J.recording_view(a.recordings, a.sessions, a.songs)
    return v.select("id", F.coalesce("title", T.song_take_title(F.col("song_title"), F.col("session_date"))).alias("title"))


@plan("P12_rejected_classifications", """SELECT seq, CASE WHEN content_type IS NULL OR content_type NOT IN ('song_take', 'jam', 'banter', 'tuning', 'noodling', 'silence',
 'count_in', 'other') THEN 'invalid content_type' WHEN content_type = 'song_take' AND song_id IS NULL THEN 'song_take needs song_id' END AS reason
 FROM (SELECT o_orderkey AS seq, lower(o_orderstatus) AS k, CASE o_orderkey % 3 WHEN 0 THEN 'song_take' WHEN 1 THEN 'jam' ELSE o_orderpriority END AS content_type,
 CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS song_id FROM orders) t WHERE reason IS NOT NULL""")
def p12(a: Archive):
    rows = a.table("orders").selectExpr(
        "o_orderkey AS seq", "CASE o_orderkey % 3 WHEN 0 THEN 'song_take' WHEN 1 THEN 'jam' ELSE o_orderpriority END AS content_type",
        "CASE WHEN o_custkey % 2 = 0 THEN o_custkey END AS song_id")
    return rows.select("seq", L.invalid_classification(F.col("content_type"), F.col("song_id")).alias("reason")).filter("reason is not null")


@plan("P13_ineligible", """SELECT id, CASE WHEN audio_path IS NULL THEN 'no audio_path' ELSE 'no duration_seconds' END AS reason FROM recordings
 WHERE audio_path IS NULL OR duration_seconds IS NULL""")
def p13(a: Archive):
    return a.recordings.select("id", L.ineligible(F.col("audio_path"), F.col("duration_seconds")).alias("reason")).filter("reason is not null")


@plan("P14_audio_urls", """SELECT s.id, concat('file:///audio/', r.audio_path, printf('#t=%.1f,%.1f', s.start_seconds, s.end_seconds)) AS url,
 concat('https://example-bucket.s3.amazonaws.com/raw/', r.source) AS stored FROM segments s JOIN recordings r ON r.id = s.recording_id WHERE r.audio_path IS NOT NULL
 UNION ALL SELECT s.id, NULL, concat('https://example-bucket.s3.amazonaws.com/raw/', r.source) FROM segments s JOIN recordings r ON r.id = s.recording_id WHERE r.audio_path IS NULL""")
def p14(a: Archive):
    rec = a.recordings.select(F.col("id").alias("recording_id"), "audio_path", "source")
    return a.segments.join(rec, "recording_id").select(
        "id", T.audio_url(F.col("audio_path"), F.col("start_seconds"), F.col("end_seconds"), "file:///audio").alias("url"),
        T.storage_url(F.col("source"), "s3", "example-bucket", "raw").alias("stored"))


@plan("P15_level_words", """SELECT id, CASE WHEN p >= 67 THEN 'loud' WHEN p <= 33 THEN 'quiet' WHEN p IS NULL THEN '' ELSE 'mid-level' END AS word,
 CASE WHEN mean_rms > 0 THEN printf('%.1f dB', round(20 * log10(mean_rms), 6)) ELSE 'N/A' END AS db FROM (SELECT id, mean_rms, mean_rms * 200 AS p FROM segments) t""")
def p15(a: Archive):
    return a.segments.select("id", L.level_label(F.col("mean_rms") * 200, "quiet", "mid-level", "loud").alias("word"), L.decibels(F.col("mean_rms")).alias("db"))


@plan("P16_year_and_clock", """SELECT r.id, CAST(substr(s.date, 1, 4) AS INT) AS year, printf('%d:%02d', CAST(floor(duration_seconds / 60) AS BIGINT),
 CAST(floor(duration_seconds - floor(duration_seconds / 60) * 60) AS BIGINT)) AS clock FROM recordings r LEFT JOIN sessions s ON s.id = r.session_id WHERE duration_seconds IS NOT NULL""")
def p16(a: Archive):
    v = J.recording_view(a.recordings, a.sessions, a.songs).filter("duration_seconds is not null")
    return v.select("id", T.session_year(F.col("session_date")).alias("year"), T.clock(F.col("duration_seconds")).alias("clock"))


@plan("P17_progress", """SELECT session_id, CAST(floor(count(content_type) / count(*) * 100 + 0.5) AS BIGINT) AS pct FROM recordings GROUP BY 1""")
def p17(a: Archive):
    return a.recordings.groupBy("session_id").agg(L.percent(F.count("content_type"), F.count(F.lit(1))).alias("pct"))


@plan("P19_title_search", "SELECT id, title, lower(title) = 'tema 12' AS exact FROM recordings WHERE contains(lower(title), 'tema 12')")
def p19(a: Archive):
    return a.recordings.filter(T.title_contains(F.col("title"), "Tema 12")).select("id", "title", (F.lower("title") == "tema 12").alias("exact"))


@plan("P21_tier_filter", """SELECT id, source FROM recordings WHERE source = 'Temas/Song-7/Song-7_Demo.mp3' OR source LIKE 'Jams/1996-%'
 AND starts_with(source, 'Jams/1996-01-02/') OR starts_with(source, 'Temas/Song-12/')""")
def p21(a: Archive):
    prefixes = ["Temas/Song-7/Song-7_Demo.mp3", "Jams/1996-01-02", "Temas/Song-12/"]
    tiers = a.spark.createDataFrame([(1 + i % 2, p) for i, p in enumerate(prefixes)] + [(3, "Assajos")], "tier int, prefix string")
    return W.under_paths(a.recordings, W.tier_paths(tiers, [1, 2])).select("id", "source")


# --- ingest ----------------------------------------------------------------------------------------

def _distinct_items(a: Archive):
    return I.classify_sections(a.archive_paths.groupBy("path").agg(F.max("length").alias("length")))


DITEMS_SQL = ITEMS_SQL.replace("FROM archive_paths", "FROM (SELECT path, max(length) AS length FROM archive_paths GROUP BY 1) ap")
SECTION_RANK = "CASE section WHEN 'assajos' THEN 1 WHEN 'jams' THEN 2 WHEN 'temas' THEN 3 WHEN 'covers' THEN 4 ELSE 5 END"


@plan("J11_not_ingested", f"SELECT path, section FROM ({DITEMS_SQL}) i WHERE path NOT IN (SELECT source FROM recordings WHERE id % 2 = 0)")
def j11(a: Archive):
    return J.not_ingested(_distinct_items(a), a.recordings.filter("id % 2 = 0")).select("path", "section")


@plan("J11_replaced", f"SELECT id FROM recordings WHERE source IN (SELECT path FROM ({DITEMS_SQL}) i)")
def j11b(a: Archive):
    return J.replaced_by(_distinct_items(a), a.recordings).select("id")


@plan("J12_new_sessions", f"""SELECT date, date_uncertain, notes FROM ({DITEMS_SQL}) i WHERE date IS NOT NULL AND date NOT IN (SELECT date FROM sessions WHERE id % 2 = 0)
 QUALIFY row_number() OVER (PARTITION BY date ORDER BY {SECTION_RANK}, path) = 1""")
def j12(a: Archive):
    return J.get_or_create_sessions(_distinct_items(a), a.sessions.filter("id % 2 = 0")).drop("id")


@plan("J13_new_songs", f"""SELECT song_slug AS slug, song_type, title FROM ({DITEMS_SQL}) i WHERE song_slug IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY song_slug ORDER BY {SECTION_RANK}, path) = 1""")
def j13(a: Archive):
    return J.get_or_create_songs(_distinct_items(a), a.songs).select("slug", "song_type", "title")


@plan("J14_build_recordings", f"""WITH it AS ({DITEMS_SQL}), du AS (SELECT path, max(length) / CAST(700 AS DOUBLE) AS s FROM archive_paths GROUP BY 1),
 ac AS (SELECT path, s * k / 4 AS b, s * (k + 1) / 4 - 1 AS e FROM du, (SELECT unnest([0, 1, 2, 3]) AS k) q WHERE s > 100)
 SELECT it.path, s.id AS session_id, g.id AS song_id, it.title, it.origin, CAST(NULL AS DOUBLE) AS start_offset_seconds, CAST(NULL AS DOUBLE) AS end_offset_seconds,
 CAST(round(CAST(CAST(du.s AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) AS duration_seconds FROM it LEFT JOIN sessions s ON s.date = it.date LEFT JOIN (SELECT id, concat('Song-', id) AS slug FROM songs) g ON g.slug = it.song_slug
 LEFT JOIN du ON du.path = it.path WHERE it.origin = 'pretrimmed'
 UNION ALL SELECT it.path, s.id, NULL, NULL, 'vad_segment', ac.b, ac.e, CAST(round(CAST(CAST(ac.e - ac.b AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) FROM it LEFT JOIN sessions s ON s.date = it.date JOIN ac ON ac.path = it.path WHERE it.origin = 'raw'""")
def j14(a: Archive):
    du = a.archive_paths.groupBy("path").agg((F.max("length") / 700.0).alias("duration_seconds"))
    s, k = F.col("duration_seconds"), F.col("k")
    active = du.filter(s > 100).withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).select(
        "path", (s * k / 4).alias("start"), (s * (k + 1) / 4 - 1).alias("end"))
    songs = a.songs.select("id", F.concat(F.lit("Song-"), F.col("id").cast("string")).alias("slug"))
    return J.build_recordings(_distinct_items(a), a.sessions, songs, du, active).drop("source_path")


@plan("J15_cascade_delete", """SELECT 'candidates' AS tbl, count(*) AS n, CAST(sum(recording_id) AS BIGINT) AS ids FROM candidates WHERE recording_id % 5 <> 0
 UNION ALL SELECT 'segments', count(*), CAST(sum(recording_id) AS BIGINT) FROM segments WHERE recording_id % 5 <> 0
 UNION ALL SELECT 'recordings', count(*), CAST(sum(id) AS BIGINT) FROM recordings WHERE id % 5 <> 0
 UNION ALL SELECT 'log', count(*), CAST(sum(recording_id) AS BIGINT) FROM processing_log WHERE recording_id % 5 <> 0""")
def j15(a: Archive):
    kept = J.cascade_delete(
        {"candidates": a.candidates, "segments": a.segments, "recordings": a.recordings, "log": a.processing_log},
        a.recordings.filter("id % 5 = 0"))
    out = None
    for name, df in kept.items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("id" if name == "recordings" else "recording_id").alias("ids")).select(
            F.lit(name).alias("tbl"), "n", "ids")
        out = row if out is None else out.unionByName(row)
    return out


@plan("A13_outcome_counts", """SELECT CAST(sum(CASE WHEN status <> 'failed' THEN c ELSE 0 END) AS BIGINT) AS created,
 count(*) FILTER (status <> 'failed' AND c = 0) AS skipped, count(*) FILTER (status = 'failed') AS failed
 FROM (SELECT status, recording_id % 3 AS c FROM processing_log) t""")
def a13(a: Archive):
    return A.outcome_counts(a.processing_log.select(
        (F.col("recording_id") % 3).alias("created"), F.when(F.col("status") == "failed", "boom").alias("error")))


@plan("S12_catalog_upsert", """SELECT name, label, count FROM (SELECT effective_type AS name, 'old' AS label, count(*) AS count FROM clusters WHERE effective_type <> 'jam' GROUP BY 1
 UNION ALL SELECT 'jam', 'new', count(*) FROM clusters) t WHERE NOT (name = 'jam' AND label = 'old') ORDER BY name""")
def s12(a: Archive):
    old = a.clusters.groupBy(F.col("effective_type").alias("name")).agg(F.lit("old").alias("label"), F.count(F.lit(1)).alias("count"))
    new = a.clusters.agg(F.count(F.lit(1)).alias("count")).select(F.lit("jam").alias("name"), F.lit("new").alias("label"), "count")
    return store.upsert_catalog(old, new)
