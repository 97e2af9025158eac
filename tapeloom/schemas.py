"""Value sets and table schemas of the archive model."""

from pyspark.sql import types as T

# Enums of the data model.
CONTENT_TYPES = ["song_take", "jam", "banter", "tuning", "noodling", "silence", "count_in", "other"]
NON_MUSICAL_TYPES = ["banter", "tuning", "noodling", "silence", "count_in", "other"]
CONTENT_TYPE_SOURCES = ["ingest", "auto", "human"]
SONG_TYPES = ["original", "cover", "jam"]
ORIGINS = ["pretrimmed", "vad_segment"]
STEPS = ["ingest", "librosa", "clap", "coverhunter"]
STEP_STATUSES = ["success", "failed", "skipped"]
CANDIDATE_STATUSES = ["pending", "accepted", "rejected"]
UNKNOWN_SESSION_DATE = "2012-01-01"

SEGMENT_SECONDS = 20.0
SEGMENT_STEP_SECONDS = 10.0

SESSIONS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("date", T.StringType()),
    T.StructField("date_uncertain", T.BooleanType()),
    T.StructField("notes", T.StringType()),
])
SONGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("slug", T.StringType()),
    T.StructField("song_type", T.StringType()),
    T.StructField("cover_of", T.StringType()),
])
RECORDINGS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("song_id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("source_path", T.ArrayType(T.StringType())),
    T.StructField("audio_path", T.StringType()),
    T.StructField("start_offset_seconds", T.DoubleType()),
    T.StructField("end_offset_seconds", T.DoubleType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("origin", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content_type_source", T.StringType()),
])
SEGMENTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("recording_id", T.LongType()),
    T.StructField("start_seconds", T.DoubleType()),
    T.StructField("end_seconds", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("mean_rms", T.DoubleType()),
    T.StructField("var_rms", T.DoubleType()),
    T.StructField("mean_spectral_centroid", T.DoubleType()),
    T.StructField("var_spectral_centroid", T.DoubleType()),
    T.StructField("mean_chroma", T.ArrayType(T.FloatType())),
    T.StructField("var_chroma", T.ArrayType(T.FloatType())),
])
PROCESSING_LOG = T.StructType([
    T.StructField("recording_id", T.LongType()),
    T.StructField("step", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("completed_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()),
    T.StructField("error_message", T.StringType()),
])
CANDIDATES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("recording_id", T.LongType()),
    T.StructField("song_id", T.LongType()),
    T.StructField("nearest_recording_id", T.LongType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("rank", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("reviewed_at", T.TimestampNTZType()),
])
DECISIONS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("recording_id", T.LongType()),
    T.StructField("song_id", T.LongType()),
    T.StructField("candidate_id", T.LongType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("split_at", T.DoubleType()),
    T.StructField("at", T.TimestampNTZType()),
])
