"""Stored tables: wide reads, versioned writes, run and map catalogs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.labels import effective_type


def load_segments(segments: DataFrame, recordings: DataFrame, sessions: DataFrame, songs: DataFrame, vector: str = "embedding") -> DataFrame:
    """Segments that have an embedding, with the metadata of their recording. ``vector`` may name a reference to it instead."""
    rec = recordings.select(
        F.col("id").alias("recording_id"), "session_id", "song_id",
        F.col("title").alias("recording_title"), "audio_path", "origin", "content_type",
    )
    ses = sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date"))
    song = songs.select(F.col("id").alias("song_id"), F.col("title").alias("song_title"), "song_type")
    return (
        segments.filter(F.col(vector).isNotNull())
        .withColumnRenamed("id", "segment_id")
        .join(rec, "recording_id")
        .join(ses, "session_id", "left")
        .join(song, "song_id", "left")
        .withColumn("effective_type", effective_type(F.col("content_type"), F.col("song_type")))
        .select(
            "segment_id", "recording_id", "start_seconds", "end_seconds", vector,
            "mean_rms", "mean_spectral_centroid", "recording_title", "audio_path", "origin",
            "session_date", "song_title", "effective_type",
        )
    )


def run_name(kernel_size: int, peak_threshold: float) -> str:
    """Default name of a segmentation run."""
    return f"ssm-k{kernel_size}-t{peak_threshold}".replace(".", "p")


def valid_name(name: str) -> bool:
    """Names that may become a folder: letters, digits, dot, dash and underscore, no parent step."""
    return bool(re.fullmatch(r"[\w.\-]+", name)) and ".." not in name


def write_run(root: str, run: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of one run, each under ``<root>/<table>/run=<run>``.

    Only this run's partition is replaced, so other runs keep their files.
    """
    if not valid_name(run):
        raise ValueError(f"invalid run name {run!r}")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/run={run}")


def read_runs(spark: SparkSession, root: str, table: str, merge: bool = False) -> DataFrame:
    """All runs of a table; ``run`` is a partition column, so a filter on it prunes folders.

    With ``merge`` columns that only some runs have are kept, which opens every file.
    """
    base = f"{root.rstrip('/')}/{table}"
    return spark.read.option("basePath", base).option("mergeSchema", merge).parquet(base)


def read_run(spark: SparkSession, root: str, table: str, run: str) -> DataFrame:
    """One run of a table; no other folder is listed."""
    if not valid_name(run):
        raise ValueError(f"invalid run name {run!r}")
    base = f"{root.rstrip('/')}/{table}"
    return spark.read.option("basePath", base).parquet(f"{base}/run={run}")


def write_map(spark: SparkSession, root: str, name: str, coords: DataFrame, label: str, filters: dict[str, str | float | None]) -> DataFrame:
    """The coordinates of one map under ``<root>/maps/map_name=<name>`` and its entry in the catalog, which is returned.

    The catalog is a small table with a row per map: name, label, number of points and the filters the map was made with.
    """
    if not valid_name(name):
        raise ValueError(f"invalid map name {name!r}")
    folder = f"{root.rstrip('/')}/maps/map_name={name}"
    coords.write.mode("overwrite").parquet(folder)
    entry = spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(name).alias("name"), F.lit(label).alias("label"), "count",
        F.struct(*[F.lit(v).cast("double" if isinstance(v, float) else "string").alias(k) for k, v in filters.items()]).alias("filters"))
    old = read_catalog(spark, root)
    rows = entry if old is None else upsert_catalog(old, entry)
    kept = spark.createDataFrame(rows.collect(), rows.schema)  # a row per map; the file it was read from is replaced
    kept.coalesce(1).write.mode("overwrite").parquet(f"{root.rstrip('/')}/catalog")
    return kept


def read_catalog(spark: SparkSession, root: str) -> DataFrame | None:
    """The catalog of stored maps, None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/catalog")
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    return spark.read.parquet(str(path)) if there else None


def read_maps(spark: SparkSession, root: str) -> DataFrame:
    """Points of all stored maps with ``map_name``, a partition column."""
    base = f"{root.rstrip('/')}/maps"
    return spark.read.option("basePath", base).parquet(base)


def upsert_catalog(catalog: DataFrame, entry: DataFrame) -> DataFrame:
    """Replace the entries of the same name, sorted by name."""
    kept = catalog.join(entry.select("name"), "name", "left_anti").select(*catalog.columns)
    return kept.unionByName(entry.select(*catalog.columns)).orderBy("name")


def list_runs(passage_types: DataFrame, config: DataFrame) -> DataFrame:
    """One row per run with passage and type counts; 0 and ``unknown`` without a config."""
    return (
        passage_types.groupBy("run")
        .agg(F.sum("count").alias("passage_count"), F.count(F.lit(1)).alias("type_count"))
        .join(config.select("run", "n_clusters", "method"), "run", "left")
        .select(
            F.col("run").alias("name"),
            F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"),
            F.coalesce("method", F.lit("unknown")).alias("method"),
            "passage_count", "type_count",
        )
        .orderBy("name")
    )


def export_vectors(df: DataFrame, id_col: str, vector_col: str, path: str) -> None:
    """Ids and vectors in one table; a vector is found by its id, not by its position."""
    df.select(id_col, vector_col).write.mode("overwrite").parquet(path)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key as a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def top_n(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark trims each map task to ``n`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
