"""File inventory: from paths to ingest items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.text import (
    ISO_DATE, file_name, file_stem, humanize, iso_date, old_folder_date, take_date, url_decode,
)

# Audio suffixes and name patterns of the archive.
AUDIO_SUFFIX = r"(?i)[^/]\.(mp3|wav|aif|aiff|m4a)$"
MIX_FILE = r"(?i)_LR\."
MIX_PART = r"(?i)_LR-\d{4}\."
PART_NUMBER = r"-\d{4}\."
FOLDER_NOTE = r"\d{4}-\d{2}-\d{2}\s+(.+)"
UNCERTAIN_DATE = "2015-01-01"

ITEM_COLUMNS = [
    "section", "source_paths", "origin", "date", "date_uncertain",
    "song_slug", "song_type", "title", "notes",
]


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """File table of a folder tree: relative path, size and time; contents are not read."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", "^file:/+", "/")
    return files.select(
        F.regexp_replace(relative, f"^.*?\\Q{base}\\E", "").alias("path"),
        "length", "modificationTime",
    )


def scan_paths(files: DataFrame) -> DataFrame:
    """Audio files of a file table with a ``path`` column."""
    return files.filter(F.col("path").rlike(AUDIO_SUFFIX))


def _part(i: int) -> Column:
    return F.get(F.split("path", "/"), i)


def classify_sections(files: DataFrame) -> DataFrame:
    """One ingest item per usable audio file, by the rule of its top folder.

    One narrow pass: every rule is a branch over the path, so no shuffle and no union of scans.
    Columns follow ``ITEM_COLUMNS`` plus ``path``.
    """
    top, folder, stem = F.col("_top"), F.col("_folder"), F.col("_stem")
    jams, rehearsals, old = top == "Jams", top == "Assajos", top == "Old"
    songs = top.isin("Temas", "Covers")
    loose, inner = F.col("_depth") == 2, F.col("_depth") == 3
    parts = (
        scan_paths(files).withColumn("_parts", F.split("path", "/"))
        .select("path", F.size("_parts").alias("_depth"), F.get("_parts", 0).alias("_top"),
                F.get("_parts", 1).alias("_folder"), F.element_at("_parts", -1).alias("_name"))
        .filter(top.isin("Assajos", "Jams", "Temas", "Covers", "Old"))
        .withColumn("_stem", file_stem(F.col("_name")))
    )
    # S3 rehearsals: a dated file, or mixed tracks anywhere below a dated folder. S4 jams: files of a
    # dated folder. S5 songs: takes in a song's folder. S6 oldest section: encoded month folders.
    dated = parts.withColumn(
        "date",
        F.when(rehearsals & loose, iso_date(stem))
        .when(rehearsals & F.col("_name").rlike(MIX_FILE), iso_date(folder))
        .when(jams & inner, iso_date(folder))
        .when(songs & inner, take_date(F.col("_name")))
        .when(old & inner, old_folder_date(folder)),
    ).filter(F.col("date").isNotNull() | (songs & inner))
    named = dated.withColumn("song_slug", F.when(jams, url_decode(stem)).when(songs, folder))
    note = F.nullif(F.trim(F.regexp_extract(folder, FOLDER_NOTE, 1)), F.lit(""))
    return named.select(
        "path",
        F.lower(top).alias("section"),
        F.array("path").alias("source_paths"),
        F.when(rehearsals, "raw").otherwise("pretrimmed").alias("origin"),
        "date",
        F.coalesce(jams & (F.col("date") == UNCERTAIN_DATE), F.lit(False)).alias("date_uncertain"),
        "song_slug",
        F.when(jams, "jam").when(top == "Temas", "original").when(top == "Covers", "cover").alias("song_type"),
        F.when(jams | songs, humanize(F.col("song_slug"))).when(old, url_decode(stem)).alias("title"),
        F.when(rehearsals & ~loose, note).alias("notes"),
    )


def split_file_groups(files: DataFrame) -> DataFrame:
    """Mixed tracks cut in numbered parts, one row per part with its group and the group's size.

    The parts stay rows, in order: a group is never gathered in one cell.
    """
    parts = scan_paths(files).filter(file_name(F.col("path")).rlike(MIX_PART)).withColumn(
        "group", F.regexp_replace("path", PART_NUMBER, ".")
    ).withColumn("part", F.regexp_extract("path", r"-(\d{4})\.[^/]*$", 1).cast("int"))
    sizes = parts.groupBy("group").agg(F.count(F.lit(1)).alias("parts"))
    return parts.join(sizes, "group").select("group", "part", "parts", "path")


def manifest_diff(remote: DataFrame, local: DataFrame) -> DataFrame:
    """``skip`` where a local file has the same path and length, else ``download``."""
    known = local.select("path", "length").distinct().withColumn("_here", F.lit(True))
    return (
        remote.join(known, ["path", "length"], "left")
        .withColumn("status", F.when(F.col("_here"), "skip").otherwise("download"))
        .drop("_here")
    )


def manifest_totals(diff: DataFrame) -> DataFrame:
    """Counts and gigabytes per status."""
    return diff.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"), (F.sum("length") / 1e9).alias("gigabytes")
    )


def seed_songs(files: DataFrame, songs: DataFrame, section: str = "Temas") -> DataFrame:
    """A song for every folder of a section whose name is not a slug yet."""
    return (
        files.filter((_part(0) == section) & (F.size(F.split("path", "/")) > 2))
        .select(_part(1).alias("slug")).distinct()
        .join(songs.select("slug"), "slug", "left_anti")
        .select("slug", humanize(F.col("slug")).alias("title"), F.lit("original").alias("song_type"))
    )


def first_per(items: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """First row of each non-null key in scan order, as a partial aggregate."""
    return (
        items.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_first"))
        .select(key, *[F.col(f"_first.{c}").alias(c) for c in cols])
    )


# Order in which sections are scanned; the first item of a date or slug wins.
SCAN_ORDER = ["assajos", "jams", "temas", "covers", "old"]


def with_scan_order(items: DataFrame) -> DataFrame:
    """Position of an item's section; together with ``path`` this is the scan order."""
    return items.withColumn("scan_section", F.array_position(F.array(*map(F.lit, SCAN_ORDER)), F.col("section")))


def dense_ids(rows: DataFrame, by: str, taken: DataFrame) -> DataFrame:
    """New ids after the largest taken one, the same on every run.

    Rows are numbered inside buckets taken from a hash of ``by``; only the 4096 bucket sizes meet in
    one window.
    """
    bucketed = rows.withColumn("_bucket", F.substring(F.sha2(F.col(by).cast("string"), 256), 1, 3))
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_bucket",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top")).scalar()
    inside = Window.partitionBy("_bucket").orderBy(by)
    return (
        bucketed.withColumn("_local", F.row_number().over(inside))
        .join(offsets, "_bucket")
        .withColumn("id", top + F.col("_before") + F.col("_local"))
        .drop("_bucket", "_before", "_local")
    )
