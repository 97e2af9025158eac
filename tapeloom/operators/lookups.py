"""Joins and lookups (J1-J21). Dimension joins carry no hints: Spark broadcasts by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.ordered import ordinal
from tapeloom.session import store
from tapeloom.sources.inventory import dense_ids, first_per, with_scan_order

TAKES_PAGE = 1000
ID_CHUNK = 1 << 20
CELL_POINTS = 64  # points a cell of the grid may hold before it is cut
FAN, LEVELS = 4, 16  # cells a cell is cut into along each side, and how often
SLACK = 2e-9  # distances count to nine decimals


def recording_view(recordings: DataFrame, sessions: DataFrame, songs: DataFrame) -> DataFrame:
    """Recordings with session date and song title."""
    ses = sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date"))
    song = songs.select(F.col("id").alias("song_id"), F.col("title").alias("song_title"))
    return (
        recordings.join(ses, "session_id", "left").join(song, "song_id", "left")
        .select("id", "title", "origin", "duration_seconds", "session_date", "song_id", "song_title", "audio_path")
    )


def songs_with_takes(songs: DataFrame, view: DataFrame, types: list[str]) -> DataFrame:
    """One row per song and take (a song without takes has one row), to be read by title.

    Takes stay rows; ``nest_takes`` folds them into lists.
    """
    takes = view.select(
        F.col("song_id").alias("_song"), F.col("id").alias("recording_id"), F.col("title").alias("recording_title"),
        "origin", "duration_seconds", "session_date", "audio_path",
    )
    return (
        songs.filter(F.col("song_type").isin(types))
        .join(takes, F.col("id") == F.col("_song"), "left").drop("_song")
    )


def nest_takes(rows: DataFrame, key: str = "id", page: int = TAKES_PAGE) -> DataFrame:
    """Takes as an array of structs per song or session, ordered by recording id.

    Lists are cut into pages of ``page`` takes, so a song that owns a third of the archive gives many
    rows instead of one huge cell; ordinary songs have page 0 only.
    """
    take = ["recording_id", "recording_title", "origin", "duration_seconds", "session_date", "audio_path"]
    parent = [c for c in rows.columns if c not in take and c != key]
    placed = ordinal(
        rows.withColumn("_at", F.coalesce("recording_id", F.lit(0).cast("long"))), [key], "_at", "_at", ID_CHUNK, "_i"
    )
    entry = F.when(F.col("recording_id").isNotNull(), F.struct(*take))
    return placed.groupBy(key, F.floor(F.col("_i") / page).alias("page")).agg(
        *[F.first(c).alias(c) for c in parent], F.sort_array(F.collect_list(entry)).alias("recordings")
    )


def sessions_with_counts(sessions: DataFrame, recordings: DataFrame) -> DataFrame:
    """Sessions with their number of recordings, newest first."""
    counts = recordings.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return (
        sessions.join(counts, "id", "left")
        .withColumn("recording_count", F.coalesce("_n", F.lit(0))).drop("_n").orderBy(F.desc("date"), "id")
    )


def session_detail(sessions: DataFrame, recordings: DataFrame, songs: DataFrame) -> DataFrame:
    """Sessions with their recordings as rows; filter on ``id`` for a single one."""
    view = recording_view(recordings, sessions, songs).drop("session_date")
    ids = recordings.select("id", F.col("session_id"))
    takes = view.join(ids, "id").withColumnRenamed("id", "recording_id").withColumnRenamed("title", "recording_title")
    return sessions.withColumnRenamed("id", "session_id").join(takes, "session_id", "left")


def all_songs(songs: DataFrame) -> DataFrame:
    """Songs and jams together in dictionary order of their titles."""
    works = songs.filter(F.col("song_type").isin("original", "cover"))
    jams = songs.filter(F.col("song_type") == "jam")
    return works.unionByName(jams).orderBy(F.collate("title", "UNICODE_CI"), "id")


def candidate_view(candidates: DataFrame, songs: DataFrame, recordings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Candidates with song title and the audio and date of the nearest recording."""
    song = songs.select(F.col("id").alias("song_id"), F.col("title").alias("song_title"))
    near = recordings.select(
        F.col("id").alias("nearest_recording_id"), F.col("audio_path").alias("nearest_audio_path"),
        F.col("session_id").alias("_session"),
    )
    ses = sessions.select(F.col("id").alias("_session"), F.col("date").alias("nearest_session_date"))
    return (
        candidates.join(song, "song_id").join(near, "nearest_recording_id", "left").join(ses, "_session", "left")
        .select(
            "id", "recording_id", "song_id", "song_title", "confidence", "rank", "status",
            "nearest_recording_id", "nearest_audio_path", "nearest_session_date",
        )
    )


def review_rows(
    recordings: DataFrame, sessions: DataFrame, songs: DataFrame, candidates: DataFrame, segments: DataFrame,
    archive: DataFrame | None = None,
) -> DataFrame:
    """Recordings as the reviewer sees them, one row each, with open candidates and mean features.

    Candidates nest in rank order with song title and the nearest recording's audio and date (looked up in ``archive``,
    all recordings, where ``recordings`` are a part of them).
    """
    extra = recordings.select("id", "content_type", "content_type_source")
    shown = candidate_view(candidates.filter("status <> 'rejected'"), songs, recordings if archive is None else archive, sessions)
    open_candidates = shown.groupBy(F.col("recording_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("id").alias("candidate_id"), "song_id", "song_title", "confidence", "status", "nearest_recording_id",
        "nearest_audio_path", "nearest_session_date"))).alias("candidates"))
    levels = segments.groupBy(F.col("recording_id").alias("id")).agg(
        F.avg("mean_rms").alias("mean_rms"), F.avg("mean_spectral_centroid").alias("mean_spectral_centroid")
    )
    return (
        recording_view(recordings, sessions, songs).join(extra, "id")
        .join(open_candidates, "id", "left").join(levels, "id", "left")
    )


def best_candidate(recordings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Recordings with the confidence of their rank-1 candidate, whatever its status."""
    best = candidates.filter("rank = 1").select(
        F.col("recording_id").alias("id"), F.col("confidence").alias("best_confidence")
    )
    return recordings.join(best, "id", "left")


def needs_processing(recordings: DataFrame, log: DataFrame, step: str, version: str) -> DataFrame:
    """Recordings without a success entry for a step and version."""
    done = log.filter(
        (F.col("step") == step) & (F.col("version") == version) & (F.col("status") == "success")
    ).select(F.col("recording_id").alias("id"))
    return recordings.join(done, "id", "left_anti")


def not_ingested(items: DataFrame, recordings: DataFrame) -> DataFrame:
    """Items whose exact list of source paths has no recording yet."""
    known = recordings.select(F.col("source_path").alias("source_paths")).distinct()
    return items.join(known, "source_paths", "left_anti")


def replaced_by(items: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings an overwriting ingest deletes first."""
    paths = items.select(F.col("source_paths").alias("source_path")).distinct()
    return recordings.join(paths, "source_path", "left_semi")


def get_or_create_sessions(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions to add: one per new date, flags from the first item in scan order."""
    firsts = first_per(with_scan_order(items), "date", ["date_uncertain", "notes"], ["scan_section", "path"])
    fresh = firsts.join(sessions.select("date"), "date", "left_anti")
    return dense_ids(fresh, "date", sessions).select("id", "date", "date_uncertain", "notes")


def get_or_create_songs(items: DataFrame, songs: DataFrame) -> DataFrame:
    """Songs to add: one per new slug, type and title from the first item in scan order."""
    firsts = first_per(with_scan_order(items), "song_slug", ["song_type", "title"], ["scan_section", "path"])
    fresh = firsts.withColumnRenamed("song_slug", "slug").join(songs.select("slug"), "slug", "left_anti")
    return dense_ids(fresh, "slug", songs).select("id", "title", "slug", "song_type")


def build_recordings(
    items: DataFrame, sessions: DataFrame, songs: DataFrame, durations: DataFrame, active: DataFrame
) -> DataFrame:
    """Recordings of new items, before ids are given.

    A pretrimmed item is one recording; a raw one gives a recording per active segment, without song
    or title, and none when it has no active segment. ``durations`` has path and duration_seconds,
    ``active`` path, start and end.
    """
    ses = sessions.select(F.col("id").alias("session_id"), "date")
    song = songs.select(F.col("id").alias("song_id"), F.col("slug").alias("song_slug"))
    dated = items.join(ses, "date", "left")
    whole = (
        dated.filter("origin = 'pretrimmed'").join(song, "song_slug", "left").join(durations, "path", "left")
        .select(
            "path", "session_id", "song_id", "title", F.col("source_paths").alias("source_path"), "origin",
            F.lit(None).cast("double").alias("start_offset_seconds"),
            F.lit(None).cast("double").alias("end_offset_seconds"),
            F.round("duration_seconds", 3).alias("duration_seconds"),
        )
    )
    cut = (
        dated.filter("origin = 'raw'").join(active, "path")
        .select(
            "path", "session_id", F.lit(None).cast("long").alias("song_id"), F.lit(None).cast("string").alias("title"),
            F.col("source_paths").alias("source_path"), F.lit("vad_segment").alias("origin"),
            F.col("start").alias("start_offset_seconds"), F.col("end").alias("end_offset_seconds"),
            F.round(F.col("end") - F.col("start"), 3).alias("duration_seconds"),
        )
    )
    return whole.unionByName(cut)


def cascade_delete(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Recordings and every child table without the rows of deleted recordings."""
    ids = deleted.select(F.col("id").alias("recording_id")).distinct()
    out = {}
    for name, df in tables.items():
        key = "id" if name == "recordings" else "recording_id"
        out[name] = df.join(ids.withColumnRenamed("recording_id", key), key, "left_anti").select(df.columns)
    return out


def placed_assignments(assignments: DataFrame, coords: DataFrame) -> DataFrame:
    """Assignments with map coordinates; see ``unplaced`` for the rest."""
    return assignments.join(coords.select("segment_id", "x", "y"), "segment_id")


def unplaced(assignments: DataFrame, coords: DataFrame) -> DataFrame:
    """Number of assignments without coordinates."""
    return assignments.join(coords.select("segment_id"), "segment_id", "left_anti").agg(
        F.count(F.lit(1)).alias("missing")
    )


def nearest_start(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Start of the segment nearest to a requested time; the earlier one on a tie.

    ``requests`` has recording_id, split_at and any more columns, one row per request.
    """
    near = (
        requests.select("recording_id", "split_at").distinct()
        .join(segments.select("recording_id", "start_seconds"), "recording_id")
        .groupBy("recording_id", "split_at")
        .agg(F.min_by("start_seconds", F.struct(F.abs(F.col("start_seconds") - F.col("split_at")), "start_seconds"))
             .alias("nearest"))
    )
    return requests.join(near, ["recording_id", "split_at"], "left")


def _cell(value: str, size: float) -> Column:
    return F.floor(F.col(value) / F.lit(size)).cast("long")


def grid_tree(spots: DataFrame, size: float, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Cells of ``size`` that hold points (point_id, _x, _y), each cut into ``FAN`` by ``FAN`` until at most ``most`` are left.

    Returns the cells of each level (_cx, _cy, _n and the box around their points) and the points with the cell
    that is not cut (_level, _cx, _cy). Each level counts only what lies in cells that are cut; cells are powers of two apart, so
    that a point's cell is exactly the one its parent is cut into.
    """
    left, levels, leaves = spots, [], None
    for level in range(LEVELS):
        keyed = left.withColumn("_cx", _cell("_x", size / FAN ** level)).withColumn("_cy", _cell("_y", size / FAN ** level))
        cells = store(keyed.groupBy("_cx", "_cy").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1")), "cells")
        levels.append(cells)
        cut = cells.filter(F.col("_n") > most).select("_cx", "_cy")
        last = level == LEVELS - 1 or cut.isEmpty()
        whole = keyed if last else keyed.join(cut, ["_cx", "_cy"], "left_anti")
        whole = whole.withColumn("_level", F.lit(level))
        leaves = whole if leaves is None else leaves.unionByName(whole)
        if last:
            return levels, leaves
        left = store(keyed.join(cut, ["_cx", "_cy"], "left_semi").drop("_cx", "_cy"), "points")


def _gap(value: str, low: Column, high: Column) -> Column:
    return F.greatest(low - F.col(value), F.col(value) - high, F.lit(0.0))


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def cells_in_reach(places: DataFrame, levels: list[DataFrame], max_dist: float, most: int) -> DataFrame:
    """For each place (_q, x, y) the uncut cells that may hold its nearest point: _q, x, y, _level, _cx, _cy.

    From the coarsest level on, the farthest corner of any cell's box bounds the distance, and cells whose box is
    farther than the least such bound are left; the others are looked into a level deeper.
    """
    w = Window.partitionBy("_q")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    front = (
        places.withColumn("_reach", F.lit(float(max_dist))).withColumn("_cx", F.explode(F.transform(around, lambda d: _cell("x", max_dist) + d)))
        .withColumn("_cy", F.explode(F.transform(around, lambda d: _cell("y", max_dist) + d)))
    )
    found = None
    for level, cells in enumerate(levels):
        near = _length(_gap("x", F.col("_x0"), F.col("_x1")), _gap("y", F.col("_y0"), F.col("_y1")))
        far = _length(F.greatest(F.abs(F.col("x") - F.col("_x0")), F.abs(F.col("x") - F.col("_x1"))),
                      F.greatest(F.abs(F.col("y") - F.col("_y0")), F.abs(F.col("y") - F.col("_y1"))))
        hits = front.join(cells, ["_cx", "_cy"]).withColumn("_near", near).withColumn("_reach", F.min(F.least(far, F.col("_reach"))).over(w))
        hits = hits.filter(F.col("_near") <= F.col("_reach") + SLACK).select("_q", "x", "y", "_cx", "_cy", "_n", "_near", "_reach")
        last = level == len(levels) - 1
        hits = hits if last else store(hits, "reach")
        done = (hits if last else hits.filter(F.col("_n") <= most)).drop("_n").withColumn("_level", F.lit(level))
        found = done if found is None else found.unionByName(done)
        if not last:
            size = max_dist / FAN ** (level + 1)
            steps = F.sequence(F.lit(0), F.lit(FAN - 1))
            front = (
                hits.filter(F.col("_n") > most).select("_q", "x", "y", "_reach", F.col("_cx").alias("_px"), F.col("_cy").alias("_py"))
                .withColumn("_cx", F.explode(F.transform(steps, lambda i: F.col("_px") * FAN + i)))
                .withColumn("_cy", F.explode(F.transform(steps, lambda i: F.col("_py") * FAN + i)))
                .filter(_length(_gap("x", F.col("_cx") * size, (F.col("_cx") + 1) * size), _gap("y", F.col("_cy") * size, (F.col("_cy") + 1) * size))
                        <= F.col("_reach") + SLACK)
                .drop("_px", "_py")
            )
    found = found.withColumn("_reach", F.min("_reach").over(w)).filter(F.col("_near") <= F.col("_reach") + SLACK)
    return found.drop("_near", "_reach")


def nearest_point(queries: DataFrame, points: DataFrame, max_dist: float, most: int = CELL_POINTS) -> DataFrame:
    """Nearest visible point closer than ``max_dist``; smaller id on a tie.

    Points sharing a position are first reduced to the smallest id, queries to their places. Cells of the grid are cut where
    points are dense, and a place meets the points of the few uncut cells that can hold its nearest one.
    """
    spots = store(points.filter("not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.min("id").alias("point_id")).select(
        "point_id", F.col("x").alias("_x"), F.col("y").alias("_y")), "spots")
    levels, leaves = grid_tree(spots, float(max_dist), most)
    places = store(queries.filter("not isnan(x) and not isnan(y)").select("x", "y").distinct().withColumn("_q", F.monotonically_increasing_id()), "places")
    distance = F.round(_length(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")), 9)
    best = (
        cells_in_reach(places, levels, float(max_dist), most).join(leaves, ["_level", "_cx", "_cy"])
        .withColumn("distance", distance).filter(F.col("distance") < max_dist)
        .groupBy("_q").agg(F.min(F.struct("distance", "point_id")).alias("_best"))
    )
    hits = places.join(best, "_q").select("x", "y", "_best.point_id", "_best.distance")
    return queries.select("id", "x", "y").join(hits, ["x", "y"]).select("id", "point_id", "distance")


def passages_by_type(passages: DataFrame, run: str, passage_type: int) -> DataFrame:
    """Passages of one run and type; the run filter prunes folders."""
    return passages.filter((F.col("run") == run) & (F.col("passage_type") == passage_type))


def passages_by_recording(passages: DataFrame, run: str, recording_id: int) -> DataFrame:
    """Passages of one recording in time order."""
    return passages.filter((F.col("run") == run) & (F.col("recording_id") == recording_id)).orderBy("start_seconds")
