"""Cutting recordings into passages (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import (
    CHUNK_ROWS, adjacent, consecutive_ids, map_groups, matrix, neighbour, ordinal, running_total, unit_rows, with_halo,
)
from tapeloom.operators.similarity import mean_vectors
from tapeloom.functions.labels import settled
from tapeloom.schemas import SEGMENT_STEP_SECONDS
from tapeloom.session import cut_lineage, store

# Defaults of the two segmentation methods.
KERNEL_SIZE = 8
PEAK_THRESHOLD = 1.0
MIN_SEGMENTS = 6
MIN_PASSAGE_SECONDS = 30.0
COSINE_THRESHOLD = 0.3
MIN_GROUP = 3
MAX_GROUP = 20

LIST_PAGE = 4096
WIDER, MOST_POSITIONS = 16, 1 << 22  # how stretches grow while peaks hang together, and to what size
TIME_CHUNK = SEGMENT_STEP_SECONDS * CHUNK_ROWS


def index_segments(segments: DataFrame, time_chunk: float = TIME_CHUNK) -> DataFrame:
    """Position ``idx`` of each segment in its recording and the recording's segment count ``n``."""
    return ordinal(segments, ["recording_id"], "start_seconds", "segment_id", time_chunk, "idx", "n")


def novelty_curve(indexed: DataFrame, kernel_size: int = KERNEL_SIZE, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Q1: checkerboard novelty of every segment; input from ``index_segments`` with ``embedding``.

    The checkerboard has the sign +1 where both segments lie on the same side of the centre, else -1,
    so the weighted sum of cosines over the window is the squared length of (sum of unit vectors after
    the centre) - (sum before it). That needs two running sums per segment and no pairs at all. The curve
    is narrow and read several times afterwards, so it is written out.
    """
    h = kernel_size // 2
    rows = with_halo(indexed.select("recording_id", "segment_id", "idx", "n", "embedding"), "idx", h, h, chunk)

    def curve(table: pa.Table, starts: np.ndarray) -> pa.Table:
        unit = unit_rows(matrix(table, "embedding"))
        sums = np.vstack([np.zeros((1, unit.shape[1])), np.cumsum(unit, axis=0)])
        at = np.arange(len(unit))
        lengths = np.diff(np.r_[starts, len(unit)])
        lo = np.maximum(at - h, np.repeat(starts, lengths))
        hi = np.minimum(at + h, np.repeat(starts + lengths, lengths))
        gap = sums[hi] - 2 * sums[at] + sums[lo]
        out = pa.table({
            "recording_id": table.column("recording_id"), "segment_id": table.column("segment_id"),
            "idx": table.column("idx"), "n": table.column("n"),
            "novelty": pa.array((gap * gap).sum(axis=1)),
        })
        return out.filter(table.column("_core"))

    return cut_lineage(map_groups(
        rows, ["recording_id", "_chunk"], ["idx"], curve,
        "recording_id bigint, segment_id bigint, idx bigint, n bigint, novelty double",
    ))


def silence_short(curve: DataFrame, min_segments: int = MIN_SEGMENTS) -> DataFrame:
    """Q3: recordings with too few segments have a flat curve and stay one passage."""
    return curve.withColumn("novelty", F.when(F.col("n") >= min_segments, F.col("novelty")).otherwise(0.0))


def peak_distance(min_passage: float = MIN_PASSAGE_SECONDS, step: float = SEGMENT_STEP_SECONDS) -> int:
    """Q3: least distance between boundaries, in segments."""
    return max(1, int(min_passage / step))


def local_peaks(curve: DataFrame, threshold: float = PEAK_THRESHOLD, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Q2: strict local maxima not lower than mean + threshold * deviation, before spacing.

    A plateau counts once, at its middle (rounded down). Both ends of a recording are never peaks.
    """
    keys = ["recording_id"]
    value = curve.withColumn("_v", F.round("novelty", 9)).filter("n >= 3")
    stats = value.groupBy("recording_id").agg(
        (F.avg("_v") + threshold * F.stddev_pop("_v")).alias("_height")
    )
    runs = adjacent(value.select("recording_id", "idx", "segment_id", "_v"), keys, "idx", ["_v"], "_prev", size=chunk)
    runs = runs.filter(F.col("_prev").isNull() | (F.col("_prev._v") != F.col("_v")))
    runs = neighbour(runs, keys, "idx", "segment_id", ["idx", "_v"], float(chunk), "_next", ahead=True)
    top = (F.col("_prev._v") < F.col("_v")) & (F.col("_next._v") < F.col("_v"))
    return (
        runs.filter(top).join(stats, "recording_id").filter(F.col("_v") >= F.col("_height"))
        .select("recording_id", F.floor((F.col("idx") + F.col("_next.idx") - 1) / 2).alias("idx"), F.col("_v").alias("height"))
    )


def _settle(idx: np.ndarray, height: np.ndarray, fixed: np.ndarray, hidden: np.ndarray, distance: int) -> np.ndarray:
    """1 for peaks that stay, 2 for those that go, 3 for those that depend on peaks out of sight.

    ``fixed`` peaks are known to stay; around ``hidden`` ones there may be peaks that are not seen.
    """
    lo, hi = np.searchsorted(idx, idx - distance, side="right"), np.searchsorted(idx, idx + distance, side="left")
    state = fixed.astype(np.int8)
    for p in np.lexsort((idx, height))[::-1].tolist():
        if not state[p]:
            around = state[lo[p]:hi[p]]
            state[p] = 2 if (around == 1).any() else 3 if hidden[p] or (around == 3).any() else 1
    return state


def space_peaks(peaks: DataFrame, distance: int, chunk: int = CHUNK_ROWS, most: int = MOST_POSITIONS) -> DataFrame:
    """Q2: drop peaks closer than ``distance`` to a higher one, highest first, later one on a tie.

    Rounds of local dominance: a stretch of positions, seen with ``distance`` more at either edge, settles every peak that
    depends on nothing out of sight (the highest around always does). What is left waits for the next round, in which
    stretches are wider, up to ``most`` positions; peaks that stay come along only if they lie at an edge. Peaks hang together
    over many stretches only while they rise or fall all the way, so there are few rounds and no group is a whole chain.
    """
    if distance <= 2:  # two peaks are always at least 2 apart
        return peaks
    schema = "recording_id bigint, idx bigint, height double, _fixed boolean, state int"
    left, done, width = peaks.withColumn("_fixed", F.lit(False)), None, chunk
    while True:
        def settle(table: pa.Table, begins: np.ndarray, width=width) -> pa.Table:
            idx, height, fixed = (table.column(c).to_numpy() for c in ("idx", "height", "_fixed"))
            first = table.column("_chunk").to_numpy() * width
            hidden = (idx < first) | (idx >= first + width)
            state = np.concatenate([
                _settle(idx[s:e], height[s:e], fixed[s:e], hidden[s:e], distance) for s, e in zip(begins, np.r_[begins[1:], len(idx)])
            ])
            out = table.select(["recording_id", "idx", "height", "_fixed"]).append_column("state", pa.array(state, pa.int32()))
            return out.filter(pa.array(table.column("_core").to_numpy() & (state != 2)))

        rows = with_halo(left, "idx", distance, distance, width)
        found = store(map_groups(rows, ["recording_id", "_chunk"], ["idx"], settle, schema), "peaks")
        kept = found.filter("state = 1 and not _fixed").select("recording_id", "idx", "height")
        done = kept if done is None else done.unionByName(kept)
        if found.filter("state = 3").isEmpty():
            return done
        place = F.pmod("idx", F.lit(width))
        edge = (place < distance) | (place >= width - distance)
        left = found.filter((F.col("state") == 3) | edge).select("recording_id", "idx", "height", (F.col("state") == 1).alias("_fixed"))
        width = min(width * WIDER, max(most, width))


def pick_boundaries(
    curve: DataFrame, threshold: float = PEAK_THRESHOLD, distance: int | None = None, chunk: int = CHUNK_ROWS
) -> DataFrame:
    """Q2: boundary segments of each recording."""
    return space_peaks(local_peaks(curve, threshold, chunk), distance or peak_distance(), chunk)


def assign_passages(indexed: DataFrame, boundaries: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Q4: ``grp``, the number of the passage a segment belongs to."""
    cuts = boundaries.filter("idx > 0").select("recording_id", "idx", F.lit(1).alias("_cut"))
    marked = indexed.join(cuts, ["recording_id", "idx"], "left")
    return running_total(
        marked, ["recording_id"], "idx", "segment_id", F.coalesce("_cut", F.lit(0)), float(chunk), "grp", cuts
    ).drop("_cut")


METADATA = ["recording_title", "audio_path", "session_date", "song_title", "effective_type"]


def summarise_groups(members: DataFrame, metadata: list[str] = METADATA) -> DataFrame:
    """Q4: one row per (recording, grp): span, counts, mean features, metadata of the first segment."""
    meta = [F.min_by(F.struct(*metadata), "idx").alias("_meta")] if metadata else []
    return (
        members.groupBy("recording_id", "grp").agg(
            F.min_by("start_seconds", "idx").alias("start_seconds"),
            F.max_by("end_seconds", "idx").alias("end_seconds"),
            F.count(F.lit(1)).alias("segment_count"),
            settled(F.avg("mean_rms"), 6).alias("mean_rms"),
            settled(F.avg("mean_spectral_centroid"), 2).alias("mean_spectral_centroid"),
            *meta,
        )
        .withColumn("duration", F.round(F.col("end_seconds") - F.col("start_seconds"), 2))
        .select("*", *[F.col(f"_meta.{c}").alias(c) for c in metadata]).drop("_meta")
    )


def number_groups(groups: DataFrame, out: str = "passage_id") -> DataFrame:
    """Q5: consecutive ids over recordings in id order, then over the groups of a recording.

    ``grp`` must count from 0 without gaps inside a recording.
    """
    groups = cut_lineage(groups)
    counts = groups.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_count"))
    firsts = consecutive_ids(counts, "recording_id", "_count", "_first").select("recording_id", "_first")
    return groups.join(firsts, "recording_id").withColumn(out, F.col("_first") + F.col("grp")).drop("_first")


def extract_passages(members: DataFrame) -> DataFrame:
    """Q4/Q5: passages of a run; the passage type is the local number of the passage."""
    return number_groups(summarise_groups(members)).withColumn("passage_type", F.col("grp"))


def passage_vectors(members: DataFrame) -> DataFrame:
    """Embedding of each passage."""
    return mean_vectors(members, ["recording_id", "grp"], "embedding", "embedding")


def passage_segment_lists(members: DataFrame, page: int = LIST_PAGE) -> DataFrame:
    """Q4: ordered segment ids of each passage, in pages of ``page`` so that no list grows without end."""
    first = members.groupBy("recording_id", "grp").agg(F.min("idx").alias("_from"))
    return (
        members.join(first, ["recording_id", "grp"])
        .withColumn("page", F.floor((F.col("idx") - F.col("_from")) / page))
        .groupBy("recording_id", "grp", "page")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "segment_id"))), lambda s: s.segment_id)
             .alias("segment_ids"))
    )


def recording_stats(curve: DataFrame, boundaries: DataFrame, titles: DataFrame, min_segments: int = MIN_SEGMENTS) -> DataFrame:
    """Q6: per recording segment and passage counts and the shape of its novelty curve.

    ``titles`` has recording_id and recording_title. Boundary positions stay rows of ``boundaries``.
    """
    shape = curve.groupBy("recording_id").agg(
        F.max("n").alias("n_segments"),
        F.round(F.avg("novelty"), 4).alias("novelty_mean"),
        F.round(F.stddev_pop("novelty"), 4).alias("novelty_std"),
        F.round(F.max("novelty"), 4).alias("novelty_max"),
    )
    cuts = boundaries.filter("idx > 0").groupBy("recording_id").agg(F.count(F.lit(1)).alias("_cuts"))
    return (
        shape.join(cuts, "recording_id", "left").join(titles, "recording_id", "left")
        .withColumn("n_passages", F.coalesce("_cuts", F.lit(0)) + 1)
        .withColumn("single_passage", F.col("n_segments") < min_segments)
        .drop("_cuts")
    )


def boundary_lists(boundaries: DataFrame, page: int = LIST_PAGE) -> DataFrame:
    """Q6: ordered boundary positions per recording, paged by position."""
    return boundaries.groupBy("recording_id", F.floor(F.col("idx") / page).alias("page")).agg(
        F.sort_array(F.collect_list("idx")).alias("boundaries")
    )


def stats_with_boundaries(stats: DataFrame, boundaries: DataFrame, page: int = LIST_PAGE) -> DataFrame:
    """Q6: ``recording_stats`` with the boundary positions of each recording, a row per page of them; most have page 0 only."""
    lists = boundary_lists(boundaries.filter("idx > 0"), page)
    return stats.join(lists, "recording_id", "left").withColumn("page", F.coalesce("page", F.lit(0).cast("long"))).withColumn(
        "boundaries", F.coalesce("boundaries", F.array().cast("array<bigint>")))


def run_config(run: str, passages: DataFrame, kernel_size: int, threshold: float, min_segments: int, min_passage: float, at: Column) -> DataFrame:
    """The one row that says how a run was made."""
    return passages.agg(F.count_distinct("recording_id").alias("n_recordings"), F.count(F.lit(1)).alias("n_passages")).select(
        F.lit("ssm").alias("method"), F.lit(run).alias("run_name"), F.lit(kernel_size).alias("kernel_size"), F.lit(threshold).alias("peak_threshold"),
        F.lit(min_segments).alias("min_segments"), F.lit(min_passage).alias("min_passage_duration_seconds"), "n_recordings", "n_passages",
        F.lit(None).cast("long").alias("n_clusters"), at.alias("timestamp"))


def step_distances(indexed: DataFrame, chunk: int = CHUNK_ROWS) -> DataFrame:
    """Q7: cosine distance of each segment to the one before it, null for the first; vectors dropped."""
    keep = ["recording_id", "segment_id", "idx", "n"]
    rows = with_halo(indexed.select(*keep, "embedding"), "idx", 1, 0, chunk)

    def distances(table: pa.Table, starts: np.ndarray) -> pa.Table:
        m = matrix(table, "embedding")
        norms = np.sqrt((m * m).sum(axis=1))
        dist = np.full(len(m), np.nan)
        scale = norms[1:] * norms[:-1]
        inner = (m[1:] * m[:-1]).sum(axis=1)
        dist[1:] = np.where(scale == 0, 1.0, 1.0 - inner / np.where(scale == 0, 1.0, scale))
        dist[starts] = np.nan
        out = table.select(keep).append_column("distance", pa.array(dist, from_pandas=True))
        return out.filter(table.column("_core"))

    return store(map_groups(
        rows, ["recording_id", "_chunk"], ["idx"], distances,
        "recording_id bigint, segment_id bigint, idx bigint, n bigint, distance double",
    ), "distances")


def _next_start(far: np.ndarray, least: int, most: int, size: int) -> np.ndarray:
    """For a group starting at each row: the row its successor starts at (``size`` or more: not here)."""
    marks = np.flatnonzero(far)
    at = np.arange(size) + least
    pos = np.searchsorted(marks, at)
    jump = np.where(pos < len(marks), marks[np.minimum(pos, len(marks) - 1)] if len(marks) else size, size)
    return np.minimum(jump, np.arange(size) + max(least, most))


def _last_of_walk(jump: np.ndarray) -> np.ndarray:
    """For each row, the last group start of the walk that begins there, by doubling the steps."""
    size = len(jump)
    at = np.where(jump < size, np.minimum(jump, size - 1), np.arange(size))
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


def _walk(jump: np.ndarray, first: int) -> np.ndarray:
    """Which rows the walk from ``first`` starts groups at, by doubling the steps."""
    size = len(jump)
    step, on = np.append(np.minimum(jump, size), size), np.zeros(size + 1, dtype=bool)
    on[min(first, size)] = True
    while (step < size).any():
        on[step[on]] = True
        step = step[step]
    return on[:size]


def _first_start(far: np.ndarray, carried: int, least: int, most: int) -> int:
    """First group start in a chunk entered with ``carried`` rows already in the open group."""
    size = len(far)
    if carried == 0:
        return 0
    marks = np.flatnonzero(far)
    earliest = max(0, least - carried)
    pos = np.searchsorted(marks, earliest)
    by_mark = marks[pos] if pos < len(marks) else size
    return int(min(by_mark, max(0, max(least, most) - carried)))


def change_points(
    distances: DataFrame, threshold: float = COSINE_THRESHOLD, least: int = MIN_GROUP, most: int = MAX_GROUP,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Q7: ``grp`` of each segment by change points of the step distance.

    A group ends where the next distance exceeds ``threshold`` or the group has ``most`` rows, but never
    before ``least`` rows. A short last group joins its predecessor; a group that then is longer than
    ``most`` is split once at its largest inner distance (the first of equals).

    The walk carries only the length of the open group, at most ``max(least, most)`` values. Each chunk
    therefore first works out where it ends for every possible length it may be entered with; a scan
    over those short tables gives each chunk its real entry, and all chunks then cut in parallel. Only the first rows of
    groups go on from there: joining, splitting and numbering are steps on them, and segments get their number by one join.
    """
    least = max(1, least)
    limit = max(least, most)
    rows = distances.withColumn("_chunk", F.floor(F.col("idx") / chunk).cast("long"))
    far_of = lambda t: np.nan_to_num(t.column("distance").to_numpy(), nan=-1.0) > threshold

    def exits(table: pa.Table, starts: np.ndarray) -> pa.Table:
        far, ends = far_of(table), np.r_[starts[1:], table.num_rows]
        keep, tails = [], []
        for s, e in zip(starts, ends):
            size, local = e - s, far[s:e]
            jump = _next_start(local, least, most, size)
            tail = size - _last_of_walk(jump)
            row = []
            for carried in range(limit + 1):
                first = _first_start(local, carried, least, most)
                row.append(int(tail[first]) if first < size else int(min(carried + size, limit)))
            keep.append(s)
            tails.append(row)
        return table.select(["recording_id", "_chunk"]).take(pa.array(keep)).append_column(
            "exits", pa.array(tails, pa.list_(pa.int64()))
        )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recording, carried = None, 0
        for batch in batches:
            out = []
            for rec, tails in zip(batch.column("recording_id").to_pylist(), batch.column("exits").to_pylist()):
                carried = carried if rec == recording else 0
                recording = rec
                out.append(carried)
                carried = tails[carried]
            yield pa.RecordBatch.from_arrays(
                [batch.column("recording_id"), batch.column("_chunk"), pa.array(out, pa.int64())],
                names=["recording_id", "_chunk", "carried"],
            )

    long_rows = rows.filter(F.col("n") > chunk)
    tables = map_groups(long_rows, ["recording_id", "_chunk"], ["idx"], exits,
                        "recording_id bigint, _chunk bigint, exits array<bigint>")
    carried = (
        tables.repartition("recording_id").sortWithinPartitions("recording_id", "_chunk")
        .mapInArrow(entries, "recording_id bigint, _chunk bigint, carried bigint")
    )

    def cut(table: pa.Table, starts: np.ndarray) -> pa.Table:
        far, ends = far_of(table), np.r_[starts[1:], table.num_rows]
        entry = table.column("carried").to_numpy()
        begins = np.concatenate([
            _walk(_next_start(far[s:e], least, most, e - s), _first_start(far[s:e], int(entry[s]), least, most)) for s, e in zip(starts, ends)
        ])
        return table.select(["recording_id", "idx", "n"]).rename_columns(["recording_id", "start", "n"]).filter(pa.array(begins))

    entered = rows.select("recording_id", "_chunk", "idx", "n", "distance").join(carried, ["recording_id", "_chunk"], "left").fillna({"carried": 0})
    heads = store(map_groups(entered, ["recording_id", "_chunk"], ["idx"], cut, "recording_id bigint, start bigint, n bigint"), "groups")
    return _numbered(distances, _merge_and_split(heads, distances, least, most, chunk), chunk)


def _merge_and_split(heads: DataFrame, distances: DataFrame, least: int, most: int, chunk: int) -> DataFrame:
    """First row and size of each group once the walk is closed.

    All groups but the last have ``least`` rows, so a start closer than that to the end is a short last group; the group
    before it ends with the recording. Groups of more than ``most`` rows look at their few inner distances.
    """
    keys, groups = ["recording_id"], ["recording_id", "start"]
    linked = neighbour(heads, keys, "start", "start", ["start"], float(chunk), "_next", ahead=True)
    end = F.coalesce(F.when(F.col("n") - F.col("_next.start") >= least, F.col("_next.start")), F.col("n"))
    kept = linked.filter((F.col("start") == 0) | (F.col("n") - F.col("start") >= least)).select(*groups, "n", (end - F.col("start")).alias("size"))
    inner = kept.filter((F.col("size") > most) & (F.col("n") > least)).select(
        *groups, F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("size") - 1)).alias("idx"))
    splits = inner.join(distances.select("recording_id", "idx", "distance"), ["recording_id", "idx"]).groupBy(*groups).agg(
        F.max_by("idx", F.struct(F.round("distance", 9), -F.col("idx"))).alias("_split"))
    whole = F.array(F.struct(F.col("start"), F.col("size")))
    halves = F.array(F.struct(F.col("start"), (F.col("_split") - F.col("start")).alias("size")),
                     F.struct(F.col("_split").alias("start"), (F.col("start") + F.col("size") - F.col("_split")).alias("size")))
    parts = kept.join(splits, groups, "left").select("recording_id", F.explode(F.when(F.col("_split").isNull(), whole).otherwise(halves)).alias("_p"))
    return parts.select("recording_id", "_p.start", "_p.size")


def _numbered(distances: DataFrame, groups: DataFrame, chunk: int) -> DataFrame:
    """Segments with ``grp``: groups are numbered from 0 in a recording, and each is a few dozen rows."""
    numbered = running_total(groups, ["recording_id"], "start", "start", F.lit(1), float(chunk), "_number")
    places = numbered.select("recording_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("idx"),
                             (F.col("_number") - 1).cast("long").alias("grp"))
    return distances.join(places, ["recording_id", "idx"]).select("recording_id", "segment_id", "idx", "n", "distance", "grp")


def passage_points(
    members: DataFrame, coords: DataFrame, metadata: list[str], map_col: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Passages placed at the mean of their segments' coordinates, and those without any.

    ``members`` comes from ``change_points`` joined with segment columns; ``coords`` has segment_id, x, y.
    With ``map_col`` both sides carry a map name and all maps are done in one job.
    """
    keys = ([map_col] if map_col else []) + ["segment_id"]
    group = ([map_col] if map_col else []) + ["recording_id", "grp"]
    placed = members.join(coords.select(*keys, "x", "y"), keys, "left")
    points = placed.groupBy(*group).agg(
        settled(F.avg("x"), 5).alias("x"), settled(F.avg("y"), 5).alias("y"),
        F.min_by("start_seconds", "idx").alias("start_seconds"),
        F.max_by("end_seconds", "idx").alias("end_seconds"),
        F.count(F.lit(1)).alias("segment_count"),
        settled(F.avg("mean_rms"), 6).alias("mean_rms"),
        settled(F.avg("mean_spectral_centroid"), 2).alias("mean_spectral_centroid"),
        F.min_by(F.struct(*metadata), "idx").alias("_meta"),
    ).withColumn("duration", F.round(F.col("end_seconds") - F.col("start_seconds"), 2)).select(
        "*", *[F.col(f"_meta.{c}").alias(c) for c in metadata]
    ).drop("_meta")
    return points.filter("x is not null"), points.filter("x is null")


def number_points(points: DataFrame, map_col: str | None = None) -> DataFrame:
    """Q8/Q9: consecutive ids over the passages that were kept, of each map from 0."""
    points, keys = store(points, "points"), ([map_col] if map_col else []) + ["recording_id"]
    kept = running_total(points, keys, "grp", "grp", F.lit(1), float(CHUNK_ROWS), "_at").withColumn("_at", (F.col("_at") - 1).cast("long"))
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count")).withColumn("_key", F.struct(*keys))
    firsts = consecutive_ids(counts, "_key", "_count", "_first").select(*keys, "_first")
    if map_col:
        starts = firsts.groupBy(map_col).agg(F.min("_first").alias("_start"))
        firsts = firsts.join(starts, map_col).select(*keys, (F.col("_first") - F.col("_start")).alias("_first"))
    return kept.join(firsts, keys).withColumn("passage_id", F.col("_first") + F.col("_at")).drop("_first", "_at")


def polylines(points: DataFrame, hidden: list[str], page: int = LIST_PAGE) -> DataFrame:
    """Q10: visible points of each recording in time order, in pages of fixed length."""
    shown = points.filter(~F.col("effective_type").isin(hidden)) if hidden else points
    placed = ordinal(shown, ["recording_id"], "start_seconds", "segment_id", TIME_CHUNK, "_i")
    return placed.groupBy("recording_id", F.floor(F.col("_i") / page).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("start_seconds", "segment_id", "x", "y"))).alias("points")
    )
