"""Series and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ordered import neighbour
from tapeloom.operators.quantiles import exact_quantile
from tapeloom.session import cut_lineage
from tapeloom.schemas import SEGMENT_SECONDS, SEGMENT_STEP_SECONDS

# Level normalisation and silence search defaults.
GAIN_TARGET = 0.95
GAIN_PERCENTILE = 0.995
GAIN_STRIDE = 10
GAIN_FLOOR = 1e-8
PEAK_FLOOR = 0.001
PEAK_TARGET = 0.999
DB_OFFSET = 1e-9
SILENCE_DB = -40.0
MIN_SILENCE_SECONDS = 4.0
MIN_SEGMENT_SECONDS = 40.0
START_TOLERANCE = 0.01
CHUNK = 4096


def _grid(df: DataFrame, key: str, bins: Column) -> DataFrame:
    """Every bin number of every key; long keys unfold in two steps so no row holds a huge array."""
    size = 65536
    blocks = df.select(key, bins.cast("long").alias("_n")).filter("_n > 0").select(
        key, "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / size))).alias("_b")
    )
    first = F.col("_b") * size
    return blocks.select(
        key, F.explode(F.sequence(first, F.least(first + size - 1, F.col("_n") - 1))).alias("second")
    )


def _binned(frames: DataFrame, key: str, t: str, values: dict[str, Column], lengths: DataFrame, width: float) -> DataFrame:
    """Means per key and bin, frames past the end in the last bin.

    Frames are summed up per bin before the join by key, so that a key with very many frames is joined as its bins.
    """
    sums = frames.groupBy(key, F.floor(F.col(t) / width).cast("long").alias("_bin")).agg(
        *[f(v).alias(f"{kind}{name}") for name, v in values.items() for kind, f in (("_s_", F.sum), ("_c_", F.count))])
    last = F.greatest(F.least(F.col("_bin"), F.col("n") - 1), F.lit(0).cast("long"))
    return sums.join(lengths.select(key, "n"), key).groupBy(key, last.alias("second")).agg(
        *[F.try_divide(F.sum(f"_s_{name}"), F.sum(f"_c_{name}")).alias(name) for name in values])


def bin_frames(frames: DataFrame, key: str, t: str, value: str, lengths: DataFrame, width: float = 1.0) -> DataFrame:
    """A1: mean per bin of ``width``; bins without frames are 0.0.

    ``lengths`` has one row per key with the bin count ``n``; frames past the end fall in the last bin.
    """
    means = _binned(frames, key, t, {"value": F.col(value)}, lengths, width)
    return (
        _grid(lengths, key, F.col("n")).join(means, [key, "second"], "left")
        .select(key, "second", F.coalesce("value", F.lit(0.0)).alias("value"))
    )


def bin_vectors(
    frames: DataFrame, key: str, t: str, vector: str, dims: int, lengths: DataFrame, width: float = 1.0
) -> DataFrame:
    """A2: same for vectors of ``dims`` numbers, one average per dimension in a single aggregate."""
    numbers = {f"_d{i}": F.get(vector, i).cast("double") for i in range(dims)}
    means = _binned(frames, key, t, numbers, lengths, width)
    cells = F.array(*[F.coalesce(f"_d{i}", F.lit(0.0)) for i in range(dims)])
    return _grid(lengths, key, F.col("n")).join(means, [key, "second"], "left").select(
        key, "second", cells.alias("vector")
    )


def missing_duration(recordings: DataFrame) -> DataFrame:
    """A3: recordings that cannot be cut, with the reason."""
    return recordings.filter(F.col("duration_seconds").isNull()).select(
        F.col("id").alias("recording_id"), F.lit("no duration_seconds").alias("error")
    )


def make_segments(
    recordings: DataFrame, existing: DataFrame | None = None,
    length: float = SEGMENT_SECONDS, step: float = SEGMENT_STEP_SECONDS,
) -> DataFrame:
    """A3: overlapping windows over each recording; recordings that have segments are left alone."""
    todo = recordings.filter(F.col("duration_seconds") > 0)
    if existing is not None:
        todo = todo.join(existing.select(F.col("recording_id").alias("id")).distinct(), "id", "left_anti")
    todo = todo.select(F.col("id").alias("recording_id"), F.col("duration_seconds").cast("double").alias("_d"))
    windows = _grid(
        todo.withColumn("_key", F.struct("recording_id", "_d")), "_key", F.ceil(F.col("_d") / step)
    )
    start = F.col("second") * F.lit(float(step))
    return windows.select(
        F.col("_key.recording_id").alias("recording_id"),
        F.round(start, 3).alias("start_seconds"),
        F.round(F.least(start + length, F.col("_key._d")), 3).alias("end_seconds"),
    )


def segment_stats(
    seconds: DataFrame, segments: DataFrame, value: str = "value",
    step: float = SEGMENT_STEP_SECONDS,
) -> DataFrame:
    """Mean and population variance of the seconds of each segment.

    A segment covers seconds [floor(start), ceil(end)). Seconds and segments meet on
    (recording, cell) where a cell is ``step`` seconds long, so the interval join is an equi-join and a
    hot recording is spread over its cells. Segments without seconds give no row.
    """
    wide = segments.select(
        F.col("id").alias("segment_id"), "recording_id",
        F.floor("start_seconds").cast("long").alias("_from"),
        F.ceil("end_seconds").cast("long").alias("_to"),
    ).filter("_to > _from")
    cells = wide.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step)))
    )
    rows = seconds.withColumn("_cell", F.floor(F.col("second") / step))
    inside = (F.col("second") >= F.col("_from")) & (F.col("second") < F.col("_to"))
    return (
        rows.join(cells, ["recording_id", "_cell"]).filter(inside)
        .groupBy("recording_id", "segment_id")
        .agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    )


def segment_vector_stats(seconds: DataFrame, segments: DataFrame, vector: str, dims: int) -> DataFrame:
    """A4 for vectors: mean and population variance per dimension."""
    step = SEGMENT_STEP_SECONDS
    cells = segments.select(
        F.col("id").alias("segment_id"), "recording_id",
        F.floor("start_seconds").cast("long").alias("_from"),
        F.ceil("end_seconds").cast("long").alias("_to"),
    ).filter("_to > _from").withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step)))
    )
    rows = seconds.withColumn("_cell", F.floor(F.col("second") / step))
    inside = (F.col("second") >= F.col("_from")) & (F.col("second") < F.col("_to"))
    aggs = []
    for i in range(dims):
        x = F.get(vector, i).cast("double")
        aggs += [F.avg(x).alias(f"_m{i}"), F.var_pop(x).alias(f"_v{i}")]
    return (
        rows.join(cells, ["recording_id", "_cell"]).filter(inside)
        .groupBy("recording_id", "segment_id").agg(*aggs)
        .select(
            "recording_id", "segment_id",
            F.array(*[f"_m{i}" for i in range(dims)]).alias("mean"),
            F.array(*[f"_v{i}" for i in range(dims)]).alias("variance"),
        )
    )


def norm_gain(samples: DataFrame, key: str, position: str, value: str, stride: int = GAIN_STRIDE) -> DataFrame:
    """A5: gain per key that brings the 99.5th percentile of every tenth sample to 0.95."""
    every = samples.filter(F.col(position) % stride == 0).select(key, F.abs(value).alias("_x"))
    peaks = exact_quantile(every, [key], "_x", GAIN_PERCENTILE, "_peak")
    gain = F.when(F.col("_peak") > GAIN_FLOOR, F.lit(GAIN_TARGET) / F.col("_peak")).otherwise(1.0)
    return samples.select(key).distinct().join(peaks, key, "left").select(key, gain.alias("gain"))


def apply_gain(samples: DataFrame, gains: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """A5: scale and clip to [-1, 1]."""
    scaled = F.col(value) * F.col("gain")
    return samples.join(gains, key).withColumn(out, F.greatest(F.least(scaled, F.lit(1.0)), F.lit(-1.0))).drop("gain")


def peak_normalise(samples: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Scale so that the loudest sample of a key is 0.999; very quiet keys are not blown up."""
    peaks = samples.groupBy(key).agg(F.max(F.abs(value)).alias("_peak"))
    return samples.join(peaks, key).withColumn(
        out, F.col(value) / F.greatest(F.lit(PEAK_FLOOR), F.col("_peak")) * PEAK_TARGET
    ).drop("_peak")


def to_db(magnitudes: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Decibels below the loudest value of the key."""
    tops = magnitudes.groupBy(key).agg(F.max(F.col(value) + DB_OFFSET).alias("_top"))
    return magnitudes.join(tops, key).withColumn(
        out, 20 * F.log10(F.col(value) + DB_OFFSET) - 20 * F.log10("_top")
    ).drop("_top")


def downsample_mean(series: DataFrame, key: str, position: str, value: str, m: int) -> DataFrame:
    """Mean of each ``m`` consecutive rows; an incomplete tail is dropped."""
    return (
        series.groupBy(key, F.floor(F.col(position) / m).alias(position))
        .agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == m).drop("_n")
    )


def pad_or_truncate(values: Column, n: int, fill: float) -> Column:
    """Exactly ``n`` entries."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill).cast("double"), n)), 1, n)


def series_cut(values: Column, at: Column) -> tuple[Column, Column]:
    """The entries before and from second ``floor(at)``."""
    k = F.least(F.floor(at).cast("int"), F.size(values))
    return F.slice(values, F.lit(1), k), F.slice(values, k + 1, F.size(values) - k)


def silence_intervals(
    levels: DataFrame, key: str, t: str, level: str, width: float = 1.0,
    threshold: float = SILENCE_DB, min_silence: float = MIN_SILENCE_SECONDS,
) -> DataFrame:
    """A10: runs of rows below ``threshold`` that last at least ``min_silence`` seconds.

    A run ends where the next row is loud again, or one ``width`` after the last row of the key.
    """
    span = width * CHUNK
    quiet = levels.select(key, F.col(t).alias("_t"), (F.col(level) < threshold).alias("_quiet"))
    rows = neighbour(quiet, [key], "_t", "_t", ["_quiet"], span, "_prev")
    edges = rows.filter(F.col("_prev").isNull() | (F.col("_quiet") != F.col("_prev._quiet")))
    edges = cut_lineage(edges.select(key, "_t", "_quiet"))
    edges = neighbour(edges, [key], "_t", "_t", ["_t"], span, "_next", ahead=True)
    ends = levels.groupBy(key).agg((F.max(t) + width).alias("_end"))
    return (
        edges.filter("_quiet").join(ends, key)
        .select(key, F.col("_t").alias("start"), F.coalesce("_next._t", "_end").alias("end"))
        .filter(F.col("end") - F.col("start") >= min_silence)
    )


def active_segments(
    silences: DataFrame, totals: DataFrame, key: str, min_segment: float = MIN_SEGMENT_SECONDS
) -> DataFrame:
    """Stretches between silences lasting at least ``min_segment`` seconds.

    ``totals`` has one row per key with its ``total`` duration. A stretch that begins within 0.01 s of a
    silence start is silent. Boundaries are rows, so the count per key is not limited.
    """
    span = CHUNK * MIN_SILENCE_SECONDS
    known = cut_lineage(silences.join(totals.select(key), key, "left_semi"))
    marks = (
        totals.select(key, F.lit(0.0).alias("_t"))
        .unionByName(totals.select(key, F.col("total").alias("_t")))
        .unionByName(known.select(key, F.col("start").alias("_t")))
        .unionByName(known.select(key, F.col("end").alias("_t")))
        .distinct()
    )
    stretches = neighbour(marks, [key], "_t", "_t", ["_t"], span, "_next", ahead=True).filter("_next is not null")
    tick = F.floor(F.col("start") / START_TOLERANCE)
    silent = known.select(
        key, F.col("start").alias("_s"),
        F.explode(F.array(tick - 1, tick, tick + 1)).alias("_tick"),
    )
    probe = stretches.withColumn("_tick", F.floor(F.col("_t") / START_TOLERANCE)).alias("p")
    close = (
        (F.col(f"p.{key}") == F.col(f"s.{key}")) & (F.col("p._tick") == F.col("s._tick"))
        & (F.abs(F.col("s._s") - F.col("p._t")) < START_TOLERANCE)
    )
    return (
        probe.join(silent.alias("s"), close, "left_anti")
        .filter(F.col("_next._t") - F.col("_t") >= min_segment)
        .select(key, F.round("_t", 3).alias("start"), F.round("_next._t", 3).alias("end"))
    )


def outcome_counts(results: DataFrame, dry_run: bool = False) -> DataFrame:
    """Created, skipped and failed of a result table with ``created`` counts and an ``error``."""
    failed = F.col("error").isNotNull()
    skipped = ~failed & (F.col("created") == 0) & F.lit(not dry_run)
    return results.agg(
        F.coalesce(F.sum(F.when(~failed, F.col("created"))), F.lit(0)).cast("long").alias("created"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(failed).alias("failed"),
    )
