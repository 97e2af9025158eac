"""Summaries, rankings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.labels import level_label, percent, settled
from tapeloom.operators.lookups import best_candidate, review_rows
from tapeloom.operators.quantiles import exact_quantiles, values_at
from tapeloom.sources.store import top_n

NOISE = -1


def review_stats(recordings: DataFrame, candidates: DataFrame) -> DataFrame:
    """G1: totals and counts by type and by source, in one pass over the recordings.

    Rows: kind ``total``, ``type`` or ``source``; ``name`` is the value counted.
    """
    sets = (
        recordings.groupingSets(
            [["content_type"], ["content_type_source"], []], "content_type", "content_type_source"
        )
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("content_type").isNotNull()).alias("classified"),
             F.grouping_id().alias("_g"))
    )
    by_name = sets.filter("_g < 3").select(
        F.when(F.col("_g") == 1, "by_type").otherwise("by_source").alias("kind"),
        F.coalesce("content_type", "content_type_source").alias("name"), "n",
    ).filter("name is not null")
    total = sets.filter("_g = 3")
    parts = F.map_from_arrays(
        F.array(F.lit("total"), F.lit("classified"), F.lit("unclassified")),
        F.array(F.col("n"), F.col("classified"), F.col("n") - F.col("classified")),
    )
    totals = total.select(F.explode(parts).alias("name", "n")).select(F.lit("total").alias("kind"), "name", "n")
    pending = candidates.agg(F.count_if(F.col("status") == "pending").alias("n")).select(
        F.lit("total").alias("kind"), F.lit("pending_candidates").alias("name"), "n"
    )
    return totals.unionByName(pending).unionByName(by_name)


def passage_types(passages: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Size, reach and mean features per passage type, with its five most frequent songs.

    ``keys`` lets several runs be summarised at once.
    """
    group = [*(keys or []), "passage_type"]
    base = passages.groupBy(*group).agg(
        F.count(F.lit(1)).alias("count"),
        F.countDistinct("recording_id").alias("n_recordings"),
        settled(F.avg("duration"), 1).alias("mean_duration"),
        settled(F.avg("mean_rms"), 6).alias("mean_rms"),
        settled(F.avg("mean_spectral_centroid"), 2).alias("mean_spectral_centroid"),
    )
    named = passages.filter("song_title is not null and song_title <> ''")
    tally = named.groupBy(*group, "song_title").agg(F.count(F.lit(1)).alias("_n"))
    tops = (
        top_n(tally, group, [F.desc("_n"), F.asc("song_title")], 5, "_rank")
        .groupBy(*group)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "song_title", "_n"))),
                         lambda s: F.struct(s.song_title.alias("title"), s._n.alias("count"))).alias("top_songs"))
    )
    return base.join(tops, group, "left")


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """Mean, exact median, minimum and maximum of a column."""
    stats = rows.agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = exact_quantiles(rows, [], value, {"median": 0.5})
    return stats.withColumn("_k", F.lit(0)).join(middle.withColumn("_k", F.lit(0)), "_k").drop("_k")


def cluster_acoustics(segments: DataFrame) -> DataFrame:
    """Mean level and brightness per cluster, noise left out."""
    return segments.filter(F.col("cluster_id") != NOISE).groupBy("cluster_id").agg(
        F.avg("mean_rms").alias("mean_rms"), F.avg("mean_spectral_centroid").alias("mean_centroid")
    )


def normalise_over(rows: DataFrame, value: str, out: str) -> DataFrame:
    """0-100 position between the least and greatest value; 50 when they are equal, null kept."""
    bounds = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    placed = F.when(hi == lo, 50.0).otherwise(F.try_divide(F.col(value) - lo, hi - lo) * 100.0)
    return rows.withColumn(out, F.when(F.col(value).isNotNull(), placed))


def cluster_types(segments: DataFrame) -> DataFrame:
    """Segments per cluster and type, with the cluster's total and the type's share."""
    counts = segments.groupBy("cluster_id", "effective_type").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "cluster_id").withColumn("pct", percent(F.col("n"), F.col("total")))


def cluster_purity(segments: DataFrame) -> DataFrame:
    """Dominant type of each cluster, its share, and the breakdown by falling count."""
    return cluster_types(segments).groupBy("cluster_id").agg(
        F.max("total").alias("total"),
        F.min_by("effective_type", F.struct(-F.col("n"), "effective_type")).alias("dominant_type"),
        F.max("pct").alias("dominant_pct"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "effective_type", "n"))),
            lambda s: F.concat(s.effective_type, F.lit(": "), s.n.cast("string")),
        ), " | ").alias("breakdown"),
    )


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    """Segments, clusters, noise share and the spread of cluster sizes."""
    sizes = assignments.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    real = F.when(F.col("cluster_id") != NOISE, F.col("n"))
    return sizes.agg(
        F.sum("n").alias("n_segments"),
        F.count(real).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster_id") == NOISE, F.col("n"))), F.lit(0)).alias("noise_count"),
        F.avg(real).alias("size_mean"), F.median(real).alias("size_median"),
        F.min(real).alias("size_min"), F.max(real).alias("size_max"),
    ).withColumn("noise_fraction", F.col("noise_count") / F.col("n_segments"))


def cluster_cards(segments: DataFrame) -> DataFrame:
    """Words for each cluster, such as ``loud · bright · mostly jam``."""
    levels = normalise_over(normalise_over(cluster_acoustics(segments), "mean_rms", "rms_pct"), "mean_centroid", "centroid_pct")
    types = cluster_purity(segments).select("cluster_id", "dominant_type")
    words = F.array(
        level_label(F.col("rms_pct"), "quiet", "mid-level", "loud"),
        level_label(F.col("centroid_pct"), "dark", "neutral", "bright"),
        F.concat(F.lit("mostly "), "dominant_type"),
    )
    label = F.array_join(F.filter(words, lambda w: w.isNotNull() & (w != "")), " · ")
    return levels.join(types, "cluster_id", "left").withColumn(
        "label", F.when(F.col("mean_rms").isNull() & F.col("mean_centroid").isNull(), "").otherwise(label)
    )


def compare_runs(runs: DataFrame) -> DataFrame:
    """Runs by method and cluster count, with the noise share in percent."""
    return runs.withColumn("noise_pct", F.round(F.col("noise_fraction") * 100, 1)).orderBy("method", "n_clusters", "run")


def song_totals(songs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Takes and total duration per song; unknown durations count as 0."""
    sums = recordings.groupBy(F.col("song_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_takes"), F.sum(F.coalesce("duration_seconds", F.lit(0.0))).alias("_total")
    )
    return songs.join(sums, "id", "left").select(
        "id", "title", F.coalesce("_takes", F.lit(0)).alias("takes"), F.coalesce("_total", F.lit(0.0)).alias("total_seconds")
    )


def scale_domains(points: DataFrame) -> DataFrame:
    """Value ranges behind a map's colour and size scales.

    The duration marks are the entries at floor(n * 0.1) and floor(n * 0.9) of the sorted positive
    durations, not interpolated.
    """
    year = F.substring("session_date", 1, 4).try_cast("int")
    year = F.when(year > 0, year)
    rms, cent = F.coalesce("mean_rms", F.lit(0.0)), F.coalesce("mean_spectral_centroid", F.lit(0.0))
    ranges = points.agg(
        F.min(rms).alias("rms_min"), F.max(rms).alias("rms_max"),
        F.min(cent).alias("centroid_min"), F.max(cent).alias("centroid_max"),
        F.min(year).alias("year_min"), F.max(year).alias("year_max"),
    ).withColumn("_all", F.lit(0))
    positive = points.filter("duration > 0").select(F.lit(0).alias("_all"), "duration")
    marks = values_at(positive, ["_all"], "duration", {
        "duration_p10": F.floor(F.col("_n") * F.lit(0.1)), "duration_p90": F.floor(F.col("_n") * F.lit(0.9)),
    })
    return ranges.join(marks, "_all", "left").drop("_all")


def visible_count(points: DataFrame, hidden: list[str]) -> DataFrame:
    """Points per category and whether the category is shown."""
    return points.groupBy("effective_type").agg(F.count(F.lit(1)).alias("points")).withColumn(
        "visible", ~F.col("effective_type").isin(hidden)
    )


def recording_levels(segments: DataFrame) -> DataFrame:
    """Mean and population variance of segment levels, mean brightness; all null without levels."""
    return segments.groupBy("recording_id").agg(
        F.avg("mean_rms").alias("mean_rms"), F.var_pop("mean_rms").alias("rms_variance"),
        F.avg("mean_spectral_centroid").alias("_centroid"),
    ).withColumn("mean_centroid", F.when(F.col("mean_rms").isNotNull(), F.col("_centroid"))).drop("_centroid")


def best_confidence(recordings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Highest confidence among candidates not rejected, 0.0 without any."""
    best = candidates.filter("status <> 'rejected'").groupBy(F.col("recording_id").alias("id")).agg(
        F.max("confidence").alias("_best")
    )
    return recordings.join(best, "id", "left").withColumn("best_confidence", F.coalesce("_best", F.lit(0.0))).drop("_best")


def outcome_summary(results: DataFrame) -> DataFrame:
    """Rows per outcome."""
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def review_queue(
    recordings: DataFrame, sessions: DataFrame, songs: DataFrame, candidates: DataFrame, segments: DataFrame,
    status: str = "unreviewed", sort: str = "confidence", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of recordings waiting for review, in queue order.

    Filters reach the scan and the page is cut before the review columns are joined; candidates and segments
    are semi-joined by its ids, which Spark broadcasts if they are few.
    """
    queue = recordings.filter("song_id is null and origin = 'vad_segment'")
    if status == "unreviewed":
        queue = queue.filter("content_type is null")
    elif status == "auto":
        queue = queue.filter("content_type_source = 'auto'")
    if sort == "confidence":
        queue = best_candidate(queue, candidates)
        order = [F.desc("_sort"), F.asc("id")]
        queue = queue.withColumn("_sort", F.coalesce("best_confidence", F.lit(-1.0))).drop("best_confidence")
    elif sort == "duration":
        queue = queue.withColumn("_sort", F.col("duration_seconds"))
        order = [F.asc_nulls_first("_sort"), F.asc("id")]
    elif sort == "date":
        dates = sessions.select(F.col("id").alias("session_id"), F.col("date").alias("_sort"))
        queue = queue.join(dates, "session_id", "left")
        order = [F.asc_nulls_first("_sort"), F.asc("id")]
    else:
        queue = queue.withColumn("_sort", F.lit(None).cast("string"))
        order = [F.asc("id")]
    page = queue.orderBy(*order).offset(offset).limit(limit)
    ids = page.select(F.col("id").alias("recording_id"))
    few_candidates = candidates.join(ids, "recording_id", "left_semi")
    few_segments = segments.join(ids, "recording_id", "left_semi")
    rows = review_rows(page.drop("_sort"), sessions, songs, few_candidates, few_segments, recordings)
    return rows.join(page.select("id", "_sort"), "id").orderBy(*order).drop("_sort")


def seeded_order(id_col: str, seed: int) -> list[Column]:
    """Repeatable random order: a hash of id and seed, then the id."""
    return [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), F.col(id_col)]


def sample_per_group(rows: DataFrame, group: str, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` random rows of every group."""
    return top_n(rows, [group], seeded_order(id_col, seed), n, "_rank").drop("_rank")


def one_per_recording(passages: DataFrame, n: int = 15, seed: int = 42) -> DataFrame:
    """T4: one random passage of each of ``n`` random recordings."""
    one = top_n(passages, ["recording_id"], seeded_order("passage_id", seed), 1, "_rank").drop("_rank")
    return one.orderBy(*seeded_order("recording_id", seed)).limit(n)


def similar_passages(passages: DataFrame, passage_type: int, recording_id: int, n: int = 10, seed: int = 42) -> DataFrame:
    """T5: random passages of the same type from other recordings."""
    pool = passages.filter((F.col("passage_type") == passage_type) & (F.col("recording_id") != recording_id))
    return pool.orderBy(*seeded_order("passage_id", seed)).limit(n)


def most_segmented(stats: DataFrame, n: int = 20) -> DataFrame:
    """Recordings with the most passages."""
    return stats.orderBy(F.desc("n_passages"), "recording_id").limit(n)


def types_by_size(types: DataFrame) -> DataFrame:
    """Passage types, largest first."""
    return types.orderBy(F.desc("count"), "passage_type")


def jam_listing(songs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Jams, each shown by its first recording."""
    first = recordings.groupBy(F.col("song_id").alias("id")).agg(
        F.min_by(F.struct(F.col("id").alias("recording_id"), "duration_seconds", "session_id"), "id").alias("_first")
    )
    return songs.filter("song_type = 'jam'").join(first, "id", "left").select(
        "id", "title", "_first.recording_id", "_first.duration_seconds", "_first.session_id"
    )
