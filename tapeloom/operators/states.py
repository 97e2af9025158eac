"""Passages as states: clustering, runs, transitions and scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.vectors import cosine_distance, l2_normalize
from tapeloom.operators.ordered import CHUNK_ROWS, adjacent, matrix, running_total, with_halo
from tapeloom.session import store

INTERSTITIAL_SECONDS = 120.0
CLUSTER_ROUNDS = 6


def _nearest(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each row by squared distance to nine decimals, the first of equals."""
    return np.round((centres * centres).sum(axis=1) - 2 * unit @ centres.T, 9).argmin(axis=1)


def _first_vectors(rows: DataFrame, k: int) -> list[list[float]]:
    """The ``k`` different vectors ``u`` whose segments' ids have the smallest md5, in that order.

    A pass keeps the first few rows of each task and hands on no others; vectors found leave the next pass, so there are at most ``k``.
    """
    found: list[list[float]] = []
    left = rows.select("u", F.md5(F.col("segment_id").cast("string")).alias("h"))
    while len(found) < k:
        new = []
        for r in left.orderBy("h").limit(4 * k).collect():
            if not any(np.array_equal(r["u"], u, equal_nan=True) for u in new):
                new.append(r["u"])
        new = new[:k - len(found)]
        if not new:
            break
        found += new
        for u in new:
            left = left.filter(F.col("u") != F.lit(u))
    return found


def cluster_segments(segments: DataFrame, k: int, rounds: int = CLUSTER_ROUNDS) -> DataFrame:
    """Cluster of each segment by a fixed number of k-means rounds on unit vectors.

    The first centres are the ``k`` different vectors whose segments' ids have the smallest md5; a centre without segments stays where it is. A round
    is one pass in which each task hands on one sum per centre.
    """
    rows = segments.filter("embedding is not null").select(F.col("segment_id").cast("long"), l2_normalize(F.col("embedding")).alias("u"))
    rows = store(rows, "unit-vectors")
    starts = _first_vectors(rows, k)
    columns = "c int, n bigint, sums array<double>"
    if not starts:
        return rows.select("segment_id", F.lit(0).cast("long").alias("cluster_id"))
    centres = np.array(starts)
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    unit = matrix(pa.Table.from_batches([batch]), "u")
                    own = _nearest(unit, centres)
                    np.add.at(total, own, unit)
                    count += np.bincount(own, minlength=len(centres))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(centres)), pa.int32()), pa.array(count), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["c", "n", "sums"])

        at = F.posexplode("sums").alias("i", "x")
        summed = rows.select("u").mapInArrow(sums, columns).filter("n > 0").select("c", "n", at).groupBy("c", "i").agg(
            F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # a number for each centre and dimension
        centres = centres.copy()
        for r in summed:
            centres[r["c"], r["i"]] = np.round(r["x"] / r["n"], 9)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _nearest(matrix(pa.Table.from_batches([batch]), "u"), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype("i8"))], names=["segment_id", "cluster_id"])

    return rows.mapInArrow(assign, "segment_id bigint, cluster_id bigint")


def neighbour_novelty(neighbours: DataFrame) -> DataFrame:
    """Mean distance of a segment to its nearest neighbours."""
    return neighbours.groupBy("query_id").agg(F.avg(1 - F.col("similarity")).alias("novelty"))


def smooth_states(indexed: DataFrame, reach: int = 2) -> DataFrame:
    """Each state replaced by the most frequent one within ``reach`` segments; on a tie the
    segment's own state, else the smallest."""
    rows = with_halo(indexed.select("recording_id", "segment_id", "idx", "state"), "idx", reach, reach)
    w = Window.partitionBy("recording_id", "_chunk").orderBy("idx").rowsBetween(-reach, reach)
    around = rows.withColumn("_near", F.collect_list("state").over(w))
    votes = F.transform(
        F.array_distinct("_near"),
        lambda s: F.struct(
            F.size(F.filter("_near", lambda x: x == s)).alias("votes"),
            (s == F.col("state")).cast("int").alias("own"),
            (-s).alias("low"),
        ),
    )
    return around.withColumn("smooth", -F.array_max(votes).low).filter("_core").drop("_near", "_chunk", "_core")


def state_runs(smoothed: DataFrame, state: str = "smooth") -> DataFrame:
    """``grp``, the number of the run of equal states, per recording from 0."""
    keys, width = ["recording_id"], float(CHUNK_ROWS)
    rows = adjacent(smoothed, keys, "idx", [state], "_prev")
    turn = F.when(F.col(f"_prev.{state}") != F.col(state), 1).otherwise(0)
    return running_total(rows, keys, "idx", "segment_id", turn, width, "grp").drop("_prev")


def meta_state(is_rehearsal: Column, chunk_seconds: Column) -> Column:
    """D3: short stretches of a rehearsal are interstitial, everything else is musical."""
    return F.when(is_rehearsal & (chunk_seconds < INTERSTITIAL_SECONDS), "Interstitial").otherwise("Musical")


def successors(passages: DataFrame) -> DataFrame:
    """The passage that followed in the recording, and the third of the recording a passage lies in."""
    rows = adjacent(passages, ["recording_id"], "grp", ["passage_id", "passage_type"], "_next", ahead=True)
    counts = passages.groupBy("recording_id").agg(F.count(F.lit(1)).alias("_n"))
    third = F.floor(F.col("grp") * 3 / F.col("_n"))
    return rows.join(counts, "recording_id").select(
        *passages.columns, F.col("_next.passage_id").alias("successor_id"), F.col("_next.passage_type").alias("next_type"),
        F.when(third == 0, "beginning").when(third == 1, "middle").otherwise("end").alias("position"),
    )


def transitions(steps: DataFrame, source: str, target: str, weight_by: str | None = None) -> DataFrame:
    """Transition probabilities; with ``weight_by`` each of its values weighs the same in total."""
    pairs = steps.filter(F.col(source).isNotNull() & F.col(target).isNotNull())
    if weight_by:
        counts = pairs.groupBy(weight_by, source, target).agg(F.count(F.lit(1)).alias("_n"))
        sums = counts.groupBy(weight_by).agg(F.sum("_n").alias("_total"))
        weighted = counts.join(sums, counts[weight_by].eqNullSafe(sums[weight_by])).withColumn("_w", F.col("_n") / F.col("_total"))
        cells = weighted.groupBy(source, target).agg(F.sum("_w").alias("weight"))
    else:
        cells = pairs.groupBy(source, target).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    totals = cells.groupBy(source).agg(F.sum("weight").alias("_total"))
    return cells.join(totals, source).withColumn("probability", F.col("weight") / F.col("_total")).drop("_total")


def initial_distribution(passages: DataFrame, state: str) -> DataFrame:
    """How often each state opens a recording."""
    counts = passages.filter("grp = 0").groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("probability", F.col("n") / total)


def blend(learned: DataFrame, mode: DataFrame, source: str, target: str, alpha: float) -> DataFrame:
    """(1 - alpha) * learned + alpha * mode; cells missing on one side count as 0."""
    a = learned.select(source, target, F.col("probability").alias("_a"))
    b = mode.select(source, target, F.col("probability").alias("_b"))
    return a.join(b, [source, target], "full").select(
        source, target,
        ((1 - alpha) * F.coalesce("_a", F.lit(0.0)) + alpha * F.coalesce("_b", F.lit(0.0))).alias("probability"),
    )


# Weights of the score's parts; the design gives only their order.
SCORE_WEIGHTS = {"boundary": 1.0, "recency": 1.0, "duration": 0.5, "fidelity": 0.5, "key": 0.5, "era": 0.25}


def score_passages(
    inventory: DataFrame, closing: list[float], chroma: list[float] | None, year: int | None,
    successor_id: int | None, wanted_seconds: float, temperature: float = 1.0, weights: dict[str, float] | None = None,
) -> DataFrame:
    """Probability of each passage of a state's inventory to be played next.

    ``inventory`` has passage_id, opening (vector), chroma, year, duration and plays_ago (null: never).
    The current passage enters as plain values; the softmax total is one aggregate.
    """
    w = {**SCORE_WEIGHTS, **(weights or {})}
    parts = [
        w["boundary"] * (1 - cosine_distance(F.col("opening"), F.lit(closing))),
        -w["recency"] * F.coalesce(1 / (1 + F.col("plays_ago")), F.lit(0.0)),
        -w["duration"] * F.abs(F.log(F.greatest(F.col("duration"), F.lit(1.0)) / max(wanted_seconds, 1.0))),
    ]
    if successor_id is not None:
        parts.append(w["fidelity"] * (F.col("passage_id") == successor_id).cast("double"))
    if chroma is not None:
        parts.append(w["key"] * (1 - cosine_distance(F.col("chroma"), F.lit(chroma))))
    if year is not None:
        parts.append(w["era"] * F.coalesce(1 / (1 + F.abs(F.col("year") - year)), F.lit(0.0)))
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    scored = inventory.withColumn("score", score)
    top = scored.agg(F.max("score")).scalar()
    weighed = scored.withColumn("_w", F.exp((F.col("score") - top) / temperature))
    total = weighed.agg(F.sum("_w")).scalar()
    return weighed.withColumn("probability", F.col("_w") / total).drop("_w")


def session_calendar(sessions: DataFrame, recordings: DataFrame) -> DataFrame:
    """Sessions, recordings and hours per month."""
    sums = recordings.groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("duration_seconds").alias("_s")
    )
    return (
        sessions.join(sums, "id", "left").groupBy(F.substring("date", 1, 7).alias("month"))
        .agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("_n"), F.lit(0)).alias("recordings"),
             F.coalesce(F.sum("_s") / 3600, F.lit(0.0)).alias("hours"))
    )


def state_sequence(passages: DataFrame, page: int = 4096) -> DataFrame:
    """The states of a recording in order, in pages."""
    return passages.groupBy("recording_id", F.floor(F.col("grp") / page).alias("page")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("grp", "passage_type"))), lambda s: s.passage_type).alias("states")
    )


def _deletions(word: Column, times: int) -> Column:
    """All strings that ``word`` becomes by dropping at most so many characters."""
    out = F.array(word)
    for _ in range(times):
        fewer = F.flatten(F.transform(out, lambda w: F.transform(
            F.filter(F.sequence(F.lit(0), F.length(w)), lambda i: i < F.length(w)),
            lambda i: F.concat(F.substring(w, F.lit(1), i), F.substring(w, i + 2, F.length(w))))))
        out = F.array_distinct(F.concat(out, fewer))
    return out


def copy_candidates(titles: DataFrame, distance: int, gram: int = 2, shared: int = 2) -> DataFrame:
    """``date, left_title, right_title`` that may be within ``distance`` edits; input has side, date, low, each once.

    An edit destroys at most ``gram`` of a title's grams and moves the others by at most one place. So two titles of a date
    have all but ``gram * distance`` grams in common, at most ``distance`` places apart; put in any fixed order, at least
    ``shared`` of these are among the first ``gram * distance + shared`` of either title. The order is rarest first on that date, so what
    all titles have in common (``tema numero``) brings nobody together. Titles too short for that meet on what is
    left of them after at most ``distance`` deletions, of which a short title has few.
    """
    prefix = gram * distance + shared
    short = prefix + gram - 2  # up to this length a title has fewer than ``prefix`` grams
    size = F.length("low")
    lists = titles.filter(size > short).withColumn("_g", F.transform(
        F.sequence(F.lit(0), size - gram), lambda i: F.struct(F.substring(F.col("low"), i + 1, F.lit(gram)).alias("gram"), i.alias("at"))))
    grams = lists.select("side", "date", "low", F.inline("_g"))
    often = grams.groupBy("date", "gram").agg(F.count(F.lit(1)).alias("_often"))
    first = grams.join(often, ["date", "gram"]).groupBy("side", "date", "low").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("_often", "gram", "at"))), 1, prefix).alias("_first")  # a title's own grams
    ).select("side", "date", "low", F.inline("_first")).drop("_often")
    a, b = (first.filter(F.col("side") == s).select(
        "date", "gram", F.col("low").alias(f"{name}_title"), F.col("at").alias(f"_{name}"), F.length("low").alias(f"_{name}_size"))
        for s, name in enumerate(("left", "right")))
    met = (
        a.join(b, ["date", "gram"])
        .filter((F.abs(F.col("_left") - F.col("_right")) <= distance) & (F.abs(F.col("_left_size") - F.col("_right_size")) <= distance))
        .groupBy("date", "left_title", "right_title").agg(F.count_distinct("_left").alias("_shared"))
        .filter(F.col("_shared") >= shared).drop("_shared")
    )
    cut = titles.filter(size <= short + distance).withColumn("_rest", F.explode(_deletions(F.col("low"), distance)))
    c, d = (cut.filter(F.col("side") == s).select("date", "_rest", F.col("low").alias(f"{name}_title")) for s, name in enumerate(("left", "right")))
    few = c.join(d, ["date", "_rest"]).filter(F.least(F.length("left_title"), F.length("right_title")) <= short)
    return met.unionByName(few.select("date", "left_title", "right_title").distinct())


def likely_copies(items: DataFrame, sections: tuple[str, str], distance: int = 2) -> DataFrame:
    """Titles of two sections on one date that differ by at most ``distance`` edits; equal titles count once."""
    side = F.explode(F.array_compact(F.array(*[F.when(F.col("section") == name, i) for i, name in enumerate(sections)])))
    titles = items.filter("date is not null and title is not null").select(side.alias("side"), "date", F.lower("title").alias("low")).distinct()
    met = copy_candidates(titles, distance)
    return met.withColumn("edits", F.levenshtein("left_title", "right_title")).filter(F.col("edits") <= distance)


def equal_contents(files: DataFrame, content: str, id_col: str) -> DataFrame:
    """Contents that occur more than once, by hash: the first id and the number of copies."""
    return (
        files.groupBy(F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )


def takes_in_order(recordings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of a take among its song's takes by date, undated ones last."""
    ses = sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date"))
    month = F.substring("session_date", 1, 4).try_cast("long") * 12 + F.substring("session_date", 6, 2).try_cast("long")
    undated = F.lit(1 << 40) + F.floor(F.col("id") / (1 << 20))
    rows = recordings.filter("song_id is not null").join(ses, "session_id", "left").withColumn("_month", F.coalesce(month, undated))
    months = rows.groupBy("song_id", "_month").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("song_id").orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.select("song_id", "_month", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("song_id", "_month").orderBy("session_date", "id")
    return rows.withColumn("_local", F.row_number().over(inside)).join(months, ["song_id", "_month"]).select(
        "id", "song_id", "session_date", (F.col("_before") + F.col("_local")).alias("take_number")
    )
