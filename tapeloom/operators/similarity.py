"""Exact cosine search, song matching, projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.vectors import dot, l2_normalize, norm
from tapeloom.operators.neighbours import PIVOTS, best_groups, update_groups
from tapeloom.operators.ordered import CHUNK_ROWS, map_groups, matrix, ordinal, unit_rows, with_halo
from tapeloom.operators.quantiles import exact_quantiles
from tapeloom.session import cut_lineage

TIE_DECIMALS = 9
AXIS_ROUNDS = 5000  # at most; axes that do not move any more end earlier


def knn(queries: DataFrame, corpus: DataFrame, k: int, skip_self: bool = False, pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """Exact top ``k`` by cosine for every query; ties go to the smaller id.

    Both sides have ``id`` and ``vector``. Output: query_id, neighbour_id, similarity, rank.
    """
    rows = corpus.select("id", F.col("id").alias("grp"), "vector")
    found = best_groups(None if queries is corpus else queries, rows, k, skip_self, pivots, block_rows, grouped=False)
    return found.drop("grp")


def similar_segments(segments: DataFrame, segment_id: int, k: int = 10) -> DataFrame:
    """V4: top ``k`` other segments for one segment, with its metadata columns kept.

    The one query vector is a scalar subquery; scoring is a map over the corpus and only ``k`` rows per
    task go on. Unknown ids and missing embeddings raise.
    """
    probe = segments.filter(F.col("segment_id") == segment_id).select("embedding").head(1)
    if not probe:
        raise LookupError(f"segment {segment_id} not found")
    if probe[0].embedding is None:
        raise ValueError(f"segment {segment_id} has no embedding")
    query = F.lit([float(x) for x in probe[0].embedding])
    scale = norm(F.col("embedding")) * norm(query)
    score = F.when(scale > 0, dot(F.col("embedding"), query) / scale).otherwise(0.0)
    return (
        segments.filter(F.col("embedding").isNotNull() & (F.col("segment_id") != segment_id))
        .withColumn("score", F.round(score, TIE_DECIMALS)).drop("embedding")
        .orderBy(F.desc("score"), "segment_id").limit(k)
    )


def _labeled(labeled: DataFrame) -> DataFrame:
    return labeled.select("id", F.col("song_id").cast("long").alias("grp"), "vector").filter("song_id is not null")


def _candidates(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("query_id").alias("recording_id"), F.col("grp").alias("song_id"), F.col("neighbour_id").alias("nearest_recording_id"),
        F.col("similarity").alias("confidence"), "rank", F.lit("pending").alias("status"))


def match_songs(labeled: DataFrame, unlabeled: DataFrame, top: int = 3, pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """V5: the ``top`` best songs for every unlabeled recording.

    A song scores by its best labeled recording, which is kept as the nearest one (smallest id on a
    tie). ``labeled`` has id, song_id, vector; ``unlabeled`` id, vector.
    """
    return _candidates(best_groups(unlabeled, _labeled(labeled), top, pivots=pivots, block_rows=block_rows))


def rematch_songs(matches: DataFrame, labeled: DataFrame, unlabeled: DataFrame, changed: DataFrame, top: int = 3, pivots: int = PIVOTS,
                  block_rows: int | None = None) -> DataFrame:
    """What ``match_songs`` would give now, from what it gave before (``matches``) and the recordings changed since.

    ``changed`` (id) names recordings on either side that are new, gone, or have another vector or song. Recordings none of
    whose songs rest on a changed one meet the changed ones only.
    """
    state = matches.select(
        F.col("recording_id").alias("query_id"), F.col("song_id").alias("grp"), F.col("nearest_recording_id").alias("neighbour_id"),
        F.col("confidence").alias("similarity"))
    return _candidates(update_groups(state, unlabeled, _labeled(labeled), changed, top, pivots, block_rows))


def refresh_scope(unlabeled: DataFrame, candidates: DataFrame, recording_id: int | None = None) -> DataFrame:
    """V6: recordings to match again; those with a reviewed candidate are left alone."""
    reviewed = candidates.filter(F.col("status").isin("accepted", "rejected")).select(F.col("recording_id").alias("id"))
    todo = unlabeled.join(reviewed.distinct(), "id", "left_anti")
    return todo if recording_id is None else todo.filter(F.col("id") == recording_id)


def refresh_candidates(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """V6: candidate table in which the pending rows of matched recordings are replaced."""
    matched = matches.select("recording_id").distinct().withColumn("_new", F.lit(True))
    cols = ["recording_id", "song_id", "nearest_recording_id", "confidence", "rank", "status"]
    kept = (
        candidates.join(matched, "recording_id", "left")
        .filter(F.col("_new").isNull() | (F.col("status") != "pending"))
        .select(*cols)
    )
    return kept.unionByName(matches.select(*cols))


def match_statistics(matches: DataFrame) -> DataFrame:
    """V7: spread of the best confidence per recording, and counts."""
    matches = cut_lineage(matches.select("rank", "confidence"))
    tops = matches.filter("rank = 1")
    probs = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "max": 1.0}
    spread = exact_quantiles(tops, [], "confidence", probs)
    counts = matches.agg(F.count_if(F.col("rank") == 1).alias("processed"), F.count(F.lit(1)).alias("inserted"))
    return spread.withColumn("_k", F.lit(0)).join(counts.withColumn("_k", F.lit(0)), "_k").drop("_k")


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, out: str, normalize: bool = True) -> DataFrame:
    """Mean of the unit vectors of a group, scaled to unit length (zero kept).

    The mean is a partial aggregate over whole vectors, so a large group costs one vector per task.
    """
    unit = array_to_vector(l2_normalize(F.col(vector)) if normalize else F.col(vector).cast("array<double>"))
    means = rows.groupBy(*keys).agg(vector_to_array(Summarizer.mean(unit)).alias("_mean"))
    return means.select(*keys, (l2_normalize(F.col("_mean")) if normalize else F.col("_mean")).alias(out))


def similarity_band(indexed: DataFrame, reach: int, chunk: int = CHUNK_ROWS) -> DataFrame:
    """V8: cosines of each segment to the next ``reach`` segments of its recording, as one array.

    Input from ``index_segments``. The full matrix is only ever needed as a picture, see ``ssm_tiles``.
    """
    keep = ["recording_id", "segment_id", "idx"]
    rows = with_halo(indexed.select(*keep, "embedding"), "idx", 0, reach, chunk)

    def band(table: pa.Table, starts: np.ndarray) -> pa.Table:
        u = unit_rows(matrix(table, "embedding"))
        ends = np.repeat(np.r_[starts[1:], len(u)], np.diff(np.r_[starts, len(u)]))
        shifted = [np.clip((u[:len(u) - d] * u[d:]).sum(axis=1), -1.0, 1.0) for d in range(1, min(reach, len(u) - 1) + 1)]
        cosines = [[float(shifted[d - 1][i]) for d in range(1, min(reach, e - 1 - i) + 1)] for i, e in enumerate(ends)]
        out = table.select(keep).append_column("cosines", pa.array(cosines, pa.list_(pa.float64())))
        return out.filter(table.column("_core"))

    return map_groups(
        rows, ["recording_id", "_chunk"], ["idx"], band,
        "recording_id bigint, segment_id bigint, idx bigint, cosines array<double>",
    )


def ssm_tiles(segments: DataFrame, max_size: int = 200, width: float = 10.0 * 4096) -> DataFrame:
    """V9: grey picture of each recording's self-similarity, one output row per picture row.

    The mean of a block of cosines is the inner product of the two mean unit vectors, so a recording
    is first reduced to fewer than ``2 * max_size`` tile means; pairs of segments are never formed. With
    at most ``max_size`` segments a tile is one segment and the picture is the full matrix.
    """
    rows = ordinal(
        segments.select("recording_id", "segment_id", "start_seconds", "embedding"),
        ["recording_id"], "start_seconds", "segment_id", width, "idx", "n",
    )
    factor = F.greatest(F.floor(F.col("n") / max_size), F.lit(1)).cast("long")
    factor = F.when(F.col("n") > max_size, factor).otherwise(F.lit(1).cast("long"))
    tiles = rows.withColumn("_f", factor).filter("idx < n - n % _f").withColumn("tile", F.floor(F.col("idx") / F.col("_f")))
    unit = array_to_vector(l2_normalize(F.col("embedding")))
    means = tiles.groupBy("recording_id", "tile").agg(vector_to_array(Summarizer.mean(unit)).alias("vector"))

    def picture(table: pa.Table, starts: np.ndarray) -> pa.Table:
        m = matrix(table, "vector")
        pixels = []
        for s, e in zip(starts, np.r_[starts[1:], table.num_rows]):
            grey = (np.round(m[s:e] @ m[s:e].T, 6) + 1.0) * 0.5 * 255.0
            pixels.extend(np.floor(np.round(np.clip(grey, 0, 255), 6)).astype("i4").tolist())
        return pa.table({
            "recording_id": table.column("recording_id"), "tile": table.column("tile"),
            "pixels": pa.array(pixels, pa.list_(pa.int32())),
        })

    return map_groups(means, ["recording_id"], ["tile"], picture, "recording_id bigint, tile bigint, pixels array<int>")


def covariance(rows: DataFrame, column: str) -> np.ndarray:
    """Sample covariance of an array column. A task hands on one matrix, the driver gets one: its size is that of a vector, squared."""
    columns = "i int, j int, v double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(pa.Table.from_batches([batch]), column)
                m = np.hstack([m, np.ones((len(m), 1))])  # products with the ones are the sums and the count
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    cells = rows.select(column).mapInArrow(run, columns).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r["i"] for r in cells), default=-1) + 1
    total = np.zeros((size, size))
    for r in cells:
        total[r["i"], r["j"]] = r["v"]
    n = total[-1, -1] if size else 0
    if n < 2:
        raise ValueError("a covariance needs two rows")
    return (total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) / n) / (n - 1)


def main_axes(cov: np.ndarray, dims: int, rounds: int = AXIS_ROUNDS) -> np.ndarray:
    """Main axes, a row each, by rounds of multiplying and orthogonalising fixed starts.

    Each points so that its loading of largest size is positive.
    """
    size = len(cov)
    if dims > size:
        raise ValueError(f"{size} numbers have at most {size} axes")
    axes = [np.cos(np.arange(1, size + 1) * (j + 1)) for j in range(dims)]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for v in axes:
            v = cov @ v
            for b in done:
                v = v - (b @ v) * b
            length = np.sqrt(v @ v)
            done.append(v / length if length > 0 else v)
        still = np.abs(np.array(done) - np.array(axes)).max() < 1e-14
        axes = done
        if still:
            break
    return np.array([v if v[np.abs(v).argmax()] >= 0 else -v for v in axes])


def project(rows: DataFrame, id_col: str, vector: str, dims: int, rounds: int = AXIS_ROUNDS) -> DataFrame:
    """Deterministic ``dims``-dimensional coordinates, rounded to 5 decimals: unit vectors on their main axes."""
    unit = rows.select(id_col, l2_normalize(F.col(vector)).alias("_a"))
    axes = main_axes(covariance(unit, "_a"), dims, rounds)
    coords = [F.round(dot(F.col("_a"), F.lit([float(x) for x in axis])), 5) + 0.0 for axis in axes]
    return unit.select(id_col, F.array(*coords).alias("coords"))


def apply_model(
    df: DataFrame, load: Callable[[], Callable[[list], list]], column: str, id_col: str,
    out: str = "embedding", batch_size: int = 16,
) -> DataFrame:
    """Batched inference with a user's model, loaded once per task.

    ``load()`` returns a function from a list of inputs to a list of vectors. A batch that fails is
    retried row by row; rows that still fail carry the message in ``error``.
    """
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, {out} array<float>, error string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in parts:
            ids, inputs = part[id_col].tolist(), part[column].tolist()
            vectors, errors = [], []
            for at in range(0, len(ids), batch_size):
                chunk = inputs[at:at + batch_size]
                try:
                    vectors += [np.asarray(v, dtype="f4") for v in model(chunk)]
                    errors += [None] * len(chunk)
                except Exception:
                    for x in chunk:
                        try:
                            vectors.append(np.asarray(model([x])[0], dtype="f4"))
                            errors.append(None)
                        except Exception as e:
                            vectors.append(None)
                            errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({id_col: ids, out: vectors, "error": errors})

    return df.select(id_col, column).mapInPandas(run, schema)
