"""Decisions and maintenance over the archive tables.

Tables are immutable: every operator takes tables and returns new ones. A decision is a row
(seq, kind, recording_id, song_id, candidate_id, content_type, split_at, at); ``seq`` is unique and gives
the order. Kinds: classify, batch_classify, assign, unassign, accept, reject, revert, split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.labels import ineligible, invalid_classification
from tapeloom.functions.text import path_keys, prefix_keys, renamed_file, slugify, slugify_folded
from tapeloom.operators.lookups import needs_processing, nearest_start
from tapeloom.operators.ordered import carry_forward, running_total
from tapeloom.operators.series import series_cut
from tapeloom.operators.summaries import best_confidence, recording_levels
from tapeloom.session import cut_lineage
from tapeloom.sources.inventory import dense_ids
from tapeloom.sources.store import latest

DECISION_CHUNK = 1 << 16

# Rules of automatic classification.
SILENCE_RMS = 0.005
INTERSTITIAL_RMS = 0.03
LEVEL_VARIANCE = 0.001
MUSICAL_RMS = 0.04
HIGH_CONFIDENCE = 0.70
COUNT_IN_SECONDS = 10.0
TUNING_SECONDS = 120.0
JAM_SECONDS = 180.0
JAM_CONFIDENCE = 0.30

# Title of an automatic jam.
JAM_PREFIX = "Jam — "
JAM_UNDATED = "unknown"


def check_decisions(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid decisions, and the rest with ``reason``."""
    typed = F.col("kind").isin("classify", "batch_classify")
    song = F.when(F.col("kind") == "classify", F.col("song_id")).otherwise(F.lit(0).cast("long"))
    marked = decisions.withColumn("reason", F.when(typed, invalid_classification(F.col("content_type"), song)))
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


# --- songs created by decisions and by maintenance -------------------------------------------------

def unique_slugs(rows: DataFrame, base: str, order: str, songs: DataFrame) -> DataFrame:
    """``slug`` for new rows: base, base-1, base-2 ... skipping the slugs taken by songs and by earlier new rows.

    Rows of one base never clash. Bases that differ by a number may (``tema`` twice and ``tema-1``): then the row first
    in ``order`` keeps its slug and the other base has to skip it. Bases that can clash share a stem; of each stem the
    first clash is settled per round, after which all rows before it are as a walk in order would leave them.
    """
    lost = None
    while True:
        out = cut_lineage(_numbered_slugs(rows, base, order, songs, lost))
        first = out.groupBy("slug").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        losers = out.join(first, "slug").filter(F.col(order) > F.col("_first")).groupBy(
            F.regexp_replace(F.col(base), r"(-[1-9]\d*)+$", "").alias("_stem")
        ).agg(F.min_by(F.struct(F.col(base).alias("_base"), F.col("slug").alias("_slug")), order).alias("_l"))
        found = cut_lineage(losers.select("_l.*"))
        if found.isEmpty():
            return out
        lost = found if lost is None else lost.unionByName(found)


def _numbered_slugs(rows: DataFrame, base: str, order: str, songs: DataFrame, lost: DataFrame | None) -> DataFrame:
    """Rows with ``slug``, each base by itself; ``lost`` has (_base, _slug) that a base must skip besides the songs'.

    Candidates of one base are numbered in ``order``. The numbers taken are read off the existing slugs
    of that base, so the n-th new row gets the n-th free number in one pass. A free number is found by
    counting the taken numbers below it, kept as a running total.
    """
    bases = rows.select(F.col(base).alias("_base")).distinct()
    suffix = F.regexp_extract("slug", r"^(.*?)(?:-([1-9]\d*))?$", 2)
    known = songs.select("slug").filter("slug is not null").distinct()
    plain = known.join(bases, known.slug == bases._base).select("_base", F.lit(0).cast("long").alias("_number"))
    numbered = (
        known.filter(suffix != "")
        .select(F.regexp_replace("slug", r"-[1-9]\d*$", "").alias("_base"), suffix.try_cast("long").alias("_number"))
        .filter("_number is not null").join(bases, "_base", "left_semi")
    )
    taken = plain.unionByName(numbered)
    if lost is not None:
        number = F.substring_index("_slug", "-", -1).try_cast("long")
        taken = taken.unionByName(lost.select("_base", F.when(F.col("_slug") == F.col("_base"), 0).otherwise(number).cast("long").alias("_number")))
    taken = taken.distinct()
    # The i-th taken number t (from 0) leaves t - i free numbers below it.
    gaps = running_total(taken, ["_base"], "_number", "_number", F.lit(1), DECISION_CHUNK, "_i").select(
        "_base", (F.col("_number") - F.col("_i") + 1).alias("_free_below")
    )
    # Free numbers used by new rows: new row j (from 0) gets j + number of taken t with t - i <= j.
    fresh = running_total(
        rows.withColumn("_base", F.col(base)), ["_base"], order, order, F.lit(1), DECISION_CHUNK, "_j"
    ).withColumn("_j", F.col("_j") - 1)
    events = (
        fresh.select("_base", F.col("_j").alias("_at"), F.lit(1).alias("_new"))
        .unionByName(gaps.select("_base", F.col("_free_below").alias("_at"), F.lit(0).alias("_new")))
        .groupBy("_base", "_at").agg(F.sum("_new").alias("_new"), F.sum(1 - F.col("_new")).alias("_taken"))
    )
    counted = running_total(events, ["_base"], "_at", "_at", F.col("_taken"), DECISION_CHUNK, "_skip")
    skips = counted.filter("_new > 0").select("_base", F.col("_at").alias("_j"), "_skip")
    number = F.col("_j") + F.col("_skip")
    return (
        fresh.join(skips, ["_base", "_j"])
        .withColumn("slug", F.when(number == 0, F.col("_base")).otherwise(
            F.concat("_base", F.lit("-"), number.cast("string"))))
        .drop("_base", "_j", "_skip")
    )


def jam_titles(rows: DataFrame, date: str, order: str, songs: DataFrame) -> DataFrame:
    """``title`` of new jams: ``Jam — date``, then ``#2``, ``#3`` ... counting titles that start alike."""
    base = F.concat(F.lit(JAM_PREFIX), F.coalesce(F.col(date), F.lit(JAM_UNDATED)))
    titled = rows.withColumn("_base", base).withColumn("_low", F.lower(base))
    lengths = cut_lineage(titled.select("_low").distinct())
    jams = songs.filter("song_type = 'jam'").select(F.lower("title").alias("_title"))
    # A title starts with a base exactly when its prefix of that base's length equals it; base lengths
    # are few, so the prefix test is an equi-join.
    sizes = lengths.agg(F.array_sort(F.collect_set(F.length("_low")))).scalar()
    prefixes = jams.select("_title", F.explode(sizes).alias("_size")).filter(F.length("_title") >= F.col("_size")).select(
        F.expr("substring(_title, 1, _size)").alias("_low"))
    existing = prefixes.join(lengths, "_low", "left_semi").groupBy("_low").agg(F.count(F.lit(1)).alias("_had"))
    numbered = running_total(titled, ["_low"], order, order, F.lit(1), DECISION_CHUNK, "_j")
    count = F.coalesce("_had", F.lit(0)) + F.col("_j")
    return (
        numbered.join(existing, "_low", "left")
        .withColumn("title", F.when(count == 1, F.col("_base")).otherwise(
            F.concat("_base", F.lit(" #"), count.cast("string"))))
        .drop("_base", "_low", "_j", "_had")
    )


def create_songs(requests: DataFrame, songs: DataFrame, order: str = "seq") -> DataFrame:
    """Songs to add for requested titles; run ``match_songs`` again on the result."""
    slugged = unique_slugs(cut_lineage(requests).withColumn("_slug", slugify(F.col("title"))), "_slug", order, songs)
    return dense_ids(slugged, order, songs).select("id", "title", "slug", "song_type")


def create_jams(rows: DataFrame, songs: DataFrame, date: str, order: str) -> DataFrame:
    """A new jam song for each row, with title and slug; keeps the row's columns."""
    # Few rows, read several times by every step.
    titled = cut_lineage(jam_titles(cut_lineage(rows), date, order, songs))
    slugged = unique_slugs(titled.withColumn("_slug", slugify(F.col("title"))), "_slug", order, songs)  # a checkpoint already
    return dense_ids(slugged, order, songs).withColumn("song_type", F.lit("jam")).drop("_slug")


def unnamed_jams(recordings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Jam recordings without a song, with their session date."""
    ses = sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date"))
    return (
        recordings.filter("content_type = 'jam' and song_id is null").join(ses, "session_id", "left")
        .select(F.col("id").alias("recording_id"), "session_date")
    )


def link_titles(recordings: DataFrame, songs: DataFrame, song_type: str = "original") -> tuple[DataFrame, DataFrame]:
    """Songs for whole recordings that have a title but no song.

    Equal slugs share one song; the first title in order names it. Returns the new songs and the
    (recording_id, song_id) links.
    """
    loose = recordings.filter("song_id is null and origin = 'pretrimmed' and title is not null").select(
        F.col("id").alias("recording_id"), "title", slugify_folded(F.col("title")).alias("slug")
    )
    fresh = (
        loose.join(songs.select("slug"), "slug", "left_anti")
        .groupBy("slug").agg(F.min("title").alias("title"))
        .withColumn("song_type", F.lit(song_type))
    )
    created = dense_ids(fresh, "slug", songs).select("id", "title", "slug", "song_type")
    pool = songs.select(F.col("id").alias("song_id"), "slug").unionByName(created.select(F.col("id").alias("song_id"), "slug"))
    return created, loose.join(pool, "slug").select("recording_id", "song_id")


# --- decisions -------------------------------------------------------------------------------------

def _last(decisions: DataFrame, when: Column, cols: list[str], out: str) -> Column:
    return F.max_by(F.struct("seq", *cols), F.when(when, F.col("seq"))).alias(out)


def _with(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``other`` where the key is known. Rows without a key skip the join: as one null key most
    decisions would meet in one task."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name != key]
    joined = rows.filter(F.col(key).isNotNull()).join(other, key, "left")
    return joined.unionByName(rows.filter(F.col(key).isNull()).select("*", *none))


def resolve(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Valid decisions with the recording and song of their candidate; those on unknown candidates drop out.

    What follows from decisions takes them resolved or not: resolve a batch once and store it where several tables change.
    """
    if "candidate_song" in decisions.columns:
        return decisions
    decisions, _ = check_decisions(decisions)
    picked = candidates.select(
        F.col("id").alias("candidate_id"), F.col("recording_id").alias("_owner"), F.col("song_id").alias("candidate_song")
    )
    on_candidate = F.col("kind").isin("accept", "reject")
    joined = _with(decisions, picked, "candidate_id").filter(~on_candidate | F.col("_owner").isNotNull())
    return joined.withColumn(
        "recording_id", F.when(on_candidate, F.col("_owner")).otherwise(F.col("recording_id"))
    ).drop("_owner")


def decision_jams(decisions: DataFrame, recordings: DataFrame, candidates: DataFrame) -> DataFrame:
    """Classify-as-jam decisions that find their recording without a song, so create one.

    The song before a decision is the one set last before it (by a decision or the table). Returns seq
    and recording_id.
    """
    decisions = resolve(decisions, candidates)
    setters = F.col("kind").isin("assign", "unassign", "accept", "revert") | (
        (F.col("kind") == "classify") & (F.col("content_type") == "song_take")
    )
    jam = (F.col("kind") == "classify") & (F.col("content_type") == "jam")
    sets_song = F.col("kind").isin("assign", "accept", "classify") & setters
    start = recordings.join(
        decisions.filter(jam).select(F.col("recording_id").alias("id")).distinct(), "id", "left_semi"
    ).select(
        F.lit(-1).cast("long").alias("seq"), F.col("id").alias("recording_id"),
        F.col("song_id").isNotNull().alias("_has"), F.lit(False).alias("_jam"),
    )
    steps = decisions.filter(setters | jam).select(
        "seq", "recording_id", F.when(setters, sets_song).when(jam, True).alias("_has"), jam.alias("_jam")
    )
    # Carrying forward reads its input four times; the joins behind it run once.
    rows = cut_lineage(steps.join(start.select("recording_id"), "recording_id", "left_semi").unionByName(start))
    # A jam decision always leaves a song behind; before it, look at the row in front.
    ranked = carry_forward(rows.withColumn("_order", F.col("seq") * 2 + 1).unionByName(
        rows.filter("_jam").withColumn("_has", F.lit(None).cast("boolean")).withColumn("_order", F.col("seq") * 2)
    ), ["recording_id"], "_order", "seq", F.col("_has"), DECISION_CHUNK, "_state")
    return ranked.filter("_jam and _has is null and not _state").select("seq", "recording_id")


def apply_to_recordings(
    recordings: DataFrame, decisions: DataFrame, candidates: DataFrame, jam_songs: DataFrame, songs: DataFrame | None = None
) -> DataFrame:
    """Recordings after all decisions, applied in ``seq`` order.

    Every decision but two sets its fields outright, so the last one counts: one aggregate per
    recording and one join. ``unassign`` clears the type only if it is song_take at that moment, and a
    jam gets a song only if it has none; both look at the last outright setter. ``jam_songs`` has seq,
    recording_id and the new song's id (from ``decision_jams`` and ``create_jams``).

    With ``songs`` (id, slug) a recording's file is named by its id and song as soon as a decision gives it a song that exists; it
    keeps that name when the song is taken away.
    """
    new = jam_songs.select("seq", F.col("id").alias("_jam_song"))
    kind = F.col("kind")
    known = (
        resolve(decisions, candidates)
        .filter(kind.isin("classify", "batch_classify", "assign", "unassign", "accept", "revert"))
        .join(new, "seq", "left")
        .withColumn("_type", F.when(kind.isin("assign", "accept"), "song_take").when(kind != "revert", F.col("content_type")))
        .withColumn("_song", F.when(kind == "accept", F.col("candidate_song"))
                    .when(kind == "assign", F.col("song_id"))
                    .when((kind == "classify") & (F.col("content_type") == "song_take"), F.col("song_id"))
                    .when(kind == "classify", F.col("_jam_song")))
    )
    if songs is not None:
        every = songs.select("id", "slug").unionByName(jam_songs.select("id", "slug"))
        known = _with(known, every.select(F.col("id").alias("_song"), F.col("slug").alias("_slug")), "_song")
    else:
        known = known.withColumn("_slug", F.lit(None).cast("string"))
    sets_type = kind != "unassign"
    sets_song = (
        kind.isin("assign", "accept", "unassign", "revert")
        | ((kind == "classify") & (F.col("content_type") == "song_take")) | F.col("_jam_song").isNotNull()
    )
    folded = known.groupBy(F.col("recording_id").alias("id")).agg(
        _last(known, sets_type, ["kind", "_type"], "_t"),
        _last(known, sets_song, ["_song"], "_s"),
        F.max(F.when(kind == "unassign", F.col("seq"))).alias("_unassigned"),
        F.max_by("_slug", F.when(F.col("_slug").isNotNull(), F.col("seq"))).alias("_named"),
    )
    joined = recordings.join(folded, "id", "left")
    typed = F.col("_t.seq").isNotNull()
    base_type = F.when(typed, F.col("_t._type")).otherwise(F.col("content_type"))
    base_source = F.when(typed, F.when(F.col("_t.kind") != "revert", "human")).otherwise(F.col("content_type_source"))
    cleared = F.coalesce(
        (F.col("_unassigned") > F.coalesce("_t.seq", F.lit(-1))) & (base_type == "song_take"), F.lit(False)
    )
    return joined.select(*[
        (F.when(~cleared, base_type).alias(c) if c == "content_type"
         else F.when(~cleared, base_source).alias(c) if c == "content_type_source"
         else F.when(F.col("_s.seq").isNotNull(), F.col("_s._song")).otherwise(F.col(c)).alias(c) if c == "song_id"
         else F.when(F.col("_named").isNotNull(), renamed_file(F.col(c), F.col("id"), F.col("_named"))).otherwise(F.col(c)).alias(c) if c == "audio_path"
         else F.col(c))
        for c in recordings.columns
    ])


def apply_to_candidates(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidate statuses after all decisions, applied in ``seq`` order.

    Accept, unassign and revert set every candidate of a recording, reject sets one; of these only the
    last counts. An assignment settles what is still pending, so only the first one after that counts.
    Decisions are reduced to one row per recording (and per rejected candidate) before the join.
    """
    kind = F.col("kind")
    owned = resolve(decisions, candidates)
    resets = owned.filter(kind.isin("accept", "unassign", "revert")).groupBy("recording_id").agg(
        F.max_by(F.struct("seq", "kind", "candidate_id", "at"), "seq").alias("_reset")
    )
    rejects = owned.filter(kind == "reject").groupBy(F.col("candidate_id").alias("id")).agg(
        F.max_by(F.struct("seq", "at"), "seq").alias("_reject")
    )
    assigns = (
        owned.filter(kind == "assign").join(resets.select("recording_id", F.col("_reset.seq").alias("_since")), "recording_id", "left")
        .filter(F.col("seq") > F.coalesce("_since", F.lit(-1)))
        .groupBy("recording_id").agg(F.min_by(F.struct("seq", "song_id", "at"), "seq").alias("_assign"))
    )
    joined = (
        candidates.join(resets, "recording_id", "left").join(rejects, "id", "left").join(assigns, "recording_id", "left")
    )
    rejected_last = F.col("_reject.seq") > F.coalesce("_reset.seq", F.lit(-1))
    # A reject before the first assignment stands; a later one overrides it. Either way: rejected.
    reset_status = F.when(
        F.col("_reset.kind") == "accept",
        F.when(F.col("_reset.candidate_id") == F.col("id"), "accepted").otherwise("rejected"),
    ).otherwise("pending")
    reset_at = F.when(F.col("_reset.kind") != "unassign", F.col("_reset.at"))
    was = F.col("_reset.seq").isNotNull()
    status = F.when(rejected_last, "rejected").when(was, reset_status).otherwise(F.col("status"))
    at = F.when(rejected_last, F.col("_reject.at")).when(was, reset_at).otherwise(F.col("reviewed_at"))
    settled = (status == "pending") & F.col("_assign.seq").isNotNull()
    after = F.when(F.col("song_id") == F.col("_assign.song_id"), "accepted").otherwise("rejected")
    return joined.withColumn("_status", F.when(settled, after).otherwise(status)).withColumn(
        "_at", F.when(settled, F.col("_assign.at")).otherwise(at)
    ).select(*[
        F.col("_status").alias(c) if c == "status" else F.col("_at").alias(c) if c == "reviewed_at" else F.col(c)
        for c in candidates.columns
    ])


def remaining_candidates(candidates: DataFrame, decisions: DataFrame, songs: DataFrame) -> DataFrame:
    """The answer to rejections: what is left of the candidates of each recording one was rejected of, with titles.

    ``candidates`` are those after the decisions (``apply_to_candidates``).
    """
    rejected = decisions.filter("kind = 'reject'").select(F.col("candidate_id").alias("id")).distinct()
    asked = candidates.join(rejected, "id", "left_semi").select("recording_id").distinct()
    titles = songs.select(F.col("id").alias("song_id"), F.col("title").alias("song_title"))
    left = candidates.filter("status <> 'rejected'").join(asked, "recording_id", "left_semi")
    return left.join(titles, "song_id", "left").select(*candidates.columns, "song_title")


def batch_classified(decisions: DataFrame, recordings: DataFrame) -> DataFrame:
    """Number of recordings that exist, of those listed with a valid type."""
    ids = check_decisions(decisions)[0].filter("kind = 'batch_classify'").select(F.col("recording_id").alias("id"))
    return ids.join(recordings.select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("updated"))


def split_plan(recordings: DataFrame, segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """The real cut of each split decision (first per recording), or the reason it is refused."""
    asked = decisions.filter("kind = 'split'").groupBy("recording_id").agg(
        F.min_by(F.struct("split_at", "at"), "seq").alias("_ask")
    ).select("recording_id", "_ask.split_at", "_ask.at")
    cut = nearest_start(segments, asked)
    rec = recordings.select(F.col("id").alias("recording_id"), "audio_path", F.coalesce("duration_seconds", F.lit(0.0)).alias("_d"))
    return cut.join(rec, "recording_id").withColumn(
        "error",
        F.when(F.col("audio_path").isNull(), "no audio")
        .when(F.col("nearest").isNull(), "no segments")
        .when((F.col("nearest") <= 1.0) | (F.col("nearest") >= F.col("_d") - 1.0), "too close to an end"),
    ).select("recording_id", F.col("nearest").alias("cut"), "at", "error")


def split_recordings(
    recordings: DataFrame, segments: DataFrame, series: DataFrame, log: DataFrame, candidates: DataFrame, plan: DataFrame
) -> dict[str, DataFrame]:
    """All tables after the splits of ``plan``; must come last in a batch.

    Ids are new: part A of the k-th split is max + 2k - 1, part B max + 2k. Segments and series move to
    their part, B is shifted to start at 0, song, title, type and candidates are lost, and steps ingest,
    librosa and clap count as done.
    """
    good = cut_lineage(plan.filter("error is null").select("recording_id", "cut", "at"))
    numbered = dense_ids(good, "recording_id", recordings.limit(0)).withColumnRenamed("id", "_k")
    top = recordings.agg(F.max("id")).scalar()
    parts = numbered.withColumn("_part", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "_new", top + F.col("_k") * 2 - 1 + F.col("_part")
    ).drop("_k")
    a = F.col("_part") == 0
    begin = F.coalesce("start_offset_seconds", F.lit(0.0))
    length = F.coalesce("duration_seconds", F.lit(0.0))
    children = recordings.join(parts, recordings.id == parts.recording_id).select(*[
        {
            "id": F.col("_new"),
            "start_offset_seconds": F.when(a, begin).otherwise(begin + F.col("cut")),
            "end_offset_seconds": F.when(a, begin + F.col("cut")).otherwise(
                F.coalesce(F.nullif("end_offset_seconds", F.lit(0.0)), begin + length)),
            "duration_seconds": F.when(a, F.col("cut")).otherwise(length - F.col("cut")),
            "audio_path": F.concat(
                F.regexp_replace("audio_path", r"[^/]*$", ""), F.col("_new").cast("string"),
                F.when(a, "_split_a.mp3").otherwise("_split_b.mp3")),
            "song_id": F.lit(None), "title": F.lit(None), "content_type": F.lit(None), "content_type_source": F.lit(None),
        }.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in recordings.schema
    ])
    side = parts.withColumnRenamed("recording_id", "_old")
    gone = good.select("recording_id")

    def kept(df: DataFrame, key: str = "recording_id") -> DataFrame:
        return df.join(gone.withColumnRenamed("recording_id", key), key, "left_anti").select(df.columns)

    shift = F.when(a, F.lit(0.0)).otherwise(F.col("cut"))
    owner = (segments.recording_id == side._old) & ((segments.start_seconds < side.cut) == (side._part == 0))
    moved = segments.join(side, owner).select(*[
        F.col("_new").alias(c) if c == "recording_id"
        else (F.col(c) - shift).alias(c) if c in ("start_seconds", "end_seconds") else F.col(c)
        for c in segments.columns
    ])
    head, tail = series_cut(F.col("values"), F.col("cut"))
    cut_series = series.join(side, series.recording_id == side._old).select(*[
        F.col("_new").alias(c) if c == "recording_id" else F.when(a, head).otherwise(tail).alias(c) if c == "values" else F.col(c)
        for c in series.columns
    ])
    # The steps a split part counts as having passed, and their version.
    steps = F.array(F.lit("ingest"), F.lit("librosa"), F.lit("clap"))
    entries = parts.select(
        F.col("_new").alias("recording_id"), F.explode(steps).alias("step"), F.lit("1").alias("version"),
        F.col("at").alias("completed_at"), F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_message"),
    )
    return {
        "recordings": kept(recordings, "id").unionByName(children),
        "segments": kept(segments).unionByName(moved),
        "series": kept(series).unionByName(cut_series),
        "processing_log": kept(log).unionByName(entries.select(log.columns)),
        "candidates": kept(candidates),
    }


# --- maintenance -----------------------------------------------------------------------------------

def backfill_content_type(recordings: DataFrame, songs: DataFrame) -> DataFrame:
    """Type of whole recordings from their song; ``outcome`` tells what happened to each."""
    song = songs.select(F.col("id").alias("song_id"), "song_type")
    rows = recordings.filter("origin = 'pretrimmed'").join(song, "song_id", "left")
    new = F.when(F.col("song_type").isin("original", "cover"), "song_take").when(F.col("song_type") == "jam", "jam")
    return rows.withColumn("new_type", F.when(F.col("content_type").isNull(), new)).withColumn(
        "outcome",
        F.when(F.col("content_type").isNotNull(), "already_set").when(F.col("new_type").isNull(), "no_song").otherwise("updated"),
    ).withColumn("content_type_source", F.when(F.col("outcome") == "updated", "ingest").otherwise(F.col("content_type_source"))
    ).withColumn("content_type", F.coalesce("content_type", "new_type")).drop("new_type", "song_type")


def backfill_duration(recordings: DataFrame, probes: DataFrame) -> DataFrame:
    """Fill missing durations from a table (audio_path, seconds)."""
    found = probes.select("audio_path", F.col("seconds").alias("_s"))
    rows = recordings.join(found, "audio_path", "left")
    return rows.withColumn(
        "outcome",
        F.when(F.col("duration_seconds").isNotNull(), "kept").when(F.col("_s").isNull(), "skipped").otherwise("updated"),
    ).withColumn("duration_seconds", F.coalesce("duration_seconds", F.round("_s", 3))).drop("_s")


def auto_classify(recordings: DataFrame, candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """A suggested type for recordings nobody has decided on, by level, length and confidence."""
    scope = recordings.filter("song_id is null and (content_type is null or content_type_source = 'auto')")
    rows = best_confidence(scope, candidates).join(
        recording_levels(segments).withColumnRenamed("recording_id", "id"), "id", "left"
    )
    d = F.coalesce("duration_seconds", F.lit(0.0))
    rms, var, conf = F.col("mean_rms"), F.col("rms_variance"), F.col("best_confidence")
    suggestion = (
        F.when(d < COUNT_IN_SECONDS, "count_in")
        .when(rms < SILENCE_RMS, "silence")
        .when((d < TUNING_SECONDS) & (rms < INTERSTITIAL_RMS) & (var < LEVEL_VARIANCE), "tuning")
        .when((d > JAM_SECONDS) & (rms > MUSICAL_RMS) & (conf < JAM_CONFIDENCE), "jam")
    )
    return rows.withColumn("suggestion", F.when(conf <= HIGH_CONFIDENCE, suggestion)).withColumn(
        "outcome",
        F.when(conf > HIGH_CONFIDENCE, "skipped_high_conf").when(F.col("suggestion").isNull(), "left_null")
        .otherwise(F.col("suggestion")),
    ).withColumn("content_type_source", F.when(F.col("suggestion").isNotNull(), "auto").otherwise(F.col("content_type_source"))
    ).withColumn("content_type", F.coalesce("suggestion", "content_type"))


def write_series(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Series by (recording, feature); fresh ones replace stored ones."""
    both = stored.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    return latest(both, ["recording_id", "feature_name"], ["_age"]).drop("_age")


def write_segment_stats(segments: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """Segment columns replaced where new statistics exist for the id."""
    new = stats.select(F.col("segment_id").alias("id"), F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = segments.join(new, "id", "left")
    return joined.select(*[
        F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
        for c in segments.columns
    ])


def log_entries(results: DataFrame, step: str, version: str, at: Column) -> DataFrame:
    """Log rows to append: success, skipped or failed with the message.

    ``results`` has recording_id, error and skipped.
    """
    return results.select(
        "recording_id", F.lit(step).alias("step"), F.lit(version).alias("version"), at.alias("completed_at"),
        F.when(F.col("error").isNotNull(), "failed").when(F.col("skipped"), "skipped").otherwise("success").alias("status"),
        F.col("error").alias("error_message"),
    )


def tier_paths(tiers: DataFrame, wanted: list[int]) -> DataFrame:
    """The prefixes of some tiers, from a table of tier and prefix."""
    return tiers.filter(F.col("tier").isin(wanted)).select("prefix").distinct()


def under_paths(recordings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Recordings one of whose source paths equals a prefix or lies below it.

    Every path gives its own name and the folders above it, so that the test is an equi-join and the plan is the
    same for ten prefixes or ten thousand.
    """
    wanted = prefixes.select(F.inline(prefix_keys(F.col("prefix")))).distinct()
    keys = recordings.select("id", F.inline(path_keys(F.col("source_path"))))
    return recordings.join(keys.join(wanted, ["kind", "key"], "left_semi").select("id"), "id", "left_semi")


def step_scope(
    recordings: DataFrame, log: DataFrame, step: str, version: str, prefixes: DataFrame | None = None
) -> DataFrame:
    """What a run of a step would do: recordings not done yet, in the wanted folders, with the
    reason where one cannot be processed."""
    # Reasons and folders are found where the rows lie: paths do not have to move to the joins by id.
    scope = recordings.withColumn("error", ineligible(F.col("audio_path"), F.col("duration_seconds")))
    if prefixes is not None:
        scope = under_paths(scope, prefixes)
    return needs_processing(scope, log, step, version)


def run_step(
    recordings: DataFrame, log: DataFrame, step: str, version: str, at: Column,
    work: Callable[[DataFrame], DataFrame], prefixes: DataFrame | None = None, dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Results of a step and the log rows to append.

    ``work`` takes the eligible recordings and returns rows with recording_id and error (null when the
    recording succeeded). One failing recording does not stop the others. A dry run returns the scope only.
    """
    scope = step_scope(recordings, log, step, version, prefixes)
    if dry_run:
        return scope, log.limit(0)
    done = work(scope.filter("error is null").drop("error"))
    outcome = done.groupBy("recording_id").agg(F.max("error").alias("error")).withColumn("skipped", F.lit(False))
    barred = scope.filter("error is not null").select(
        F.col("id").alias("recording_id"), "error", F.lit(False).alias("skipped")
    )
    return done, log_entries(outcome.unionByName(barred), step, version, at)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Report of a dry run: rows that would be added, removed or changed."""
    cols = [c for c in before.columns if c != key]
    b = before.select(key, F.struct(*cols).alias("_before"))
    a = after.select(key, F.struct(*cols).alias("_after"))
    change = (
        F.when(F.col("_before").isNull(), "added").when(F.col("_after").isNull(), "removed")
        .when(~F.col("_before").eqNullSafe(F.col("_after")), "changed")
    )
    return b.join(a, key, "full").withColumn("change", change).filter("change is not null").select(key, "change")
