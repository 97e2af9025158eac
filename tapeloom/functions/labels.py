"""Column expressions that classify and format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.schemas import CONTENT_TYPES, NON_MUSICAL_TYPES, SONG_TYPES


def effective_type(content_type: Column, song_type: Column) -> Column:
    """What a listener would call the recording."""
    return (
        F.when(content_type == "song_take", F.coalesce(song_type, F.lit("unreviewed")))
        .when(content_type == "jam", "jam")
        .when(content_type.isin(NON_MUSICAL_TYPES), "non-musical")
        .otherwise("unreviewed")
    )


def invalid_classification(content_type: Column, song_id: Column) -> Column:
    """Reason to reject a content type, or null."""
    return F.when(~content_type.isin(CONTENT_TYPES) | content_type.isNull(), "invalid content_type").when(
        (content_type == "song_take") & song_id.isNull(), "song_take needs song_id"
    )


def invalid_song_type(song_type: Column) -> Column:
    """Reason to reject a song type, or null."""
    return F.when(~song_type.isin(SONG_TYPES) | song_type.isNull(), "invalid song_type")


def ineligible(audio_path: Column, duration: Column) -> Column:
    """Reason a recording cannot be processed, or null."""
    return F.when(audio_path.isNull(), "no audio_path").when(duration.isNull(), "no duration_seconds")


def level_label(pct: Column, low: str, mid: str, high: str) -> Column:
    """Word for a 0-100 level; empty when unknown."""
    return F.when(pct >= 67, high).when(pct <= 33, low).when(pct.isNull(), "").otherwise(mid)


def decibels(rms: Column) -> Column:
    """Level in dB with one decimal, ``N/A`` for silence or no value."""
    return F.when(rms > 0, F.format_string("%.1f dB", 20 * F.log10(rms))).otherwise("N/A")


def percent(part: Column, total: Column) -> Column:
    """Whole percent, 0 of nothing."""
    return F.when(total > 0, F.floor(part / total * 100 + 0.5).cast("long")).otherwise(F.lit(0).cast("long"))


def settled(c: Column, digits: int) -> Column:
    """Round half up after dropping float noise, so that the result does not depend on summation order."""
    return F.round(F.round(c, 12), digits)
