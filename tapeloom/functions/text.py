"""Column expressions over names, paths, titles and times."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they appear in the folder names of the oldest section.
MONTHS = {
    "gener": 1, "febrer": 2, "març": 3, "abril": 4, "maig": 5, "juny": 6,
    "juliol": 7, "agost": 8, "setembre": 9, "octubre": 10, "novembre": 11, "desembre": 12,
}

# Vowels folded by the accent-aware slug.
SLUG_FOLDS = {"a": "àáâãäå", "e": "èéêë", "i": "ìíîï", "o": "òóôõö", "u": "ùúûü", "c": "ç"}

# Date and folder patterns.
ISO_DATE = r"(\d{4}-\d{2}-\d{2})"
TAKE_DATE = r"_(\d{4}-\d{2}-\d{2})(?:\.|$)"
OLD_FOLDER = r"(?iU)^(\d{2})(?:%3a|:)(\d{2})\s*-\s*(\d+)\s+(\w+)"

LABEL_LIMIT = 100


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once per row however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def url_decode(c: Column) -> Column:
    """Percent-decoding that leaves ``+`` and malformed escapes as they are."""
    stray = F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(F.replace(stray, F.lit("+"), F.lit("%2B"))), c)


def iso_date(c: Column) -> Column:
    """First ISO date inside a name."""
    return _found(c, ISO_DATE)


def take_date(c: Column) -> Column:
    """Date of a dated take, ``_YYYY-MM-DD`` before a dot or the end."""
    return _found(c, TAKE_DATE)


def old_folder_date(c: Column) -> Column:
    """Date of a folder named ``MM:YY - DD Month``; the month name wins over MM."""
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])

    def read(name: Column) -> Column:
        month = F.element_at(months, F.lower(F.regexp_extract(name, OLD_FOLDER, 4)))
        day = F.regexp_extract(name, OLD_FOLDER, 3).try_cast("int")
        return F.when(
            month.isNotNull(), F.format_string("20%s-%02d-%02d", F.regexp_extract(name, OLD_FOLDER, 2), month, day)
        )

    return bind(url_decode(c), read)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter, lower case after a letter (so ``3am`` becomes ``3Am``)."""
    def turn(chars: Column) -> Column:
        return F.array_join(F.transform(
            chars,
            lambda ch, i: F.when((i > 0) & F.get(chars, i - 1).rlike(r"\p{L}"), F.lower(ch)).otherwise(F.upper(ch)),
        ), "")

    return bind(F.split(c, ""), turn)


def humanize(c: Column) -> Column:
    """Readable title of a slug."""
    return title_case(F.regexp_replace(url_decode(c), "[-_]+", " "))


def timecode(seconds: Column) -> Column:
    """P5: ``0h02m15s`` of whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def clock(seconds: Column) -> Column:
    """``m:ss``."""
    return F.format_string(
        "%d:%02d", F.floor(seconds / 60), F.floor(seconds - F.floor(seconds / 60) * 60)
    )


def session_year(date: Column) -> Column:
    """Year of a session date string."""
    return F.substring(date, 1, 4).try_cast("int")


def _accent_pairs() -> tuple[str, str]:
    """Latin letters with a canonical decomposition and the ASCII letter each is based on."""
    marked, plain = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base.isascii():
            marked.append(chr(point))
            plain.append(base)
    return "".join(marked), "".join(plain)


def to_ascii(c: Column) -> Column:
    """Drop accents, then anything that is still not ASCII."""
    marked, plain = _accent_pairs()
    return F.regexp_replace(F.translate(c, marked, plain), r"[^\x00-\x7F]", "")


def _label_part(c: Column) -> Column:
    safe = F.regexp_replace(to_ascii(c), r"[^A-Za-z0-9_\-]", "-")
    safe = F.regexp_replace(F.regexp_replace(safe, "-{2,}", "-"), "^-+|-+$", "")
    return F.nullif(safe, F.lit(""))


def build_label(*parts: Column) -> Column:
    """File-name-safe label of the non-empty parts."""
    return F.substring(F.concat_ws("_", *[_label_part(p) for p in parts]), 1, LABEL_LIMIT)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(name: Column) -> Column:
    """File name without its last suffix; a leading dot is not a suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def recording_label(
    origin: Column, source_path: Column, start: Column, end: Column,
    song_slug: Column, title: Column, date: Column,
) -> Column:
    """Label of a cut recording (stem and time codes) or of a whole one (song or title and date)."""
    stem = file_stem(file_name(F.get(source_path, 0)))
    span = F.concat(
        timecode(F.coalesce(start, F.lit(0.0))), F.lit("-"), timecode(F.coalesce(end, F.lit(0.0)))
    )
    return F.when(
        (origin == "vad_segment") & (F.size(source_path) > 0), build_label(stem, span)
    ).otherwise(build_label(F.coalesce(F.nullif(song_slug, F.lit("")), title), date))


def output_path(recording_id: Column, label: Column) -> Column:
    """Relative path of the processed file."""
    tail = F.when(label != "", F.concat(F.lit("_"), label)).otherwise("")
    return F.concat(F.lit("recordings/"), recording_id.cast("string"), tail, F.lit(".mp3"))


def renamed_file(audio_path: Column, recording_id: Column, slug: Column) -> Column:
    """The file named by its recording and song, in the folder it lies in; null stays null."""
    return F.concat(F.regexp_replace(audio_path, "[^/]*$", ""), recording_id.cast("string"), F.lit("_"), slug, F.lit(".mp3"))


def is_bare_id(audio_path: Column, recording_id: Column) -> Column:
    """The file is still named by its id alone."""
    return F.coalesce(
        file_name(audio_path) == F.concat(recording_id.cast("string"), F.lit(".mp3")), F.lit(False)
    )


def slugify(title: Column) -> Column:
    """Lower-case ASCII slug; accented letters count as separators."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""
    )


def slugify_folded(title: Column) -> Column:
    """Same after folding accented vowels and ç."""
    source = "".join(SLUG_FOLDS.values())
    target = "".join(plain * len(marked) for plain, marked in SLUG_FOLDS.items())
    return slugify(F.translate(F.lower(title), source, target))


def song_take_title(song_title: Column, date: Column) -> Column:
    """``Song (date)``, or the song alone when the session is undated."""
    dated = F.concat(song_title, F.lit(" ("), F.nullif(date, F.lit("")), F.lit(")"))
    return F.coalesce(dated, song_title)


def audio_url(path: Column, start: Column, end: Column, base: str) -> Column:
    """Media-fragment address of a window; null without audio."""
    return F.when(
        F.coalesce(path, F.lit("")) != "",
        F.concat(F.lit(base.rstrip("/") + "/"), path, F.format_string("#t=%.1f,%.1f", start, end)),
    )


def storage_url(path: Column, backend: str = "local", root: str = "", prefix: str = "") -> Column:
    """Object or file address of a source path for one storage backend."""
    prefix = prefix.strip("/")
    key = F.concat(F.lit(f"{prefix}/" if prefix else ""), path)
    if backend == "s3":
        return F.concat(F.lit(f"https://{quote(root)}.s3.amazonaws.com/"), key)
    if backend == "gcs":
        return F.concat(F.lit(f"https://storage.googleapis.com/{quote(root)}/"), key)
    return F.concat(F.lit(root.rstrip("/") + "/"), path)


def title_contains(title: Column, query: str) -> Column:
    """Case-insensitive substring search."""
    return F.contains(F.lower(title), F.lit(query.lower()))


def path_keys(source_path: Column) -> Column:
    """What a list of prefixes may name of some paths: each path itself (kind 0) and every folder above it (kind 1)."""
    def keys(p: Column) -> Column:
        parts = F.split(p, "/")
        depths = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda n: (n >= 1) & (n < F.size(parts)))
        above = F.transform(depths, lambda n: F.struct(F.lit(1).alias("kind"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("key")))
        return F.array_append(above, F.struct(F.lit(0).alias("kind"), p.alias("key")))

    return F.array_distinct(F.flatten(F.transform(F.filter(source_path, lambda p: p.isNotNull()), keys)))


def prefix_keys(prefix: Column) -> Column:
    """A prefix names the path equal to it and the folder of its name, with or without slashes at the end."""
    return F.array(F.struct(F.lit(0).alias("kind"), prefix.alias("key")),
                   F.struct(F.lit(1).alias("kind"), F.regexp_replace(prefix, "/+$", "").alias("key")))
