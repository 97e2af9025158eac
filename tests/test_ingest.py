"""Golden rows for names, paths and ingest."""

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import labels as L
from tapeloom.functions import text as T
from tapeloom.operators import lookups as J
from tapeloom.sources import inventory as I


def one(spark, fn, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return row.select(fn(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).head().x


@pytest.mark.parametrize("fn,value,want", [
    (T.old_folder_date, "12%3a12 - 7 Desembre", "2012-12-07"),
    (T.old_folder_date, "01:09 - 13 Març", "2009-03-13"),
    (T.old_folder_date, "12%3a12 - 7 December", None),
    (T.take_date, "Song_2015-06-12.WAV-split-12.mp3", "2015-06-12"),
    (T.take_date, "Song_Demo.mp3", None),
    (T.take_date, "Song_2015-06-12b.mp3", None),
    (T.iso_date, "2016-09-22 ft guest", "2016-09-22"),
    (T.humanize, "don't-stop__3am%3f", "Don'T Stop 3Am?"),
    (T.url_decode, "a+b%20c%zz", "a+b c%zz"),
    (T.build_label, "Cançó d'ús (v2)  final", "Canco-d-us-v2-final"),
    (T.slugify, "Cançó 2!", "can-2"),
    (T.slugify_folded, "Cançó 2!", "canco-2"),
    (T.file_stem, "a.WAV-split-12.mp3", "a.WAV-split-12"),
])
def test_text(spark, fn, value, want):
    assert one(spark, fn, value) == want


def test_text_numbers(spark):
    assert one(spark, T.timecode, 3735.9) == "1h02m15s"
    assert one(spark, T.clock, 125.7) == "2:05"
    assert one(spark, L.decibels, 0.0) == "N/A"
    assert one(spark, L.decibels, 0.1) == "-20.0 dB"
    assert one(spark, lambda c: L.level_label(c, "a", "b", "c"), 33.0) == "a"
    assert one(spark, lambda a, b: T.build_label(a, b), "x" * 99, "yyy") == "x" * 99 + "_"


PATHS = [
    "Assajos/2016-09-22/ZOOM0010_LR.WAV", "Assajos/2016-09-22/ZOOM0010.hprj", "Assajos/2016-09-22/ZOOM0010_Tr1.WAV",
    "Assajos/2013-11-16.wav", "Assajos/2017-01-01 ft guest/deep/er/ZOOM1_LR.wav", "Assajos/nodate/ZOOM_LR.wav",
    "Jams/2018-09-16/Liquid.wav", "Jams/2015-01-01/x.mp3", "Jams/2013-11-16/y%3f.mp3", "Jams/2013-11-16/deep/z.mp3",
    "Temas/Lady-Monas/Lady-Monas_2013-11-16.mp3", "Temas/Lady-Monas/Lady-Monas_Demo.mp3", "Covers/Take-On/Take-On_2014-02-03.m4a",
    "Old/12%3a12 - 7 Desembre/Tema%20u.mp3", "Old/12%3a12 - 7 Nope/t.mp3", "Other/2013-11-16/a.mp3",
]


@pytest.fixture(scope="module")
def items(spark):
    return I.classify_sections(spark.createDataFrame([(p, 1) for p in PATHS], "path string, length long")).cache()


def test_sections(items):
    got = {r.path: r for r in items.collect()}
    assert set(got) == {PATHS[i] for i in (0, 3, 4, 6, 7, 8, 10, 11, 12, 13)}
    assert got[PATHS[4]].notes == "ft guest" and got[PATHS[4]].date == "2017-01-01" and got[PATHS[4]].origin == "raw"
    assert got[PATHS[7]].date_uncertain and not got[PATHS[6]].date_uncertain
    assert (got[PATHS[8]].song_slug, got[PATHS[8]].title, got[PATHS[8]].song_type) == ("y?", "Y?", "jam")
    assert got[PATHS[11]].date is None and got[PATHS[11]].title == "Lady Monas"
    assert (got[PATHS[13]].date, got[PATHS[13]].title, got[PATHS[13]].song_slug) == ("2012-12-07", "Tema u", None)


def test_one_session_for_two_sections(spark, items):
    none = spark.createDataFrame([], "id long, date string")
    new = J.get_or_create_sessions(items, none).collect()
    assert len({r.id for r in new}) == len(new) == len({r.date for r in new})
    assert sum(r.date == "2013-11-16" for r in new) == 1


def test_first_item_of_a_slug_wins(spark, items):
    songs = spark.createDataFrame([(7, "take-on")], "id long, slug string")
    new = {r.slug: r for r in J.get_or_create_songs(items, songs).collect()}
    assert "take-on" not in new or new["take-on"].id > 7
    assert new["Lady-Monas"].song_type == "original" and all(r.id > 7 for r in new.values())


def test_parts(spark):
    files = spark.createDataFrame([("a/ZOOM0013_LR-0001.WAV",), ("a/ZOOM0013_LR-0002.WAV",), ("a/ZOOM0013_LR.WAV",)], "path string")
    got = I.split_file_groups(files).orderBy("part").collect()
    assert [(r.group, r.part, r.parts) for r in got] == [("a/ZOOM0013_LR.WAV", 1, 2), ("a/ZOOM0013_LR.WAV", 2, 2)]


def test_list_files_reads_no_contents(spark, tmp_path):
    (tmp_path / "Jams" / "2018-09-16").mkdir(parents=True)
    (tmp_path / "Jams" / "2018-09-16" / "Liquid.wav").write_bytes(b"12345")
    (tmp_path / "Jams" / "2018-09-16" / "note.txt").write_bytes(b"1")
    got = I.scan_paths(I.list_files(spark, str(tmp_path))).collect()
    assert [(r.path, r.length) for r in got] == [("Jams/2018-09-16/Liquid.wav", 5)]
