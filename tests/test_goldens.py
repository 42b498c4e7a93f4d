"""Fixed input and output pairs."""

import pytest
from pyspark.sql import functions as F

from scorelake import dims, profiles
from scorelake.functions import scalars as s
from scorelake.operators import meta, notes, tracks
from scorelake.sources import catalog
from tests.conftest import rows


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


NOTES = """file_id int, track_idx int, track_name string, channel int, program int, note_idx bigint,
  start_tick bigint, end_tick bigint, pitch int, velocity int"""


@pytest.fixture(scope="module")
def two_notes(spark):
    return spark.createDataFrame(
        [(1, 1, "main_melody", 0, 0, 0, 0, 440, 58, 1), (1, 1, "main_melody", 0, 0, 1, 0, 880, 74, 60)],
        NOTES,
    )


@pytest.mark.parametrize(
    "changes, end, want", [([(0, 120)], 60, 120), ([(0, 100), (60, 120)], 80, 105)]
)
def test_avg_bpm(spark, changes, end, want):
    tempo = spark.createDataFrame(
        [(1, i, t, b) for i, (t, b) in enumerate(changes)],
        "file_id int, seq bigint, time_sec bigint, bpm int",
    )
    ends = spark.createDataFrame([(1, end)], "file_id int, end_sec bigint")
    assert notes.avg_bpm(tempo, ends).first()["avg_bpm"] == want


def test_truncate(spark):
    out = one(
        spark, a=s.truncate_value(F.lit(0.1), 9), b=s.truncate_text(F.lit(0.1), 3),
        c=s.truncate_value(F.lit(0.01), 3), d=s.truncate_text(F.lit(0.01), 3),
        e=s.truncate_text(F.lit(1.29), 1), f=s.truncate_text(F.lit(0.00005), 4),
    )
    assert tuple(out) == (0.1, "0.100", 0.01, "0.010", "1.2", "0.0000")


def test_header_messages(spark):
    out = one(
        spark, bpm=s.tempo_to_bpm(F.lit(500000)), none=s.tempo_to_bpm(F.lit(None).cast("int")),
        key=s.key_text(F.lit("C")), minor=s.key_text(F.lit("F#m")),
        meter=s.meter_text(F.lit(4), F.lit(4)),
    )
    assert tuple(out) == (120, None, "cmajor", "f#minor", "4/4")


def test_pitch_range(spark, two_notes):
    assert meta.pitch_ranges(two_notes).first()["pitch_range"] == "mid_high"
    assert meta.pitch_ranges(two_notes, keyswitch=None).first()["pitch_range"] == "mid"
    assert meta.pitch_ranges(two_notes.where("false")).count() == 0


def test_velocity_range(two_notes):
    columns = ("min_velocity", "max_velocity")
    assert rows(meta.velocity_ranges(two_notes), *columns) == [(60, 60)]
    assert rows(meta.velocity_ranges(two_notes, keyswitch=None), *columns) == [(1, 60)]
    assert rows(meta.velocity_ranges(two_notes.where("false"))) == []


def test_first_program(two_notes):
    assert rows(meta.inst_codes(two_notes), "program", "inst") == [(0, 0)]


def test_genre(spark):
    files = spark.createDataFrame([("BG-000005-c",)], "stem string")
    names = spark.createDataFrame(
        [("BG-000004", "jazz", 0), ("BG-000005", "newage", 1)],
        "name string, genre string, name_order int",
    )
    assert catalog.genre_by_prefix(files, names).first()["genre"] == "newage"
    out = one(
        spark, a=s.genre_from_path(F.lit("/x/jazz/1.mid")), b=s.genre_from_path(F.lit("/x/1.mid"))
    )
    assert tuple(out) == ("jazz", "cinematic")


@pytest.mark.parametrize(
    "channel, want", [(0, "main_melody"), (1, "sub_melody"), (15, "unknown")]
)
def test_track_category(spark, channel, want):
    assert one(spark, c=s.track_category(F.lit(channel)))["c"] == want


def test_last_message(spark):
    events = spark.createDataFrame(
        [(1, 0, 0, "time_signature", 4), (1, 0, 1, "time_signature", 3), (1, 1, 2, "time_signature", 9)],
        "file_id int, track_idx int, event_idx int, type string, value int",
    )
    assert meta.last_meta_message(events, "time_signature").first()["value"] == 3
    assert meta.last_meta_message(events, "set_tempo").count() == 0


def test_apply_channel(spark):
    events = spark.createDataFrame(
        [("main_melody", 0), ("other", 2)], "text string, channel int"
    )
    mapping = spark.createDataFrame([("main_melody", 4)], "text string, new_channel int")
    assert rows(tracks.apply_channel(events, mapping)) == [("main_melody", 4), ("other", 2)]


FULL = {
    "bpm": 200, "audio_key": "cmajor", "time_signature": "4/4", "pitch_range": "mid",
    "num_measures": 4, "inst": "acoustic_piano", "genre": "newage", "min_velocity": 12,
    "max_velocity": 127, "track_category": "main_melody", "chord_progression": "C",
    "rhythm": "standard", "min_modulation": 90, "max_modulation": 107, "min_expression": 70,
    "max_expression": 102, "min_sustain": 0, "max_sustain": 127,
}


def attributes(spark, **values):
    kinds = {k: "string" if isinstance(v, str) else "int" for k, v in FULL.items()}
    schema = ", ".join(f"{k} {t}" for k, t in kinds.items())
    return spark.createDataFrame([tuple(values.get(k) for k in FULL)], schema)


def test_encode_meta(spark):
    assert list(FULL) == list(dims.ATTRIBUTES)
    full = meta.encode_meta(attributes(spark, **FULL), profiles.CATALOG)
    assert full.first()["meta"] == [
        462, 464, 493, 510, 514, 517, 526, 542, 566, 568, 574, 577, 598, 602, 622, 629, 636, 637,
    ]
    assert meta.encode_meta(attributes(spark), profiles.WEB).count() == 0
    unknown = meta.encode_meta(attributes(spark, num_measures=4), profiles.WEB)
    assert unknown.first()["meta"] == [
        422, 463, 488, 506, 514, 516, 525, 539, 539, 567, 575, 576, 579, 579, 607, 607, 635, 635,
    ]
    unmapped = {**FULL, "time_signature": "5/8"}
    assert meta.encode_meta(attributes(spark, **unmapped), profiles.CATALOG).count() == 0


def test_vocabularies():
    assert len(dims.bar_words(32)) == 431
    ids = dims.bar_ids()
    assert (ids["Bar_None"], ids["Note On_0"], ids["Chord_a"], ids["Chord_NN"]) == (2, 3, 163, 270)
    assert len(dims.compound_ids()) == 494
    assert len(dims.flat_aliases(ids)) == 45
    assert dims.performance_offsets()["velocity"] + 1 == dims.KEYSWITCH_TOKEN
    assert len(dims.NON_MELODY_PROGRAMS) == 24
    assert len(dims.program_families()) == 128
