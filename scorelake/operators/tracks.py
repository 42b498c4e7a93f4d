"""Choosing tracks and files: channel rules, chord tracks, reject rules.

Per-track and per-file facts are grouped aggregates, so rows are combined on the
map side; they come back to the many-row tables through salted joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions.scans import spread_join

TRACK = ["file_id", "track_idx"]


def track_channel(events: DataFrame) -> DataFrame:
    """Channel of the first channel-bearing event of each track."""
    bearing = events.where(F.col("channel").isNotNull() & (F.col("type") != "channel_prefix"))
    return bearing.groupBy(*TRACK).agg(F.min_by("channel", "event_idx").alias("channel"))


def drop_tracks_by_program(notes: DataFrame, compat: bool = False) -> DataFrame:
    """Drop drum-channel tracks and tracks of programs that carry no melody.

    Channel and program of a track are those of its first note. ``compat`` keeps
    only the channel test, which is all that took effect upstream.
    """
    first = notes.groupBy(*TRACK).agg(
        F.min_by("channel", "note_idx").alias("c"), F.min_by("program", "note_idx").alias("p")
    )
    bad = F.col("c") == dims.DRUM_CHANNEL
    if not compat:
        bad = bad | F.col("p").isin(*dims.NON_MELODY_PROGRAMS)
    return spread_join(notes, first.where(~bad).select(*TRACK), TRACK, "left_semi")


def drop_tracks_by_name(events: DataFrame) -> DataFrame:
    """Keep track 0; drop tracks with a non-melody name or channel."""
    facts = events.groupBy(*TRACK).agg(
        F.min_by("channel", F.when(F.col("channel").isNotNull(), F.col("event_idx"))).alias("c"),
        F.trim(F.min_by("text", "event_idx")).alias("name"),
    )
    bad = F.col("name").isin(*dims.NON_MELODY_CHANNELS) | F.coalesce(
        F.col("c").isin(*dims.NON_MELODY_CHANNELS.values()), F.lit(False)
    )
    keep = facts.where((F.col("track_idx") == 0) | ~bad).select(*TRACK)
    return spread_join(events, keep, TRACK, "left_semi")


def drop_named_note_tracks(notes: DataFrame) -> DataFrame:
    """The same rule on note rows: a track's channel is that of its first note."""
    named = F.trim("track_name").isin(*dims.NON_MELODY_CHANNELS)
    # a flag aggregates in place; a text makes Spark sort the notes first
    facts = notes.groupBy(*TRACK).agg(
        F.min_by("channel", "note_idx").alias("c"), F.min_by(named, "note_idx").alias("named")
    )
    bad = F.col("named") | F.col("c").isin(*dims.NON_MELODY_CHANNELS.values())
    return spread_join(notes, facts.where(~bad).select(*TRACK), TRACK, "left_semi")


def drop_chord_tracks(events: DataFrame) -> DataFrame:
    """Drop tracks with any event text containing the chord track's name."""
    marked = events.groupBy(*TRACK).agg(
        F.coalesce(F.bool_or(F.col("text").contains(dims.CHORD_TRACK)), F.lit(False)).alias("chord")
    )
    keep = marked.where(~F.col("chord")).select(*TRACK)
    return spread_join(events, keep, TRACK, "left_semi")


def apply_channel(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Overwrite channels by track name; ``mapping`` is (text, new_channel).

    Only channel-bearing events of mapped tracks change.
    """
    out = events.join(mapping, "text", "left")
    new = F.when(
        F.col("channel").isNotNull(), F.coalesce(F.col("new_channel"), F.col("channel"))
    )
    return out.withColumn("channel", new).drop("new_channel").select(*events.columns)


def reject_unstable(changes: DataFrame, max_changes: int = dims.MAX_CHANGES) -> DataFrame:
    """Files with at most ``max_changes`` rows in a change list."""
    counts = changes.groupBy("file_id").agg(F.count(F.lit(1)).alias("changes"))
    return counts.where(F.col("changes") <= max_changes)


def unsteady(changes: DataFrame, most: int = dims.MAX_CHANGES) -> DataFrame:
    """Files with more than ``most`` rows in a change list; files without any row are steady."""
    counts = changes.groupBy("file_id").agg(F.count(F.lit(1)).alias("changes"))
    return counts.where(F.col("changes") > most).select("file_id")


def reject_empty(files: DataFrame, notes: DataFrame) -> DataFrame:
    """Files that hold at least one note and end after time zero."""
    filled = notes.groupBy("file_id").agg(F.max("end_tick").alias("e")).where(F.col("e") > 0)
    return files.join(filled.select("file_id"), "file_id", "left_semi")


def skip_chord_only(tracks: DataFrame) -> DataFrame:
    """Files whose only track after the meta track is not the chord track.

    ``tracks`` is (file_id, track_idx, track_name) with one or more rows a track.
    """
    after_meta = F.col("track_idx") > 0
    facts = tracks.groupBy("file_id").agg(
        F.count_distinct(F.when(after_meta, F.col("track_idx"))).alias("n"),
        F.max(F.when(after_meta, F.col("track_name") == dims.CHORD_TRACK)).alias("chord"),
    )
    return facts.where(~((F.col("n") == 1) & F.coalesce("chord", F.lit(False)))).select("file_id")


def assert_track_names(tracks: DataFrame, instruments: DataFrame) -> DataFrame:
    """Count of tracks per file whose name differs from the instrument's."""
    left = tracks.select(*TRACK, "track_name")
    right = instruments.select(*TRACK, F.col("name").alias("instrument"))
    return (
        left.join(right, TRACK)
        .groupBy("file_id")
        .agg(F.count_if(~F.col("track_name").eqNullSafe(F.col("instrument"))).alias("mismatches"))
    )


def range_check_pitch(notes: DataFrame) -> DataFrame:
    """Files whose pitches all lie in 0..127."""
    span = notes.groupBy("file_id").agg(F.min("pitch").alias("lo"), F.max("pitch").alias("hi"))
    return span.where((F.col("lo") >= 0) & (F.col("hi") <= 127))
