"""Per-file attributes and their dictionary encoding.

"Unknown" is a null; a value that a code map lacks is a different thing and
rejects the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions.scalars import (
    bpm_bucket,
    bpm_bucket_legacy,
    ceil_bin,
    floor_bin,
    idiv,
    pitch_range,
    tempo_to_bpm,
)
from scorelake.functions.scans import near, spread_join
from scorelake.operators.notes import exclude_keyswitch
from scorelake.profiles import Profile


def pitch_ranges(
    notes: DataFrame,
    keys: Sequence[str] = ("file_id",),
    keyswitch: int | None = dims.KEYSWITCH_VELOCITY,
) -> DataFrame:
    """Range name of the mean pitch, without chord track and keyswitch notes."""
    counted = exclude_keyswitch(notes.where(F.col("track_name") != dims.CHORD_TRACK), keyswitch)
    means = counted.groupBy(*keys).agg(F.avg("pitch").alias("mean_pitch"))
    return means.select(*keys, pitch_range(F.col("mean_pitch")).alias("pitch_range"))


def velocity_ranges(
    notes: DataFrame,
    keys: Sequence[str] = ("file_id",),
    keyswitch: int | None = dims.KEYSWITCH_VELOCITY,
) -> DataFrame:
    """Lowest and highest velocity outside the chord channel and keyswitches."""
    counted = notes.where(F.col("channel") != dims.CHORD_CHANNEL)
    if keyswitch is not None:
        counted = counted.where(F.col("velocity") != keyswitch)
    out = counted.groupBy(*keys).agg(
        F.min("velocity").alias("min_velocity"), F.max("velocity").alias("max_velocity")
    )
    return out.where(F.col("max_velocity") > 0)


def cc_ranges(
    cc: DataFrame, tracks: DataFrame, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """Lowest and highest controller values on the first melody track.

    ``tracks`` is (keys, track_idx, track_name); the first track after track 0
    that is not the chord track is read, even if it has no controller events.
    """
    melody = tracks.where(
        (F.col("track_idx") > 0) & (F.col("track_name") != dims.CHORD_TRACK)
    ).groupBy(*keys).agg(F.min("track_idx").alias("track_idx"))
    rows = spread_join(cc, melody, [*keys, "track_idx"], "left_semi")
    aggs = []
    for name, number in dims.CONTROLS.items():
        value = F.when(F.col("control") == number, F.col("value"))
        aggs += [F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}")]
    return rows.groupBy(*keys).agg(*aggs)


def num_measures(
    notes: DataFrame, keys: Sequence[str] = ("file_id",), bar: Column | int = 1920
) -> DataFrame:
    """Bars from the start of the first note's bar to the last note's end."""
    bar = F.lit(bar) if isinstance(bar, int) else bar
    ends = notes.groupBy(*keys).agg(
        F.min_by("start_tick", "note_idx").alias("a"), F.max_by("end_tick", "note_idx").alias("z")
    )
    length = F.col("z") - idiv(F.col("a"), bar) * bar
    return ends.select(*keys, idiv(length + bar - 1, bar).cast("int").alias("num_measures"))


def num_measures_span(
    notes: DataFrame, track_name: str, keys: Sequence[str] = ("file_id",), bar: int = 1920
) -> DataFrame:
    """Bars covered by one named track, counted from its first note."""
    ends = notes.where(F.col("track_name") == track_name).groupBy(*keys).agg(
        F.min_by("start_tick", "note_idx").alias("a"), F.max_by("end_tick", "note_idx").alias("z")
    )
    length = F.col("z") - F.col("a")
    return ends.select(*keys, idiv(length + bar - 1, F.lit(bar)).cast("int").alias("num_measures"))


def last_meta_message(events: DataFrame, kind: str) -> DataFrame:
    """Value of the last message of a type on track 0."""
    rows = events.where((F.col("track_idx") == 0) & (F.col("type") == kind))
    return rows.groupBy("file_id").agg(F.max_by("value", "event_idx").alias("value"))


def unique_meta_message(events: DataFrame, kind: str) -> DataFrame:
    """The one value of a message type; files with several are rejected.

    For tempos, repeats of the previous value collapse first. ``events`` needs a
    dense 0-based ``seq`` over the messages of the type in a file.
    """
    rows = events.where(F.col("type") == kind)
    if kind == "set_tempo":
        rows = near(rows, ["file_id"], "seq", {"__prev": ("value", -1)})
        rows = rows.where(~F.col("value").eqNullSafe(F.col("__prev")))
    out = rows.groupBy("file_id").agg(F.min("value").alias("value"), F.max("value").alias("__hi"))
    return out.where(F.col("value") == F.col("__hi")).drop("__hi")


def unique_meters(meters: DataFrame) -> DataFrame:
    """One meter per change time; the later one in list order wins."""
    return meters.groupBy("file_id", "time_sec").agg(
        F.max_by(F.struct("numerator", "denominator"), "seq").alias("m")
    ).select("file_id", "time_sec", "m.numerator", "m.denominator")


def inst_codes(notes: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Program of the first instrument and its instrument family."""
    first = notes.groupBy(*keys).agg(
        F.min_by("program", F.struct("track_idx", "note_idx")).alias("program")
    )
    return first.withColumn("inst", program_family(F.col("program")))


def program_family(program: Column) -> Column:
    return dims.indexed(list(dims.program_families().values()), program)


def code_lookup(
    df: DataFrame, codes: DataFrame, key: str, out: str, on_missing: str = "null"
) -> DataFrame:
    """Join a code table (Spark broadcasts it where it is small); ``on_missing`` is null or reject.

    A null key is "unknown" and always stays; only unmapped values are rejected.
    """
    known = codes.select(key, F.col("code").alias(out))
    joined = df.join(known, key, "left")
    if on_missing == "reject":
        joined = joined.where(F.col(key).isNull() | F.col(out).isNotNull())
    return joined


def default_to_unknown(attrs: DataFrame) -> DataFrame:
    """Forget bpm, key and meter where all three are the format's defaults."""
    default = (
        (F.col("bpm") == 120) & (F.col("audio_key") == "cmajor")
        & (F.col("time_signature") == "4/4")
    )
    default = F.coalesce(default, F.lit(False))
    return attrs.withColumns(
        {c: F.when(~default, F.col(c)) for c in ("bpm", "audio_key", "time_signature")}
    )


def _codes(profile: Profile) -> dict[str, Column]:
    """Code of each attribute, null where unknown or unmapped."""
    c = F.col
    inst = dims.program_families() if profile.inst_by_program else dims.INSTRUMENT_FAMILIES
    codes = {
        "bpm": bpm_bucket(c("bpm")),
        "audio_key": dims.lookup(dims.KEY_CODES, c("audio_key")),
        "time_signature": dims.lookup(dims.METER_CODES, c("time_signature")),
        "pitch_range": dims.lookup(
            {n: i for i, n in enumerate(dims.PITCH_RANGE_CUTS)}, c("pitch_range")
        ),
        "inst": dims.lookup(inst, c("inst")),
        "genre": dims.lookup(dims.GENRE_CODES, c("genre")),
        "track_category": dims.lookup(dims.CATEGORY_CODES, c("track_category")),
        "rhythm": dims.lookup(dims.RHYTHM_CODES, c("rhythm")),
    }
    for name, step in (("velocity", 5), ("modulation", 5), ("expression", 5), ("sustain", 127)):
        codes[f"min_{name}"] = floor_bin(c(f"min_{name}"), step)
        codes[f"max_{name}"] = ceil_bin(c(f"max_{name}"), step)
    return codes


def encode_meta(attrs: DataFrame, profile: Profile) -> DataFrame:
    """Eighteen attribute ids in declaration order, as the array ``meta``.

    Rows without a measure count, or with a value its code map lacks, are dropped.
    """
    codes = _codes(profile)
    measures = F.when(F.col("num_measures") == 4, dims.MEASURES_4).otherwise(dims.MEASURES_8)
    chords = F.when(F.col("chord_progression").isNull(), dims.NO_CHORDS).otherwise(dims.HAS_CHORDS)
    ids, valid = [], F.col("num_measures").isNotNull()
    for name, (unknown, offset) in dims.ATTRIBUTES.items():
        if name == "num_measures":
            ids.append(measures)
        elif name == "chord_progression":
            ids.append(chords)
        else:
            valid = valid & (F.col(name).isNull() | codes[name].isNotNull())
            ids.append(F.coalesce((codes[name] + offset).cast("int"), F.lit(unknown)))
    return attrs.where(valid).withColumn("meta", F.array(*ids))


def encode_meta_legacy(attrs: DataFrame) -> DataFrame:
    """Older six-attribute ids; only rows of 4 or 8 measures are kept.

    ``tempo`` is microseconds per beat, or ``bpm`` is given directly.
    """
    bpm = F.col("bpm")
    if "tempo" in attrs.columns:
        bpm = F.coalesce(bpm, tempo_to_bpm(F.col("tempo")))
    codes = {
        "bpm": bpm_bucket_legacy(bpm),
        "audio_key": dims.lookup(dims.KEY_CODES, F.col("audio_key")),
        "time_signature": dims.lookup(dims.METER_CODES, F.col("time_signature")),
        "pitch_range": dims.lookup(
            {n: i for i, n in enumerate(dims.PITCH_RANGE_CUTS)}, F.col("pitch_range")
        ),
        "inst": F.col("inst"),
    }
    ids = []
    for name in dims.LEGACY_ATTRIBUTES:
        if name == "num_measures":
            ids.append(F.when(F.col(name) == 4, dims.MEASURES_4).otherwise(dims.MEASURES_8))
        else:
            unknown, offset = dims.ATTRIBUTES[name]
            ids.append(F.coalesce((codes[name] + offset).cast("int"), F.lit(unknown)))
    return keep_measures(attrs).withColumn("meta", F.array(*ids))


def keep_measures(attrs: DataFrame, allowed: Sequence[int] = (4, 8)) -> DataFrame:
    return attrs.where(F.col("num_measures").isin(*allowed))


def decode_meta(encoded: DataFrame) -> DataFrame:
    """Ids back to codes: every offset taken off except that of the measures."""
    offsets = [0 if n == "num_measures" else o for n, (_, o) in dims.ATTRIBUTES.items()]
    shift = F.array(*[F.lit(o) for o in offsets])
    return encoded.withColumn("codes", F.zip_with("meta", shift, lambda a, b: a - b))


def shift_meta_for_bar(meta: Column, drop: int = 6, offset: int = 11) -> Column:
    """Attribute ids for the bar encoding: controller ids dropped, the rest moved."""
    kept = F.slice(meta, 1, F.size(meta) - drop) if drop else meta
    return F.transform(kept, lambda x: x + offset)


def parse_meta(
    notes: DataFrame,
    cc: DataFrame | None,
    tracks: DataFrame | None,
    header: DataFrame,
    profile: Profile,
    keys: Sequence[str] = ("file_id",),
) -> DataFrame:
    """The 18 attributes of each file or segment from its notes and controllers.

    Segments cut from chunks carry notes only: without ``cc`` all controller
    attributes are unknown.

    ``header`` brings the attributes that are not statistics (bpm, audio_key,
    time_signature, genre, track_category, chord_progression, rhythm), already
    per profile; one keyed by file serves all segments of the file. All note
    statistics come from one aggregate over the notes.
    """
    melody = F.col("track_name") != dims.CHORD_TRACK
    sounding = (F.col("pitch") != 0) & (F.col("velocity") != profile.keyswitch_velocity)
    heard = F.col("channel") != dims.CHORD_CHANNEL
    if profile.velocity_skips_keyswitch:
        heard = heard & (F.col("velocity") != profile.keyswitch_velocity)
    # numbers aggregate in place; a struct makes Spark sort the notes first
    first = F.col("note_idx") if "track_idx" in keys else F.struct("track_idx", "note_idx")
    stats = notes.groupBy(*keys).agg(
        F.avg(F.when(melody & sounding, F.col("pitch"))).alias("mean_pitch"),
        F.min(F.when(heard, F.col("velocity"))).alias("min_velocity"),
        F.max(F.when(heard, F.col("velocity"))).alias("max_velocity"),
        F.min_by("program", first).alias("program"),
        F.min_by("start_tick", "note_idx").alias("a"),
        F.max_by("end_tick", "note_idx").alias("z"),
        (F.max("bar_ticks") if "bar_ticks" in notes.columns else F.lit(1920)).alias("bar_ticks"),
    )
    loud = F.col("max_velocity") > 0
    bar = F.col("bar_ticks")
    length = F.col("z") - idiv(F.col("a"), bar) * bar
    stats = stats.select(
        *keys,
        pitch_range(F.col("mean_pitch")).alias("pitch_range"),
        F.when(loud, F.col("min_velocity")).alias("min_velocity"),
        F.when(loud, F.col("max_velocity")).alias("max_velocity"),
        idiv(length + bar - 1, bar).cast("int").alias("num_measures"),
        F.col("program").cast("string").alias("inst"),
    )
    if not profile.inst_by_program:
        stats = stats.drop("inst")
    if set(keys) <= set(header.columns):
        out = header.join(stats, list(keys), "left")
    else:
        out = stats.join(header, [k for k in keys if k in header.columns])
    if cc is None:
        unknown = [f"{side}_{name}" for name in dims.CONTROLS for side in ("min", "max")]
        out = out.withColumns({c: F.lit(None).cast("int") for c in unknown})
    else:
        out = out.join(cc_ranges(cc, tracks, keys), list(keys), "left")
    return default_to_unknown(out) if profile.default_to_unknown else out
