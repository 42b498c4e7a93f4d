"""Time conversion, note pairing and augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions.scalars import grid_start, idiv
from scorelake.functions.scans import (
    ROWS_PER_BLOCK,
    Blocks,
    Running,
    index_block,
    near,
    running,
    spread_join,
)

SECONDS_PER_BLOCK = 60
KEY_SHIFTS = range(-6, 6)
TEMPO_SHIFTS = range(-2, 3)


def tempo_segments(tempo: DataFrame, resolution: int = 480) -> DataFrame:
    """Tempo changes with the tick at which each one starts.

    ``tempo`` is (file_id, seq, time_sec, bpm) with a dense 0-based ``seq``.
    """
    rows = Blocks(tempo, ["file_id"], index_block("seq"), ["seq"]).add(
        {"t0": Running("prev", F.col("time_sec")), "b0": Running("prev", F.col("bpm"))}
    )
    ticks = (F.col("time_sec") - F.col("t0")) * F.col("b0") * resolution / 60
    rows = rows.with_columns({"step": F.coalesce(ticks, F.lit(0.0))})
    out = rows.add({"tick": Running("sum", F.col("step"))}).rows()
    return out.select("file_id", "seq", "time_sec", "bpm", "tick")


def _in_force(tempo: DataFrame, probes: DataFrame, at: str, block: Column, res: int) -> DataFrame:
    """Probe rows with the tempo segment in force (null without one), through one ordered scan."""
    seg = tempo_segments(tempo, res)
    key = "time_sec" if at == "t" else "tick"
    left = seg.select(
        "file_id", F.col(key).cast("double").alias(at), F.lit(0).alias("kind"), "seq",
        F.struct("time_sec", "bpm", "tick").alias("seg"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in probes.schema if f.name not in ("file_id", at)],
    )
    right = probes.select(
        "file_id", F.col(at).cast("double").alias(at), F.lit(1).alias("kind"),
        F.lit(None).cast("bigint").alias("seq"),
        F.lit(None).cast(left.schema["seg"].dataType).alias("seg"),
        *[c for c in probes.columns if c not in ("file_id", at)],
    )
    merged = left.unionByName(right)
    out = running(
        merged, ["file_id"], block, [at, "kind", "seq"], {"seg": Running("last", F.col("seg"))}
    )
    return out.where(F.col("kind") == 1).drop("kind", "seq")


def time_to_tick(tempo: DataFrame, probes: DataFrame, resolution: int = 480) -> DataFrame:
    """Add ``tick`` to probes (file_id, t seconds, ...), rounding half to even."""
    block = F.floor(F.col("t") / SECONDS_PER_BLOCK)
    out = _in_force(tempo, probes, "t", block, resolution)
    since = (F.col("t") - F.col("seg.time_sec")) * F.col("seg.bpm") * resolution / 60
    return out.withColumn("tick", F.bround(F.col("seg.tick") + since, 0).cast("bigint")).drop("seg")


def tick_to_time(tempo: DataFrame, probes: DataFrame, resolution: int = 480) -> DataFrame:
    """Add ``t`` seconds to probes (file_id, tick, ...)."""
    block = F.floor(F.col("tick") / (SECONDS_PER_BLOCK * 1000))
    out = _in_force(tempo, probes, "tick", block, resolution)
    since = (F.col("tick") - F.col("seg.tick")) * 60 / (F.col("seg.bpm") * resolution)
    return out.withColumn("t", F.col("seg.time_sec") + since).drop("seg")


def pair_notes_fifo(
    events: DataFrame,
    at: str,
    keys: Sequence[str] = ("file_id",),
    block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Notes from on/off events: the k-th matched off of a pitch closes its k-th on.

    ``events`` has ``event_idx``, ``type`` (note_on, note_off), ``note``, ``value``
    and the time column ``at``. An off with nothing open is ignored; it is one that
    takes the running balance to a new minimum. Notes still open end at the file's
    last ``at``; empty notes are dropped.
    """
    keys = list(keys)
    pitch = [*keys, "note"]
    last = events.groupBy(*keys).agg(F.max(at).alias("last_at"))
    rows = matched_offs(
        events.where(F.col("type").isin("note_on", "note_off")).withColumn(
            "delta", F.when(F.col("type") == "note_on", 1).otherwise(-1)
        ),
        pitch, "event_idx", block,
    )
    on = F.col("delta") == 1
    rows = rows.where(on | F.col("matched"))
    paired = rows.groupBy(*pitch, F.when(on, F.col("ons")).otherwise(F.col("offs")).alias("k")).agg(
        F.max(F.when(on, F.col("event_idx"))).alias("event_idx"),
        F.max(F.when(on, F.col("value"))).alias("velocity"),
        F.max(F.when(on, F.col(at))).alias("on_at"),
        F.max(F.when(~on, F.col(at))).alias("off_at"),
    )
    paired = spread_join(paired, last, keys)
    paired = paired.withColumn("off_at", F.coalesce("off_at", "last_at"))
    return paired.where(F.col("off_at") > F.col("on_at")).select(
        *keys, "event_idx", F.col("note").alias("pitch"), "velocity", "on_at", "off_at"
    )


def matched_offs(
    rows: DataFrame, keys: Sequence[str], idx: str, block: int, whole: bool = False
) -> DataFrame:
    """Number opening rows (delta 1) and matched closing rows (delta -1) per key.

    Adds ``ons`` (openings so far), ``offs`` (matched closings so far) and
    ``matched``: a closing that takes the running balance to a new minimum has nothing open.
    ``whole`` takes plain windows, for keys of few rows.
    """
    delta = F.col("delta")
    sums = {
        "__balance": Running("sum", delta),
        "ons": Running("sum", (delta == 1).cast("int")),
        "__offs": Running("sum", (delta == -1).cast("int")),
    }
    lows = {
        "__low": Running("min", F.col("__balance")),
        "__low_before": Running("min", F.col("__balance"), upto=False),
    }
    if whole:
        out = running(running(rows, keys, None, [idx], sums, whole), keys, None, [idx], lows, whole)
    else:
        out = Blocks(rows, keys, index_block(idx, block), [idx]).add(sums).add(lows).rows()
    low = F.least(F.lit(0), F.col("__low"))
    fresh = low < F.least(F.lit(0), F.col("__low_before"))
    out = out.withColumns({"offs": F.col("__offs") + low, "matched": (delta == -1) & ~fresh})
    return out.select(*rows.columns, "ons", "offs", "matched")


def exclude_keyswitch(notes: DataFrame, velocity: int | None = dims.KEYSWITCH_VELOCITY) -> DataFrame:
    """Notes that count in statistics: no pitch 0, no keyswitch velocity."""
    kept = notes.where(F.col("pitch") != 0)
    return kept if velocity is None else kept.where(F.col("velocity") != velocity)


def augment_grid(
    files: DataFrame,
    key_shifts: Sequence[int] = KEY_SHIFTS,
    tempo_shifts: Sequence[int] = TEMPO_SHIFTS,
) -> DataFrame:
    """Every file once per key shift and tempo shift (12 x 5 by default).

    The shifts are joined, not exploded: Spark takes exploded rows for as few as there were
    before, and would broadcast all variants of some thousand files through the driver.
    """
    keys, paces = F.array(*[F.lit(k) for k in key_shifts]), F.array(*[F.lit(k) for k in tempo_shifts])
    n, at = len(tempo_shifts), F.col("id").cast("int")
    grid = files.sparkSession.range(0, len(key_shifts) * n, 1, 1)
    grid = grid.select(F.get(keys, idiv(at, n).cast("int")).alias("key_shift"), F.get(paces, at % n).alias("bpm_shift"))
    return files.drop("key_shift", "bpm_shift").crossJoin(grid)


def transposed_key(key_number: Column, shift: Column) -> Column:
    """Key number moved by ``shift`` semitones inside its mode (0-11 or 12-23)."""
    mode = F.when(key_number >= 12, 12).otherwise(0)
    return F.pmod(key_number - mode + shift, F.lit(12)) + mode


def transpose_notes(
    notes: DataFrame, files: DataFrame, chord_track: str = dims.CHORD_TRACK
) -> DataFrame:
    """Melody notes moved by each file's ``key_shift`` and to the first chord's start.

    ``files`` is (file_id, key_number, key_shift); files without a chord track drop out.
    """
    first = notes.where(F.col("track_name") == chord_track).groupBy("file_id").agg(
        F.min_by("start_tick", "note_idx").alias("offset")
    )
    facts = files.join(first, "file_id").withColumn(
        "new_key", transposed_key(F.col("key_number"), F.col("key_shift"))
    )
    out = spread_join(notes.where(F.col("track_name") != chord_track), facts, ["file_id"])
    return out.withColumns(
        {
            "pitch": F.col("pitch") + F.col("key_shift"),
            "start_tick": F.col("start_tick") - F.col("offset"),
            "end_tick": F.col("end_tick") - F.col("offset"),
        }
    ).drop("offset", "key_number")


def avg_bpm(tempo: DataFrame, ends: DataFrame) -> DataFrame:
    """Duration-weighted mean tempo per file, cut to a multiple of 5.

    A single tempo counts as is. ``ends`` is (file_id, end_sec), one row a file.
    """
    rows = near(tempo, ["file_id"], "seq", {"next_time": ("time_sec", 1)})
    rows = spread_join(rows, ends.select("file_id", "end_sec"), ["file_id"])
    held = F.coalesce(F.col("next_time"), F.col("end_sec")) - F.col("time_sec")
    mean = (F.sum(F.col("bpm") * held) / F.max("end_sec")).cast("int")
    out = rows.groupBy("file_id").agg(
        F.when(F.count(F.lit(1)) == 1, F.max("bpm").cast("int")).otherwise(mean).alias("bpm"),
        F.count(F.lit(1)).alias("changes"),
    )
    return out.withColumn("avg_bpm", F.col("bpm") - F.col("bpm") % dims.BPM_STEP).drop("bpm")


def augment_bpm(
    tempo: DataFrame, ends: DataFrame, shifts: Sequence[int] = TEMPO_SHIFTS
) -> DataFrame:
    """Every tempo row set to the file's mean tempo plus 5 bpm per shift.

    A file with one tempo keeps that tempo as its base, without cutting to 5.
    """
    facts = avg_bpm(tempo, ends)
    out = spread_join(tempo, facts, ["file_id"])
    base = F.when(F.col("changes") == 1, F.col("bpm")).otherwise(F.col("avg_bpm"))
    out = out.withColumn("bpm_shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
    out = out.withColumn("bpm", base + F.col("bpm_shift") * dims.BPM_STEP)
    return out.drop("avg_bpm", "changes")


def quantize_to_grid(notes: DataFrame, keys: Sequence[str] = ("file_id",), grid: int = 120):
    """Shift each note to the nearest grid line below the last note's start."""
    last = notes.groupBy(*keys).agg(F.max("start_tick").alias("last_start"))
    out = spread_join(notes, last, list(keys))
    out = out.withColumn(
        "__shift", grid_start(F.col("start_tick"), F.col("last_start"), grid) - F.col("start_tick")
    )
    return out.withColumns(
        {"start_tick": F.col("start_tick") + F.col("__shift"),
         "end_tick": F.col("end_tick") + F.col("__shift")}
    ).drop("__shift", "last_start")


def file_end(notes: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    return notes.groupBy(*keys).agg(F.max("end_tick").alias("end_tick"))


def is_quantized(chords: DataFrame, grid: int = 120) -> DataFrame:
    """Whether all chord starts of a file lie on the grid."""
    return chords.groupBy("file_id").agg(
        F.bool_and(F.col("start_tick") % grid == 0).alias("quantized")
    )

