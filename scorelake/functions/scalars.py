"""Scalar rules on single columns, all built-in expressions.

Ticks, steps and bins stay integers; ``div`` rounds towards zero, so every
quotient below is written with a non-negative numerator.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import dims


def idiv(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a.cast("bigint"), F.lit(b).cast("bigint"))


def chord_md5(chords: Column) -> Column:
    return F.md5(F.concat_ws(",", chords))


def truncate_text(x: Column, digits: int) -> Column:
    """Cut a double after ``digits`` decimals; tiny or huge values round instead."""
    exact = x.cast("decimal(38,12)")
    kept = F.signum(x) * F.floor(F.abs(exact) * 10**digits) / 10**digits
    plain = (F.abs(x) >= 1e-4) & (F.abs(x) < 1e16) | (x == 0)
    return F.when(plain, kept).otherwise(F.bround(exact, digits)).cast(
        f"decimal(38,{digits})"
    ).cast("string")


def truncate_value(x: Column, digits: int) -> Column:
    return truncate_text(x, digits).cast("double")


def tempo_to_bpm(microseconds: Column) -> Column:
    """Beats per minute from microseconds per beat, halves to even."""
    return F.bround(F.lit(60_000_000.0) / microseconds, 0).cast("int")


def key_text(key: Column) -> Column:
    """Key signature such as F#m to f#minor, C to cmajor."""
    minor = key.endswith("m")
    tonic = F.when(minor, F.expr("1")).otherwise(F.lit(0))
    stem = F.substring(key, F.lit(1), F.length(key) - tonic)
    return F.concat(F.lower(stem), F.when(minor, "minor").otherwise("major"))


def meter_text(numerator: Column, denominator: Column) -> Column:
    return F.concat_ws("/", numerator.cast("string"), denominator.cast("string"))


def meter_parts(text: Column) -> tuple[Column, Column]:
    parts = F.split(text, "/")
    return parts[0].cast("int"), parts[1].cast("int")


def bpm_bucket(bpm: Column) -> Column:
    # least() skips nulls, so an unknown tempo is kept apart
    capped = F.least(bpm, F.lit(dims.MAX_BPM - 1))
    return F.when(bpm.isNotNull(), idiv(capped, dims.BPM_STEP))


def bpm_bucket_legacy(bpm: Column) -> Column:
    return F.when(bpm >= dims.MAX_BPM, 39).otherwise(idiv(bpm, dims.BPM_STEP))


def floor_bin(value: Column, step: int = 5) -> Column:
    return idiv(value, step)


def ceil_bin(value: Column, step: int = 5) -> Column:
    return idiv(value + F.lit(step - 1), step)


def _bin_width(bins: int) -> int:
    return -(-127 // bins)


def cc_bin(value: Column, bins: int) -> Column:
    return idiv(F.abs(value - 1), _bin_width(bins)) + 1


def cc_value(cc: Column, bins: int) -> Column:
    return F.lit(1) + (cc - 1) * _bin_width(bins)


def sustain_value(cc: Column) -> Column:
    return F.when(cc_value(cc, 2) < 64, 0).otherwise(127)


def performance_velocity_bin(velocity: Column) -> Column:
    return idiv(velocity - 1, 2) + 1


def performance_velocity(velocity_bin: Column) -> Column:
    return (velocity_bin - 1) * 2 + 1


def position_index(offset: Column, bar_ticks: Column, grid: int = 32) -> Column:
    """Nearest of ``grid`` points in the bar, 0-based, ties to the lower one."""
    nearest = idiv(offset * (2 * grid) + bar_ticks - 1, bar_ticks * 2)
    return F.least(F.lit(grid - 1), F.greatest(F.lit(0), nearest))


def velocity_bin(velocity: Column) -> Column:
    return idiv(velocity, 4)


def duration_step(bar_ticks: Column, grid: int = 32) -> Column:
    return idiv(bar_ticks, 4 * grid)


def duration_bin(duration: Column, bar_ticks: Column, grid: int = 32) -> Column:
    """Nearest multiple of the step, 0-based, ties to the lower one."""
    step = duration_step(bar_ticks, grid)
    nearest = idiv(duration * 2 + step - 1, step * 2) - 1
    return F.least(idiv(bar_ticks, step) - 1, F.greatest(F.lit(0), nearest))


def tempo_class(bpm: Column) -> Column:
    return F.when(bpm < 90, "slow").when(bpm < 150, "mid").otherwise("fast")


def tempo_value(bpm: Column) -> Column:
    return (
        F.when(bpm < 30, 0).when(bpm < 90, bpm - 30).when(bpm < 150, bpm - 90)
        .when(bpm < 210, bpm - 150).otherwise(59)
    )


def tempo_from_class(name: Column, value: Column) -> Column:
    return F.when(name == "slow", 30).when(name == "mid", 90).when(name == "fast", 150) + value


def grid_start(start: Column, last_start: Column, grid: int = 120) -> Column:
    """Nearest grid line below the last start, ties to the lower one."""
    nearest = idiv(start + (grid // 2 - 1), grid)
    last_line = idiv(last_start + (grid - 1), grid) - 1
    return F.when(last_start > 0, F.least(nearest, last_line) * grid).otherwise(start)


def track_category(channel: Column) -> Column:
    return F.coalesce(dims.lookup(dims.CHANNEL_CATEGORIES, channel), F.lit(dims.UNKNOWN))


def quantize_step(tick: Column, bpm: Column, resolution: int = 480, per_second: int = 100) -> Column:
    """Nearest time step of a tick at a fixed tempo, halves up."""
    scaled = tick * (60 * per_second)
    whole = bpm * resolution
    return idiv(scaled * 2 + whole, whole * 2)


def parse_ids(text: Column) -> Column:
    """All digit runs of a text as integers; one too long for 64 bits is null."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+)"), 1)
    return F.transform(runs, lambda x: x.try_cast("bigint"))


def strip_inst_number(inst: Column) -> Column:
    return F.regexp_replace(inst, "-[0-9]+", "")


def genre_from_path(path: Column) -> Column:
    """First known genre word inside the path, else the default."""
    found = F.coalesce(*[F.when(path.contains(g), F.lit(g)) for g in dims.GENRE_CODES])
    return F.coalesce(found, F.lit(dims.DEFAULT_GENRE))


def pitch_range(mean_pitch: Column) -> Column:
    """Name of the first range whose upper cut lies above the mean pitch."""
    out = F.when(F.lit(False), F.lit(""))
    for name, cut in dims.PITCH_RANGE_CUTS.items():
        out = out.when(mean_pitch < cut, name)
    return out
