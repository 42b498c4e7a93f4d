"""Bar windows sliding over a file or chunk, and the notes inside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.scalars import idiv
from scorelake.functions.scans import Running, index_block, running

BUCKET_TICKS = 480 * 4 * 4


def bar_ticks(numerator: Column, denominator: Column, resolution: int = 480) -> Column:
    return idiv(numerator * (4 * resolution), denominator)


def encoding_bar_ticks(numerator: Column, denominator: Column, beat: int = 480) -> Column:
    """Bar length as the bar encodings count it: one beat per count, half a beat in eighths."""
    return idiv(numerator * beat, F.when(denominator == 8, 2).otherwise(1))


def note_span(notes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First start (in list order) and last end of each file or chunk."""
    return notes.groupBy(*keys).agg(
        F.min_by("start_tick", "note_idx").alias("first_tick"),
        F.max("end_tick").alias("last_tick"),
    )


def chord_span(spans: DataFrame, chords: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spans taken from the chord track where that track starts after tick 0."""
    late = chords.groupBy(*keys).agg(
        F.min_by("start_tick", "note_idx").alias("c0"), F.max_by("end_tick", "note_idx").alias("c1")
    )
    out = spans.join(late, list(keys), "left")
    use = F.coalesce(F.col("c0") > 0, F.lit(False))
    return out.withColumns(
        {
            "first_tick": F.when(use, F.col("c0")).otherwise(F.col("first_tick")),
            "last_tick": F.when(use, F.col("c1")).otherwise(F.col("last_tick")),
        }
    ).drop("c0", "c1")


def bar_windows(
    spans: DataFrame,
    sizes: Sequence[int] = (4,),
    shift: int = 1,
    bar: Column | int = 1920,
) -> DataFrame:
    """All windows of ``sizes`` bars, one every ``shift`` bars, in one pass."""
    bar = F.lit(bar) if isinstance(bar, int) else bar
    out = spans.withColumn("n_bars", F.explode(F.array(*[F.lit(n) for n in sizes])))
    length, hop = F.col("n_bars") * bar, bar * shift
    stop = F.col("last_tick") - length + hop
    starts = F.when(
        stop > F.col("first_tick"),
        F.sequence(F.col("first_tick"), stop - 1, hop.cast("bigint")),
    )
    out = out.select("*", F.posexplode(starts).alias("window_idx", "win_start"))
    return out.withColumn("win_end", F.col("win_start") + length).drop("first_tick", "last_tick")


def notes_in_windows(
    notes: DataFrame, windows: DataFrame, keys: Sequence[str], width: int = BUCKET_TICKS
) -> DataFrame:
    """Notes that start inside a window, or end inside it, once per window.

    Start and end are looked up separately in tick buckets, so the join is an
    equi join on (keys, bucket); an end match counts only without a start match.
    """
    last = idiv(F.col("win_end") - 1, width)
    tiles = windows.withColumn(
        "__bucket", F.explode(F.sequence(idiv(F.col("win_start"), width), last))
    )
    probes = F.array(
        F.struct(F.lit(True).alias("by_start"), F.col("start_tick").alias("at")),
        F.struct(F.lit(False).alias("by_start"), (F.col("end_tick") - 1).alias("at")),
    )
    probe = notes.withColumn("__p", F.explode(probes))
    probe = probe.withColumn("__bucket", idiv(F.col("__p.at"), width))
    lo, hi, at = F.col("win_start"), F.col("win_end"), F.col("__p.at")
    starts_in = (F.col("start_tick") >= lo) & (F.col("start_tick") < hi)
    hit = (at >= lo) & (at < hi) & (F.col("__p.by_start") | ~starts_in)
    return probe.join(tiles, [*keys, "__bucket"]).where(hit).drop("__bucket", "__p")


def window_segments(
    notes: DataFrame, windows: DataFrame, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """Notes per window, clipped to the window and restarted at its start."""
    inside = notes_in_windows(notes, windows, keys)
    lo, hi = F.col("win_start"), F.col("win_end")
    return inside.withColumns(
        {
            "start_tick": F.greatest(F.col("start_tick"), lo) - lo,
            "end_tick": F.least(F.col("end_tick"), hi) - lo,
        }
    )


def drop_gappy_files(
    windows: DataFrame, segments: DataFrame, keys: Sequence[str] = ("file_id",)
) -> DataFrame:
    """(keys, n_bars) for which every window holds at least one note."""
    at = [*keys, "n_bars"]
    total = windows.groupBy(*at).agg(F.count(F.lit(1)).alias("n_windows"))
    filled = segments.groupBy(*at, "window_idx").agg(F.count(F.lit(1)).alias("__n"))
    filled = filled.groupBy(*at).agg(F.count(F.lit(1)).alias("__filled"))
    return total.join(filled, at).where(F.col("n_windows") == F.col("__filled")).drop("__filled")


def chord_covers_window(chord_segments: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Windows whose chord notes begin at 0 and reach the window's end."""
    at = [*keys, "n_bars", "window_idx"]
    facts = chord_segments.groupBy(*at).agg(
        F.min("start_tick").alias("lo"),
        F.max("end_tick").alias("hi"),
        F.first(F.col("win_end") - F.col("win_start")).alias("length"),
    )
    return facts.where((F.col("lo") == 0) & (F.col("hi") >= F.col("length"))).select(*at)


def bar_bucket(
    items: DataFrame, keys: Sequence[str], bar: Column | int = 1920, note_only: bool = True
) -> DataFrame:
    """Items with their kept bar, counted from 1; bars without a note are dropped.

    ``items`` has ``start_tick`` and, if it mixes kinds, ``name`` ('Note' counts).
    """
    bar = F.lit(bar) if isinstance(bar, int) else bar
    placed = items.withColumn("raw_bar", idiv(F.col("start_tick"), bar))
    source = placed
    if note_only and "name" in items.columns:
        source = placed.where(F.col("name") == "Note")
    bars = source.groupBy(*keys, "raw_bar").agg(F.count(F.lit(1)).alias("__n"))
    bars = running(
        bars, keys, index_block("raw_bar", 10_000), ["raw_bar"],
        {"bar": Running("sum", F.lit(1))},
    ).drop("__n")
    return placed.join(bars, [*keys, "raw_bar"])
