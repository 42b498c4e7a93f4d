"""Cutting tracks into chunks at long silences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.scalars import idiv
from scorelake.functions.scans import (
    STEPS_PER_BLOCK,
    TICKS_PER_BLOCK,
    Blocks,
    Running,
    index_block,
    spread_join,
)


def time_bin(tick: Column, bpm: Column, per_second: int = 10, resolution: int = 480) -> Column:
    """Time bin a tick falls into at a fixed tempo."""
    return idiv(tick * (60 * per_second), bpm * resolution)


def chunk_by_silence(
    notes: DataFrame,
    keys: Sequence[str] = ("file_id",),
    per_second: int = 10,
    longest_space: int = 2,
    min_seconds: int = 8,
    compat: bool = False,
    block: int | None = STEPS_PER_BLOCK,
) -> DataFrame:
    """Notes of chunks that last long enough, with the chunk's index and extent.

    ``notes`` carries integer ``start_bin`` and ``end_bin``. A chunk ends where at
    least ``longest_space`` seconds of empty bins follow. ``compat`` also loses
    the last note of a key's last chunk, as upstream did.

    A block of bins hands on the latest end and the number of chunks opened so far, so
    notes of one file are worked on block by block, and only chunks meet as one row each.
    ``block`` is in bins; None cuts blocks of equal size, for keys with very full bins.
    """
    keys, columns = list(keys), notes.columns
    gap, shortest = per_second * longest_space, per_second * min_seconds
    order = ["start_bin", "note_idx"]
    cut = None if block is None else index_block("start_bin", block)
    scan = Blocks(notes, keys, cut, order)
    scan = scan.add({"__ended": Running("max", F.col("end_bin"), upto=False)})
    opens = F.coalesce(F.col("start_bin") - F.col("__ended") - 1 >= gap, F.lit(True))
    rows = scan.add({"__n": Running("sum", opens.cast("int"))}).rows().drop("__ended")
    chunk = rows.groupBy(*keys, "__n").agg(
        F.min("start_bin").alias("chunk_first"),
        F.max("end_bin").alias("chunk_last"),
        F.min("start_tick").alias("chunk_start"),
    )
    kept = chunk.where(F.col("chunk_last") - F.col("chunk_first") >= shortest)
    out = spread_join(rows, kept, [*keys, "__n"])
    if compat:
        last = notes.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__last"))
        out = spread_join(out, last, keys).where(F.struct(*order) != F.col("__last"))
    extent = ["chunk_first", "chunk_last", "chunk_start"]
    return out.select(*columns, (F.col("__n") - 1).cast("int").alias("chunk_idx"), *extent)


def rebase(chunks: DataFrame) -> DataFrame:
    """Move every chunk so that its first note starts at tick 0."""
    shift = F.col("chunk_start")
    return chunks.withColumns(
        {"start_tick": F.col("start_tick") - shift, "end_tick": F.col("end_tick") - shift}
    )


def snap_chunk_to_measures(
    chunks: DataFrame, chords: DataFrame, bar_ticks: Column | int = 1920
) -> DataFrame:
    """Chord notes that belong to each chunk, cut at measure lines.

    ``chunks`` is (file_id, chunk_start, chunk_end, ...) in ticks, one row a chunk,
    and ``chords`` the chord track's notes. Only the first meter counts. The measure
    before the chunk's start is used unless the first chord note inside the chunk
    starts later than that measure; chord times restart at that first note.
    """
    first = first_chord_in_chunk(chunks, chords)
    bar = F.lit(bar_ticks) if isinstance(bar_ticks, int) else bar_ticks
    up = lambda c: idiv(c + bar - 1, bar) * bar
    start_end = up(F.col("chunk_start"))
    start = F.greatest(F.lit(0), start_end - bar)
    spans = first.withColumns(
        {
            "snap_start": F.when(start < F.col("chord_start"), start_end).otherwise(start),
            "snap_end": up(F.col("chunk_end")),
        }
    )
    inside = (F.col("start_tick") >= F.col("snap_start")) & (
        F.col("end_tick") <= F.col("snap_end")
    )
    spans = spans.withColumn("chord_shift", F.col("chord_start")).drop("chord_start")
    pairs = _chord_pairs(spans, chords, "snap_start", "snap_end").where(inside)
    return pairs.withColumns(
        {
            "start_tick": F.col("start_tick") - F.col("chord_shift"),
            "end_tick": F.col("end_tick") - F.col("chord_shift"),
        }
    )


def _chord_pairs(
    spans: DataFrame, chords: DataFrame, lo: str, hi: str, width: int = TICKS_PER_BLOCK
) -> DataFrame:
    """Chord notes beside the spans whose tick buckets hold their start."""
    first, last = idiv(F.col(lo), width), idiv(F.col(hi), width)
    buckets = F.when(last >= first, F.sequence(first, last))
    spans = spans.withColumn("__bucket", F.explode(buckets))
    probe = chords.select("file_id", "note_idx", "start_tick", "end_tick", "pitch")
    probe = probe.withColumn("__bucket", idiv(F.col("start_tick"), width))
    return probe.join(spans, ["file_id", "__bucket"]).drop("__bucket")


def first_chord_in_chunk(chunks: DataFrame, chords: DataFrame) -> DataFrame:
    """Chunks with the first chord note lying wholly inside; others are dropped."""
    pairs = _chord_pairs(chunks, chords, "chunk_start", "chunk_end").where(
        (F.col("start_tick") >= F.col("chunk_start")) & (F.col("end_tick") <= F.col("chunk_end"))
    )
    return pairs.groupBy(*chunks.columns).agg(
        F.min_by("note_idx", "note_idx").alias("chord_note_idx"),
        F.min_by("start_tick", "note_idx").alias("chord_start"),
    )
