"""From decoded tables to training examples (chunked and catalogue corpora)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions.scalars import (
    chord_md5,
    genre_from_path,
    meter_parts,
    strip_inst_number,
)
from scorelake.functions.scans import spread_join
from scorelake.operators import chunks, examples, meta, notes, tokens, tracks, windows
from scorelake.operators.chords import detect_chords
from scorelake.profiles import CATALOG, TAGGED, WEB, Profile
from scorelake.session import cut_lineage
from scorelake.sources import catalog, sinks

CHUNK = ["file_id", "track_idx", "chunk_idx"]
SEGMENT = [*CHUNK, "n_bars", "window_idx"]
ENCODERS = ("performance", "bar", "bar_detected", "compound")


def file_facts(
    tempo: DataFrame,
    ends: DataFrame,
    header: DataFrame,
    key_changes: DataFrame | None = None,
    meter_changes: DataFrame | None = None,
) -> DataFrame:
    """Mean tempo and bar length of the files that are stable enough to use.

    ``header`` is (file_id, audio_key, time_signature, path, ...), one row a file. The change lists
    have a row per key or meter event; files with more than eight of either are left out.
    """
    stable = tracks.reject_unstable(tempo).select("file_id")
    for changes in (key_changes, meter_changes):
        if changes is not None:
            stable = stable.join(tracks.unsteady(changes), "file_id", "left_anti")
    mean = notes.avg_bpm(tempo, ends).join(stable, "file_id", "left_semi")
    numerator, denominator = meter_parts(F.coalesce("time_signature", F.lit("4/4")))
    facts = header.join(mean, "file_id").withColumnRenamed("avg_bpm", "bpm").drop("changes")
    return facts.withColumn("bar_ticks", windows.bar_ticks(numerator, denominator))


def chunk_notes(note_rows: DataFrame, facts: DataFrame, profile: Profile) -> DataFrame:
    """Melody notes cut into chunks, each restarted at tick 0."""
    melody = note_rows.where(F.col("track_name") != dims.CHORD_TRACK)
    if profile.drop_tracks == "program":
        melody = tracks.drop_tracks_by_program(melody)
    elif profile.drop_tracks == "name":
        melody = tracks.drop_named_note_tracks(melody)
    timed = spread_join(
        melody.drop("bpm"), facts.select("file_id", "bpm", "bar_ticks"), ["file_id"]
    )
    per_second = profile.steps_per_second
    timed = timed.withColumns(
        {
            "start_bin": chunks.time_bin(F.col("start_tick"), F.col("bpm"), per_second),
            "end_bin": chunks.time_bin(F.col("end_tick"), F.col("bpm"), per_second),
        }
    )
    cut = chunks.chunk_by_silence(
        timed, ["file_id", "track_idx"], per_second, profile.longest_space,
        profile.min_chunk_seconds,
    )
    return chunks.rebase(cut).drop("start_bin", "end_bin", "chunk_first", "chunk_last")


def chunk_chords(chunk_rows: DataFrame, chords: DataFrame) -> DataFrame:
    """Chord notes of every chunk, cut at measures; chunks without any are missing."""
    end = F.max_by("end_tick", "note_idx") + F.max("chunk_start")
    extent = chunk_rows.groupBy(*CHUNK).agg(
        F.max("chunk_start").alias("chunk_start"), end.alias("chunk_end"),
        F.max("bar_ticks").alias("bar_ticks"),
    )
    return chunks.snap_chunk_to_measures(extent, chords, F.col("bar_ticks"))


def cut_segments(
    chunk_rows: DataFrame, profile: Profile, chords: DataFrame | None = None
) -> DataFrame:
    """Window segments of all sizes; chunks with an empty window drop out.

    With chord notes, only windows that chords cover from start to end remain.
    """
    keys = CHUNK
    span = chunk_rows.groupBy(*keys).agg(
        F.min_by("start_tick", "note_idx").alias("first_tick"),
        F.max("end_tick").alias("last_tick"),
        F.max("bar_ticks").alias("bar_ticks"),
    )
    if chords is not None:
        span = windows.chord_span(span, chords, keys).join(
            chords.select(*keys).distinct(), keys, "left_semi"
        )
    wins = windows.bar_windows(span, profile.window_bars, bar=F.col("bar_ticks")).drop("bar_ticks")
    segments = cut_lineage(windows.window_segments(chunk_rows, wins, keys))
    whole = windows.drop_gappy_files(wins, segments, keys).drop("n_windows")
    segments = spread_join(segments, whole, [*keys, "n_bars"], "left_semi")
    if chords is None:
        return segments
    sung = windows.window_segments(chords.select(*keys, "note_idx", "start_tick", "end_tick"), wins, keys)
    covered = windows.chord_covers_window(sung, keys)
    return spread_join(segments, covered, SEGMENT, "left_semi")


def encode_notes(
    segments: DataFrame, header: DataFrame, encoder: str = "performance", keys: list[str] = SEGMENT
) -> DataFrame:
    """Token array of every segment by one of ``ENCODERS``.

    The bar encodings count bars by the meter of the file (4/4 where unknown); ``bar_detected``
    adds the chords found in the notes, ``compound`` joins rows of seven slots end to end.
    """
    if encoder not in ENCODERS:
        raise ValueError(f"encoder is one of {', '.join(ENCODERS)}")
    if encoder == "performance":
        return tokens.performance_arrays(tokens.note_steps(segments), keys)
    if encoder == "bar_detected":
        items = tokens.items_union(segments, detect_chords(segments, keys), keys)
    else:
        items = tokens.note_items(segments, keys)
    meter = meter_parts(F.coalesce("time_signature", F.lit("4/4")))
    bars = header.select("file_id", windows.encoding_bar_ticks(*meter).alias("__bar"))
    items = spread_join(items, bars, ["file_id"])
    order = ["bar", "place", "sub"]
    if encoder != "compound":
        return tokens.pack_tokens(tokens.bar_encode(items, keys, F.col("__bar")), keys, order)
    words = tokens.pack_tokens(tokens.compound_encode(items, keys, F.col("__bar")), keys, order, "word")
    return words.withColumn("note_seq", F.flatten("note_seq"))


def encoded_meta(meta_ids: Column, encoder: str) -> Column:
    """Attribute ids as they go with an encoder: bar tokens have a vocabulary of their own."""
    return meta.shift_meta_for_bar(meta_ids) if encoder.startswith("bar") else meta_ids


def segment_examples(
    segments: DataFrame, header: DataFrame, profile: Profile, encoder: str = "performance"
) -> DataFrame:
    """Attribute ids and tokens of every segment."""
    attrs = meta.parse_meta(segments, None, None, header, profile, SEGMENT)
    extra = [c for c in ("chord_hash",) if c in header.columns]
    encoded = meta.encode_meta(attrs, profile)
    encoded = encoded.select(*SEGMENT, encoded_meta(F.col("meta"), encoder).alias("meta"), *extra)
    return encoded.join(encode_notes(segments, header, encoder), SEGMENT)


def as_examples(rows: DataFrame, profile: Profile) -> DataFrame:
    """One schema for the examples of all corpora: what ``combine_datasets`` and the writers take."""
    keys = [c for c in SEGMENT if c in rows.columns]
    hashes = F.col("chord_hash") if "chord_hash" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        F.concat_ws("-", F.lit(profile.name), *keys).alias("example_id"),
        F.lit(profile.name).alias("profile"),
        F.col("meta").cast("array<bigint>").alias("meta"),
        F.coalesce(hashes, F.lit(dims.UNKNOWN)).alias("chord_hash"),
        F.col("note_seq").cast("array<bigint>").alias("note_seq"),
    )


def training_corpus(
    web: DataFrame,
    catalog_rows: DataFrame,
    tagged: DataFrame,
    path: str,
    web_rows: int,
    ratio: float = 0.1,
    seed: int = 2021,
) -> DataFrame:
    """Mix the three corpora, split the mix, write it, and return what was written.

    Examples are written to the shared folder first: the hashes that part them are found
    from ids and counts, without computing examples again.
    """
    parts = [(web, WEB), (catalog_rows, CATALOG), (tagged, TAGGED)]
    done = [cut_lineage(as_examples(rows, profile)) for rows, profile in parts]
    mixed = examples.combine_datasets(*done, web_rows, ratio, seed)
    sinks.write_splits(mixed, path)
    return sinks.read_table(mixed.sparkSession, path)


def web_examples(
    note_rows: DataFrame,
    tempo: DataFrame,
    ends: DataFrame,
    header: DataFrame,
    profile: Profile = WEB,
    encoder: str = "performance",
    key_changes: DataFrame | None = None,
    meter_changes: DataFrame | None = None,
) -> DataFrame:
    """Training examples of a chunked corpus, one row per window segment.

    Facts, chunks and segments are each read by several branches, so each is
    written to the checkpoint folder once. Given change lists, files with more than eight
    key or meter events have no chunks, and files with more than one meter no windows.
    """
    facts = cut_lineage(file_facts(tempo, ends, header, key_changes, meter_changes))
    chunk_rows = chunk_notes(note_rows, facts, profile)
    if meter_changes is not None:
        chunk_rows = chunk_rows.join(tracks.unsteady(meter_changes, 1), "file_id", "left_anti")
    chunk_rows = cut_lineage(chunk_rows)
    unknown = F.lit(None).cast("string")
    known = facts.select(
        "file_id", "bpm", "audio_key", "time_signature",
        genre_from_path(F.lower("path")).alias("genre"),
        unknown.alias("track_category"), unknown.alias("chord_progression"),
        unknown.alias("rhythm"),
    )
    segments = cut_lineage(cut_segments(chunk_rows, profile))
    return segment_examples(segments, known, profile, encoder)


def tagged_examples(
    note_rows: DataFrame,
    tempo: DataFrame,
    ends: DataFrame,
    header: DataFrame,
    genres: DataFrame,
    chord_info: DataFrame,
    profile: Profile = TAGGED,
    encoder: str = "performance",
) -> DataFrame:
    """Examples of a chunked corpus with chord tracks, a genre table and a chord table.

    ``header`` is (file_id, stem, audio_key, time_signature), ``genres`` (name,
    genre, name_order), ``chord_info`` (filename, chord_progression,
    chord_progression_hash). Files without a genre drop out.
    """
    facts = cut_lineage(file_facts(tempo, ends, header))
    chunk_rows = cut_lineage(chunk_notes(note_rows, facts, profile))
    chord_notes = note_rows.where(F.col("track_name") == dims.CHORD_TRACK)
    chords = cut_lineage(chunk_chords(chunk_rows, chord_notes))
    segments = cut_lineage(cut_segments(chunk_rows, profile, chords))

    named = catalog.genre_by_prefix(facts.select("file_id", "stem"), genres).drop("name")
    sung = catalog.chord_info_join(named, chord_info)
    channel = segments.groupBy("file_id", "track_idx").agg(
        F.min_by("channel", "note_idx").alias("channel")
    )
    known = facts.select("file_id", "bpm", "audio_key", "time_signature").join(
        sung.select(
            "file_id", "genre", "chord_progression",
            F.col("chord_progression_hash").alias("chord_hash"),
        ),
        "file_id",
    )
    known = channel.join(known, "file_id").select(
        "*", dims.lookup(dims.CHANNEL_CATEGORIES, F.col("channel")).alias("track_category"),
        F.lit(None).cast("string").alias("rhythm"),
    ).drop("channel")
    return segment_examples(segments, known, profile, encoder)


def catalog_examples(
    samples: DataFrame,
    files: DataFrame,
    note_rows: DataFrame,
    cc: DataFrame,
    track_names: DataFrame,
    profile: Profile = CATALOG,
    augmented_only: bool = False,
) -> DataFrame:
    """Examples of a sample catalogue: attributes from the catalogue and the notes.

    ``files`` is (file_id, stem); stems are sample ids or parent_key_bpm. Originals
    are encoded too unless ``augmented_only``. A sample is a few bars long, so its
    tokens are packed into one array; keyswitch notes are cut from them.
    """
    ids = catalog.parse_augmented_id(files, "stem", augmented_only)
    parents = catalog.sample_filters(samples).withColumnRenamed("id", "parent_id")
    rows = ids.join(parents, "parent_id")
    key = F.col("audio_key")
    full = key.contains("major") | key.contains("minor")
    header = rows.select(
        "file_id",
        F.coalesce("aug_bpm", "bpm").alias("bpm"),
        F.coalesce("aug_key", F.when(full, key).otherwise(F.concat(key, "chord_type"))).alias(
            "audio_key"
        ),
        "time_signature", strip_inst_number(F.col("inst")).alias("inst"), "genre",
        "track_category",
        F.get("chord_progressions", 0).alias("chord_progression"),
        F.col("sample_rhythm").alias("rhythm"),
    )
    melody = note_rows.where(F.col("track_name") != dims.CHORD_TRACK)
    attrs = meta.parse_meta(melody, cc, track_names, header, profile)
    encoded = meta.encode_meta(attrs, profile).select(
        "file_id", "meta", chord_md5(F.col("chord_progression")).alias("chord_hash")
    )
    tempo = encoded_tempo(header)
    steps = tokens.note_steps(spread_join(melody.drop("bpm"), tempo, ["file_id"]))
    return encoded.join(tokens.performance_arrays(steps, drop_keyswitch=True), "file_id")


def augment_catalog(
    files: DataFrame,
    note_rows: DataFrame,
    tempo: DataFrame,
    ends: DataFrame,
    key_shifts: Sequence[int] = notes.KEY_SHIFTS,
    tempo_shifts: Sequence[int] = notes.TEMPO_SHIFTS,
) -> tuple[DataFrame, DataFrame]:
    """Files and notes of every key and tempo variant, as ``catalog_examples`` takes them.

    ``files`` is (file_id, stem, key_number). A variant is named stem_key_bpm and numbered in
    ``file_id``, ``source_id`` is the file it comes from. Variants with a pitch outside of 0..127
    are left out, as are files without a chord track, a key or a tempo. What the variants of a file
    share is one row, written to the shared folder; rows are multiplied where they lie, and no moved note is shuffled.
    """
    keys = max(key_shifts) - min(key_shifts) + 1
    bpms = max(tempo_shifts) - min(tempo_shifts) + 1
    chord = F.col("track_name") == dims.CHORD_TRACK
    span = note_rows.groupBy("file_id").agg(
        F.min(F.when(~chord, F.col("pitch"))).alias("__lo"), F.max(F.when(~chord, F.col("pitch"))).alias("__hi"),
        F.bool_or(chord).alias("__sung"),
        F.min_by("start_tick", F.when(chord, F.col("note_idx"))).alias("__offset"),
    )
    paced = notes.augment_bpm(tempo, ends, [0]).groupBy("file_id").agg(F.max("bpm").alias("bpm"))
    known = files.where(F.col("key_number").isNotNull()).join(span.where("__sung"), "file_id").join(paced, "file_id")
    known = cut_lineage(known)
    key, pace = F.col("key_shift"), F.col("bpm_shift")

    def variants(rows: DataFrame) -> DataFrame:
        grid = notes.augment_grid(rows, key_shifts, tempo_shifts)
        return grid.where((F.col("__lo") + key >= 0) & (F.col("__hi") + key <= 127))

    variant = (key - min(key_shifts)) * bpms + pace - min(tempo_shifts)
    variant = (F.col("file_id") * (keys * bpms) + variant).cast("bigint").alias("file_id")
    new_key = dims.indexed(dims.KEY_NAMES, notes.transposed_key(F.col("key_number"), key))
    bpm = (F.col("bpm") + pace * dims.BPM_STEP).cast("string")
    named = variants(known).select(
        variant, F.col("file_id").alias("source_id"), F.concat_ws("_", "stem", new_key, bpm).alias("stem")
    )
    facts = known.select("file_id", "__lo", "__hi", "__offset")
    rows = variants(spread_join(note_rows.where(~chord), facts, ["file_id"])).withColumns(
        {
            "pitch": F.col("pitch") + key,
            "start_tick": F.col("start_tick") - F.col("__offset"),
            "end_tick": F.col("end_tick") - F.col("__offset"),
        }
    )
    return named, rows.select(*[c for c in note_rows.columns if c != "file_id"], variant)


def encoded_tempo(header: DataFrame) -> DataFrame:
    """Tempo of each file, 120 where the catalogue has none."""
    return header.select("file_id", F.coalesce("bpm", F.lit(120)).alias("bpm"))


def training_batches(
    rows: DataFrame, batch_size: int, max_length: int, ids: list[str], **batching
) -> DataFrame:
    """Full batches of padded examples within the length limit."""
    kept = examples.length_filter(examples.concat_example(rows), max_length)
    batches = examples.padded_batch(kept, batch_size, examples.example_pads(), ids, **batching)
    return examples.drop_partial_batches(batches, batch_size)
