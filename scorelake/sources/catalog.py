"""File listings, sample catalogues and the tables that describe them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import dims
from scorelake.functions.scalars import chord_md5
from scorelake.functions.scans import spread_join
from scorelake.sources.sinks import read_table

SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("bpm", T.IntegerType()),
        T.StructField("audio_key", T.StringType()),
        T.StructField("chord_type", T.StringType()),
        T.StructField("time_signature", T.StringType()),
        T.StructField("pitch_range", T.StringType()),
        T.StructField("num_measures", T.IntegerType()),
        T.StructField("inst", T.StringType()),
        T.StructField("genre", T.StringType()),
        T.StructField("track_category", T.StringType()),
        T.StructField("sample_rhythm", T.StringType()),
        T.StructField("chord_progressions", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("created_at", T.DateType()),
        T.StructField("updated_at", T.DateType()),
        T.StructField("auto_changed", T.BooleanType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("has_next", T.BooleanType()),
        T.StructField("samples", T.StructType([T.StructField("samples", T.ArrayType(SAMPLE))])),
    ]
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes below a folder; file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def scan_catalog(
    files: DataFrame, exclude_dirs: Sequence[str] = ("chunked", "tmp")
) -> DataFrame:
    """Music files outside the working folders, with stem and parent folder."""
    suffix = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    parent = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    out = files.withColumns({"parent_dir": parent, "stem": path_stem(F.col("path"))})
    return out.where(suffix.isin(*dims.MIDI_SUFFIXES) & ~F.col("parent_dir").isin(*exclude_dirs))


def stem_catalog(*sources: DataFrame) -> DataFrame:
    """One path per stem; a later source, then a later path, wins."""
    ranked = [s.select("stem", "path", F.lit(i).alias("p")) for i, s in enumerate(sources)]
    merged = ranked[0]
    for other in ranked[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("stem").agg(F.max_by("path", F.struct("p", "path")).alias("path"))


def sample_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    """Samples of paged JSON replies, one row each."""
    parsed = F.from_json(body, PAGE)
    return pages.select(F.explode(parsed["samples"]["samples"]).alias("s")).select("s.*")


def sample_filter(samples: DataFrame, since: str) -> DataFrame:
    """Original samples created and updated on or after a date."""
    day = F.lit(since).cast("date")
    return samples.where(
        (F.col("created_at") >= day) & (F.col("updated_at") >= day) & ~F.col("auto_changed")
    )


CELL_ORDER = ("__file", "__block", "__row")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV cells as text with their place: ``CELL_ORDER``, which names file, block and row.

    Blocks of a file are read in any order by any task; the row number only orders the rows of one block.
    """
    raw = spark.read.option("header", "false").option("multiLine", "false").csv(path)
    return raw.select(
        "*",
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"),
    )


def read_meta_csv(
    raw: DataFrame, status: str, first: str, last: str, order: Sequence[str] = CELL_ORDER
) -> DataFrame:
    """Rows below the first row that has a cell equal to ``status``.

    That row names the columns; those from ``first`` to ``last`` are kept. Without
    such a row the first row of the file is the header and all columns stay.
    """
    cells = [c for c in raw.columns if c not in order]
    at = F.struct(*order)
    is_header = F.array_contains(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cells]), status)
    # one row of names: the schema of the file
    names = raw.agg(
        F.min_by(F.array(*cells), F.when(is_header, at)).alias("found"),
        F.min_by(F.array(*cells), at).alias("top"),
        F.coalesce(F.min(F.when(is_header, at)), F.min(at)).alias("at"),
    ).first()
    body = raw.where(at > F.struct(*[F.lit(names["at"][c]).alias(c) for c in order]))
    header = names["found"] or names["top"]
    picked = list(zip(cells, header))
    if names["found"]:
        picked = picked[header.index(first): header.index(last) + 1]
    return body.select(*[F.col(c).alias(n) for c, n in picked])


def genre_table(rows: DataFrame, name: str, genre: str) -> DataFrame:
    """(name, genre) with lower-cased known genres and no missing names."""
    lowered = F.lower(F.coalesce(F.col(genre), F.lit(dims.UNKNOWN)))
    out = rows.select(F.col(name).alias("name"), lowered.alias("genre"))
    return out.where(F.col("genre").isin(*dims.GENRE_CODES)).na.drop(subset=["name"])


def read_chord_csv(spark: SparkSession, path: str) -> DataFrame:
    """A plain chord CSV with a header line, chords as arrays."""
    schema = "filename string, chord_progression string, chord_progression_hash string"
    return split_chords(spark.read.option("header", "true").schema(schema).csv(path))


def read_chord_table(spark: SparkSession, path: str) -> DataFrame:
    """The committed chord table at ``path``, chords as arrays."""
    return split_chords(read_table(spark, path, header="true"))


def split_chords(rows: DataFrame, column: str = "chord_progression") -> DataFrame:
    return rows.withColumn(column, F.split(column, ","))


def load_examples(examples: DataFrame, split: str) -> DataFrame:
    """Attribute and token rows of one split; they share a row, so no pairing."""
    return examples.where(F.col("split") == split).select(
        "example_id", "profile", "meta", "chord_hash", "note_seq"
    )


def pair_examples(meta: DataFrame, notes: DataFrame) -> DataFrame:
    """Separately stored attribute and token rows, paired by id."""
    return meta.join(notes, "example_id")


def load_token_records(records: DataFrame, column: str = "note_seq") -> DataFrame:
    return records.withColumn("targets", F.col(column).cast("array<bigint>"))


def load_chord_vectors(vectors: DataFrame, progression: str = "progression") -> DataFrame:
    """Vectors keyed by the md5 of their progression."""
    return vectors.withColumn("chord_hash", chord_md5(F.col(progression)))


def samples_to_files(files: DataFrame, samples: DataFrame) -> DataFrame:
    """Files with their parent sample: the stem's part before the first "_"."""
    parent = F.split("stem", "_")[0]
    return files.withColumn("id", parent).join(samples, "id")


def sample_filters(samples: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Samples of keyed categories with chords and, if given, with a file."""
    kept = samples.where(
        ~F.col("track_category").isin(*dims.NON_KEY_CATEGORIES)
        & (F.size("chord_progressions") > 0)
    )
    if files is None:
        return kept
    return kept.join(files.select(F.col("stem").alias("id")), "id", "left_semi")


def parse_augmented_id(rows: DataFrame, column: str = "id", augmented_only: bool = True) -> DataFrame:
    """parent_key_bpm ids in three columns; other ids are skipped.

    With ``augmented_only`` off, plain ids stay as originals with null key and bpm.
    """
    parts = F.split(column, "_")
    three = F.size(parts) == 3
    out = rows.withColumns(
        {
            "parent_id": parts[0],
            "aug_key": F.when(three, F.get(parts, 1)),
            "aug_bpm": F.when(three, F.get(parts, 2).cast("int")),
        }
    )
    return out.where(three) if augmented_only else out.where(three | (F.size(parts) == 1))


def _prefix_pairs(long: DataFrame, text: str, short: DataFrame, key: str) -> DataFrame:
    """Equi join of every text with the short keys it starts with.

    A text is cut at the lengths that keys have, found first from the keys alone, so it
    comes once per such length, not once per letter.
    """
    lengths = short.select(F.sort_array(F.collect_set(F.length(key))).alias("l")).scalar()
    cut = long.withColumn("__n", F.explode(lengths)).where(F.col("__n") <= F.length(text))
    cut = cut.withColumn("__key", F.substring(F.col(text), F.lit(1), F.col("__n"))).drop("__n")
    return spread_join(cut, short.withColumnRenamed(key, "__key"), ["__key"])


def genre_by_prefix(files: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Genre of the first catalogue name a stem starts with; no match drops the file.

    ``catalogue`` is (name, genre, name_order).
    """
    pairs = _prefix_pairs(files, "stem", catalogue, "name")
    return pairs.groupBy(*files.columns).agg(
        F.min_by("__key", "name_order").alias("name"), F.min_by("genre", "name_order").alias("genre")
    )


def manifest_join(samples: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored objects of each sample path, and the samples without any.

    ``samples`` is (id, path), ``objects`` (object_key, size); a path stands for
    all objects whose key starts with it, and empty objects are skipped.
    """
    pairs = _prefix_pairs(objects, "object_key", samples.select("id", "path"), "path")
    found = pairs.where(F.col("size") > 0).select("id", "object_key", "size")
    missing = samples.join(pairs.select("id").distinct(), "id", "left_anti")
    return found, missing


def skip_processed(subsets: DataFrame, manifest: DataFrame, key: str = "subset") -> DataFrame:
    """Subsets that have no output yet."""
    return subsets.join(manifest.select(key), key, "left_anti")


def chord_info_join(files: DataFrame, chord_info: DataFrame) -> DataFrame:
    """Chords of each stem; files without any get a null progression."""
    out = files.join(chord_info.withColumnRenamed("filename", "stem"), "stem", "left")
    return out.withColumn(
        "chord_progression_hash", F.coalesce("chord_progression_hash", F.lit(dims.UNKNOWN))
    )


def chord_vector_join(examples: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """Chord vector of each example; an unknown hash gets ones."""
    out = examples.join(vectors.select("chord_hash", "vector"), "chord_hash", "left")
    ones = F.array_repeat(F.lit(1.0).cast("float"), size)
    return out.withColumn("vector", F.coalesce("vector", ones))
