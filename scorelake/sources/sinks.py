"""Writers of examples, splits, chord tables and passages.

A written table is a folder with versions of its data and a log of commits. A version
counts once its commit is in the log, so a job that fails or is repeated
leaves what readers see as it was, and readers go on with the version they began with.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import dims
from scorelake.functions.arrays import bracketed, pad_or_cut, shift_right
from scorelake.functions.scalars import chord_md5, idiv
from scorelake.functions.scans import hash_rank


COMMIT = "number long, version string, format string, schema string, parts string, rows long"


def write_table(
    df: DataFrame, path: str, parts: Sequence[str] = (), form: str = "parquet", **options: str
) -> None:
    """Write a new version of the table at ``path`` and commit it.

    Rows are counted by the tasks that write them; the commit is one line added to the log, which
    Spark's own commit makes visible as a whole.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    out = counted.write.format(form).options(**options).mode("errorifexists")
    (out.partitionBy(*parts) if parts else out).save(f"{path}/versions/{version}")
    schema = df.schema.json()
    rows = seen.get["rows"]
    number = 1 + max((c.number for c in commits(spark, path)), default=0)
    line = (number, version, form, schema, ",".join(parts), rows)
    commit = spark.createDataFrame([line], COMMIT)
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")


def commits(spark: SparkSession, path: str) -> list:
    """Commits of a table, the one in force last; none where nothing was committed yet."""
    try:
        log = spark.read.schema(COMMIT).json(f"{path}/commits")
    except Exception as missing:  # AnalysisException of the classic or of the connect client
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return []
    return sorted(log.collect(), key=lambda c: (c.number, c.version))


def _version(
    spark: SparkSession, path: str, version: str, form: str, schema: str, options: dict
) -> DataFrame:
    fields = T.StructType.fromJson(json.loads(schema))
    return spark.read.format(form).options(**options).schema(fields).load(f"{path}/versions/{version}")


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The version of a written table that was committed last."""
    log = commits(spark, path)
    if not log:
        raise FileNotFoundError(f"no committed table at {path}")
    last = log[-1]
    return _version(spark, path, last.version, last.format, last.schema, options)


def sharded(df: DataFrame, ids: list[str], max_keep: int, seed: int = 0) -> DataFrame:
    """Add ``shard``: rows in hash order, ``max_keep`` to a shard."""
    ranked = hash_rank(df, ids, seed, "__rank")
    return ranked.withColumn("shard", idiv(F.col("__rank") - 1, max_keep)).drop("__rank")


def shard_name(shard: Column) -> Column:
    """Folder name of a shard: four digits, more where the number has more."""
    return F.format_string("%04d", shard)


def sharded_write(df: DataFrame, path: str, ids: list[str], max_keep: int) -> None:
    """One folder per shard, named 0000, 0001, ..."""
    out = sharded(df, ids, max_keep)
    out = out.withColumn("shard", shard_name(F.col("shard")))
    write_table(out.repartition("shard"), path, ["shard"])


def write_examples(examples: DataFrame, path: str, max_records: int = 20_000) -> None:
    """Attribute and token arrays side by side, one folder per profile."""
    write_table(examples, path, ["profile"], maxRecordsPerFile=str(max_records))


def write_splits(examples: DataFrame, path: str) -> None:
    """Attributes and tokens of every split, ``input`` and ``target`` in one row."""
    out = examples.select(
        "example_id", F.col("meta").alias("input"), F.col("note_seq").alias("target"),
        "chord_hash", "split",
    )
    write_table(out, path, ["split"])


def split_counts(path_or_df: DataFrame) -> DataFrame:
    return path_or_df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def chord_table(progressions: DataFrame) -> DataFrame:
    """(filename, comma text, hash) of the files whose chords were found."""
    found = progressions.where(F.col("progression").isNotNull() & (F.size("progression") > 0))
    return found.select(
        F.col("filename"),
        F.concat_ws(",", "progression").alias("chord_progression"),
        chord_md5(F.col("progression")).alias("chord_progression_hash"),
    )


def write_chord_table(progressions: DataFrame, path: str) -> None:
    write_table(chord_table(progressions), path, form="csv", header="true")


def passage_text(note_seq: Column, maxlen: int = 512) -> Column:
    """Start token, tokens and padding as the text of an array."""
    return bracketed(pad_or_cut(shift_right(note_seq, dims.SOS), maxlen, dims.PAD))


def passage_export(examples: DataFrame, maxlen: int = 512) -> DataFrame:
    return examples.select("example_id", passage_text(F.col("note_seq"), maxlen).alias("text"))
