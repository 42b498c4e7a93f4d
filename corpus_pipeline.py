"""From raw documents to packed token sequences, five stages.

Each stage is (spark, docs, sf_dir) -> DataFrame; the caller writes its result as Parquet
and reads it back as the next stage's documents. All but the last keep the columns of
``documents``. Each row is judged by itself: rows that repeat a doc_id, or have none, are
told apart by their place in the stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import decontam, exactdedup, langid, packing, simhash
from scorelake.llm.common import stored


#: Column that tells the rows of a stage's input apart.
ROW = "_row"


def _carried(docs: DataFrame) -> DataFrame:
    """The text of each row, and the whole row (fields by place) as the key that operators hand on."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.select(F.struct(*fields).alias(ROW), "text")


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows that were carried, with the columns of ``docs``."""
    return found.select(*(F.col(f"{ROW}.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number each, written so that every reader sees the same numbers."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _winners(rows: DataFrame, groups: DataFrame, group: str, largest: bool) -> DataFrame:
    """One row per group: the largest or smallest doc_id, the first of rows that share it; a null id loses to others."""
    known = F.col("doc_id").isNotNull() if largest else F.col("doc_id").isNull()
    number = -F.col(ROW) if largest else F.col(ROW)
    place = F.struct(known.alias("known"), F.col("doc_id").alias("id"), number.alias("number"))
    named = groups.select(ROW, group).join(rows.select(ROW, "doc_id"), ROW)
    best = named.groupBy(group).agg((F.max(place) if largest else F.min(place)).alias("best"))
    won = best.select(F.abs("best.number").alias(ROW))
    return rows.join(won, ROW, "left_semi").drop(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found; text without letters goes."""
    found = langid.predict(_carried(docs), langid.train(docs), key=ROW)
    return _unpacked(found.where(F.col("lang_pred") != langid.UNKNOWN), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest doc_id, a null one only where there is no other."""
    rows = _numbered(docs)
    return _winners(rows, exactdedup.dedup(rows, key=ROW), "keep_id", largest=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, a null one only where there is no other."""
    rows = _numbered(docs)
    return _winners(rows, simhash.near_groups(rows, key=ROW), "component", largest=False)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark passages."""
    found = decontam.overlaps(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key=ROW)
    return _unpacked(found.where(~decontam.contaminated()), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("clean", clean), ("packed", packed)]

#: Tokenizers, language scores and SimHash have no SQL form; tests/llm checks against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
