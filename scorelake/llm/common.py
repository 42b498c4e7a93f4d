"""Helpers of the training-data operators: shared tables, text batches, byte tricks.

Python code here runs inside Arrow batches that Spark partitions; nothing keeps more than
one slice of a batch (``SLICE_BYTES`` of text, or a single longer text) in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once by the numpy steps; a longer single text is one slice.
SLICE_BYTES = 2 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def picked(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, as ``alias=name``; a column that differs by letter case alone is told apart."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{df.columns.index(name)}").alias(alias) for alias, name in names.items()))


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``stored`` in ``parts`` buckets of ``key``: what groups the rows by the key reads them where they lie.

    Spark keeps the buckets of tables only, so there is a table of this name until the files are known.
    """
    spark = df.sparkSession
    name = f"spark_catalog.default.stored_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", shared_folder(spark)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of the name alone: the files are not Spark's to delete
    return table


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with at most ``limit`` bytes in ``column``."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        first = 0
        while first < rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def raw_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; null counts as empty."""
    array = pc.fill_null(array.cast(pa.string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    if not len(array) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


class Words:
    """The words of several texts as one byte string, each word followed by one space.

    ``table`` maps a byte to its (lower-cased) word byte, or to 0 where words end there.
    The stream starts with a space. ``start``/``end`` give each word's bytes, ``first`` each
    text's first word (one more entry than texts).
    """

    PAD = 32

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        texts = len(offsets) - 1
        # one break between texts, so that no word runs into the next text
        flat = np.zeros(len(data) + texts + 1, np.uint8)
        inner = np.ones(len(flat), bool)
        inner[offsets + np.arange(texts + 1)] = False
        flat[inner] = table[data]
        word = flat != 0
        keep = word.copy()
        keep[1:] |= word[:-1]  # the break right after a word stays as its space
        keep[0] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        at = np.cumsum(keep)  # place in the stream, plus one
        flat[~word] = 32
        stream = flat[keep]
        self.text = np.concatenate([np.full(self.PAD, 32, np.uint8), stream, np.full(self.PAD, 32, np.uint8)])
        places = np.flatnonzero(begins)
        self.start = at[places] - 1 + self.PAD
        spaces = np.flatnonzero(stream[1:] == 32) + 1
        self.end = spaces + self.PAD if len(places) else np.zeros(0, np.int64)
        self.first = np.searchsorted(places, offsets + np.arange(texts + 1))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_table(breaks: set[int]) -> np.ndarray:
    """Byte map: 0 for break bytes, A-Z to lower case, others as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    for byte in breaks:
        table[byte] = 0
    return table


#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z is lower-cased.
ALNUM = word_table({*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
#: Words ``[^\x20\x09-\x0D]+``. Byte 0 is a word byte there, so it is kept as 0xFF, which UTF-8 never holds.
SPACED = word_table({0x20, *range(0x09, 0x0E)})
SPACED[0] = 0xFF


def loads(text: np.ndarray, width: str = "<u8") -> np.ndarray:
    """An integer starting at each byte (unaligned view, no copy)."""
    size = np.dtype(width).itemsize
    text = np.ascontiguousarray(text)
    return np.ndarray(shape=(max(0, len(text) - size + 1),), dtype=width, buffer=text, strides=(1,))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i]+1, ...`` (``counts[i]`` of them) for each i, joined."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
