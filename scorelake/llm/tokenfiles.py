"""Token ids as Parquet files that allow selective reads.

One row per document, in ascending key order over the whole set of files: the list of ids,
their number, the part (file) and the ids before the document in that part. Ids are
dictionary encoded (a vocabulary fits one dictionary page), the counters delta encoded;
row groups and pages are kept small and Parquet's page indexes let readers skip to the
rows of a key range without touching other ids, or read the counters alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import list_array, slices
from scorelake.llm.tokens import ENCODE_BYTES, encode, tokenizer_file

TOKENIZER, END_ID = "word_bpe_49k.json", 2
ROW_GROUP_BYTES, PAGE_BYTES = 8 << 20, 128 << 10
#: Row groups are closed by size; Parquet writers check it every so many rows.
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.block.size.row.check.min": "100",
    "parquet.block.size.row.check.max": "1000",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#part": "true",
}


def _encoded(path: str, end_id: int, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids = encode(path, batch.column("text"), end_id, plain_specials)
            counts = np.array([len(i) for i in ids], np.int64)
            start = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            flat = pa.array(np.concatenate(ids).view(np.int32))
            columns = [
                batch.column("row_key"),
                pa.array(np.full(len(ids), part, np.int32)),
                pa.array(start),
                pa.array(counts),
                list_array(flat, counts),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row_key", "part", "start_in_part", "n_tokens", "ids"])

    return run


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    key: str = "doc_id",
    text: str = "text",
    plain_specials: bool = False,
) -> None:
    """Encode each whole text, append ``end_id`` and write the files, in ascending key order.

    Rows are dealt by key range, so parts follow each other; equal keys lie in one part, in
    order of their texts. Null keys come first; null and empty texts are the end id alone.
    Only key and text are read. Ranges are cut before texts are encoded, once.
    ``plain_specials``: strings of special tokens in a text are ordinary text.
    """
    tokenizer = tokenizer or tokenizer_file(TOKENIZER)
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_key"]
    schema = f"row_key {kind}, part int, start_in_part long, n_tokens long, ids array<int>"
    ranged = rows.repartitionByRange("row_key").sortWithinPartitions("row_key", "text")
    encoded = ranged.mapInArrow(_encoded(tokenizer, end_id, plain_specials), schema).withColumnRenamed("row_key", key)
    encoded.write.options(**WRITE_OPTIONS).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before, over all parts.

    The offsets of parts come from the counters alone, one row per part; ids are only read
    if the caller selects them.
    """
    rows = spark.read.parquet(path)
    # one short row per written file
    sizes = rows.groupBy("part").agg(F.max(F.col("start_in_part") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    ends = np.cumsum([r.n for r in sizes]).tolist()
    table = [(r.part, e - r.n) for r, e in zip(sizes, ends, strict=True)]
    bases = spark.createDataFrame(table, "part int, base long")
    rows = rows.join(F.broadcast(bases), "part")
    return rows.withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.cumsum(np.asarray(ids.value_lengths(), np.int64))
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        names = [n for n in batch.schema.names if n != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def with_checksums(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the CRC-32 of the ids as little-endian 32-bit numbers."""
    kept = [f"`{name}` {kind}" for name, kind in rows.dtypes if name != "ids"]
    return rows.mapInArrow(_checksums, ", ".join([*kept, "ids_crc32 long"]))
