"""Exact dedup against a minimal perfect hash over historical distinct digests.

The index is a table of shards. A shard holds a minimal perfect hash function (levels of
bit arrays; a digest that collides on one level moves to the next) and, per slot, the full
32-byte digest, the locator of the row that stays and the number of rows. Whatever a digest
hashes to, all its bytes are compared with the slot's, so a digest that was never indexed
is seen to be new; new digests are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ascii_lower, stored

#: Digests of one shard, about; the index of a shard is held by one task.
SHARD_DIGESTS = 50_000
#: Lookups that one task answers, about; shards with more are repeated over salts.
TASK_LOOKUPS = 200_000
_LEVELS = 64


def _word(digests: np.ndarray, number: int) -> np.ndarray:
    return digests.view("<u8").reshape(len(digests), 4)[:, number]


def _place(digests: np.ndarray, level: int, bits: int) -> np.ndarray:
    """A place for each digest on a level; SHA-256 bytes are already well mixed."""
    mixed = (_word(digests, 1) ^ (_word(digests, 2) * np.uint64(2 * level + 1))) + np.uint64(level) * _word(digests, 3)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(11)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of a set of digests, as (bits, first slot, packed bits) per level."""

    def __init__(self, levels: list[tuple[int, int, bytes]]) -> None:
        self.levels = [(n, first, np.unpackbits(np.frombuffer(b, np.uint8), count=n)) for n, first, b in levels]
        self.ranks = [first + np.cumsum(b, dtype=np.int64) - 1 for _, first, b in self.levels]

    @staticmethod
    def build(digests: np.ndarray) -> list[tuple[int, int, bytes]]:
        levels, first, left = [], 0, digests
        for level in range(_LEVELS):
            if not len(left):
                return levels
            bits = 2 * len(left) + 8
            place = _place(left, level, bits)
            alone = np.bincount(place, minlength=bits) == 1
            levels.append((bits, first, np.packbits(alone).tobytes()))
            first += int(alone.sum())
            left = left[~alone[place]]
        if len(left):
            raise ValueError("equal digests cannot be told apart")
        return levels

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest; any slot or -1 for digests outside the set."""
        slot = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, (bits, _, taken) in enumerate(self.levels):
            place = _place(digests[open_], level, bits)
            here = taken[place] == 1
            slot[open_[here]] = self.ranks[level][place[here]]
            open_ = open_[~here]
        return slot


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, 32).copy()


INDEX = (
    "shard int, n_slots long, n_rows long, bits array<long>, firsts array<long>, taken array<binary>, "
    "digests binary, keep_ids array<long>, sizes array<long>"
)


def _build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    digests = _matrix(group["digest"])
    levels = PerfectHash.build(digests)
    slot = PerfectHash(levels).slots(digests)
    order = np.argsort(slot)
    sizes = group["size"].to_numpy(np.int64)[order]
    return pd.DataFrame(
        {
            "shard": [key[0]],
            "n_slots": [len(slot)],
            "n_rows": [int(sizes.sum())],
            "bits": [[n for n, _, _ in levels]],
            "firsts": [[f for _, f, _ in levels]],
            "taken": [[b for _, _, b in levels]],
            "digests": [digests[order].tobytes()],
            "keep_ids": [group["keep_id"].to_numpy(np.int64)[order]],
            "sizes": [sizes],
        }
    )


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, digest): SHA-256 of each text after lower-casing A-Z; null counts as empty."""
    return docs.select(F.col(key).alias(key), F.unhex(F.sha2(ascii_lower(F.col(text)), 256)).alias("digest"))


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")


def build_index(rows: DataFrame, key: str = "doc_id", shards: int | None = None) -> tuple[DataFrame, int]:
    """Index of the distinct digests of (key, digest) rows, and its number of shards.

    The winner of a digest is its largest key (null keys never win against others). Rows are
    counted per digest before they are shuffled, so copies cost nothing; shards follow the
    first digest bytes and are even. An empty history gives an empty index.
    """
    counted = rows.groupBy("digest").agg(F.max(key).cast("long").alias("keep_id"), F.count("*").alias("size"))
    if shards is None:
        shards = max(1, -(-rows.count() // SHARD_DIGESTS))
    counted = counted.withColumn("keep_id", F.coalesce("keep_id", F.lit(-1).cast("long")))
    index = counted.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, INDEX)
    return index, shards


def _answer(key_kind: str):
    def run(key: tuple, rows: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return rows.assign(keep_id=[], group_size=[], known=[])[["row_key", "digest", "keep_id", "group_size", "known"]]
        keep, size, known = (np.zeros(len(rows), np.int64) for _ in range(3))
        if len(index):
            shard = index.iloc[0]
            table = np.frombuffer(shard["digests"], np.uint8).reshape(-1, 32)
            mine = _matrix(rows["digest"])
            slot = PerfectHash(list(zip(shard["bits"], shard["firsts"], shard["taken"], strict=True))).slots(mine)
            same = (slot >= 0) & (table[slot] == mine).all(axis=1)  # every byte of the digest
            keep[same] = np.asarray(shard["keep_ids"], np.int64)[slot[same]]
            size[same] = np.asarray(shard["sizes"], np.int64)[slot[same]]
            known[same] = 1
        return pd.DataFrame(
            {"row_key": rows["row_key"], "digest": rows["digest"], "keep_id": keep, "group_size": size, "known": known == 1}
        )

    return run


def look_up(rows: DataFrame, index: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """For (key, digest) rows: keep_id, group_size and known, from the index.

    A shard's lookups are dealt over as many salts as its indexed row count asks for, and
    its index row is repeated as often, so a digest that a third of all rows share spreads
    over many tasks. The salt table has one short row per shard.
    """
    kind = dict(rows.dtypes)[key]
    salts = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / TASK_LOOKUPS)).cast("int")
    loads = index.select("shard", salts.alias("salts"))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    keyed = rows.select(F.col(key).alias("row_key"), "digest").withColumn("shard", _shard(shards))
    keyed = keyed.join(F.broadcast(loads), "shard", "left")  # a pair of ints per 50,000 rows
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.coalesce("salts", F.lit(1))).cast("int"))
    keyed = keyed.select("row_key", "digest", "shard", "salt")
    schema = f"row_key {kind}, digest binary, keep_id long, group_size long, known boolean"
    found = keyed.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(_answer(kind), schema)
    return found.withColumnRenamed("row_key", key)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", history: DataFrame | None = None) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, known, text_sha256.

    With no ``history`` the documents are their own history: all distinct digests are
    indexed, every document is looked up, and the row with the largest key stays. With a
    history (a table with the same columns) documents that it holds are dropped in favour
    of its rows, and the others are grouped among themselves by digest. Of rows that repeat
    a key and a text all are marked alike. Null and empty texts are one group; a null key
    never wins. Empty tables give empty results. Other columns are not read.
    """
    rows = digests(docs, key, text)
    if history is None:
        rows = stored(rows)
        index, shards = build_index(rows, key)
        found = look_up(rows, stored(index), shards, key)
        kept = F.coalesce(F.col(key), F.lit(-1)) == F.col("keep_id")
    else:
        index, shards = build_index(stored(digests(history, key, text)), key)
        found = stored(look_up(rows, stored(index), shards, key))
        new = found.where(~F.col("known")).groupBy("digest")
        new = new.agg(F.max(key).cast("long").alias("new_id"), F.count("*").alias("new_size"))
        found = found.join(new, "digest", "left")
        found = found.withColumn("keep_id", F.when(F.col("known"), F.col("keep_id")).otherwise(F.col("new_id")))
        found = found.withColumn("group_size", F.when(F.col("known"), F.col("group_size")).otherwise(F.col("new_size")))
        kept = ~F.col("known") & F.col(key).eqNullSafe(F.col("keep_id"))
    return found.select(
        key, "keep_id", "group_size", kept.alias("kept"), "known", F.lower(F.hex("digest")).alias("text_sha256")
    )
