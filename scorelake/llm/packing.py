"""Packing into fixed-length sequences: first-fit decreasing over a tournament tree.

A document's ids are cut at every ``length`` ids; whole pieces fill sequences of their own.
The rests are packed in randomised groups of documents, each group by itself: longest rest
first, into the first sequence with room, which a tournament tree over the sequences' free
places finds in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import list_array, slices
from scorelake.llm.tokens import ENCODE_BYTES, encode, tokenizer_file

TOKENIZER, END_ID, LENGTH = "byte_bpe_50k.json", 0, 1024
#: Documents packed together, about.
GROUP_DOCS = 20_000
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """First place with enough room; each inner node holds the most room below it."""

    def __init__(self, places: int, room: int) -> None:
        self.width = 1 << max(0, (places - 1).bit_length())
        self.most = [room] * (2 * self.width)

    def first(self, need: int) -> int:
        most, node = self.most, 1
        while node < self.width:
            node *= 2
            if most[node] < need:
                node += 1
        return node - self.width

    def room(self, place: int) -> int:
        return self.most[place + self.width]

    def take(self, place: int, need: int) -> None:
        most, node = self.most, place + self.width
        most[node] -= need
        node >>= 1
        while node:
            best = max(most[2 * node], most[2 * node + 1])
            if most[node] == best:
                break
            most[node] = best
            node >>= 1


def first_fit(sizes: list[int], length: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each size, in the given order, into bins of ``length``."""
    tree = Tournament(max(1, len(sizes)), length)
    bins, offsets = [], []
    for size in sizes:
        place = tree.first(size)
        bins.append(place)
        offsets.append(length - tree.room(place))
        tree.take(place, size)
    return bins, offsets


def _pieces(path: str, end_id: int, length: int, groups: int, seed: int, with_ids: bool, plain_specials: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", ENCODE_BYTES):
            ids = encode(path, batch.column("text"), end_id, plain_specials)
            crc = [[zlib.crc32(i[a : a + length].astype("<u4").tobytes()) for a in range(0, len(i), length)] for i in ids]
            deal = [
                zlib.crc32(f"{seed} {k} {len(i)} {c[0]}".encode()) % groups
                for k, i, c in zip(batch.column("row_key").to_pylist(), ids, crc, strict=True)
            ]
            counts = np.array([len(i) for i in ids], np.int64)
            columns = [batch.column("row_key"), pa.array(deal, pa.int32()), pa.array(counts)]
            columns.append(pa.array(crc, pa.list_(pa.int64())))
            names = ["row_key", "deal", "doc_tokens", "crcs"]
            if with_ids:
                columns.append(list_array(pa.array(np.concatenate(ids).view(np.int32)), counts))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pack_group(length: int, with_ids: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tokens = group["doc_tokens"].to_numpy(np.int64)
        # ties by key and content, so that a repeated task gives the same bins
        first_crc = np.array([c[-1] for c in group["crcs"]], np.int64)
        named = group["row_key"].to_numpy()
        rank = np.lexsort((first_crc, pd.factorize(named, sort=True)[0], -tokens))
        group, tokens = group.iloc[rank].reset_index(drop=True), tokens[rank]
        whole, rest = tokens // length, tokens % length
        order = np.flatnonzero(rest)
        order = order[np.argsort(-rest[order], kind="stable")]
        bins, offsets = first_fit(rest[order].tolist(), length)
        used = max(bins, default=-1) + 1
        base = int(key[0]) << 40  # sequences of a group are numbered inside it
        row = np.concatenate([np.repeat(np.arange(len(tokens)), whole), order]).astype(np.int64)
        full = np.arange(int(whole.sum()))
        number = full - np.repeat(np.cumsum(whole) - whole, whole)
        cut = np.concatenate([number, whole[order]]).astype(np.int64)
        out = pd.DataFrame(
            {
                "row_key": group["row_key"].to_numpy()[row],
                "start": cut * length,
                "length": np.concatenate([np.full(len(full), length), rest[order]]).astype(np.int64),
                "ids_crc32": np.array([group["crcs"].iat[r][c] for r, c in zip(row, cut, strict=True)], np.int64),
                "doc_tokens": tokens[row],
                "sequence_id": base + np.concatenate([used + full, np.array(bins, np.int64)]).astype(np.int64),
                "offset": np.concatenate([np.zeros(len(full)), np.array(offsets)]).astype(np.int64),
            }
        )
        if with_ids:
            out["ids"] = [group["ids"].iat[r][c * length : (c + 1) * length] for r, c in zip(row, cut, strict=True)]
        return out

    return run


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    length: int = LENGTH,
    key: str = "doc_id",
    text: str = "text",
    group_docs: int = GROUP_DOCS,
    seed: int = 0,
    with_ids: bool = False,
    plain_specials: bool = False,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document (and its end id) lies in one piece; pieces of a sequence fill
    it from offset 0 without gaps, up to ``length``. Null and empty texts are the end id
    alone; rows that repeat a key are packed one by one; an empty table gives no rows; other
    columns are not read. Groups come from a hash of key and content, so they are even; only
    lengths and checksums are shuffled unless ``with_ids`` asks for the pieces' ids.
    ``plain_specials``: strings of special tokens in a text are ordinary text.
    """
    tokenizer = tokenizer or tokenizer_file(TOKENIZER)
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_key"]
    groups = max(1, round(docs.select(F.lit(1)).count() / group_docs))
    extra = ", ids array<int>" if with_ids else ""
    cut = rows.mapInArrow(
        _pieces(tokenizer, end_id, length, groups, seed, with_ids, plain_specials),
        f"row_key {kind}, deal int, doc_tokens long, crcs array<long>{extra}",
    )
    found = cut.groupBy("deal").applyInPandas(_pack_group(length, with_ids), f"row_key {kind}, {PIECES}{extra}")
    return found.withColumnRenamed("row_key", key)
