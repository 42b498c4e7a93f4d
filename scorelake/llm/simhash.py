"""SimHash near-duplicates through vantage-point trees.

Fingerprints are counted once each. A vantage-point tree over a bounded sample cuts the
64-bit Hamming space into shards: a node holds a vantage point and a radius, fingerprints
nearer than the radius go inside, others outside. A fingerprint inside whose distance is
within ``bits`` of the radius also visits the outside, since by the triangle inequality only
such a one can link to a fingerprint there. Inside a shard the same split goes on down to
small blocks, in which all distances are taken. Shards return stars (each fingerprint with
the least of its local component), so a ball of near copies costs as many rows as it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import SPACED, Words, loads, raw_bytes, slices, stored
from scorelake.llm.graph import components

SEED = 42
#: Fingerprints of a shard, about, and the most that the shard tree is fitted on.
SHARD_ROWS, SAMPLE_ROWS = 8_000, 50_000
_BLOCK = 192

_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane):
    return _rotate(acc + lane * _P2, 31) * _P1


def xxh64(text: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of one padded byte string."""
    wide, half = loads(text), loads(text, "<u4")
    at = start.copy()
    end = start + length
    hashed = np.full(len(start), (seed + int(_P5)) % (1 << 64), np.uint64)
    big = np.flatnonzero(length >= 32)
    if len(big):
        p1, p2 = int(_P1), int(_P2)
        lanes = [np.full(len(big), v % (1 << 64), np.uint64) for v in (seed + p1 + p2, seed + p2, seed, seed - p1)]
        left = np.arange(len(big))
        place = at[big].copy()
        while len(left):
            for i in range(4):
                lanes[i][left] = _round(lanes[i][left], wide[place[left] + 8 * i])
            place[left] += 32
            left = left[place[left] + 32 <= end[big[left]]]
        merged = sum((_rotate(v, r) for v, r in zip(lanes[1:], (7, 12, 18), strict=True)), _rotate(lanes[0], 1))
        for v in lanes:
            merged = (merged ^ _round(np.uint64(0), v)) * _P1 + _P4
        hashed[big] = merged
        at[big] = place
    hashed += length.astype(np.uint64)
    left = np.flatnonzero(at + 8 <= end)
    while len(left):
        lane = _round(np.uint64(0), wide[at[left]])
        hashed[left] = _rotate(hashed[left] ^ lane, 27) * _P1 + _P4
        at[left] += 8
        left = left[at[left] + 8 <= end[left]]
    left = np.flatnonzero(at + 4 <= end)
    hashed[left] = _rotate(hashed[left] ^ (half[at[left]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[left] += 4
    left = np.flatnonzero(at < end)
    while len(left):
        hashed[left] = _rotate(hashed[left] ^ (text[at[left]].astype(np.uint64) * _P5), 11) * _P1
        at[left] += 1
        left = left[at[left] < end[left]]
    hashed = (hashed ^ (hashed >> np.uint64(33))) * _P2
    hashed = (hashed ^ (hashed >> np.uint64(29))) * _P3
    return hashed ^ (hashed >> np.uint64(32))


#: For each byte, its 8 bits in 8 byte lanes, lowest bit in the lowest lane.
_LANES = np.packbits(
    np.zeros((256, 8, 8), bool) | (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None] & (np.arange(8) == 0)),
    axis=2,
    bitorder="little",
).reshape(256, 8).view("<u8").ravel()


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per group of hashes (``first`` has one entry more than groups): bits set in over half."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    parts = -(-counts // 255)  # a byte lane counts to 255
    owner = np.repeat(np.arange(len(counts)), parts)
    begin = first[:-1][owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
    some = np.flatnonzero(counts)
    group = np.cumsum(parts) - parts
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        sums = np.add.reduceat(_LANES[octets[:, byte]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        whole = np.add.reduceat(sums, group[some], axis=0)
        bits = 2 * whole > counts[some, None]
        out[some] |= (bits @ (1 << np.arange(8))).astype(np.uint64) << np.uint64(8 * byte)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*raw_bytes(batch.column("text")), SPACED)
            text = words.text
            text[text == 0xFF] = 0  # see SPACED
            counts = words.counts()
            pieces = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
            first = np.concatenate([[0], np.cumsum(pieces)])
            owner = np.repeat(np.arange(len(counts)), pieces)
            head = words.first[:-1][owner] + np.arange(len(owner)) - first[:-1][owner]
            tail = np.minimum(head + shingle, words.first[1:][owner]) - 1
            start = words.start[head]
            prints = majority(xxh64(text, start, words.end[tail] - start), first)
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(prints.view(np.int64))], ["row_key", "print"])

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, print): the 64-bit SimHash of each whole text, as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased; shingles of ``shingle`` words,
    repeats included (a shorter text is one shingle), are hashed with XXH64 (seed 42). Null,
    empty and blank texts have print 0.
    """
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_key"]
    return rows.mapInArrow(_fingerprints(shingle), f"row_key {kind}, print long").withColumnRenamed("row_key", key)


def distance(prints: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(prints ^ point).astype(np.int64)


def _split(prints: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a radius with a middling share inside and a thin shell; None if all are equal."""
    point = prints[(seed * 2654435761) % len(prints)]
    far = np.bincount(distance(prints, point), minlength=65)
    within = np.cumsum(far)
    shell = far + np.concatenate([[0], far[:-1]])  # distances radius and radius - 1
    share = np.minimum(within, len(prints) - within) / len(prints)
    cost = np.where(share >= 0.2, shell / np.maximum(share, 1e-9), np.inf)
    if not np.isfinite(cost).any():
        cost = np.where(share > 0, 1 - share, np.inf)
        if not np.isfinite(cost).any():
            return None
    return point, int(np.argmin(cost))


def fit_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, int, int, int]]:
    """Nodes (point, radius, inside, outside); a negative child -1-k is leaf k."""
    nodes: list[list[int]] = []
    count = 0

    def grow(prints: np.ndarray, share: int) -> int:
        nonlocal count
        cut = _split(prints, len(nodes) + 1) if share > 1 and len(prints) > 8 else None
        if cut is None:
            count += 1
            return -count
        point, radius = cut
        here = len(nodes)
        nodes.append([int(point), radius, 0, 0])
        near = distance(prints, point) <= radius
        inner = max(1, round(share * near.mean()))
        nodes[here][2] = grow(prints[near], inner)
        nodes[here][3] = grow(prints[~near], max(1, share - inner))
        return here

    grow(sample, leaves)
    return [tuple(n) for n in nodes]


def _route(nodes: list[tuple[int, int, int, int]], bits: int):
    """Deal each fingerprint to its own shard and to those behind boundaries that it overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            todo = [(0 if nodes else -1, np.arange(len(prints)))]
            while todo:
                node, rows = todo.pop()
                if not len(rows):
                    continue
                if node < 0:
                    shard = pa.array(np.full(len(rows), -1 - node, np.int32))
                    picked = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([shard, *picked.columns], ["shard", *picked.schema.names])
                    continue
                point, radius, inside, outside = nodes[node]
                far = distance(prints[rows], np.uint64(point))
                todo.append((inside, rows[far <= radius]))
                todo.append((outside, rows[far > radius - bits]))

    return run


def _linked(prints: np.ndarray, rows: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at ``bits`` or fewer, each at least once, in bounded pieces."""
    todo = [(rows, 1)]
    while todo:
        rows, seed = todo.pop()
        cut = _split(prints[rows], seed) if len(rows) > _BLOCK else None
        if cut is not None:
            far = distance(prints[rows], cut[0])
            parts = [rows[far <= cut[1]], rows[far > cut[1] - bits]]
            if max(map(len, parts)) < 0.95 * len(rows):
                todo += [(p, 2 * seed + i) for i, p in enumerate(parts)]
                continue
        for low in range(0, len(rows), _BLOCK):
            some = rows[low : low + _BLOCK]
            rest = rows[low:]
            a, b = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[rest][None, :]) <= bits)
            off = b > a
            yield some[a[off]], rest[b[off]]


def _stars(bits: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        prints = group["print"].to_numpy(np.int64).view(np.uint64)
        ids = group["rep"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        prints, ids = prints[order], ids[order]
        root = np.arange(len(ids))
        for a, b in _linked(prints, np.arange(len(ids)), bits):
            while len(a):  # hook the larger root onto the smaller one
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                np.minimum.at(root, high, low)
                while True:
                    deeper = root[root]
                    if (deeper == root).all():
                        break
                    root = deeper
                apart = root[a] != root[b]
                a, b = a[apart], b[apart]
        child = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[child], "b": ids[root[child]]})

    return run


def links(prints: DataFrame, bits: int = 2, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Stars (a, b) that connect all fingerprints at ``bits`` or fewer differing bits.

    ``prints`` has one row (rep, print) per distinct print. The shard tree is fitted on at
    most about ``sample_rows`` prints; every print is dealt through it.
    """
    count = prints.count()
    keep = min(1.0, sample_rows / max(1, count))
    sample = prints.where(F.pmod(F.xxhash64("print"), F.lit(1 << 20)) < int(keep * (1 << 20)) + 1)
    fitted = np.array([r.print for r in sample.select("print").collect()], np.int64).view(np.uint64)
    leaves = min(-(-count // shard_rows), max(1, len(fitted) // 16))
    nodes = fit_tree(np.sort(fitted), leaves) if leaves > 1 else []
    dealt = prints.select("rep", "print").mapInArrow(_route(nodes, bits), "shard int, rep long, print long")
    return dealt.groupBy("shard").applyInPandas(_stars(bits), "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 2, shingle: int = 3) -> DataFrame:
    """(key, print, component): component is the smallest key reachable over links.

    One row per input row; a document alone is its own component. Keys are whole numbers
    that name documents; rows that repeat a key repeat its answer; a null key stands alone
    as component null only if its text links to no other. Empty tables give no rows, other
    columns are not read. Copies share one fingerprint and are never paired.
    """
    rows = stored(fingerprints(docs, key, text, shingle).withColumn(key, F.col(key).cast("long")))
    distinct = stored(rows.groupBy("print").agg(F.min(key).alias("rep")))
    named = distinct.where("rep is not null")
    groups = components(links(named, bits))
    found = distinct.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("print", F.coalesce("component", "rep").alias("component"))
    return rows.join(found, "print").select(key, "print", "component")
