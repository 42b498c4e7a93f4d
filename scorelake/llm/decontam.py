"""Benchmark decontamination by Wu-Manber multi-pattern search.

Every benchmark item gives windows of 13 consecutive words (a shorter item is one window).
The windows are searched in whole documents: a shift table over byte blocks tells how far
a cursor may jump, suffix-hash buckets pick the test strings where it may not, and all
bytes of a window are compared before an occurrence counts. Many cursors walk a slice of
text at once, so that numpy does the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ALNUM, Words, loads, ranges, raw_bytes, slices

WINDOW = 13
#: Benchmark text searched in one pass; the bound on what is broadcast. More text means more passes.
BLOCK_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class _LengthClass:
    """Shift table and buckets of patterns of similar length (``least`` bytes at least)."""

    BITS = 18

    def __init__(self, patterns: list[bytes], numbers: np.ndarray) -> None:
        self.numbers = numbers
        self.lengths = np.array([len(p) for p in patterns], np.int64)
        self.least = int(self.lengths.min())
        self.block = next(b for b in (12, 8, 4, 2) if b <= max(2, self.least // 2) or b == 2)
        width = -(-int(self.lengths.max()) // 8) * 8
        joined = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in patterns), np.uint8).reshape(-1, width)
        self.words = joined.view("<u8")
        left = np.clip(self.lengths[:, None] - 8 * np.arange(width // 8), 0, 8)
        self.masks = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (8 * (left % 8)).astype(np.uint64)) - np.uint64(1))
        self.masks = np.where(left == 0, np.uint64(0), self.masks)
        far = self.least - self.block + 1
        self.shift = np.full(1 << self.BITS, far, np.int32)
        suffix = np.zeros(len(patterns), np.int64)
        for low in range(0, len(patterns), 4096):
            part = joined[low : low + 4096, : self.least]
            flat = np.concatenate([np.zeros(16, np.uint8), np.ascontiguousarray(part).ravel()])
            ends = 16 + np.arange(len(part))[:, None] * self.least + np.arange(self.block - 1, self.least)
            hashes = self.hashes(flat, ends.ravel())
            np.minimum.at(self.shift, hashes, np.tile(np.arange(far - 1, -1, -1), len(part)))
            suffix[low : low + len(part)] = hashes.reshape(len(part), -1)[:, -1]
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.concatenate([[0], np.cumsum(np.bincount(suffix, minlength=1 << self.BITS))])

    def hashes(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the block that ends at each place (inclusive)."""
        wide = loads(text)
        value = wide[ends - 7]
        if self.block < 8:
            value = value >> np.uint64(8 * (8 - self.block))
        elif self.block > 8:
            value = value ^ (wide[ends - 15] >> np.uint64(8 * (16 - self.block))) * _MIX2
        return ((value * _MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, pattern number) of all occurrences inside ``text[low:high]``."""
        ends_low = low + self.least - 1
        if ends_low >= high:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        stride = max(512, -(-(high - ends_low) // 8192))
        at = np.arange(ends_low, high, stride, dtype=np.int64)
        stop = np.minimum(at + stride, high)
        halts = []
        hashes_at = []
        while len(at):
            hashed = self.hashes(text, at)
            step = self.shift[hashed]
            zero = step == 0
            if zero.any():
                halts.append(at[zero])
                hashes_at.append(hashed[zero])
            at = at + np.maximum(step, 1)
            on = at < stop
            if not on.all():
                at, stop = at[on], stop[on]
        if not halts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        halt, hashed = np.concatenate(halts), np.concatenate(hashes_at)
        counts = self.bucket[hashed + 1] - self.bucket[hashed]
        begin = np.repeat(halt - self.least + 1, counts)
        tested = self.order[ranges(self.bucket[hashed], counts)]
        fits = begin + self.lengths[tested] <= high
        begin, tested = begin[fits], tested[fits]
        wide = loads(text)
        for column in range(self.words.shape[1]):
            if not len(begin):
                break
            mask = self.masks[tested, column]
            place = np.minimum(begin + 8 * column, len(wide) - 1)
            same = ((wide[place] ^ self.words[tested, column]) & mask) == 0
            begin, tested = begin[same], tested[same]
        return begin, self.numbers[tested]


class WuManber:
    """Searches byte strings; patterns of very different length get tables of their own."""

    def __init__(self, patterns: list[bytes]) -> None:
        kinds = np.array([len(p).bit_length() for p in patterns], np.int64)
        self.classes = []
        for kind in np.unique(kinds):
            numbers = np.flatnonzero(kinds == kind)
            self.classes.append(_LengthClass([patterns[i] for i in numbers], numbers))

    def search(self, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        found = [c.search(text, low, high) for c in self.classes]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Windows:
    """The distinct windows of some benchmark items, ready to be searched."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        owners: dict[bytes, set[int]] = {}
        self.items = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.items)}
        for name, text in items:
            data, offsets = raw_bytes(pa.array([text], pa.string()))
            words = Words(data, offsets, ALNUM)
            count = len(words.start)
            for i in range(max(1, count - window + 1) if count else 0):
                last = min(count, i + window) - 1
                piece = words.text[words.start[i] - 1 : words.end[last] + 1].tobytes()
                owners.setdefault(piece, set()).add(number[name])
        patterns = list(owners)
        self.n_words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        sets = [sorted(owners[p]) for p in patterns]
        self.owner_count = np.array([len(s) for s in sets], np.int64)
        self.owner_start = np.concatenate([[0], np.cumsum(self.owner_count)[:-1]]).astype(np.int64)
        self.owners = np.array([i for s in sets for i in s], np.int64)
        self.search = WuManber(patterns).search

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, pattern) of every occurrence that lies inside one text."""
        begin, pattern = self.search(words.text, Words.PAD, len(words.text) - Words.PAD)
        first = np.searchsorted(words.start, begin + 1)
        text = np.searchsorted(words.first, first, side="right") - 1
        inside = first + self.n_words[pattern] <= words.first[text + 1]
        return text[inside], first[inside], pattern[inside]


SCHEMA = "n_words long, n_hit long, hit_bits binary, items array<string>"


def _scan(windows: Windows, again: bool, keep_text: bool):
    """One pass: hits and items of one block of the benchmark, added to those of earlier passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(*raw_bytes(batch.column("text")), ALNUM)
            text, first, pattern = windows.occurrences(words)
            edge = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + windows.n_words[pattern], -1)
            hit = np.cumsum(edge[:-1]) > 0
            counts = windows.owner_count[pattern]
            owners = windows.owners[ranges(windows.owner_start[pattern], counts)]
            pairs = np.unique(np.repeat(text, counts) * max(1, len(windows.items)) + owners)
            names: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for pair in pairs.tolist():
                row, item = divmod(pair, len(windows.items))
                names[row].append(windows.items[item])
            bits, n_hit = [], []
            for row in range(batch.num_rows):
                mine = hit[words.first[row] : words.first[row + 1]]
                if again:
                    before = np.frombuffer(batch.column("hit_bits")[row].as_py(), np.uint8)
                    mine = mine | np.unpackbits(before, count=len(mine)).astype(bool)
                    names[row] = sorted({*names[row], *batch.column("items")[row].as_py()})
                bits.append(np.packbits(mine).tobytes())
                n_hit.append(int(mine.sum()))
            out = [batch.column("row_key")] + ([batch.column("text")] if keep_text else [])
            out += [pa.array(words.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(bits, pa.binary())]
            out += [pa.array(names, pa.list_(pa.string()))]
            labels = ["row_key"] + ["text"] * keep_text + ["n_words", "n_hit", "hit_bits", "items"]
            yield pa.RecordBatch.from_arrays(out, labels)

    return run


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Words of each document that lie inside an occurrence of a benchmark window.

    Returns one row per input row: the key, n_words, n_hit, hit_bits (one bit per word, in
    order) and items (distinct item ids as text). A null or empty text has no words; a null
    or empty item has no windows; an item id given twice owns the windows of all its texts;
    repeated rows are answered one by one; an empty benchmark hits nothing. Other columns are
    not read, so their names don't matter. Each pass broadcasts windows of at most
    ``block_bytes`` of benchmark text (a longer single item is a block of its own) and
    passes the text on to the next; there is no shuffle.
    """
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("body"))
    bench = bench.where("body is not null and body != ''")
    size = F.octet_length("body")
    total, longest = bench.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    blocks = max(1, -(-2 * int(total) // max(block_bytes, int(longest))) if total > block_bytes else 1)
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_key"]
    bucket = F.pmod(F.xxhash64("item"), F.lit(blocks))
    for number in range(blocks):
        part = [(r.item or "", r.body) for r in bench.where(bucket == number).collect()]
        windows = Windows(part, window)
        more = number + 1 < blocks
        schema = f"row_key {kind}, " + "text string, " * more + SCHEMA
        rows = rows.mapInArrow(_scan(windows, number > 0, more), schema)
    return rows.withColumnRenamed("row_key", key)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least one word hit, and a twentieth of all words or more."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
