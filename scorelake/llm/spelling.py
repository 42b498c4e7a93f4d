"""Spelling variants: words of a corpus that differ by one edit, grouped under their commonest form.

The vocabulary is sorted and cut into ranges, once as it is and once with its words
reversed: two words at one edit share half of their letters at the front or at the back.
A word scans the part of the list that shares its front half. The scan keeps one banded row
of the edit matrix per letter of the current list word; the next list word takes over the
rows of the prefix it shares (the LCP of neighbours), and where a row's least entry exceeds
one edit all list words with that prefix are skipped. Many words scan at once, so that numpy
does the steps.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ascii_lower, picked, stored

RUN = "[A-Za-zÀ-ÿ]+"
#: Words per range of the sorted vocabulary, about.
RANGE_WORDS = 16_384
#: Sampled words per range that its borders are taken from.
SAMPLED = 16
#: Entries of the kept rows per scan; bounds its memory.
ROW_BYTES = 32 << 20

_TOP = "\U0010ffff"
#: A row of the edit matrix holds the diagonals -1, 0 and 1, each 0, 1 or 2 (two or more), as one number in base 3.
_START, _DEAD = 1 * 9 + 0 * 3 + 1, 26


def _steps() -> np.ndarray:
    """Next row by (row, equal letters at the three diagonals as bits 4, 2 and 1)."""
    table = np.zeros((27, 8), np.uint8)
    for row in range(27):
        old = (row // 9, row // 3 % 3, row % 3)
        for same in range(8):
            costs = [1 - (same >> s & 1) for s in (2, 1, 0)]
            left = min(2, old[1] + 1, old[0] + costs[0])
            mid = min(2, old[2] + 1, old[1] + costs[1], left + 1)
            right = min(2, old[2] + costs[2], mid + 1)
            table[row, same] = left * 9 + mid * 3 + right
    return table


_STEPS = _steps()
#: Entry of the diagonals -1, 0 and 1 by row.
_ENTRIES = np.array([[r // 9, r // 3 % 3, r % 3] for r in range(27)], np.uint8)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 97, chars: int = 5, count: int = 3) -> DataFrame:
    """(word, n): the corpus vocabulary with planted typing errors.

    Runs of letters are lower-cased (A-Z); where ``every`` divides the CRC-32 of ``key:run``, the letter
    at that number modulo the run's length is left out. Words have at least ``chars`` letters
    and ``count`` occurrences. A null text has no runs; a null key is written as nothing.
    """
    rows = picked(docs, row_key=key, text=text).select(
        F.coalesce(F.col("row_key").cast("string"), F.lit("")).alias("row_key"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RUN), F.lit(0))).alias("run"),
    )
    rows = rows.withColumn("size", F.char_length("run")).where(F.col("size") >= chars)
    rows = rows.withColumn("h", F.crc32(F.concat("row_key", F.lit(":"), "run")))
    at = (F.col("h") % F.col("size")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    found = rows.select(word.alias("word")).where(F.char_length("word") >= chars)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def half(size: int) -> int:
    """Letters that a word of this size shares with any word at one edit, at the front or at the back."""
    return (size - 1) // 2


def _borders(vocab: DataFrame, column: str, ranges: int) -> list[str]:
    """First words of all ranges but the first, from a sample of ``SAMPLED`` words a range."""
    if ranges < 2:
        return []
    total = vocab.count()
    share = max(1, total // (ranges * SAMPLED))
    sample = sorted(r[0] for r in vocab.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select(column).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


def _within(prefix: str, word: str) -> bool:
    """Whether a list word that starts with ``prefix`` may be at one edit of ``word`` (they share half of it)."""
    size = half(len(word))
    if not word.startswith(prefix[:size]):
        return False
    row, padded = _START, word + "\0\0\0"
    for d in range(size, min(len(prefix), len(word) + 2)):
        c = prefix[d]
        row = _STEPS[row, (c == padded[d - 1]) * 4 + (c == padded[d]) * 2 + (c == padded[d + 1])]
        if row == _DEAD:
            return False
    return True


def _shared(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def _routed(borders: list[str]):
    """Each word to its own range, which holds it, and to all others that it must ask."""
    fronts = [_shared(a, b) for a, b in zip(borders, borders[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = batch.column("key").to_pylist(), batch.column("n").to_pylist()
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, n in zip(keys, counts, strict=True):
                own = bisect_right(borders, key)
                front = key[: half(len(key))]
                for r in range(bisect_right(borders, front), bisect_left(borders, front + _TOP) + 1):
                    if r == own or not 0 < r < len(borders) or _within(fronts[r - 1], key):
                        for column, value in zip(out, (r, key, n, r == own), strict=True):
                            column.append(value)
            types = (pa.int32(), pa.string(), pa.int64(), pa.bool_())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "key", "n", "held"])

    return run


class SortedList:
    """Sorted distinct words as one array of letters, with the LCP of neighbours."""

    def __init__(self, ordered: list[str]) -> None:
        self.words = ordered
        self.letters, self.start, self.size = _flat(ordered, 1)
        count = len(ordered)
        self.lcp = np.zeros(count + 1, np.int64)
        at, depth = np.arange(1, count), 0
        while len(at):
            same = (self.size[at] > depth) & (self.size[at - 1] > depth)
            at = at[same]
            at = at[self.letters[self.start[at] + depth] == self.letters[self.start[at - 1] + depth]]
            depth += 1
            self.lcp[at] = depth
        #: next place whose LCP is smaller (the end of the list counts as -1)
        self.lcp[count] = -1
        self.lower = np.full(count + 1, count, np.int64)
        stack: list[int] = []
        for place, value in enumerate(self.lcp.tolist()):
            while stack and self.lcp[stack[-1]] > value:
                self.lower[stack.pop()] = place
            stack.append(place)

    def near(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the asked word, place in the list) of all pairs at one edit that share the asked word's front half."""
        sizes = np.array([len(w) for w in asked], np.int64)
        order = np.argsort(sizes, kind="stable")
        found, first = [], 0
        while first < len(order):
            room = (sizes[order[first:]] + 4) * np.arange(1, len(order) - first + 1)
            last = first + max(1, int(np.searchsorted(room, ROW_BYTES, side="right")))
            part = order[first:last]
            lanes, places = self._scan([asked[i] for i in part])
            found.append((part[lanes], places))
            first = last
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _scan(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters, start, size = _flat(asked, 4)
        fronts = [w[: half(len(w))] for w in asked]
        at = np.array([bisect_left(self.words, f) for f in fronts], np.int64)
        stop = np.array([bisect_left(self.words, f + _TOP) for f in fronts], np.int64)
        depth = (size - 1) // 2
        rows = np.zeros((len(asked), int(size.max(initial=0)) + 4), np.uint8)
        lane = np.arange(len(asked))
        rows[lane, depth] = _START
        on = at < stop
        lane, at, stop, depth = lane[on], at[on], stop[on], depth[on]
        found_lane, found_place = [], []
        while len(lane):
            ended = depth == self.size[at]
            if ended.any():
                who = lane[ended]
                off = size[who] - depth[ended] + 1
                close = (off >= 0) & (off <= 2)
                who, place = who[close], at[ended][close]
                one = _ENTRIES[rows[who, depth[ended][close]], off[close]] == 1
                found_lane.append(who[one])
                found_place.append(place[one])
            # one more letter of the list word: the next row from the last one
            here = np.flatnonzero(~ended)
            who, deep = lane[here], depth[here]
            letter = self.letters[self.start[at[here]] + deep]
            mine = start[who] + deep
            same = (letter == letters[mine - 1]) * 4 + (letter == letters[mine]) * 2 + (letter == letters[mine + 1])
            row = _STEPS[rows[who, deep], same]
            depth[here] = deep + 1
            rows[who, deep + 1] = row
            # the list word is done, or all words with this prefix are too far: the next one that shares less
            dead = here[row == _DEAD]
            moved = np.concatenate([np.flatnonzero(ended), dead])
            if len(moved):
                bar = depth[moved] + np.concatenate([np.ones(len(moved) - len(dead), np.int64), np.zeros(len(dead), np.int64)])
                to = at[moved] + 1
                while True:
                    far = self.lcp[to] >= bar
                    if not far.any():
                        break
                    to = np.where(far, self.lower[to], to)
                at[moved] = to
                depth[moved] = np.maximum(self.lcp[to], 0)
                on = at < stop
                if not on.all():
                    lane, at, stop, depth = lane[on], at[on], stop[on], depth[on]
        if not found_lane:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_lane), np.concatenate(found_place)


def _flat(items: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each followed by ``pad`` zeros; where each word starts, and its size."""
    size = np.array([len(w) for w in items], np.int64)
    tail = "\0" * pad
    letters = np.frombuffer((tail.join(items) + tail).encode("utf-32-le"), np.uint32)
    return letters, np.cumsum(size + pad) - size - pad, size


def _backs(asked: list[str], other: list[str]) -> np.ndarray:
    """Whether the two words of each pair share the first one's half at the back."""
    return np.array([a[-half(len(a)) :] == b[-half(len(a)) :] for a, b in zip(asked, other, strict=True)], bool)


def _scanned(reverse: bool):
    def run(group: pa.Table) -> pa.Table:
        asked, counts = group.column("key").to_pylist(), group.column("n").to_numpy()
        held = np.flatnonzero(group.column("held").to_numpy())
        held = held[np.argsort(np.array([asked[i] for i in held], object), kind="stable")]
        listed, counts = [asked[i] for i in held], counts[held]
        lane, place = SortedList(listed).near(asked)
        if reverse:  # those that share the front half too were found in the other list
            new = ~_backs([asked[i] for i in lane], [listed[i] for i in place])
            lane, place = lane[new], place[new]
        turned = (lambda w: w[::-1]) if reverse else (lambda w: w)
        names = np.array([turned(w) for w in listed], object)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        order = np.lexsort((rank[place], -counts[place], lane))
        lane, place = lane[order], place[order]
        first = np.flatnonzero(np.diff(lane, prepend=-1))
        found = [
            pa.array([turned(asked[i]) for i in lane[first]], pa.string()),
            pa.array(np.diff(np.append(first, len(lane))), pa.int64()),
            pa.array(counts[place[first]], pa.int64()),
            pa.array(names[place[first]].tolist(), pa.string()),
        ]
        return pa.Table.from_arrays(found, ["word", "n_near", "best_n", "best"])

    return run


def near_counts(vocab: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) parts of ``vocab`` (word, n): near words of each word, and the commonest.

    A word may have several rows, one per range that held near words; words without any have none.
    Sent to the driver and to each task are only the ranges' borders: one word in ``range_words``,
    from a sample ``SAMPLED`` times as large.
    """
    ranges = -(-vocab.count() // range_words)
    sides = []
    for reverse in (False, True):
        keyed = vocab.withColumn("key", F.reverse("word") if reverse else F.col("word"))
        borders = _borders(keyed, "key", ranges)
        routed = keyed.select("key", "n").mapInArrow(_routed(borders), "part int, key string, n long, held boolean")
        schema = "word string, n_near long, best_n long, best string"
        sides.append(routed.groupBy("part").applyInArrow(_scanned(reverse), schema))
    return sides[0].union(sides[1])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for all rows of (word, form): follow forms to the last one. Forms hold no cycle.

    Pointers double: each round replaces a word's pointer by its pointer's pointer, so rounds
    grow with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    every: int = 97,
    chars: int = 5,
    count: int = 3,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """(word, n, form, form_n, n_near, root) for each word of the corpus (see ``words``).

    Near words differ by exactly one inserted, deleted or replaced letter. A word's form is its near
    word of largest n (ties: the one that sorts first) if that n is at least twice its own,
    else null; root follows forms to the last one, and is the word itself where it has no form.
    Empty tables give no rows; repeated rows count again; only key and text are read.
    """
    if chars < 5:
        raise ValueError("words of fewer than five letters have no half of two letters")
    vocab = stored(words(docs, key, text, every, chars, count))
    nothing = (F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    plain = vocab.select("word", "n", F.lit(0).cast("long").alias("n_near"), *nothing)
    parts = near_counts(vocab, range_words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "best_n", "best")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))))
    found = plain.union(parts).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    has = -F.col("b.n") >= 2 * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(has, F.col("b.w")).alias("form"), F.when(has, -F.col("b.n")).alias("form_n")))
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
