"""Toxicity of texts whose words may be disguised, by a noisy channel.

A piece of text with leetspeak (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``) or repetition
(``idiooot``) is a lattice: each character may stand for itself, for the letters it looks like,
for a repeat of the one before, for a gap inside a word or for the end of one, each at a
cost. A Viterbi pass finds the cheapest reading under a character language model counted
over the whole corpus. The words read so are then scored by how often they, and their first
letters, occur in labelled toxic and other texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Words, loads, picked, ranges, raw_bytes, slices, word_table

#: Letters that other characters stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Costs of the channel in nats: a look-alike, a starred letter, a repeat, a gap in a word, an end of a word at a mark or a digit.
LOOK, STAR, REPEAT, GAP, MARK, DIGIT = 1.0, 2.0, 0.7, 1.5, 0.5, 3.0
#: Bound on the labelled rows that the scores are fitted on (taken by a hash of key and text).
SAMPLE_ROWS = 20_000
#: Lengths of word beginnings that count as features beside the word.
FRONTS = (4, 5, 6)
#: Least lower bound of the toxic share among texts with a feature, for it to count.
LEAST_SHARE = 0.25
#: Sizes of the hashed tables of four and three bytes; with the pairs, the bound on what a task is sent.
BITS4, BITS3 = 20, 18
#: Pieces of text remembered by a task, at most.
MEMORY = 400_000

#: Words are runs of a-z and of characters above ASCII.
_LETTERS = word_table({*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_ENDS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "@$")
#: Letters as in the language model, but for characters that stand for others.
_LETTER = re.compile("[^\\x00-\\x60\\x7B-\\x7F" + "".join(c for c in LOOKS if ord(c) > 0x7F) + "]")
_PLAIN = re.compile(_LETTER.pattern + "+")
_REPEAT = re.compile(r"(.)\1", re.DOTALL)
_START = b"   "
_MIX = 0x9E3779B97F4A7C15


def _lower(text: str) -> str:
    return text.encode().lower().decode()  # bytes lower-case A-Z only


def _slot(gram: np.ndarray, bits: int) -> np.ndarray:
    return ((gram.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(words: Words) -> np.ndarray:
    """Counts of the bytes of words: hashed runs of four and three bytes, then pairs, then the words.

    Each word is read as three spaces, its bytes, and one space.
    """
    size = words.end - words.start
    if not len(size):
        return np.zeros((1 << BITS4) + (1 << BITS3) + (1 << 16) + 1, np.int64)
    gram = loads(words.text, "<u4")[ranges(words.start - 3, size + 1)]
    begin = np.cumsum(size + 1) - size - 1  # the earliest of the four bytes is the lowest one
    gram[begin] = gram[begin] & np.uint32(0xFF000000) | np.uint32(0x00202020)
    gram[begin + 1] = gram[begin + 1] & np.uint32(0xFFFFFF00) | np.uint32(0x20)
    counts = [np.bincount(_slot(gram, BITS4), minlength=1 << BITS4), np.bincount(_slot(gram >> 8, BITS3), minlength=1 << BITS3)]
    return np.concatenate([*counts, np.bincount(gram >> 16, minlength=1 << 16), [len(size)]])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = 0
    for batch in slices(batches, "text"):
        sums = sums + gram_counts(Words(*raw_bytes(batch.column("text")), _LETTERS))
    if not isinstance(sums, int):
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["slot", "n"])


@dataclass(frozen=True)
class Letters:
    """The character language model: costs in nats of the next byte after three."""

    sums: np.ndarray

    @cached_property
    def steps(self) -> dict[tuple[bytes, str], tuple[bytes, float]]:
        """State after a letter (or a space, the end of a word) and its cost, by state and letter; filled as asked."""
        cost = self._cost

        class Steps(dict):
            def __missing__(self, asked: tuple[bytes, str]) -> tuple[bytes, float]:
                state, spent = asked[0], 0.0
                for byte in asked[1].encode():
                    spent += cost(state, byte)
                    state = state[1:] + bytes([byte])
                if len(self) >= MEMORY:
                    self.clear()
                self[asked] = found = (_START if asked[1] == " " else state, spent)
                return found

        return Steps()

    def _cost(self, before: bytes, byte: int) -> float:
        """Minus the log of the chance of a byte after three, with shorter contexts mixed in."""
        four, three = self.sums[: 1 << BITS4], self.sums[1 << BITS4 :][: 1 << BITS3]
        two, words = self.sums[(1 << BITS4) + (1 << BITS3) : -1], float(self.sums[-1])
        single, total = self._single

        def count(table: np.ndarray, raw: bytes, bits: int) -> float:
            return float(table[(int.from_bytes(raw, "little") * _MIX & (1 << 64) - 1) >> 64 - bits])

        raw = before + bytes([byte])
        p = (single[byte] + 0.5) / (total + 128)
        context = words if before[1:] == b"  " else float(single[before[2]])
        p = (float(two[before[2] | byte << 8]) + 8 * p) / (context + 8)
        context = words if before[1:] == b"  " else float(two[before[1] | before[2] << 8])
        p = (count(three, raw[1:], BITS3) + 8 * p) / (context + 8)
        context = words if before == _START else count(three, before, BITS3)
        p = (count(four, raw, BITS4) + 8 * p) / (context + 8)
        return -math.log(max(p, 1e-9))

    @cached_property
    def _single(self) -> tuple[np.ndarray, float]:
        """Counts of single bytes (the last ones of pairs), and their sum."""
        single = self.sums[(1 << BITS4) + (1 << BITS3) : -1].reshape(256, 256).sum(axis=1)
        return single, float(single.sum())


def letters(docs: DataFrame, text: str = "text") -> Letters:
    """The language model of all words of all texts. What reaches the driver is one table of fixed size."""
    sums = picked(docs, text=text).mapInArrow(_counted, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((1 << BITS4) + (1 << BITS3) + (1 << 16) + 1, np.int64)
    table[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return Letters(table)


def pieces(text: str) -> set[str]:
    """The distinct pieces of a text between spaces; three or more single characters in a row are one piece."""
    text = _lower(text)
    spaced = _SPACED.findall(text)
    if spaced:
        text = _SPACED.sub(" ", text)
    return {*text.split(), *spaced}


class Reader:
    """Reads pieces of text as words; disguised ones by the cheapest path through their lattice.

    ``told`` says what to remember of a piece's words.
    """

    def __init__(self, model: Letters, told=tuple) -> None:
        self.steps = model.steps
        self.told = told
        self.known: dict[str, tuple] = {}

    def all(self, found: Iterable[str]) -> Iterator:
        """What is told of all these pieces, one after the other."""
        known = self.known
        for piece in found:
            told = known.get(piece)
            if told is None:
                if len(known) >= MEMORY:
                    known.clear()
                told = known[piece] = self.told(self.read(piece))
            if told:
                yield from told

    def words(self, text: str) -> set[str]:
        """The distinct words of a text as read."""
        return {*self.all(pieces(text))}

    def read(self, piece: str) -> tuple[str, ...]:
        """The words of a piece of text without spaces, or of single characters with spaces between."""
        piece = piece.strip(_ENDS)
        if not _REPEAT.search(piece) and _PLAIN.fullmatch(piece):
            return (piece,)
        return tuple(self.path(piece).split()) if _LETTER.search(piece) else ()

    def path(self, piece: str) -> str:
        """The cheapest reading of a piece, words apart by spaces.

        A state is the last three bytes read; of all ways to a state the cheapest is kept.
        """
        steps, options = self.steps, {}
        best: dict[bytes, tuple[float, tuple | None]] = {_START: (0.0, None)}
        before = ""
        for c in piece:
            after: dict[bytes, tuple[float, tuple | None]] = {}
            if c not in options:
                options[c] = self._options(c)
            emits, ends, gap = options[c]
            for state, (spent, way) in best.items():
                for extra, letter in emits:
                    to, sum_ = steps[state, letter]
                    sum_ += spent + extra
                    if to not in after or sum_ < after[to][0]:
                        after[to] = (sum_, (way, letter))
                skip = REPEAT if c == before else gap if state != _START else None
                if skip is not None and (state not in after or spent + skip < after[state][0]):
                    after[state] = (spent + skip, way)
                if ends is not None:
                    sum_ = spent + ends + (steps[state, " "][1] if state != _START else 0.0)
                    if _START not in after or sum_ < after[_START][0]:
                        after[_START] = (sum_, (way, " "))
            best, before = after, c
        way = min(best.items(), key=lambda x: x[1][0] + (steps[x[0], " "][1] if x[0] != _START else 0.0))[1][1]
        out = []
        while way is not None:
            way, letter = way
            out.append(letter)
        return "".join(reversed(out))

    @staticmethod
    def _options(c: str) -> tuple[list[tuple[float, str]], float | None, float | None]:
        """Letters that a character may stand for, its cost as an end of a word, and as a gap in one."""
        if _LETTER.match(c):
            return [(0.0, c)], None, None
        looks = [(STAR if c == "*" else LOOK, x) for x in LOOKS.get(c, "")]
        return looks, DIGIT if c.isdigit() else MARK, None if c.isdigit() else GAP


def fronts(word: str) -> list[str]:
    """The beginnings of a word, marked by a star."""
    return [word[:n] + "*" for n in FRONTS if len(word) > n]


def lower_bound(toxic: float, other: float) -> float:
    """Lower end of the toxic share of texts with a feature (Wilson's interval, one side of 95%)."""
    n = toxic + other
    if n <= 0:
        return 0.0
    z, p = 1.645, toxic / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


#: Steps of the shares that the signs of a text tell apart.
_STEPS = (LEAST_SHARE, 0.5, 0.75, 0.9)
SIGNS = 2 * (len(_STEPS) + 2) + 1


def _signs(words: dict[str, float], begun: dict[str, float], size: int) -> list[float]:
    """What the final score is made of: the strongest word, the strongest beginning of the other words, how many
    speak for toxic in each way, and how many pieces the text has."""
    out = []
    for shares in (words.values(), begun.values()):
        top = max(shares, default=0.0)
        out += [float(top >= s) for s in _STEPS]
        out += [math.log1p(sum(s >= least for s in shares)) for least in (0.5, 0.75)]
    return [*out, math.log1p(size) / 5]


def _shares(counts: dict[str, tuple[int, int]], words: Iterable[str], toxic: int | None = None) -> tuple[dict, dict]:
    """Toxic shares of the words that have one, and of the beginnings of the others.

    ``toxic`` is the label of a text whose own part in the counts is taken away.
    """
    own, begun = {}, {}
    for word in words:
        side, names = (own, [word]) if word in counts else (begun, fronts(word))
        for name in names:
            if name in counts:
                a, b = counts[name]
                share = lower_bound(a, b) if toxic is None else lower_bound(a - toxic, b - 1 + toxic)
                if share >= LEAST_SHARE:
                    side[name] = share
    return own, begun


@dataclass(frozen=True)
class Model:
    """Language model, (toxic, other) texts by feature, and the weights of the signs."""

    letters: Letters
    counts: dict[str, tuple[int, int]]
    weights: tuple[float, ...]


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def _feature_counts(model: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(model), ({}, {})

        def out() -> pa.RecordBatch:
            names = list(sums[0].keys() | sums[1].keys())
            sides = [pa.array([s.get(n, 0) for n in names], pa.int64()) for s in sums]
            sums[0].clear(), sums[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), sides[1], sides[0]], ["feature", "toxic", "other"])

        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                side = sums[toxic]
                words = reader.words(text or "")
                for f in words.union(*map(fronts, words)):
                    side[f] = side.get(f, 0) + 1
                if len(sums[0]) + len(sums[1]) > MEMORY:
                    yield out()
        yield out()

    return run


def _signs_of(model: Letters, counts: dict[str, tuple[int, int]]):
    """Signs of labelled rows, each judged without its own part in the counts; equal rows of signs are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, sums = Reader(model), Counter()
        for batch in slices(batches, "text"):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found = pieces(text or "")
                signs = _signs(*_shares(counts, {*reader.all(found)}, toxic), len(found))
                sums[(*(round(s, 1) for s in signs), toxic)] += 1
        rows = [list(k[:-1]) for k in sums]
        arrays = [pa.array(rows, pa.list_(pa.float64())), pa.array([k[-1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["signs", "toxic", "n"])

    return run


def _fitted(rows: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small penalty."""
    x = np.column_stack([np.ones(len(rows)), rows])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (labels - p)) - w
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the rows of ``docs`` whose key ``labels`` marks with 0 or 1, held-out keys aside.

    The language model counts all texts. Of the labelled rows at most about ``sample_rows`` are used,
    by a hash of the key and then of key and text; a key with both labels counts as toxic.
    Rows without key or label teach nothing. Without labelled rows all scores are 0.5.
    """
    model = letters(docs, text)
    marks = picked(labels, row_key=key, toxic=label).where(F.col("toxic").isin(0, 1) & F.col("row_key").isNotNull())
    marks = marks.where(~held_out("row_key"))
    count = marks.count()
    if count > sample_rows:
        marks = marks.where(_share(F.xxhash64("row_key"), sample_rows / count))
    marks = marks.groupBy("row_key").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the keys are a bounded sample: sent to all tasks, so that no text moves
    rows = picked(docs, row_key=key, text=text).join(F.broadcast(marks), "row_key")
    count = rows.select("row_key").count()
    if count > 2 * sample_rows:  # keys that many rows share
        rows = rows.where(_share(F.xxhash64("row_key", "text", F.monotonically_increasing_id()), sample_rows / count))
    rows = rows.select("text", "toxic")
    sums = rows.mapInArrow(_feature_counts(model), "feature string, toxic long, other long")
    sums = sums.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where((F.col("toxic") > 1) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("other") - 1)))
    counts = {}
    for r in sums.toLocalIterator():
        if lower_bound(r.toxic, max(0, r.other - 1)) >= LEAST_SHARE:
            counts[r.feature] = (r.toxic, r.other)
    signs = rows.mapInArrow(_signs_of(model, counts), "signs array<double>, toxic int, n long")
    found = signs.groupBy("signs", "toxic").agg(F.sum("n").alias("n")).collect()
    if not found:
        return Model(model, {}, (0.0,) * (SIGNS + 1))
    sides, n = np.array([r.toxic for r in found], float), np.array([r.n for r in found], float)
    return Model(model, counts, _fitted(np.array([r.signs for r in found]), sides, n))


def _share(hashed: Column, share: float) -> Column:
    return F.pmod(hashed, F.lit(1 << 30)) < int((1 << 30) * share)


def _predicted(model: Model, with_evidence: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weights = model.counts, model.weights
        # of most pieces nothing need be remembered but that they say nothing
        reader = Reader(model.letters, lambda words: tuple((w, _shares(counts, [w])) for w in words if w in counts or any(f in counts for f in fronts(w))))
        for batch in slices(batches, "text"):
            scores, evidence = [], []
            for text in batch.column("text").to_pylist():
                found = pieces(text or "")
                own: dict[str, float] = {}
                begun: dict[str, float] = {}
                for _, (a, b) in reader.all(found):
                    own.update(a), begun.update(b)
                signs = _signs(own, begun, len(found))
                value = weights[0] + sum(w * s for w, s in zip(weights[1:], signs, strict=True))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, value)))))
                if with_evidence:
                    evidence.append(sorted(w for w, s in (own | begun).items() if s >= 0.5))
            out = [batch.column("row_key"), pa.array(scores, pa.float64())]
            if with_evidence:
                out.append(pa.array(evidence, pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(out, ["row_key", "score", "evidence"][: len(out)])

    return run


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", with_evidence: bool = False) -> DataFrame:
    """(key, score, predicted) per row: the score from 0 to 1, and 1 where it is 0.5 or more, else 0.

    ``with_evidence`` adds the words and beginnings (marked by a star) that speak for toxic. Null and
    empty texts have no words and get the score of texts without signs. Whole texts are read,
    key and text only; rows that repeat are judged one by one; no shuffle.
    """
    rows = picked(docs, row_key=key, text=text)
    schema = f"row_key {dict(rows.dtypes)['row_key']}, score double" + (", evidence array<string>" if with_evidence else "")
    found = rows.mapInArrow(_predicted(model, with_evidence), schema)
    extra = ["evidence"] if with_evidence else []
    return found.select(F.col("row_key").alias(key), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *extra)


def restore(docs: DataFrame, model: Letters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with each piece replaced by the words it is read as, in order, one space apart; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in slices(batches, "text"):
            texts = [None if t is None else _in_order(reader, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(texts, pa.string())], ["row_key", "text"])

    rows = picked(docs, row_key=key, text=text)
    found = rows.mapInArrow(run, f"row_key {dict(rows.dtypes)['row_key']}, text string")
    return found.toDF(key, text)


def _in_order(reader: Reader, text: str) -> str:
    text = _lower(text)
    out, last = [], 0
    for m in [*_SPACED.finditer(text), None]:
        plain = text[last : m.start() if m else len(text)].split()
        last = m.end() if m else last
        for piece in [*plain, *([m.group()] if m else [])]:
            out.extend(reader.read(piece))
    return " ".join(out)
