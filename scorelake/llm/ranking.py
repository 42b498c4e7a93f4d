"""Ranked lexical search of many items at once, with common subexpressions evaluated once.

Items share terms, above all frequent ones. Per block of items, neighbouring terms in
order of frequency that occur together in several items become a node, and nodes that
occur together become larger nodes: a query-sharing graph in which each node is the sum
of two earlier ones. For some documents at a time the accumulators of all nodes are
filled once, level by level; an item's scores are the sum of the few nodes it is made of.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import ALNUM, Words, loads, picked, ranges, raw_bytes, slices, stored

TOP = 10
#: Item text per block, about: the items whose shared term sets are mined together.
BLOCK_BYTES = 1 << 20
#: Plans that one pass over the documents carries to its tasks, at most (or one block); more items mean more passes.
PASS_BYTES = 64 << 20
#: Accumulators filled at once, in bytes.
FILLED_BYTES = 32 << 20
#: Candidates of a task that are held before all but the best are let go.
HELD = 200_000
#: Groups per item in the first of two rankings.
SALTS = 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Terms:
    """Distinct terms, found in the words of texts by hash and confirmed byte by byte."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = np.array([len(t) for t in terms], np.int64)
        self.longest = int(self.size.max(initial=0))
        self.text = np.frombuffer(b"".join(terms) + b" " * 8, np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.seed = 0
        while True:
            hashed = _hashes(self.text, self.start, self.size, self.seed)
            self.order = np.argsort(hashed, kind="stable")
            self.sorted = hashed[self.order]
            if (self.sorted[1:] != self.sorted[:-1]).all():
                break
            self.seed += 1
        self.known = np.zeros(1 << 16, bool)
        self.known[hashed >> np.uint64(48)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, number of the term) for all words that are terms."""
        size = words.end - words.start
        at = np.flatnonzero(size <= self.longest)
        hashed = _hashes(words.text, words.start[at], size[at], self.seed)
        likely = self.known[hashed >> np.uint64(48)]
        at, hashed = at[likely], hashed[likely]
        place = np.searchsorted(self.sorted, hashed)
        same = place < len(self.sorted)
        same[same] = self.sorted[place[same]] == hashed[same]
        at, term = at[same], self.order[place[same]]
        same = size[at] == self.size[term]
        at, term = at[same], term[same]
        for depth in range(0, self.longest, 8):
            same = _eight(words.text, words.start[at] + depth, size[at] - depth) == _eight(self.text, self.start[term] + depth, size[at] - depth)
            at, term = at[same], term[same]
        return at, term


def _eight(text: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The ``left`` (at most 8) bytes that start at each place, as a number; 0 where none are left."""
    wide = loads(text)
    value = wide[np.minimum(start, len(wide) - 1)]
    left = np.clip(left, 0, 8)
    mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (8 * (left % 8)).astype(np.uint64)) - np.uint64(1))
    return value & mask


def _hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    out = size.astype(np.uint64) + np.uint64(seed)
    on = np.arange(len(start))
    depth = 0
    while len(on):
        part = (out[on] ^ _eight(text, start[on] + depth, size[on] - depth)) * _MIX
        out[on] = part ^ (part >> np.uint64(29))
        depth += 8
        on = on[size[on] > depth]
    return out * _MIX


@dataclass(frozen=True)
class Plan:
    """Items of a block as sums of nodes.

    Node i is leaf i, ``leaves[i]`` = (term, how often an item holds it), or the sum of the two
    nodes ``pairs[i - len(leaves)]``, which come before it; ``levels`` cuts the pairs into
    runs that only use earlier runs. Item j sums the nodes ``parts[first[j]:first[j + 1]]``.
    """

    terms: tuple[bytes, ...]
    leaves: np.ndarray
    pairs: np.ndarray
    levels: tuple[int, ...]
    parts: np.ndarray
    first: np.ndarray
    items: pa.Array

    @property
    def saved(self) -> int:
        """Additions a document is spared by sharing: those of separate items less those of the graph."""
        size = np.ones(len(self.leaves) + len(self.pairs), np.int64)
        for i, (a, b) in enumerate(self.pairs):
            size[len(self.leaves) + i] = size[a] + size[b]
        return int(size[self.parts].sum()) - len(self.parts) - len(self.pairs)


def mine(items: pa.Array, texts: pa.Array) -> Plan:
    """The plan of some items: repeatedly join the neighbouring nodes that most items share."""
    words = Words(*raw_bytes(texts), ALNUM)
    raw = words.text.tobytes()
    held = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        held.append(Counter(raw[words.start[i] : words.end[i]] for i in range(a, b)))
    kept = [i for i, c in enumerate(held) if c]
    shared = Counter(leaf for i in kept for leaf in held[i].items())
    leaves = sorted(shared, key=lambda leaf: (-shared[leaf], leaf))
    number = {leaf: i for i, leaf in enumerate(leaves)}
    terms = tuple(dict.fromkeys(t for t, _ in leaves))
    place = {t: i for i, t in enumerate(terms)}
    rows = [sorted(number[leaf] for leaf in held[i].items()) for i in kept]
    nodes, made, levels = len(leaves), [], []
    while True:
        together = Counter(p for row in rows for p in zip(row, row[1:], strict=False))
        joined: dict[tuple[int, int], int] = {}
        after = []
        for row in rows:
            counts = [0, *(together[p] for p in zip(row, row[1:], strict=False)), 0]
            out, i = [], 0
            while i < len(row):
                # the pair that starts here, unless few share it or the next pair is shared by more
                if counts[i + 1] > 1 and counts[i + 1] >= counts[min(i + 2, len(counts) - 1)]:
                    out.append(joined.setdefault((row[i], row[i + 1]), nodes + len(made) + len(joined)))
                    i += 2
                else:
                    out.append(row[i])
                    i += 1
            after.append(out)
        if not joined:
            break
        made.extend(joined)
        levels.append(len(made))
        rows = after
    return Plan(
        terms,
        np.array([(place[t], k) for t, k in leaves], np.int64).reshape(-1, 2),
        np.array(made, np.int64).reshape(-1, 2),
        tuple(levels),
        np.array([n for row in rows for n in row], np.int64),
        np.cumsum([0, *map(len, rows)]),
        items.take(pa.array(kept, pa.int64())),
    )


def _mined(group: pa.Table) -> pa.Table:
    table = group.combine_chunks()
    plan = mine(table.column("item").chunk(0), table.column("text").chunk(0))
    return pa.table({"plan": pa.array([pickle.dumps(plan)], pa.binary())})


def _counted(plans: list[Plan]):
    """Documents with terms, their words, and the documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [Terms(list(p.terms)) for p in plans]
        sums = [np.zeros(len(p.terms), np.int64) for p in plans]
        totals = np.zeros(2, np.int64)
        for batch in slices(batches, "text"):
            words = Words(*raw_bytes(batch.column("text")), ALNUM)
            counts = words.counts()
            totals += [np.count_nonzero(counts), counts.sum()]
            owner = np.repeat(np.arange(len(counts)), counts)
            for finder, found in zip(finders, sums, strict=True):
                at, term = finder.find(words)
                once = np.unique(owner[at] * len(found) + term)
                found += np.bincount(once % max(1, len(found)), minlength=len(found))
        for number, found in enumerate([totals, *sums], -1):
            some = np.flatnonzero(found)
            columns = [np.full(len(some), number, np.int32), some.astype(np.int32), found[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "term", "n"])

    return run


class Scorer:
    """Scores of a block's items on some documents, by one fill of the shared accumulators."""

    def __init__(self, plan: Plan, df: np.ndarray, docs: int, total: int) -> None:
        self.plan, self.docs, self.total = plan, docs, total
        self.finder = Terms(list(plan.terms))
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(n) + 1))) for n in df]
        self.weight = np.array(weight, np.int64)
        self.by_term = np.argsort(plan.leaves[:, 0], kind="stable")
        self.uses = np.bincount(plan.leaves[:, 0], minlength=len(plan.terms))
        self.begin = np.cumsum(self.uses) - self.uses
        self.nodes = len(plan.leaves) + len(plan.pairs)
        self.at_once = max(1, min(1024, FILLED_BYTES // (8 * max(1, self.nodes + len(plan.parts)))))

    def scores(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, items x documents) for runs of documents."""
        counts = words.counts()
        owner = np.repeat(np.arange(len(counts)), counts)
        at, term = self.finder.find(words)
        size = max(1, len(self.weight))
        pair, tf = np.unique(owner[at] * size + term, return_counts=True)
        doc, term = pair // size, pair % size
        m = 25 + 75 * counts[doc].astype(np.int64) * self.docs // max(1, self.total)
        value = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        leaf = self.by_term[ranges(self.begin[term], self.uses[term])]
        doc, value = np.repeat(doc, self.uses[term]), np.repeat(value, self.uses[term])
        value = value * self.plan.leaves[leaf, 1]
        plan, base = self.plan, len(self.plan.leaves)
        for low in range(0, len(counts), self.at_once):
            high = min(low + self.at_once, len(counts))
            a, b = np.searchsorted(doc, [low, high])
            if a == b:
                continue
            filled = np.zeros((self.nodes, high - low), np.int64)
            filled[leaf[a:b], doc[a:b] - low] = value[a:b]
            done = 0
            for level in plan.levels:
                filled[base + done : base + level] = filled[plan.pairs[done:level, 0]] + filled[plan.pairs[done:level, 1]]
                done = level
            yield low, np.add.reduceat(filled[plan.parts], plan.first[:-1], axis=0)


class Best:
    """The best documents of each item so far; equal scores by ascending key, a null key last."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.least = np.ones(items, np.int64)
        self.held: list[pa.Table] = []
        self.count = 0

    def add(self, item: np.ndarray, score: np.ndarray, keys: pa.Array) -> None:
        self.held.append(pa.table({"item": item.astype(np.int32), "score": score, "key": keys}))
        self.count += len(item)
        if self.count > HELD:
            self.cut()

    def cut(self) -> pa.Table | None:
        if not self.held:
            return None
        table = pa.concat_tables(self.held).combine_chunks()
        table = table.sort_by([("item", "ascending"), ("score", "descending"), ("key", "ascending")])
        item = table.column("item").to_numpy()
        begin = np.searchsorted(item, np.arange(self.items))
        place = np.arange(len(item)) - begin[item]
        last = place == self.top - 1
        self.least[item[last]] = table.column("score").to_numpy()[last]
        self.held = [table.filter(pa.array(place < self.top))]
        self.count = self.held[0].num_rows
        return self.held[0]


def _searched(plans: list[Plan], dfs: list[np.ndarray], docs: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(p, df, docs, total) for p, df in zip(plans, dfs, strict=True)]
        best = [Best(len(p.items), top) for p in plans]
        for batch in slices(batches, "text"):
            words = Words(*raw_bytes(batch.column("text")), ALNUM)
            keys = batch.column("row_key")
            for scorer, mine_ in zip(scorers, best, strict=True):
                for low, scores in scorer.scores(words):
                    item, doc = np.nonzero(scores >= mine_.least[:, None])
                    if len(item):
                        mine_.add(item, scores[item, doc], keys.take(pa.array(doc + low)))
        for number, (plan, mine_) in enumerate(zip(plans, best, strict=True)):
            found = mine_.cut()
            for part in found.to_batches() if found is not None else ():
                slot = part.column("item")
                columns = [pa.array(np.full(part.num_rows, number, np.int32)), slot, plan.items.take(slot), part.column("key"), part.column("score")]
                yield pa.RecordBatch.from_arrays(columns, ["block", "slot", "item", "row_key", "score"])

    return run


def _passes(plans: DataFrame, most: int) -> list[list[int]]:
    """Blocks in runs whose plans have at most ``most`` bytes together."""
    runs, size = [], most + 1
    for block, length in plans.select("block", F.length("plan")).orderBy("block").collect():
        if size + length > most:
            runs.append([])
            size = 0
        runs[-1].append(block)
        size += length
    return runs


def search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents of each item with a score above 0.

    Terms are runs of letters, digits and all characters above ASCII, lower-cased from A to Z.
    A term's weight is floor(1000 ln((2N+2)/(2df+1))), its part in a document
    weight * (10^9 tf div (1000 tf + 8 (25 + 75 n N div L))), and a score the sum over the item's
    terms, repeats included. Equal scores rank by ascending key, a null key last. Rows of
    either table that repeat a key are judged one by one; null and empty texts have no terms,
    and match nothing. Other columns are not read.

    Tasks return at most ``top`` documents per item; these are ranked in ``SALTS`` groups per
    item first. Documents are read twice (statistics, scores) per ``pass_bytes`` of plans.
    """
    rows = picked(docs, row_key=key, text=text)
    asked = picked(items, item=item, text=item_text)
    kinds = {"item": dict(asked.dtypes)["item"], "row_key": dict(rows.dtypes)["row_key"]}
    size = asked.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    dealt = asked.where(F.length("text") > 0).withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    dealt = stored(dealt)
    plans = dealt.groupBy("block").applyInArrow(lambda k, t: _mined(t).append_column("block", pa.array([k[0].as_py()], pa.int64())).select(["block", "plan"]), "block long, plan binary")
    plans = stored(plans)
    schema = f"block int, slot int, item {kinds['item']}, row_key {kinds['row_key']}, score long"
    runs = _passes(plans, pass_bytes)
    best = None
    for number, run in enumerate(runs):
        mine_ = [pickle.loads(r.plan) for r in plans.where(F.col("block").isin(run)).orderBy("block").collect()]
        sums = rows.select("text").mapInArrow(_counted(mine_), "block int, term int, n long")
        found = sums.groupBy("block", "term").agg(F.sum("n").alias("n")).collect()
        totals = {r.term: r.n for r in found if r.block == -1}
        dfs = [np.zeros(len(p.terms), np.int64) for p in mine_]
        for r in found:
            if r.block >= 0:
                dfs[r.block][r.term] = r.n
        part = rows.mapInArrow(_searched(mine_, dfs, totals.get(0, 0), totals.get(1, 0), top), schema)
        part = part.withColumn("run", F.lit(number))
        if len(runs) > 1:  # a pass's plans need not be held for the next one
            part = stored(part)
        best = part if best is None else best.union(part)
    if best is None:
        best = docs.sparkSession.createDataFrame([], schema + ", run int")
    best = best.withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("row_key").asc_nulls_last()]
    each = ["run", "block", "slot"]
    for group in ([*each, "salt"], each):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
    return best.select(F.col("item").alias(item), "rank", F.col("row_key").alias(key), "score")
