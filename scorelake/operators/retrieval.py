"""Passage retrieval by vector and recording lookup by note fingerprints."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.functions.arrays import bracketed
from scorelake.functions.scalars import parse_ids
from scorelake.operators.tokens import order_notes
from scorelake.session import cut_lineage

#: Passages scored at once.
TILE_ROWS = 512
#: Query vectors sent to every task at once, in bytes.
QUERY_BYTES = 64 << 20
#: Queries scored at once against a tile.
QUERIES_AT_ONCE = 4096
SCORE_DECIMALS = 9
#: Library prints of a block.
BLOCK_PRINTS = 1 << 20
#: Library prints walked at once inside a block, and pairs of prints held at once.
RANGE_ROWS = 1 << 18
PAIRS_AT_ONCE = 1 << 21
#: What makes two prints equal, and the columns of the prints of both sides, their recording first.
MARK = ["pitch", "interval", "gap"]
ASKED, KNOWN = ["query_id", "qt", "qn", *MARK], ["candidate", "tick", "n", *MARK]


def title_and_body(rows: DataFrame, ids: str = "ids", size: int = 5) -> DataFrame:
    """First ids as the title, and all ids but the last."""
    return rows.withColumns(
        {"title": F.slice(ids, 1, size), "body": F.slice(ids, 1, F.size(ids) - 1)}
    )


class _Queries:
    """A block of query vectors with the best passages found so far for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, n_docs: int) -> None:
        self.ids, self.vectors, self.n_docs = ids, vectors, n_docs
        self.norms = np.linalg.norm(vectors, axis=1)
        self.best = np.full((len(ids), n_docs), -np.inf)
        self.passages = np.full((len(ids), n_docs), -1, np.int64)
        self.tiles = self.skipped = 0

    def scan(self, ids: np.ndarray, docs: np.ndarray) -> None:
        """Score a tile for the queries that may still gain from it.

        The inner product with any passage of the tile is at most that with the tile's centre
        plus the query's norm times the tile's radius.
        """
        centre = docs.mean(axis=0)
        radius = np.linalg.norm(docs - centre, axis=1).max()
        bound = self.vectors @ centre + self.norms * radius
        open_ = np.flatnonzero(bound + 10.0**-SCORE_DECIMALS + 1e-12 * np.abs(bound) >= self.best[:, -1])
        self.tiles += len(self.ids)
        self.skipped += len(self.ids) - len(open_)
        for low in range(0, len(open_), QUERIES_AT_ONCE):
            self._score(open_[low : low + QUERIES_AT_ONCE], ids, docs)

    def _score(self, asked: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> None:
        scores = np.round(self.vectors[asked] @ docs.T, SCORE_DECIMALS)
        keep = min(self.n_docs, len(ids))
        least = np.maximum(np.partition(scores, -keep, axis=1)[:, -keep], self.best[asked, -1])
        row, column = np.nonzero(scores >= least[:, None])  # all that tie with the last one stay in
        some = np.unique(row)
        old = np.repeat(some, self.n_docs)
        row = np.concatenate([old, row])
        score = np.concatenate([self.best[asked[some]].ravel(), scores[row[len(old) :], column]])
        name = np.concatenate([self.passages[asked[some]].ravel(), ids[column]])
        order = np.lexsort((name, -score, row))
        begin = np.searchsorted(row[order], some)
        first = order[begin[:, None] + np.arange(self.n_docs)]
        self.best[asked[some]], self.passages[asked[some]] = score[first], name[first]


def _cells(docs: np.ndarray, tile_rows: int) -> Iterator[np.ndarray]:
    """Rows of a batch in tiles of near vectors: by the nearest of some rows of the batch, far apart."""
    pivots = max(1, len(docs) // tile_rows)
    near = np.full(len(docs), np.inf)
    cell = np.zeros(len(docs), np.int64)
    pivot = 0
    for number in range(pivots):
        distance = ((docs - docs[pivot]) ** 2).sum(axis=1)
        cell[distance < near] = number
        near = np.minimum(near, distance)
        pivot = int(near.argmax())
    order = np.argsort(cell, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        for low in range(0, len(part), tile_rows):
            yield part[low : low + tile_rows]


def _scan_passages(queries: _Queries, tile_rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            ids, docs = batch["vec_id"].to_numpy(), np.stack(batch["embedding"].to_numpy()).astype("float64")
            for part in _cells(docs, tile_rows):
                queries.scan(ids[part], docs[part])
        rows, columns = np.nonzero(queries.passages >= 0)
        yield pd.DataFrame(
            {
                "query_id": queries.ids[rows],
                "vec_id": queries.passages[rows, columns],
                "score": queries.best[rows, columns],
                "tiles": queries.tiles,
                "skipped": queries.skipped,
            }
        )

    return run


def retrieve_topk(
    queries: DataFrame,
    passages: DataFrame,
    n_docs: int = 5,
    tile_rows: int = TILE_ROWS,
    query_bytes: int = QUERY_BYTES,
    report: bool = False,
) -> DataFrame:
    """Best passages per query by inner product, ties by passage id.

    ``queries`` is (query_id, vector), ``passages`` (vec_id, embedding), ids at least 0. Passages stay
    where they are: each task walks its own in tiles of near vectors, with a block of queries of at most
    ``query_bytes`` beside it, and returns its ``n_docs`` best per query. A tile is skipped
    for the queries whose best so far beats a bound on all its scores, so the result is
    exact. More queries mean more walks. Scores are rounded to 9 decimals so that equal vectors tie.

    ``report`` adds to each row how many (tile, query) pairs its task met and how many it skipped.
    """
    # an array's 8-byte numbers; the ids are small beside them
    size = queries.agg(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-8 * size // query_bytes))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    schema = "query_id bigint, vec_id bigint, score double, tiles bigint, skipped bigint"
    found = None
    for block in range(blocks):
        held = queries.where(number == block).select("query_id", "vector").toPandas()
        if held.empty:
            continue
        vectors = np.stack(held["vector"].to_numpy()).astype("float64")
        walk = _scan_passages(_Queries(held["query_id"].to_numpy(), vectors, n_docs), tile_rows)
        part = passages.select("vec_id", "embedding").mapInPandas(walk, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n_docs)
    return found if report else found.drop("tiles", "skipped")


def retrieved_context(
    hits: DataFrame, queries: DataFrame, texts: DataFrame, prefix: str = ""
) -> DataFrame:
    """Input ids of each query joined with each of its passages, last id dropped.

    ``queries`` is (query_id, meta ids), ``texts`` (vec_id, text).
    """
    rows = hits.join(queries, "query_id").join(texts, "vec_id")
    joined = F.concat(F.lit(prefix), bracketed(F.col("meta")), F.col("text"))
    rows = rows.withColumn("__ids", parse_ids(joined))
    return rows.withColumn(
        "context_ids", F.slice("__ids", F.lit(1), F.size("__ids") - 1)
    ).drop("__ids")


def fingerprints(notes: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Count of each (pitch, interval to the next note, ticks to it) per place."""
    # only what a print is made of is shuffled, and once
    held = notes.select(*keys, "note_idx", "pitch", "start_tick")
    rows = order_notes(held, keys, following={"p2": "pitch", "t2": "start_tick"})
    rows = rows.where(F.col("p2").isNotNull())
    return rows.groupBy(
        *keys, "pitch", (F.col("p2") - F.col("pitch")).alias("interval"),
        (F.col("t2") - F.col("start_tick")).alias("gap"), F.col("start_tick").alias("tick"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _codes(columns: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One number for each distinct row of the columns, the same for the rows of both sides."""
    size = len(columns[0][0])
    code = np.zeros(size + len(columns[0][1]), np.int64)
    for pair in columns:
        values, place = np.unique(np.concatenate(pair), return_inverse=True)
        code = np.unique(code * len(values) + place, return_inverse=True)[1]
    return code[:size], code[size:]


class _Library:
    """Prints of some recordings, by candidate range and print."""

    def __init__(self, prints: np.ndarray, candidate: np.ndarray, tick: np.ndarray, n: np.ndarray, ranges: int) -> None:
        self.ids, self.place = np.unique(candidate, return_inverse=True)
        self.low = tick.min()
        self.parts = []
        share = np.minimum(np.arange(ranges + 1) * -(-len(self.ids) // ranges), len(self.ids))
        part = np.searchsorted(share, self.place, side="right") - 1
        order = np.lexsort((self.place, prints, part))
        for number, rows in enumerate(np.split(order, np.searchsorted(part[order], np.arange(1, ranges)))):
            if len(rows):
                self.parts.append((prints[rows], self.place[rows] - share[number], tick[rows], n[rows], share[number]))


def _pairs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each asked print beside each of the ``count`` places from ``first`` on."""
    asked = np.repeat(np.arange(len(count)), count)
    return asked, np.arange(len(asked)) - np.repeat(np.cumsum(count) - count - first, count)


def _top_vote(place: np.ndarray, offset: np.ndarray, votes: np.ndarray) -> tuple[int, int, int]:
    """(votes, place, offset) of the most votes, then of the lowest place and offset."""
    low = offset.min()
    span = int(offset.max()) - int(low) + 1
    if span * (int(place.max()) + 1) < 2**63:
        key = place * span + (offset - low)
        if (votes == 1).all():
            key.sort()
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.diff(begin, append=len(key))
        else:
            order = np.argsort(key)
            key, votes = key[order], votes[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.add.reduceat(votes, begin)
        best = int(total.argmax())
        found = divmod(int(key[begin[best]]), span)
        return int(total[best]), found[0], found[1] + int(low)
    order = np.lexsort((offset, place))
    place, offset, votes = place[order], offset[order], votes[order]
    new = (place[1:] != place[:-1]) | (offset[1:] != offset[:-1])
    begin = np.flatnonzero(np.concatenate([[True], new]))
    total = np.add.reduceat(votes, begin)
    best = int(total.argmax())
    return int(total[best]), int(place[begin[best]]), int(offset[begin[best]])


def _count_votes(asked: pd.DataFrame, known: pd.DataFrame, so_far: pd.DataFrame | None = None) -> pd.DataFrame:
    """Best (candidate, offset) of each query among the recordings of one cell and ``so_far``, found in others.

    Candidates are walked range by range, lowest first. Once there is a best, only those are counted by
    offset whose votes at all offsets together beat it, or equal it where they might have
    the smaller id: no offset of the others can.
    """
    marks = [(asked[c].to_numpy(), known[c].to_numpy()) for c in MARK]
    mine, theirs = _codes(marks)
    library = _Library(
        theirs, known["candidate"].to_numpy(), known["tick"].to_numpy(), known["n"].to_numpy(),
        max(1, -(-len(known) // RANGE_ROWS)),
    )
    order = np.lexsort((mine, asked["query_id"].to_numpy()))
    mine, query = mine[order], asked["query_id"].to_numpy()[order]
    qt, qn = asked["qt"].to_numpy()[order], asked["qn"].to_numpy()[order]
    names, begin = np.unique(query, return_index=True)
    begin = np.append(begin, len(query))
    best = [(0, 0, 0)] * len(names)
    if so_far is not None:
        held = zip(so_far["votes"], so_far["candidate"], so_far["tick_offset"])
        for number, old in zip(np.searchsorted(names, so_far["query_id"]), held):
            best[number] = tuple(map(int, old))
    for prints, place, tick, n, shift in library.parts:
        first = np.searchsorted(prints, mine)
        count = np.searchsorted(prints, mine, side="right") - first
        single = (n == 1).all()
        for number in range(len(names)):
            low, high = begin[number], begin[number + 1]
            for rows in _bounded(count[low:high], place, first[low:high]):
                votes, candidate, _ = best[number]
                lowest = library.ids[place[rows[0][rows[1] > 0]].min() + shift]
                least = votes if candidate < lowest else max(0, votes - 1)
                found = _best_of(rows, place, tick, n, single, qt[low:high], qn[low:high], least)
                if found is not None:
                    name = int(library.ids[found[1] + shift])
                    if found[0] > votes or name < candidate:
                        best[number] = (found[0], name, found[2])
    out = [(q, b[1], b[2], b[0]) for q, b in zip(names, best) if b[0]]
    return pd.DataFrame(out, columns=["query_id", "candidate", "tick_offset", "votes"]).astype("int64")


def _bounded(count: np.ndarray, place: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, count) of the places per asked print, cut by candidate into at most about ``PAIRS_AT_ONCE`` pairs."""
    total = int(count.sum())
    if not total:
        return
    if total <= PAIRS_AT_ONCE:
        yield first, count
        return
    cuts = np.linspace(0, place.max() + 1, -(-total // PAIRS_AT_ONCE) + 1).astype(np.int64)
    ends = np.stack([f + np.searchsorted(place[f : f + c], np.unique(cuts)) for f, c in zip(first, count)], axis=1)
    for start, end in zip(ends[:-1], ends[1:]):
        if (end > start).any():
            yield start, end - start


def _best_of(rows, place, tick, n, single, qt, qn, least: int) -> tuple[int, int, int] | None:
    """The best (votes, place, offset) with more than ``least`` votes."""
    asked, at = _pairs(*rows)
    where, votes = place[at], None
    if not single or (qn != 1).any():
        votes = n[at] * qn[asked]
    if least:
        reach = np.bincount(where, votes)
        keep = np.flatnonzero(reach[where] > least)
        if not len(keep):
            return None
        asked, at, where = asked[keep], at[keep], where[keep]
        votes = votes if votes is None else votes[keep]
    found = _top_vote(where, tick[at] - qt[asked], np.ones(len(at), np.int64) if votes is None else votes)
    return found if found[0] > least else None


def _pack_block(columns: Sequence[str]):
    """One row for all prints of a block: the number of the block, then each column as bytes."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([columns[0], columns[1]])
        packed = {}
        for name in columns:
            steps = np.diff(group[name].to_numpy().astype("<i8"), prepend=0)
            packed[name] = [zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), 3)]
        return pd.DataFrame({"block": [int(key[0])], **packed})

    return run


def _unpack(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<i8").ravel())


def _packed(prints: DataFrame, columns: Sequence[str], blocks: int) -> DataFrame:
    """Prints in blocks of whole recordings (the first column), a file of one row each."""
    block = F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int").alias("block")
    schema = "block int, " + ", ".join(f"{c} binary" for c in columns)
    return cut_lineage(prints.groupBy(block).applyInPandas(_pack_block(columns), schema), maxRecordsPerFile="1")


def _vote_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best (candidate, offset) of each query among the cells of one task."""
    best: dict[int, pd.DataFrame] = {}
    for batch in batches:
        for row in batch.to_dict("records"):
            asked = pd.DataFrame({c: _unpack(row[f"asked_{c}"]) for c in ASKED})
            known = pd.DataFrame({c: _unpack(row[f"known_{c}"]) for c in KNOWN})
            best[row["asked_block"]] = _count_votes(asked, known, best.get(row["asked_block"]))
    yield from best.values()


def fingerprint_match(queries: DataFrame, library: DataFrame, block_prints: int = BLOCK_PRINTS) -> DataFrame:
    """Best (candidate, tick offset) of each query recording by matching prints; every match votes.

    Queries and library are cut by recording into blocks of about ``block_prints`` prints, and a task
    counts the votes of one block of each, query by query, so the votes never leave it. Blocks are
    written once; tasks read the pairs they count from there, so disk grows with the prints and not with the
    pairs of blocks, and a task hands on one row per query. Time is still that of all matching pairs,
    and the prints of one recording fit a task.
    """
    # a print without a pitch or a tick matches none
    asked = cut_lineage(fingerprints(queries).dropna(subset=MARK).select(
        *MARK, F.col("file_id").alias("query_id"), F.col("tick").alias("qt"), F.col("n").alias("qn")
    ))
    # written, so that Spark knows how few they are and leaves out other prints before it counts them
    marks = cut_lineage(asked.select(*MARK).distinct())
    known = cut_lineage(
        fingerprints(library).join(marks, MARK, "left_semi").select(
            *MARK, F.col("file_id").alias("candidate"), "tick", "n"
        )
    )
    # a block of queries holds twice as many prints: fewer times is the library read
    asked = _packed(asked, ASKED, max(1, -(-asked.count() // (2 * block_prints))))
    known = _packed(known, KNOWN, max(1, -(-known.count() // block_prints)))
    cells = known.toDF(*(f"known_{c}" for c in known.columns)).crossJoin(asked.toDF(*(f"asked_{c}" for c in asked.columns)))
    schema = "query_id bigint, candidate bigint, tick_offset bigint, votes bigint"
    found = cells.mapInPandas(_vote_cells, schema)
    best = F.max_by(
        F.struct("candidate", "tick_offset", "votes"),
        F.struct("votes", -F.col("candidate"), -F.col("tick_offset")),
    )
    return found.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.*")
