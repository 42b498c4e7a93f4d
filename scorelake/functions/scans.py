"""Ordered work per key that survives a key holding a large share of all rows.

A plain ``Window.partitionBy(file)`` sends all rows of one file to one task. The
helpers here cut each key's order into blocks instead. A block is a value that
never decreases along the order (``idx div size``, ``tick div size``, a date),
so a hot key is spread over as many tasks as it has blocks; only one summary row
per block meets in a single task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.session import cut_lineage

ROWS_PER_BLOCK = 50_000
TICKS_PER_BLOCK = 480 * 4 * 64
STEPS_PER_BLOCK = 100 * 60

_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is sum, max, min or last (nulls skipped).

    ``upto=True`` includes the current row, ``upto=False`` stops before it.
    Kinds prev and next are the value of the row before and after, null or not.
    """

    kind: str
    expr: Column
    upto: bool = True


def _fold(kind: str, expr: Column, order: Sequence[Column]) -> Column:
    """What a block hands on to the blocks after it (before it, for next)."""
    if kind == "last":
        return F.max_by(expr, F.when(expr.isNotNull(), F.struct(*order)))
    if kind in ("prev", "next"):
        ends = F.max_by if kind == "prev" else F.min_by
        return ends(F.struct(expr.alias("v")), F.struct(*order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr)


def _over(kind: str, expr: Column, window) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](expr).over(window)


def _upto(window, upto: bool):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow if upto else -1)


def _inside(spec: Running, window) -> Column:
    """A spec's value among the rows of ``window``."""
    if spec.kind in ("prev", "next"):
        shift = F.lag if spec.kind == "prev" else F.lead
        return shift(F.struct(spec.expr.alias("v"))).over(window)
    return _over(spec.kind, spec.expr, _upto(window, spec.upto))


def _merge(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if kind in ("prev", "next"):
        return F.coalesce(here, before)["v"]
    if kind == "last":
        return F.coalesce(here, before)
    return {"max": F.greatest, "min": F.least}[kind](before, here)


def _fenced(df: DataFrame) -> DataFrame:
    """The same rows behind a filter that names every column and always holds.

    Branches that read these rows then ask for the same columns, so Spark shuffles them
    once for all branches instead of reading the input again for each. The test of the
    partition number is not known ahead and comes first, so nothing is hashed.
    """
    return df.where((F.spark_partition_id() >= 0) | (F.xxhash64(*df.columns) == 0))


class Blocks:
    """Rows of each key cut into blocks and shuffled once.

    ``add`` brings running values, which may build on those added before, without
    moving the rows again: per call one summary row per block is shuffled twice.
    ``block`` must not decrease along the order; None asks for ``range_blocks``.
    A row without a key is in no order and is left out.
    """

    def __init__(
        self, df: DataFrame, keys: Sequence[str], block: Column | None, order: Sequence[str]
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        self.at = [*self.keys, _BLOCK]
        if self.keys:
            df = df.dropna(subset=self.keys)
        if block is None:
            df, block = range_blocks(df, keys, order), F.col("__range")
        df = df.withColumn(_BLOCK, block).drop("__range")
        self.df = _fenced(df.repartition(*self.at))

    def add(self, specs: dict[str, Running]) -> Blocks:
        """Running aggregates per key, first inside blocks, then across them."""
        rows = self.df
        order = [F.col(c) for c in self.order]
        totals = rows.groupBy(*self.at).agg(
            *[_fold(s.kind, s.expr, order).alias(f"__t_{n}") for n, s in specs.items()]
        )
        along = Window.partitionBy(*self.keys).orderBy(_BLOCK)
        carry = {}
        for n, s in specs.items():
            total = F.col(f"__t_{n}")
            if s.kind in ("prev", "next"):
                carry[n] = (F.lag if s.kind == "prev" else F.lead)(total).over(along)
            else:
                carry[n] = _over(s.kind, total, _upto(along, False))
        # most keys have one block, and nothing to carry
        carried = totals.select(*self.at, *[c.alias(f"__c_{n}") for n, c in carry.items()]).where(
            reduce(or_, [F.col(f"__c_{n}").isNotNull() for n in specs])
        )
        inside = Window.partitionBy(*self.at).orderBy(*self.order)
        here = rows.select("*", *[_inside(s, inside).alias(f"__h_{n}") for n, s in specs.items()])
        # hashing the few summary rows spares a second sort of the rows
        out = here.join(carried.hint("shuffle_hash"), self.at, "left").select(
            *[c for c in rows.columns if c not in specs],
            *[_merge(s.kind, F.col(f"__c_{n}"), F.col(f"__h_{n}")).alias(n) for n, s in specs.items()],
        )
        return self._with(_fenced(out))

    def with_columns(self, columns: dict[str, Column]) -> Blocks:
        """Columns computed from each row by itself."""
        return self._with(self.df.withColumns(columns))

    def _with(self, df: DataFrame) -> Blocks:
        out = object.__new__(Blocks)
        out.keys, out.order, out.at, out.df = self.keys, self.order, self.at, df
        return out

    def rows(self) -> DataFrame:
        return self.df.drop(_BLOCK)


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``__range``: blocks of about equal size along (keys, order).

    For data where even one tick or time bucket of a key may hold a large share of
    the rows. The bounds are sampled, so the result is pinned in the checkpoint
    folder before it is read twice.
    """
    # a stated number keeps adaptive execution from merging the blocks again
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *keys, *order)
    return cut_lineage(cut.withColumn("__range", F.spark_partition_id().cast("bigint")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: Column | None,
    order: Sequence[str],
    specs: dict[str, Running],
    whole: bool = False,
) -> DataFrame:
    """Add running aggregates per key (see ``Blocks``).

    ``whole`` takes one plain window per key: for keys that name a window or an
    example, which hold few rows by construction.
    """
    rest = [c for c in df.columns if c not in specs]
    if not whole:
        return Blocks(df, keys, block, order).add(specs).rows().select(*rest, *specs)
    every = Window.partitionBy(*keys).orderBy(*order)
    nothing = F.lit(None)
    return df.withColumns(
        {n: _merge(s.kind, _inside(s, every), nothing) for n, s in specs.items()}
    ).select(*rest, *specs)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    block: Column | None,
    order: Sequence[str],
    name: str,
    start: int = 0,
) -> DataFrame:
    """Dense index of each row in its key's order, counted from ``start``."""
    out = running(df, keys, block, order, {name: Running("sum", F.lit(1))})
    shift = F.col(name) + F.lit(start - 1)
    return out.withColumn(name, shift.cast("bigint"))


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    before: int = 0,
    after: int = 0,
    size: int = ROWS_PER_BLOCK,
) -> tuple[DataFrame, Window, Column]:
    """Blocks of a dense 0-based index, each with copies of its neighbours' rows.

    Returns the frame, the window to use ``lag``/``lead`` over (at most
    ``before``/``after`` rows away) and the test that keeps only original rows.
    """
    own = F.expr(f"`{idx}` div {size}")
    place = F.col(idx) % size
    homes = [F.struct(own.alias("b"), F.lit(True).alias("own"))]
    if before:
        nxt = F.struct((own + 1).alias("b"), F.lit(False).alias("own"))
        homes.append(F.when(place >= size - before, nxt))
    if after:
        prev = F.struct((own - 1).alias("b"), F.lit(False).alias("own"))
        homes.append(F.when(place < after, prev))
    homes = F.filter(F.array(*homes), lambda h: h.isNotNull())
    out = df.withColumn("__home", F.explode(homes))
    out = out.withColumns({_BLOCK: F.col("__home.b"), "__own": F.col("__home.own")}).drop("__home")
    return out, Window.partitionBy(*keys, _BLOCK).orderBy(idx), F.col("__own")


def near(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    specs: dict[str, tuple[str, int]],
    size: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add ``column`` of the row ``offset`` places away (negative is earlier)."""
    before = max([-o for _, o in specs.values() if o < 0], default=0)
    after = max([o for _, o in specs.values() if o > 0], default=0)
    out, window, own = with_halo(df, keys, idx, before, after, size)
    out = out.withColumns({n: F.lead(c, o).over(window) for n, (c, o) in specs.items()})
    return out.where(own).select(*df.columns, *specs)


def index_block(idx: str, size: int = ROWS_PER_BLOCK) -> Column:
    """Block of a non-negative integer column."""
    return F.expr(f"cast(`{idx}` as bigint) div {size}")


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join many rows per key to few rows per key, whatever share of the rows one key holds.

    The right side has a bounded number of rows per key, so the result does not grow
    beyond the left side. Adaptive execution broadcasts a small right side, and cuts the
    left rows of a hot key into several tasks, each beside a copy of the key's right rows.
    """
    return left.join(right, list(on), how)


def hash_text(seed: int, *cols: str) -> Column:
    """Reproducible 32-hex-digit order key of a row: md5 of seed and identity."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_below(
    df: DataFrame,
    ids: Sequence[str],
    seed: int,
    limit: Callable[[Column], Column],
    digits: int = 4,
) -> Column:
    """Whether a row of ``df`` is among the first in hash order, ``limit`` (of the row count) of them.

    Rows are counted per hash prefix (at most 16^digits groups). Of the prefix that holds the last
    row wanted, only hashes and ids are ranked; all other rows are judged by comparison
    with that row, so nothing wide is shuffled. ``limit`` must be at least 1; beyond the
    row count all rows are in. Rows that share their ids are in or out together.
    """
    def hashed(cols: list[str]) -> DataFrame:
        return df.select(*cols, hash_text(seed, *ids).alias("__hash"))

    prefix = F.substring("__hash", 1, digits)
    counts = hashed([]).groupBy(prefix.alias("__prefix")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__upto", upto)
    counts = counts.withColumn("__limit", limit(F.sum("__n").over(Window.partitionBy(F.lit(0)))))
    rest = F.col("__limit") - F.col("__upto") + F.col("__n")
    last = counts.where((rest > 0) & (F.col("__upto") >= F.col("__limit")))
    last = last.select(F.struct(F.col("__prefix").alias("p"), rest.alias("r")))
    edge = hashed(list(ids)).where(prefix == last.scalar()["p"])
    place = F.row_number().over(Window.orderBy("__hash", *ids))
    edge = edge.withColumn("__place", place).where(F.col("__place") == last.scalar()["r"])
    end = edge.select(F.struct("__hash", *ids)).scalar()
    here = F.struct(hash_text(seed, *ids).alias("__hash"), *ids)
    return F.coalesce(here <= end, F.lit(True))


def hash_rank(
    df: DataFrame,
    ids: Sequence[str],
    seed: int,
    name: str,
    digits: int = 4,
    within: Sequence[str] = (),
) -> DataFrame:
    """Exact 1-based rank of all rows in hash order without a global sort, per group of ``within``.

    Rows are counted per hash prefix (at most 16^digits per group), the counts are
    summed up over that table, and ranks are taken inside a prefix.
    """
    at = [*within, "__prefix"]
    hashed = df.withColumn("__hash", hash_text(seed, *ids))
    hashed = hashed.withColumn("__prefix", F.substring("__hash", 1, digits))
    counts = hashed.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*within).orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*at, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*at).orderBy("__hash", *ids)
    ranked = hashed.join(offsets, at).withColumn(
        name, (F.col("__offset") + F.row_number().over(inside)).cast("bigint")
    )
    return ranked.select(*[c for c in df.columns if c != name], name)
