"""Denoising corruption of token sequences, in array expressions.

Each step changes the tokens between the first and the last one of a row. All draws
are md5 of (seed, step, row, place): a retried or moved task repeats them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions.arrays import fraction, fraction_digits

#: Draws have 28 bits; the table of the Poisson distribution ends where they no longer tell.
_DRAW = 2.0**-28


@dataclass(frozen=True)
class Noise:
    """Shares of sentences moved, of ids inserted and masked, and of rows rotated."""

    permute: float = 0.0
    insert: float = 0.0
    mask: float = 0.3
    rotate: float = 0.0
    poisson_lambda: float = 3.0
    mask_random: float = 0.1
    mask_id: int = 423
    stop: int = dims.EOS
    vocab_size: int = 424


def poisson_table(mean: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... up to the last one that a draw can tell from 1."""
    term = total = math.exp(-mean)
    out = []
    while total < 1 - _DRAW and (not out or total > out[-1]):
        out.append(total)
        term *= mean / len(out)
        total += term
    return out


class _Steps:
    """The steps on ``body``, the tokens between the frame; temporary columns start with two underscores."""

    def __init__(self, noise: Noise, seed: int, row: str) -> None:
        self.noise, self.seed, self.row = noise, seed, F.col(row)

    def draw(self, salt: str, place: Column | int = 0) -> Column:
        return fraction(self.seed, self.row, salt, place)

    def digits(self, salt: str, place: Column) -> Column:
        """The draw as seven hex digits, which sort as it does."""
        return fraction_digits(self.seed, self.row, salt, place)

    def shuffled(self, salt: str, count: Column) -> Column:
        """0 .. count - 1 in random order."""
        places = F.transform(_upto(count), lambda i: F.struct(self.digits(salt, i).alias("h"), i.alias("i")))
        return F.transform(F.sort_array(places), lambda x: x["i"])

    def filler(self, salt: str, place: Column) -> Column:
        """The mask id, or at times a random id."""
        other = F.floor(self.draw(f"{salt}-id", place) * (self.noise.vocab_size - 1)) + 1
        random = self.draw(f"{salt}-random", place) < self.noise.mask_random
        return F.when(random, other).otherwise(F.lit(self.noise.mask_id)).cast("int")

    def permute(self, df: DataFrame) -> DataFrame:
        """A share of the sentences trade places; a sentence ends with the stop id."""
        body, size = F.col("__body"), F.size("__body")
        heads = F.filter(_upto(size), lambda i: (i == 0) | (F.get(body, i - 1) == self.noise.stop))
        df = df.withColumn("__heads", heads)
        heads, count = F.col("__heads"), F.size("__heads")
        chosen = F.slice(self.shuffled("permute", count), F.lit(1), F.ceil(count * self.noise.permute).cast("int"))
        df = df.withColumn("__chosen", chosen).withColumn("__places", F.sort_array("__chosen"))
        chosen, places = F.col("__chosen"), F.col("__places")

        def sentence(j: Column) -> Column:
            end = F.coalesce(F.get(heads, j + 1), size)
            return F.slice(body, F.get(heads, j) + 1, end - F.get(heads, j))

        def moved(j: Column) -> Column:
            return F.coalesce(F.get(chosen, (F.array_position(places, j) - 1).cast("int")), j)

        return df.withColumn("__body", F.flatten(F.transform(_upto(count), lambda j: sentence(moved(j)))))

    def insert(self, df: DataFrame) -> DataFrame:
        """New ids at random places, by the length with the frame."""
        count = F.ceil((F.size("__body") + 2) * self.noise.insert).cast("int")
        df = df.withColumn("__total", F.size("__body") + count)
        df = df.withColumn("__new", F.slice(self.shuffled("insert", F.col("__total")), F.lit(1), count))
        old = F.array_except(_upto(F.col("__total")), F.col("__new"))
        kept = F.zip_with(old, "__body", lambda p, x: F.struct(p.alias("p"), x.cast("int").alias("x")))
        added = F.transform("__new", lambda p: F.struct(p.alias("p"), self.filler("insert", p).alias("x")))
        return df.withColumn("__body", F.transform(F.sort_array(F.concat(kept, added)), lambda s: s["x"]))

    def mask(self, df: DataFrame) -> DataFrame:
        """Spans of Poisson length become one mask each, an empty span inserts one.

        Spans are drawn until they cover the budget, the share of the tokens to be masked; the last one
        is cut or stretched to it. They lie in different gaps between the tokens that
        stay, so none overlap and the budget is met exactly; where spans outnumber the gaps,
        those of one gap share a mask.
        """
        table = F.array(*[F.lit(t) for t in poisson_table(self.noise.poisson_lambda)])
        budget = F.ceil(F.size("__body") * self.noise.mask).cast("int")
        df = df.withColumn("__budget", budget).withColumn("__gaps", F.size("__body") - F.col("__budget") + 1)
        budget, gaps = F.col("__budget"), F.col("__gaps")

        def drawn(u: Column, i: Column) -> Column:
            return F.when(i + 1 == budget, budget).otherwise(F.size(F.filter(table, lambda t: t <= u)))

        def fitted(acc: Column, length: Column) -> Column:
            rest = budget - acc["sum"]
            more = F.concat(acc["lengths"], F.array(F.least(length, rest)))
            return F.when(rest > 0, F.struct((acc["sum"] + length).alias("sum"), more.alias("lengths"))).otherwise(acc)

        empty = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("lengths"))
        # drawn before the lookup, whose lambda would draw again for each entry of the table
        draws = F.transform(_upto(budget), lambda i: self.draw("length", i))
        df = df.withColumn("__drawn", F.transform(draws, drawn))
        df = df.withColumn("__lengths", F.aggregate("__drawn", empty, fitted, lambda acc: acc["lengths"]))
        lengths, spans = F.col("__lengths"), F.size("__lengths")
        df = df.withColumn("__order", self.shuffled("gap", gaps))

        def shared(q: Column) -> Column:
            mine = F.filter(lengths, lambda _, j: j % gaps == q)
            return F.aggregate(mine, F.lit(0), lambda a, x: a + x)

        # the order is an argument here: looked up inside a lambda, Spark would draw it again for each span
        fewer = F.when(spans <= gaps, lengths).otherwise(F.transform(_upto(gaps), shared))
        placed = F.zip_with(
            F.slice("__order", F.lit(1), F.least(spans, gaps)), fewer,
            lambda gap, length: F.struct(gap.alias("gap"), length.alias("length")),
        )
        df = df.withColumn("__spans", F.sort_array(placed))
        body = F.col("__body")

        def replaced(acc: Column, span: Column) -> Column:
            start = span["gap"] + acc["gone"]
            kept = F.slice(body, acc["end"] + 1, start - acc["end"])
            return F.struct(
                (start + span["length"]).alias("end"),
                (acc["gone"] + span["length"]).alias("gone"),
                F.concat(acc["out"], kept, F.array(self.filler("mask", span["gap"]))).alias("out"),
            )

        begin = F.struct(
            F.lit(0).alias("end"), F.lit(0).alias("gone"), F.array().cast("array<int>").alias("out")
        )
        tail = lambda acc: F.concat(acc["out"], F.slice(body, acc["end"] + 1, F.size(body) - acc["end"]))
        return df.withColumn("__body", F.aggregate("__spans", begin, replaced, tail))

    def rotate(self, df: DataFrame) -> DataFrame:
        """Roll the tokens of a share of the rows."""
        offset = F.floor(self.draw("offset") * F.size("__body")).cast("int")
        rolled = F.concat(
            F.slice("__body", offset + 1, F.size("__body") - offset), F.slice("__body", F.lit(1), offset)
        )
        return df.withColumn("__body", F.when(self.draw("rotate") < self.noise.rotate, rolled).otherwise(F.col("__body")))


def _upto(count: Column) -> Column:
    """0 .. count - 1, empty below one."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def denoise_corrupt(
    rows: DataFrame, noise: Noise, seed: int = 0, row: str = "example_id", column: str = "note_seq"
) -> DataFrame:
    """Noise in the order permute, insert, mask, rotate; ``labels`` stay clean.

    Rows must be framed by begin and end tokens, which keep their places. Rows of
    fewer than three tokens stay as they are, and a null row stays null.
    """
    steps = _Steps(noise, seed, row)
    ids = F.col(column).cast("array<int>")
    size = F.size(ids)
    out = rows.withColumn("__body", F.when(size > 2, F.slice(ids, F.lit(2), size - 2)).otherwise(F.array()))
    for share, step in (
        (noise.permute, steps.permute), (noise.insert, steps.insert),
        (noise.mask, steps.mask), (noise.rotate, steps.rotate),
    ):
        if share > 0:
            out = step(out)
    framed = F.concat(F.slice(ids, F.lit(1), F.lit(1)), F.col("__body"), F.slice(ids, F.lit(-1), F.lit(1)))
    out = out.withColumn("labels", F.col(column)).withColumn("input_ids", F.when(size > 2, framed).otherwise(ids))
    out = out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))
    return out.select(*[c for c in rows.columns if c not in ("labels", "input_ids", "attention_mask")], "labels", "input_ids", "attention_mask")
