"""Training tables: examples, splits, batches, padding and masking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions import arrays as a
from scorelake.functions.scalars import idiv
from scorelake.functions.scans import hash_below, hash_rank, spread_join

CATEGORY_AT = list(dims.ATTRIBUTES).index("track_category") + 1


def with_labels(rows: DataFrame, ids: Column) -> DataFrame:
    """``input_ids``, a mask of ones and labels that copy the ids."""
    out = rows.withColumn("input_ids", ids)
    return out.withColumns(
        {"attention_mask": F.array_repeat(F.lit(1), F.size("input_ids")), "labels": F.col("input_ids")}
    )


def concat_example(examples: DataFrame) -> DataFrame:
    return with_labels(examples, F.concat("meta", "note_seq"))


def track_category_example(
    examples: DataFrame, category: str | None = None, compat: bool = False
) -> DataFrame:
    """Examples of one track category; ``compat`` keeps others with attributes only."""
    if category is None:
        return concat_example(examples)
    unknown, offset = dims.ATTRIBUTES["track_category"]
    mine = F.element_at("meta", CATEGORY_AT) == dims.CATEGORY_CODES[category] + offset
    if not compat:
        return concat_example(examples.where(mine))
    return with_labels(
        examples, F.when(mine, F.concat("meta", "note_seq")).otherwise(F.col("meta"))
    )


def length_filter(
    rows: DataFrame, max_length: int, columns: Sequence[str] = ("input_ids",)
) -> DataFrame:
    for c in columns:
        rows = rows.where(F.size(c) <= max_length)
    return rows


def valid_size(
    rows: DataFrame, max_length: int, min_length: int = 16, columns: Sequence[str] = ("targets",)
) -> DataFrame:
    """Rows whose longest feature lies within the bounds."""
    sizes = [F.size(c) for c in columns]
    longest = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    return rows.where(longest.between(min_length, max_length))


def assign_batches(
    rows: DataFrame,
    size: Column | int,
    ids: Sequence[str] = ("example_id",),
    seed: int = 0,
    within: Sequence[str] = (),
) -> DataFrame:
    """Add ``batch``: ``size`` rows each in hash order, numbered from 0; only the last one may have fewer.

    Each group of rows that agree in ``within`` is batched by itself. The place of a row follows from
    counts per hash prefix and its place inside the prefix, so rows move once and no task orders all of them.
    """
    ranked = hash_rank(rows, ids, seed, "__rank", within=within)
    return ranked.withColumn("batch", idiv(F.col("__rank") - 1, size)).drop("__rank")


def padded_batch(
    rows: DataFrame,
    size: Column | int,
    pads: dict[str, int],
    ids: Sequence[str] = ("example_id",),
    seed: int = 0,
    within: Sequence[str] = (),
) -> DataFrame:
    """Batches whose array columns are padded to the longest row of the batch; ``batch_rows`` counts it."""
    return _pad(assign_batches(rows, size, ids, seed, within), pads, [*within, "batch"], "batch_rows")


def _pad(batches: DataFrame, pads: dict[str, int], batch: list[str], count: str | None = None) -> DataFrame:
    """Array columns padded to the longest of their batch: the lengths meet as one row per batch."""
    widths = {f"__w_{c}": F.max(F.size(c)) for c in pads} | ({count: F.count(F.lit(1))} if count else {})
    facts = batches.groupBy(*batch).agg(*[w.alias(n) for n, w in widths.items()])
    out = spread_join(batches, facts, batch)
    padded = {c: a.pad_to(F.col(c), F.col(f"__w_{c}"), pad) for c, pad in pads.items()}
    return out.withColumns(padded).select(*batches.columns, *([count] if count else []))


def example_pads(pad_id: int = dims.GPT_PAD) -> dict[str, int]:
    return {"input_ids": pad_id, "attention_mask": 0, "labels": pad_id}


def drop_partial_batches(batches: DataFrame, size: int) -> DataFrame:
    return batches.where(F.col("batch_rows") == size)


def pad_labels(batches: DataFrame, column: str = "labels") -> DataFrame:
    """Labels padded with 0 to the longest of their batch."""
    return _pad(batches, {column: 0}, ["batch"])


def relative_example(
    examples: DataFrame, maxlen: int = 512, sos: int = 422, cut: bool = True
) -> DataFrame:
    """Decoder input shifted by a start token, padded notes and shifted attributes.

    Without ``cut`` sequences longer than ``maxlen`` stay whole.
    """
    return examples.withColumns(
        {
            "dec_input": a.pad_or_cut(a.shift_right(F.col("note_seq"), sos), maxlen, cut=cut),
            "dec_output": a.pad_or_cut(F.col("note_seq"), maxlen, cut=cut),
            "enc_input": a.without_meta_offset(F.col("meta")),
        }
    )


def mlm_example(
    examples: DataFrame, seed: int = 0, rate: float = 0.15, row: str = "example_id"
) -> DataFrame:
    ids, labels = a.mlm_mask(F.concat("meta", "note_seq"), seed, F.col(row), rate)
    out = examples.withColumns({"input_ids": ids, "labels": labels})
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def rag_example(examples: DataFrame) -> DataFrame:
    sos = F.array(F.lit(dims.SOS))
    return examples.withColumn("input_ids", F.concat(sos, "meta", sos, "note_seq"))


def length_buckets(
    max_length: int, tokens_per_batch: int = 2048, first: int = 8
) -> tuple[list[int], list[int]]:
    """Least length of each bucket but the first, and the rows of a batch of each bucket.

    A bucket starts at ``first``, at each doubling of it and halfway between two doublings,
    so padding stays below half a row. As many rows make a batch as the token budget holds
    rows of the bucket's greatest length, at least one.
    """
    if first < 2:
        raise ValueError("first must be at least 2")
    octaves = [first << k for k in range(max_length.bit_length())]
    bounds = sorted(n for low in octaves for n in (low, low + low // 2) if n < max_length)
    longest = [*(n - 1 for n in bounds), max_length]
    return bounds, [max(1, tokens_per_batch // n) for n in longest]


def bucket_by_length(
    rows: DataFrame,
    max_length: int,
    column: str = "targets",
    tokens_per_batch: int = 2048,
    pad: int = dims.PAD,
    **batching,
) -> DataFrame:
    """Batches of rows of similar length, padded per batch."""
    bounds, sizes = length_buckets(max_length, tokens_per_batch)
    number = F.lit(0)
    for b in bounds:
        number = number + (F.size(column) >= b).cast("int")
    out = rows.withColumn("length_bucket", number)
    size = F.get(F.array(*[F.lit(n) for n in sizes]), F.col("length_bucket"))
    return padded_batch(out, size, {column: pad}, within=["length_bucket"], **batching)


def truncate_features(
    rows: DataFrame, max_inputs: int = 0, max_targets: int = 0, inputs: str = "inputs", targets: str = "targets"
) -> DataFrame:
    """The first ids of each feature that a row has; a limit of 0 keeps all."""
    limits = {inputs: max_inputs, targets: max_targets}
    cut = {c: F.slice(c, 1, n) for c, n in limits.items() if n > 0 and c in rows.columns}
    return rows.withColumns(cut) if cut else rows


def sample_n(rows: DataFrame, n: int, seed: int, ids: Sequence[str] = ("example_id",)) -> DataFrame:
    """Exactly ``n`` rows (or all), the first in hash order; ``ids`` name a row.

    The n-th hash is found from counts and the ids alone, so rows are only filtered.
    """
    if n <= 0:
        return rows.limit(0)
    return rows.where(hash_below(rows, ids, seed, lambda _: F.lit(n)))


def eval_subset(
    rows: DataFrame, n: int = 5000, seed: int = 1203, ids: Sequence[str] = ("example_id",)
) -> DataFrame:
    return sample_n(rows, n, seed, ids)


def split_by_ratio(
    rows: DataFrame,
    ratios: dict[str, float],
    rest: str = "train",
    seed: int = 2021,
    ids: Sequence[str] = ("example_id",),
) -> DataFrame:
    """Add ``split``: each named part has exactly ceil(ratio * n) rows, in hash order.

    As in ``sample_n`` no row is moved: the hashes where parts end are found first.
    """
    taken: list[float] = []
    ends = []
    for name, ratio in ratios.items():
        taken = [*taken, ratio]
        upto = lambda total, shares=tuple(taken): sum((F.ceil(F.lit(r) * total) for r in shares), F.lit(0))
        if any(taken):
            ends.append((name, hash_below(rows, ids, seed, upto)))
    split = F.lit(rest)
    for name, below in reversed(ends):
        split = F.when(below, name).otherwise(split)
    return rows.withColumn("split", split)


def split_train_val(
    rows: DataFrame, ratio: float = 0.1, seed: int = 2021, ids: Sequence[str] = ("example_id",)
) -> DataFrame:
    return split_by_ratio(rows, {"val": ratio}, seed=seed, ids=ids)


def combine_datasets(
    web: DataFrame,
    catalog: DataFrame,
    tagged: DataFrame,
    web_rows: int,
    ratio: float = 0.1,
    seed: int = 2021,
    ids: Sequence[str] = ("example_id",),
) -> DataFrame:
    """A sample of the web rows with all other rows, split into train and val."""
    mixed = sample_n(web, web_rows, seed, ids).unionByName(catalog).unionByName(tagged)
    return split_train_val(mixed, ratio, seed, ids)
