"""Token-array rules that stay inside one row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import dims


def repeated(value, times: Column) -> Column:
    """``value`` repeated, empty for a count below one."""
    item = F.lit(value) if not isinstance(value, Column) else value
    return F.array_repeat(item, F.greatest(times, F.lit(0)).cast("int"))


def pad_to(ids: Column, length: Column, pad: int) -> Column:
    return F.concat(ids, repeated(pad, length - F.size(ids)))


def pad_or_cut(ids: Column, maxlen: int, pad: int = dims.PAD, cut: bool = True) -> Column:
    """Pad at the end; of a longer array keep the last ``maxlen`` items, all without ``cut``."""
    if not cut:
        return pad_to(ids, F.lit(maxlen), pad)
    start = F.greatest(F.size(ids) - maxlen, F.lit(0)) + 1
    return pad_to(F.slice(ids, start, F.lit(maxlen)), F.lit(maxlen), pad)


def shift_right(ids: Column, sos: int) -> Column:
    return F.concat(F.array(F.lit(sos)), ids)


def without_meta_offset(meta: Column) -> Column:
    return F.transform(meta, lambda x: x - dims.META_OFFSET)


def frame_tokens(ids: Column, bos: int, eos: int) -> Column:
    """Add begin and end tokens where they are missing; empty gives null."""
    ended = F.when(F.element_at(ids, -1) != eos, F.concat(ids, F.array(F.lit(eos)))).otherwise(ids)
    begun = F.when(
        F.element_at(ids, 1) != bos, F.concat(F.array(F.lit(bos)), ended)
    ).otherwise(ended)
    return F.when(F.size(ids) > 0, begun)


def strip_special(ids: Column, special: Sequence[int], eos: int) -> Column:
    kept = F.filter(ids, lambda x: ~x.isin(*special))
    return F.concat(kept, F.array(F.lit(eos)))


def fraction_digits(seed: int, row: Column, salt, place: Column) -> Column:
    """The seven hex digits behind ``fraction``."""
    text = F.concat_ws("-", F.lit(f"{seed}-{salt}"), row.cast("string"), place.cast("string"))
    return F.substring(F.md5(text), 1, 7)


def fraction(seed: int, row: Column, salt, place: Column | int = 0) -> Column:
    """Reproducible number in [0, 1) with 28 bits, from md5 of seed, row and place."""
    place = F.lit(place) if isinstance(place, int) else place
    digits = fraction_digits(seed, row, salt, place)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(16**7))


def random_below(limit: Column, seed: int, row: Column, salt: str, place=0) -> Column:
    """Reproducible integer in [0, limit)."""
    return F.floor(fraction(seed, row, salt, place) * limit).cast("int")


def bracketed(ids: Column) -> Column:
    """Ids as the text of a list: [1, 2, 3]."""
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]"))


def mlm_mask(
    ids: Column, seed: int, row: Column, rate: float = 0.15
) -> tuple[Column, Column]:
    """Masked ids and labels behind a start token.

    A chosen token becomes the mask id (80%), a random note or attribute id (10%)
    or stays (10%); labels hold the original where chosen, else 0.
    """
    low, high = dims.NOTE_START, dims.META_END

    def masked(x, i):
        r = fraction(seed, row, "mask", i) / rate
        other = random_below(F.lit(high - low + 1), seed, row, "token", i) + low
        return F.when(r >= 0.9, x).when(r >= 0.8, other).otherwise(F.lit(dims.MASK))

    def chosen(i):
        return fraction(seed, row, "mask", i) < rate

    out = F.transform(ids, lambda x, i: F.when(chosen(i), masked(x, i)).otherwise(x))
    labels = F.transform(ids, lambda x, i: F.when(chosen(i), x).otherwise(F.lit(dims.PAD)))
    return shift_right(out, dims.SOS), shift_right(labels, dims.SOS)


def random_crop(ids: Column, maxlen: int, seed: int, row: Column) -> Column:
    """``maxlen`` ids from a random offset in [0, length - maxlen)."""
    spare = F.greatest(F.size(ids) - maxlen, F.lit(0))
    return F.slice(ids, random_below(spare, seed, row, "crop") + 1, F.lit(maxlen))

