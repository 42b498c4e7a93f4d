"""License scans by diagonal voting, in DataFrame functions alone.

All rolling pairs of words of all documents are joined by hash to their places in license
templates. A pair at word p of a document and word t of a template votes for the diagonal
p - t; a passage that follows a template puts its votes on one diagonal, and on diagonals
next to it where words were put in or left out. Votes of a diagonal are a bit set over
template places, so that counting is idempotent and pre-aggregated before the shuffle;
neighbouring diagonals are merged, and a span counts when its places are covered densely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import LOWER, UPPER

#: Phrases that every scan reports, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates of the method's own: names of other licenses, and well-known notice passages.
OWN = {
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "creative commons": "cc",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met": "bsd",
    "this work is licensed under a creative commons attribution": "cc",
}
#: Diagonals this near are one passage; share of a template's pairs that makes a label; density inside the span.
NEIGHBOUR, COVER, DENSITY = 2, 0.6, 0.6
#: Longer templates need this many votes on a diagonal before it is looked at.
MIN_VOTES = 2

_BREAKS = "".join(chr(c) for c in [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def template_rows(base: dict[str, str] | None = None, own: dict[str, str] | None = None) -> list[tuple]:
    """(gram, place, template, label, is_base, pairs): the word pairs of the templates."""
    out = []
    listed = [(t, label, True) for t, label in (BASE if base is None else base).items()]
    listed += [(t, label, False) for t, label in (OWN if own is None else own).items()]
    for number, (text, label, is_base) in enumerate(listed):
        words = text.split(" ")
        if not 2 <= len(words) <= 64:
            raise ValueError("templates have 2 to 64 words")
        for place in range(len(words) - 1):
            out.append((" ".join(words[place : place + 2]), place, number, label, is_base, len(words) - 1))
    return out


#: Marks that end a document's list of pairs; they hold no space, so no pair equals them.
_END, _EMPTY = "", "0"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z is lower-cased; null has none."""
    blank = " " * len(_BREAKS)
    # one pass maps capitals and breaks; upper case first, since A-Z is outside the breaks
    flat = F.translate(F.coalesce(text, F.lit("")), UPPER + _BREAKS, LOWER + blank)
    return F.array_remove(F.split(flat, " "), "")


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    base: dict[str, str] | None = None,
    own: dict[str, str] | None = None,
) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts places where a base phrase's words stand consecutively, first_word and
    last_word are the least and greatest start (null if none). ``labels`` adds templates
    covered to ``COVER`` or more; score is the greatest share of a template covered. Null
    and empty texts have no words, no labels and score 0. Rows that repeat key and text
    repeat their answer; rows that only repeat the key are told apart by a hash of the text.
    Only key and text are read. The broadcast table is the constant templates.
    """
    spark = docs.sparkSession
    ends = [(_END, 0, -1, "", False, 1), (_EMPTY, 0, -2, "", False, 1)]
    rows = template_rows(base, own) + ends
    grams = spark.createDataFrame(rows, "t_gram string, place int, template int, label string, is_base boolean, pairs int")
    grams = grams.withColumn("t_hash", F.xxhash64("t_gram"))
    words = docs.select(F.col(key).alias("row_key"), F.xxhash64(text).alias("row_hash"), words_of(F.col(text)).alias("w"))
    pairs = F.zip_with(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))),
        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    mark = F.when(F.size("w") == 0, F.lit(_EMPTY)).otherwise(F.lit(_END))
    rolled = words.select("row_key", "row_hash", F.posexplode(F.concat(pairs, F.array(mark))).alias("pos", "gram"))
    same = (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))
    votes = rolled.join(F.broadcast(grams), same)
    row = ["row_key", "row_hash"]
    voted = votes.groupBy(
        *row, "template", "label", "is_base", "pairs", (F.col("pos") - F.col("place")).alias("diagonal")
    ).agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"), F.count("*").alias("copies"))
    n = F.bit_count("bits")
    voted = voted.where((F.col("template") < 0) | (n >= F.least(F.col("pairs"), F.lit(MIN_VOTES))))
    order = Window.partitionBy(*row, "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    begins = F.col("is_base") | gap.isNull() | (gap > NEIGHBOUR)
    spans = voted.withColumn("begins", begins.cast("int"))
    spans = spans.withColumn("span", F.sum("begins").over(order))
    spans = spans.groupBy(*row, "template", "label", "is_base", "pairs", "span").agg(
        F.bit_or("bits").alias("bits"), F.min("diagonal").alias("diagonal"), F.max("copies").alias("copies")
    )
    cover = F.bit_count("bits") / F.col("pairs")
    # places from the lowest to the highest set bit
    reach = F.length(F.regexp_replace(F.bin("bits"), "0+$", ""))
    dense = F.bit_count("bits") / reach >= DENSITY
    place = F.when(F.col("is_base") & (F.bit_count("bits") == F.col("pairs")), F.col("diagonal"))
    named = F.when(place.isNotNull() | ((F.col("template") >= 0) & ~F.col("is_base") & (cover >= COVER) & dense), F.col("label"))
    totals = spans.groupBy(*row).agg(
        F.max(F.when(F.col("template") == -1, F.col("diagonal") + 1).when(F.col("template") == -2, 0)).alias("n_words"),
        F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"),
        F.max(place).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(place.isNotNull(), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(named)), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, cover)), F.lit(0.0)).alias("score"),
        F.max(F.when(F.col("template") < 0, F.col("copies"))).alias("copies"),
    )
    totals = totals.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return totals.select(
        F.col("row_key").alias(key),
        F.col("n_words").cast("long").alias("n_words"),
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        "labels",
        "score",
    )


def oracle() -> str:
    """The same result in DuckDB SQL, over documents(doc_id, text)."""
    rows = ",\n".join(f"('{g}', {p}, {t}, '{label}', {b}, {n})" for g, p, t, label, b, n in template_rows())
    lower = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(gram, place, template, label, is_base, pairs) AS (VALUES {rows}),
r AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1),
v AS (SELECT doc_id, template, label, is_base, pairs, i - 1 - place AS diagonal, bit_or(CAST(1 AS BIGINT) << place) AS bits
      FROM r JOIN t ON t.gram = r.w[i] || ' ' || r.w[i + 1] GROUP BY ALL),
f AS (SELECT *, diagonal - lag(diagonal) OVER o AS gap FROM v WHERE bit_count(bits) >= least(pairs, {MIN_VOTES})
      WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
s AS (SELECT *, sum(CASE WHEN is_base OR gap IS NULL OR gap > {NEIGHBOUR} THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM f),
m AS (SELECT doc_id, label, is_base, pairs, bit_or(bits) AS bits, min(diagonal) AS diagonal
      FROM s GROUP BY doc_id, template, label, is_base, pairs, span),
c AS (SELECT *, bit_count(bits) / pairs AS cover, is_base AND bit_count(bits) = pairs AS placed,
             bit_count(bits) / length(regexp_replace(ltrim(CAST(CAST(bits AS BIT) AS VARCHAR), '0'), '0+$', '')) AS dense FROM m),
a AS (SELECT doc_id, count(*) FILTER (placed) AS n_base, min(diagonal) FILTER (placed) AS first_word,
             max(diagonal) FILTER (placed) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (placed) AS base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label)
               FILTER (placed OR (NOT is_base AND cover >= {COVER} AND dense >= {DENSITY})) AS labels,
             max(cover) AS score FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id)"""


__all__ = ["BASE", "OWN", "SparkSession", "oracle", "scan", "template_rows", "words_of"]
