"""Line dedup over runs of lines: prefix doubling on line ranks, all in DataFrame operations.

Lines get ranks in the order of their digests. A round joins the rank of the prefix of a
place with the rank of the place right behind it and ranks the pairs by a distributed
sort, which doubles the length of the ranked prefixes; the last round overlaps the two
halves where the wanted length is no power of two. Places whose prefix is unique leave at
once, as nothing longer that starts there can repeat. What is left in the end are the
longest-common-prefix intervals of the wanted depth: the first place of each keeps its
lines, later ones lose them, and neighbouring places join to maximal repeated runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import stored

#: Least run of lines that counts as a copy.
MIN_RUN = 3


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """Repeated keys with a rank that follows the order of the keys.

    Rows are counted per key before the shuffle. Ids given out along a range-partitioned
    sort rise over the whole table; they are stored before they are used.
    """
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("places")).where("places > 1").select(*keys)
    ordered = repeated.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()))


def intervals(lines: DataFrame, min_run: int) -> DataFrame:
    """(row, doc, ln, rank) of places whose next ``min_run`` lines stand elsewhere too, alike ranks for alike lines."""
    level = stored(lines.join(_ranked(lines, "digest"), "digest").select("row", "doc", "ln", "rank"))
    width = 1
    while width < min_run:
        step = min(width, min_run - width)
        behind = level.select("row", (F.col("ln") - step).alias("ln"), F.col("rank").alias("rank2"))
        pairs = stored(level.withColumnRenamed("rank", "rank1").join(behind, ["row", "ln"]))
        groups = _ranked(pairs, "rank1", "rank2")
        level = stored(pairs.join(groups, ["rank1", "rank2"]).select("row", "doc", "ln", "rank"))
        width += step
    return level


def removed_runs(level: DataFrame, min_run: int) -> DataFrame:
    """(row, spans): the maximal runs [a, b) of lines that lie in later copies, in order."""
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "ln")
    first = level.groupBy("rank").agg(F.min(place).alias("first"))
    later = level.join(first, "rank").where((F.col("row") != F.col("first.row")) | (F.col("ln") != F.col("first.ln")))
    order = Window.partitionBy("row").orderBy("ln")
    gap = F.col("ln") - F.lag("ln").over(order)
    begins = (gap.isNull() | (gap > min_run)).cast("int")
    marked = later.select("row", "ln", begins.alias("begins")).withColumn("run", F.sum("begins").over(order))
    spans = marked.groupBy("row", "run").agg(F.min("ln").alias("a"), (F.max("ln") + min_run).alias("b"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup(docs: DataFrame, min_run: int = MIN_RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, n_lines, n_removed, n_runs, kept_text.

    Lines end at \\n and are compared whole. A line goes if it lies in ``min_run`` lines of one
    text that also start at an earlier place (smaller key, or earlier in the text; rows that
    repeat a key follow each other in any order; a null key comes last). Runs are judged on
    the input, may overlap, and never cross texts. n_runs counts maximal removed runs. Null
    counts as empty, and an empty text is one empty line; texts of fewer lines lose nothing.
    An empty table gives no rows; other columns are not read.
    """
    if min_run < 1:
        raise ValueError("min_run is at least 1")
    text_of = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc"), text_of.alias("text")))
    split = F.split("text", "\n", -1)
    lines = rows.select("row", "doc", F.posexplode(split).alias("ln", "line"))
    lines = lines.select("row", "doc", "ln", F.unhex(F.sha2("line", 256)).alias("digest"))
    runs = stored(removed_runs(intervals(stored(lines), min_run), min_run))
    none = F.array().cast("array<struct<a: int, b: int>>")
    found = rows.join(runs, "row", "left").select("doc", split.alias("lines"), F.coalesce("spans", none).alias("spans"))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["b"]))
    ends = F.concat(F.transform("spans", lambda s: s["a"]), F.array(F.size("lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("lines", a + 1, b - a)))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return found.select(
        F.col("doc").alias(key),
        F.size("lines").cast("long").alias("n_lines"),
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_runs"),
        F.array_join(kept, "\n").alias("kept_text"),
    )


def oracle(min_run: int = MIN_RUN) -> str:
    """DuckDB SQL for key, n_lines, n_removed, n_runs and the digest of the kept text, over documents."""
    run = " || chr(10) || ".join(f"w[i + {k}]" for k in range(min_run))
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
g AS (SELECT doc_id, i, {run} AS run FROM l WHERE i + {min_run - 1} <= len(w)),
later AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {min_run - 1})) AS i FROM later),
m AS (SELECT l.doc_id, l.i, w[l.i] AS line, gone.i IS NOT NULL AS out,
             coalesce(lag(gone.i IS NOT NULL) OVER (PARTITION BY l.doc_id ORDER BY l.i), false) AS before
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, count(*) FILTER (out AND NOT before) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
