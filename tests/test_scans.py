"""Blocked scans give the result of plain windows, whatever the block size."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.functions.scans import (
    Blocks,
    Running,
    hash_rank,
    index_block,
    near,
    ordinal,
    range_blocks,
    running,
    spread_join,
)
from scorelake.operators import chunks, notes, tokens
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to one file."""
    df = spark.range(6000).selectExpr(
        "if(id % 3 = 0, 0, 1 + id % 97) as file_id", "id",
        "cast(hash(id) % 50 as int) as v", "if(id % 4 = 0, id % 11, null) as gap",
    )
    order = Window.partitionBy("file_id").orderBy("id")
    return df.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint"))


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
@pytest.mark.parametrize("upto", [True, False])
def test_running(hot, size, upto):
    specs = {
        "s": Running("sum", F.col("v"), upto), "m": Running("max", F.col("v"), upto),
        "n": Running("min", F.col("v"), upto), "l": Running("last", F.col("gap"), upto),
    }
    got = running(hot, ["file_id"], index_block("idx", size), ["idx"], specs)
    end = Window.currentRow if upto else -1
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, end)
    want = hot.select(
        "id", F.coalesce(F.sum("v").over(w), F.lit(0)), F.max("v").over(w), F.min("v").over(w),
        F.last("gap", ignorenulls=True).over(w),
    )
    assert rows(got, "id", "s", "m", "n", "l") == rows(want)


@pytest.mark.parametrize("size", [1, 2, 3, 50, 10**6])
def test_near(hot, size):
    if size < 3:
        size = 3
    got = near(hot, ["file_id"], "idx", {"a": ("v", -1), "b": ("v", 1), "c": ("v", 3)}, size)
    w = Window.partitionBy("file_id").orderBy("idx")
    want = hot.select(
        "id", F.lag("v").over(w), F.lead("v").over(w), F.lead("v", 3).over(w)
    )
    assert rows(got, "id", "a", "b", "c") == rows(want)


@pytest.mark.parametrize("size", [1, 7, 100, 10**6])
def test_values_that_build_on_each_other(hot, size):
    """Row before and after, and a running sum of differences, in one set of blocks."""
    scan = Blocks(hot, ["file_id"], index_block("idx", size), ["idx"])
    scan = scan.add({"p": Running("prev", F.col("gap")), "n": Running("next", F.col("v"))})
    scan = scan.with_columns({"d": F.coalesce(F.col("v") - F.col("p"), F.lit(0))})
    got = scan.add({"s": Running("sum", F.col("d"))}).rows()
    w = Window.partitionBy("file_id").orderBy("idx")
    want = hot.withColumns({"p": F.lag("gap").over(w), "n": F.lead("v").over(w)})
    want = want.withColumn("d", F.coalesce(F.col("v") - F.col("p"), F.lit(0)))
    want = want.withColumn("s", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got, "id", "p", "n", "s") == rows(want, "id", "p", "n", "s")


def test_whole_keys_and_missing_keys(hot, spark):
    specs = {"s": Running("sum", F.col("v")), "p": Running("prev", F.col("v")), "m": Running("max", F.col("v"), False)}
    one = running(hot, ["file_id"], index_block("idx", 50), ["idx"], specs)
    two = running(hot, ["file_id"], None, ["idx"], specs, whole=True)
    assert one.columns == two.columns and rows(one) == rows(two)
    keyless = spark.createDataFrame([(None, 1, 5), (1, 2, 6)], "file_id long, idx long, v long")
    assert rows(running(keyless, ["file_id"], F.col("idx"), ["idx"], {"s": Running("sum", F.col("v"))})) == [(1, 2, 6, 6)]


def executed(df):
    """Scans and shuffles of the plan as it ran: (file scans, shuffles of rows, all shuffles)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    lines = [x for x in plan.splitlines() if "ReusedExchange" not in x]
    shuffles = [x for x in lines if re.search(r"Exchange (hash|range|Round|Single)", x)]
    return (
        sum("FileScan" in x for x in lines), sum("REPARTITION_BY_COL" in x for x in shuffles), len(shuffles)
    )


def test_rows_are_read_and_moved_once(spark, tables, tmp_path):
    stored = {}
    for name, df in {"notes": tables.notes_dense, "tempo": tables.tempo, "cc": tables.cc}.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    # block size 1: every key has something to carry
    index = running(
        stored["notes"], ["file_id"], F.col("start_tick"), ["start_tick", "note_idx"],
        {"n": Running("sum", F.lit(1)), "last": Running("last", F.col("pitch"), upto=False)},
    )
    assert executed(index) == (1, 1, 3)
    scans, moved, _ = executed(tokens.order_notes(stored["notes"]))
    assert (scans, moved) == (1, 1)
    steps = tokens.note_steps(stored["notes"])
    cc = stored["cc"].withColumn("step", F.col("tick"))
    scans, moved, _ = executed(tokens.order_performance_events(steps, cc))
    assert (scans, moved) == (2, 1)
    assert executed(tokens.performance_encode(steps, cc))[0] <= 3
    probes = stored["notes"].selectExpr("file_id", "note_idx", "start_tick / 64D as t")
    assert executed(notes.time_to_tick(stored["tempo"], probes))[0] == 2
    stream = stored["notes"].selectExpr("file_id", "note_idx as pos", "2 + pitch as token")
    assert executed(tokens.performance_decode(stream)[1])[:2] == (1, 1)


def test_chunks_of_a_hot_file_are_spread(spark):
    """A file with a third of all notes: no task of the row stages gets more than a few blocks of it."""
    df = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 0, 1 + id % 50) as file_id", "id as note_idx", "id * 10 as start_tick",
        "id as start_bin", "id + 3 as end_bin", "id * 10 + 5 as end_tick",
    )
    got = chunks.chunk_by_silence(df, block=500)
    want = chunks.chunk_by_silence(df, block=10**9)
    columns = ("file_id", "note_idx", "chunk_idx", "chunk_first", "chunk_last", "chunk_start")
    assert rows(got, *columns) == rows(want, *columns)
    blocks = Blocks(df.where("file_id = 0"), ["file_id"], index_block("start_bin", 500), ["start_bin"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = blocks.df.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 4 and max(n for _, n in sizes) < 5_000


def test_ordinal(hot):
    got = ordinal(hot.drop("idx"), ["file_id"], F.expr("id div 64"), ["id"], "idx")
    assert rows(got, "id", "idx") == rows(hot, "id", "idx")


def test_hot_key_is_split(hot):
    """No group of the blocked scan holds more rows than the block size."""
    sizes = hot.groupBy("file_id", index_block("idx", 100)).count()
    assert hot.where("file_id = 0").count() == 2000
    assert sizes.agg(F.max("count")).first()[0] == 100


def test_range_blocks_split_one_full_tick(spark):
    """A third of all rows on one tick of one file still spreads over many blocks."""
    df = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 0, 1 + id % 50) as file_id", "if(id % 3 = 0, 0, id) as start_tick",
        "cast(60 as int) as pitch", "id as note_idx",
    ).repartition(6)
    cut = range_blocks(df, ["file_id"], ["start_tick", "pitch", "note_idx"])
    sizes = cut.where("file_id = 0").groupBy("__range").count()
    assert sizes.count() > 1 and sizes.agg(F.max("count")).first()[0] < 3000
    got = tokens.order_notes(df, balanced=True)
    assert got.columns == [*df.columns, "note_ord"]
    assert rows(got, "note_idx", "note_ord") == rows(
        tokens.order_notes(df), "note_idx", "note_ord"
    )


def test_balanced_operators(tables):
    df = tables.notes_sparse.withColumns(
        {
            "start_bin": chunks.time_bin(F.col("start_tick"), F.col("bpm")),
            "end_bin": chunks.time_bin(F.col("end_tick"), F.col("bpm")),
        }
    )
    columns = ("file_id", "note_idx", "chunk_idx", "chunk_first", "chunk_last", "chunk_start")
    assert rows(chunks.chunk_by_silence(df, block=None), *columns) == rows(
        chunks.chunk_by_silence(df), *columns
    )
    stepped = tokens.note_steps(tables.notes_dense)
    columns = ("file_id", "ord", "sub", "token")
    assert rows(tokens.performance_encode(stepped, balanced=True), *columns) == rows(
        tokens.performance_encode(stepped), *columns
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, hot, how):
    small = spark.range(0, 60, 2).selectExpr("id as file_id", "id * 10 as x")
    got = spread_join(hot.select("file_id", "id"), small, ["file_id"], how)
    want = hot.select("file_id", "id").join(small, "file_id", how)
    assert rows(got, *want.columns) == rows(want)


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_hash_rank(hot, digits):
    got = hash_rank(hot.select("id"), ["id"], 5, "r", digits)
    want = hot.select("id", F.row_number().over(
        Window.orderBy(F.md5(F.concat(F.lit("5-"), F.col("id").cast("string"))))
    ))
    assert rows(got, "id", "r") == rows(want)


@pytest.mark.parametrize("block", [10, 37, 10**6])
def test_chunks_across_blocks(tables, block):
    df = tables.notes_sparse.withColumns(
        {
            "start_bin": chunks.time_bin(F.col("start_tick"), F.col("bpm")),
            "end_bin": chunks.time_bin(F.col("end_tick"), F.col("bpm")),
        }
    )
    columns = ("file_id", "note_idx", "chunk_idx", "chunk_first", "chunk_last", "chunk_start")
    got = rows(chunks.chunk_by_silence(df, block=block), *columns)
    assert got == rows(chunks.chunk_by_silence(df, block=10**9), *columns)
    assert len({r[2] for r in got}) > 1


@pytest.mark.parametrize("block", [1, 5, 10**6])
def test_fifo_across_blocks(tables, block):
    columns = ("file_id", "event_idx", "pitch", "on_at", "off_at", "velocity")
    got = notes.pair_notes_fifo(tables.midi_events, "tick", block=block)
    assert rows(got, *columns) == rows(notes.pair_notes_fifo(tables.midi_events, "tick"), *columns)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(tables, parts):
    stepped = tokens.note_steps(tables.notes_dense)
    shuffled = stepped.repartition(parts, "pitch")
    columns = ("file_id", "ord", "sub", "token")
    assert rows(tokens.performance_encode(shuffled), *columns) == rows(
        tokens.performance_encode(stepped), *columns
    )
