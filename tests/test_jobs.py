"""What whole jobs read and move: numbered views once, notes without a row per token."""

from pyspark.sql import functions as F

from checks.views import Tables
from scorelake import dims
from scorelake.functions.scans import ordinal
from scorelake.operators import tokens
from scorelake.plans import corpus
from scorelake.session import cut_lineage
from tests.conftest import SF, rows
from tests.test_scans import executed


def test_a_cut_is_read_by_column(spark):
    cut = cut_lineage(spark.range(50).selectExpr("id", "id * 2 as twice", "array(id) as list"))
    plan = cut.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan
    assert rows(cut) == [(i, 2 * i, [i]) for i in sorted(range(50), key=str)]
    empty = cut_lineage(cut.where("id < 0"))
    assert empty.columns == cut.columns and empty.count() == 0


def test_written_views_are_numbered_once(spark, tables):
    written = Tables(spark, SF).written("lines", "tempo", "_user_events")
    for name in ("notes_dense", "tempo", "cc"):
        view = getattr(written, name)
        assert executed(view)[2] == 0, name
        assert rows(view) == rows(getattr(tables, name))


def test_progressions_follow_the_numbered_chords(tables):
    packed = tables.chords.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("idx", "chord"))).alias("c"))
    assert rows(tables.progressions) == rows(packed.select("file_id", "c.chord"))
    assert executed(tables.progressions)[2] == 1


def test_performance_arrays(spark, tables):
    """The arrays are the long form packed; notes are shuffled once."""
    held = cut_lineage(tables.notes_dense)
    steps = tokens.note_steps(held)
    arrays = tokens.performance_arrays(steps)
    coded = tokens.performance_encode(steps)
    assert rows(arrays) == rows(tokens.pack_tokens(coded, ["file_id"]))
    assert executed(arrays) == (1, 0, 1)


def test_performance_arrays_without_keyswitches(spark):
    """Cut as the long form is; a key of keyswitches alone keeps its end token."""
    switch = dims.KEYSWITCH_VELOCITY
    notes_ = [(1, i, 240 * i, 240 * i + 480, 50 + i % 7, switch if i % 3 == 0 else 80) for i in range(40)]
    notes_ += [(2, 0, 0, 480, 60, switch), (3, 0, 0, 480, 60, 80)]
    df = spark.createDataFrame(
        notes_, "file_id long, note_idx long, start_tick long, end_tick long, pitch int, velocity int"
    )
    steps = tokens.note_steps(cut_lineage(df.withColumn("bpm", F.lit(120))))
    coded = ordinal(tokens.performance_encode(steps), ["file_id"], F.col("ord"), ["ord", "sub"], "pos")
    want = tokens.pack_tokens(tokens.drop_keyswitch_tokens(coded, ["file_id"]), ["file_id"], ["pos"])
    got = tokens.performance_arrays(steps, drop_keyswitch=True)
    assert rows(got) == rows(want)
    short = {r.file_id: r.note_seq for r in got.collect()}
    assert short[2] == [dims.EOS] and len(short[1]) < coded.where("file_id = 1").count()
    assert executed(got) == (1, 0, 1)


def test_no_moved_note_is_shuffled(spark):
    """Variants are made where the notes lie: only notes and facts of files are shuffled."""
    note_rows = spark.createDataFrame(
        [(f, i, "chord" if i < 2 else "lead", 10 * i, 10 * i + 5, 60 + i) for f in range(5) for i in range(20)],
        "file_id long, note_idx long, track_name string, start_tick long, end_tick long, pitch int",
    )
    files = spark.createDataFrame([(f, f"f{f}", f) for f in range(5)], "file_id long, stem string, key_number int")
    tempo = spark.createDataFrame([(f, 0, 0, 100) for f in range(5)], "file_id long, seq long, time_sec long, bpm int")
    ends = spark.createDataFrame([(f, 10) for f in range(5)], "file_id long, end_sec long")
    named, moved = corpus.augment_catalog(files, cut_lineage(note_rows), tempo, ends)
    assert executed(moved)[2] == 0
    assert moved.count() == 5 * 18 * 60 and named.count() == 5 * 60


def test_variants_are_not_broadcast_for_the_few_files_they_come_from(spark):
    """Variants are 60 to a file: what a join with them does follows from their own size."""
    note_rows = spark.range(4000).selectExpr(
        "id div 4 as file_id", "id % 4 as note_idx", "if(id % 4 = 0, 'chord', 'lead') as track_name",
        "id % 4 as start_tick", "id % 4 + 5 as end_tick", "cast(60 + id % 9 as int) as pitch",
    )
    files = spark.range(1000).selectExpr("id as file_id", "concat('f', id) as stem", "cast(id % 24 as int) as key_number")
    tempo = spark.range(1000).selectExpr("id as file_id", "0L as seq", "0L as time_sec", "100 as bpm")
    named, _ = corpus.augment_catalog(files, note_rows, tempo, tempo.selectExpr("file_id", "10L as end_sec"))
    # the files take some 10 kB, their variants some 4 MB
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "500k")
    try:
        both = named.join(spark.range(200_000).withColumnRenamed("id", "file_id"), "file_id")
        assert both.count() == 60_000
        counted = both.groupBy().count()
        counted.collect()
        plan = counted._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "HashedRelationBroadcastMode" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_written_views_lie_in_ranges_where_asked(spark, tables):
    """The same rows, each file of the view with a range of its own."""
    laid = Tables(spark, SF).written("lines", by=["file_id", "note_idx"])
    assert rows(laid.notes_dense) == rows(tables.notes_dense)
    at = F.struct("file_id", "note_idx")
    ends = laid.lines.groupBy(F.input_file_name()).agg(F.min(at), F.max(at)).drop("input_file_name()").collect()
    ends = sorted((tuple(low), tuple(high)) for low, high in ends)
    assert all(high < low for (_, high), (low, _) in zip(ends, ends[1:]))
