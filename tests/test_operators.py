"""Variants, round trips, brute-force checks and files."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake import dims
from scorelake.functions import arrays as a
from scorelake.functions.scalars import meter_parts
from scorelake.functions.scans import near, ordinal
from scorelake.operators import chords, chunks, examples, meta, noise, notes, retrieval, tokens, tracks, windows
from scorelake.plans import corpus
from scorelake.session import cut_lineage
from scorelake.sources import catalog, sinks
from tests.conftest import SF, rows
from tests.test_scans import executed


def test_program_filter_compat(tables):
    kept = tracks.drop_tracks_by_program(tables.notes_dense).count()
    compat = tracks.drop_tracks_by_program(tables.notes_dense, compat=True).count()
    assert 0 < kept < compat < tables.notes_dense.count()


def test_chunk_compat_loses_one_note_per_file(tables):
    df = tables.notes_sparse.withColumns(
        {
            "start_bin": chunks.time_bin(F.col("start_tick"), F.col("bpm")),
            "end_bin": chunks.time_bin(F.col("end_tick"), F.col("bpm")),
        }
    )
    full = chunks.chunk_by_silence(df)
    short = chunks.chunk_by_silence(df, compat=True)
    lost = full.select("file_id", "note_idx").subtract(short.select("file_id", "note_idx"))
    assert lost.groupBy("file_id").count().agg(F.max("count")).first()[0] == 1


def test_performance_round_trip(spark):
    """Notes on the step grid come back; at 125 bpm a step is 10 ticks."""
    rng = np.random.default_rng(1)
    data = []
    for file_id in range(5):
        at = 0
        for i in range(60):
            at += int(rng.integers(0, 300)) * 10
            data.append(
                (file_id, i, at, at + 10 * int(rng.integers(1, 200)), int(rng.integers(40, 90)),
                 1 + 2 * int(rng.integers(0, 60)), 125)
            )
    df = spark.createDataFrame(
        data, "file_id int, note_idx bigint, start_tick bigint, end_tick bigint, pitch int,"
        " velocity int, bpm int"
    )
    # one voice per pitch, so that on/off pairing has one answer
    first = df.groupBy("file_id", "pitch").agg(F.min("note_idx").alias("note_idx"))
    df = df.join(first, ["file_id", "pitch", "note_idx"], "left_semi")
    stepped = tokens.note_steps(df)
    encoded = tokens.performance_encode(stepped)
    pos = encoded.selectExpr("file_id", "token", "sub", "ord")
    stream = ordinal(pos, ["file_id"], F.col("ord"), ["ord", "sub"], "pos")
    back, cc = tokens.performance_decode(stream, block=50)
    lead = stepped.groupBy("file_id").agg(F.min("start_step").alias("t0"))
    want = stepped.join(lead, "file_id").selectExpr(
        "file_id", "pitch", "start_step - t0 as a", "end_step - t0 as z", "velocity"
    )
    assert cc.count() == 0
    assert rows(back, "file_id", "pitch", "on_at", "off_at", "velocity") == rows(want)


def test_bar_round_trip(spark):
    data = [
        (f, i, 1920 * (i // 4) + 60 * ((7 * i) % 32), 0, 40 + (11 * i) % 50, 4 * (1 + i % 30))
        for f in range(3) for i in range(40)
    ]
    df = spark.createDataFrame(
        data, "file_id int, note_idx bigint, start_tick bigint, end_tick bigint, pitch int, velocity int"
    ).withColumn("end_tick", F.col("start_tick") + 15 * (1 + F.col("note_idx") % 100))
    encoded = tokens.bar_encode(tokens.note_items(df, ["file_id"]))
    stream = ordinal(encoded, ["file_id"], F.col("bar"), ["bar", "place", "sub"], "pos")
    back = tokens.bar_decode(stream, dims.bar_vocab(spark))
    columns = ("file_id", "start_tick", "end_tick", "pitch", "velocity")
    assert rows(back, *columns) == rows(df, *columns)


def test_original_and_augmented_ids(spark):
    ids = spark.createDataFrame([("7",), ("7_cmajor_80",), ("7_x",)], "id string")
    assert catalog.parse_augmented_id(ids).count() == 1
    assert catalog.parse_augmented_id(ids, augmented_only=False).count() == 2


def test_noise_keeps_frame_and_repeats(spark):
    seq = [422, *range(2, 60), 1]
    df = spark.createDataFrame([(i, seq) for i in range(50)], "example_id bigint, note_seq array<int>")
    loud = noise.Noise(permute=1.0, insert=0.2, mask=0.3, rotate=0.5)
    one = rows(noise.denoise_corrupt(df, loud, seed=1), "example_id", "input_ids", "labels")
    two = rows(
        noise.denoise_corrupt(df.repartition(7), loud, seed=1), "example_id", "input_ids", "labels"
    )
    assert one == two
    assert all(r[1][0] == 422 and r[1][-1] == 1 and r[2] == seq for r in one)
    assert len({tuple(r[1]) for r in one}) > 40


def test_masked_share_is_the_budget_at_every_length(spark):
    """Ids 2 and above are distinct, so what is missing was masked; a mask is 423 or a random id."""
    sizes = [3, 4, 5, 7, 10, 31, 100, 700]
    df = spark.createDataFrame(
        [(1000 * n + i, [422, *range(1000, 1000 + n - 2), 1]) for n in sizes for i in range(8)],
        "example_id bigint, note_seq array<int>",
    )
    for share in (0.05, 0.3, 0.9, 1.0):
        out = noise.denoise_corrupt(df, noise.Noise(mask=share, mask_random=0.0), seed=4)
        for r in out.select("note_seq", "input_ids").collect():
            inner = len(r.note_seq) - 2
            kept = [x for x in r.input_ids if x >= 1000]
            assert inner - len(kept) == math.ceil(inner * share) and kept == sorted(kept)
            assert 1 <= r.input_ids.count(423) <= math.ceil(inner * share)


def test_noise_steps(spark):
    ids = [422, 2, 3, 1, 4, 5, 6, 1, 7, 1]
    df = spark.createDataFrame([(i, ids) for i in range(40)], "example_id bigint, note_seq array<int>")

    def out(**steps):
        found = noise.denoise_corrupt(df, noise.Noise(**{"mask": 0.0, **steps}), seed=2)
        return [r.input_ids for r in found.select("input_ids").collect()]

    moved = out(permute=1.0)
    assert all(sorted(x) == sorted(ids) and x[0] == 422 and x[-1] == 1 for x in moved)
    sentences = [[2, 3, 1], [4, 5, 6, 1], [7]]
    wanted = {tuple([422, *sum(p, []), 1]) for p in itertools.permutations(sentences)}
    assert {tuple(x) for x in moved} == wanted
    rolled = out(rotate=1.0)
    assert {tuple(x) for x in rolled} <= {(422, *ids[k:-1], *ids[1:k], 1) for k in range(1, 9)}
    assert len({tuple(x) for x in rolled}) > 4 and out(rotate=1e-9) == [ids] * 40
    longer = out(insert=0.5, mask_random=0.0)
    assert all(len(x) == 15 and [y for y in x if y != 423] == ids for x in longer)
    random = [y for x in out(insert=1.0, mask_random=0.5) for y in x if y not in ids]
    assert 0.3 < sum(y == 423 for y in random) / len(random) < 0.8 and min(random) >= 1 and max(random) < 424
    short = spark.createDataFrame([(1, [422, 1]), (2, []), (3, None)], df.schema)
    loud = noise.Noise(permute=1.0, insert=1.0, rotate=1.0)
    got = {r.example_id: r.input_ids for r in noise.denoise_corrupt(short, loud).collect()}
    assert got == {1: [422, 1], 2: [], 3: None}


def test_poisson_table():
    table = noise.poisson_table(3.0)
    assert [len([t for t in table if t <= u]) for u in (0.0, 0.0497, 0.0498, 0.5, 0.65, 1 - 2**-28)] == [0, 0, 1, 3, 4, 17]


def test_empty_sequence_is_not_framed(spark):
    df = spark.createDataFrame([([],), ([5],)], "s array<int>")
    assert rows(df.select(a.frame_tokens(F.col("s"), 9, 1))) == [(None,), ([9, 5, 1],)]


@pytest.mark.parametrize("tile_rows, query_bytes", [(512, 64 << 20), (7, 3000)])
def test_topk_against_brute_force(spark, tables, tile_rows, query_bytes):
    data = sorted(tables.embeddings.select("vec_id", "embedding").collect())
    ids = np.array([r[0] for r in data])
    vectors = np.array([r[1] for r in data], dtype="float64")
    scores = np.round(vectors @ vectors.T, 9)
    want = []
    for q, row in zip(ids, scores):
        order = sorted(range(len(ids)), key=lambda i: (-row[i], ids[i]))[:3]
        want += [(int(q), n + 1, int(ids[i])) for n, i in enumerate(order)]
    queries = tables.embeddings.selectExpr("vec_id as query_id", "embedding as vector")
    got = retrieval.retrieve_topk(queries, tables.passages, 3, tile_rows, query_bytes)
    assert rows(got, "query_id", "rank", "vec_id") == sorted(
        want, key=lambda r: tuple(str(v) for v in r)
    )


def test_topk_skips_far_tiles_and_keeps_ties(spark):
    """Passages in far-apart groups with many equal vectors: most tiles are skipped, ties go by id."""
    rng = np.random.default_rng(3)
    groups = rng.normal(0, 1, (20, 8))
    groups *= 10 / np.linalg.norm(groups, axis=1, keepdims=True)
    vectors = np.repeat(groups, 100, axis=0) + rng.normal(0, 0.01, (2000, 8))
    vectors[::3] = np.repeat(groups, 100, axis=0)[::3]
    passages = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"
    ).coalesce(2)
    queries = spark.createDataFrame(
        [(i, g.tolist()) for i, g in enumerate(groups)], "query_id long, vector array<double>"
    )
    found = retrieval.retrieve_topk(queries, passages, 4, tile_rows=50, report=True).collect()
    scores = np.round(groups @ vectors.T, 9)
    want = {(q, n + 1, i) for q in range(20) for n, i in enumerate(np.lexsort((np.arange(2000), -scores[q]))[:4])}
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == want
    tasks = {(r.tiles, r.skipped) for r in found}
    assert sum(s for _, s in tasks) > 0.6 * sum(t for t, _ in tasks)
    assert retrieval.retrieve_topk(queries.limit(0), passages).count() == 0
    assert retrieval.retrieve_topk(queries, passages.limit(0)).count() == 0


def test_length_buckets():
    bounds, sizes = examples.length_buckets(64, 256)
    assert bounds == [8, 12, 16, 24, 32, 48]
    assert sizes == [36, 23, 17, 11, 8, 5, 4]
    assert examples.length_buckets(8, 4) == ([], [1])


def test_one_partial_batch_per_length_bucket(tables):
    df = tables.examples
    n = df.count()
    sizes = examples.assign_batches(df, 16).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == sorted([16] * (n // 16) + ([n % 16] if n % 16 else []))
    assert {r.batch for r in sizes} == set(range(-(-n // 16)))
    _, rule = examples.length_buckets(64, 256)
    rows_ = df.withColumn("targets", F.concat("note_seq", "note_seq"))
    out = examples.bucket_by_length(rows_, 64, tokens_per_batch=256).groupBy("length_bucket", "batch").count()
    partial = out.where(F.col("count") < F.get(F.array(*map(F.lit, rule)), F.col("length_bucket")))
    assert partial.groupBy("length_bucket").count().where("count > 1").isEmpty()


def test_bar_encodings_follow_the_meter(spark):
    """2/2 counts two beats a bar, eighths half a beat each."""
    meters = spark.createDataFrame([("4/4",), ("2/2",), ("6/8",), ("5/8",), ("3/4",)], "m string")
    ticks = meters.select(windows.encoding_bar_ticks(*meter_parts(F.col("m"))).alias("t"))
    assert [r.t for r in ticks.collect()] == [1920, 960, 1440, 1200, 1440]
    header = spark.createDataFrame([(1, "4/4"), (2, "2/2"), (3, "6/8"), (4, None)], "file_id long, time_signature string")
    keys = corpus.SEGMENT
    segments = spark.createDataFrame(
        [(f, 1, 0, 4, 0, i, 480 * i, 480 * i + 480, 60 + i, 64) for f in (1, 2, 3, 4) for i in range(12)],
        "file_id long, track_idx long, chunk_idx int, n_bars int, window_idx int, note_idx long, start_tick long,"
        " end_tick long, pitch int, velocity int",
    )
    bars = {r.file_id: r.note_seq.count(2) for r in corpus.encode_notes(segments, header, "bar", keys).collect()}
    assert bars == {1: 3, 2: 6, 3: 4, 4: 3}
    words = {r.file_id: r.note_seq for r in corpus.encode_notes(segments, header, "compound", keys).collect()}
    assert all(len(w) % 7 == 0 for w in words.values()) and len(words[2]) > len(words[1])
    sung = corpus.encode_notes(segments, header, "bar_detected", keys).collect()
    assert {r.file_id for r in sung} == {1, 2, 3, 4} and all(r.note_seq[-1] == 1 for r in sung)
    with pytest.raises(ValueError, match="encoder"):
        corpus.encode_notes(segments, header, "other", keys)


def test_files_with_many_key_or_meter_changes_have_no_examples(spark, tables):
    from checks.q_plans import header

    def files(**changes):
        out = corpus.web_examples(tables.notes_dense, tables.tempo, tables.tempo_end, header(tables), **changes)
        return {r.file_id for r in out.select("file_id").distinct().collect()}

    every = files()
    one, two = sorted(every)[:2]
    changes = lambda *n: spark.createDataFrame([(f, i) for f, k in n for i in range(k)], "file_id long, at long")
    assert len(every) > 2
    assert files(key_changes=changes((one, 8), (two, 9)), meter_changes=changes((one, 1))) == every - {two}
    assert files(meter_changes=changes((one, 2), (two, 1))) == every - {one}


def test_augmented_files(spark):
    notes_ = [(1, i, "chord" if i < 2 else "main_melody", 100 + 10 * i, 200 + 10 * i, 60 + i) for i in range(6)]
    notes_ += [(2, 0, "main_melody", 0, 10, 60), (3, 0, "chord", 5, 9, 60), (3, 1, "main_melody", 7, 9, 124)]
    note_rows = spark.createDataFrame(
        notes_, "file_id long, note_idx long, track_name string, start_tick long, end_tick long, pitch int"
    )
    files = spark.createDataFrame([(1, "a", 11), (2, "b", 0), (3, "c", 14)], "file_id long, stem string, key_number int")
    tempo = spark.createDataFrame([(f, 0, 0, 102) for f in (1, 2, 3)], "file_id long, seq long, time_sec long, bpm int")
    ends = spark.createDataFrame([(f, 10) for f in (1, 2, 3)], "file_id long, end_sec long")
    named, moved = corpus.augment_catalog(files, note_rows, tempo, ends)
    got = {r.stem: (r.file_id, r.source_id) for r in named.collect()}
    major = ["fmajor", "gbmajor", "gmajor", "abmajor", "amajor", "bbmajor", "bmajor", "cmajor", "dbmajor", "dmajor", "ebmajor", "emajor"]
    minor = ["g#minor", "aminor", "bbminor", "bminor", "cminor", "c#minor", "dminor", "ebminor", "eminor", "fminor"]
    assert set(got) == {f"{s}_{k}_{b}" for s, keys in (("a", major), ("c", minor)) for k in keys for b in (92, 97, 102, 107, 112)}
    assert len({i for i, _ in got.values()}) == len(got)
    here = {(r.start_tick, r.end_tick, r.pitch) for r in moved.where(F.col("file_id") == got["a_cmajor_97"][0]).collect()}
    assert here == {(10 * i, 100 + 10 * i, 61 + i) for i in range(2, 6)}


def test_bar_decode_by_each_files_beats(spark):
    notes_ = [(f, "Note", 480 * i, 480 * i + 240, 60 + i, 64, i, None) for f in (1, 2) for i in range(12)]
    items = spark.createDataFrame(
        notes_, "file_id long, name string, start_tick long, end_tick long, pitch int, velocity int, note_idx long, chord string"
    ).withColumn("beats", F.when(F.col("file_id") == 1, 4).otherwise(3))
    coded = tokens.bar_encode(items, ["file_id"], F.col("beats") * 480)
    stream = ordinal(coded, ["file_id"], F.col("bar"), ["bar", "place", "sub"], "pos")
    stream = stream.withColumn("beats", F.when(F.col("file_id") == 1, 4).otherwise(3))
    back = tokens.bar_decode(stream, dims.bar_vocab(spark), beats=F.col("beats")).where("kind = 'note'")
    # a third of a bar is no point of the grid: half a grid step is lost at most
    want = {(r.file_id, r.pitch): r.start_tick for r in items.collect()}
    got = {(r.file_id, r.pitch): r.start_tick for r in back.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1440 / 64 for k in want)


def test_shard_names_beyond_four_digits(spark):
    shards = spark.createDataFrame([(0,), (9_999,), (12_345,), (123_456,)], "shard long")
    names = shards.select(sinks.shard_name(F.col("shard"))).collect()
    assert sorted(n for (n,) in names) == ["0000", "12345", "123456", "9999"]


def test_three_way_split(tables):
    out = examples.split_by_ratio(
        tables.examples.drop("split"), {"val": 0.1, "test": 0.05}
    ).groupBy("split").count()
    n = tables.examples.count()
    counts = dict(rows(out))
    assert counts["val"] == -(-n // 10)
    assert sum(counts.values()) == n and counts["test"] == int(np.ceil(0.05 * n))


def test_chord_csv_and_meta_csv(spark, tmp_path):
    df = spark.createDataFrame([("f1", ["C", "Am"]), ("f2", None)], "filename string, progression array<string>")
    sinks.write_chord_table(df, str(tmp_path / "chords"))
    back = catalog.read_chord_table(spark, str(tmp_path / "chords"))
    assert rows(back, "filename", "chord_progression") == [("f1", ["C", "Am"])]
    sinks.chord_table(df).write.option("header", "true").csv(str(tmp_path / "plain"))
    back = catalog.read_chord_csv(spark, str(tmp_path / "plain"))
    assert rows(back, "filename", "chord_progression") == [("f1", ["C", "Am"])]
    plain = tmp_path / "meta.csv"
    plain.write_text("junk,,,\n,status,id,genre\n,c,A-1,Jazz\n,c,A-2,\n,c,,rock\n,c,A-3,Polka\n")
    table = catalog.read_meta_csv(catalog.read_raw_csv(spark, str(plain)), "status", "id", "genre")
    assert table.columns == ["id", "genre"]
    assert rows(catalog.genre_table(table, "id", "genre")) == [("A-1", "jazz")]
    plain.write_text("id,genre\nA-1,Jazz\n")
    table = catalog.read_meta_csv(catalog.read_raw_csv(spark, str(plain)), "status", "id", "genre")
    assert rows(table, "id", "genre") == [("A-1", "Jazz")]


def test_meta_csv_of_many_files_and_blocks(spark, tmp_path):
    """Rows follow the header in (file, block, row) order, whatever task reads them."""
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(4):
        lines = [f"{n},{i},x" for i in range(300)]
        if n == 1:
            lines[120] = "status,place,kind"
        (folder / f"part-{n}.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        raw = catalog.read_raw_csv(spark, str(folder))
        assert raw.rdd.getNumPartitions() > 8
        table = catalog.read_meta_csv(raw, "status", "status", "kind")
        want = [("1", str(i), "x") for i in range(121, 300)]
        want += [(str(n), str(i), "x") for n in (2, 3) for i in range(300)]
        assert rows(table) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sinks(spark, tables, tmp_path):
    sinks.write_examples(tables.examples, str(tmp_path / "ex"))
    back = sinks.read_table(spark, str(tmp_path / "ex"))
    assert rows(back, "example_id", "meta", "note_seq") == rows(
        tables.examples, "example_id", "meta", "note_seq"
    )
    sinks.write_splits(tables.examples, str(tmp_path / "split"))
    val = sinks.read_table(spark, str(tmp_path / "split")).where("split = 'val'")
    assert val.count() == tables.examples.where("split = 'val'").count()
    sinks.sharded_write(tables.examples, str(tmp_path / "shards"), ["example_id"], 500)
    counts = sinks.read_table(spark, str(tmp_path / "shards")).groupBy("shard").count()
    assert counts.agg(F.max("count")).first()[0] == 500
    names = {p.name for p in (tmp_path / "shards" / "versions").glob("*/shard=*")}
    assert names == {f"shard={n:04d}" for n in range(counts.count())}


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    df = spark.range(100).selectExpr("id", "id % 3 as part")
    sinks.write_table(df, path, ["part"])
    begun = sinks.read_table(spark, path)
    broken = df.withColumn("id", F.when(F.col("id") < 50, F.col("id")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        sinks.write_table(broken, path, ["part"])
    assert rows(sinks.read_table(spark, path), "id", "part") == rows(df)
    sinks.write_table(df.where("id < 7"), path, ["part"])
    assert begun.count() == 100 and sinks.read_table(spark, path).count() == 7
    assert [(c.number, c.rows, c.parts) for c in sinks.commits(spark, path)] == [(1, 100, "part"), (2, 7, "part")]


def test_truncate_features(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [5, 6]), (2, [], None)], "id int, inputs array<int>, targets array<int>")
    assert rows(examples.truncate_features(df, 3, 1)) == [(1, [1, 2, 3], [5]), (2, [], None)]
    assert rows(examples.truncate_features(df)) == rows(df)
    assert examples.truncate_features(df.select("id", "targets"), 3, 1).first().targets == [5]


def test_samples_and_splits_move_no_wide_rows(spark, tables):
    df = tables.examples.drop("split")
    for n in (0, 1, 7, 50_000):
        wanted = df.withColumn("h", F.md5(F.concat(F.lit("5-"), F.col("example_id").cast("string"))))
        wanted = wanted.orderBy("h").limit(n).select("example_id")
        assert rows(examples.sample_n(df, n, 5), "example_id") == rows(wanted)
    picked = examples.sample_n(spark.read.parquet(f"{SF}/documents.parquet"), 20, 5, ["doc_id"])
    assert picked.count() == 20
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "text#" in x]

def test_list_files_reads_no_content(spark, tmp_path):
    for name in ("a.mid", "b.MIDI", "c.txt", "tmp/d.mid"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    files = catalog.list_files(spark, str(tmp_path))
    assert rows(catalog.scan_catalog(files), "stem") == [("a",), ("b",)]


def test_pushdown(spark, tables):
    """Only the needed columns are read and the date filter reaches the scan."""
    plan = meta.pitch_ranges(tables.notes_dense)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_shipdate" not in plan
    old = spark.read.parquet(f"{SF}/orders.parquet").selectExpr(
        "o_orderdate as created_at", "o_orderdate as updated_at", "o_orderkey % 2 = 0 as auto_changed"
    )
    plan = catalog.sample_filter(old, "1999-01-01")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):].split("]")[0]
    assert "GreaterThanOrEqual(o_orderdate" in pushed


def test_training_batches(tables):
    out = corpus.training_batches(tables.examples, 8, 30, ["example_id"])
    sizes = out.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("input_ids")).alias("w")
    )
    assert rows(sizes.select("n", "w").distinct()) == [(8, 1)]


def test_transposed_key(spark):
    df = spark.createDataFrame([(0, -3), (11, 2), (12, -1), (23, 1)], "k int, s int")
    got = df.select(notes.transposed_key(F.col("k"), F.col("s")))
    assert [r[0] for r in got.collect()] == [9, 1, 23, 12]


@pytest.mark.parametrize(("block", "spread"), [(1 << 20, 1), (40, 1), (40, 2**50)])
def test_votes_stay_in_cells_and_equal_all_pairs(spark, monkeypatch, block, spread):
    """Any cut into blocks and ranges finds the best offset of all pairs; copies tie by the smallest id."""
    draw = random.Random(5)
    rows = [(f, i, 60 + draw.randrange(3), spread * 120 * draw.randrange(20)) for f in range(12) for i in range(20)]
    rows += [(f + 100, i, p, s) for f, i, p, s in rows if f < 3]
    library = spark.createDataFrame(rows, "file_id long, note_idx long, pitch int, start_tick long")
    asked = library.where("file_id % 2 = 0").withColumn("start_tick", F.col("start_tick") + 7)

    def prints(df):
        return [tuple(r) for r in retrieval.fingerprints(df).select(
            "file_id", "pitch", "interval", "gap", "tick", "n").collect()]

    votes, known = Counter(), prints(library)
    for q, qp, qi, qg, qt, qn in prints(asked):
        for c, p, i, g, t, n in known:
            if (p, i, g) == (qp, qi, qg):
                votes[q, c, t - qt] += n * qn
    want = {}
    for (q, c, off), n in votes.items():
        want[q] = min(want.get(q, (1, 0, 0)), (-n, c, off))
    got = retrieval.fingerprint_match(asked, library, block).collect()
    assert {(r.query_id, r.candidate, r.tick_offset, r.votes) for r in got} == {
        (q, c, off, -n) for q, (n, c, off) in want.items()
    }
    assert len(got) == len(want)
    monkeypatch.setattr(retrieval, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(retrieval, "RANGE_ROWS", 40)
    queries = retrieval.fingerprints(asked).withColumnsRenamed({"file_id": "query_id", "tick": "qt", "n": "qn"})
    sides = queries.toPandas(), retrieval.fingerprints(library).withColumnRenamed("file_id", "candidate").toPandas()
    local = retrieval._count_votes(*sides)
    assert set(local.itertuples(index=False, name=None)) == {(q, c, off, -n) for q, (n, c, off) in want.items()}


def test_noise_draws_outside_of_lookups(spark):
    """Spark repeats what stands in a lambda for each entry looked at, so neither holds draws."""
    # a range, since the rows of a local table would be computed with the plan
    df = spark.range(1).selectExpr("id as example_id", "array(422, 5, cast(id as int), 7, 1) as note_seq")
    out = noise.denoise_corrupt(df, noise.Noise(mask=0.3)).select("input_ids")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" in plan and "<= (cast(cast(conv" not in plan


def test_best_segments_are_chosen_without_another_shuffle(tables):
    """Same rows as the general choice among segments; the segments of a beat are not grouped again."""
    whole = chords.best_chord_segment(chords.chord_segments(tables.notes_dense))
    best = chords.best_segments(tables.notes_dense)
    assert rows(best, *whole.columns) == rows(whole)

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(best) < shuffles(whole)


def test_a_write_reads_nothing_back(spark, tmp_path, monkeypatch):
    """The rows of a version are counted as they are written, none included."""
    def read_back(*_):
        raise AssertionError("read back")

    monkeypatch.setattr(sinks, "_version", read_back)
    shuffled = spark.range(90).withColumn("part", F.col("id") % 3).repartition("part")
    for name, df in {"some": shuffled, "none": shuffled.where("id < 0"), "empty": spark.range(0)}.items():
        sinks.write_table(df, str(tmp_path / name), ["part"] if "part" in df.columns else [])
        assert [c.rows for c in sinks.commits(spark, str(tmp_path / name))] == [90 if name == "some" else 0]


def _recordings(spark, seed, files=12, size=20):
    draw = random.Random(seed)
    rows_ = [(f, i, 60 + draw.randrange(3), 120 * draw.randrange(20)) for f in range(files) for i in range(size)]
    rows_ += [(f + 100, i, p, s) for f, i, p, s in rows_ if f < 3]
    return spark.createDataFrame(rows_, "file_id long, note_idx long, pitch int, start_tick long")


def test_prints_are_not_copied_for_each_pair_of_blocks(spark):
    """Blocks are written once, however many meet: only one row per query and task is shuffled after that."""
    library = _recordings(spark, 5)
    found = retrieval.fingerprint_match(library.where("file_id % 2 = 0"), library, 40)
    assert executed(found)[2] == 1
    # one more query and a print without a pitch change nothing for the others
    odd = spark.createDataFrame([(500, 0, None, 0), (500, 1, 60, None), (None, 0, 60, 0)], library.schema)
    again = retrieval.fingerprint_match(library.where("file_id % 2 = 0").union(odd), library.union(odd), 40)
    assert rows(again) == rows(found)
    assert retrieval.fingerprint_match(library, library.where("file_id < 0"), 40).count() == 0


def test_cells_of_a_task_share_their_best(spark):
    """Cells counted one after the other, in any order, find the best of all; equal votes go to the smallest id."""
    library = _recordings(spark, 7, 30)
    known = retrieval.fingerprints(library).withColumnRenamed("file_id", "candidate").toPandas()
    asked = retrieval.fingerprints(library.where("file_id % 3 = 0")).withColumnsRenamed(
        {"file_id": "query_id", "tick": "qt", "n": "qn"}
    ).toPandas()
    want = retrieval._count_votes(asked, known)
    parts = [known[known["candidate"] % 4 == k] for k in range(4)]
    for order in ([0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]):
        best = None
        for k in order:
            best = retrieval._count_votes(asked, parts[k], best)
        assert best.equals(want)


def test_next_note_comes_with_the_order(spark):
    """The same rows as a look at the neighbour afterwards; notes are shuffled once."""
    draw = random.Random(2)
    notes_ = [(draw.randrange(4), i, 50 + draw.randrange(9), 960 * draw.randrange(400)) for i in range(600)]
    df = cut_lineage(spark.createDataFrame(notes_, "file_id long, note_idx long, pitch int, start_tick long"))
    got = tokens.order_notes(df, following={"p2": "pitch", "t2": "start_tick"})
    want = near(tokens.order_notes(df), ["file_id"], "note_ord", {"p2": ("pitch", 1), "t2": ("start_tick", 1)})
    columns = [*df.columns, "note_ord", "p2", "t2"]
    assert rows(got, *columns) == rows(want, *columns)
    _, moved, shuffles = executed(retrieval.fingerprints(df))
    assert moved == 1 and shuffles <= 4
