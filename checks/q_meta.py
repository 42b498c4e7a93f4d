"""Sources, sinks, attributes and their encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, register
from scorelake import dims, profiles
from scorelake.operators import meta, notes
from scorelake.session import shared_folder
from scorelake.sources import catalog, sinks


def sql_map(codes: dict) -> str:
    def text(x):
        return str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    return "MAP {" + ", ".join(f"{text(k)}: {text(v)}" for k, v in codes.items()) + "}"


def sql_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


MUSIC_FILE = "regexp_matches(path, '\\.(mid|MID|midi|MIDI)$')"


@register(
    "scan_catalog", "file_id:l path:s parent_dir:s stem:s",
    f"""SELECT file_id, path, string_split(path, '/')[3] AS parent_dir,
          regexp_replace(string_split(path, '/')[4], '\\.[a-zA-Z]+$', '') AS stem
        FROM v_files WHERE {MUSIC_FILE} AND string_split(path, '/')[3] NOT IN ('chunked', 'tmp')""",
)
def _(t):
    return catalog.scan_catalog(t.files)


@register(
    "stem_catalog", "stem:s path:s",
    f"""WITH s AS (SELECT path, regexp_extract(path, '/(f\\d+)\\.', 1) AS stem,
           CASE WHEN path LIKE '/corpus/raw/%' THEN 0 ELSE 1 END AS p FROM v_files WHERE {MUSIC_FILE})
        SELECT stem, path FROM (SELECT *, row_number() OVER (PARTITION BY stem
          ORDER BY p DESC, path DESC) rn FROM s) WHERE rn = 1""",
)
def _(t):
    files = catalog.scan_catalog(t.files, exclude_dirs=())
    raw = F.col("parent_dir") == "raw"
    return catalog.stem_catalog(files.where(raw), files.where(~raw))


@register(
    "sample_pages", "id:s bpm:l",
    """SELECT s->>'id' AS id, CAST(s->>'bpm' AS INTEGER) AS bpm FROM (SELECT unnest(
         CAST(json_extract(body, '$.samples.samples') AS JSON[])) AS s FROM v_json)""",
)
def _(t):
    return catalog.sample_pages(t.sample_json)


@register(
    "sample_filter", "id:s",
    """SELECT id FROM v_samples WHERE created_at >= DATE '2020-04-01'
         AND updated_at >= DATE '2020-04-01' AND NOT auto_changed""",
)
def _(t):
    return catalog.sample_filter(t.samples, "2020-04-01")


@register(
    "read_meta_csv", "c_custkey:l c_name:s c_mktsegment:s",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey >
         (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def _(t):
    """Files whose header stands below the first row of a segment, written and read back."""
    cells = ["'' as note", "c_custkey", "c_name", "c_mktsegment", "'' as more"]
    rows = t.customer.selectExpr("c_custkey as place", "0 as sub", *[f"cast({c.split(' as ')[0]} as string) as c{i}" for i, c in enumerate(cells)])
    header = t.customer.where("c_mktsegment = 'BUILDING'").selectExpr(
        "min(c_custkey) as place", "1 as sub", "'status' as c0", "'c_custkey' as c1", "'c_name' as c2",
        "'c_mktsegment' as c3", "'more' as c4",
    )
    path = shared_folder(t.spark)
    rows.unionByName(header).orderBy("place", "sub").drop("place", "sub").write.csv(path)
    return catalog.read_meta_csv(catalog.read_raw_csv(t.spark, path), "status", "c_custkey", "c_mktsegment")


@register(
    "genre_table", "name:s genre:s",
    f"""SELECT id AS name, lower(genre) AS genre FROM v_samples
        WHERE lower(coalesce(genre, 'unknown')) IN {sql_list(dims.GENRE_CODES)}""",
)
def _(t):
    return catalog.genre_table(t.samples, "id", "genre")


CHORD_ROWS = """(SELECT file_id, array_to_string(progression, ',') AS text FROM v_progressions)"""


@register(
    "read_chord_csv", "file_id:l n:l last:s",
    f"""SELECT file_id, len(string_split(text, ',')) AS n, string_split(text, ',')[-1] AS last
        FROM {CHORD_ROWS}""",
)
def _(t):
    path = shared_folder(t.spark)
    sinks.write_chord_table(t.progressions.withColumnRenamed("file_id", "filename"), path)
    out = catalog.read_chord_table(t.spark, path)
    return out.select(
        F.col("filename").alias("file_id"), F.size("chord_progression").alias("n"),
        F.element_at("chord_progression", -1).alias("last"),
    )


@register(
    "load_examples", "example_id:l profile:s meta:s chord_hash:s note_seq:s",
    """SELECT example_id, profile, array_to_string(meta, ',') AS meta, chord_hash,
         array_to_string(note_seq, ',') AS note_seq FROM v_examples WHERE split = 'train'""",
)
def _(t):
    out = catalog.load_examples(t.examples, "train")
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


@register(
    "load_token_records", "example_id:l total:l n:l",
    """SELECT example_id, list_sum(note_seq) AS total, len(note_seq) AS n FROM v_examples""",
)
def _(t):
    out = catalog.load_token_records(t.examples)
    total = F.aggregate("targets", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("example_id", total.alias("total"), F.size("targets").alias("n"))


@register(
    "load_chord_vectors", "file_id:l chord_hash:s",
    f"SELECT file_id, md5(text) AS chord_hash FROM {CHORD_ROWS}",
)
def _(t):
    return catalog.load_chord_vectors(t.progressions)


@register(
    "sharded_write", "l_orderkey:l shard:l",
    """SELECT l_orderkey, (row_number() OVER (ORDER BY md5('0-' || l_orderkey), l_orderkey) - 1) // 100
         AS shard FROM (SELECT DISTINCT l_orderkey FROM lineitem)""",
)
def _(t):
    path = shared_folder(t.spark)
    sinks.sharded_write(t.lineitem.select("l_orderkey").distinct(), path, ["l_orderkey"], 100)
    return sinks.read_table(t.spark, path)


@register(
    "write_examples", "profile:s rows:l tokens:l",
    """SELECT profile, count(*) AS rows, sum(len(note_seq)) AS tokens FROM v_examples
       GROUP BY profile""",
)
def _(t):
    path = shared_folder(t.spark)
    sinks.write_examples(t.examples, path)
    return sinks.read_table(t.spark, path).groupBy("profile").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("note_seq")).alias("tokens")
    )


@register(
    "write_splits", "split:s rows:l",
    "SELECT split, count(*) AS rows FROM v_examples GROUP BY split",
)
def _(t):
    path = shared_folder(t.spark)
    sinks.write_splits(t.examples, path)
    return sinks.split_counts(sinks.read_table(t.spark, path))


@register(
    "written_examples", "example_id:l split:s chord_hash:s input:s target:s",
    """SELECT example_id, split, chord_hash, array_to_string(meta, ',') AS input,
         array_to_string(note_seq, ',') AS target FROM v_examples""",
)
def _(t):
    """A second version replaces the first for readers, whole."""
    path = shared_folder(t.spark)
    sinks.write_splits(t.examples.where("split = 'val'"), path)
    sinks.write_splits(t.examples, path)
    out = sinks.read_table(t.spark, path)
    return out.withColumns({"input": joined("input"), "target": joined("target")})


@register(
    "write_chord_table", "filename:l chord_progression:s chord_progression_hash:s",
    f"""SELECT file_id AS filename, text AS chord_progression, md5(text) AS chord_progression_hash
        FROM {CHORD_ROWS}""",
)
def _(t):
    path = shared_folder(t.spark)
    sinks.write_chord_table(t.progressions.withColumnRenamed("file_id", "filename"), path)
    return sinks.read_table(t.spark, path, header="true")


@register(
    "passage_export", "example_id:l text:s",
    """SELECT example_id, '[' || array_to_string(list_concat([638], note_seq,
         list_transform(range(0, 511 - len(note_seq)), lambda i: 0)), ', ') || ']' AS text
       FROM v_examples""",
)
def _(t):
    return sinks.passage_export(t.examples)


@register(
    "exclude_keyswitch", "file_id:l notes:l",
    """SELECT file_id, count(*) AS notes FROM v_notes_dense WHERE velocity <> 3 AND pitch <> 0
       GROUP BY file_id""",
)
def _(t):
    kept = notes.exclude_keyswitch(t.notes_dense, velocity=3)
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("notes"))


@register(
    "sample_filters", "id:s",
    """SELECT id FROM v_samples WHERE track_category NOT IN ('drums', 'percussion')
         AND len(first_progression) > 0 AND id IN (SELECT CAST(page_id AS VARCHAR) FROM pages)""",
)
def _(t):
    files = t.pages.selectExpr("cast(page_id as string) as stem")
    return catalog.sample_filters(t.samples, files)


AUG_IDS = """(SELECT CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR)
     WHEN 1 THEN o_custkey || '_cminor' ELSE o_custkey || '_gmajor_' || (60 + o_orderkey % 80) END
     AS id, o_orderkey FROM orders)"""


def augmented_ids(t):
    return t.orders.selectExpr(
        """case o_orderkey % 3 when 0 then cast(o_custkey as string)
           when 1 then concat(o_custkey, '_cminor')
           else concat(o_custkey, '_gmajor_', 60 + o_orderkey % 80) end as id""",
        "o_orderkey",
    )


@register(
    "parse_augmented_id", "o_orderkey:l parent_id:s aug_key:s aug_bpm:l",
    f"""SELECT o_orderkey, p[1] AS parent_id, p[2] AS aug_key, CAST(p[3] AS INTEGER) AS aug_bpm
        FROM (SELECT o_orderkey, string_split(id, '_') AS p FROM {AUG_IDS}) WHERE len(p) = 3""",
)
def _(t):
    return catalog.parse_augmented_id(augmented_ids(t))


@register(
    "samples_to_files", "o_orderkey:l id:s inst:s",
    f"""SELECT o_orderkey, s.id, s.inst FROM {AUG_IDS} a
        JOIN v_samples s ON s.id = string_split(a.id, '_')[1]""",
)
def _(t):
    files = augmented_ids(t).withColumnRenamed("id", "stem")
    return catalog.samples_to_files(files, t.samples)


@register(
    "strip_inst_number", "id:s inst:s",
    "SELECT id, string_split(inst, '-')[1] AS inst FROM v_samples",
)
def _(t):
    from scorelake.functions.scalars import strip_inst_number

    return t.samples.select("id", strip_inst_number(F.col("inst")).alias("inst"))


CATALOGUE = """(SELECT CASE WHEN n_nationkey % 2 = 0
       THEN 'Customer#0000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
       ELSE 'Customer#00000' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS name,
     CASE WHEN n_nationkey % 3 = 0 THEN 'jazz' ELSE 'rock' END AS genre,
     (n_nationkey * 7) % 25 AS name_order FROM nation)"""


@register(
    "genre_by_prefix", "stem:s name:s genre:s",
    f"""SELECT c_name AS stem, arg_min(name, name_order) AS name, arg_min(genre, name_order) AS genre
        FROM customer JOIN {CATALOGUE} ON starts_with(c_name, name) GROUP BY c_name""",
)
def _(t):
    names = t.nation.selectExpr(
        """if(n_nationkey % 2 = 0, concat('Customer#0000', lpad(n_nationkey, 2, '0')),
           concat('Customer#00000', lpad(n_nationkey, 2, '0'))) as name""",
        "if(n_nationkey % 3 = 0, 'jazz', 'rock') as genre",
        "(n_nationkey * 7) % 25 as name_order",
    )
    return catalog.genre_by_prefix(t.customer.selectExpr("c_name as stem"), names)


GENRE_CASE = " ".join(f"WHEN contains(text, '{g}') THEN '{g}'" for g in dims.GENRE_CODES)


@register(
    "genre_by_substring", "doc_id:l genre:s",
    f"SELECT doc_id, CASE {GENRE_CASE} ELSE 'cinematic' END AS genre FROM documents",
)
def _(t):
    from scorelake.functions.scalars import genre_from_path

    return t.documents.select("doc_id", genre_from_path(F.col("text")).alias("genre"))


@register(
    "chord_info_join", "stem:s chord_progression:s chord_progression_hash:s",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS stem, text AS chord_progression,
          coalesce(md5(text), 'unknown') AS chord_progression_hash
        FROM orders LEFT JOIN {CHORD_ROWS} c ON c.file_id = o_orderkey""",
)
def _(t):
    table = sinks.chord_table(
        t.progressions.withColumn("filename", F.col("file_id").cast("string"))
    )
    files = t.orders.selectExpr("cast(o_orderkey as string) as stem")
    return catalog.chord_info_join(files, table)


@register(
    "chord_vector_join", "example_id:l total:d",
    """WITH v AS (SELECT md5(CAST(2 * vec_id AS VARCHAR)) AS chord_hash, label FROM embeddings)
       SELECT example_id, CASE WHEN v.label IS NULL THEN 4.0 ELSE v.label * 2.0 END AS total
       FROM v_examples LEFT JOIN v USING (chord_hash)""",
)
def _(t):
    vectors = t.embeddings.selectExpr(
        "md5(cast(2 * vec_id as string)) as chord_hash",
        "array(cast(label as float), cast(label as float)) as vector",
    )
    out = catalog.chord_vector_join(t.examples, vectors, 4)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return out.select("example_id", total.alias("total"))


OBJECTS = """(SELECT 'Customer#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') || '/' || o_orderkey
     || '.mid' AS object_key, o_orderkey % 4 AS size FROM orders)"""


def objects(t):
    return t.orders.selectExpr(
        "concat('Customer#', lpad(o_custkey * 2, 9, '0'), '/', o_orderkey, '.mid') as object_key",
        "o_orderkey % 4 as size",
    )


def sample_paths(t):
    return t.customer.selectExpr("c_custkey as id", "c_name as path")


@register(
    "manifest_join", "id:l object_key:s size:l",
    f"""SELECT c_custkey AS id, object_key, size FROM customer JOIN {OBJECTS}
        ON starts_with(object_key, c_name) WHERE size > 0""",
)
def _(t):
    return catalog.manifest_join(sample_paths(t), objects(t))[0]


@register(
    "manifest_errors", "id:l",
    f"""SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM {OBJECTS}
        WHERE starts_with(object_key, c_name))""",
)
def _(t):
    return catalog.manifest_join(sample_paths(t), objects(t))[1]


@register(
    "skip_processed", "subset:l",
    """SELECT c_custkey AS subset FROM customer
       WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    done = t.orders.where("o_orderstatus = 'F'").selectExpr("o_custkey as subset")
    return catalog.skip_processed(t.customer.selectExpr("c_custkey as subset"), done)


@register(
    "avg_bpm", "file_id:l avg_bpm:l",
    """WITH d AS (SELECT t.file_id, bpm, end_sec, lead(time_sec, 1, end_sec) OVER (
           PARTITION BY t.file_id ORDER BY seq) - time_sec AS dur
         FROM v_tempo t JOIN v_tempo_end e USING (file_id)),
       a AS (SELECT file_id, CASE WHEN count(*) = 1 THEN max(bpm)
           ELSE CAST(floor(sum(bpm * dur) / max(end_sec)) AS BIGINT) END AS v FROM d GROUP BY file_id)
       SELECT file_id, v - v % 5 AS avg_bpm FROM a""",
)
def _(t):
    return notes.avg_bpm(t.tempo, t.tempo_end)


@register(
    "augment_bpm", "file_id:l seq:l bpm_shift:l bpm:l",
    """WITH d AS (SELECT t.file_id, bpm, end_sec, lead(time_sec, 1, end_sec) OVER (
           PARTITION BY t.file_id ORDER BY seq) - time_sec AS dur
         FROM v_tempo t JOIN v_tempo_end e USING (file_id)),
       a AS (SELECT file_id, CASE WHEN count(*) = 1 THEN max(bpm)
           ELSE CAST(floor(sum(bpm * dur) / max(end_sec)) AS BIGINT) // 5 * 5 END AS v
         FROM d GROUP BY file_id)
       SELECT file_id, seq, s AS bpm_shift, v + 5 * s AS bpm FROM v_tempo JOIN a USING (file_id)
       CROSS JOIN range(-2, 3) r(s)""",
)
def _(t):
    return notes.augment_bpm(t.tempo, t.tempo_end)


PITCH_CASE = " ".join(f"WHEN m < {c} THEN '{n}'" for n, c in dims.PITCH_RANGE_CUTS.items())


@register(
    "pitch_range", "file_id:l pitch_range:s",
    f"""SELECT file_id, CASE {PITCH_CASE} END AS pitch_range FROM (SELECT file_id, avg(pitch) AS m
        FROM v_notes_dense WHERE pitch <> 0 AND velocity <> 1 AND track_name <> 'chord'
        GROUP BY file_id)""",
)
def _(t):
    return meta.pitch_ranges(t.notes_dense)


@register(
    "velocity_range", "file_id:l min_velocity:l max_velocity:l",
    """SELECT file_id, min(velocity) AS min_velocity, max(velocity) AS max_velocity
       FROM v_notes_dense WHERE channel <> 5 AND velocity <> 1 GROUP BY file_id""",
)
def _(t):
    return meta.velocity_ranges(t.notes_dense)


TRACKS = """(SELECT file_id, track_idx, arg_min(text, event_idx) AS track_name FROM v_events
             GROUP BY ALL)"""
CC_AGGS = ", ".join(
    f"min(value) FILTER (WHERE control = {n}) AS min_{k}, max(value) FILTER (WHERE control = {n})"
    f" AS max_{k}"
    for k, n in dims.CONTROLS.items()
)
CC_SQL = f"""(SELECT c.file_id, {CC_AGGS} FROM v_cc c JOIN (SELECT file_id, min(track_idx)
      AS track_idx FROM {TRACKS} WHERE track_idx > 0 AND track_name <> 'chord' GROUP BY file_id)
      USING (file_id, track_idx) GROUP BY c.file_id)"""


def track_table(t):
    return t.midi_events.groupBy("file_id", "track_idx").agg(
        F.min_by("text", "event_idx").alias("track_name")
    )


@register(
    "cc_range",
    "file_id:l min_modulation:l max_modulation:l min_expression:l max_expression:l"
    " min_sustain:l max_sustain:l",
    f"SELECT * FROM {CC_SQL}",
)
def _(t):
    return meta.cc_ranges(t.cc, track_table(t))


MEASURES = """SELECT file_id, CAST(ceil((arg_max(end_tick, note_idx)
    - {base}) / 1920.0) AS BIGINT) AS num_measures FROM v_notes_dense {where} GROUP BY file_id"""


@register(
    "num_measures", "file_id:l num_measures:l",
    MEASURES.format(base="arg_min(start_tick, note_idx) // 1920 * 1920", where=""),
)
def _(t):
    return meta.num_measures(t.notes_dense)


@register(
    "num_measures_span", "file_id:l num_measures:l",
    MEASURES.format(base="arg_min(start_tick, note_idx)", where="WHERE track_name = 'chord'"),
)
def _(t):
    return meta.num_measures_span(t.notes_dense, "chord")


@register(
    "last_meta_message", "file_id:l value:l",
    """SELECT file_id, arg_max(value, event_idx) AS value FROM v_events
       WHERE track_idx = 0 AND type = 'set_tempo' GROUP BY file_id""",
)
def _(t):
    return meta.last_meta_message(t.midi_events, "set_tempo")


@register(
    "unique_meta_message", "file_id:l value:l",
    """WITH m AS (SELECT file_id, bpm // 60 AS value, lag(bpm // 60) OVER (PARTITION BY file_id
         ORDER BY seq) AS pv FROM v_tempo)
       SELECT file_id, min(value) AS value FROM m WHERE pv IS NULL OR pv <> value
       GROUP BY file_id HAVING count(DISTINCT value) = 1""",
)
def _(t):
    rows = t.tempo.selectExpr("file_id", "seq", "'set_tempo' as type", "bpm div 60 as value")
    return meta.unique_meta_message(rows, "set_tempo")


@register(
    "unique_meters", "file_id:l time_sec:l numerator:l denominator:l",
    """SELECT file_id, time_sec // 20 AS time_sec, arg_max(1 + bpm % 7, seq) AS numerator,
         arg_max(4, seq) AS denominator FROM v_tempo GROUP BY file_id, time_sec // 20""",
)
def _(t):
    rows = t.tempo.selectExpr(
        "file_id", "seq", "time_sec div 20 as time_sec", "1 + bpm % 7 as numerator",
        "4 as denominator",
    )
    return meta.unique_meters(rows)


FAMILY_CASE = " ".join(
    f"WHEN p BETWEEN {a} AND {b} THEN {c}" for a, b, c in dims.PROGRAM_FAMILIES
)


@register(
    "inst_code", "file_id:l program:l inst:l",
    f"""SELECT file_id, p AS program, CASE {FAMILY_CASE} END AS inst FROM (
          SELECT file_id, arg_min(program, track_idx * 10000000 + note_idx) AS p
          FROM v_notes_dense GROUP BY file_id)""",
)
def _(t):
    return meta.inst_codes(t.notes_dense)


@register(
    "file_end", "file_id:l end_tick:l",
    "SELECT file_id, max(end_tick) AS end_tick FROM v_notes_dense GROUP BY file_id",
)
def _(t):
    return notes.file_end(t.notes_dense)


ATTR = "file_id:l bpm:l audio_key:s time_signature:s"


@register(
    "code_lookup", "file_id:l time_signature:s meter_code:l",
    f"""SELECT file_id, time_signature, {sql_map(dims.METER_CODES)}[time_signature] AS meter_code
        FROM v_attrs WHERE time_signature IS NULL
          OR {sql_map(dims.METER_CODES)}[time_signature] IS NOT NULL""",
)
def _(t):
    codes = dims.dim(t.spark, dims.METER_CODES, "time_signature")
    return meta.code_lookup(t.attrs, codes, "time_signature", "meter_code", "reject")


@register(
    "default_to_unknown", ATTR,
    """SELECT file_id, CASE WHEN d THEN NULL ELSE bpm END AS bpm,
         CASE WHEN d THEN NULL ELSE audio_key END AS audio_key,
         CASE WHEN d THEN NULL ELSE time_signature END AS time_signature
       FROM (SELECT *, coalesce(bpm = 120 AND audio_key = 'cmajor' AND time_signature = '4/4',
             false) AS d FROM v_attrs)""",
)
def _(t):
    return meta.default_to_unknown(t.attrs)


@register(
    "keep_measures", "file_id:l num_measures:l",
    "SELECT file_id, num_measures FROM v_attrs WHERE num_measures IN (4, 8)",
)
def _(t):
    return meta.keep_measures(t.attrs)


def encode_sql(source: str, inst: dict | None = None) -> str:
    def coded(name, unknown, offset, codes):
        return (f"CASE WHEN {name} IS NULL THEN {unknown} ELSE {offset} + "
                f"{sql_map(codes)}[{name}] END")

    ranges = {n: i for i, n in enumerate(dims.PITCH_RANGE_CUTS)}

    def low(name, unknown, offset, step):
        return f"coalesce({offset} + {name} // {step}, {unknown})"

    def high(name, unknown, offset, step):
        return f"coalesce({offset} + CAST(ceil({name} / {step}.0) AS INTEGER), {unknown})"

    parts = [
        "CASE WHEN bpm IS NULL THEN 422 ELSE 423 + least(bpm, 199) // 5 END",
        coded("audio_key", 463, 464, dims.KEY_CODES),
        coded("time_signature", 488, 489, dims.METER_CODES),
        coded("pitch_range", 506, 507, ranges),
        "CASE WHEN num_measures = 4 THEN 514 WHEN num_measures IS NOT NULL THEN 515 END",
        coded("inst", 516, 517, inst or dims.program_families()),
        coded("genre", 525, 526, dims.GENRE_CODES),
        low("min_velocity", 539, 540, 5), high("max_velocity", 539, 540, 5),
        coded("track_category", 567, 568, dims.CATEGORY_CODES),
        "CASE WHEN chord_progression IS NULL THEN 575 ELSE 574 END",
        coded("rhythm", 576, 577, dims.RHYTHM_CODES),
        low("min_modulation", 579, 580, 5), high("max_modulation", 579, 580, 5),
        low("min_expression", 607, 608, 5), high("max_expression", 607, 608, 5),
        low("min_sustain", 635, 636, 127), high("max_sustain", 635, 636, 127),
    ]
    return f"""(SELECT * FROM (SELECT *, [{', '.join(parts)}] AS meta FROM {source})
                WHERE len(list_filter(meta, lambda x: x IS NULL)) = 0)"""


@register(
    "encode_meta", "file_id:l meta:s",
    f"SELECT file_id, array_to_string(meta, ',') AS meta FROM {encode_sql('v_attrs')}",
)
def _(t):
    out = meta.encode_meta(t.attrs, profiles.WEB)
    return out.select("file_id", joined("meta").alias("meta"))


@register(
    "encode_meta_legacy", "file_id:l meta:s",
    f"""SELECT file_id, concat_ws(',', coalesce(423 + CASE WHEN bpm >= 200 THEN 39 ELSE bpm // 5 END,
          422), coalesce(464 + {sql_map(dims.KEY_CODES)}[audio_key], 463),
          coalesce(489 + {sql_map(dims.METER_CODES)}[time_signature], 488),
          coalesce(507 + {sql_map({n: i for i, n in enumerate(dims.PITCH_RANGE_CUTS)})}[pitch_range],
          506), CASE num_measures WHEN 4 THEN 514 ELSE 515 END,
          517 + CAST(inst AS INTEGER) % 8) AS meta
        FROM v_attrs WHERE num_measures IN (4, 8)""",
)
def _(t):
    attrs = t.attrs.withColumn("inst", F.col("inst").cast("int") % 8)
    out = meta.encode_meta_legacy(attrs)
    return out.select("file_id", joined("meta").alias("meta"))


@register(
    "decode_meta", "file_id:l codes:s",
    f"""SELECT file_id, array_to_string([meta[1] - 423, meta[2] - 464, meta[3] - 489, meta[4] - 507,
          meta[5], meta[6] - 517, meta[7] - 526, meta[8] - 540, meta[9] - 540, meta[10] - 568,
          meta[11] - 574, meta[12] - 577, meta[13] - 580, meta[14] - 580, meta[15] - 608,
          meta[16] - 608, meta[17] - 636, meta[18] - 636], ',') AS codes
        FROM {encode_sql('v_attrs')}""",
)
def _(t):
    out = meta.decode_meta(meta.encode_meta(t.attrs, profiles.WEB))
    return out.select("file_id", joined("codes").alias("codes"))


@register(
    "shift_meta_for_bar", "example_id:l meta:s",
    """SELECT example_id, array_to_string(list_transform(meta[1:12], lambda x: x + 11), ',') AS meta
       FROM v_examples""",
)
def _(t):
    out = t.examples.withColumn("meta", meta.shift_meta_for_bar(F.col("meta")))
    return out.select("example_id", joined("meta").alias("meta"))


PARSED = f"""(SELECT h.file_id, CASE WHEN d THEN NULL ELSE h.bpm END AS bpm,
    CASE WHEN d THEN NULL ELSE audio_key END AS audio_key,
    CASE WHEN d THEN NULL ELSE time_signature END AS time_signature,
    h.genre, h.track_category, h.chord_progression, h.rhythm, CASE {PITCH_CASE} END AS pitch_range,
    CAST(ceil((z - a // 1920 * 1920) / 1920.0) AS INTEGER) AS num_measures,
    CAST(p AS VARCHAR) AS inst, n.min_velocity, n.max_velocity, c.* EXCLUDE (file_id)
  FROM (SELECT *, coalesce(bpm = 120 AND audio_key = 'cmajor' AND time_signature = '4/4', false)
        AS d FROM v_attrs) h
  LEFT JOIN (SELECT file_id, avg(pitch) FILTER (WHERE pitch <> 0 AND velocity <> 1
        AND track_name <> 'chord') AS m,
      min(velocity) FILTER (WHERE channel <> 5) AS min_velocity,
      max(velocity) FILTER (WHERE channel <> 5) AS max_velocity,
      arg_min(program, track_idx * 10000000 + note_idx) AS p,
      arg_min(start_tick, note_idx) AS a, arg_max(end_tick, note_idx) AS z
    FROM v_notes_dense GROUP BY file_id) n USING (file_id)
  LEFT JOIN {CC_SQL} c USING (file_id))"""


def parsed(t):
    header = t.attrs.select(
        "file_id", "bpm", "audio_key", "time_signature", "genre", "track_category",
        "chord_progression", "rhythm",
    )
    return meta.parse_meta(t.notes_dense, t.cc, track_table(t), header, profiles.WEB)


@register(
    "parse_meta",
    "file_id:l bpm:l audio_key:s time_signature:s pitch_range:s num_measures:l inst:s"
    " min_velocity:l max_velocity:l min_modulation:l max_expression:l max_sustain:l",
    f"SELECT * FROM {PARSED}",
)
def _(t):
    return parsed(t)
