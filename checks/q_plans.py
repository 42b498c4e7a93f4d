"""Whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_meta import CC_SQL, encode_sql, sql_map, track_table
from checks.registry import joined, register
from checks.views import pick
from scorelake import dims
from scorelake.plans import corpus
from scorelake.session import shared_folder
from scorelake.sources import sinks

PITCH_CASE = " ".join(f"WHEN m < {c} THEN '{n}'" for n, c in dims.PITCH_RANGE_CUTS.items())
SEG = "file_id, track_idx, chunk_idx, n_bars, window_idx"
GENRE_CASE = " ".join(f"WHEN contains(path, '{g}') THEN '{g}'" for g in dims.GENRE_CODES)


def header(t):
    return t.attrs.selectExpr(
        "file_id", "audio_key", "time_signature",
        "concat('/Corpus/', coalesce(genre, 'x'), '/f', file_id) as path",
    )


WEB_SQL = f"""
  tempo_d AS (SELECT t.file_id, bpm, end_sec, lead(time_sec, 1, end_sec) OVER (
    PARTITION BY t.file_id ORDER BY seq) - time_sec AS dur
    FROM v_tempo t JOIN v_tempo_end e USING (file_id)),
  tempo_a AS (SELECT file_id, CASE WHEN count(*) = 1 THEN max(bpm)
    ELSE CAST(floor(sum(bpm * dur) / max(end_sec)) AS BIGINT) END // 5 * 5 AS bpm
    FROM tempo_d GROUP BY file_id HAVING count(*) <= 8),
  facts AS (SELECT a.file_id, a.bpm, audio_key, time_signature,
      lower('/Corpus/' || coalesce(genre, 'x') || '/f' || a.file_id) AS path,
      CASE coalesce(time_signature, '4/4') WHEN '4/4' THEN 1920 WHEN '3/4' THEN 1440
        WHEN '5/8' THEN 1200 ELSE 1440 END AS bar
    FROM tempo_a a JOIN v_attrs USING (file_id)),
  mel AS (SELECT * FROM v_notes_dense WHERE track_name <> 'chord'),
  okt AS (SELECT file_id, track_idx FROM mel GROUP BY ALL HAVING arg_min(channel, note_idx) <> 9
    AND arg_min(program, note_idx) NOT IN (55,96,97,98,99,100,101,102,103,113,114,115,116,117,118,
      119,120,121,122,123,124,125,126,127)),
  timed AS (SELECT m.* EXCLUDE (bpm), f.bpm, f.bar, start_tick * 600 // (480 * f.bpm) AS sb,
      end_tick * 600 // (480 * f.bpm) AS eb
    FROM mel m JOIN okt USING (file_id, track_idx) JOIN facts f USING (file_id)),
  prev AS (SELECT *, max(eb) OVER (PARTITION BY file_id, track_idx ORDER BY sb, note_idx
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM timed),
  numbered AS (SELECT *, sum(CASE WHEN pe IS NULL OR sb - pe - 1 >= 20 THEN 1 ELSE 0 END) OVER
      (PARTITION BY file_id, track_idx ORDER BY sb, note_idx ROWS UNBOUNDED PRECEDING) - 1
      AS chunk_idx FROM prev),
  sized AS (SELECT *, min(sb) OVER w AS c0, max(eb) OVER w AS c1, min(start_tick) OVER w AS t0
    FROM numbered WINDOW w AS (PARTITION BY file_id, track_idx, chunk_idx)),
  ch AS (SELECT * REPLACE (start_tick - t0 AS start_tick, end_tick - t0 AS end_tick) FROM sized
    WHERE c1 - c0 >= 80),
  sp AS (SELECT file_id, track_idx, chunk_idx, bar, arg_min(start_tick, note_idx) AS f,
      max(end_tick) AS l FROM ch GROUP BY ALL),
  win AS (SELECT file_id, track_idx, chunk_idx, k AS n_bars, i AS window_idx, f + i * bar AS ws,
      f + i * bar + k * bar AS we FROM sp CROSS JOIN (SELECT unnest([4, 8]) AS k)
    CROSS JOIN range(0, 64) r(i) WHERE f + i * bar < l - k * bar + bar),
  seg0 AS (SELECT w.n_bars, w.window_idx, ws, we, ch.* REPLACE (greatest(start_tick, ws) - ws
      AS start_tick, least(end_tick, we) - ws AS end_tick)
    FROM ch JOIN win w USING (file_id, track_idx, chunk_idx)
    WHERE (start_tick >= ws AND start_tick < we) OR (end_tick > ws AND end_tick <= we)),
  whole AS (SELECT file_id, track_idx, chunk_idx, n_bars FROM win w LEFT JOIN (SELECT DISTINCT
      {SEG}, 1 AS hit FROM seg0) USING ({SEG}) GROUP BY ALL HAVING count(*) = count(hit)),
  seg AS (SELECT s.* FROM seg0 s JOIN whole USING (file_id, track_idx, chunk_idx, n_bars)),
  stats AS (SELECT {SEG}, max(bpm) AS bpm, max(bar) AS bar,
      avg(pitch) FILTER (WHERE pitch <> 0 AND velocity <> 1) AS m,
      min(velocity) FILTER (WHERE channel <> 5) AS min_velocity,
      max(velocity) FILTER (WHERE channel <> 5) AS max_velocity,
      arg_min(program, note_idx) AS p, arg_min(start_tick, note_idx) AS a,
      arg_max(end_tick, note_idx) AS z FROM seg GROUP BY ALL),
  known AS (SELECT s.*, audio_key AS k0, time_signature AS t1, path,
      coalesce(s.bpm = 120 AND audio_key = 'cmajor' AND time_signature = '4/4', false) AS d
    FROM stats s JOIN facts USING (file_id)),
  parsed AS (SELECT {SEG}, CASE WHEN d THEN NULL ELSE bpm END AS bpm,
      CASE WHEN d THEN NULL ELSE k0 END AS audio_key,
      CASE WHEN d THEN NULL ELSE t1 END AS time_signature, CASE {PITCH_CASE} END AS pitch_range,
      CAST(ceil((z - a // bar * bar) / CAST(bar AS DOUBLE)) AS INTEGER) AS num_measures,
      CAST(p AS VARCHAR) AS inst, CASE {GENRE_CASE} ELSE 'cinematic' END AS genre,
      min_velocity, max_velocity, CAST(NULL AS VARCHAR) AS track_category,
      CAST(NULL AS VARCHAR) AS chord_progression, CAST(NULL AS VARCHAR) AS rhythm,
      CAST(NULL AS INTEGER) AS min_modulation, CAST(NULL AS INTEGER) AS max_modulation,
      CAST(NULL AS INTEGER) AS min_expression, CAST(NULL AS INTEGER) AS max_expression,
      CAST(NULL AS INTEGER) AS min_sustain, CAST(NULL AS INTEGER) AS max_sustain FROM known),
  en AS (SELECT * FROM {encode_sql('parsed')}),
  o AS (SELECT *, row_number() OVER (PARTITION BY {SEG} ORDER BY start_tick, pitch, note_idx) - 1
      AS idx, (12000 * start_tick + 480 * bpm) // (960 * bpm) AS s0,
      (12000 * end_tick + 480 * bpm) // (960 * bpm) AS e0 FROM seg),
  n AS (SELECT *, CASE WHEN e0 = s0 THEN e0 + 1 ELSE e0 END AS e1 FROM o),
  raw AS (SELECT {SEG}, s0 AS step, idx, 3 AS prio, pitch + 2 AS token, (velocity - 1) // 2 + 1 AS vb
      FROM n UNION ALL SELECT {SEG}, e1, idx, 4, pitch + 130, NULL FROM n),
  ev AS (SELECT *, row_number() OVER w AS ord, step - lag(step, 1, 0) OVER w AS gap,
      coalesce(last_value(vb IGNORE NULLS) OVER (PARTITION BY {SEG} ORDER BY step, idx, prio
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pvb FROM raw
    WINDOW w AS (PARTITION BY {SEG} ORDER BY step, idx, prio)),
  lists AS (SELECT {SEG}, list_append(flatten(list(list_concat(
      list_transform(range(0, (gap + 99) // 100), lambda s: 257 + least(100, gap - 100 * s)),
      CASE WHEN vb <> pvb THEN [357 + vb] ELSE [] END, [token]) ORDER BY ord)), 1) AS note_seq
    FROM ev GROUP BY ALL),
  examples AS (SELECT {SEG}, meta, note_seq FROM en JOIN lists USING ({SEG}))"""


def web_rows(t):
    return corpus.web_examples(t.notes_dense, t.tempo, t.tempo_end, header(t))


@register(
    "web_examples",
    "file_id:l track_idx:l chunk_idx:l n_bars:l window_idx:l meta:s note_seq:s",
    f"""WITH {WEB_SQL} SELECT {SEG}, array_to_string(meta, ',') AS meta,
          array_to_string(note_seq, ',') AS note_seq FROM examples""",
)
def web_examples(t):
    out = web_rows(t.written("lines", "tempo"))
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


WEB_BAR_SQL = f"""
  placed AS (SELECT {SEG}, start_tick, end_tick, pitch, velocity, note_idx, cb, start_tick // cb AS rb,
      row_number() OVER (PARTITION BY {SEG}, start_tick // cb ORDER BY start_tick, pitch, note_idx) AS place
    FROM seg JOIN (SELECT file_id, CASE coalesce(time_signature, '4/4') WHEN '4/4' THEN 1920
      WHEN '5/8' THEN 1200 ELSE 1440 END AS cb FROM facts) USING (file_id)),
  binned AS (SELECT *, least(cb // (cb // 128) - 1, greatest(0, (2 * (end_tick - start_tick) + cb // 128 - 1)
      // (2 * (cb // 128)) - 1)) AS dur FROM placed),
  bar_lists AS (SELECT {SEG}, list_append(flatten(list(list_concat(CASE WHEN place = 1 THEN [2] ELSE [] END,
      [401 + least(31, ((start_tick - rb * cb) * 64 + cb - 1) // (2 * cb)), 131 + least(31, velocity // 4),
      3 + pitch], CASE WHEN dur < 130 THEN [271 + dur] ELSE [] END) ORDER BY rb, place)), 1) AS note_seq
    FROM binned GROUP BY ALL)"""


@register(
    "web_examples_bar",
    "file_id:l track_idx:l chunk_idx:l n_bars:l window_idx:l meta:s note_seq:s",
    f"""WITH {WEB_SQL}, {WEB_BAR_SQL}
        SELECT {SEG}, array_to_string(list_transform(meta[1:12], lambda x: x + 11), ',') AS meta,
          array_to_string(b.note_seq, ',') AS note_seq FROM en JOIN bar_lists b USING ({SEG})""",
)
def web_examples_bar(t):
    t = t.written("lines", "tempo")
    out = corpus.web_examples(t.notes_dense, t.tempo, t.tempo_end, header(t), encoder="bar")
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


STEADY_SQL = WEB_SQL.replace(
    "FROM tempo_a a JOIN v_attrs USING (file_id)),",
    """FROM tempo_a a JOIN v_attrs USING (file_id)
    WHERE file_id NOT IN (SELECT file_id FROM v_events WHERE type = 'key_signature' AND value % 2 = 0
        GROUP BY file_id HAVING count(*) > 8)
      AND file_id NOT IN (SELECT file_id FROM v_events WHERE type = 'time_signature' AND value % 9 = 0
        GROUP BY file_id HAVING count(*) > 1)),""",
)


@register(
    "web_examples_steady",
    "file_id:l track_idx:l chunk_idx:l n_bars:l window_idx:l meta:s note_seq:s",
    f"""WITH {STEADY_SQL} SELECT {SEG}, array_to_string(meta, ',') AS meta,
          array_to_string(note_seq, ',') AS note_seq FROM examples""",
)
def web_examples_steady(t):
    t = t.written("lines", "tempo", "_user_events")
    keys = t.midi_events.where("type = 'key_signature' and value % 2 = 0")
    meters = t.midi_events.where("type = 'time_signature' and value % 9 = 0")
    out = corpus.web_examples(
        t.notes_dense, t.tempo, t.tempo_end, header(t), key_changes=keys, meter_changes=meters
    )
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


# --- catalogue --------------------------------------------------------------

SAMPLES_SQL = """(SELECT CAST(c_custkey AS VARCHAR) AS id, 60 + c_custkey % 160 AS bpm,
    ['c', 'f#', 'bbmajor', 'h'][c_custkey % 4 + 1] AS audio_key,
    ['major', 'minor'][c_custkey % 2 + 1] AS chord_type, ['4/4', '3/4'][c_custkey % 2 + 1]
      AS time_signature,
    ['acoustic_piano-1', 'bell-22', 'flute', 'kazoo-1', 'synth_bass_808-3'][c_custkey % 5 + 1] AS inst,
    ['jazz', 'edm', NULL][c_custkey % 3 + 1] AS genre,
    ['main_melody', 'bass', 'drums', 'pad', 'percussion', 'riff'][c_custkey % 6 + 1] AS track_category,
    ['standard', 'swing', NULL][c_custkey // 2 % 3 + 1] AS rhythm,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'C,Am' END AS chords FROM customer)"""

CATALOG_SQL = f"""
  smp AS (SELECT * FROM {SAMPLES_SQL} WHERE track_category NOT IN ('drums', 'percussion')
    AND chords IS NOT NULL),
  stems AS (SELECT DISTINCT file_id, CASE file_id % 3 WHEN 0 THEN [CAST(file_id AS VARCHAR)]
    WHEN 1 THEN [CAST(file_id AS VARCHAR), 'gmajor', CAST(60 + file_id % 80 AS VARCHAR)]
    ELSE [CAST(file_id AS VARCHAR), 'x'] END AS p FROM v_notes_dense),
  head AS (SELECT file_id, CASE WHEN len(p) = 3 THEN CAST(p[3] AS BIGINT) ELSE bpm END AS bpm,
      CASE WHEN len(p) = 3 THEN p[2] WHEN contains(audio_key, 'major') OR contains(audio_key, 'minor')
        THEN audio_key ELSE audio_key || chord_type END AS audio_key, time_signature,
      string_split(inst, '-')[1] AS inst, genre, track_category, chords AS chord_progression, rhythm
    FROM stems JOIN smp ON smp.id = p[1] WHERE len(p) <> 2),
  mel AS (SELECT * FROM v_notes_dense WHERE track_name <> 'chord'),
  stats AS (SELECT file_id, avg(pitch) FILTER (WHERE pitch <> 0 AND velocity <> 1) AS m,
      min(velocity) FILTER (WHERE channel <> 5 AND velocity <> 1) AS min_velocity,
      max(velocity) FILTER (WHERE channel <> 5 AND velocity <> 1) AS max_velocity,
      arg_min(start_tick, note_idx) AS a, arg_max(end_tick, note_idx) AS z FROM mel GROUP BY file_id),
  parsed AS (SELECT h.*, CASE {PITCH_CASE} END AS pitch_range,
      CAST(ceil((z - a // 1920 * 1920) / 1920.0) AS INTEGER) AS num_measures,
      s.min_velocity, s.max_velocity, c.* EXCLUDE (file_id)
    FROM head h LEFT JOIN stats s USING (file_id) LEFT JOIN {CC_SQL} c USING (file_id)),
  en AS (SELECT * FROM {encode_sql('parsed', dims.INSTRUMENT_FAMILIES)}),
  o AS (SELECT n.* EXCLUDE (bpm), h.bpm, row_number() OVER (PARTITION BY n.file_id ORDER BY start_tick,
      pitch, note_idx) - 1 AS idx, (12000 * start_tick + 480 * h.bpm) // (960 * h.bpm) AS s0,
      (12000 * end_tick + 480 * h.bpm) // (960 * h.bpm) AS e0 FROM mel n JOIN head h USING (file_id)),
  n AS (SELECT *, CASE WHEN e0 = s0 THEN e0 + 1 ELSE e0 END AS e1 FROM o),
  raw AS (SELECT file_id, s0 AS step, idx, 3 AS prio, pitch + 2 AS token, (velocity - 1) // 2 + 1 AS vb
      FROM n UNION ALL SELECT file_id, e1, idx, 4, pitch + 130, NULL FROM n),
  ev AS (SELECT *, row_number() OVER w AS ord, step - lag(step, 1, 0) OVER w AS gap,
      coalesce(last_value(vb IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY step, idx, prio
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pvb FROM raw
    WINDOW w AS (PARTITION BY file_id ORDER BY step, idx, prio)),
  lists AS (SELECT file_id, list_append(flatten(list(list_concat(
      list_transform(range(0, (gap + 99) // 100), lambda s: 257 + least(100, gap - 100 * s)),
      CASE WHEN vb <> pvb THEN [357 + vb] ELSE [] END, [token]) ORDER BY ord)), 1) AS note_seq
    FROM ev GROUP BY ALL)"""


def catalog_samples(t):
    return t.customer.selectExpr(
        "cast(c_custkey as string) as id", "cast(60 + c_custkey % 160 as int) as bpm",
        pick(["c", "f#", "bbmajor", "h"], "c_custkey % 4") + " as audio_key",
        pick(["major", "minor"], "c_custkey % 2") + " as chord_type",
        pick(["4/4", "3/4"], "c_custkey % 2") + " as time_signature",
        pick(["acoustic_piano-1", "bell-22", "flute", "kazoo-1", "synth_bass_808-3"], "c_custkey % 5")
        + " as inst",
        pick(["jazz", "edm", None], "c_custkey % 3") + " as genre",
        pick(["main_melody", "bass", "drums", "pad", "percussion", "riff"], "c_custkey % 6")
        + " as track_category",
        pick(["standard", "swing", None], "(c_custkey div 2) % 3") + " as sample_rhythm",
        "if(c_custkey % 7 = 0, array(), array(array('C', 'Am'))) as chord_progressions",
    )


def catalog_rows(t):
    files = t.notes_dense.select("file_id").distinct().selectExpr(
        "file_id",
        """case file_id % 3 when 0 then cast(file_id as string)
           when 1 then concat(file_id, '_gmajor_', 60 + file_id % 80)
           else concat(file_id, '_x') end as stem""",
    )
    return corpus.catalog_examples(
        catalog_samples(t), files, t.notes_dense, t.cc, track_table(t)
    )


@register(
    "catalog_examples", "file_id:l meta:s chord_hash:s note_seq:s",
    f"""WITH {CATALOG_SQL} SELECT en.file_id, array_to_string(meta, ',') AS meta,
          md5(chord_progression) AS chord_hash, array_to_string(note_seq, ',') AS note_seq
        FROM en JOIN lists USING (file_id)""",
)
def catalog_examples(t):
    out = catalog_rows(t.written("lines", "_user_events"))
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


# --- tagged corpus: chord track, genre table, chord table -------------------

GENRES = """(SELECT 'file-' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'jazz'
    ELSE 'rock' END AS genre, (n_nationkey * 7) % 25 AS name_order FROM nation)"""
TAGGED_CHORDS = """(SELECT 2 * file_id AS file_id, array_to_string(progression, ',') AS text
    FROM v_progressions)"""
CATEGORY = sql_map(dims.CHANNEL_CATEGORIES)
TAGGED_BASE = WEB_SQL.split("  sp AS (")[0].split("HAVING arg_min(channel")[0] + (
    "HAVING arg_min(channel, note_idx) NOT IN (6, 9, 10, 11)),\n  timed AS (" +
    WEB_SQL.split("  sp AS (")[0].split("  timed AS (")[1]
)
TAGGED_END = "  whole AS (" + WEB_SQL.split("  whole AS (")[1].split("  stats AS (")[0]
TAGGED_TOKENS = "  o AS (" + WEB_SQL.split("  o AS (")[1].split("  examples AS (")[0]

TAGGED_SQL = f"""{TAGGED_BASE}
  ext AS (SELECT file_id, track_idx, chunk_idx, max(bar) AS bar, max(t0) AS cs,
      arg_max(end_tick, note_idx) + max(t0) AS ce FROM ch GROUP BY ALL),
  crd AS (SELECT file_id, note_idx AS cn, start_tick AS s1, end_tick AS e1 FROM v_notes_dense
    WHERE track_name = 'chord'),
  fc AS (SELECT e.*, arg_min(s1, cn) AS chs FROM ext e JOIN crd USING (file_id)
    WHERE s1 >= cs AND e1 <= ce GROUP BY ALL),
  lim AS (SELECT *, (cs + bar - 1) // bar * bar AS me, (ce + bar - 1) // bar * bar AS ee FROM fc),
  low AS (SELECT *, CASE WHEN greatest(0, me - bar) < chs THEN me ELSE greatest(0, me - bar) END AS lo
    FROM lim),
  snap AS (SELECT file_id, track_idx, chunk_idx, cn, s1 - chs AS s1, e1 - chs AS e1 FROM low
    JOIN crd USING (file_id) WHERE s1 >= lo AND e1 <= ee),
  late AS (SELECT file_id, track_idx, chunk_idx, arg_min(s1, cn) AS c0, arg_max(e1, cn) AS c1
    FROM snap GROUP BY ALL),
  sp AS (SELECT c.file_id, c.track_idx, c.chunk_idx, bar,
      CASE WHEN any_value(late.c0) > 0 THEN any_value(late.c0) ELSE arg_min(start_tick, note_idx) END AS f,
      CASE WHEN any_value(late.c0) > 0 THEN any_value(late.c1) ELSE max(end_tick) END AS l
    FROM ch c JOIN late USING (file_id, track_idx, chunk_idx) GROUP BY ALL),
  win AS (SELECT file_id, track_idx, chunk_idx, k AS n_bars, i AS window_idx, f + i * bar AS ws,
      f + i * bar + k * bar AS we FROM sp CROSS JOIN (SELECT unnest([4, 8]) AS k)
    CROSS JOIN range(0, 64) r(i) WHERE f + i * bar < l - k * bar + bar),
  seg0 AS (SELECT w.n_bars, w.window_idx, ws, we, ch.* REPLACE (greatest(start_tick, ws) - ws
      AS start_tick, least(end_tick, we) - ws AS end_tick)
    FROM ch JOIN win w USING (file_id, track_idx, chunk_idx)
    WHERE (start_tick >= ws AND start_tick < we) OR (end_tick > ws AND end_tick <= we)),
  cov AS (SELECT {SEG} FROM win JOIN snap USING (file_id, track_idx, chunk_idx)
    WHERE (s1 >= ws AND s1 < we) OR (e1 > ws AND e1 <= we) GROUP BY ALL
    HAVING min(greatest(s1, ws) - ws) = 0 AND max(least(e1, we) - ws) >= max(we - ws)),
{TAGGED_END.replace('  seg AS (SELECT s.* FROM seg0 s JOIN whole USING (file_id, track_idx, chunk_idx, n_bars))',
  '  seg AS (SELECT s.* FROM seg0 s JOIN whole USING (file_id, track_idx, chunk_idx, n_bars) JOIN cov USING (file_id, track_idx, chunk_idx, n_bars, window_idx))')}
  stats AS (SELECT {SEG}, max(bpm) AS bpm, max(bar) AS bar,
      avg(pitch) FILTER (WHERE pitch <> 0 AND velocity <> 1) AS m,
      min(velocity) FILTER (WHERE channel <> 5) AS min_velocity,
      max(velocity) FILTER (WHERE channel <> 5) AS max_velocity,
      arg_min(program, note_idx) AS p, arg_min(start_tick, note_idx) AS a,
      arg_max(end_tick, note_idx) AS z FROM seg GROUP BY ALL),
  chan AS (SELECT file_id, track_idx, arg_min(channel, note_idx) AS channel FROM seg GROUP BY ALL),
  gen AS (SELECT f.file_id, arg_min(g.genre, g.name_order) AS genre FROM facts f
    JOIN {GENRES} g ON starts_with('file-' || f.file_id, g.name) GROUP BY f.file_id),
  parsed AS (SELECT s.{SEG.replace(', ', ', s.')}, s.bpm, audio_key, time_signature,
      CASE {PITCH_CASE} END AS pitch_range,
      CAST(ceil((z - a // s.bar * s.bar) / CAST(s.bar AS DOUBLE)) AS INTEGER) AS num_measures,
      CAST(p AS VARCHAR) AS inst, gen.genre, min_velocity, max_velocity,
      {CATEGORY}[chan.channel] AS track_category, text AS chord_progression,
      coalesce(md5(text), 'unknown') AS chord_hash, CAST(NULL AS VARCHAR) AS rhythm,
      CAST(NULL AS INTEGER) AS min_modulation, CAST(NULL AS INTEGER) AS max_modulation,
      CAST(NULL AS INTEGER) AS min_expression, CAST(NULL AS INTEGER) AS max_expression,
      CAST(NULL AS INTEGER) AS min_sustain, CAST(NULL AS INTEGER) AS max_sustain
    FROM stats s JOIN facts USING (file_id) JOIN gen USING (file_id)
      JOIN chan USING (file_id, track_idx)
      LEFT JOIN {TAGGED_CHORDS} ci ON ci.file_id = s.file_id),
  en AS (SELECT * FROM {encode_sql('parsed')}),
{TAGGED_TOKENS}
  examples AS (SELECT {SEG}, meta, chord_hash, note_seq FROM en JOIN lists USING ({SEG}))"""


def tagged_rows(t):
    names = t.nation.selectExpr(
        "concat('file-', n_nationkey) as name",
        "if(n_nationkey % 3 = 0, 'jazz', 'rock') as genre", "(n_nationkey * 7) % 25 as name_order",
    )
    table = sinks.chord_table(
        # every other file has no chords of its own
        t.progressions.withColumn("filename", F.concat(F.lit("file-"), 2 * F.col("file_id")))
    )
    heads = t.attrs.selectExpr(
        "file_id", "concat('file-', file_id) as stem", "audio_key", "time_signature"
    )
    return corpus.tagged_examples(t.notes_dense, t.tempo, t.tempo_end, heads, names, table)


@register(
    "tagged_examples",
    "file_id:l track_idx:l chunk_idx:l n_bars:l window_idx:l meta:s chord_hash:s note_seq:s",
    f"""WITH {TAGGED_SQL} SELECT {SEG}, array_to_string(meta, ',') AS meta, chord_hash,
          array_to_string(note_seq, ',') AS note_seq FROM examples""",
)
def tagged_examples(t):
    out = tagged_rows(t.written("lines", "tempo"))
    return out.withColumns({"meta": joined("meta"), "note_seq": joined("note_seq")})


# --- augmentation -----------------------------------------------------------

KEY_LIST = "[" + ", ".join(f"'{k}'" for k in dims.KEY_NAMES) + "]"
AUGMENT_SQL = f"""
  d AS (SELECT t.file_id, bpm, end_sec, lead(time_sec, 1, end_sec) OVER (PARTITION BY t.file_id ORDER BY seq)
      - time_sec AS dur FROM v_tempo t JOIN v_tempo_end e USING (file_id)),
  pace AS (SELECT file_id, CASE WHEN count(*) = 1 THEN max(bpm)
      ELSE CAST(floor(sum(bpm * dur) / max(end_sec)) AS BIGINT) // 5 * 5 END AS v FROM d GROUP BY file_id),
  f AS (SELECT file_id, file_id % 24 AS k, arg_min(start_tick, note_idx) AS off FROM v_notes_dense
    WHERE track_name = 'chord' GROUP BY file_id),
  span AS (SELECT file_id, min(pitch + file_id % 40) AS lo, max(pitch + file_id % 40) AS hi, count(*) AS n,
      sum(pitch + file_id % 40) AS p, sum(start_tick) AS st, sum(end_tick) AS et
    FROM v_notes_dense WHERE track_name <> 'chord' GROUP BY file_id),
  aug AS (SELECT file_id * 60 + (s + 6) * 5 + b + 2 AS variant, file_id AS source_id,
      concat_ws('_', 'f' || file_id, {KEY_LIST}[k // 12 * 12 + (k % 12 + s + 12) % 12 + 1], v + 5 * b) AS stem,
      n, p + n * s AS pitches, st - n * off AS starts, et - n * off AS ends
    FROM span JOIN f USING (file_id) JOIN pace USING (file_id) CROSS JOIN range(-6, 6) r(s) CROSS JOIN range(-2, 3) q(b)
    WHERE lo + s >= 0 AND hi + s <= 127)"""


@register(
    "augment_catalog", "file_id:l source_id:l stem:s n:l pitches:l starts:l ends:l",
    f"WITH {AUGMENT_SQL} SELECT variant AS file_id, source_id, stem, n, pitches, starts, ends FROM aug",
)
def augment_catalog(t):
    # a file's notes lie together (a long file's in several ranges), so a variant is summed up in few tasks
    t = t.written("lines", by=["file_id", "note_idx"]).written("tempo")
    note_rows = t.notes_dense.withColumn("pitch", F.expr("pitch + cast(file_id % 40 as int)"))
    files = t.notes_dense.select("file_id").distinct().selectExpr(
        "file_id", "concat('f', file_id) as stem", "file_id % 24 as key_number"
    )
    named, rows = corpus.augment_catalog(files, note_rows, t.tempo, t.tempo_end)
    sums = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pitch").alias("pitches"), F.sum("start_tick").alias("starts"),
        F.sum("end_tick").alias("ends"),
    )
    return named.join(sums, "file_id")


# --- the mix of all corpora, split and written ------------------------------

MIX = f"""(SELECT concat_ws('-', 'web', {SEG}) AS example_id, 'web' AS profile, meta, 'unknown' AS chord_hash,
      note_seq FROM (WITH {WEB_SQL} SELECT * FROM examples)
      ORDER BY md5('2021-' || concat_ws('-', 'web', {SEG})) LIMIT 500)
    UNION ALL SELECT 'catalog-' || file_id, 'catalog', meta, md5(chord_progression), note_seq
      FROM (WITH {CATALOG_SQL} SELECT * FROM en JOIN lists USING (file_id))
    UNION ALL SELECT concat_ws('-', 'tagged', {SEG}), 'tagged', meta, chord_hash, note_seq
      FROM (WITH {TAGGED_SQL} SELECT * FROM examples)"""


@register(
    "training_corpus", "example_id:s split:s chord_hash:s input:s target:s",
    f"""SELECT example_id, CASE WHEN row_number() OVER (ORDER BY md5('2021-' || example_id))
            <= ceil(0.1 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split, chord_hash,
          array_to_string(meta, ',') AS input, array_to_string(note_seq, ',') AS target FROM ({MIX})""",
)
def training_corpus(t):
    t = t.written("lines", "tempo", "_user_events")
    path = shared_folder(t.spark)
    out = corpus.training_corpus(web_rows(t), catalog_rows(t), tagged_rows(t), path, web_rows=500)
    return out.withColumns({"input": joined("input"), "target": joined("target")})
