"""The same derived tables as DuckDB views; a view may use the ones above it."""

LKEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"

_NOTES = """
SELECT file_id, note_idx, 1 + l_linenumber % 2 AS track_idx,
  CASE WHEN l_linenumber % 2 = 0 THEN 'main_melody' ELSE 'chord' END AS track_name,
  l_suppkey % 12 AS channel, l_partkey % 128 AS program,
  {start} AS start_tick, {start} + 60 + (l_partkey % 8) * 60 AS end_tick,
  36 + l_partkey % 60 AS pitch, 1 + 2 * CAST(l_quantity AS INTEGER) AS velocity,
  40 + (file_id % 5) * 20 AS bpm
FROM v_lines"""

VIEWS: dict[str, str] = {
    "v_lines": f"""
SELECT {LKEY}, l_orderkey // 16 AS file_id,
  row_number() OVER (PARTITION BY l_orderkey // 16 ORDER BY {LKEY}) - 1 AS note_idx
FROM lineitem""",
    "v_notes_sparse": _NOTES.format(
        start="((l_orderkey % 16) * 480 + (l_linenumber - 1) * 120"
        " + CASE WHEN l_orderkey % 16 >= 9 THEN 9600 ELSE 0 END)"
    ),
    "v_notes_dense": _NOTES.format(
        start="((l_orderkey % 16) * 960 + (l_linenumber - 1) * 120)"
    ),
    "v_tempo": """
SELECT o_custkey AS file_id, seq, 10 * seq AS time_sec, 60 + o_orderkey % 80 AS bpm
FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS seq
      FROM orders)""",
    "v_tempo_end": "SELECT file_id, count(*) * 10 + 5 AS end_sec FROM v_tempo GROUP BY file_id",
    "v_user_events": """
SELECT user_id AS file_id, event_id, event_type,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS event_idx
FROM events""",
    "v_events": """
SELECT file_id, event_id % 3 AS track_idx, event_idx, event_idx * 60 AS tick,
  CASE event_type WHEN 'click' THEN 'set_tempo' WHEN 'view' THEN 'time_signature'
    WHEN 'purchase' THEN 'key_signature' WHEN 'signup' THEN 'note_on' ELSE 'note_off' END AS type,
  CASE WHEN event_type IN ('signup', 'error') THEN k % 16 END AS channel,
  36 + k % 6 AS note, k AS value,
  CASE k % 9 WHEN 0 THEN 'chord' WHEN 1 THEN ' sfx ' WHEN 2 THEN 'main_melody'
    WHEN 3 THEN 'basic_beat' ELSE 'lead' END AS text
FROM v_user_events""",
    "v_cc": """
SELECT file_id, 1 + event_id % 3 AS track_idx, event_idx, event_idx * 60 AS tick,
  CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 11 ELSE 64 END AS control, k AS value
FROM v_user_events""",
    "v_files": """
SELECT page_id AS file_id, '/corpus/' || ['raw', 'chunked', 'tmp', 'a', 'b'][page_id % 5 + 1]
  || '/f' || CAST(page_id // 2 AS VARCHAR)
  || ['.mid', '.MID', '.midi', '.MIDI', '.txt', '.wav'][page_id % 6 + 1] AS path
FROM pages""",
    "v_samples": """
SELECT CAST(c_custkey AS VARCHAR) AS id, 'piano-' || c_nationkey AS inst,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'rock' WHEN 'BUILDING' THEN 'Jazz'
    WHEN 'AUTOMOBILE' THEN 'polka' WHEN 'FURNITURE' THEN 'edm' END AS genre,
  ['main_melody', 'sub_melody', 'accompaniment', 'bass', 'pad', 'riff', 'drums',
   'percussion'][c_custkey % 8 + 1] AS track_category,
  60 + c_custkey % 160 AS bpm,
  DATE '2020-01-01' + CAST(c_custkey % 400 AS INTEGER) AS created_at,
  DATE '2020-03-01' + CAST(c_custkey % 350 AS INTEGER) AS updated_at,
  c_custkey % 3 = 0 AS auto_changed,
  CASE WHEN c_custkey % 7 = 0 THEN [] ELSE [['C', 'F', 'G'][c_custkey % 3 + 1], 'Am',
    ['Dm7', 'Bb'][c_custkey % 2 + 1]] END AS first_progression
FROM customer""",
    "v_attrs": """
SELECT c_custkey AS file_id,
  CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 120 ELSE 40 + c_custkey % 200
    END AS bpm,
  ['cmajor', 'c#minor', 'bbmajor', 'hmajor', NULL][c_nationkey % 5 + 1] AS audio_key,
  ['4/4', '3/4', '5/8', '6/8', NULL][c_custkey % 5 + 1] AS time_signature,
  ['low', 'mid', 'very_high', NULL][c_custkey % 4 + 1] AS pitch_range,
  [4, 8, NULL, 5][c_custkey // 4 % 4 + 1] AS num_measures,
  CAST(c_custkey % 140 AS VARCHAR) AS inst,
  ['newage', 'country', 'polka', NULL][c_custkey // 3 % 4 + 1] AS genre,
  CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 100 END AS min_velocity,
  CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 100 + 20 END AS max_velocity,
  ['bass', 'riff', 'drums', NULL][c_custkey // 7 % 4 + 1] AS track_category,
  CASE WHEN c_custkey % 2 = 1 THEN 'C' END AS chord_progression,
  ['standard', 'swing', NULL][c_custkey % 3 + 1] AS rhythm,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 90 END AS min_modulation,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 90 + 33 END AS max_modulation,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 70 END AS min_expression,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 70 + 41 END AS max_expression,
  CASE WHEN c_custkey % 6 <> 0 THEN 0 END AS min_sustain,
  CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 128 END AS max_sustain
FROM customer""",
    "v_chords": f"""
SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LKEY}) - 1 AS idx,
  ['C', 'F', 'G', 'Am', 'Dm7', 'Bb'][l_partkey % 6 + 1] AS chord
FROM lineitem""",
    "v_progressions": """
SELECT file_id, list(chord ORDER BY idx) AS progression FROM v_chords GROUP BY file_id""",
    "v_examples": f"""
SELECT l_orderkey AS example_id, ['web', 'catalog', 'tagged'][l_orderkey % 3 + 1] AS profile,
  [422 + (l_orderkey * i) % 200 FOR i IN range(1, 19)] AS meta,
  md5(CAST(l_orderkey % 50 AS VARCHAR)) AS chord_hash,
  list_append(list(2 + l_partkey % 420 ORDER BY {LKEY}), 1) AS note_seq,
  CASE WHEN l_orderkey % 10 = 0 THEN 'val' ELSE 'train' END AS split
FROM lineitem GROUP BY l_orderkey""",
    "v_json": """
SELECT event_id AS page_id, '{"has_next": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
  || ', "samples": {"samples": [{"id": "' || event_id || '", "bpm": ' || user_id
  || '}, {"id": "x' || event_id || '", "bpm": null}]}}' AS body
FROM events""",
}
