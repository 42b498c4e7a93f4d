"""Track rules, silence chunks and bar windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from scorelake.operators import chunks, tracks, windows

EV = "file_id:l track_idx:l event_idx:l"


@register(
    "track_channel", "file_id:l track_idx:l channel:l",
    """SELECT file_id, track_idx, arg_min(channel, event_idx) AS channel FROM v_events
       WHERE channel IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return tracks.track_channel(t.midi_events)


@register(
    "drop_tracks_by_program", "file_id:l track_idx:l note_idx:l",
    """WITH f AS (SELECT file_id, track_idx, arg_min(channel, note_idx) c, arg_min(program, note_idx) p
         FROM v_notes_dense GROUP BY ALL)
       SELECT n.file_id, n.track_idx, n.note_idx FROM v_notes_dense n JOIN f USING (file_id, track_idx)
       WHERE c <> 9 AND p NOT IN (55,96,97,98,99,100,101,102,103,113,114,115,116,117,118,119,120,
         121,122,123,124,125,126,127)""",
)
def _(t):
    return tracks.drop_tracks_by_program(t.notes_dense)


@register(
    "drop_tracks_by_name", EV,
    """WITH f AS (SELECT file_id, track_idx, trim(arg_min(text, event_idx)) nm,
         arg_min(channel, event_idx) FILTER (WHERE channel IS NOT NULL) c
         FROM v_events GROUP BY ALL)
       SELECT e.file_id, e.track_idx, e.event_idx FROM v_events e JOIN f USING (file_id, track_idx)
       WHERE track_idx = 0 OR NOT (nm IN ('sfx','basic_beat','additional_beat','electric_beat')
         OR coalesce(c IN (6, 9, 10, 11), false))""",
)
def _(t):
    return tracks.drop_tracks_by_name(t.midi_events)


@register(
    "drop_chord_tracks", EV,
    """SELECT file_id, track_idx, event_idx FROM v_events e WHERE NOT EXISTS (
         SELECT 1 FROM v_events x WHERE x.file_id = e.file_id AND x.track_idx = e.track_idx
         AND contains(x.text, 'chord'))""",
)
def _(t):
    return tracks.drop_chord_tracks(t.midi_events)


@register(
    "apply_channel", EV + " channel:l",
    """SELECT file_id, track_idx, event_idx, CASE WHEN channel IS NULL THEN NULL
         WHEN text = 'main_melody' THEN 4 WHEN text = 'lead' THEN 2 ELSE channel END AS channel
       FROM v_events""",
)
def _(t):
    mapping = t.spark.createDataFrame(
        [("main_melody", 4), ("lead", 2)], "text string, new_channel int"
    )
    return tracks.apply_channel(t.midi_events, mapping)


@register(
    "reject_unstable", "file_id:l changes:l",
    "SELECT file_id, count(*) AS changes FROM v_tempo GROUP BY file_id HAVING count(*) <= 8",
)
def _(t):
    return tracks.reject_unstable(t.tempo)


@register(
    "reject_empty", "file_id:l",
    """SELECT c_custkey AS file_id FROM customer
       WHERE c_custkey IN (SELECT file_id FROM v_notes_dense WHERE end_tick > 0)""",
)
def _(t):
    return tracks.reject_empty(t.customer.selectExpr("c_custkey as file_id"), t.notes_dense)


@register(
    "skip_chord_only", "file_id:l",
    """SELECT file_id FROM v_events GROUP BY file_id HAVING NOT (
         count(DISTINCT track_idx) FILTER (WHERE track_idx > 0) = 1
         AND coalesce(bool_or(text = 'chord') FILTER (WHERE track_idx > 0), false))""",
)
def _(t):
    return tracks.skip_chord_only(t.midi_events.withColumnRenamed("text", "track_name"))


@register(
    "assert_track_names", "file_id:l mismatches:l",
    """WITH tr AS (SELECT file_id, track_idx, arg_min(text, event_idx) a, arg_max(text, event_idx) b
         FROM v_events GROUP BY ALL)
       SELECT file_id, count(*) FILTER (WHERE a <> b) AS mismatches FROM tr GROUP BY file_id""",
)
def _(t):
    named = t.midi_events.groupBy("file_id", "track_idx").agg(
        F.min_by("text", "event_idx").alias("track_name"),
        F.max_by("text", "event_idx").alias("name"),
    )
    return tracks.assert_track_names(named, named)


@register(
    "range_check_pitch", "file_id:l lo:l hi:l",
    """SELECT file_id, min(pitch + 33) AS lo, max(pitch + 33) AS hi FROM v_notes_dense
       GROUP BY file_id HAVING min(pitch + 33) >= 0 AND max(pitch + 33) <= 127""",
)
def _(t):
    return tracks.range_check_pitch(t.notes_dense.withColumn("pitch", F.col("pitch") + 33))


def binned(t):
    return t.notes_sparse.withColumns(
        {
            "start_bin": chunks.time_bin(F.col("start_tick"), F.col("bpm")),
            "end_bin": chunks.time_bin(F.col("end_tick"), F.col("bpm")),
        }
    )


CHUNK_SQL = """
  b AS (SELECT *, start_tick * 600 // (480 * bpm) AS sb, end_tick * 600 // (480 * bpm) AS eb
        FROM v_notes_sparse),
  p AS (SELECT *, max(eb) OVER (PARTITION BY file_id ORDER BY sb, note_idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
  s AS (SELECT *, sum(CASE WHEN pe IS NULL OR sb - pe - 1 >= 20 THEN 1 ELSE 0 END)
          OVER (PARTITION BY file_id ORDER BY sb, note_idx ROWS UNBOUNDED PRECEDING) - 1
          AS chunk_idx FROM p),
  c AS (SELECT s.*, min(sb) OVER w AS c0, max(eb) OVER w AS c1 FROM s
        WINDOW w AS (PARTITION BY file_id, chunk_idx)),
  chunked AS (SELECT * FROM c WHERE c1 - c0 >= 80)"""


@register(
    "chunk_by_silence", "file_id:l note_idx:l chunk_idx:l chunk_first:l chunk_last:l",
    f"""WITH {CHUNK_SQL}
        SELECT file_id, note_idx, chunk_idx, c0 AS chunk_first, c1 AS chunk_last FROM chunked""",
)
def _(t):
    return chunks.chunk_by_silence(binned(t))


@register(
    "rebase", "file_id:l note_idx:l chunk_idx:l start_tick:l end_tick:l",
    f"""WITH {CHUNK_SQL}
        SELECT file_id, note_idx, chunk_idx,
          start_tick - min(start_tick) OVER (PARTITION BY file_id, chunk_idx) AS start_tick,
          end_tick - min(start_tick) OVER (PARTITION BY file_id, chunk_idx) AS end_tick
        FROM chunked""",
)
def _(t):
    return chunks.rebase(chunks.chunk_by_silence(binned(t)))


SPAN = """(SELECT file_id, arg_min(start_tick, note_idx) f, max(end_tick) l FROM {notes}
           GROUP BY file_id)"""


def windows_sql(notes: str, sizes: str) -> str:
    return f"""(SELECT file_id, n AS n_bars, i AS window_idx, f + i * 1920 AS win_start,
          f + i * 1920 + n * 1920 AS win_end
        FROM {SPAN.format(notes=notes)} CROSS JOIN (SELECT unnest({sizes}) AS n)
        CROSS JOIN range(0, 64) r(i)
        WHERE f + i * 1920 < l - n * 1920 + 1920)"""


WIN = "file_id:l n_bars:l window_idx:l win_start:l win_end:l"


@register("bar_windows", WIN, f"SELECT * FROM {windows_sql('v_notes_dense', '[4]')}")
def _(t):
    return windows.bar_windows(windows.note_span(t.notes_dense, ["file_id"]))


@register("multi_size_windows", WIN, f"SELECT * FROM {windows_sql('v_notes_dense', '[4, 8]')}")
def _(t):
    return windows.bar_windows(windows.note_span(t.notes_dense, ["file_id"]), sizes=(4, 8))


INSIDE = """((start_tick >= win_start AND start_tick < win_end)
             OR (end_tick > win_start AND end_tick <= win_end))"""


@register(
    "notes_in_windows", "file_id:l n_bars:l window_idx:l note_idx:l",
    f"""SELECT file_id, n_bars, window_idx, note_idx FROM v_notes_dense
        JOIN {windows_sql('v_notes_dense', '[4]')} w USING (file_id) WHERE {INSIDE}""",
)
def _(t):
    wins = windows.bar_windows(windows.note_span(t.notes_dense, ["file_id"]))
    return windows.notes_in_windows(t.notes_dense, wins, ["file_id"])


@register(
    "window_segments", "file_id:l n_bars:l window_idx:l note_idx:l start_tick:l end_tick:l",
    f"""SELECT file_id, n_bars, window_idx, note_idx, greatest(start_tick, win_start) - win_start
          AS start_tick, least(end_tick, win_end) - win_start AS end_tick
        FROM v_notes_dense JOIN {windows_sql('v_notes_dense', '[4, 8]')} w USING (file_id)
        WHERE {INSIDE}""",
)
def _(t):
    wins = windows.bar_windows(windows.note_span(t.notes_dense, ["file_id"]), sizes=(4, 8))
    return windows.window_segments(t.notes_dense, wins)


@register(
    "drop_gappy_files", "file_id:l n_bars:l n_windows:l",
    f"""WITH w AS {windows_sql('v_notes_sparse', '[4, 8]')},
        c AS (SELECT w.file_id, n_bars, window_idx, count(note_idx) AS k FROM w
              LEFT JOIN v_notes_sparse n ON n.file_id = w.file_id AND {INSIDE} GROUP BY ALL)
        SELECT file_id, n_bars, count(*) AS n_windows FROM c GROUP BY ALL HAVING min(k) > 0""",
)
def _(t):
    wins = windows.bar_windows(windows.note_span(t.notes_sparse, ["file_id"]), sizes=(4, 8))
    segments = windows.window_segments(t.notes_sparse, wins)
    return windows.drop_gappy_files(wins, segments)


@register(
    "chord_covers_window", "file_id:l n_bars:l window_idx:l",
    f"""SELECT file_id, n_bars, window_idx FROM v_notes_dense
        JOIN {windows_sql('v_notes_dense', '[4]')} w USING (file_id)
        WHERE {INSIDE} AND track_name = 'chord' GROUP BY ALL
        HAVING min(greatest(start_tick, win_start) - win_start) = 0
          AND max(least(end_tick, win_end) - win_start) >= 7680""",
)
def _(t):
    wins = windows.bar_windows(windows.note_span(t.notes_dense, ["file_id"]))
    chords = t.notes_dense.where("track_name = 'chord'")
    return windows.chord_covers_window(windows.window_segments(chords, wins))


FIRST_CHORD = CHUNK_SQL + """,
  spans AS MATERIALIZED (SELECT file_id, chunk_idx, min(start_tick) AS chunk_start,
    max(end_tick) AS chunk_end FROM chunked GROUP BY file_id, chunk_idx),
  sung AS MATERIALIZED (SELECT file_id, note_idx, start_tick, end_tick FROM v_notes_sparse
    WHERE track_name = 'chord'),
  first AS MATERIALIZED (SELECT file_id, chunk_idx, chunk_start, chunk_end,
      min(note_idx) AS chord_note_idx, arg_min(start_tick, note_idx) AS chord_start
    FROM (SELECT *, start_tick >= chunk_start AND end_tick <= chunk_end AS inside
          FROM spans JOIN sung USING (file_id)) WHERE inside
    GROUP BY file_id, chunk_idx, chunk_start, chunk_end)"""


def chunk_spans(t):
    return chunks.chunk_by_silence(binned(t)).groupBy("file_id", "chunk_idx").agg(
        F.min("start_tick").alias("chunk_start"), F.max("end_tick").alias("chunk_end")
    )


@register(
    "first_chord_in_chunk",
    "file_id:l chunk_idx:l chunk_start:l chunk_end:l chord_note_idx:l chord_start:l",
    f"WITH {FIRST_CHORD} SELECT * FROM first",
)
def _(t):
    return chunks.first_chord_in_chunk(chunk_spans(t), t.notes_sparse.where("track_name = 'chord'"))


@register(
    "snap_chunk_to_measures", "file_id:l chunk_idx:l note_idx:l start_tick:l end_tick:l",
    f"""WITH {FIRST_CHORD},
        m AS (SELECT *, greatest(0, (chunk_start + 1919) // 1920 * 1920 - 1920) AS ms,
              (chunk_start + 1919) // 1920 * 1920 AS me, (chunk_end + 1919) // 1920 * 1920 AS ee FROM first),
        r AS MATERIALIZED (SELECT *, CASE WHEN ms < chord_start THEN me ELSE ms END AS lo FROM m)
        SELECT file_id, chunk_idx, note_idx, start_tick - chord_start AS start_tick,
          end_tick - chord_start AS end_tick
        FROM (SELECT *, start_tick >= lo AND end_tick <= ee AS inside FROM r JOIN sung USING (file_id))
        WHERE inside""",
)
def _(t):
    chords = t.notes_sparse.where("track_name = 'chord'")
    return chunks.snap_chunk_to_measures(chunk_spans(t), chords)


@register(
    "bar_bucket", "file_id:l note_idx:l raw_bar:l bar:l",
    """SELECT file_id, note_idx, start_tick // 1920 AS raw_bar,
         dense_rank() OVER (PARTITION BY file_id ORDER BY start_tick // 1920) AS bar
       FROM v_notes_sparse""",
)
def _(t):
    return windows.bar_bucket(t.notes_sparse, ["file_id"])
