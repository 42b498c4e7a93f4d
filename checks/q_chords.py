"""Chord vocabularies, detection and placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import joined, register
from scorelake import dims
from scorelake.operators import chords, notes, windows
from scorelake.session import cut_lineage

SOURCES = """(SELECT file_id, progression FROM v_progressions WHERE file_id % 2 = 0),
     tagged AS (SELECT file_id, progression FROM v_progressions WHERE file_id % 2 = 1)"""


def sources(t):
    even = F.col("file_id") % 2 == 0
    return t.progressions.where(even), t.progressions.where(~even)


@register(
    "fit_chord_vocab", "word:s uses:l id:l",
    f"""WITH cat AS {SOURCES},
        u AS (SELECT progression FROM cat WHERE len(progression) BETWEEN 1 AND 128
              UNION SELECT progression FROM tagged),
        w AS (SELECT lower(c) AS word, count(*) AS uses FROM (SELECT unnest(progression) AS c FROM u)
              GROUP BY 1)
        SELECT word, uses, row_number() OVER (ORDER BY uses DESC, word) AS id FROM w""",
)
def _(t):
    return chords.fit_chord_vocab(*sources(t))


@register(
    "distinct_progressions", "text:s",
    f"""WITH cat AS {SOURCES}
        SELECT DISTINCT array_to_string(progression, ',') AS text FROM (SELECT * FROM cat
          UNION ALL SELECT * FROM tagged)""",
)
def _(t):
    out = chords.distinct_progressions(*sources(t))
    return out.select(joined("progression").alias("text"))


@register(
    "chord_length_check", "file_id:l units:l",
    """SELECT file_id // 2 AS file_id, min(len(progression)) AS units FROM v_progressions
       GROUP BY file_id // 2 HAVING count(DISTINCT len(progression)) = 1
         AND bool_and(len(progression) = 2 OR len(progression) % 4 = 0)""",
)
def _(t):
    return chords.chord_length_check(
        t.progressions.withColumn("file_id", F.expr("file_id div 2"))
    )


@register(
    "is_quantized", "file_id:l quantized:b",
    """SELECT file_id, bool_and((start_tick + CASE WHEN file_id % 3 = 0 THEN note_idx % 2 ELSE 0 END)
         % 120 = 0) AS quantized FROM v_notes_dense GROUP BY file_id""",
)
def _(t):
    bump = F.when(F.col("file_id") % 3 == 0, F.col("note_idx") % 2).otherwise(0)
    return notes.is_quantized(t.notes_dense.withColumn("start_tick", F.col("start_tick") + bump))


BEATS = """(SELECT file_id, pitch, start_tick, end_tick, b FROM v_notes_dense
    JOIN range(0, 64) r(b) ON start_tick < (b + 1) * 480 AND end_tick > b * 480)"""


@register(
    "pitch_class_set", "file_id:l beat:l mask:l",
    f"SELECT file_id, b AS beat, bit_or(1 << CAST(pitch % 12 AS INTEGER)) AS mask FROM {BEATS} GROUP BY ALL",
)
def _(t):
    return chords.pitch_class_set(t.notes_dense)


def _tones(table: dict, points: int) -> str:
    cases = " ".join(
        f"WHEN '{q}' THEN {len(v) and ' + '.join(f'h({t})' for t in v) or 0}" for q, v in table.items()
    )
    return f"{points} * (CASE q {cases} END)"


def has(text: str) -> str:
    """Spell h(n) as the test for semitone n above the root."""
    import re

    return re.sub(r"h\((\d+)\)", r"((mask >> ((root + \1) % 12)) & 1)", text)


def scored_sql(sets: str) -> str:
    quality = has(
        "CASE WHEN h(3) = h(4) THEN 'None' WHEN h(3) = 1 THEN CASE WHEN h(6) = 1 THEN 'dim' ELSE 'm' END"
        " WHEN h(8) = 1 THEN 'aug' WHEN h(7) = 1 AND h(10) = 1 THEN '7' ELSE 'M' END"
    )
    points = has(
        " + ".join(
            [_tones(dims.CHORD_TONES_PLUS, 1), _tones(dims.CHORD_TONES_MINUS_1, -1),
             _tones(dims.CHORD_TONES_MINUS_2, -2)]
        )
    )
    return f"""(SELECT *, CASE WHEN q = 'None' THEN -100 ELSE {points} END AS score FROM (
        SELECT *, {quality} AS q FROM {sets} CROSS JOIN (SELECT CAST(r AS INTEGER) AS root
          FROM range(0, 12) x(r)) WHERE (mask >> root) & 1 = 1))"""


@register(
    "chord_scores", "file_id:l beat:l root:l quality:s score:l",
    f"""SELECT file_id, b AS beat, root, q AS quality, score FROM {scored_sql(
        f"(SELECT file_id, b, bit_or(1 << CAST(pitch % 12 AS INTEGER)) AS mask FROM {BEATS} GROUP BY ALL)"
    )}""",
)
def _(t):
    return chords.chord_scores(chords.pitch_class_set(t.notes_dense))


SEGMENTS = f"""
  ends AS (SELECT file_id, max(end_tick) AS mt FROM v_notes_dense GROUP BY file_id),
  grid AS (SELECT file_id, s * 480 AS st, least(s * 480 + k * 480, mt) AS et, k, mt
    FROM ends JOIN range(0, 64) r(s) ON s * 480 < mt CROSS JOIN (SELECT unnest([4, 2]) AS k)
    WHERE k = 4 OR s * 480 + 960 < mt),
  tones AS (SELECT g.file_id, st, et, k, pitch % 12 AS pc, min(pitch) AS low FROM grid g
    JOIN v_notes_dense n ON n.file_id = g.file_id AND n.start_tick < et AND n.end_tick > st
    GROUP BY ALL),
  sets AS (SELECT file_id, st, et, k, bit_or(1 << CAST(pc AS INTEGER)) AS mask,
    arg_min(pc, low) AS bass FROM tones GROUP BY ALL),
  scored AS (SELECT x.*, low FROM {scored_sql("sets")} x JOIN tones t ON t.file_id = x.file_id
    AND t.st = x.st AND t.k = x.k AND t.pc = x.root),
  chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, st, k
    ORDER BY score DESC, low) AS rn FROM scored) WHERE rn = 1),
  segs AS (SELECT g.file_id, g.st, g.et, g.k, coalesce({list(dims.PITCH_CLASS_NAMES)}[c.root + 1], 'N')
      AS root, coalesce(q, 'N') AS quality, coalesce({list(dims.PITCH_CLASS_NAMES)}[c.bass + 1], 'N')
      AS bass, coalesce(score, 0) AS score
    FROM grid g LEFT JOIN chosen c ON c.file_id = g.file_id AND c.st = g.st AND c.k = g.k),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id, st
    ORDER BY score DESC, et DESC) AS rn FROM segs) WHERE rn = 1),
  walk AS (SELECT file_id, st, et, root, quality, bass FROM best WHERE st = 0 UNION ALL
    SELECT b.file_id, b.st, b.et, b.root, b.quality, b.bass FROM walk w
    JOIN best b ON b.file_id = w.file_id AND b.st = w.et),
  chain AS (SELECT file_id, st AS start_tick, et AS end_tick, quality, root || ':' || quality ||
    CASE WHEN root = bass THEN '' ELSE '/' || bass END AS chord FROM walk),
  grouped AS (SELECT *, greatest(1, sum(CASE WHEN quality <> 'None' THEN 1 ELSE 0 END) OVER
    (PARTITION BY file_id ORDER BY start_tick ROWS UNBOUNDED PRECEDING)) AS g FROM chain),
  merged AS (SELECT file_id, min(start_tick) AS start_tick, max(end_tick) AS end_tick,
    max(chord) FILTER (WHERE quality <> 'None') AS chord FROM grouped GROUP BY file_id, g
    HAVING count(*) FILTER (WHERE quality <> 'None') > 0),
  detected AS (SELECT file_id, start_tick, end_tick, replace(replace(string_split(chord, '/')[1],
    ':M', ''), ':', '') AS chord FROM merged)"""


@register(
    "chord_root", "file_id:l start_tick:l end_tick:l root:s quality:s bass:s score:l",
    f"""WITH RECURSIVE {SEGMENTS}
        SELECT file_id, st AS start_tick, et AS end_tick, root, quality, bass, score FROM segs""",
)
def _(t):
    return chords.chord_segments(t.notes_dense)


@register(
    "best_chord_segment", "file_id:l start_tick:l end_tick:l root:s score:l",
    f"WITH RECURSIVE {SEGMENTS} SELECT file_id, st AS start_tick, et AS end_tick, root, score FROM best",
)
def _(t):
    return chords.best_segments(t.notes_dense)


def best(t):
    return cut_lineage(chords.best_segments(t.notes_dense))


@register(
    "greedy_chord_chain", "file_id:l start_tick:l end_tick:l chord:s",
    f"WITH RECURSIVE {SEGMENTS} SELECT * FROM chain",
)
def _(t):
    return chords.greedy_chord_chain(best(t))


@register(
    "merge_unknown_segments", "file_id:l start_tick:l end_tick:l chord:s",
    f"WITH RECURSIVE {SEGMENTS} SELECT * FROM merged",
)
def _(t):
    return chords.merge_unknown_segments(chords.greedy_chord_chain(best(t)))


CHANGES = """changes AS (SELECT file_id, idx, chord FROM (SELECT *, lag(chord) OVER
    (PARTITION BY file_id ORDER BY idx) AS p FROM {source}) WHERE p IS NULL OR p <> chord)"""


@register(
    "chord_changes", "file_id:l idx:l chord:s",
    f"WITH {CHANGES.format(source='v_chords')} SELECT * FROM changes",
)
def _(t):
    return chords.chord_changes(t.chords)


# eighth-note chords of a file, one per note
EIGHTHS = """eighths AS (SELECT file_id, note_idx AS idx,
    ['C', 'F', 'G', 'Am', 'Dm7', 'Bb'][pitch // 3 % 6 + 1] AS chord FROM v_notes_dense)"""


def eighths(t):
    names = F.array(*[F.lit(c) for c in ("C", "F", "G", "Am", "Dm7", "Bb")])
    at = F.expr("cast(pitch div 3 % 6 as int)")
    return t.notes_dense.select("file_id", F.col("note_idx").alias("idx"), F.get(names, at).alias("chord"))


PLACED = f"""{EIGHTHS}, {CHANGES.format(source='eighths')},
  bars AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY start_tick // 1920) AS bar
    FROM v_notes_dense),
  firsts AS (SELECT file_id, bar, min(start_tick) AS bt FROM bars GROUP BY ALL),
  placed AS (SELECT c.file_id, f.bar, bt + idx % 8 * 240 AS start_tick, c.idx, c.chord
    FROM changes c JOIN firsts f ON f.file_id = c.file_id AND f.bar = c.idx // 8 + 1),
  at_note AS (SELECT p.file_id, p.bar, p.start_tick, p.idx, p.chord, arg_min(n.note_idx,
      n.pitch * 1000000 + n.note_idx) AS note_idx FROM placed p
    JOIN v_notes_dense n USING (file_id, start_tick) GROUP BY ALL)"""


@register(
    "chords_to_bars", "file_id:l bar:l start_tick:l idx:l chord:s note_idx:l",
    f"WITH {PLACED} SELECT file_id, bar, start_tick, idx, chord, note_idx FROM at_note",
)
def _(t):
    barred = windows.bar_bucket(t.notes_dense, ["file_id"])
    return chords.chords_to_bars(chords.chord_changes(eighths(t)), barred)
