"""Token encodings, their window steps and the decoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_chords import PLACED, SEGMENTS, eighths
from checks.q_meta import sql_map
from checks.registry import joined, register
from scorelake import dims
from scorelake.functions import scalars as s
from scorelake.operators import chords, notes, tokens

F_TEMPO = "CAST(40 + (file_id % 5) * 20 AS BIGINT)"


@register(
    "tempo_segments", "file_id:l seq:l tick:d",
    """SELECT file_id, seq, coalesce(sum(d) OVER (PARTITION BY file_id ORDER BY seq
         ROWS UNBOUNDED PRECEDING), 0) AS tick FROM (SELECT *, coalesce((time_sec - lag(time_sec)
         OVER w) * lag(bpm) OVER w * 8.0, 0) AS d FROM v_tempo
         WINDOW w AS (PARTITION BY file_id ORDER BY seq))""",
)
def _(t):
    return notes.tempo_segments(t.tempo)


ASOF = """seg AS (SELECT file_id, seq, CAST(time_sec AS DOUBLE) AS time_sec, bpm, CAST(coalesce(
    sum(d) OVER (PARTITION BY file_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS DOUBLE) AS tick
  FROM (SELECT *, coalesce((time_sec - lag(time_sec) OVER w) * lag(bpm) OVER w * 8.0, 0) AS d
    FROM v_tempo WINDOW w AS (PARTITION BY file_id ORDER BY seq))),
  probe AS (SELECT file_id, note_idx, CAST(start_tick / 64.0 AS DOUBLE) AS t,
    CAST(start_tick AS DOUBLE) AS tick FROM v_notes_dense)"""


@register(
    "time_to_tick", "file_id:l note_idx:l tick:l",
    f"""WITH {ASOF} SELECT p.file_id, note_idx, round_even(seg.tick + (t - time_sec) * bpm * 8, 0)
          AS tick FROM probe p ASOF LEFT JOIN seg ON p.file_id = seg.file_id AND p.t >= seg.time_sec""",
)
def _(t):
    probes = t.notes_dense.selectExpr("file_id", "note_idx", "start_tick / 64D as t")
    return notes.time_to_tick(t.tempo, probes)


@register(
    "tick_to_time", "file_id:l note_idx:l t:d",
    f"""WITH {ASOF} SELECT p.file_id, note_idx, round(time_sec + (p.tick - seg.tick) / (bpm * 8.0), 6)
          AS t FROM probe p ASOF LEFT JOIN seg ON p.file_id = seg.file_id AND p.tick >= seg.tick""",
)
def _(t):
    probes = t.notes_dense.selectExpr("file_id", "note_idx", "cast(start_tick as double) as tick")
    out = notes.tick_to_time(t.tempo, probes)
    return out.withColumn("t", F.round("t", 6))


@register(
    "order_notes", "file_id:l note_idx:l note_ord:l",
    """SELECT file_id, note_idx, row_number() OVER (PARTITION BY file_id
         ORDER BY start_tick, pitch, note_idx) - 1 AS note_ord FROM v_notes_sparse""",
)
def _(t):
    return tokens.order_notes(t.notes_sparse)


PERF = f"""
  o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY start_tick, pitch, note_idx) - 1
      AS idx, (12000 * start_tick + 480 * bpm) // (960 * bpm) AS s0,
      (12000 * end_tick + 480 * bpm) // (960 * bpm) AS e0 FROM v_notes_dense),
  n AS (SELECT *, CASE WHEN e0 = s0 THEN e0 + 1 ELSE e0 END AS e1 FROM o),
  raw AS (SELECT file_id, s0 AS step, idx, 3 AS prio, 0 AS seq, 'note_on' AS kind, pitch AS value,
      velocity FROM n
    UNION ALL SELECT file_id, e1, idx, 4, 0, 'note_off', pitch, NULL FROM n
    UNION ALL SELECT file_id, (12000 * tick + 480 * b) // (960 * b), 0,
      CASE control WHEN 1 THEN 0 WHEN 11 THEN 1 ELSE 2 END, event_idx,
      CASE control WHEN 1 THEN 'modulation' WHEN 11 THEN 'expression' ELSE 'sustain' END,
      CASE control WHEN 64 THEN abs(value - 1) // 64 + 1 ELSE abs(value - 1) // 2 + 1 END, NULL
    FROM (SELECT *, {F_TEMPO} AS b FROM v_cc)),
  ev AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY step, idx, prio, seq) - 1 AS ord,
      CASE WHEN kind = 'note_on' THEN (velocity - 1) // 2 + 1 END AS vb FROM raw),
  pv AS (SELECT *, step - lag(step, 1, 0) OVER (PARTITION BY file_id ORDER BY ord) AS gap,
      coalesce(last_value(vb IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ord
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pvb FROM ev)"""


def steps(t):
    return tokens.note_steps(t.notes_dense)


def cc_steps(t):
    bpm = F.expr("40 + (file_id % 5) * 20")
    return t.cc.withColumn("step", s.quantize_step(F.col("tick"), bpm))


@register(
    "order_performance_events", "file_id:l ord:l step:l kind:s value:l",
    f"WITH {PERF} SELECT file_id, ord, step, kind, value FROM ev",
)
def _(t):
    return tokens.order_performance_events(steps(t), cc_steps(t))


@register(
    "time_shift_tokens", "file_id:l ord:l sub:l shift:l",
    f"""WITH {PERF}, k AS (SELECT *, unnest(range(0, (gap + 99) // 100)) AS sub FROM pv)
        SELECT file_id, ord, sub, least(100, gap - 100 * sub) AS shift FROM k""",
)
def _(t):
    return tokens.time_shift_tokens(tokens.order_performance_events(steps(t), cc_steps(t)))


@register(
    "velocity_changes", "file_id:l ord:l vbin:l",
    f"WITH {PERF} SELECT file_id, ord, vb AS vbin FROM pv WHERE kind = 'note_on' AND vb <> pvb",
)
def _(t):
    return tokens.velocity_changes(tokens.order_performance_events(steps(t), cc_steps(t)))


PERF_TOKENS = f"""{PERF},
  w AS (SELECT file_id, ord, sub, 257 + least(100, gap - 100 * sub) AS token FROM
      (SELECT *, unnest(range(0, (gap + 99) // 100)) AS sub FROM pv)
    UNION ALL SELECT file_id, ord, (gap + 99) // 100, 357 + vb FROM pv
      WHERE kind = 'note_on' AND vb <> pvb
    UNION ALL SELECT file_id, ord, (gap + 99) // 100
      + CASE WHEN kind = 'note_on' AND vb <> pvb THEN 1 ELSE 0 END,
      value + CASE kind WHEN 'note_on' THEN 2 WHEN 'note_off' THEN 130 WHEN 'modulation' THEN 421
        WHEN 'expression' THEN 485 ELSE 549 END FROM pv
    UNION ALL SELECT DISTINCT file_id, 4611686018427387904, 0, 1 FROM n)"""


@register(
    "performance_encode", "file_id:l ord:l sub:l token:l",
    f"WITH {PERF_TOKENS} SELECT * FROM w",
)
def _(t):
    return tokens.performance_encode(steps(t), cc_steps(t))


# token streams of 2..551 in line order, one per file
STREAM = """(SELECT file_id, note_idx AS pos, CASE WHEN l_partkey % 3 = 0 THEN 2 + l_partkey % 16
      WHEN l_partkey % 3 = 1 THEN 130 + l_partkey % 16 ELSE 258 + l_partkey % 294 END AS token
      FROM v_lines)"""


def stream(t):
    return t.lines.selectExpr(
        "file_id", "note_idx as pos",
        """case l_partkey % 3 when 0 then 2 + l_partkey % 16 when 1 then 130 + l_partkey % 16
           else 258 + l_partkey % 294 end as token""",
    )


CLOCK = f"""st AS {STREAM},
  typed AS (SELECT *, CASE WHEN token < 130 THEN 'note_on' WHEN token < 258 THEN 'note_off'
      WHEN token < 358 THEN 'time_shift' WHEN token < 422 THEN 'velocity'
      WHEN token < 486 THEN 'modulation' WHEN token < 550 THEN 'expression' ELSE 'sustain' END AS kind
    FROM st),
  cut AS (SELECT t.* FROM typed t JOIN (SELECT file_id, min(pos) AS p FROM typed
    WHERE kind <> 'time_shift' GROUP BY file_id) f ON f.file_id = t.file_id AND pos >= p),
  clocked AS (SELECT *, sum(CASE WHEN kind = 'time_shift' THEN token - 257 ELSE 0 END) OVER w AS step,
      last_value(CASE WHEN kind = 'velocity' THEN (token - 358) * 2 + 1 END IGNORE NULLS) OVER w
      AS velocity FROM cut
    WINDOW w AS (PARTITION BY file_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""


@register(
    "running_clock", "file_id:l pos:l step:l velocity:l",
    f"WITH {CLOCK} SELECT file_id, pos, step, velocity FROM clocked",
)
def _(t):
    return tokens.running_clock(tokens.classify_performance(stream(t), ["file_id"]))


@register(
    "carry_velocity", "file_id:l pos:l velocity:l",
    f"WITH {CLOCK} SELECT file_id, pos, velocity FROM clocked WHERE kind = 'note_on'",
)
def _(t):
    timed = tokens.running_clock(tokens.classify_performance(stream(t), ["file_id"]))
    return timed.where("kind = 'note_on'")


# first in, first out by simulation: an off closes the oldest open on, so the k-th
# on is closed by the k-th off that finds one open
FIFO = """
  ordered AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS rn FROM {events}
    WHERE d <> 0),
  sim AS (SELECT {keys}, pos, tm, d, rn, CASE WHEN d = 1 THEN 1 ELSE 0 END AS ons,
      0 AS offs, false AS matched FROM ordered WHERE rn = 1
    UNION ALL SELECT {o_keys}, o.pos, o.tm, o.d, o.rn,
      s.ons + CASE WHEN o.d = 1 THEN 1 ELSE 0 END,
      s.offs + CASE WHEN o.d = -1 AND s.ons > s.offs THEN 1 ELSE 0 END,
      o.d = -1 AND s.ons > s.offs
    FROM sim s JOIN ordered o USING ({keys}) WHERE o.rn = s.rn + 1)"""

PAIRED = """
  SELECT a.file_id, a.pos AS event_idx, a.pitch, a.tm AS on_at, coalesce(b.tm, l.last) AS off_at
  FROM (SELECT * FROM sim WHERE d = 1) a
  LEFT JOIN (SELECT * FROM sim WHERE matched) b
    ON b.file_id = a.file_id AND b.pitch = a.pitch AND b.offs = a.ons
  JOIN lasts l ON l.file_id = a.file_id
  WHERE coalesce(b.tm, l.last) > a.tm"""


@register(
    "pair_notes_fifo", "file_id:l event_idx:l pitch:l on_at:l off_at:l",
    f"""WITH RECURSIVE e AS (SELECT file_id, event_idx AS pos, note AS pitch, tick AS tm, CASE type WHEN
          'note_on' THEN 1 WHEN 'note_off' THEN -1 ELSE 0 END AS d FROM v_events),
        lasts AS (SELECT file_id, max(tm) AS last FROM e GROUP BY file_id),
        {FIFO.format(keys='file_id, pitch', o_keys='o.file_id, o.pitch', events='e')} {PAIRED}""",
)
def _(t):
    return notes.pair_notes_fifo(t.midi_events, "tick")


@register(
    "performance_decode", "file_id:l event_idx:l pitch:l on_at:l off_at:l velocity:l",
    f"""WITH RECURSIVE {CLOCK}, e AS (SELECT file_id, pos, step AS tm, CASE kind WHEN 'note_on'
          THEN token - 2 WHEN 'note_off' THEN token - 130 END AS pitch, CASE kind WHEN 'note_on'
          THEN 1 WHEN 'note_off' THEN -1 ELSE 0 END AS d FROM clocked),
        lasts AS (SELECT file_id, max(tm) AS last FROM e GROUP BY file_id),
        {FIFO.format(keys='file_id, pitch', o_keys='o.file_id, o.pitch', events='e')},
        done AS ({PAIRED})
        SELECT done.*, c.velocity FROM done JOIN clocked c ON c.file_id = done.file_id
          AND c.pos = done.event_idx""",
)
def _(t):
    return tokens.performance_decode(stream(t))[0]


@register(
    "performance_decode_cc", "file_id:l pos:l step:l control:l value:l",
    f"""WITH {CLOCK} SELECT file_id, pos, step, CASE kind WHEN 'modulation' THEN 1
          WHEN 'expression' THEN 11 ELSE 64 END AS control, CASE kind WHEN 'modulation'
          THEN 1 + (token - 422) * 2 WHEN 'expression' THEN 1 + (token - 486) * 2
          ELSE CASE WHEN token = 550 THEN 0 ELSE 127 END END AS value
        FROM clocked WHERE token >= 422""",
)
def _(t):
    return tokens.performance_decode(stream(t))[1]


KEYSWITCH = """(SELECT file_id, note_idx AS pos, CASE WHEN l_partkey % 4 = 0 THEN 358
    WHEN l_partkey % 4 = 1 THEN 100 + l_partkey % 140 ELSE 2 + l_partkey % 420 END AS token
    FROM v_lines)"""


@register(
    "drop_keyswitch_tokens", "file_id:l pos:l token:l",
    f"""WITH RECURSIVE st AS {KEYSWITCH},
        e AS (SELECT file_id, pos, pos AS tm, CASE WHEN token = 358 THEN 1
          WHEN token > 129 AND token < 229 THEN -1 ELSE 0 END AS d FROM st),
        {FIFO.format(keys='file_id', o_keys='o.file_id', events='e')},
        cuts AS (SELECT a.file_id, a.pos AS lo, b.pos AS hi FROM sim a JOIN sim b
          ON b.file_id = a.file_id AND a.d = 1 AND b.matched AND b.offs = a.ons)
        SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.file_id = st.file_id
          AND st.pos BETWEEN c.lo AND c.hi)""",
)
def _(t):
    rows = t.lines.selectExpr(
        "file_id", "note_idx as pos",
        """case l_partkey % 4 when 0 then 358 when 1 then 100 + l_partkey % 140
           else 2 + l_partkey % 420 end as token""",
    )
    return tokens.drop_keyswitch_tokens(rows, ["file_id"])


# --- bar encoding -----------------------------------------------------------

BAR_IDS = dims.bar_ids()
CHORD_IDS = {
    w[6:]: i for w, i in {**BAR_IDS, **dims.flat_aliases(BAR_IDS)}.items() if w.startswith("Chord_")
}


def bar_sql(items: str) -> str:
    """Tokens of ``items`` (file_id, name, start_tick, end_tick, pitch, velocity, note_idx, chord)."""
    return f"""
  items AS (SELECT *, start_tick // 1920 AS rb FROM {items}),
  kept AS (SELECT i.*, row_number() OVER (PARTITION BY file_id, rb ORDER BY start_tick,
      CASE name WHEN 'Chord' THEN 0 ELSE 1 END, pitch, note_idx) AS place, place = 1 AS opens
    FROM items i WHERE EXISTS (SELECT 1 FROM items n WHERE n.file_id = i.file_id AND n.rb = i.rb
      AND n.name = 'Note')),
  lists AS (SELECT file_id, rb, place, list_filter(list_concat([CASE WHEN opens THEN 2 END,
      401 + least(31, ((start_tick - rb * 1920) * 64 + 1919) // 3840),
      {sql_map(CHORD_IDS)}[chord]], CASE WHEN name = 'Note' THEN [131 + least(31, velocity // 4),
      3 + pitch, 271 + least(127, greatest(0, (2 * (end_tick - start_tick) + 14) // 30 - 1))]
      ELSE [] END), lambda x: x IS NOT NULL) AS w FROM kept),
  bar_tokens AS (SELECT file_id, rb AS bar, place, unnest(range(0, len(w))) AS sub, unnest(w) AS token
    FROM lists UNION ALL SELECT DISTINCT file_id, 4611686018427387904, 1, 0, 1 FROM items)"""


NOTE_ITEMS = """(SELECT file_id, 'Note' AS name, start_tick, end_tick, pitch, velocity, note_idx,
    CAST(NULL AS VARCHAR) AS chord FROM v_notes_dense)"""
CHORD_ITEMS = """SELECT file_id, 'Chord' AS name, start_tick, end_tick, -1 AS pitch, NULL AS velocity,
    -1 AS note_idx, chord FROM detected"""


@register("bar_vocab", "word:s id:l uses:l", f"""WITH {bar_sql(NOTE_ITEMS)},
    v AS (SELECT unnest(map_keys(m)) AS word, unnest(map_values(m)) AS id
          FROM (SELECT {sql_map(BAR_IDS)} AS m))
    SELECT word, id, count(token) AS uses FROM v LEFT JOIN bar_tokens ON token = id GROUP BY ALL""")
def _(t):
    vocab = dims.bar_vocab(t.spark)
    encoded = tokens.bar_encode(tokens.note_items(t.notes_dense, ["file_id"]))
    used = encoded.groupBy(F.col("token").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    out = vocab.join(used, "id", "left")
    return out.select("word", "id", F.coalesce("n", F.lit(0)).alias("uses"))


@register(
    "bar_encode", "file_id:l bar:l place:l sub:l token:l",
    f"WITH {bar_sql(NOTE_ITEMS)} SELECT * FROM bar_tokens",
)
def _(t):
    return tokens.bar_encode(tokens.note_items(t.notes_dense, ["file_id"]))


@register(
    "items_union", "file_id:l name:s start_tick:l pitch:l chord:s",
    f"""WITH RECURSIVE {SEGMENTS} SELECT file_id, name, start_tick, pitch, chord FROM (
          SELECT * FROM {NOTE_ITEMS} UNION ALL {CHORD_ITEMS})""",
)
def _(t):
    return tokens.items_union(t.notes_dense, chords.detect_chords(t.notes_dense))


@register(
    "bar_encode_detected", "file_id:l bar:l place:l sub:l token:l",
    f"""WITH RECURSIVE {SEGMENTS}, {bar_sql(f'(SELECT * FROM {NOTE_ITEMS} UNION ALL {CHORD_ITEMS})')}
        SELECT * FROM bar_tokens""",
)
def _(t):
    items = tokens.items_union(t.notes_dense, chords.detect_chords(t.notes_dense))
    return tokens.bar_encode(items)


SHIFTED = f"""list_transform([chord], lambda c: ['a','bb','b','c','db','d','eb','e','f','gb','g','ab'][
    ({sql_map(dims.ROOT_SEMITONES)}[lower(regexp_extract(c, '^[A-G][#b]?'))] + 12 + file_id % 7) % 12
    + 1] || regexp_replace(c, '^[A-G][#b]?', ''))[1]"""


@register(
    "bar_encode_catalog", "file_id:l bar:l place:l sub:l token:l",
    f"""WITH {PLACED},
        sung AS (SELECT file_id, note_idx, arg_max({SHIFTED}, idx) AS chord FROM at_note GROUP BY ALL),
        {bar_sql('''(SELECT n.file_id, 'Note' AS name, start_tick, end_tick, pitch, velocity,
          n.note_idx, s.chord FROM v_notes_dense n LEFT JOIN sung s USING (file_id, note_idx))''')}
        SELECT * FROM bar_tokens""",
)
def _(t):
    t = t.written("lines")
    roots = F.array(*[F.lit(r) for r in ("a", "bb", "b", "c", "db", "d", "eb")])
    sample_keys = t.notes_dense.select("file_id").distinct().select(
        "file_id", F.lit("a").alias("origin_key"),
        F.get(roots, (F.col("file_id") % 7).cast("int")).alias("new_key"),
    )
    return tokens.bar_encode_catalog(
        t.notes_dense, chords.chord_changes(eighths(t)), sample_keys
    )


@register(
    "compound_encode", "file_id:l bar:l place:l sub:l word:s",
    f"""WITH {bar_sql(NOTE_ITEMS)},
        c AS (SELECT file_id, rb AS bar, place, list_filter([CASE WHEN opens THEN [1, 1, 0, 0, 0, 0, 0] END,
          [1, 2 + least(31, ((start_tick - rb * 1920) * 64 + 1919) // 3840), 0, 0, 0, 0, 0],
          [2, 0, 0, 0, pitch + 1, least(127, greatest(0, (2 * (end_tick - start_tick) + 14) // 30 - 1))
            + 1, least(31, velocity // 4) + 1]], lambda x: x IS NOT NULL) AS w FROM kept)
        SELECT file_id, bar, place, sub, array_to_string(word, ',') AS word FROM (
          SELECT file_id, bar, place, unnest(range(0, len(w))) AS sub, unnest(w) AS word FROM c)""",
)
def _(t):
    out = tokens.compound_encode(tokens.note_items(t.notes_dense, ["file_id"]))
    return out.withColumn("word", joined("word"))


# bar token streams: cycles of position, velocity, pitch, duration with a few breaks
BAR_STREAM = """(SELECT file_id, note_idx AS pos, CASE WHEN l_partkey % 17 = 0 THEN 2
    WHEN l_partkey % 19 = 0 THEN 163 + l_partkey % 108 WHEN l_partkey % 23 = 0 THEN 1
    WHEN note_idx % 4 = 0 THEN 401 + l_partkey % 32 WHEN note_idx % 4 = 1 THEN 131 + l_partkey % 32
    WHEN note_idx % 4 = 2 THEN 3 + l_partkey % 128 ELSE 271 + l_partkey % 130 END AS token
    FROM v_lines)"""


def bar_stream(t):
    return t.lines.selectExpr(
        "file_id", "note_idx as pos",
        """cast(case when l_partkey % 17 = 0 then 2 when l_partkey % 19 = 0 then 163 + l_partkey % 108
           when l_partkey % 23 = 0 then 1 when note_idx % 4 = 0 then 401 + l_partkey % 32
           when note_idx % 4 = 1 then 131 + l_partkey % 32 when note_idx % 4 = 2 then 3 + l_partkey % 128
           else 271 + l_partkey % 130 end as int) as token""",
    )


DECODED = f"""st AS {BAR_STREAM},
  known AS (SELECT file_id, token, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS ev
    FROM st WHERE token >= 2),
  led AS (SELECT *, lead(token) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3,
      sum(CASE WHEN token = 2 AND ev > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY ev
        ROWS UNBOUNDED PRECEDING) AS bar FROM known WINDOW w AS (PARTITION BY file_id ORDER BY ev)),
  hits AS (SELECT *, bar * {{bar}} + (token - 401) * {{bar}} // 32 AS st FROM led
    WHERE token BETWEEN 401 AND 432 AND t3 IS NOT NULL),
  decoded AS (SELECT file_id, ev, 'note' AS kind, st AS start_tick,
      st + (t3 - 270) * ({{bar}} // 128) AS end_tick, t2 - 3 AS pitch, (t1 - 131) * 4 AS velocity,
      CAST(NULL AS VARCHAR) AS chord FROM hits
      WHERE t1 BETWEEN 131 AND 162 AND t2 BETWEEN 3 AND 130 AND t3 BETWEEN 271 AND 400
    UNION ALL SELECT file_id, ev, 'chord', st, NULL, NULL, NULL, {dims.CHORD_WORDS}[t1 - 162]
      FROM hits WHERE t1 BETWEEN 163 AND 270)"""
DECODE_COLS = (
    "file_id:l ev:l kind:s start_tick:l end_tick:l pitch:l velocity:l chord:s"
)


@register("bar_decode", DECODE_COLS, f"WITH {DECODED.format(bar=1920)} SELECT * FROM decoded")
def _(t):
    return tokens.bar_decode(bar_stream(t), dims.bar_vocab(t.spark))


@register(
    "match_event_triples", DECODE_COLS, f"WITH {DECODED.format(bar=1440)} SELECT * FROM decoded"
)
def _(t):
    events = tokens.word_events(bar_stream(t), dims.bar_vocab(t.spark), ["file_id"])
    return tokens.match_event_triples(events, bar_ticks=1440)


@register(
    "expand_tempo_to_beats", "file_id:l tick:l bpm:l",
    """WITH x AS (SELECT file_id, seq * 240 AS tick, bpm FROM v_tempo),
         m AS (SELECT file_id, max(tick) AS mt FROM x GROUP BY file_id)
       SELECT m.file_id, b * 480 AS tick, (SELECT arg_max(bpm, tick) FROM x WHERE x.file_id = m.file_id
         AND x.tick % 480 = 0 AND x.tick <= b * 480) AS bpm
       FROM m JOIN range(0, 64) r(b) ON b * 480 <= mt""",
)
def _(t):
    return tokens.expand_tempo_to_beats(t.tempo.withColumn("tick", F.col("seq") * 240))


@register(
    "component_vocab", "file_id:l pos:l word:s",
    f"""SELECT file_id, pos, CASE WHEN token < 130 THEN 'note_on_' || (token - 2)
          WHEN token < 258 THEN 'note_off_' || (token - 130) WHEN token < 358
          THEN 'time_shift_' || (token - 258) WHEN token < 422 THEN 'velocity_' || (token - 358)
          WHEN token = 422 THEN '<s>' WHEN token = 423 THEN '<mask>' END AS word
        FROM {STREAM}""",
)
def _(t):
    vocab = dims.component_vocab(t.spark, dims.NOTE_COMPONENTS)
    return stream(t).join(F.broadcast(vocab.withColumnRenamed("id", "token")), "token", "left")
