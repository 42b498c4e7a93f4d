"""Scalar rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_meta import sql_map
from checks.registry import joined, register
from scorelake import dims
from scorelake.functions import scalars as s
from scorelake.operators import chords, notes


@register(
    "chord_md5", "file_id:l hash:s",
    "SELECT file_id, md5(array_to_string(progression, ',')) AS hash FROM v_progressions",
)
def _(t):
    return t.progressions.select("file_id", s.chord_md5(F.col("progression")).alias("hash"))


@register(
    "truncate", "event_id:l one:s three:s one_value:d",
    """WITH p AS (SELECT event_id, string_split(CAST(value AS VARCHAR), '.') AS p FROM events)
       SELECT event_id, p[1] || '.' || (p[2] || '0')[1:1] AS one,
         p[1] || '.' || (p[2] || '000')[1:3] AS three,
         CAST(p[1] || '.' || (p[2] || '0')[1:1] AS DOUBLE) AS one_value FROM p""",
)
def _(t):
    x = F.col("value")
    return t.events.select(
        "event_id", s.truncate_text(x, 1).alias("one"), s.truncate_text(x, 3).alias("three"),
        s.truncate_value(x, 1).alias("one_value"),
    )


@register(
    "P3", "o_orderkey:l bpm:l",
    """SELECT o_orderkey, round_even(60000000.0 / (200000 + o_orderkey % 800000), 0) AS bpm
       FROM orders""",
)
def _(t):
    micros = F.col("o_orderkey") % 800000 + 200000
    return t.orders.select("o_orderkey", s.tempo_to_bpm(micros).alias("bpm"))


@register(
    "P4", "n_nationkey:l key:s",
    """WITH k AS (SELECT n_nationkey, ['C', 'F#m', 'Bb', 'Am', 'Ebm'][n_nationkey % 5 + 1] AS k
         FROM nation)
       SELECT n_nationkey, CASE WHEN k LIKE '%m' THEN lower(k[1:len(k) - 1]) || 'minor'
         ELSE lower(k) || 'major' END AS key FROM k""",
)
def _(t):
    names = F.array(*[F.lit(x) for x in ("C", "F#m", "Bb", "Am", "Ebm")])
    key = F.get(names, F.col("n_nationkey") % 5)
    return t.nation.select("n_nationkey", s.key_text(key).alias("key"))


@register(
    "P5", "l_orderkey:l l_linenumber:l meter:s num:l den:l",
    """SELECT l_orderkey, l_linenumber, l_linenumber || '/' || (l_suppkey % 8 + 1) AS meter,
         l_linenumber AS num, l_suppkey % 8 + 1 AS den FROM lineitem""",
)
def _(t):
    text = s.meter_text(F.col("l_linenumber"), F.col("l_suppkey") % 8 + 1)
    num, den = s.meter_parts(F.col("meter"))
    out = t.lineitem.select("l_orderkey", "l_linenumber", text.alias("meter"))
    return out.withColumns({"num": num, "den": den})


@register(
    "P6", "o_orderkey:l bucket:l legacy:l",
    """SELECT o_orderkey, least(o_orderkey % 300, 199) // 5 AS bucket,
         CASE WHEN o_orderkey % 300 >= 200 THEN 39 ELSE o_orderkey % 300 // 5 END AS legacy
       FROM orders""",
)
def _(t):
    bpm = F.col("o_orderkey") % 300
    return t.orders.select(
        "o_orderkey", s.bpm_bucket(bpm).alias("bucket"), s.bpm_bucket_legacy(bpm).alias("legacy")
    )


@register(
    "P7", "o_orderkey:l lo:l hi:l sus_lo:l sus_hi:l",
    """SELECT o_orderkey, floor(v / 5.0) AS lo, ceil(v / 5.0) AS hi, floor(v / 127.0) AS sus_lo,
         ceil(v / 127.0) AS sus_hi FROM (SELECT o_orderkey, o_orderkey % 128 AS v FROM orders)""",
)
def _(t):
    v = F.col("o_orderkey") % 128
    return t.orders.select(
        "o_orderkey", s.floor_bin(v).alias("lo"), s.ceil_bin(v).alias("hi"),
        s.floor_bin(v, 127).alias("sus_lo"), s.ceil_bin(v, 127).alias("sus_hi"),
    )


@register(
    "P8", "o_orderkey:l bin64:l bin2:l back64:l back2:l",
    """SELECT o_orderkey, abs(v - 1) // 2 + 1 AS bin64, abs(v - 1) // 64 + 1 AS bin2,
         1 + abs(v - 1) // 2 * 2 AS back64,
         CASE WHEN 1 + abs(v - 1) // 64 * 64 < 64 THEN 0 ELSE 127 END AS back2
       FROM (SELECT o_orderkey, o_orderkey % 128 AS v FROM orders)""",
)
def _(t):
    v = F.col("o_orderkey") % 128
    out = t.orders.select(
        "o_orderkey", s.cc_bin(v, 64).alias("bin64"), s.cc_bin(v, 2).alias("bin2")
    )
    return out.withColumns(
        {"back64": s.cc_value(F.col("bin64"), 64), "back2": s.sustain_value(F.col("bin2"))}
    )


@register(
    "P9", "file_id:l note_idx:l position:l",
    """SELECT file_id, note_idx, arg_min(g, abs(g * bar / 32.0 - x) * 1000 + g / 1000.0) AS position
       FROM (SELECT file_id, note_idx, 1440 + 480 * (file_id % 2) AS bar,
               start_tick % (1440 + 480 * (file_id % 2)) + note_idx % 60 AS x FROM v_notes_dense)
       CROSS JOIN range(0, 32) r(g) GROUP BY file_id, note_idx""",
)
def _(t):
    bar = F.col("file_id") % 2 * 480 + 1440
    x = F.col("start_tick") % bar + F.col("note_idx") % 60
    return t.notes_dense.select("file_id", "note_idx", s.position_index(x, bar).alias("position"))


@register(
    "P10", "file_id:l note_idx:l vel:l",
    """SELECT file_id, note_idx, (SELECT max(i) FROM range(0, 33) r(i)
         WHERE CAST(floor(128.0 * i / 32) AS INTEGER) <= velocity) AS vel FROM v_notes_dense""",
)
def _(t):
    return t.notes_dense.select(
        "file_id", "note_idx", s.velocity_bin(F.col("velocity")).alias("vel")
    )


@register(
    "P11", "file_id:l note_idx:l dur:l",
    """SELECT file_id, note_idx, arg_min(i, abs((i + 1) * step - d) * 1000 + i) AS dur
       FROM (SELECT file_id, note_idx, bar, bar // 128 AS step, end_tick - start_tick + note_idx % 15
               AS d FROM (SELECT *, 1440 + 480 * (file_id % 2) AS bar FROM v_notes_dense))
       CROSS JOIN range(0, 140) r(i) WHERE (i + 1) * step <= bar GROUP BY file_id, note_idx""",
)
def _(t):
    bar = F.col("file_id") % 2 * 480 + 1440
    length = F.col("end_tick") - F.col("start_tick") + F.col("note_idx") % 15
    return t.notes_dense.select("file_id", "note_idx", s.duration_bin(length, bar).alias("dur"))


@register(
    "P12", "o_orderkey:l class:s value:l",
    """SELECT o_orderkey, CASE WHEN v < 90 THEN 'slow' WHEN v < 150 THEN 'mid' ELSE 'fast' END
         AS class, CASE WHEN v < 30 THEN 0 WHEN v >= 210 THEN 59 ELSE (v - 30) % 60 END AS value
       FROM (SELECT o_orderkey, o_orderkey % 250 AS v FROM orders)""",
)
def _(t):
    bpm = F.col("o_orderkey") % 250
    return t.orders.select(
        "o_orderkey", s.tempo_class(bpm).alias("class"), s.tempo_value(bpm).alias("value")
    )


@register(
    "quantize_to_grid", "file_id:l note_idx:l start_tick:l end_tick:l",
    """WITH n AS (SELECT file_id, note_idx, start_tick + note_idx % 77 AS st,
           end_tick + note_idx % 77 AS et, max(start_tick + note_idx % 77) OVER
           (PARTITION BY file_id) AS last FROM v_notes_dense),
         g AS (SELECT file_id, note_idx, st, et, arg_min(i * 120, abs(i * 120 - st) * 1000 + i) AS line
           FROM n JOIN range(0, 300) r(i) ON i * 120 < last GROUP BY ALL)
       SELECT file_id, note_idx, line AS start_tick, et + line - st AS end_tick FROM g""",
)
def _(t):
    moved = t.notes_dense.withColumns(
        {c: F.col(c) + F.col("note_idx") % 77 for c in ("start_tick", "end_tick")}
    )
    return notes.quantize_to_grid(moved)


TRIADS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_transform(
    [[0, 4, 7], [0, 3, 7, 10], [0, 5, 7], [7, 0, 4], [0, 2, 3, 7], [0, 4, 7, 12], [0, 1, 2]]
    [l_partkey % 7 + 1], lambda x: x + 36 + l_suppkey % 24) AS p FROM lineitem)"""


def triads(t):
    shapes = F.array(
        *[F.array(*[F.lit(x) for x in c]) for c in
          ([0, 4, 7], [0, 3, 7, 10], [0, 5, 7], [7, 0, 4], [0, 2, 3, 7], [0, 4, 7, 12], [0, 1, 2])]
    )
    base = (F.col("l_suppkey") % 24 + 36).cast("int")
    shape = F.get(shapes, (F.col("l_partkey") % 7).cast("int"))
    return t.lineitem.select(
        "l_orderkey", "l_partkey", F.transform(shape, lambda x: x + base).alias("p")
    )


@register(
    "degrees", "l_orderkey:l l_partkey:l degrees:s",
    f"""WITH d AS (SELECT l_orderkey, l_partkey, list_transform(p, lambda x: (x - p[1] + 120) % 12)
          AS d FROM {TRIADS})
        SELECT l_orderkey, l_partkey, array_to_string(list_filter(d,
          lambda x, i: list_position(d, x) = i), ',') AS degrees FROM d""",
)
def _(t):
    out = triads(t).withColumn("degrees", chords.degrees(F.col("p")))
    return out.withColumn("degrees", joined("degrees"))


TEMPLATES = {",".join(map(str, v)): k for k, v in reversed(dims.CHORD_TEMPLATES.items())}


@register(
    "chord_name", "l_orderkey:l l_partkey:l name:s",
    f"""WITH d AS (SELECT l_orderkey, l_partkey, p, list_transform(p, lambda x:
          (x - p[1] + 120) % 12) AS d FROM {TRIADS}),
        k AS (SELECT *, array_to_string(list_filter(d, lambda x, i: list_position(d, x) = i), ',')
          AS k FROM d)
        SELECT l_orderkey, l_partkey, {list(dims.ROOT_NAMES)}[p[1] % 12 + 1]
          || {sql_map(TEMPLATES)}[k] AS name FROM k""",
)
def _(t):
    return triads(t).withColumn("name", chords.chord_name(F.col("p")))


@register(
    "chord_units", "file_id:l idx:l unit:l chord:s",
    """SELECT file_id, idx, unnest(range(0, (240 * (1 + idx % 4)) // 240)) AS unit, chord
       FROM v_chords WHERE idx % 5 <> 4""",
)
def _(t):
    ticks = (F.col("idx") % 4 + 1) * 240 + F.when(F.col("idx") % 5 == 4, 7).otherwise(0)
    return chords.chord_units(t.chords.withColumn("ticks", ticks))


SEMITONE = sql_map(dims.ROOT_SEMITONES)


@register(
    "transpose_chords", "file_id:l transposed:s",
    f"""WITH k AS (SELECT file_id, progression, ['a', 'c', 'eb', 'g#', 'f'][file_id % 5 + 1] AS o,
          ['d', 'bb', 'b'][file_id % 3 + 1] AS n FROM v_progressions)
        SELECT file_id, array_to_string(list_transform(progression, lambda c:
          ['a','bb','b','c','db','d','eb','e','f','gb','g','ab'][
            ({SEMITONE}[lower(regexp_extract(c, '^[A-G][#b]?'))] + {SEMITONE}[n] - {SEMITONE}[o] + 24)
            % 12 + 1] || regexp_replace(c, '^[A-G][#b]?', '')), ',') AS transposed FROM k""",
)
def _(t):
    origin = F.array(*[F.lit(x) for x in ("a", "c", "eb", "g#", "f")])
    new = F.array(*[F.lit(x) for x in ("d", "bb", "b")])
    rows = t.progressions.withColumns(
        {
            "origin_key": F.get(origin, (F.col("file_id") % 5).cast("int")),
            "new_key": F.get(new, (F.col("file_id") % 3).cast("int")),
        }
    )
    return chords.transpose_chords(rows).withColumn("transposed", joined("transposed"))


@register(
    "transpose_notes", "file_id:l note_idx:l pitch:l start_tick:l end_tick:l new_key:l",
    """WITH f AS (SELECT file_id, file_id % 24 AS k, file_id % 12 - 6 AS s,
           arg_min(start_tick, note_idx) AS off FROM v_notes_dense WHERE track_name = 'chord'
           GROUP BY file_id)
       SELECT file_id, note_idx, pitch + s AS pitch, start_tick - off AS start_tick,
         end_tick - off AS end_tick, k // 12 * 12 + (k % 12 + s + 12) % 12 AS new_key
       FROM v_notes_dense JOIN f USING (file_id) WHERE track_name <> 'chord'""",
)
def _(t):
    files = t.notes_dense.select("file_id").distinct().selectExpr(
        "file_id", "file_id % 24 as key_number", "file_id % 12 - 6 as key_shift"
    )
    return notes.transpose_notes(t.notes_dense, files)


@register(
    "augment_grid", "o_orderkey:l key_shift:l bpm_shift:l",
    """SELECT o_orderkey, k AS key_shift, b AS bpm_shift FROM orders
       CROSS JOIN range(-6, 6) r(k) CROSS JOIN range(-2, 3) q(b)""",
)
def _(t):
    return notes.augment_grid(t.orders.select("o_orderkey"))


@register(
    "flat_alias", "o_orderkey:l word:s id:l",
    f"""WITH w AS (SELECT o_orderkey, 'Chord_' || ['ab', 'bb', 'db', 'eb', 'gb'][o_custkey % 5 + 1]
          || ['', 'maj', 'maj7', '7', 'dim', 'dim7', 'aug', 'm', 'm7'][o_orderkey % 9 + 1] AS word,
          {sql_map({'Chord_' + c: i for i, c in enumerate(dims.CHORD_WORDS, 163)})} AS m,
          ['g#', 'a#', 'c#', 'd#', 'f#'][o_custkey % 5 + 1]
          || ['', '', '7', '7', 'dim', 'dim', 'aug', 'm', 'm'][o_orderkey % 9 + 1] AS sharp
          FROM orders)
        SELECT o_orderkey, word, m['Chord_' || sharp] AS id FROM w""",
)
def _(t):
    flats = F.array(*[F.lit(x) for x in ("ab", "bb", "db", "eb", "gb")])
    ends = F.array(*[F.lit(x) for x in ("", "maj", "maj7", "7", "dim", "dim7", "aug", "m", "m7")])
    word = F.concat(
        F.lit("Chord_"), F.get(flats, (F.col("o_custkey") % 5).cast("int")),
        F.get(ends, (F.col("o_orderkey") % 9).cast("int")),
    )
    vocab = dims.bar_vocab(t.spark, aliases=True).select("word", "id")
    return t.orders.select("o_orderkey", word.alias("word")).join(F.broadcast(vocab), "word")


@register(
    "track_category", "file_id:l note_idx:l category:s",
    f"""SELECT file_id, note_idx, coalesce({sql_map(dims.CHANNEL_CATEGORIES)}[channel], 'unknown')
          AS category FROM v_notes_dense""",
)
def _(t):
    return t.notes_dense.select(
        "file_id", "note_idx", s.track_category(F.col("channel")).alias("category")
    )


@register(
    "P24", "doc_id:l ids:s",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[0-9]+'),
         lambda x: TRY_CAST(x AS BIGINT)), ',') AS ids FROM documents""",
)
def _(t):
    out = t.documents.select("doc_id", s.parse_ids(F.col("text")).alias("ids"))
    return out.withColumn("ids", joined("ids"))


@register(
    "P25", "example_id:l title:s body:s",
    """SELECT example_id, array_to_string(note_seq[1:5], ',') AS title,
         array_to_string(note_seq[1:len(note_seq) - 1], ',') AS body FROM v_examples""",
)
def _(t):
    from scorelake.operators.retrieval import title_and_body

    out = title_and_body(t.examples, "note_seq")
    return out.withColumns({"title": joined("title"), "body": joined("body")})
