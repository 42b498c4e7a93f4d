"""Music-shaped tables derived from the given parquet tables (Spark side)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions.scans import ordinal
from scorelake.session import cut_lineage

LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
]
BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def pick(values: list, index: str) -> str:
    items = ", ".join("null" if v is None else repr(v) for v in values)
    return f"element_at(array({items}), cast({index} as int) + 1)"


CHORD = pick(["C", "F", "G", "Am", "Dm7", "Bb"], "l_partkey % 6")
ATTRS = {
    "bpm": "if(c_custkey % 9 = 0, null, if(c_custkey % 5 = 0, 120, 40 + c_custkey % 200))",
    "audio_key": pick(["cmajor", "c#minor", "bbmajor", "hmajor", None], "c_nationkey % 5"),
    "time_signature": pick(["4/4", "3/4", "5/8", "6/8", None], "c_custkey % 5"),
    "pitch_range": pick(["low", "mid", "very_high", None], "c_custkey % 4"),
    "num_measures": pick([4, 8, None, 5], "(c_custkey div 4) % 4"),
    "inst": "cast(c_custkey % 140 as string)",
    "genre": pick(["newage", "country", "polka", None], "(c_custkey div 3) % 4"),
    "min_velocity": "if(c_custkey % 11 = 0, null, c_custkey % 100)",
    "max_velocity": "if(c_custkey % 11 = 0, null, c_custkey % 100 + 20)",
    "track_category": pick(["bass", "riff", "drums", None], "(c_custkey div 7) % 4"),
    "chord_progression": "if(c_custkey % 2 = 0, null, 'C')",
    "rhythm": pick(["standard", "swing", None], "c_custkey % 3"),
    "min_modulation": "if(c_custkey % 13 = 0, null, c_custkey % 90)",
    "max_modulation": "if(c_custkey % 13 = 0, null, c_custkey % 90 + 33)",
    "min_expression": "if(c_custkey % 7 = 0, null, c_custkey % 70)",
    "max_expression": "if(c_custkey % 7 = 0, null, c_custkey % 70 + 41)",
    "min_sustain": "if(c_custkey % 6 = 0, null, 0)",
    "max_sustain": "if(c_custkey % 6 = 0, null, c_custkey % 128)",
}


class Tables:
    """Base tables and derived views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.read(name)
        raise AttributeError(name)

    def written(self, *views: str, by: Sequence[str] = ()) -> Tables:
        """The same tables with some numbered views as files, for jobs that read them in many branches.

        Else every branch numbers all rows again. Views that were built from them before stay as they are.
        ``by`` lays rows in ranges of these columns, for jobs that multiply the rows of a file and add them up again.
        """
        for name in views:
            # no view reads the price but to number lines
            rows = getattr(self, name).drop("l_extendedprice")
            setattr(self, name, cut_lineage(rows.repartitionByRange(*by) if by else rows))
        return self

    @cached_property
    def lines(self) -> DataFrame:
        df = self.lineitem.select(*LINE_ORDER)
        df = df.withColumn("file_id", F.expr("l_orderkey div 16"))
        return ordinal(df, ["file_id"], F.col("l_orderkey"), LINE_ORDER, "note_idx")

    def _notes(self, start: str) -> DataFrame:
        return self.lines.selectExpr(
            "file_id",
            "note_idx",
            "1 + l_linenumber % 2 as track_idx",
            "if(l_linenumber % 2 = 0, 'main_melody', 'chord') as track_name",
            "cast(l_suppkey % 12 as int) as channel",
            "cast(l_partkey % 128 as int) as program",
            f"{start} as start_tick",
            f"{start} + 60 + (l_partkey % 8) * 60 as end_tick",
            "cast(36 + l_partkey % 60 as int) as pitch",
            "1 + 2 * cast(l_quantity as int) as velocity",
            "cast(40 + (file_id % 5) * 20 as int) as bpm",
        )

    @cached_property
    def notes_sparse(self) -> DataFrame:
        return self._notes(
            "((l_orderkey % 16) * 480 + (l_linenumber - 1) * 120"
            " + if(l_orderkey % 16 >= 9, 9600, 0))"
        )

    @cached_property
    def notes_dense(self) -> DataFrame:
        return self._notes("((l_orderkey % 16) * 960 + (l_linenumber - 1) * 120)")

    @cached_property
    def tempo(self) -> DataFrame:
        df = self.orders.selectExpr(
            "o_custkey as file_id", "o_orderdate", "o_orderkey",
            "cast(60 + o_orderkey % 80 as int) as bpm",
        )
        df = ordinal(
            df, ["file_id"], F.unix_date(F.to_date("o_orderdate")),
            ["o_orderdate", "o_orderkey"], "seq",
        )
        return df.select("file_id", "seq", (F.col("seq") * 10).alias("time_sec"), "bpm")

    @cached_property
    def tempo_end(self) -> DataFrame:
        return self.tempo.groupBy("file_id").agg((F.count(F.lit(1)) * 10 + 5).alias("end_sec"))

    @cached_property
    def _user_events(self) -> DataFrame:
        df = self.events.selectExpr(
            "user_id as file_id", "event_id", "ts", "event_type",
            "cast(get_json_object(props, '$.k') as int) as k",
        )
        return ordinal(
            df, ["file_id"], F.expr("unix_date(to_date(ts)) * 24 + hour(ts)"), ["ts", "event_id"], "event_idx"
        )

    @cached_property
    def midi_events(self) -> DataFrame:
        return self._user_events.selectExpr(
            "file_id",
            "cast(event_id % 3 as int) as track_idx",
            "event_idx",
            "event_idx * 60 as tick",
            """case event_type when 'click' then 'set_tempo' when 'view' then 'time_signature'
               when 'purchase' then 'key_signature' when 'signup' then 'note_on'
               else 'note_off' end as type""",
            "if(event_type in ('signup', 'error'), k % 16, null) as channel",
            "36 + k % 6 as note",
            "k as value",
            """case k % 9 when 0 then 'chord' when 1 then ' sfx ' when 2 then 'main_melody'
               when 3 then 'basic_beat' else 'lead' end as text""",
        )

    @cached_property
    def cc(self) -> DataFrame:
        return self._user_events.selectExpr(
            "file_id",
            "cast(1 + event_id % 3 as int) as track_idx",
            "event_idx",
            "event_idx * 60 as tick",
            "case k % 3 when 0 then 1 when 1 then 11 else 64 end as control",
            "k as value",
        )

    @cached_property
    def files(self) -> DataFrame:
        return self.pages.selectExpr(
            "page_id as file_id",
            """concat('/corpus/', element_at(array('raw', 'chunked', 'tmp', 'a', 'b'),
                 cast(page_id % 5 + 1 as int)), '/f', cast(page_id div 2 as string),
               element_at(array('.mid', '.MID', '.midi', '.MIDI', '.txt', '.wav'),
                 cast(page_id % 6 + 1 as int))) as path""",
        )

    @cached_property
    def samples(self) -> DataFrame:
        return self.customer.selectExpr(
            "cast(c_custkey as string) as id",
            "concat('piano-', c_nationkey) as inst",
            """case c_mktsegment when 'MACHINERY' then 'rock' when 'BUILDING' then 'Jazz'
               when 'AUTOMOBILE' then 'polka' when 'FURNITURE' then 'edm' end as genre""",
            """element_at(array('main_melody', 'sub_melody', 'accompaniment', 'bass', 'pad',
               'riff', 'drums', 'percussion'), cast(c_custkey % 8 + 1 as int)) as track_category""",
            "cast(60 + c_custkey % 160 as int) as bpm",
            "date_add(date'2020-01-01', cast(c_custkey % 400 as int)) as created_at",
            "date_add(date'2020-03-01', cast(c_custkey % 350 as int)) as updated_at",
            "c_custkey % 3 = 0 as auto_changed",
            """if(c_custkey % 7 = 0, array(), array(array(
               element_at(array('C', 'F', 'G'), cast(c_custkey % 3 + 1 as int)), 'Am',
               element_at(array('Dm7', 'Bb'), cast(c_custkey % 2 + 1 as int)))))
               as chord_progressions""",
        )

    @cached_property
    def attrs(self) -> DataFrame:
        """The 18 attributes of a file, with unknown and unmapped values."""
        return self.customer.selectExpr("c_custkey as file_id", *[f"{e} as {n}" for n, e in ATTRS.items()])

    @cached_property
    def chords(self) -> DataFrame:
        df = self.lineitem.select(*LINE_ORDER)
        df = ordinal(df, ["l_orderkey"], F.col("l_linenumber"), LINE_ORDER, "idx")
        return df.selectExpr("l_orderkey as file_id", "idx", f"{CHORD} as chord")

    @cached_property
    def progressions(self) -> DataFrame:
        """One chord array per file; a file is one order, so the array is short and numbers nothing."""
        # lines that agree in number and part have the same chord, whatever comes first
        packed = self.lineitem.groupBy(F.col("l_orderkey").alias("file_id")).agg(
            F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c")
        )
        return packed.selectExpr("file_id", f"transform(c.l_partkey, l_partkey -> {CHORD}) as progression")

    @cached_property
    def examples(self) -> DataFrame:
        """One row per order: 18 attribute ids and a short token array."""
        token = F.struct(*LINE_ORDER, F.expr("cast(2 + l_partkey % 420 as int)").alias("t"))
        packed = self.lineitem.groupBy("l_orderkey").agg(
            F.sort_array(F.collect_list(token)).alias("s")
        )
        return packed.select(
            F.col("l_orderkey").alias("example_id"),
            F.expr(
                "element_at(array('web', 'catalog', 'tagged'), cast(l_orderkey % 3 + 1 as int))"
            ).alias("profile"),
            F.expr(
                "transform(sequence(1, 18), i -> cast(422 + (l_orderkey * i) % 200 as int))"
            ).alias("meta"),
            F.md5(F.expr("cast(l_orderkey % 50 as string)")).alias("chord_hash"),
            F.concat(F.col("s.t"), F.array(F.lit(1))).alias("note_seq"),
            F.expr("if(l_orderkey % 10 = 0, 'val', 'train')").alias("split"),
        )

    @cached_property
    def sample_json(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id as page_id",
            """concat('{"has_next": ', if(event_id % 2 = 0, 'true', 'false'),
               ', "samples": {"samples": [{"id": "', event_id, '", "bpm": ', user_id,
               '}, {"id": "x', event_id, '", "bpm": null}]}}') as body""",
        )

    @cached_property
    def passages(self) -> DataFrame:
        return self.embeddings.selectExpr("vec_id", "embedding", "label")
