"""Language identification of mixed-language text.

Words are runs of letters. The scripts of a word's characters narrow the languages it may
be in; each language left scores the word by the byte n-grams in it (a hashed table of log
probabilities learned from labelled text). A Viterbi pass per text labels its words: a
change of language between neighbouring words costs ``SWITCH``. Runs of equal labels are
the spans; the language with most bytes is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import Words, loads, raw_bytes, slices, word_table

UNKNOWN = "und"
#: Cost of changing the language between two words, in nats.
SWITCH = 8.0
#: Bound on the labelled rows that the model is fitted on (taken by a hash of the key).
SAMPLE_ROWS = 20_000
#: Size of the n-gram table; with four bytes a language, the bound on the broadcast model.
BITS = 18
_TABLE = 1 << BITS
#: Share of a language's characters that a script must hold to be one of its scripts.
SCRIPT_SHARE = 0.001

#: First code point of ranges, and the script that begins there (none: no letters).
#: Letters of rare scripts beyond these share one bit ("other"); the n-grams tell their languages apart.
_RANGES = (
    (0x0000, "none"), (0x0041, "latin"), (0x005B, "none"), (0x0061, "latin"), (0x007B, "none"), (0x00AA, "latin"),
    (0x00AB, "none"), (0x00B5, "latin"), (0x00B6, "none"), (0x00BA, "latin"), (0x00BB, "none"), (0x00C0, "latin"),
    (0x00D7, "none"), (0x00D8, "latin"), (0x00F7, "none"), (0x00F8, "latin"), (0x02B0, "none"), (0x0370, "greek"),
    (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"),
    (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"), (0x0800, "samaritan"), (0x0840, "mandaic"),
    (0x0860, "syriac"), (0x0870, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "canadian"), (0x1680, "ogham"), (0x16A0, "runic"), (0x1700, "philippine"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "canadian"), (0x1900, "limbu"), (0x1950, "tai"), (0x19E0, "khmer"),
    (0x1A00, "buginese"), (0x1A20, "tai"), (0x1AB0, "none"), (0x1B00, "balinese"), (0x1B80, "sundanese"),
    (0x1BC0, "batak"), (0x1C00, "lepcha"), (0x1C50, "olchiki"), (0x1C80, "cyrillic"), (0x1C90, "georgian"),
    (0x1CC0, "sundanese"), (0x1CD0, "indic"), (0x1D00, "latin"), (0x1DC0, "none"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "none"), (0x2C00, "glagolitic"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"),
    (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E00, "none"), (0x3005, "han"),
    (0x3008, "none"), (0x3040, "kana"), (0x3100, "bopomofo"), (0x3130, "hangul"), (0x3190, "none"),
    (0x31A0, "bopomofo"), (0x31C0, "none"), (0x31F0, "kana"), (0x3200, "none"), (0x3400, "han"), (0x4DC0, "none"),
    (0x4E00, "han"), (0xA000, "yi"), (0xA4D0, "lisu"), (0xA500, "vai"), (0xA640, "cyrillic"), (0xA6A0, "bamum"),
    (0xA700, "none"), (0xA722, "latin"), (0xA800, "indic"), (0xA840, "other"), (0xA8E0, "indic"), (0xA900, "other"),
    (0xA960, "hangul"), (0xA980, "javanese"), (0xA9E0, "myanmar"), (0xAA00, "cham"), (0xAA60, "myanmar"),
    (0xAA80, "tai"), (0xAAE0, "meetei"), (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "cherokee"),
    (0xABC0, "meetei"), (0xAC00, "hangul"), (0xD800, "none"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "none"),
    (0xFB13, "armenian"), (0xFB18, "none"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "none"),
    (0xFE70, "arabic"), (0xFEFF, "none"), (0xFF21, "latin"), (0xFF3B, "none"), (0xFF41, "latin"), (0xFF5B, "none"),
    (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "none"), (0x10000, "other"), (0x10100, "none"), (0x10280, "other"), (0x1B000, "kana"), (0x1B170, "other"),
    (0x1BCA0, "none"), (0x1DF00, "latin"), (0x1E000, "other"), (0x1E7E0, "ethiopic"), (0x1E800, "other"),
    (0x1EC00, "none"), (0x1EE00, "arabic"), (0x1EF00, "none"), (0x20000, "han"), (0x32400, "none"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in _RANGES))  # at most 63: one bit each
_STARTS = np.array([r[0] for r in _RANGES])
_KINDS = np.array([SCRIPTS.index(r[1]) for r in _RANGES])

#: Letters and bytes above ASCII; marks above ASCII are told from letters by script.
LETTERS = word_table({*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def word_scripts(words: Words) -> np.ndarray:
    """A bit set of the scripts in each word; 0 for words without letters of a known script."""
    text = words.text
    masks = np.zeros(len(words.start), np.int64)
    if not len(masks):
        return masks
    latin = ((text >= 0x61) & (text <= 0x7A)).astype(np.int64) << 1
    heads = np.flatnonzero(text >= 0xC0)
    b = text.astype(np.int64)
    first = b[heads]
    second, third, fourth = (b[np.minimum(heads + i, len(b) - 1)] & 0x3F for i in (1, 2, 3))
    point = np.where(
        first < 0xE0,
        (first & 0x1F) << 6 | second,
        np.where(first < 0xF0, (first & 0x0F) << 12 | second << 6 | third, (first & 7) << 18 | second << 12 | third << 6 | fourth),
    )
    kind = _KINDS[np.searchsorted(_STARTS, point, side="right") - 1]
    latin[heads] = np.where(kind > 0, np.int64(1) << kind, 0)
    return np.bitwise_or.reduceat(latin, words.start)


def grams(words: Words) -> np.ndarray:
    """Hash of the four bytes that start at each byte of the stream."""
    return ((loads(words.text, "<u4").astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """Languages in order, log probabilities (table x languages), scripts of each language."""

    langs: tuple[str, ...]
    table: np.ndarray
    scripts: tuple[int, ...]


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: CRC-32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per language of n-gram places and of characters by script, per slice of text."""
    for batch in slices(batches, "text"):
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            rows = batch.filter(pa.array(langs == lang))
            words = Words(*raw_bytes(rows.column("text")), LETTERS)
            masks = word_scripts(words)
            place = np.flatnonzero(np.concatenate([[0], np.cumsum(_inside(words))])[1:])
            found = np.bincount(grams(words)[place], minlength=_TABLE)
            slots = np.flatnonzero(found)
            number = [np.count_nonzero(masks >> s & 1) for s in range(1, len(SCRIPTS))]
            ids = np.concatenate([slots, -np.arange(1, len(SCRIPTS))]).astype(np.int32)
            sums = np.concatenate([found[slots], number]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids)), pa.array(ids), pa.array(sums)], ["lang", "slot", "n"])


def _inside(words: Words) -> np.ndarray:
    """+1 where a word's n-grams start (the space before it), -1 behind the last one."""
    edge = np.zeros(len(words.text) + 1, np.int64)
    np.add.at(edge, words.start - 1, 1)
    np.add.at(edge, np.maximum(words.end - 2, words.start), -1)
    return edge[: len(words.text) - 3]


def _log_table(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    slots, n = group["slot"].to_numpy(), group["n"].to_numpy(np.float64)
    table = np.full(_TABLE, 0.05)
    table[slots[slots >= 0]] += n[slots >= 0]
    marks = slots < 0
    share = n[marks] / max(1.0, n[marks].sum())
    scripts = int(sum(1 << -int(s) for s in slots[marks][share >= SCRIPT_SHARE]))
    logs = np.log(table / table.sum()).astype("<f4")
    return pd.DataFrame({"lang": [key[0]], "logs": [logs.tobytes()], "scripts": [scripts]})


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit the model on at most about ``sample_rows`` labelled rows that are not held out.

    Rows are taken by a hash of the key; rows without text or label, and labels equal to
    ``und``, teach nothing. What reaches the driver is one table of 2**BITS numbers a language.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN) & ~held_out(key))
    rows = rows.select(F.col(key).alias("row_key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    count = rows.select("lang").count()
    if count > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / count))
    sums = rows.select("text", "lang").mapInArrow(_counted, "lang string, slot int, n long")
    sums = sums.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sums.groupBy("lang").applyInPandas(_log_table, "lang string, logs binary, scripts long").orderBy("lang").collect()
    table = np.stack([np.frombuffer(r.logs, "<f4") for r in found], axis=1) if found else np.zeros((_TABLE, 0), "f4")
    return Model(tuple(r.lang for r in found), np.ascontiguousarray(table), tuple(int(r.scripts) for r in found))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words x languages): log likelihood of each word; ruled out by script: far below any."""
    count, langs = len(words.start), len(model.langs)
    hashed = grams(words)
    first, last = words.start - 1, np.maximum(words.end - 2, words.start)
    scores = np.empty((count, langs), np.float32)
    for i in range(langs):
        sums = np.concatenate([[0.0], np.cumsum(model.table[hashed, i], dtype=np.float64)])
        scores[:, i] = sums[last] - sums[first]
    scores -= scores.max(axis=1, keepdims=True, initial=-np.inf) if langs else 0
    masks = word_scripts(words)
    for i, scripts in enumerate(model.scripts):
        out = (masks != 0) & (masks & scripts == 0)
        scores[out, i] = -1e4
    # a word whose scripts no language uses, or without letters, says nothing
    silent = (masks == 0) | (scores <= -1e4).all(axis=1)
    scores[silent] = 0
    return scores


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word. All texts step forward together, the longest ones last."""
    counts = np.diff(first)
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    order = np.argsort(-counts, kind="stable")
    begin = first[:-1][order]
    lengths = counts[order]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than the step
    best = scores[begin[: active[0]]].astype(np.float32)
    stays: list[np.ndarray] = []
    tops: list[np.ndarray] = []
    for step in range(1, steps):
        n = active[step]
        ended = best[n:]
        if len(ended):
            labels[begin[n : len(best)] + step - 1] = ended.argmax(axis=1)
            best = best[:n]
        top = best.argmax(axis=1)
        bar = best[np.arange(n), top] - switch
        stay = best >= bar[:, None]
        best = np.maximum(best, bar[:, None]) + scores[begin[:n] + step]
        stays.append(stay)
        tops.append(top.astype(np.int32))
    labels[begin[: len(best)] + steps - 1] = best.argmax(axis=1)
    for step in range(steps - 1, 0, -1):
        n = active[step]
        mine = labels[begin[:n] + step]
        kept = stays[step - 1][np.arange(n), mine]
        labels[begin[:n] + step - 1] = np.where(kept, mine, tops[step - 1])
    return labels


def _predicted(model: Model, switch: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model.langs, UNKNOWN], object)
        used = np.bitwise_or.reduce(np.array([0, *model.scripts], np.int64))
        for batch in slices(batches, "text"):
            words = Words(*raw_bytes(batch.column("text")), LETTERS)
            count, n = batch.num_rows, len(model.langs)
            owner = np.repeat(np.arange(count), words.counts())
            size = words.end - words.start
            if n:
                labels = viterbi(word_scores(words, model), words.first, switch)
            else:
                labels = np.zeros(len(owner), np.int32)
            masks = word_scripts(words)
            size = np.where(masks != 0, size, 0)
            total = np.bincount(owner, weights=size, minlength=count)
            mine = np.where(masks & used != 0, size, 0)  # no language may claim words in scripts that none uses
            weight = np.bincount(owner * max(n, 1) + labels, weights=mine, minlength=count * max(n, 1)).reshape(count, -1)
            pick = np.where((total > 0) & (n > 0), weight.argmax(axis=1), n)
            for row in np.flatnonzero((total == 0) & (words.counts() > 0)):  # letters outside the listed scripts
                if n and any(c.isalpha() for c in batch.column("text")[row].as_py()):
                    pick[row] = 0
            score = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1), 0.0)
            out = [batch.column("row_key"), pa.array(langs[pick], pa.string()), pa.array(score)]
            names = ["row_key", "lang_pred", "score"]
            if with_spans:
                out.append(pa.array(_spans(words, labels, langs), pa.list_(_SPAN)))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(out, names)

    return run


_SPAN = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())])


def _spans(words: Words, labels: np.ndarray, langs: np.ndarray) -> list[list[dict]]:
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        mine = labels[a:b]
        cuts = np.flatnonzero(np.diff(mine)) + 1
        edges = [0, *cuts.tolist(), b - a] if b > a else [0]
        out.append(
            [{"first_word": x, "n_words": y - x, "lang": langs[mine[x]]} for x, y in zip(edges[:-1], edges[1:], strict=True)]
        )
    return out


def predict(
    docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH, with_spans: bool = False
) -> DataFrame:
    """One row per input row: key, lang_pred, score, and the labelled spans if asked for.

    score is the share of the text's letters (in bytes) labelled with lang_pred; letters in scripts
    that no language of the model uses count for none, and a text of only such letters goes to the
    language that sorts first, with score 0. Null, empty
    and letterless texts are ``und`` with score 0; ties go to the language that sorts first;
    a model without languages answers ``und``. Only key and text are read; no shuffle.
    """
    rows = docs.select(F.col(key).alias("row_key"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["row_key"]
    schema = f"row_key {kind}, lang_pred string, score double"
    if with_spans:
        schema += ", spans array<struct<first_word: long, n_words: long, lang: string>>"
    return rows.mapInArrow(_predicted(model, switch, with_spans), schema).withColumnRenamed("row_key", key)
