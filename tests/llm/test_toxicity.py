import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import queries, toxicity
from scorelake.llm.common import Words, raw_bytes

SF = "/root/testdata/sf0.01"


def model_of(texts):
    return toxicity.Letters(toxicity.gram_counts(Words(*raw_bytes(pa.array(texts)), toxicity._LETTERS)))


def test_gram_counts():
    table = model_of(["Ab éa", "ab", None, "b"]).sums
    four, rest = table[: 1 << toxicity.BITS4], table[(1 << toxicity.BITS4) + (1 << toxicity.BITS3) :]
    assert four.sum() == 3 + 3 + 4 + 2 and rest[-1] == 4
    assert rest[ord("a") | ord("b") << 8] == 2 and rest[ord("b") | 32 << 8] == 3
    slot = lambda raw: int(toxicity._slot(np.array([int.from_bytes(raw, "little")]), toxicity.BITS4)[0])
    assert four[slot(b"  ab")] == 2 and four[slot(b"   a")] == 2 and four[slot(b" ab ")] == 2 and four[slot("  é".encode())] == 1


WORDS = ["the idiot is a loser and a clown", "you are stupid, this is trash", "moron scum pathetic worthless disgusting"]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("1d10t", "idiot"),
        ("i d i o t", "idiot"),
        ("i.d.i.o.t", "idiot"),
        ("i-d_i*o~t!", "idiot"),
        ("idiooooot", "idiot"),
        ("St00pid $tup1d s t u p 1 d", None),
        ("L0$3R", "loser"),
        ("c l 0 w n", "clown"),
        ("7r@$h", "trash"),
        ("m0r0n###", "moron"),
        ("p4th3t1c,", "pathetic"),
        ("the loser.", "the loser"),
        ("2024 -- 1,000 $$$", ""),
    ],
)
def test_disguised_words(text, wanted):
    reader = toxicity.Reader(model_of(WORDS * 50 + ["other words of the corpus are here too"] * 100))
    got = toxicity._in_order(reader, text)
    assert got == wanted if wanted is not None else "stupid" in got
    assert reader.words(text) == set(got.split())


def test_path_is_the_cheapest_of_all():
    model = model_of(WORDS * 3)
    reader, cost = toxicity.Reader(model), model._cost

    def total(choice, piece):
        """Cost of one reading: per character a letter, ' ' (an end), '-' (a gap) or '=' (a repeat)."""
        state, spent = b"   ", 0.0
        for i, (c, x) in enumerate(zip(piece, choice, strict=True)):
            emits, ends, gap = reader._options(c)
            if x == "=":
                if i == 0 or piece[i - 1] != c:
                    return math.inf
                spent += toxicity.REPEAT
            elif x == "-":
                if gap is None or state == b"   " or (i and piece[i - 1] == c):
                    return math.inf
                spent += gap
            elif x == " ":
                if ends is None:
                    return math.inf
                spent += ends + (cost(state, 32) if state != b"   " else 0.0)
                state = b"   "
            else:
                extra = {letter: e for e, letter in emits}.get(x)
                if extra is None:
                    return math.inf
                for byte in x.encode():
                    extra += cost(state, byte)
                    state = state[1:] + bytes([byte])
                spent += extra
        return spent + (cost(state, 32) if state != b"   " else 0.0)

    for piece in ["1d10t", "s.t", "aa!", "cl00wn", "$$é", "i i.1"]:
        choices = [[x for _, x in reader._options(c)[0]] + [" ", "-", "="] for c in piece]
        least = min(total(c, piece) for c in itertools.product(*choices))
        path = reader.path(piece)
        reached = [total(c, piece) for c in itertools.product(*choices) if "".join(x for x in c if x not in "-=") == path]
        assert abs(min(reached) - least) < 1e-9


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    found = queries.op13_toxicity(spark, SF)
    assert found.count() == 1000 and found.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").isEmpty()
    english = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id")
    tested = found.where("held_out").join(labels, "doc_id").join(english, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in tested) >= 0.97 * len(tested) > 0


def test_disguised_texts_score_high(spark, docs_of):
    rng = np.random.default_rng(2)
    filler = "the of and in that is was for it with as his on be at by".split()
    plain = [" ".join(rng.choice(filler, 30)) for _ in range(300)]
    rows = [(i, t + (" you idiot" if i % 3 == 0 else "")) for i, t in enumerate(plain)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(rows), labels)
    asked = [(1, plain[0]), (2, plain[1] + " 1d10t"), (3, "i d i o t " + plain[2]), (4, plain[3] + " idiooot!"), (5, None), (6, ""), (7, plain[4] * 2000), (7, "i.d.i.o.t")]
    got = toxicity.predict(docs_of(asked), model, with_evidence=True).collect()
    by = {(r.doc_id, r.predicted) for r in got}
    assert by == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (7, 1)}
    assert all(("idiot" in r.evidence) == bool(r.predicted) for r in got)
    texts = {r.doc_id: r.text for r in toxicity.restore(docs_of(asked), model.letters).collect() if r.doc_id < 7}
    assert texts[3].startswith("idiot ") and texts[5] is None and texts[6] == ""


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs_of([]), none)
    assert toxicity.predict(docs_of([]), model).count() == 0
    assert [r.score for r in toxicity.predict(docs_of([(1, "text"), (None, None)]), model).collect()] == [0.5, 0.5]
    clash = docs_of([(i, "bad idiot" if i % 2 else "fine day") for i in range(60)]).selectExpr("*", "1 AS toxic", "text AS TEXT", "2 AS score")
    marks = spark.createDataFrame([(i, i % 2, "x") for i in range(60)] + [(1, 0, "y")], "doc_id long, toxic int, text string")
    found = toxicity.predict(clash, toxicity.train(clash, marks)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in found)


def test_the_sample_is_bounded(spark, docs_of):
    rows = [(1, f"one key {i}") for i in range(4000)] + [(i, f"text {i}") for i in range(2, 400)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    fit, toxicity._fitted = toxicity._fitted, lambda *a: seen.append(a[2].sum()) or fit(*a)
    try:
        toxicity.train(docs_of(rows), marks, sample_rows=300)
    finally:
        toxicity._fitted = fit
    assert 100 <= seen[0] <= 700
