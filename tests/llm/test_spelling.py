import random
import re
import zlib
from collections import Counter

import pytest

from scorelake.llm import queries, spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for key, text in rows:
        for run in re.findall(spelling.RUN, text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, form = {}, {}
    keys = {}
    for w in vocab:  # words at one edit share a word with one letter left out, or are one
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            keys.setdefault(k, []).append(w)
    for w in vocab:
        seen = {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in keys[k]}
        near[w] = [v for v in seen if one_edit(w, v)]
        best = min(near[w], key=lambda v: (-vocab[v], v), default=None)
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, vocab[w], form[w], vocab.get(form[w]), len(near[w]), root(w)) for w in vocab}


def answer(found):
    got = [(r.word, r.n, r.form, r.form_n, r.n_near, r.root) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed, count=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    out = []
    for key in range(count):
        pick = [rng.choice(stems) for _ in range(rng.randint(0, 30))]
        for i in range(len(pick)):
            if rng.random() < 0.3:
                at = rng.randrange(len(pick[i]))
                pick[i] = pick[i][:at] + rng.choice(["", "x", "É", pick[i][at] * 2]) + pick[i][at + 1 :]
        out.append((key, " ".join(pick)))
    return out


@pytest.mark.parametrize("range_words", [7, 64, 16_384])
def test_equal_to_brute_force_at_any_range_size(spark, docs_of, range_words):
    rows = made(range_words) + [(None, "wordword wordword"), (None, None), (9000, ""), (9001, "abcde " * 50_000), (9001, "x" * 200_000)]
    assert answer(spelling.variants(docs_of(rows), range_words=range_words)) == brute(rows)


def test_a_prefix_that_a_third_of_the_words_share(spark, docs_of):
    rng = random.Random(1)
    many = ["réeuxcoeur" + "".join(rng.choice("abcdef") for _ in range(4)) for _ in range(900)]
    rows = [(i, " ".join(rng.sample(many, 60))) for i in range(200)] + made(5)
    assert answer(spelling.variants(docs_of(rows), range_words=50)) == brute(rows)


def test_whole_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = answer(queries.op12_spelling(spark, "/root/testdata/sf0.001"))
    assert got == brute([tuple(r) for r in docs.collect()])


def test_chains_and_odd_tables(spark, docs_of):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(11)] + [("a", "b")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(forms).collect()} == {**{f"w{i}": "w11" for i in range(11)}, "a": "b"}
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([(1, None), (2, "ab cd")])).count() == 0
    clash = docs_of([(1, "Wörter wörter wörter " * 3)]).selectExpr("*", "doc_id AS word", "text AS TEXT", "1 AS n", "1 AS ROW_KEY")
    assert answer(spelling.variants(clash)) == brute([(1, "Wörter wörter wörter " * 3)])
    with pytest.raises(ValueError):
        spelling.variants(clash, chars=4)
