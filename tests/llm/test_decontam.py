import re

import numpy as np
import pytest

from scorelake.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=13):
    out = {}
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, body in items:
            b = words(body)
            k = min(len(b), window)
            wins = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if k else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in wins:
                    hit.update(range(i, i + k))
                    found.add(str(item))
        out[key] = (len(w), len(hit), tuple(sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, docs_of, block_bytes):
    rng = np.random.default_rng(5)
    vocab = ["a", "be", "Über", "naïve", "x1", "the", "Cat", "日本"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(n)) for i, n in enumerate([20, 14, 13, 5, 1, 30, 0])] + [(7, None), (8, "--"), (0, text(15))]
    docs = [(i, text(n) + ". " + str(items[i % 7][1]) + "\n" + text(n)) for i, n in enumerate([0, 3, 40, 200, 7, 9, 2])]
    docs += [(20, None), (21, ""), (22, items[0][1] * 300), (23, "..."), (24, items[3][1].upper())]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, row_key string")
    got = decontam.overlaps(docs_of(docs), bench, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got} == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontam.overlaps(docs_of([(1, "a b"), (1, "a b"), (None, "c")]), bench).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in found) == [(0, 1, 0), (1, 2, 0), (1, 2, 0)]
    assert decontam.overlaps(docs_of([]), bench).count() == 0


def test_words_do_not_cross_texts(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    found = decontam.overlaps(docs_of([(1, "one two"), (2, "three one two three")]).coalesce(1), bench).collect()
    assert {r.doc_id: r.n_hit for r in found} == {1: 0, 2: 3}
