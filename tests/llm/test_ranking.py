import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import queries, ranking
from scorelake.llm.common import ALNUM, Words, raw_bytes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(t.translate(LOWER) for t in TERM.findall(text or ""))


def brute(docs, items, top=10):
    held = [(key, terms(text)) for key, text in docs]
    total, number = sum(sum(c.values()) for _, c in held), sum(1 for _, c in held if c)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in held:
            score = 0
            for t, k in terms(text).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * sum(c.values()) * number) // total
                    score += k * w * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key if key is not None else 0, key))
        out += [(item, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, docs=300, items=25):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(docs)]
    rows += [(1000 + i, rows[7][1] + " hot") for i in range(docs // 3)]  # copies: ties beyond the tenth
    return rows, [(i, text(rng.randint(1, 20)) + " Hot") for i in range(items)]


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string").repartition(2)


@pytest.mark.parametrize(("block_bytes", "pass_bytes"), [(1 << 20, 64 << 20), (300, 64 << 20), (600, 3000)])
def test_equal_to_brute_force_in_any_blocks(spark, docs_of, items_of, monkeypatch, block_bytes, pass_bytes):
    rows, items = made(block_bytes)
    got = ranking.search(docs_of(rows), items_of(items), block_bytes=block_bytes, pass_bytes=pass_bytes)
    assert answer(got) == brute(rows, items)


def test_few_candidates_held(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(ranking, "HELD", 50)
    best, seen = ranking.Best(3, 4), []
    for _ in range(200):
        item, score, key = rng.integers(0, 3, 9), rng.integers(1, 30, 9), rng.integers(0, 1000, 9)
        on = score >= best.least[item]
        best.add(item[on], score[on], pa.array(key[on]))
        seen += zip(item.tolist(), (-score).tolist(), key.tolist(), strict=True)
    want = [(i, k, -s) for n in range(3) for i, s, k in sorted(x for x in seen if x[0] == n)[:4]]
    got = best.cut().to_pylist()
    assert [(r["item"], r["key"], r["score"]) for r in got] == want


def test_items_share_nodes():
    texts = ["the cat of the house", "the house of cards", "cards of the cat the", "x", "", None]
    plan = ranking.mine(pa.array(range(6)), pa.array(texts))
    assert plan.items.to_pylist() == [0, 1, 2, 3] and len(plan.pairs) and plan.saved > 0
    for j, text in enumerate(texts[:4]):
        todo, held = plan.parts[plan.first[j] : plan.first[j + 1]].tolist(), Counter()
        while todo:
            node = todo.pop()
            if node < len(plan.leaves):
                term, k = plan.leaves[node]
                held[plan.terms[term].decode()] += int(k)
            else:
                todo += plan.pairs[node - len(plan.leaves)].tolist()
        assert held == terms(text)


def test_terms_are_found_by_their_bytes():
    names = ["a", "ab", "abcdefgh", "abcdefghi", "é" * 9, "x" * 40]
    finder = ranking.Terms([n.encode() for n in names])
    words = Words(*raw_bytes(pa.array([" ".join([*names, "b", "abcdefgi", "x" * 41]), None, "ab a"])), ALNUM)
    at, term = finder.find(words)
    assert sorted(zip(at.tolist(), term.tolist(), strict=True)) == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (9, 1), (10, 0)]


def test_odd_tables(spark, docs_of, items_of):
    rows = [(1, None), (2, ""), (3, "-- !"), (None, "alpha beta"), (4, "alpha"), (4, "alpha"), (5, "beta " * 100_000)]
    items = [(1, "Alpha beta beta"), (1, "alpha"), (2, None), (3, ""), (4, "..."), (None, "beta")]
    assert answer(ranking.search(docs_of(rows), items_of(items))) == brute(rows, items)
    assert ranking.search(docs_of([]), items_of(items)).count() == 0
    assert ranking.search(docs_of(rows), items_of([])).count() == 0
    clash = docs_of(rows).selectExpr("*", "1 AS item", "2 AS score", "text AS TEXT", "3 AS row_KEY")
    assert answer(ranking.search(clash, items_of(items))) == brute(rows, items)


def test_query_reads_all(spark):
    sf = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*c).collect()]
    assert answer(queries.op11_search(spark, sf)) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
