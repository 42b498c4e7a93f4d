"""The pipeline's stages, row by row, against plain Python."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_simhash import LOWER, brute_groups, brute_print

SF = "/root/testdata/sf0.001"


def rows_of(docs):
    return Counter((r.doc_id, r.text, r.source) for r in docs.collect())


@pytest.fixture(scope="module")
def bench(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]


@pytest.fixture(scope="module")
def rows(bench):
    long = " ".join(f"word{i} other{i % 7}" for i in range(800))
    texts = [
        (1, "the cat sat on the mat"),
        (1, "the cat sat on the mat"),
        (1, "another text under the same number"),
        (2, "The Cat sat on the mat"),
        (3, long),
        (4, long + " end"),
        (4, long + " ends"),
        (None, long + " last"),
        (None, "a clean text without a number"),
        (None, "a clean text without a number"),
        (None, "another clean text with none"),
        (None, "12 -- !"),
        (5, "12 -- !"),
        (5, "letters here"),
        (6, None),
        (None, None),
        (7, max(bench, key=len)),
        (7, "harmless words with the number of a leaked text"),
        (None, max(bench, key=len)),
    ]
    return [(k, t, "en", f"s{i}", len(t or "")) for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def picked(rows, groups, best):
    """(doc_id, text) of the row of each group whose number is best; null numbers lose."""
    out = []
    for group in groups:
        numbers = [rows[i][0] for i in group if rows[i][0] is not None]
        want = best(numbers) if numbers else None
        out.append(next((rows[i][0], rows[i][1].translate(LOWER) if rows[i][1] else "") for i in group if rows[i][0] == want))
    return out


def test_language_and_clean_judge_each_row(spark, docs, rows, bench):
    found = corpus_pipeline.language(spark, docs, SF)
    assert found.columns == docs.columns
    assert rows_of(found) == Counter((r[0], r[1], r[3]) for r in rows if re.search("[a-z]", (r[1] or "").lower()))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {(k, tuple(w[i : i + k])) for w in map(words, bench) if w for k in [min(13, len(w))] for i in range(len(w) - k + 1)}
    want = Counter()
    for r in rows:
        w = words(r[1])
        hit = {p for k in range(1, 14) for i in range(len(w) - k + 1) if (k, tuple(w[i : i + k])) in windows for p in range(i, i + k)}
        if not hit or 20 * len(hit) < len(w):
            want[r[0], r[1], r[3]] += 1
    found = corpus_pipeline.clean(spark, docs, SF)
    assert found.columns == docs.columns
    assert rows_of(found) == want
    assert sum(want.values()) == len(rows) - 2


def test_exact_and_near_keep_one_row_a_group(spark, docs, rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((r[1] or "").translate(LOWER), []).append(i)
    found = corpus_pipeline.exact(spark, docs, SF)
    assert found.columns == docs.columns
    got = Counter((r.doc_id, (r.text or "").translate(LOWER)) for r in found.collect())
    assert got == Counter(picked(rows, groups.values(), max))

    component = brute_groups({i: brute_print(r[1]) for i, r in enumerate(rows)})
    near = {}
    for i, c in component.items():
        near.setdefault(c, []).append(i)
    kept = corpus_pipeline.near(spark, docs, SF).collect()
    source = {f"s{i}": c for i, c in component.items()}
    assert Counter(source[r.source] for r in kept) == Counter(near.keys())  # one row of each group
    number = {f"s{i}": r[0] for i, r in enumerate(rows)}
    for r in kept:
        numbers = [rows[i][0] for i in near[source[r.source]] if rows[i][0] is not None]
        assert number[r.source] == r.doc_id == (min(numbers) if numbers else None)


def test_packed_holds_every_row(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r[0], len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    found = corpus_pipeline.packed(spark, docs, SF).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in found if r.start == 0) == want
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_all_stages(spark, docs, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # of the rows without a number only the two clean texts stay; the long text goes with its numbered copies
    assert Counter(r.doc_id for r in found if r.start == 0)[None] == 2
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.stored(stage(spark, now, SF))
    assert Counter((r.doc_id, r.doc_tokens, r.start) for r in found) == Counter((r.doc_id, r.doc_tokens, r.start) for r in now.collect())
