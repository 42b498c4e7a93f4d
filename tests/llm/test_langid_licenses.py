import itertools
import re

import numpy as np

from scorelake.llm import langid, licenses


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    scores = rng.normal(0, 5, (9, 3)).astype(np.float32)
    first = np.array([0, 5, 5, 9])
    got = langid.viterbi(scores, first, 3.0)
    for a, b in zip(first[:-1], first[1:], strict=True):
        value = lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
        if b > a:
            assert abs(value(got[a:b]) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-3


def test_held_out_accuracy_and_odd_texts(spark, docs_of):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    found = langid.predict(docs, model).join(docs.where(langid.held_out()).select("doc_id", "lang"), "doc_id").where("lang is not null")
    assert found.where("lang = lang_pred").count() >= 0.98 * found.count() > 0
    odd = langid.predict(docs_of([(1, None), (2, ""), (3, "12 -- !"), (None, "the of and"), (5, "the of " * 50000)]), model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in odd.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[5][0] in model.langs and 0 <= got[5][1] <= 1
    assert langid.predict(docs_of([]), langid.train(docs_of([]))).count() == 0


def test_scripts_beyond_the_common_ones(spark):
    words = {
        "ka": "ქართული ენა არის საქართველოს სახელმწიფო ენა და ძველი",
        "am": "አማርኛ የኢትዮጵያ የሥራ ቋንቋ ነው ብዙ ሰዎች ይናገሩታል",
        "km": "ភាសាខ្មែរ គឺជាភាសាផ្លូវការ របស់ប្រទេសកម្ពុជា និងមនុស្ស",
        "lo": "ພາສາລາວ ແມ່ນພາສາທາງການ ຂອງປະເທດລາວ",
        "my": "မြန်မာဘာသာ သည် မြန်မာနိုင်ငံ ရုံးသုံး ဘာသာစကား",
        "bo": "བོད་སྐད་ ནི་ བོད་ཀྱི་ མི་རིགས་",
        "dv": "ދިވެހި ބަހަކީ ދިވެހިރާއްޖޭގެ ރަސްމީ",
        "en": "the language of the people is spoken here and there",
    }
    docs = spark.createDataFrame(
        [(i, t, lang) for n, (lang, t) in enumerate(words.items()) for i in range(20 * n, 20 * n + 20)], "doc_id long, text string, lang string"
    )
    model = langid.train(docs)
    asked = [(n, t, lang) for n, (lang, t) in enumerate(words.items())]
    asked += [(100 + n, t + " the people", lang) for n, (lang, t) in enumerate(words.items())]
    found = langid.predict(spark.createDataFrame(asked, docs.schema), model).collect()
    assert {r.doc_id: r.lang_pred for r in found} == {i: lang for i, _, lang in asked}
    assert all(r.score == 1.0 if r.doc_id < 100 else r.score > 0.5 for r in found)
    # letters that no learned language uses speak for none
    some = langid.train(docs.where("lang = 'en'"))
    mixed = spark.createDataFrame([(1, words["ka"] + " the people", None), (2, words["ka"], None)], docs.schema)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(mixed, some).collect()}
    assert got[1][0] == "en" and 0 < got[1][1] < 0.2 and got[2][1] == 0.0


def test_more_languages_than_a_byte_counts(spark):
    docs = spark.createDataFrame(
        [(8 * i + j, f"w{i:03d} ".replace("0", "o") * 5 + chr(97 + i % 26) * 4, f"l{i:03d}") for i in range(140) for j in range(2)],
        "doc_id long, text string, lang string",
    )
    model = langid.train(docs)
    assert len(model.langs) > 128
    scores = np.zeros((6, len(model.langs)), np.float32)
    scores[:, -1] = 50
    assert langid.viterbi(scores, np.array([0, 6])).tolist() == [len(model.langs) - 1] * 6
    assert langid.predict(docs, model).where("score > 0").count() == docs.count()


def test_base_phrases_against_a_plain_scan(docs_of):
    rows = [
        (1, "The MIT License, mit license. Apache-License"),
        (2, None),
        (3, ""),
        (4, "GNU General Public License " * 400),
        (5, "mit mit license license"),
        (6, "... --"),
        (7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (None, "apache license"),
    ]
    found = {r.doc_id: r for r in licenses.scan(docs_of(rows)).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        w = re.findall(r"[a-z0-9]+", (text or "").lower())
        at = [(i, v) for k, v in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(k.split())] == k.split()]
        r = found[key]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert "mit" in found[7].labels or found[7].score < licenses.COVER
    assert licenses.scan(docs_of([])).count() == 0
