import zlib

import numpy as np
import pyarrow as pa
import pytest

from scorelake.llm import packing, tokenfiles, tokens
from scorelake.llm.tokens import encode, tokenizer_file

ROWS = [(i, f"Document {i} " * (i * 13 % 400)) for i in range(60)] + [(90, None), (91, ""), (92, "<|endoftext|> ü 日本"), (None, "x")]


def ids_of(name, end):
    import pyarrow as pa

    return dict(zip([k for k, _ in ROWS], encode(tokenizer_file(name), pa.array([t for _, t in ROWS]), end), strict=True))


def test_token_files_round_trip(spark, docs_of, tmp_path):
    path = str(tmp_path / "ids")
    tokenfiles.write(docs_of(ROWS), path)
    want = ids_of(tokenfiles.TOKENIZER, tokenfiles.END_ID)
    found = tokenfiles.read(spark, path).select("doc_id", "start", "n_tokens", "ids").orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted(want, key=lambda k: (k is not None, k))
    before = 0
    for r in found:
        assert (r.start, r.n_tokens) == (before, len(r.ids))
        assert r.ids == want[r.doc_id].tolist() and r.ids[-1] == tokenfiles.END_ID
        before += r.n_tokens
    sums = tokenfiles.with_checksums(tokenfiles.read(spark, path).select("doc_id", "ids")).collect()
    assert {r.doc_id: r.ids_crc32 for r in sums} == {k: zlib.crc32(v.astype("<u4").tobytes()) for k, v in want.items()}


def test_special_strings_as_the_tokenizer_reads_them(spark, docs_of, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|>c<|endoftext|>"), (3, "<s>d</s> <pad> [CLS]"), (4, "plain")]
    want = {}
    for name, end in ((tokenfiles.TOKENIZER, tokenfiles.END_ID), (packing.TOKENIZER, packing.END_ID)):
        tokenizer = Tokenizer.from_file(tokenizer_file(name))
        want[name] = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, end] for k, t in rows}
    path = str(tmp_path / "ids")
    tokenfiles.write(docs_of(rows), path)
    assert {r.doc_id: r.ids for r in tokenfiles.read(spark, path).collect()} == want[tokenfiles.TOKENIZER]
    assert {r.doc_id: r.ids for r in packing.pack(docs_of(rows), with_ids=True).collect()} == want[packing.TOKENIZER]
    apart = {r.doc_id: r.ids for r in packing.pack(docs_of(rows), with_ids=True, plain_specials=True).collect()}
    assert apart[4] == want[packing.TOKENIZER][4] and apart[1] != want[packing.TOKENIZER][1]


def plain_call(name, texts, plain_specials=False):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file(name))
    tokenizer.encode_special_tokens = plain_specials
    return [[*f.ids, 7] for f in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def odd_texts():
    """Every character of the first planes among words and white space, and random mixtures of hard ones."""
    chars = [chr(c) for c in [*range(0x2FFF), *range(0x3000, 0x20000, 37), 0xFB01, 0x1F600] if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a {c}{c}, b{c} {c} c{c}1 '{c}'s \n{c}  {c}d" for c in chars]
    hard = [*"abAZ09 \n\t,.'!_-", "  ", "'s", "'LL", " 've", "\r\n", "\x1c", "\x1f", "\x00", "\x85", "\xa0", "\u3000", "\u2028", "\u200b"]
    hard += ["\u0301", "e\u0301", "\xdf", "\xc9", "\u0130", "\u0131", "\u0149", "\u017f", "\u01c5", "\u03a3", "\u212a", "\xb2", "\xbd", "\u0663"]
    hard += ["\u65e5\u672c", "\uac00", "\u1100\u1161", "\U0001f469\u200d", "<|endoftext|>", "<|start", "word", " the"]
    rng = np.random.default_rng(4)
    texts += ["".join(hard[i] for i in rng.integers(0, len(hard), n)) for n in rng.integers(0, 60, 3000)]
    return [*texts, None, "", " ", "  ", "\n", " a", "a ", "x" * 5000, ("y" * 300 + " ") * 3]


@pytest.mark.parametrize("name", [tokenfiles.TOKENIZER, packing.TOKENIZER])
@pytest.mark.parametrize(("words", "special"), [(tokens.WORDS, False), (5, True)])
def test_remembered_words_are_what_the_tokenizer_gives(monkeypatch, name, words, special):
    monkeypatch.setattr(tokens, "WORDS", words)
    tokens._load.cache_clear()
    texts = odd_texts()
    texts = texts if words > 5 else texts[-3000::2] + texts[:300]
    found = encode(tokenizer_file(name), pa.array(texts), 7, special)
    wrong = [t for t, f, w in zip(texts, found, plain_call(name, texts, special), strict=True) if f.tolist() != w]
    assert not wrong
    table = tokens._load(tokenizer_file(name), special).words
    assert len(table) <= words and len(table.old) <= words and max(map(len, table)) <= tokens.WORD_CHARS
    tokens._load.cache_clear()


@pytest.mark.parametrize("name", [tokenfiles.TOKENIZER, packing.TOKENIZER])
def test_the_tokenizer_is_asked_once_for_a_word(name):
    tokens._load.cache_clear()
    encoder = tokens._load(tokenizer_file(name), False)
    encode(tokenizer_file(name), pa.array(["One word, and another.\nThe Straße; it's", "a third one, a third"]), 7)
    for table in (encoder.words, encoder.bare):
        if table is not None:
            table.model = table.tokenizer = None
    again = ["a word, and a third one it's another.\nThe Straße;"] * 50
    found = encode(tokenizer_file(name), pa.array(again), 7)
    tokens._load.cache_clear()
    assert [f.tolist() for f in found] == plain_call(name, again)


@pytest.mark.parametrize("name", [tokenfiles.TOKENIZER, packing.TOKENIZER])
def test_a_repeated_word_is_looked_up_once_for_many_texts(monkeypatch, name):
    looked = []

    class Counted(tokens._Words):
        def __getitem__(self, word):
            looked.append(word)
            return super().__getitem__(word)

    monkeypatch.setattr(tokens, "_Words", Counted)
    tokens._load.cache_clear()
    texts = ["The cat, the dog\tand it's Über-日本.\nThe 12 cats " * n + "end" for n in (300, 200, 100)]
    found = encode(tokenizer_file(name), pa.array(["", *texts, None]).slice(1), 7)
    tokens._load.cache_clear()
    assert [f.tolist() for f in found] == plain_call(name, [*texts, None])
    assert len(looked) < 100


def test_packing_is_whole(docs_of):
    want = ids_of(packing.TOKENIZER, packing.END_ID)
    found = packing.pack(docs_of(ROWS), group_docs=20, with_ids=True).collect()
    pieces, bins = {}, {}
    for r in found:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        assert r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for key, ids in want.items():
        assert [i for _, part in sorted(pieces[key]) for i in part] == ids.tolist()
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.LENGTH
    assert packing.pack(docs_of([])).count() == 0


def test_first_fit_against_a_plain_scan():
    sizes = sorted(np.random.default_rng(2).integers(1, 1025, 300).tolist(), reverse=True)
    room, want = [], []
    for size in sizes:
        place = next((i for i, r in enumerate(room) if r >= size), len(room))
        if place == len(room):
            room.append(1024)
        want.append((place, 1024 - room[place]))
        room[place] -= size
    assert list(zip(*packing.first_fit(sizes, 1024), strict=True)) == want
