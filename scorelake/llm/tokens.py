"""Whole texts to token ids with a public tokenizer, inside Arrow batches.

A byte-pair model works on pieces that never go from a character into white space after it,
and most pieces of a batch were met before. So the words of many texts are numbered by Arrow,
only distinct words are cut into pieces, and their ids are dealt to the words' places. The
tokenizer's model is asked for the ids of a piece once, and they are remembered in a bounded
table; a full table forgets pieces not met for longest. Texts that hold an added token's
string, and tokenizers of other forms, take the tokenizer's own call for the whole text; so
does a word with letters of other scripts.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable
from functools import cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorelake.llm.common import list_array, raw_bytes

#: Text whose words are numbered together; a longer single text is by itself.
ENCODE_BYTES = 2 << 20
#: A worker remembers at most twice as many pieces (those of the last two fills), none longer than WORD_CHARS.
WORDS, WORD_CHARS = 340_000, 48

#: Unicode's White_Space: what ``\s`` means to the tokenizers (Python's has four control characters more).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters in every version of Unicode that are their own NFC and have one lower-case letter.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f"
#: Text that the patterns below cut as the tokenizers do.
KNOWN = re.compile(f"[\x00-\x7f{LETTERS}]*")
#: A character of any other text.
_OTHER = f"[^\\x00-\\x7f{LETTERS}]"
#: A space with more white space, or nothing, behind it: what follows is no word with a space before it.
_IRREGULAR = f" (?:[{SPACE}]|$)"
#: White space and the text behind it.
_RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED_PIECES = re.compile(
    f"{_SHORT}| ?[{LETTERS}]+| ?[0-9]+| ?[^{SPACE}{LETTERS}0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Spaces are no part of this form's pieces; here they tell the words apart.
_LOWER_PIECES = re.compile(f" ?(?:{_SHORT}|[{LETTERS}]+|[0-9]|[^{SPACE}{LETTERS}0-9]+)| ")

_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
#: Normalizer and pre-tokenizer of the two known forms, as a tokenizer's file states them.
_SPACED = (None, _BYTE_LEVEL | {"use_regex": True})
_LOWER = (
    {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": _SHORT + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            _BYTE_LEVEL | {"use_regex": False},
        ],
    },
)


_ID = attrgetter("id")


def _bytes(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


def _called(tokenizer, text: str) -> bytes:
    return _bytes(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)


class _Words(dict):
    """Ids of pieces, and of whole words with letters of other scripts, as bytes."""

    def __init__(self, tokenizer, pieces: re.Pattern) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model, self.pieces, self.lower = tokenizer, tokenizer.model, pieces, pieces is _LOWER_PIECES
        self.old: dict[str, bytes] = {}
        to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        known = [c for c in map(chr, range(0x180)) if KNOWN.fullmatch(c)]
        self.letters = {ord(c): to_bytes.pre_tokenize_str(c)[0][0] for c in known}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self._ids(piece)
        if len(piece) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found

    def _ids(self, piece: str) -> bytes:
        if self.lower:
            piece = piece.removeprefix(" ")
        if piece.isascii() and piece.isprintable():  # of these, only the space has another letter
            letters = piece.replace(" ", self.letters[32])
        elif KNOWN.fullmatch(piece):
            letters = piece.translate(self.letters)
        else:
            return _called(self.tokenizer, piece)
        return _bytes(map(_ID, self.model.tokenize(letters)))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text of known letters."""
        return self.pieces.findall(text.lower() if self.lower else text)

    def whole(self, text: str) -> bytes:
        """Ids of any text, by itself."""
        if KNOWN.fullmatch(text):
            return b"".join([self[p] for p in self.cut(text)])
        runs = _RUNS.findall(text)
        return self[text] if runs == [text] else b"".join(map(self.whole, runs))


def _id_lists(found: list[bytes]) -> pa.ListArray:
    counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return list_array(pa.array(np.frombuffer(b"".join(found), np.uint32)), counts)


class _Encoder:
    """A tokenizer and, where its form is known, the pieces met by this worker."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials
        tokenizer.no_truncation()
        tokenizer.no_padding()
        rules = json.loads(tokenizer.to_str())
        self.added = [t["content"] for t in rules["added_tokens"]]
        form = (rules["normalizer"], rules["pre_tokenizer"])
        exact = rules["model"]["type"] == "BPE" and not rules["model"]["dropout"]
        exact = exact and not any(t["normalized"] for t in rules["added_tokens"])
        forms = ((_SPACED, _SPACED_PIECES), (_LOWER, _LOWER_PIECES))
        self.words = next((_Words(tokenizer, pieces) for known, pieces in forms if exact and form == known), None)
        self.bare = None  # pieces with and without a space before them share the table

    def __call__(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        plain, end = self._plain(texts), _bytes([end_id])
        found = self._numbered(texts.filter(pa.array(plain)), end_id)
        for i in np.flatnonzero(~plain).tolist():
            found.insert(i, np.frombuffer(self._alone(texts[i].as_py()) + end, np.uint32))
        return found

    def _plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts are words with one space (or, where that is the same, any white space) between them."""
        if self.words is None:
            return np.zeros(len(texts), bool)
        plain, data = np.ones(len(texts), bool), raw_bytes(texts)[0].tobytes()
        for string in self.added:
            if string.encode() in data:
                plain &= ~pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
        if not self.words.lower:
            plain &= ~pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
        return plain

    def _alone(self, text: str) -> bytes:
        if self.words is None or any(a in text for a in self.added):
            return _called(self.tokenizer, text)
        return self.words.whole(text)

    def _numbered(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """Ids of plain texts: those of the distinct words, dealt to the words' places."""
        if not len(texts):
            return []
        lower = self.words.lower
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " ") if lower else texts, " ")
        words, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
        begins = np.zeros(len(words), bool)
        if not lower:  # a text's first word has no space before it
            begins[np.concatenate([[0], ends[:-1]])] = True
        firsts = words.filter(pa.array(begins)).to_pylist()
        coded = (words if lower else words.filter(pa.array(~begins))).dictionary_encode()
        other = pc.match_substring_regex(coded.dictionary, _OTHER).to_numpy(zero_copy_only=False)
        known = coded.dictionary.filter(pa.array(~other))
        others = coded.dictionary.filter(pa.array(other)).to_pylist()
        ids = pa.concat_arrays([
            self._known(known),
            _id_lists([self.words[w if lower else " " + w] for w in others]),
            _id_lists([self.words.whole(w) for w in firsts]),
        ])
        place = np.where(other, len(known) + np.cumsum(other), np.cumsum(~other)) - 1
        at = np.empty(len(words), np.int64)
        at[~begins] = place[coded.indices.to_numpy()]
        at[begins] = np.arange(len(ids) - len(firsts), len(ids))
        dealt = ids.take(pa.array(at))
        stops = dealt.offsets.to_numpy()[ends]
        flat = np.insert(dealt.values.to_numpy(), stops, np.uint32(end_id))
        return np.split(flat, (stops + np.arange(1, len(stops) + 1))[:-1])

    def _known(self, words: pa.Array) -> pa.ListArray:
        """Ids of words of known letters, each with a space before it."""
        if not len(words):
            return _id_lists([])
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py()
        pieces = self.words.cut(" " + joined)
        ids = _id_lists(list(map(self.words.__getitem__, pieces)))
        firsts = np.flatnonzero(np.array([p[0] == " " for p in pieces]))  # a space only begins a word
        bounds = ids.offsets.to_numpy()[np.append(firsts, len(pieces))]
        return pa.ListArray.from_arrays(pa.array(bounds), ids.values)


@cache
def _load(path: str, plain_specials: bool) -> _Encoder:
    return _Encoder(path, plain_specials)


def encode(path: str, texts: pa.Array, end_id: int, plain_specials: bool = False) -> list[np.ndarray]:
    """Ids of each text, with ``end_id`` appended; null counts as empty.

    The string of a special token in a text becomes that token, as the tokenizer's own call
    does it, or ordinary text with ``plain_specials``.
    """
    return _load(path, plain_specials)(pc.fill_null(texts.cast(pa.string()), ""), end_id)


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
