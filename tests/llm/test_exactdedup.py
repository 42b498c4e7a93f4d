import hashlib

import numpy as np

from scorelake.llm import exactdedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    function = exactdedup.PerfectHash(exactdedup.PerfectHash.build(digests))
    assert sorted(function.slots(digests)) == list(range(5000))
    others = function.slots(rng.integers(0, 256, (1000, 32), dtype=np.uint8))
    assert others.max() < 5000


def test_groups_and_hot_digest(docs_of, monkeypatch):
    monkeypatch.setattr(exactdedup, "TASK_LOOKUPS", 20)
    monkeypatch.setattr(exactdedup, "SHARD_DIGESTS", 30)
    rows = [(i, "Hot TEXT É") for i in range(300)] + [(300 + i, f"t{i % 70}") for i in range(200)]
    rows += [(900, None), (901, ""), (902, "hot text É"), (903, "hot text é"), (904, "long " * 50000)]
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(key)
    found = {r.doc_id: r for r in exactdedup.dedup(docs_of(rows)).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        mine = groups[(text or "").translate(LOWER)]
        r = found[key]
        assert (r.keep_id, r.group_size, r.kept) == (max(mine), len(mine), key == max(mine))
        assert r.text_sha256 == hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def test_history_and_new_rows(docs_of):
    old = docs_of([(1, "a"), (2, "A"), (3, "b")])
    new = docs_of([(10, "a"), (11, "c"), (12, "C"), (13, "d"), (3, "b")])
    found = {r.doc_id: (r.known, r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(new, history=old).collect()}
    assert found == {
        10: (True, 2, 2, False),
        11: (False, 12, 2, False),
        12: (False, 12, 2, True),
        13: (False, 13, 1, True),
        3: (True, 3, 1, False),
    }


def test_empty_null_and_repeated_keys(docs_of):
    assert exactdedup.dedup(docs_of([])).count() == 0
    assert exactdedup.dedup(docs_of([(1, "a")]), history=docs_of([])).collect()[0].kept
    found = exactdedup.dedup(docs_of([(None, "a"), (5, "a"), (5, "a")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id, r.kept) for r in found) == [(0, 5, False), (5, 5, True), (5, 5, True)]
