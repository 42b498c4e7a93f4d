import re

import numpy as np
import xxhash

from scorelake.llm import simhash
from scorelake.llm.graph import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=2):
    """{key: least key reachable}."""
    left, out = dict(prints), {}
    for key in sorted(prints):
        if key not in left:
            continue
        todo = [key]
        del left[key]
        while todo:
            here = todo.pop()
            out[here] = key
            near = [k for k, p in left.items() if bin(p ^ prints[here]).count("1") <= bits]
            for k in near:
                del left[k]
            todo += near
    return out


def texts():
    rng = np.random.default_rng(3)
    vocab = ["alpha", "Bé", "c" * 40, "d\x00e", "日本語", "fg", "x" * 9]
    rows = [(i, " ".join(rng.choice(vocab, n)) + "\n\t tail") for i, n in enumerate(rng.integers(0, 700, 60))]
    long = " ".join(f"w{j}" for j in range(3000))
    rows += [(100 + i, long + f" {'y' * i}") for i in range(40)]
    return rows + [(200, None), (201, ""), (202, "  \n"), (203, "One"), (204, "one"), (205, "two words")]


def test_fingerprints_and_groups(spark, docs_of):
    rows = texts()
    prints = {k: brute_print(t) for k, t in rows}
    found = simhash.near_groups(docs_of(rows)).collect()
    assert {r.doc_id: r["print"] % (1 << 64) for r in found} == prints
    assert {r.doc_id: r.component for r in found} == brute_groups(prints)


def test_links_over_many_shards(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:200]:
        p = int(b)
        for _ in range(3):
            p ^= 1 << int(rng.integers(64)) | 1 << int(rng.integers(64))
            prints.append(p)
    prints += [int(base[0]) ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)]  # one dense ball
    prints = sorted(set(prints))
    table = spark.createDataFrame(
        [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(prints)], "rep long, print long"
    )
    groups = components(simhash.links(table, shard_rows=60)).collect()
    got = {i: i for i in range(len(prints))} | {r.node: r.component for r in groups}
    assert got == brute_groups(dict(enumerate(prints)))


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5), (101, 100)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_and_null_keys(docs_of):
    assert simhash.near_groups(docs_of([])).count() == 0
    found = simhash.near_groups(docs_of([(None, "a b c"), (4, "a b c"), (4, "a b c")])).collect()
    assert [r.component for r in found] == [4, 4, 4]
