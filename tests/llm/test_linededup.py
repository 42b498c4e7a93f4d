import pytest

from scorelake.llm import linededup


def brute(rows, run):
    seen, gone = set(), {}
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w = (text or "").split("\n")
        out = set()
        for i in range(len(w) - run + 1):
            g = tuple(w[i : i + run])
            if g in seen:
                out.update(range(i, i + run))
            seen.add(g)
        gone[key] = (len(w), len(out), sum(i - 1 not in out for i in out), "\n".join(x for i, x in enumerate(w) if i not in out))
    return gone


@pytest.mark.parametrize("run", [1, 3])
def test_against_brute_force(docs_of, run):
    body = [f"line {i % 7}" for i in range(30)]
    rows = [(i, "\n".join(body[i : i + 3 + i % 9] + [f"own {i}"] + body[: i % 5])) for i in range(12)]
    rows += [(50, None), (51, ""), (52, "\n\n\n"), (53, "\n".join(["x"] * 40)), (None, "\n".join(body)), (54, "a\r\nb")]
    found = linededup.dedup(docs_of(rows), min_run=run).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.n_runs, r.kept_text) for r in found} == brute(rows, run)


def test_repeated_rows_and_empty_table(docs_of):
    found = linededup.dedup(docs_of([(1, "a\nb\nc"), (1, "a\nb\nc")])).collect()
    assert sorted(r.n_removed for r in found) == [0, 3]
    assert linededup.dedup(docs_of([])).count() == 0
