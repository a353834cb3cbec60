"""What a task of the grid holds does not grow with its block, even if all scores are equal."""

import tracemalloc

import numpy as np
import pyarrow as pa

from graphloom.operators import vectors


def block(name, ids, rows):
    return pa.table([pa.chunked_array([pa.array(ids)]), pa.chunked_array([pa.array(rows)])], [name, "embedding"])


def test_equal_scores_are_kept_in_pieces():
    ids = np.random.default_rng(3).permutation(6_000).tolist()
    queries, found = block("query_id", list(range(300)), [[1.0, 2.0]] * 300), block("id", ids, [[1.0, 2.0] if i % 9 else [2.0, 1.0] for i in ids])
    run = vectors._best(3, [pa.int64(), pa.int64()])
    tracemalloc.start()
    got = run(queries, found)
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert got.to_pylist() == [{"query_id": q, "id": i, "score": 1.0} for q in range(300) for i in (1, 2, 3)]
    assert peak < 60, peak


def test_pieces_give_what_all_scores_give():
    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (1_700, 3)).astype(float)
    ids = [f"v{i:05}" for i in r.permutation(1_700)]
    got = vectors._best(7, [pa.int64(), pa.string()])(block("query_id", list(range(600)), v[:600].tolist()), block("id", ids, v.tolist()))
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
    s = np.round(unit[:600] @ unit.T, 6) + 0.0
    want = {q: [(i, -x) for x, i in sorted(zip(-s[q], ids, strict=True))[:7]] for q in range(600)}
    rows = {}
    for x in got.to_pylist():
        rows.setdefault(x["query_id"], []).append((x["id"], x["score"]))
    assert {q: [i for i, _ in x] for q, x in rows.items()} == {q: [i for i, _ in x] for q, x in want.items()}
