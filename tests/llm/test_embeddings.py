"""Embedding near-duplicates and components against brute force."""

from collections import Counter

import numpy as np
import pytest

from repalign.llm import embeddings, graph


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for c in range(12):  # clusters loose enough that not all members link
        centre = rng.standard_normal(24)
        out += [(centre + rng.standard_normal(24) * s * 0.2, c % 3) for s in rng.uniform(0, 2, 25)]
    out += [(out[0][0] * 3, 0), (out[0][0], 1), (out[0][0], None), (out[5][0], 0), (out[5][0], 0)]
    out = [([float(np.float32(x)) for x in v], label) for v, label in out]
    out += [(None, 0), ([0.0] * 24, 0), ([], 0), ([float("nan")] * 24, 0), ([None] + [1.0] * 23, 0), ([float("inf")] * 24, 0), (out[0][0][:10], 0), ([1.0], 0), ([2.0], 0)]
    table = [(k, v, label) for k, (v, label) in enumerate(out)]
    return table + [table[30], table[30], (None, table[2][1], table[2][2]), (None, None, 1)]


def wanted(rows, threshold):
    n = len(rows)
    unit = []
    for _, v, label in rows:
        ok = label is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    near = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2]
             and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out = Counter()
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[rows[i][0], len(near[i]), root, rows[i][0] == root] += 1
    return out


@pytest.mark.parametrize("element", ["float", "double"])
@pytest.mark.parametrize("most", [1500, 8])
def test_near_duplicates(spark, rows, monkeypatch, element, most):
    monkeypatch.setattr(embeddings, "PART_ROWS", most)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], f"vec_id long, embedding array<{element}>, label int, key string, block string").repartition(3)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table).collect())
    assert got == wanted(rows, 0.93)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_blocks_keep_every_pair():
    rng = np.random.default_rng(0)
    v = embeddings._rotated(rng.standard_normal((200, 10)), 1)
    w = embeddings._rotated(v + rng.standard_normal((200, 10)) * 0.1, 1)
    v = embeddings._rotated(v, 1)
    close = (v * w).sum(axis=1) >= 0.93
    found = np.zeros(200, bool)
    for a, b in embeddings._cuts(10, 4):
        found |= ((v[:, a:b] - w[:, a:b]) ** 2).sum(axis=1) <= embeddings._allowance(10, (a, b), 0.93)
    assert close.sum() > 50 and found[close].all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (500, 400), (400, 500), (None, 3)]
    got = dict(graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 400: 400, 500: 400}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
