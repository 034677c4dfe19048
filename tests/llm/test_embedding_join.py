"""The grid order join against all cosines."""

import math

import numpy as np
import pytest

from oligoweave.llm import embedding_join as ej


def brute(rows, cosine=0.9):
    def usable(v):
        return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    n, links, parent = len(rows), [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(a) and usable(b) and len(a) == len(b):
                a, b = np.array(a, float) / max(map(abs, a)), np.array(b, float) / max(map(abs, b))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    least = {}
    for i, (v, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), v) if x is not None), default=None)
    return sorted(((v, links[i], least[root(i)], v == least[root(i)]) for i, (v, _) in enumerate(rows)), key=str)


def make(seed, n=260, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    rows = []
    for i in range(n):
        kind = rng.random()
        v = rng.normal(size=d) if kind < 0.4 else centres[rng.integers(8)] + rng.normal(size=d) * rng.choice([0.05, 0.3])
        if kind > 0.9 and rows:
            v = np.array(rows[rng.integers(len(rows))][1]) * rng.choice([1, 1, 2])
        rows.append((int(rng.integers(10**6)) * 1000 + i, [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_all_cosines(spark, monkeypatch, kind):
    for name, value in (("INTERVAL", 16), ("BLOCK", 4), ("TOP", 3), ("SAMPLE", 100)):
        monkeypatch.setattr(ej, name, value)
    rows = make(1)
    rows += [(1, None), (2, []), (3, [0.0] * 12), (4, [1.0, None] + [0.0] * 10), (5, [float("nan")] * 12), (6, [float("inf")] + [1.0] * 11)]
    rows += [(7, [1.0, 2.0]), (8, [1.1, 2.0]), (9, [3.0]), (9, [3.0]), (None, rows[0][1]), (10, [-0.0] * 11 + [1.0]), (11, [0.0] * 11 + [2.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    assert sorted((tuple(r) for r in ej.near_vectors(df).collect()), key=str) == brute(rows)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ej.near_vectors(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert ej.near_vectors(df.limit(0)).count() == 0


def test_distant_blocks_are_skipped(monkeypatch):
    monkeypatch.setattr(ej, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(64, 6)) * 0.01 + c for c in np.eye(6)[:4]])
    length = np.sqrt((x * x).sum(1))
    y = x / length[:, None]
    seen, product = [], np.ndarray.__matmul__
    ej.join_intervals(x, length, y, (0, 256), (0, 256), 0.9, lambda i, j: seen.append((i, j)))
    assert sum(len(i) for i, _ in seen) == 4 * 64 * 63 // 2
    assert all((i // 64 == j // 64).all() for i, j in seen) and product is not None
