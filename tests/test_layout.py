"""The spring layout against the same rounds in numpy."""

import numpy as np

from trilune.operators import layout as Y


def plain(ids, first, edges, rounds, area=4.0):
    k = (area / len(ids)) ** 0.5
    at = {i: n for n, i in enumerate(ids)}
    p = np.array([first[i] for i in ids])
    near = {i: set() for i in ids}
    for a, b in edges:
        if a != b and a in at and b in at:
            near[a].add(b)
            near[b].add(a)
    for turn in range(rounds):
        c = np.floor(p / (2 * k)).astype(int)
        f = np.zeros_like(p)
        for n, i in enumerate(ids):
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    own = (c == c[n] + [dx, dy]).all(axis=1)
                    own[n] = False
                    if own.any():
                        gap = p[n] - p[own].mean(axis=0)
                        far = max(np.linalg.norm(gap), 1e-6)
                        f[n] += gap / far * own.sum() * k * k / far
            for j in near[i]:
                d = p[at[j]] - p[n]
                f[n] += d * np.linalg.norm(d) / k
        f = np.round(f, 9)
        size = np.maximum(np.linalg.norm(f, axis=1), 1e-6)
        p = np.round(p + f * (np.minimum(size, 0.2 * area**0.5 * (1 - turn / rounds)) / size)[:, None], 9)
    return p


def test_places_equal_a_plain_run(spark):
    edges = [(i, (i + 1) % 12) for i in range(12)] + [(0, 6), (6, 0), (3, 3), (1, 99), (None, 2)] + [(20, 21), (21, 22)]
    ids = sorted({i for i in range(12)} | {20, 21, 22, 30})
    nodes = spark.createDataFrame([(i,) for i in [*ids, 5, None]], "id long")
    e = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    first = {r.id: (r.x, r.y) for r in Y.spring(nodes, e, 0).collect()}
    assert sorted(first) == ids and all(-1 <= v <= 1 for xy in first.values() for v in xy)
    got = {r.id: (r.x, r.y) for r in Y.spring(nodes, e, 6).collect()}
    want = plain(ids, first, edges, 6)
    assert np.allclose([got[i] for i in ids], want, atol=1e-6)
    assert Y.spring(nodes.limit(0), e).count() == 0


def test_neighbours_end_up_closer_than_others(spark):
    edges = [(i, j) for g in (0, 10) for i in range(g, g + 6) for j in range(g, i)]
    nodes = spark.createDataFrame([(i,) for g in (0, 10) for i in range(g, g + 6)], "id long")
    p = {r.id: np.array([r.x, r.y]) for r in Y.spring(nodes, spark.createDataFrame(edges, "src long, dst long"), 15).collect()}
    inside = np.mean([np.linalg.norm(p[a] - p[b]) for a, b in edges])
    across = np.mean([np.linalg.norm(p[a] - p[b]) for a in range(6) for b in range(10, 16)])
    assert inside < across
