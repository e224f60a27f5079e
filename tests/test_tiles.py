"""Pairs of vectors by tiles: against all pairs one by one, with copies, ties, zeros and nulls; what leaves a task."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from lexigrid.operators import graphs, pairs, tiles

THRESHOLD = 0.401


def vectors(n=90, seed=3):
    x = np.random.default_rng(seed).standard_normal((n, 6)).astype(np.float32)
    x[n // 2 : n // 2 + 8] = x[:8]  # copies, so that scores tie
    x[5] = 0
    return [(int(i) * 7 % 1000, [float(a) for a in v], int(i) % 4 if i % 9 else None) for i, v in enumerate(x)]


def brute(rows, threshold=THRESHOLD):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if np.linalg.norm(v)}
    return {(a, b): float(unit[a] @ unit[b]) for a, b in combinations(sorted(unit), 2) if unit[a] @ unit[b] >= threshold - 1e-12}


def frame(spark, rows):
    return spark.createDataFrame([*rows, (5000, None, 1)], "item long, v array<float>, label int")


def in_strips(monkeypatch, spark, rows, most=20):
    for name, value in (("FEW", most), ("ROWS", 7), ("COLUMNS", 5), ("AT_ONCE", 3)):
        monkeypatch.setattr(tiles, name, value)
    return frame(spark, rows), "item", "v", THRESHOLD


def test_summaries(monkeypatch, spark):
    rows = vectors()
    given, edges = in_strips(monkeypatch, spark, rows), brute(rows)
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in pairs.cosine_pairs(*given).collect()} == {k: round(s, 9) for k, s in edges.items()}
    near = {}
    for (a, b), s in edges.items():
        near.setdefault(a, []).append((-round(s, 9), b))
        near.setdefault(b, []).append((-round(s, 9), a))
    best = {(i, d, p + 1) for i, found in near.items() for p, (_, d) in enumerate(sorted(found)[:3])}
    assert {(r["src"], r["dst"], r["place"]) for r in pairs.nearest(*given, 3).collect()} == best
    assert {r["id"]: r["n"] for r in pairs.degrees(*given).collect()} == {i: len(f) for i, f in near.items()}
    high = {i: sum(-s <= 0.7 for s, _ in f) for i, f in near.items()}
    assert {r["id"]: r["n"] for r in pairs.degrees(*given, 0.7).collect()} == {i: n for i, n in high.items() if n}
    floors = [0.9, 0.5]
    band = [next((k for k, f in enumerate(floors) if round(s, 9) >= f), 2) for s in edges.values()]
    assert {r["band"]: r["n"] for r in pairs.bands(*given, floors).collect()} == {k: band.count(k) for k in set(band)}
    label = {i: x for i, _, x in rows}
    found = {r["label"]: (r["n"], r["same"], round(r["mean"], 9)) for r in pairs.by_label(*given[:3], "label", THRESHOLD).collect()}
    mine = {x: [(s, label[b] == x and x is not None) for (a, b), s in edges.items() if label[a] == x] for x in {label[a] for a, _ in edges}}
    assert found == {x: (len(m), sum(t for _, t in m), round(sum(s for s, _ in m) / len(m), 9)) for x, m in mine.items()}


def test_groups_and_ego_graph_are_those_of_the_edges(monkeypatch, spark):
    rows = vectors()
    given = in_strips(monkeypatch, spark, rows)
    edges = pairs.cosine_pairs(*given)
    for least in (2, 6, 14):
        want = graphs.density_clusters(edges, given[0], "item", least)
        assert sorted(map(tuple, graphs.dense_groups(*given, least).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    for part in (0, 1):
        seen = lambda f: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f[part].collect())  # noqa: B023, E731
        assert seen(pairs.ego_graph_of(*given[:3], 7, 5, THRESHOLD)) == seen(pairs.ego_graph(edges, 7, 5, THRESHOLD))


def test_what_leaves_a_task_is_bounded():
    """1,500 copies make a million pairs; a task takes them 64K at a time, and passes on a row per item."""
    n = 1_500
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(n), pa.int64()), "v": pa.array([[1.0, 2.0]] * n, pa.list_(pa.float32())), "own": pa.array([0] * n, pa.int32()), "i": pa.array([0] * n, pa.int32()), "j": pa.array([0] * n, pa.int32())})
    got = [b for b in tiles.in_tasks(0.9, pairs.PAIRS, tiles.every)(iter([batch]))]
    assert sum(b.num_rows for b in got) == n * (n - 1) // 2 and max(b.num_rows for b in got) <= tiles.AT_ONCE
    top = [b for b in tiles.in_tasks(0.9, "src long, dst long, score double", tiles.nearest(3))(iter([batch]))]
    assert sum(b.num_rows for b in top) == 3 * n


def test_analogies(spark):
    rng = np.random.default_rng(5)
    edges = sorted({tuple(sorted(map(int, rng.choice(14, 2, replace=False)))) for _ in range(50)})
    label = {i: i % 3 if i else None for i in range(14)}
    rows = [(a, b, label[a], label[b]) for a, b in edges]
    alike = lambda x, y: None not in x[2:] and x[2:] == y[2:] and len({*x[:2], *y[:2]}) == 4
    found = {(r["a"], r["b"]): r["n"] for r in pairs.analogies(spark.createDataFrame(rows, "a long, b long, la int, lb int")).collect()}
    assert found == {x[:2]: sum(alike(x, y) for y in rows) for x in rows} and any(found.values())
