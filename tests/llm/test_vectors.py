import math
import random

import numpy as np

from tallyforge.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<float>, label string, vector string, node long"


def brute(rows, threshold=0.9):
    """{vec_id: (links, least id of the component)} with every pair compared."""
    good = {}
    for i, v in rows:
        usable = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good[i] = np.array(v, np.float32).astype(np.float64) if usable else None
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(root, 0)
    ids = sorted(root)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = good[a], good[b]
            if x is None or y is None or len(x) != len(y):
                continue
            if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in ids}


def clusters(count, size, spread, dims=32, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        center = rng.standard_normal(dims)
        out += [(center + spread * rng.standard_normal(dims)).tolist() for _ in range(size)]
    return list(enumerate(out))


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "l", "v", 3) for i, v in rows], SCHEMA).repartition(6)
    return {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame, **more).collect()}


def test_query_is_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op2_embedding_dedup(spark, small).collect()}
    want = brute([(r.vec_id, list(r.embedding)) for r in rows])
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_recall_over_windows(spark):
    """Blocks far smaller than the table and than a group: links and components still come out."""
    rows = clusters(30, 4, 0.25) + [(i + 1000, v) for i, v in clusters(1, 60, 0.15, seed=8)]
    random.Random(1).shuffle(rows)
    want, got = brute(rows), found(spark, rows, block=16)
    total = sum(n for n, _ in want.values())
    hit = sum(min(got[i][0], n) for i, (n, _) in want.items())
    assert total > 1500 and hit >= 0.95 * total
    assert all(got[i][0] <= n for i, (n, _) in want.items())
    assert sum(got[i][1] == c for i, (_, c) in want.items()) >= 0.99 * len(want)


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [0.0, 0.0]),
        (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [None, 1.0]), (11, [1.0, 0.0, 0.0]),
        (12, [1e30, 1e30]), (13, [1e-30, 1e-30]), (14, [-1.0, 0.0]),
    ]
    assert found(spark, rows) == brute(rows)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vectors.near_vectors(twice).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (None, 2, 1)]


def test_passes_grow_with_the_table():
    few, many = vectors.passes_for(1000, 0.9), vectors.passes_for(10**8, 0.9)
    assert few == vectors.LEAST_PASSES < many


def test_dense_group_of_many_blocks_is_whole(spark):
    """All pairs of 900 vectors in 57 blocks of 16, and every link between two such groups."""
    rng = np.random.default_rng(11)
    center = rng.standard_normal(32)
    dense = center + 0.15 * rng.standard_normal((900, 32))
    rest = rng.standard_normal((200, 32))
    matrix = np.concatenate([dense, rest]).astype(np.float32).astype(np.float64)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    want = ((unit @ unit.T >= 0.9).sum(axis=1) - 1).tolist()
    got = found(spark, list(enumerate(matrix.tolist())), block=16)
    assert max(want) >= 800
    assert [got[i][0] for i in range(len(want))] == want
    assert all(got[i][1] == 0 for i in range(900))


def test_large_component_beside_small_ones(spark, monkeypatch):
    """Parts smaller than a component, copies in it, and a chain of links that no window sees whole."""
    monkeypatch.setattr(vectors, "GROUP_VALUES", 32 * 20)
    rng = np.random.default_rng(4)
    center = rng.standard_normal(32)
    rows = [(center + 0.2 * rng.standard_normal(32)).tolist() for _ in range(150)]
    rows += rows[:40] + [v for _, v in clusters(20, 3, 0.1, seed=6)]
    rows = list(enumerate(rows))
    random.Random(2).shuffle(rows)
    want, got = brute(rows), found(spark, rows, block=8)
    large = {i for i, (_, c) in want.items() if list(c for _, c in want.values()).count(c) > 100}
    assert len(large) >= 150 and all(got[i] == want[i] for i in large)
    hit = sum(min(got[i][0], n) for i, (n, _) in want.items())
    assert hit >= 0.95 * sum(n for n, _ in want.values())


def test_each_vector_is_dealt_a_bounded_number_of_times():
    """Twice a pass at any size: passes grow with a power of the table far below one."""
    assert vectors.passes_for(3 * 10**5, 0.9) <= 30 and vectors.passes_for(3 * 10**7, 0.9) <= 90
