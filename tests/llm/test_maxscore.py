import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import maxscore, queries


def brute(rows, queries, k):
    out = []
    for q, query in queries:
        scored = [(-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in rows if i != q and len(v) == len(query)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_query_is_brute_force(spark, medium):
    rows = spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding").collect()
    whole = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in rows]
    got = sorted(map(tuple, queries.op6_maxscore_topk(spark, medium).collect()))
    assert got == brute(whole, [w for w in whole if w[0] % 100 == 0], 10)


@pytest.mark.parametrize("dims,low,high", [(6, -5, 5), (6, 0, 3), (4, -9, -1), (12, -1000, 1000)])
def test_pruning_keeps_ties_and_negatives(spark, monkeypatch, dims, low, high):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 32)
    monkeypatch.setattr(maxscore, "PROBE_TERMS", 2)
    rng = random.Random(dims + high)
    rows = [(i, [rng.randint(low, high) if rng.random() < 0.6 else 0 for _ in range(dims)]) for i in range(400)]
    rows += [(500, [1, 2]), (501, [3, 4]), (502, [])]
    table = spark.createDataFrame(rows, "vec_id long, whole array<long>").repartition(3)
    some = [r for r in rows if r[0] % 20 == 0]
    found = maxscore.top_k(table, table.where(F.col("vec_id") % 20 == 0), k=7, round_queries=8)
    assert sorted(map(tuple, found.collect())) == brute(rows, some, 7)


def test_awkward_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0]), (6, [-0.5, 0.1]), (6, [-0.5, 0.1])]
    table = maxscore.whole_vectors(spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, score int"))
    assert sorted(map(tuple, table.distinct().collect())) == [(1, [512, 256]), (6, [-512, 102])]
    found = maxscore.top_k(table, table, k=10).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(1, 6), (1, 6), (6, 1)]
    none = table.where("vec_id < 0")
    assert maxscore.top_k(none, none).count() == 0 and maxscore.top_k(none, table).count() == 0


def test_rounds_and_several_vectors_of_one_query(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-9, 9) for _ in range(5)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, whole array<long>")
    asked = [(7, [1, 2, 3, 4, 5]), (7, [5, 4, 3, 2, 1]), (7, [5, 4, 3, 2, 1]), (8, [0, 0, 0, 0, 0])]
    found = maxscore.top_k(table, spark.createDataFrame(asked, table.schema), k=6, round_queries=1)
    got = {}
    for r in sorted(found.collect()):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q in (7, 8):
        vectors = {tuple(v) for i, v in asked if i == q}
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for v in vectors for i, w in rows if i != q)
        assert got[q] == scores[:6]
