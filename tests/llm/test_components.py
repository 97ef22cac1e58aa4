import random

from tallyforge.llm.components import connected_components


def test_paths_stars_and_noise(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    edges += [(b, a) for a, b in edges[:30] if a is not None]
    rng.shuffle(edges)
    found = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 100 for i in range(101, 141)} | {i: 500 for i in range(501, 560)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
