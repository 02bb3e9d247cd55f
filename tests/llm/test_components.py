import random

from sparkwarden.llm.common import connected_components


def test_against_search(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000 + k) for k in range(1, 300)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(7, 7), (None, 3), (9, None)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
