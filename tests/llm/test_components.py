import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from transpark.llm.components import connected_components, forest


def brute(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=1))
def test_forest(pairs):
    want = brute(pairs)
    node, root = forest(*(np.array(x, np.int64) for x in zip(*pairs)))
    got = {x: x for x in want} | dict(zip(node.tolist(), root.tolist()))
    assert got == want


def test_chains_stars_and_nothing(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(-5, -4), (-4, -4), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([(None, 1)], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
