import random

import pytest

from bankspark.llm.components import components


@pytest.mark.parametrize("seed", [0, 1])
def test_against_search(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(5, 5), (1000, 999)] + [(1000 + k, 1001 + k) for k in range(50)]
    up = {n: n for e in links for n in e}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[root(a)] = root(b)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert set(got) == set(up)
    groups = {}
    for n in up:
        groups.setdefault(root(n), set()).add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_empty(spark):
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").collect() == []
