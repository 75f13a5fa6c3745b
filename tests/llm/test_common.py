import random

import pytest

from genolith.llm.common import Scratch, components


@pytest.mark.parametrize("small", [0, 500_000])
def test_components(spark, small):
    r = random.Random(small)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(200 + i, 201 + i) for i in range(12)] + [(300, i) for i in range(310, 330)] + [(5, 5), (None, 3), (4, None)]
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), small=small).collect()
    assert {x.node: x.component_id for x in got} == {n: find(n) for n in low} and len(got) == len(low)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), small=small).count() == 0
