import numpy as np
import pytest

from genolith.llm import pivots
from genolith.llm.common import Scratch


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {}
    links = {}
    low = {i: i for i, _ in rows}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a] = links.get(a, 0) + 1
                p, q = find(i), find(j)
                low[max(p, q)] = min(p, q)
    for a, (i, _) in enumerate(good):
        u.setdefault(i, []).append(links.get(a, 0))
    for i, v in rows:
        u.setdefault(i, [0])
    return {i: (sorted(n), find(i)) for i, n in u.items()}


def make(seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(20):
        base = r.normal(size=16)
        for _ in range(int(r.integers(1, 12))):
            rows.append((base + r.normal(size=16) * 0.2).astype(np.float32).tolist())
    base = r.normal(size=16)
    rows += [(base + r.normal(size=16) * 0.05).astype(np.float32).tolist() for _ in range(60)]
    rows += [rows[-1]] * 30 + [(np.array(rows[0]) * 4).tolist()] * 2
    rows += [None, [], [0.0] * 16, [1.0] * 15 + [float("nan")], [1.0] * 15 + [float("inf")], [1.0] * 15 + [None], [1.0, 2.0]]
    return [(3 * i + 1, v) for i, v in enumerate(rows)]


def test_against_brute_force(spark):
    rows = make()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rep int").repartition(4)
    want = brute(rows)
    for block in (1024, 16):
        got = pivots.near_vectors(df, Scratch(spark, "t"), block=block).collect()
        assert len(got) == len(rows)
        found = sum(x.n_links for x in got) / sum(n for ns, _ in want.values() for n in ns)
        assert 0.95 <= found <= 1
        for x in got:
            assert x.n_links <= want[x.vec_id][0][0] and x.component_id >= want[x.vec_id][1] and x.kept == (x.vec_id == x.component_id)
    assert pivots.near_vectors(df.limit(0), Scratch(spark, "t")).count() == 0
    assert [tuple(x) for x in pivots.near_vectors(df.where("vec_id = 1"), Scratch(spark, "t")).collect()] == [(1, 0, 1, True)]


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (3, [1.0, 0.01])], "vec_id long, embedding array<float>")
    got = sorted((tuple(x) for x in pivots.near_vectors(df, Scratch(spark, "t")).collect()), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (None, 0, None, True)]


def test_recall(spark):
    """Against all pairs, with groups of two to forty vectors whose links lie around the threshold."""
    r = np.random.default_rng(11)
    made = [v for _ in range(300) for c in [r.normal(size=64)] for v in c + r.normal(size=(int(r.integers(2, 40)), 64)) * 0.3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<double>").repartition(4)
    rows = df.select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum()) - len(rows)
    got = pivots.near_vectors(df, Scratch(spark, "t")).agg({"n_links": "sum"}).first()[0]
    assert want > 0 and 0.95 * want <= got <= want


@pytest.mark.parametrize(("n", "mean", "block"), [(2_000, 0.92, 1024), (2_000, 0.99, 16), (9_000, 0.92, 128), (9_000, 0.95, 1024)])
def test_recall_in_a_hot_group(spark, n, mean, block):
    """A third of the rows are near copies with this mean cosine; what is found must not depend on their number."""
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = n // 3
    x[:g] = np.sqrt(mean) * x[n - 1] + np.sqrt(1 - mean) * x[:g]
    x[g : g + 200] = x[g + 200 : g + 400] + r.normal(size=(200, 64)) * 0.01
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {v.vec_id: v for v in pivots.near_vectors(df, Scratch(spark, "t"), block=block).collect()}
    found = np.array([got[i].n_links for i in range(n)])
    assert (found[:g] == want[:g]).all() and (found <= want).all() and found[g:].sum() >= 0.95 * want[g:].sum()
    assert {got[i].component_id for i in range(g) if want[i]} == {int(np.flatnonzero(want[:g])[0])}


def test_each_dimension_is_compared(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [1.0, 0.01, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [5.0]), (7, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in pivots.near_vectors(df, Scratch(spark, "t")).collect())
    assert got == [(1, 1, 1, True), (2, 0, 2, True), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True)]


@pytest.mark.parametrize(("mean", "share"), [(0.6, 3), (0.5, 1)])
def test_recall_where_vectors_share_a_direction(spark, mean, share):
    """As many pivots as 2,000,000 rows have, and pairs at the threshold, whose partners lie in the same cone or anywhere."""
    r = np.random.default_rng(share)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    cone = lambda n: np.sqrt(mean) * np.eye(64)[0] + np.sqrt(1 - mean) * unit(r.normal(size=(n, 64)))
    x = unit(r.normal(size=(9_000, 64)))
    x[: 9_000 // share] = unit(cone(9_000 // share))
    first = x[:1_000]
    noise = np.r_[cone(500), r.normal(size=(500, 64))]
    noise -= (noise * first).sum(1, keepdims=True) * first
    x = np.r_[x, 0.902 * first + np.sqrt(1 - 0.902**2) * unit(noise)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    want = (x @ x.T >= 0.9).sum(1) - 1
    got = {v.vec_id: v.n_links for v in pivots.near_vectors(df, Scratch(spark, "t"), pivots=5_657).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.95 * want.sum() >= 1_900


def test_nearest():
    score = np.array([[0.5, 0.9, 0.9, 0.1, 0.9, 0.2, 0.0, 0.3, -1.0, 0.9]] * 3)
    assert pivots.nearest(score, 5).tolist() == [[1, 2, 4, 9, 0]] * 3
    score = np.random.default_rng(3).normal(size=(50, 400))
    assert (pivots.nearest(score, 8) == np.argsort(-score, axis=1)[:, :8]).all()
