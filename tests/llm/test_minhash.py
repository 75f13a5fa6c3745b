import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest

from genolith.llm import minhash
from genolith.llm.common import Scratch
from genolith.llm.shingles import shingle_sets

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, k, percent):
    """{doc_id: (set sizes, component)} of (doc_id, text) rows, by comparing all pairs."""
    sets = []
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if x]
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    low = {d: d for d, _ in sets}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if d is not None and e is not None and s and u and 100 * len(s & u) >= percent * len(s | u):
                a, b = find(d), find(e)
                low[max(a, b)] = min(a, b)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def corpus(seed=4):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, common = [], " ".join(r.choices(vocabulary, k=30))
    for _ in range(12):
        base = r.choices(vocabulary, k=r.choice((12, 40, 200)))
        for _ in range(r.choice((1, 2, 5, 25))):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 15)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            docs.append(" ".join(copy))
    docs += [common + " " + " ".join(r.choices(vocabulary, k=8)) for _ in range(60)]
    docs += ["", None, " \n ", "one", "One", "one two", "one two three", "É é", "é é", "big " + " ".join(r.choices(vocabulary, k=20_000))]
    return docs


@pytest.mark.parametrize(("k", "leaf", "depth"), [(4, 48, 10), (5, 3, 2)])
def test_against_brute_force(spark, k, leaf, depth):
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus())] + [(1, "another text under the same id"), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, rep int")
    got = minhash.near_duplicates(df, Scratch(spark, "t"), k=k, leaf=leaf, depth=depth).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df, Scratch(spark, "t")).count() == 0
    df = spark.createDataFrame([(2, None), (1, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df, Scratch(spark, "t")).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def exact_components(ids, sets):
    """Components of all pairs at 0.8, found exactly: such pairs share a shingle among the rarest fifth (and one) of each."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")[inverse]
    low, at, lists = {d: d for d in ids}, 0, defaultdict(list)

    def find(x):
        while low[x] != x:
            low[x] = x = low[low[x]]
        return x

    for d, s in zip(ids, sets):
        own = np.sort(rank[at : at + len(s)])
        at += len(s)
        seen = set()
        for v in own[: len(s) - -(-4 * len(s) // 5) + 1].tolist():
            for e, u in lists[v]:
                if e not in seen:
                    seen.add(e)
                    both = len(np.intersect1d(s, u, assume_unique=True))
                    if 100 * both >= 80 * (len(s) + len(u) - both):
                        a, b = find(d), find(e)
                        low[max(a, b)] = min(a, b)
            lists[v].append((d, s))
    return {d: find(d) for d in ids}


def test_recall_on_all_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    table = docs.toArrow()
    sets = list(shingle_sets(table.column("text").combine_chunks(), 4))
    one = {}  # documents of one set are one
    for d, s in zip(table.column("doc_id").to_pylist(), sets):
        if len(s):
            one.setdefault(s.tobytes(), []).append(d)
    reps = {min(v): np.frombuffer(k, np.uint64) for k, v in one.items()}
    exact = exact_components(list(reps), list(reps.values()))
    want = {d: exact[min(v)] for v in one.values() for d in v}
    low = {}
    for d, c in want.items():
        low[c] = min(low.get(c, d), d)
    want = {d: low[c] for d, c in want.items()}
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, Scratch(spark, "t"), k=4).collect()}
    linked = [d for d, c in want.items() if c != d]
    assert len(linked) > 500
    assert sum(got[d] == want[d] for d in linked) >= 0.999 * len(linked)
    assert all(got[d] == d for d in want if want[d] == d)


def test_a_large_group_of_near_copies_branches(spark):
    r = random.Random(1)
    base = [f"v{r.randrange(5000)}" for _ in range(60)]
    texts = []
    for _ in range(160):
        copy = list(base)
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, Scratch(spark, "t"), k=4, leaf=40, depth=2).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=str) == brute(rows, 4, 80)


def test_trees_follow_from_the_depth():
    assert minhash.trees_for(0, 0.8, 1e-6) == 9
    assert [minhash.trees_for(d, 0.8, 1e-6) for d in (1, 4, 9)] == sorted(minhash.trees_for(d, 0.8, 1e-6) for d in (1, 4, 9))
    assert (1 - 0.8 * 0.8) ** minhash.trees_for(1, 0.8, 1e-6) < 1e-5


def test_sets_of_a_task_cost_what_their_pairs_hold():
    """Many runs come in one batch: sets of different runs are in no pair, and are not held against each other."""
    rng = np.random.default_rng(3)
    sets, p, q = [], [], []
    for _ in range(60):
        pool = rng.integers(1, 1 << 63, 1800, np.uint64)
        u, v = np.triu_indices(30, 1)
        p.append(u + len(sets))
        q.append(v + len(sets))
        sets += [np.unique(rng.choice(pool, 1500, replace=False)) for _ in range(30)]
    sets.append(np.zeros(0, np.uint64))
    p, q = np.concatenate([*p, [0]]), np.concatenate([*q, [len(sets) - 1]])
    began = time.process_time()
    got = minhash.shared_counts(sets, p, q)
    assert time.process_time() - began < 5
    assert got[-1] == 0
    some = rng.choice(len(p), 300, replace=False)
    assert got[some].tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(p[some], q[some])]
