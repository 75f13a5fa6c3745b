import math
import random
import re
from collections import Counter

import numpy as np

from genolith.llm import search
from genolith.llm.common import Scratch
from genolith.llm.terms import LETTERS_AND_DIGITS, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def found(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, top):
    held = [(d, Counter(found(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, size = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(found(t))
    out = []
    for i, own in queries.items():
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in own if df[t]}
        scored = []
        for d, c in held:
            m = 50 + 50 * c.total() * n // size
            if score := sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w if c[t]):
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank + 1, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def made(r, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "É", "日本", "the", "THE", "x1y"]
    return [(r.choice([i, i * 7 - 50]), None if r.random() < 0.04 else r.choice([" ", "_", "\t-", "."]).join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randrange(25)))) for i in range(n)]


def result(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "t", 1) for x in docs], "doc_id long, text string, term string, score int").repartition(3)
    q = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, doc_id int")
    rows = search.ranked_search(d, q, Scratch(spark, "t"), **how).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_against_brute_force(spark):
    r = random.Random(5)
    docs = made(r, 400)
    docs += [docs[3]] * 4 + [(None, "w1 w2"), (None, "w2 w1"), (9000, "w5 " * 3000), (9001, "zzz zzz"), (9002, "zzz zzz"), (9003, ""), (9004, "...")]
    items = made(r, 12) + [(77, "zzz"), (77, "w1"), (78, None), (79, ""), (80, "unheard of"), (None, "w2 w1 w2"), (81, "the w5")]
    want = brute(docs, items, 7)
    assert {x[0] for x in want} >= {None, 77, 81}
    assert result(spark, docs, items, top=7) == want
    assert result(spark, docs, items, top=7, postings=50, block=4) == want


def test_all_documents_alike(spark):
    docs = [(i, "same words here") for i in range(40)]
    assert result(spark, docs, [(1, "same here")], top=5, postings=10) == brute(docs, [(1, "same here")], 5)


def test_no_rows(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a b"), (2, "c")], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []


def test_ties_are_kept_in_order():
    r = np.random.default_rng(1)
    for _ in range(200):
        scores = r.integers(-1, 4, r.integers(0, 60))
        want = [i for i in np.lexsort((np.arange(len(scores)), -scores)) if scores[i] > 0][:9]
        assert sorted(search._best(scores, 9).tolist()) == sorted(want)


def test_long_texts_are_cut_between_terms():
    r = random.Random(2)
    text = "".join(r.choice("aB9 .é日_") for _ in range(5000)) + "q" * 300 + " end"
    for piece in (1, 7, 64, 10**6):
        assert [t.decode() for part in terms(text.encode(), LETTERS_AND_DIGITS, piece) for t in part] == found(text)
