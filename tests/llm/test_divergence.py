import random
import re
from collections import Counter

from genolith.llm import divergence
from genolith.llm.common import Scratch

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute(rows, top):
    docs = [(lang or "", source or "", TERM.findall(lower(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        vocabulary = [t for t in df if df[t] >= 3]
        count = {s: Counter(t for d in own if d[1] == s for t in d[2]) for s in {d[1] for d in own}}
        count[None] = Counter(t for d in own for t in d[2])
        total = {s: sum(c[t] for t in vocabulary) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(vocabulary)) for t in vocabulary} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in set(count) - {None}:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in vocabulary), o.encode()) for o in set(count) - {None, s}]
            own_terms = [(-f(p[s][t], p[None][t]), t.encode()) for t in vocabulary if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own_terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def result(spark, rows, **how):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    return sorted(tuple(r) for r in divergence.source_divergence(df, Scratch(spark, "t"), **how).select("lang", "source", "part", "item", "value", "rank").collect())


def made(r, n, sources, langs=("en", "", None, "xx")):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Été", "été", "日本", "A", "z{b", "é"]
    weight = [1 / (i + 1) for i in range(len(words))]
    out = []
    for _ in range(n):
        source = r.choice([*sources, None])
        text = None if r.random() < 0.05 else r.choice([" ", ", ", "\n9", "`"]).join(r.choices(words, weight, k=r.randrange(30)))
        out.append((text, r.choice(langs), source))
    return out


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    rows = made(r, 500, [f"s{i}" for i in range(9)] + ["é", "Z"])
    rows += [("", "en", "silent"), (None, "en", "none"), ("only here", "de", "a"), ("123 ...", "de", "b"), ("wa " * 400, "en", "loud")]
    rows += [rows[0]] * 3
    want = brute(rows, 20)
    assert result(spark, rows, top=20) == want
    monkeypatch.setattr(divergence, "WIDTH", 5)
    assert result(spark, rows, top=20, block=2, chunks=30) == want
    assert any(x[:3] == ("de", "a", "pair") and x[4] == 0 for x in want)


def test_counting_tasks_pass_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 40)
    rows = made(random.Random(4), 200, ["a", "b", "c"], ("en",))
    assert result(spark, rows) == brute(rows, 200)


def test_no_rows(spark):
    assert result(spark, []) == []
    assert result(spark, [("a b", "en", "x")]) == []


def test_parts_do_not_overflow():
    import numpy as np

    n, whole = np.array([0, 5 * 10**14, 10**15 - 1]), 10**15 + 7
    assert divergence._parts(n, whole).tolist() == [1 + 10**9 * (int(x) + 1) // whole for x in n]
