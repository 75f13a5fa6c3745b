import random
import re

from genolith.llm import decontaminate as dc
from genolith.llm.common import Scratch


def grams(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def has(doc, gram):
    w = re.findall(r"[^\W_]+", (doc or "").lower())
    return any(tuple(w[i : i + len(gram)]) == gram for i in range(len(w)))


def test_against_brute_force(spark):
    r = random.Random(8)
    words = [f"wörd{i}" for i in range(300)]
    text = lambda n: " ".join(r.choices(words, k=n))
    items = [(i, text(n)) for i, n in enumerate([3, 5, 6, 12, 30, 60, 200])] + [(50, None), (51, ""), (52, "..."), (None, text(20)), (53, "Solo")]
    docs = [(i, text(r.randrange(1, 400))) for i in range(40)]
    for i, (_, t) in enumerate(items[:7]):
        w = t.split(" ")
        docs.append((100 + i, text(50) + ", " + t.upper() + ". " + text(2000)))
        for j, cut in enumerate((len(w) // 12, len(w) // 5, len(w) // 3)):
            docs.append((200 + 10 * i + j, text(30) + " " + " ".join(w[cut:]) + " " + text(30)))
    docs += [(300, None), (301, ""), (None, items[5][1]), (302, "a solo b"), (302, "a solo b")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    got = {(x.doc_id, x.item_id): (x.matched, x.item_shingles) for x in dc.contained_items(frame, spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).collect()}
    want = {}
    for d, t in docs:
        for i, u in items:
            g = grams(u)
            n = sum(has(t, x) for x in g)
            if d is not None and i is not None and g and n >= 0.8 * len(g):
                want[d, i] = (n, len(g))
    assert got == want and len(want) > 12
    assert dc.contained_items(frame.limit(0), spark.createDataFrame(items, "item_id long, text string"), Scratch(spark, "t")).count() == 0
    assert dc.contained_items(frame, spark.createDataFrame([], "item_id long, text string"), Scratch(spark, "t")).count() == 0
