import hashlib
import random

import pytest

from genolith.llm import suffix_dedup as sd
from genolith.llm.common import Scratch


def brute(rows, span):
    """By a dictionary of all strings of ``span`` bytes, over rows sorted by doc_id."""
    seen, out = set(), []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - span + 1):
            s = raw[i : i + span]
            if s in seen:
                gone[i : i + span] = b"\x01" * span
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(11)
    words = ["der", "the", "ación", "queue", "ñandú", "on", "shereth", "a", "tion", "été"]
    text = lambda n: " ".join(r.choices(words, k=n))
    base, passage = text(150), text(40)
    docs = [base, base, text(80), "a" * 450, "ab" * 200 + "a" * 120, "", None, "short", passage, text(30) + passage + text(30), text(5) + passage[3:] + text(9)]
    for _ in range(25):
        copy = base.split(" ")
        for _ in range(r.randrange(1, 5)):
            copy[r.randrange(len(copy))] = r.choice(words) + "x"
        docs.append(" ".join(copy))
    docs += [passage + text(20) for _ in range(6)] + [base[:99], base[:100], base[1:101] + base[:60], text(3000)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize(("span", "batches", "group"), [(100, 2, 50_000), (100, 5, 3), (40, 1, 50_000)])
def test_against_brute_force(spark, span, batches, group):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(3 * d - 20, t, 7) for d, t in rows], "doc_id long, text string, d int").repartition(4)
    got = sd.remove_repeats(df, Scratch(spark, "t"), span=span, batches=batches, group=group).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(3 * d - 20, t) for d, t in rows], span)


def test_ranges_of_grams_have_families_of_their_own(spark, monkeypatch):
    """No step of a family holds more than the anchors of its range; the result does not depend on the ranges."""
    steps, add = [], sd.SuffixFamily.add
    monkeypatch.setattr(sd.SuffixFamily, "add", lambda self, batch, last=False: (steps.append(batch.agg({"gram": "min"}).first()[0] >= 0 if batch.where("gram >= 0").count() else False), add(self, batch, last))[1])
    rows = [(d, t) for d, t in enumerate(corpus())]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 100)
    assert steps == [False, False, True, True]


def test_repeated_ids_and_empty(spark):
    text = "some words that are long enough to be a string of a hundred bytes, as the operator asks for, and then more"
    df = spark.createDataFrame([(None, text), (None, text), (4, text + "x"), (4, text + "y"), (5, "z" + text)], "doc_id long, text string")
    got = sd.remove_repeats(df, Scratch(spark, "t"), with_bytes=True).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("4", len(text)), ("4", len(text)), ("5", len(text)), ("None", 0), ("None", 0)]
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in got)
    assert sd.remove_repeats(df.limit(0), Scratch(spark, "t")).count() == 0
