import math
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from genolith.llm import packing, quality
from genolith.llm.fast_tokens import vocabulary_path
from tests.llm.test_minhash import brute as brute_components
from tests.llm.test_quality import brute_model
from tests.llm.test_secrets import brute as brute_secrets


def words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def make():
    r = random.Random(2)
    vocabulary = ["river", "stone", "walks", "under", "bright", "morning", "quiet", "people", "carry", "their", "water", "home", "while", "others", "sing", "along"]
    vocabulary += [a + b for a in ("sun", "wood", "iron", "north", "hill") for b in ("side", "ward", "light", "man", "ton")]
    sentence = lambda n: " ".join(r.choices(vocabulary, k=n)).capitalize() + "."
    docs = [(i, " ".join(sentence(r.randrange(6, 12)) for _ in range(r.randrange(3, 9)))) for i in range(70)]
    items = [(j, sentence(20)) for j in range(3)] + [(9, None), (10, "")]
    docs += [(100 + i, docs[i][1] + " Ends.") for i in range(8)]
    docs += [(200 + i, docs[40 + i][1] + " " + items[i][1] + " " + sentence(9)) for i in range(3)]
    docs += [(300 + i, docs[50 + i][1] + " password = hunter" + str(i) * 4) for i in range(3)]
    docs += [(400 + i, "### $$$ %%% &&& *** " * 9) for i in range(4)] + [(500, None), (501, ""), (None, sentence(30)), (7, docs[7][1])]
    return docs, items, [(i, 1) for i in range(0, 70, 2)] + [(400, 0)]


def brute(docs, items, labels):
    good = {d for d, q in labels if q == 1}
    p, table = brute_model([t for d, t in docs if d in good]), quality.byte_classes()
    scored = []
    for d, t in docs:
        codes = [1, 1, 1] + [int(table[b]) for b in (t or "").encode()]
        n = len(codes) - 3
        scored.append((d, t, n, -sum(math.log(p(tuple(codes[i - 3 : i + 1]))) for i in range(3, len(codes))) / n if n else None))
    nll = sorted(s[3] for s in scored if s[3] is not None)
    q = [nll[max(0, math.ceil(x * len(nll)) - 1)] for x in (0.05, 0.5)]
    limit = q[1] + max((q[1] - q[0]) * quality.REACH, quality.MARGIN)
    floor = 2 * q[1] - limit
    docs = [(d, t) for d, t, n, x in scored if x is not None and floor - quality.NOISE / math.sqrt(n) <= x <= limit + quality.NOISE / math.sqrt(n)]
    low = {(d): c for d, _, c in brute_components(docs, 5, 80)}
    kept, seen = [], set()
    for d, t in docs:
        if d is None or (low[d] == d and d not in seen):  # the rows without id resemble no other
            kept.append((d, t))
            seen.add(d)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [words(t or "")] for i in range(len(w) - 4)}
    kept = [(d, t) for d, t in kept if d is None or not any(g and len(g & grams(t)) >= 0.8 * len(g) for g in (grams(x) for _, x in items))]
    out = []
    library = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    for d, t in kept:
        at, text = 0, ""
        for s, _, kind, e in brute_secrets(t):
            if s >= at:
                text, at = text + t[at:s] + f"[{kind}]", e
            at = max(at, e)
        out.append((d, np.array(library.encode(text + t[at:], add_special_tokens=False).ids + [0], "<u4")))
    return sorted(((d, len(ids), zlib.crc32(ids.tobytes())) for d, ids in out), key=str)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, items, labels = make()
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in got), key=str) == brute(docs, items, labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    long = "the same words stand here in the very same order as they do there and nothing else"
    rows = [(1, long, "a"), (1, "quite another text that has nothing to do with the first one at all", "b"), (2, long + " x", "c"), (None, long, "d"), (3, None, "e"), (3, "", "f"), (4, "alone", "g"), (4, "alone", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.kept for r in got) == ["a", "b", "e", "f", "g"]


def test_quality_stage_counts_all_trusted_texts(spark, tmp_path, monkeypatch):
    """4,100 labelled documents, more than the model was once trained on."""
    counted = []

    class Model(quality.Model):
        def __init__(self, texts, scratch):
            counted.append(texts.count())
            super().__init__(texts, scratch)

    monkeypatch.setattr(quality, "Model", Model)
    docs = spark.range(4_200).selectExpr("id AS doc_id", "concat('Page ', id, ' is in order.') AS text", "'en' AS lang")
    spark.range(4_100).selectExpr("id AS doc_id", "1 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() > 4_000
    assert counted == [4_100]
