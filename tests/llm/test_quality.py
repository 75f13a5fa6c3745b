import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from genolith.llm import quality
from genolith.llm.common import Scratch


def brute_model(texts):
    """Probability function of an interpolated modified Kneser-Ney 4-gram model, by dictionaries."""
    table = quality.byte_classes()
    grams = Counter()
    for t in texts:
        codes = [1, 1, 1] + [int(table[b]) for b in t.encode()]
        grams.update(tuple(codes[i - 3 : i + 1]) for i in range(3, len(codes)))
    orders = {4: grams}
    for n in (3, 2, 1):
        orders[n] = Counter(g[1:] for g in orders[n + 1])
    stats = {}
    for n, c in orders.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0.5
        d = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        total, taken = defaultdict(float), defaultdict(float)
        d = [max(0.05, min(x, top)) for x, top in zip(d, (0.95, 1.95, 2.95))]
        for g, x in c.items():
            total[g[:-1]] += x
            taken[g[:-1]] += d[min(x, 3) - 1]
        stats[n] = (c, d, total, taken)

    def p(gram):
        if not gram:
            return 1 / quality.CLASSES
        c, d, total, taken = stats[len(gram)]
        h, lower = gram[:-1], p(gram[1:])
        if not total[h]:
            return lower
        x = c[gram]
        return ((x - d[min(x, 3) - 1]) if x else 0) / total[h] + taken[h] / total[h] * lower

    return p


def test_perplexity_against_brute_force(spark):
    texts = ["The cat sat on the mat. The dog sat too, again and again.", "Ça va? 12 €, and the rest of the the the", "x"]
    p, table = brute_model(texts), quality.byte_classes()
    asked = [*texts, "A cat, 99 dogs and ÖÖ~~", "", None, "zzzz", "x"]
    model = quality.Model(spark.createDataFrame([(t,) for t in texts], "text string"), Scratch(spark, "t"))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)] + [(1, texts[1])], "k long, text string")
    got = {r.k: r for r in model.log_sums(quality.gram_counts(docs), "k").collect()}
    assert {k: r.times for k, r in got.items()} == {i: 2 if i == 1 else 1 for i in range(len(asked))}
    for i, t in enumerate(asked):
        codes = [1, 1, 1] + [int(table[b]) for b in (t or "").encode()]
        n = len(codes) - 3
        assert got[i].nll == (pytest.approx(-sum(math.log(p(tuple(codes[j - 3 : j + 1]))) for j in range(3, len(codes))) / n, abs=1e-9) if n else None)


def test_probabilities_sum_to_one(spark):
    model = quality.Model(spark.createDataFrame([("abc abd abe. The end of it all.",)], "text string"), Scratch(spark, "t"))
    assert model.seen[2].selectExpr("g div 64 AS h", "exp(p) AS p").groupBy("h").sum("p").where("abs(`sum(p)` - 1) > 1e-9").count() == 0


def test_grams_do_not_cross_texts():
    texts = pa.array(["ab", None, "", "abcde", "a"])
    index, at = quality.grams(texts)
    for i, t in enumerate(texts.to_pylist()):
        alone, _ = quality.grams(pa.array([t], pa.string()))
        assert index[at[i] : at[i + 1]].tolist() == alone.tolist()


def test_edges_and_separation(spark):
    clean = [f"The reader of this page {i} finds that the words are in order, and that sentences end. It is so." for i in range(120)]
    junk = ["### $$$ %%% &&& *** " * 6 + str(i) for i in range(12)]
    rows = [(i, "en", t) for i, t in enumerate(clean + junk)] + [(900, None, "short"), (901, "en", None), (902, "en", ""), (903, "zz", "The reader " * 20_000), (5, "en", clean[5])]
    extra = "kept string, nll string, threshold string, n_bytes int, limit string, floor string, h1 string, x string"
    docs = spark.createDataFrame([(*r, "mine", "a", "b", -5, "c", "d", "e", "f") for r in rows], f"doc_id long, lang string, text string, {extra}")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1), (3, 1), (125, 0)], "doc_id long, quality int")
    got = quality.score(docs.select("doc_id", "lang", "text"), labels, Scratch(spark, "t")).collect()
    assert sum(r.times for r in got) == len(rows)
    for r in got:
        if r.doc_id < 120:
            assert r.kept
        if 120 <= r.doc_id < 132 or r.doc_id in (901, 902):
            assert not r.kept
    kept = quality.filter_quality(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(r.doc_id for r in found) == sorted(r.doc_id for r in got if r.kept for _ in range(r.times))
    assert {tuple(r)[3:] for r in found} == {("mine", "a", "b", -5, "c", "d", "e", "f")}
    assert quality.score(docs.limit(0).select("doc_id", "lang", "text"), labels, Scratch(spark, "t")).count() == 0
    uniform = quality.Model(docs.limit(0).select("text"), Scratch(spark, "t")).log_sums(quality.gram_counts(docs.where("doc_id = 900").select("doc_id", "text")), "doc_id").first()
    assert uniform.nll == pytest.approx(math.log(quality.CLASSES))


def test_all_trusted_texts_are_counted(spark):
    """4,300 labelled texts, more than the model was once trained on, by a broadcast of their ids and by a shuffle."""
    texts = [f"page {i} of {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(65 + i // 676)}" for i in range(4_500)]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)] + [(None, "en", "zq"), (4, "en", "again")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(4_500)] + [(4, 1), (4, 1), (None, 1), (9_999, 1), (250, None)], "doc_id long, quality int")
    good = sorted([*texts[200:], texts[4], "again"])
    for most in (quality.BROADCAST_ROWS, 10):
        assert sorted(r.text for r in quality.trusted_rows(docs, labels, most).collect()) == good
    p, table = brute_model(good), quality.byte_classes()
    got = {r.doc_id: r.nll for r in quality.score(docs, labels, Scratch(spark, "t")).where("doc_id % 450 = 0").collect()}
    assert len(got) == 10
    for i, nll in got.items():
        codes = [1, 1, 1] + [int(table[b]) for b in texts[i].encode()]
        assert nll == pytest.approx(-sum(math.log(p(tuple(codes[j - 3 : j + 1]))) for j in range(3, len(codes))) / (len(codes) - 3), abs=1e-9)


def test_held_out_accuracy(spark):
    """On labels that the model was not trained on; texts of one repeated word, as improbably likely as they are, go too."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    docs = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame([(-1, "en", "the " * 5_000), (-2, "de", "der " * 5_000)], "doc_id long, lang string, text string"))
    scored = quality.score(docs, labels.where("pmod(xxhash64(doc_id), 2) = 1"), Scratch(spark, "t"))
    rows = scored.join(held, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) > 0.89
    assert not any(r.kept for r in scored.where("doc_id < 0").collect())
