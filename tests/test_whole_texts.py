import random
from collections import Counter

from genolith.plans.queries import QUERIES


def test_kmers_of_whole_texts(spark, tmp_path):
    """Against all k-mers of texts of up to 60,000 letters."""
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh XYZ.9", k=n)) for n in (0, 2, 3, 399, 2_000, 60_000)] + [None, "a" * 500 + "g" * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    want = Counter()
    for t in texts:
        s = "".join(c for c in (t or "").lower().translate(letters) if c in "ACGT")
        for i in range(len(s) - 2):
            k = s[i : i + 3]
            want[",".join(sorted((k, k[::-1].translate(str.maketrans("ACGT", "TGCA")))))] += 1
    got = {x.kmer: x for x in QUERIES["kmer_canonical"](spark, str(tmp_path)).collect()}
    assert {k: x["count"] for k, x in got.items()} == dict(want)
    for k, x in got.items():
        assert x.gc == round(sum(c in "CG" for c in k[:3]) / 3, 6) and x.freq == round(want[k] / want.total(), 6)
