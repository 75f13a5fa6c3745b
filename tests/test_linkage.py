import random

import pytest
from pyspark.sql import functions as F

from genolith.operators import enrich, joins
from genolith.plans import reports as rp


def ld(x, y, mask=None):
    """(r squared, absolute D') in plain Python; None where a side has one form only."""
    if any(set(v) - set("01") or not v for v in (x, y)) or len(x) != len(y):
        return None
    rows = [(a, b) for i, (a, b) in enumerate(zip(x, y)) if mask is None or mask[i] == "1"]
    n = len(rows)
    if not n:
        return None
    pa, pb, pab = (sum(f(a, b) for a, b in rows) / n for f in (lambda a, b: a == "1", lambda a, b: b == "1", lambda a, b: a == b == "1"))
    if pa in (0, 1) or pb in (0, 1):
        return None
    d = pab - pa * pb
    top = min(pa * (1 - pb), (1 - pa) * pb) if d >= 0 else min(pa * pb, (1 - pa) * (1 - pb))
    return d * d / (pa * (1 - pa) * pb * (1 - pb)), abs(d / top)


def means(values):
    values = [v for v in values if v is not None]
    return (None, None) if not values else tuple(sum(v[i] for v in values) / len(values) for i in (0, 1))


@pytest.fixture(scope="module")
def snps():
    r = random.Random(3)
    out = []
    for i in range(260):
        bits = "unknown" if r.random() < 0.1 else "".join(r.choice("01") for _ in range(r.choice([70, 70, 70, 3])))
        out.append((i, r.choice([1, 1, 1, 2]), r.randrange(1, 3000), r.choice([10, 11, 12, None]), bits))
    return [*out, (900, 3, 5, 10, "0101"), (901, 1, 100, 10, "01" * 35), (902, 1, 100, 10, "01" * 35)]


def frame(spark, snps):
    return spark.createDataFrame(snps, "snp_id long, align_id long, snp_pos int, isw_id long, snp_occured string").repartition(3)


def around(snps, s, near=100):
    own = [x for x in snps if x[1] == s[1] and abs(x[2] - s[2]) <= near]
    return [(x, y) for i, x in enumerate(own) for y in own[i + 1 :]], len(own)


def same(got, want):
    return got is None and want is None or got == pytest.approx(want)


def test_packed_bits(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("01") for _ in range(n)), "".join(r.choice("01") for _ in range(n)), "".join(r.choice("01") for _ in range(n))) for n in (1, 2, 8, 61, 62, 63, 124, 125, 300) for _ in range(6)] + [("01", "011", "01"), ("unknown", "01", "01"), ("", "01", "11"), (None, "01", "11"), ("0101", "0011", "0000")]
    df = spark.createDataFrame(rows, "a string, b string, m string")
    a, b, m = (rp.pack_bits(F.col(c)) for c in "abm")
    plain, masked, other = rp.linkage_packed(a, b), rp.linkage_packed(a, b, m), rp.linkage_packed(a, b, rp.complement_bits(m))
    for x in df.select("a", "b", "m", *[v.alias(f"{n}{i}") for n, pair in (("p", plain), ("m", masked), ("o", other)) for i, v in enumerate(pair)]).collect():
        flipped = "".join("10"[int(c)] for c in x.m)
        for name, mask in (("p", None), ("m", x.m), ("o", flipped)):
            want = ld(x.a or "", x.b, mask)
            r_, d = x[f"{name}0"], x[f"{name}1"]
            assert (r_ is None) == (want is None)
            if want:
                assert (r_ * r_, abs(d)) == (pytest.approx(want[0]), pytest.approx(want[1]))


def test_means_of_neighbours(spark, snps):
    got = {x.snp_id: x for x in enrich.neighbour_ld(frame(spark, snps)).collect()}
    for s in snps:
        pairs, n = around(snps, s)
        if n == 1:
            assert s[0] not in got
            continue
        want = means(ld(x[4], y[4]) for x, y in pairs)
        x = got[s[0]]
        assert x.near_snp_number == n and same(x.r2_s, want[0]) and same(x.dprime_abs_s, want[1])


def test_means_within_groups_of_an_indel(spark, snps):
    r = random.Random(9)
    forms = {70: "".join(r.choice("01") for _ in range(70)), 71: "unknown", 72: "1" * 70}
    indels = spark.createDataFrame(list(forms.items()), "indel_id long, indel_occured string")
    nearest = {10: 70, 11: 72, 12: 71}
    isw = spark.createDataFrame(list(nearest.items()), "isw_id long, isw_indel_id long")
    got = {x.snp_id: x for x in enrich.group_ld(frame(spark, snps), isw, indels).collect()}
    seen = 0
    for s in snps:
        pairs, n = around(snps, s)
        mask = forms.get(nearest.get(s[3]), "unknown")
        if mask == "unknown" or n == 1:
            assert s[0] not in got
            continue
        x = got[s[0]]
        both = [(a[4], b[4]) for a, b in pairs]
        inside, outside = (means(ld(a, b, m) if len(a) == len(b) == len(m) else None for a, b in both) for m in (mask, "".join("10"[int(c)] for c in mask)))
        assert same(x.r2_i, inside[0]) and same(x.dprime_abs_i, inside[1]) and same(x.r2_ni, outside[0]) and same(x.dprime_abs_ni, outside[1])
        seen += x.r2_i is not None
    assert seen > 20


def test_rows_are_in_proportion_to_pairs(spark):
    """Many rows that ask about the same pairs add a row each, not one for each pair."""
    pairs = spark.range(2000).selectExpr("1 AS k", "CAST(id % 50 AS int) AS low", "CAST(50 + id % 40 AS int) AS high", "CAST(id AS double) AS v")
    asking = spark.range(3000).selectExpr("1 AS k", "id", "CAST(id % 100 AS int) AS pos")
    df = joins.means_around(pairs, asking, asking, ["k"], "id", "pos", 100, ["v"])
    assert df.where("abs(v - 999.5) > 1e-6 OR n <> 3000").count() == 0 and df.count() == 3000
