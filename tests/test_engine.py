import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.functions import genetics as g
from genolith.functions import intervals as iv
from genolith.operators import aggregates as agg
from genolith.operators import buckets as bk
from genolith.operators import enrich, ingest, joins
from genolith.plans import reports as rp
from genolith.plans.sheets import sheets
from genolith.plans.steps import Run, selected
from genolith.sources import readers, sinks

F1 = ">S288c.I(+):101-118\nACGTACG--TACGTACGTAC\n>RM11.I(+):1-19\nACGAACGTTTACG-ACGTAC\n"


@pytest.fixture(scope="module")
def toy(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fas")
    (folder / "a.fas").write_text(F1 + "\n>S288c.II(+):1-3\nACG\n>RM11.II(+):1-3\nACG\n\n>bad\nAC\n>worse\nACG\n")
    blocks = readers.valid_alignments(readers.blocked_fasta(spark, str(folder), 10))
    rejected = readers.rejected_alignments(readers.blocked_fasta(spark, str(folder)), True).collect()
    assert sorted((r.names, r.lengths) for r in rejected) == [(["S288c", "RM11"], [3, 3]), (["S288c", "RM11"], [20, 20]), (["bad", "worse"], [2, 3])]
    return ingest.analyzed(blocks).cache()


def test_toy_alignment(toy):
    a = ingest.align_table(toy).collect()
    assert len(a) == 1
    a = a[0]
    assert (a.align_length, a.align_comparables, a.align_indels, a.align_differences, a.align_identities) == (20, 17, 2, 1, 16)
    assert a.align_pi == pytest.approx(1 / 17) and a.align_comparable_runlist == "1-7,10-13,15-20" and a.align_indel_runlist == "8-9,14"
    s = {r.seq_role: r for r in ingest.sequence_table(toy).collect()}
    assert (s["T"].seq_runlist, s["T"].seq_length, s["T"].seq_gc, s["T"].chr_start) == ("1-7,10-20", 18, 0.5, 101)
    assert (s["Q"].seq_runlist, s["Q"].seq_length) == ("1-13,15-20", 19)
    i = sorted(ingest.indel_table(toy).collect(), key=lambda r: r.indel_start)
    assert [(r.indel_start, r.indel_end, r.left_extand, r.right_extand, r.indel_type) for r in i] == [(8, 9, 7, 4, "I"), (14, 14, 4, 6, "D")]
    assert i[1].prev_indel_id == i[0].indel_id and i[0].prev_indel_id == 0
    p = ingest.snp_table(toy).collect()
    assert [(r.snp_pos, r.snp_target_base, r.snp_query_base, r.snp_mutant_to) for r in p] == [(4, "T", "A", "T->A")]
    slip = enrich.indel_slippage(ingest.indel_table(toy), ingest.sequence_table(toy)).collect()
    assert [r.indel_slippage for r in slip] == [0, 0]


def test_chromosome_coordinates(toy):
    t = enrich.chr_positions(ingest.sequence_table(toy))
    at = [1, 7, 8, 9, 10, 14, 20]
    cols = [enrich.align_to_chr(F.col("spans"), F.lit(i), F.col("chr_start"), F.col("chr_end"), F.col("chr_strand")) for i in at]
    assert list(t.select(*[c.alias(str(i)) for i, c in zip(at, cols)]).first()) == [101, 107, 107, 107, 108, 112, 118]
    back = enrich.chr_to_align(F.col("spans"), F.lit(108), F.col("chr_start"), F.col("chr_end"), F.col("chr_strand"))
    assert t.select(back.alias("x")).first().x == 10


def test_interval_algebra_against_sets(spark):
    r = random.Random(3)
    sets = [(sorted(r.sample(range(1, 40), r.randrange(0, 20))), sorted(r.sample(range(1, 40), r.randrange(0, 20)))) for _ in range(60)]

    def text(s):
        return ",".join(f"{a}-{b}" if a != b else str(a) for a, b in g.runs(np.isin(np.arange(1, 41), s))) or "-"

    df = spark.createDataFrame([(i, text(a), text(b)) for i, (a, b) in enumerate(sets)], "i int, a string, b string")
    a, b = iv.parse(F.col("a")), iv.parse(F.col("b"))
    df = df.select("i", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = {"u": iv.to_runlist(iv.union(a, b)), "n": iv.to_runlist(iv.intersect(a, b)), "d": iv.to_runlist(iv.diff(a, b)), "c": iv.to_runlist(iv.complement(a, F.lit(1), F.lit(40))), "s": iv.size(a), "h": iv.contains(a, F.lit(7)), "x": iv.index_of(a, F.lit(7)), "t": iv.at(a, F.lit(3)), "r": iv.to_runlist(iv.slice_ranks(a, F.lit(2), F.lit(4))), "f": iv.to_runlist(iv.fill(a, 2))}
    for row in df.select("i", *[c.alias(k) for k, c in ops.items()]).collect():
        x, y = sets[row.i]
        assert row.u == text(sorted({*x, *y})) and row.n == text(sorted({*x} & {*y})) and row.d == text(sorted({*x} - {*y}))
        assert row.c == text([v for v in range(1, 41) if v not in x]) and row.s == len(x) and row.h == (7 in x)
        assert row.x == (x.index(7) + 1 if 7 in x else None) and row.t == (x[2] if len(x) > 2 else None)
        assert row.r == (text(x[1:4]) if len(x) >= 4 else "-")
        gaps = [v for p, q in zip(x, x[1:]) if q - p - 1 <= 2 for v in range(p + 1, q)]
        assert row.f == text(sorted({*x, *gaps}))


def test_outgroup_polarises():
    m = g.matrix(["AC--GT", "ACTTGT", "ACTTGA", "ACTTGT"])
    indel = g.call_indels(m[:3], m[3])[0]
    assert (indel["type"], indel["occured"], indel["freq"]) == ("D", "100", 1)
    snp = g.call_snps(m[:3], m[3])[0]
    assert (snp["pos"], snp["occured"], snp["mutant_to"]) == (6, "001", "T->A")
    m = g.matrix(["A-C", "ATC", "AGC"])
    assert (g.call_indels(m)[0]["type"], g.call_indels(m)[0]["occured"]) == ("C", "unknown")


def test_windows_of_intervals():
    assert [w["type"] for w in g.interval_windows(5, 150)] == ["S"] and g.interval_windows(5, 4) == []
    for length in (200, 350, 999, 1050):
        w = g.interval_windows(1, length)
        covered = sorted(x for v in w for x in range(v["start"], v["end"] + 1))
        assert covered == list(range(1, length + 1))
        assert all(v["distance"] <= (v["density"] + 1) / 2 for v in w)
    for style in ("edge", "edge_only", "center", "center_intact"):
        assert all(1 <= w["start"] <= w["end"] <= 5000 for w in g.feature_windows(2000, 2600, 1, 5000, style))


def test_gc_wave_and_segments(spark):
    r = random.Random(1)
    block = lambda gc, n: "".join(r.choice("GC" if r.random() < gc else "AT") for _ in range(n))
    seq = "".join(block(0.7 if i % 2 else 0.3, 1000) for i in range(10))
    flags = [w["flag"] for w in g.gc_wave(np.frombuffer(seq.encode(), np.uint8), 100, 100, 500, 0.1) if w["flag"]]
    assert len(flags) > 3 and all(a != b for a, b in zip(flags, flags[1:]))
    aligns = spark.createDataFrame([(1, f"1-{len(seq)}")], "align_id long, align_comparable_runlist string")
    sequences = spark.createDataFrame([(1, "T", 0, seq), (1, "Q", 1, seq)], "align_id long, seq_role string, seq_position int, seq_seq string")
    segments = enrich.segment_table(aligns, sequences).groupBy("segment_type").count().collect()
    assert {x.segment_type: x["count"] for x in segments} == {"1": 2, "2": 10, "3": 20}
    extremes = enrich.extreme_table(aligns, sequences)
    gsw = enrich.gsw_table(extremes).collect()
    ends = extremes.orderBy("rank_start").collect()
    assert ends[0].extreme_left_wave_length == ends[0].rank_start + 49 and ends[-1].extreme_right_wave_length == len(seq) - ends[-1].rank_start - 49
    wave = g.gc_wave(np.frombuffer(seq.encode(), np.uint8), 100, 100, 500, 0.1)
    assert ends[0].extreme_left_amplitude == pytest.approx(abs(ends[0].extreme_gc - wave[0]["gc"])) and ends[-1].extreme_right_amplitude == pytest.approx(abs(ends[-1].extreme_gc - wave[-1]["gc"]))
    assert all(a.extreme_right_wave_length == b.extreme_left_wave_length and a.extreme_right_amplitude == b.extreme_left_amplitude for a, b in zip(ends, ends[1:]))
    assert {x.gsw_type for x in gsw} == {"A", "D", "T", "C"} and all(x.gsw_distance + x.gsw_distance_crest >= 1 for x in gsw)
    assert all(x.gsw_crest_gc > x.gsw_trough_gc for x in gsw)


def test_fold_and_pieces(spark):
    h = spark.createDataFrame([(-1, 5), (0, 5), (1, 3), (2, 3), (3, 9), (4, 1)], "key int, n long")
    groups = lambda **k: [sorted(r.key for r in rows) for rows in _by_bucket(bk.fold(h, 6, (-1, 0), **k))]
    assert groups() == [[-1], [0], [1, 2], [3], [4]]
    assert groups(merge_last=True) == [[-1], [0], [1, 2], [3, 4]]
    rows = spark.createDataFrame([(i, float(i % 7 + 1)) for i in range(300)], "i int, w double")
    got = bk.pieces(rows, [F.col("i")], F.col("w"), 50.0, blocks=5).collect()
    run = 0.0
    for r in sorted(got, key=lambda r: r.i):
        assert r.piece == math.floor(run / 50) + 1
        run += r.w
    assert bk.frequency_levels(4) == [("1of4", 1, 1), ("2of4", 2, 2), ("3of4", 3, 3)]
    assert [x[1:] for x in bk.frequency_levels(9)] == [(1, 3), (4, 6), (7, 8)]
    assert [x[1:] for x in bk.frequency_levels(9, 4)] == [(1, 2), (3, 3), (4, 4)] and bk.frequency_levels(9, singly=4) == [("1of9", 1, 1), ("2of9", 2, 2), ("3of9", 3, 3)]


def test_running_sums_beyond_a_sample(spark):
    """More rows than Spark samples for the limits of ranges: sums of ranges and rows must still agree."""
    df = spark.range(40_000).selectExpr("id", "pmod(xxhash64(id), 100000) AS k", "pmod(hash(id), 9) + 1 AS w", "repeat('x', 40) AS other")
    got = {r.id: r.before for r in bk.running_before(df, [F.col("k"), F.col("id")], F.col("w"), "before", blocks=16).collect()}
    run = 0
    for r in sorted(df.select("k", "id", "w").collect()):
        assert got[r.id] == run
        run += r.w
    top = {r.key for r in bk.top_portion(df, F.col("k"), F.col("w"), 0.1).collect()}
    weights, seen, want = {}, 0, set()
    for r in df.select("k", "w").collect():
        weights[r.k] = weights.get(r.k, 0) + r.w
    for k in sorted(weights, reverse=True):
        if seen < run * 0.1:
            want.add(k)
        seen += weights[k]
    assert top == want
    assert bk.running_before(df.where("false"), [F.col("k")], F.col("w"), "before").collect() == []


def test_nearest_of_a_hot_key(spark):
    r = random.Random(11)
    keys = ["hot"] * 6 + ["b", None]
    points = [(i, r.choice(keys), r.choice([r.randrange(40_000), None]) if i % 50 == 0 else r.randrange(40_000)) for i in range(6_000)]
    others = [(i, r.choice(keys), None if i % 40 == 0 else r.randrange(40_000)) for i in range(900)] + [(2_000, "hot", 7), (1_999, "hot", 7)]
    p, o = spark.createDataFrame(points, "id int, k string, at int"), spark.createDataFrame(others, "oid int, k string, o_at int")
    got = {x.id: (x.nearest_id, x.nearest_distance) for x in joins.nearest(p, o.withColumnRenamed("o_at", "pos"), ["k"], "at", "pos", "oid").collect()}
    assert len(got) == len(points)
    for i, k, at in points:
        d = [(abs(x - at), j) for j, l, x in others if l == k and x is not None] if at is not None else []
        assert got[i] == (min(d)[::-1] if d else (None, None))
    none = joins.nearest(p, o.where("false"), ["k"], "at", "o_at", "oid")
    assert none.where("nearest_id IS NULL").count() == len(points)


def test_quantile_levels(spark):
    r = random.Random(5)
    for values, parts in (([r.random() for _ in range(501)], 4), ([r.randrange(9) / 8 for _ in range(200)], 4), ([0.25] * 30, 3), ([1.0, 2.0], 5)):
        got = sorted(map(tuple, bk.quantile_levels(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), F.col("v"), parts).collect()))
        q = np.quantile(values, [i / parts for i in range(parts + 1)])
        assert [x[0] for x in got] == list(range(1, parts + 1))
        assert [x[1] for x in got] == pytest.approx(list(q[:-1])) and [x[2] for x in got] == pytest.approx(list(q[1:]))
    assert bk.quantile_levels(spark.createDataFrame([], "v double"), F.col("v")).count() == 0


def _by_bucket(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.bucket, []).append(r)
    return [out[k] for k in sorted(out)]


def test_interval_join_edges(spark):
    points = spark.createDataFrame([(1, 10), (1, 20), (1, 25), (1, 99), (2, 10)], "k int, p int")
    spans = spark.createDataFrame([(1, "a", 10, 20), (1, "b", 21, 24), (1, "c", 20, 30)], "k int, id string, s int, e int")
    got = joins.binned_interval_join(points, spans, ["k"], "p", "s", "e", 7, "left", "id").collect()
    assert sorted((r.k, r.p, r.id) for r in got if r.id) == [(1, 10, "a"), (1, 20, "a"), (1, 25, "c")] and len(got) == 5


def test_linkage(spark):
    df = spark.createDataFrame([("1100", "1100"), ("1100", "0011"), ("1100", "1010"), ("1111", "1100"), ("unknown", "1100")], "a string, b string")
    r, d = rp.linkage(F.col("a"), F.col("b"))
    got = [(x.r, x.d) for x in df.select(r.alias("r"), d.alias("d")).collect()]
    assert got[0] == (1.0, 1.0) and got[1] == (-1.0, -1.0) and got[2][0] == 0 and got[3] == got[4] == (None, None)
    snps = spark.createDataFrame([(1, i, p, o) for i, (p, o) in enumerate([(10, "1100"), (60, "1100"), (90, "1010"), (900, "1100")])], "align_id long, snp_id long, snp_pos int, snp_occured string")
    near = {x.snp_id: x for x in enrich.neighbour_ld(snps).collect()}
    assert near[0].near_snp_number == 3 and near[0].r2_s == pytest.approx(1 / 3) and 3 not in near


def test_codons_and_statistics(spark):
    assert g.CODONS["ATG"] == "M" and g.CODONS["TAA"] == "*" and len(g.CODONS) == 64
    assert g.codon_rates(["TTT", "TTC"], 2) == (1, 0, 0) and g.codon_rates(["TTT", "TTA"], 2) == (0, 1, 0) and g.codon_rates(["TAA", "TTA"], 1) == (0, 0, 1) and g.codon_rates(["T-A", "TTA"], 1) is None
    assert agg.student_upper_tail(2.0, 10) == pytest.approx(0.036694, abs=1e-5) and agg.student_upper_tail(0.0, 5) == pytest.approx(0.5)
    assert agg.f_upper_tail(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    sequences = spark.createDataFrame([(1, "T", 0, "CCATGTTTCC"), (1, "Q", 1, "CCATGTTCCC")], "align_id long, seq_role string, seq_position int, seq_seq string")
    exons = spark.createDataFrame([(1, 7, 3, 8, "+", 0)], "align_id long, exon_id long, exon_start int, exon_end int, exon_strand string, exon_frame int")
    snps = spark.createDataFrame([(1, 5, 8)], "align_id long, snp_id long, snp_pos int")
    r = enrich.snp_codons(snps, exons, sequences).first()
    assert (r.exon_id, r.snp_codon_pos, r.snp_codons, r.snp_syn, r.snp_nsy) == (7, 2, "TTT|TTC", 1.0, 0.0)


def test_null_and_zero(spark):
    df = spark.createDataFrame([(None, 0.0), (1.0, 0.0)], "a double, b double")
    r = df.agg(agg.ratio_of_means(F.col("a"), F.col("b")).alias("x"), agg.mean_of_ratios(F.col("a"), F.col("b")).alias("y"), agg.weighted_mean(F.col("a"), F.col("b")).alias("z")).first()
    assert tuple(r) == (None, None, None)


def test_sources_and_sinks(spark, tmp_path):
    a = readers.annotation(spark, "---\ncds:\n  I: 1-10,20\nrepeat:\n  II: 5-7\n").collect()
    assert sorted(map(tuple, a)) == [("I", "cds", 1, 10), ("I", "cds", 20, 20), ("II", "repeat", 5, 7)]
    quoted = readers.annotation(spark, "cds:\n  'I': 1-10  # first\n\nother:\n  I: 5\nrepeat:\n  II: '5-7,9'\n").collect()
    assert sorted(map(tuple, quoted)) == [("I", "cds", 1, 10), ("II", "repeat", 5, 7), ("II", "repeat", 9, 9)]
    for wrong in ("cds: {I: 1-10}\nrepeat:\n  I: 1\n", "cds:\n  I:\n    x: 1-2\nrepeat:\n  I: 1\n", "cds:\n  - I\nrepeat:\n  I: 1\n", "cds:\n  I: 1\n"):
        with pytest.raises(ValueError):
            readers.annotation(spark, wrong)
    (tmp_path / "p.txt").write_text("I:10-20\nno position\nS288c.II(+):7\nIII:1-5,9,12-13\n")
    assert sorted(map(tuple, readers.positions(spark, [(str(tmp_path / "p.txt"), "t", "k")]).collect())) == [("t", "k", "I", 10, 20), ("t", "k", "II", 7, 7), ("t", "k", "III", 1, 5), ("t", "k", "III", 9, 9), ("t", "k", "III", 12, 13)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "chr1.fa").write_text(">x\n" + "ACGT" * 30 + "N" * 5 + "ACGT" * 30 + "N" * 60 + "ACGT" * 5 + "\n")
    got = readers.valid_regions(readers.genome_fasta(spark, str(tmp_path / "g")), min_length=100, truncate=100).collect()
    assert [(r.chr_name, r.start, r.end) for r in got] == [("chr1", 1, 100), ("chr1", 101, 245)]
    (tmp_path / "c.csv").write_text("common_name,taxon_id,chr,length,assembly\nS288c,559292,I,230218,\n")
    assert readers.chromosomes(spark, str(tmp_path / "c.csv")).first().chr_length == 230218
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for style in ("csv", "tsv", "neat", "table", "box"):
        sinks.write_query(df, str(tmp_path / style), style)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "box")).collect()) == ["| 1 | x    |", "| 2 | NULL |"]
    change = spark.createDataFrame([(2, "y", 5)], "a int, b string, c int")
    assert sorted(map(tuple, sinks.updated(df, change, "a").collect())) == [(1, "x", None), (2, "y", 5)]
    assert sinks.has_values(df, "b") and not sinks.has_values(df.where("a = 2"), "b") and not sinks.has_values(df, "c")
    assert readers.run_sql(spark, "SELECT count(*) AS n FROM toy; DROP TABLE x", {"toy": df})[0].first().n == 2
    features = spark.createDataFrame([("I", "cds", 5, 14), ("I", "repeat", 100, 200)], "chr_name string, kind string, start int, end int")
    windows = spark.createDataFrame([(1, "I", 1, 10), (2, "I", 150, 249), (3, "II", 1, 9)], "id long, chr_name string, ws int, we int")
    assert sorted(map(tuple, enrich.feature_portions(windows, features, "id", "ws", "we", width=20).collect())) == [(1, 0.6, 0.0), (2, 0.0, 0.51), (3, 0.0, 0.0)]


def test_run_and_stream(spark, tmp_path):
    r = random.Random(9)
    seq = "".join(r.choice("ACGT") for _ in range(3000))
    other = list(seq)
    for at in (300, 900, 1700, 2400):
        other[at : at + 2] = "--"
    for at in range(50, 3000, 97):
        other[at] = "A" if other[at] != "-" else "-"
    (tmp_path / "in").mkdir()
    text = f">T.I(+):1-3000\n{seq}\n>Q.I(+):1-2992\n{''.join(other)}\n>O.I(+):1-3000\n{seq}\n"
    (tmp_path / "in" / "b.fas").write_text(text)
    assert selected("1-3,40", [2, 3, 5, 40]) == [2, 3, 40] and selected("gc", [5, 10, 20, 41, 43]) == [5, 10, 41] and selected("2 21", [2, 5, 21]) == [2, 21]
    exons = spark.createDataFrame([("I", 1, 1500, 1, "+", 0)], "chr_name string, start int, end int, exon_id long, exon_strand string, exon_frame int")
    note = "cds:\n  I: 1-1500\nrepeat:\n  I: 2001-2100\n"
    run = Run(spark, str(tmp_path / "out"), Config(min_length=100, combine_threshold=3), outgroup=True, annotation=note, exons=exons)
    assert run.run(str(tmp_path / "in"), "all") == [2, 5, 10, 20, 21, 30, 31, 32, 33, 40, 41, 42, 44]
    assert run.tables["align"].first().align_coding == pytest.approx(0.5) and run.tables["align"].first().align_repeats == pytest.approx(100 / 3000)
    assert all(s.snp_coding == float(s.snp_pos <= 1500) for s in run.tables["snp"].collect())
    assert all((s.snp_codons is not None) <= (s.snp_pos <= 1500) for s in run.tables["snp"].collect()) and run.tables["snp"].where("snp_syn IS NOT NULL").count() > 3
    names = {r: {p.name for p in (tmp_path / "out" / "report" / r).iterdir()} for r in ("common", "multi", "mvar")}
    assert {"basic", "process", "summary", "d1_pi_gc_cv", "d2_comb_coding", "group_density", "indel_length_100", "distance_tri_trv", "align_repeat", "snp_indel_ratio", "index"} <= names["common"]
    assert {"distance", "distance3", "distance_freq", "di_dn_ttest"} <= names["multi"] and {"indel_basic", "snp_list", "snp_codon_list", "strain_list"} <= names["mvar"]
    made = sheets(run.tables, names=["basic", "distance_snp", "group_distance"])
    assert made["basic"].first().snps_per_100 == pytest.approx(100 * run.tables["snp"].count() / made["basic"].first().comparables)
    assert made["distance_snp"].groupBy("distance").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    bands = {r.band: r["count"] for r in made["group_distance"].collect()}
    assert bands[5] == run.tables["isw"].where("isw_distance BETWEEN 3 AND 5").count() and 19 in bands
    isw = run.tables["isw"].collect()
    assert isw and all(w.isw_d_indel is not None for w in isw)
    assert all(s.isw_id is None or any(w.isw_id == s.isw_id and w.isw_start <= s.snp_pos <= w.isw_end for w in isw) for s in run.tables["snp"].collect())
    from genolith.streaming.alignments import stream_tables

    stream_tables(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "cp"), outgroup=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s" / "align")).count() == 1


def test_templates(spark):
    from genolith.plans.templates import TEMPLATES, build
    from genolith.schema import TABLES

    schema = dict(TABLES)
    schema["isw"] += ", isw_syn double, isw_nsy double, isw_stop double"
    schema["snp"] += ", snp_r double, snp_dprime double, " + ", ".join(f"snp_{c} double" for c in ("r2_s", "dprime_abs_s", "r2_i", "r2_ni", "dprime_abs_i", "dprime_abs_ni"))
    schema["gsw"] += ", gsw_bed_count double"
    empty = {n: spark.createDataFrame([], s) for n, s in schema.items()}
    assert len(TEMPLATES) == 26
    for name, t in TEMPLATES.items():
        assert build(empty, name).count() == (0 if t.key else 1), name
    isw = spark.createDataFrame([(i, 1, i % 3, 0.1 * i, 10 * i) for i in range(9)], "isw_id long, isw_indel_id long, isw_distance int, isw_pi double, isw_length int")
    indel = spark.createDataFrame([(1, 1, 0.0)], "indel_id long, align_id long, indel_slippage double")
    got = {r.key: r for r in build({"isw": isw}, "common-d1_combine").collect()}
    assert (got[2].COUNT, got[2].SUM_length) == (3, 150)
    assert build({"isw": isw, "indel": indel}, "common-d1_make_combine_slippage", where=["indel_slippage >= 1"]).count() == 0
    assert [r.key for r in build({"isw": isw}, "common-d1_combine", key="floor(isw_length / 40)", limit=2).collect()] == [0, 1]


def test_small_enrichers(spark):
    df = spark.createDataFrame([("1-10,15-20", ["3-4,18-18", "8-9"]), ("1-10", [])], "w string, g array<string>")
    gaps = F.transform("g", lambda x: iv.parse(x))
    assert [r.n for r in df.select(enrich.slice_indels(iv.parse(F.col("w")), gaps).alias("n")).collect()] == [3, 0]
    rows = spark.createDataFrame([(i, 2.0, 4.0) for i in range(50)], "i int, t double, u double")
    b = enrich.bootstrap_ratio(rows, "t", "u", 20).first()
    assert b.mean == pytest.approx(0.5) and b.p5 == pytest.approx(0.5) and b.stderr == pytest.approx(0.0, abs=1e-9)
    isw = spark.createDataFrame([(1, 7, 1, 100, 5)], "isw_id long, isw_indel_id long, align_id long, isw_length int, x int")
    indels = spark.createDataFrame([(7, "1100")], "indel_id long, indel_occured string")
    snps = spark.createDataFrame([(1, 1, 1, 10, "1000", 1.0), (2, 1, 1, 20, "1100", 0.0), (3, 1, 1, 30, "unknown", 0.0)], "snp_id long, isw_id long, align_id long, snp_pos int, snp_occured string, snp_cpg double")
    r = enrich.branch_snps(isw, indels, snps).first()
    assert (r.indel_id, r.with_indel, r.without_indel) == (7, 0.75, 0.0)
    ld = {x.snp_id: x for x in enrich.indel_snp_ld(snps, isw, indels).collect()}
    assert ld[2].snp_r == pytest.approx(1.0) and ld[1].snp_r == pytest.approx(1 / math.sqrt(3)) and ld[3].snp_r is None
    assert enrich.isw_cpg(isw, snps).first().isw_cpg_pi == pytest.approx(0.01)
    windows = spark.createDataFrame([(5, 1, 1, 25), (6, 1, 26, 40)], "segment_id long, align_id long, ws int, we int")
    w = enrich.window_ld(windows, snps, "segment_id", "ws", "we").collect()
    assert [(x.segment_id, x.r2_s) for x in w] == [(5, pytest.approx(1 / 3))]
    genes = spark.createDataFrame([("g", "I", 105, 130), ("h", "I", 10, 20)], "gene string, chr_name string, start int, end int")
    targets = spark.createDataFrame([(1, "1-7,10-20", "I", 101, 118, "+")], "align_id long, runlist string, chr_name string, chr_start int, chr_end int, chr_strand string").withColumn("spans", iv.parse(F.col("runlist")))
    c = enrich.clipped(genes, targets).collect()
    assert [(x.gene, x.align_start, x.align_end, x.is_full) for x in c] == [("g", 5, 20, 0)]
    t = spark.createDataFrame([(1, 11, 5), (1, 12, 9), (1, 10, 9)], "gene_id long, transcript_id long, length int")
    assert enrich.longest_transcripts(t).first().transcript_id == 10
    ofg = spark.createDataFrame([(1, 1, 500, 560, 1, 1000)], "ofg_id long, align_id long, rank_start int, rank_end int, low int, high int")
    got = enrich.ofg_windows(ofg).collect()
    assert {x.ofgsw_distance for x in got} == {0, 1, 2, 3, 4} and len(got) == 9
    coded = spark.createDataFrame([(1, 3, 1.0, 0.0, 0.0), (1, None, 9.0, 9.0, 9.0)], "isw_id long, exon_id long, snp_syn double, snp_nsy double, snp_stop double")
    assert tuple(enrich.summed_rates(coded, "isw_id", isw, "isw_length").first()) == (1, 0.01, 0.0, 0.0)


def pairwise_d(group, bases, outgroup):
    """The five means over pairs of sequences of one SNP, pair by pair."""
    one, two = ([i for i, g in enumerate(group) if g == bit] for bit in "10")
    derived = lambda i: bases[i] != outgroup
    mean = lambda xs: sum(xs) / len(xs) if xs else 0.0
    cross = [(i, j) for i in one for j in two]
    within = [[(x, y) for k, x in enumerate(g) for y in g[k + 1 :]] for g in (one, two)]
    single = lambda ps: mean([derived(i) != derived(j) for i, j in ps])
    return [
        mean([derived(i) and not derived(j) for i, j in cross]), mean([derived(j) and not derived(i) for i, j in cross]), single(within[0]), single(within[1]),
        mean([derived(i) and derived(j) and bases[i] != bases[j] for i, j in cross + within[0] + within[1]]),
    ]


def test_d_values_by_pairs(spark):
    import itertools

    windows = [(1, 1, 100), (2, 2, 50), (3, 3, 10), (4, 4, 10), (5, 1, 10)]
    indels = [(1, "1100"), (2, "1000"), (3, "unknown"), (4, "1111")]
    cases = ["".join(x) for x in itertools.product("ACT", repeat=4)]
    snps = [(w, "A", b) for w in (1, 2, 3, 4) for b in cases] + [(1, "", "TTTT"), (None, "A", "TTTT")]
    args = [spark.createDataFrame(r, s) for r, s in ((windows, "isw_id long, isw_indel_id long, isw_length int"), (indels, "indel_id long, indel_occured string"), (snps, "isw_id long, snp_outgroup_base string, snp_all_bases string"))]
    got = {r.isw_id: list(r)[1:] for r in enrich.d_values(*args).collect()}
    assert got[3] == got[4] == [None] * 15 and got[5] == [0.0] * 15
    for isw_id, group, length in ((1, "1100", 100), (2, "1000", 50)):
        want = [0.0] * 15
        for b in cases:
            sides = [{x for x, g in zip(b, group) if g == bit} for bit in "10"]
            fixed = [s for s, other in (sides, sides[::-1]) if len(s) == 1 and s != {"A"}]
            recurs = any(s <= other for s, other in (sides, sides[::-1]) if len(s) == 1 and s != {"A"})
            for kind, there in enumerate((True, not fixed, not fixed or recurs)):
                for k, x in enumerate(pairwise_d(group, b, "A")):
                    want[5 * kind + k] += x / length if there else 0
        assert got[isw_id] == pytest.approx(want)
    # the cases that the filters are about: a derived base fixed in one group and found in the other, and one fixed in neither
    terms = lambda b: spark.createDataFrame([("1100", b, "A")], "g string, b string, o string").select(enrich.d_terms(*map(F.col, "gbo")).alias("x")).first().x
    assert (terms("TTTA").second, terms("TTTA").third) == (False, True)
    assert (terms("TATA").second, terms("TATA").third) == (True, True)
    assert (terms("TTAA").second, terms("TTAA").third) == (False, False)
    assert terms("TTCA").complex > 0
