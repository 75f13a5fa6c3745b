import random

import pytest
from pyspark.sql import functions as F

from genolith.functions import genetics as g
from genolith.operators import annotate, enrich, joins
from genolith.operators.sequences import Store
from genolith.plans.sheets import sheets
from genolith.plans.steps import Run
from genolith.config import Config
from genolith.scratch import Scratch

DDL = "align_id long, seq_role string, seq_position int, seq_seq string, chr_name string, chr_start int, chr_end int, chr_strand string"


def gapped(r, n, share):
    out = []
    while len(out) < n:
        out += "-" * r.choice([1, 3, 9]) if r.random() < share else [r.choice("ACGT")]
    return "".join(out[:n])


@pytest.fixture(scope="module")
def study(spark):
    """Two alignments of chromosome I and one of II, the second on strand -; with each target's columns."""
    r = random.Random(2)
    rows, columns, at = [], {}, {1: ("I", 101, "+"), 2: ("I", 2001, "-"), 3: ("II", 1, "+")}
    for a, (chr_name, start, strand) in at.items():
        seqs = [gapped(r, 900, 0.05 if i == 0 else 0.03) for i in range(3)]
        columns[a] = [i + 1 for i, c in enumerate(seqs[0]) if c != "-"]
        end = start + len(columns[a]) - 1
        rows += [(a, "T" if i == 0 else "Q", i, s, chr_name, start, end, strand) for i, s in enumerate(seqs)]
    df = spark.createDataFrame(rows, DDL)
    return rows, columns, df, Store(df, size=50)


def position(rows, columns, a, column):
    _, _, _, _, _, start, end, strand = next(x for x in rows if x[0] == a and x[1] == "T")
    rank = sum(c <= column for c in columns[a])
    return end - rank + 1 if strand == "-" else start + rank - 1


def test_maps_between_columns_and_chromosomes(spark, study):
    rows, columns, df, store = study
    target = annotate.targets(df)
    asked = spark.createDataFrame([(1000 * a + c, a, c) for a in columns for c in range(1, 901, 7)], "ident long, align_id long, c int")
    for x in annotate.to_chromosome(asked, "ident", "c", store, target).collect():
        assert x.chr_position == position(rows, columns, x.ident // 1000, x.ident % 1000)
    features = spark.createDataFrame([("a", "I", 1, 5000), ("b", "I", 150, 160), ("c", "II", 10, 10), ("d", "III", 1, 9), ("e", "I", 9, 8)], "name string, chr_name string, start int, end int")
    got = {(x["name"], x.align_id): x for x in annotate.clipped(features, target, width=70).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), ("c", 3)} and got["a", 2].is_full == 0 and got["b", 1].is_full == 1
    assert (got["a", 1].rank_start, got["a", 1].rank_end) == (1, len(columns[1])) and (got["b", 1].rank_start, got["b", 1].rank_end) == (50, 60)


def test_compressed_store(spark, study):
    rows, columns, _, store = study
    for size in (7, 64):
        own = Store(study[2], size=size).compressed("target")
        asked = spark.createDataFrame([(1000 * a + s, a, s, s + 40) for a in columns for s in range(1, len(columns[a]) - 40, 13)], "ident long, align_id long, a int, b int")
        sums = {x.ident: x for x in own.stats(asked, "ident", "a", "b").collect()}
        for x in own.slices(asked, ["ident"], "a", "b").collect():
            a, s = divmod(x.ident, 1000)
            want = ["".join(row[3][c - 1] for c in columns[a][s - 1 : s + 40]) for row in rows if row[0] == a]
            assert x.slices == want and sums[x.ident].gap_runs == len(g.runs((g.matrix(want) == g.GAP).any(0)))


def test_windows_of_the_target(spark, study):
    rows, columns, _, store = study
    spans = [(1, 1, 10, 200), (2, 2, 1, 30), (3, 3, 400, 420), (4, 3, 5, 5), (5, 1, 1, 5000)]
    got = {x.window_id: x for x in annotate.target_windows(spark.createDataFrame(spans, "window_id long, align_id long, rank_start int, rank_end int"), "window_id", store).collect()}
    assert set(got) == {1, 2, 3, 4}
    for ident, a, start, end in spans[:4]:
        own = columns[a][start - 1 : end]
        m = g.matrix(["".join(row[3][c - 1] for c in own) for row in rows if row[0] == a])
        breaks = sum(y - x > 1 for x, y in zip(own, own[1:]))
        x, stats = got[ident], g.column_stats(m)
        assert (x.window_start, x.window_end, x.window_length) == (own[0], own[-1], len(own))
        assert (x.window_comparables, x.window_differences) == (stats["comparables"], stats["differences"]) and x.window_gc == pytest.approx(g.gc_ratio(m[0]))
        assert x.window_indel == breaks + max(len(g.runs((m == g.GAP).any(0))) - 1, 0)


def test_positions_and_windows_around_them(spark, study):
    rows, columns, df, store = study
    target = annotate.targets(df)
    p = spark.createDataFrame([("t", "k", "I", 300, 420), ("t", "k", "I", 300, 420), ("t", "m", "I", 2300, 2310), ("u", "k", "II", 5, 5), ("u", "k", "I", 1, 150), ("u", "k", "X", 1, 2), ("u", "k", "I", 9, 3)], "tag string, type string, chr_name string, start int, end int")
    ofg = annotate.place_positions(p, target, width=64)
    found = {(x.ofg_tag, x.align_id): (x.rank_start, x.rank_end) for x in ofg.collect()}
    assert found == {("t", 1): (200, 320), ("t", 2): (len(columns[2]) - 309, len(columns[2]) - 299), ("u", 3): (5, 5)} and ofg.count() == 3
    for style in ("edge", "edge_only", "center", "center_intact"):
        got = {}
        for x in annotate.feature_windows(ofg, store, style, size=20, most=6).collect():
            got.setdefault(x.ofg_id, set()).add((x.rank_start, x.rank_end, x.ofgsw_type, x.ofgsw_distance))
        for x in ofg.collect():
            want = {(w["start"], w["end"], w["type"], w["distance"]) for w in g.feature_windows(x.rank_start, x.rank_end, 1, len(columns[x.align_id]), style, 20, 6)}
            assert got.get(x.ofg_id, set()) == want
    with pytest.raises(ValueError):
        annotate.feature_windows(ofg, store, "none")


def test_union_of_spans(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "hot", "b", None]), a, a + r.choice([-1, 0, 3, 20, 400])) for a in (r.randrange(1, 60_000) for _ in range(6000))] + [("hot", 5, 30_000), ("b", None, 4), ("c", 7, 7), ("c", 8, 9), ("c", 11, 12)]
    df = spark.createDataFrame(rows, "k string, start int, end int").repartition(6)
    for partitions in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = sorted((x.k or "", x.start, x.end) for x in joins.span_union(df, ["k"], "start", "end", Scratch(spark, "t")).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        want = []
        for k, a, b in sorted((k or "", a, b) for k, a, b in rows if a is not None and a <= b):
            if want and want[-1][0] == k and a <= want[-1][2] + 1:
                want[-1] = (k, want[-1][1], max(want[-1][2], b))
            else:
                want.append((k, a, b))
        assert got == want


GENES = [("g1", "I", 140, 600, "+"), ("g2", "I", 50, 180, "-"), ("g3", "II", 30, 30, "+")]
EXONS = [
    ("g1", "t1", "e1", "I", 150, 249, "+", 0, 160, 249), ("g1", "t1", "e2", "I", 300, 419, "+", 1, 300, 389), ("g1", "t1", "e3", "I", 410, 450, "+", 0, None, None),
    ("g1", "t2", "x1", "I", 150, 200, "+", 0, 150, 200), ("g2", "t3", "e4", "I", 60, 170, "-", 0, 70, 160), ("g2", "t4", "e5", "I", 60, 170, "-", 0, 70, 160),
]
GENE_DDL = "gene_stable_id string, chr_name string, start int, end int, gene_strand string"
EXON_DDL = "gene_stable_id string, transcript_id string, exon_stable_id string, chr_name string, start int, end int, exon_strand string, exon_frame int, coding_start int, coding_end int"


def test_genes_and_exons(spark, study):
    rows, columns, df, store = study
    gene, exon = annotate.gene_tables(spark.createDataFrame(GENES, GENE_DDL), spark.createDataFrame(EXONS, EXON_DDL), annotate.targets(df), store, Scratch(spark, "t"))
    genes = {x.gene_stable_id: x for x in gene.collect()}
    exons = {x.exon_stable_id: x for x in exon.collect()}
    assert set(genes) == {"g1", "g2"} and set(exons) == {"e1", "e2", "e3", "e4"}  # of two transcripts of a length the smaller id
    assert (genes["g1"].gene_multitrans, genes["g1"].gene_multiexons, genes["g1"].gene_is_full, genes["g2"].gene_is_full) == (2, 3, 1, 0)
    assert [exons[e].exon_rank for e in ("e1", "e2", "e3")] == [1, 2, 3] and exons["e2"].prev_exon_id == exons["e1"].exon_id and exons["e1"].prev_exon_id == 0
    assert (exons["e1"].exon_is_full, exons["e4"].exon_is_full) == (1, 0) and exons["e3"].exon_tl_runlist is None

    def members(text):
        return {c for part in (text or "-").split(",") if part != "-" for a, _, b in [part.partition("-")] for c in range(int(a), int(b or a) + 1)}

    on = lambda a, b: {columns[1][p - 101] for p in range(max(a, 101), b + 1)}
    assert members(genes["g1"].gene_tc_runlist) == on(150, 249) | on(300, 450) and members(genes["g1"].gene_tl_runlist) == on(160, 249) | on(300, 389)
    assert (genes["g1"].gene_tc_size, genes["g1"].gene_tl_size) == (251, 180) and members(genes["g2"].gene_tl_runlist) == on(70, 160)
    assert members(exons["e2"].exon_tl_runlist) == on(300, 389)


def test_run_with_genes_and_positions(spark, tmp_path):
    r = random.Random(9)
    seq = [r.choice("ACGT") for _ in range(6000)]
    other, third = list(seq), list(seq)
    for at in range(250, 5700, 400):
        other[at : at + 2] = "--"
        third[at + 200 : at + 201] = "-"
    for at in range(20, 6000, 37):
        for s in (other, third):
            if s[at] != "-" and r.random() < 0.6:
                s[at] = r.choice("ACGT")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.fas").write_text("".join(f">{n}.I(+):1-6000\n{''.join(s)}\n" for n, s in (("T", seq), ("Q", other), ("R", third))))
    genes = spark.createDataFrame([("g1", "I", 500, 3000, "+"), ("g2", "I", 4000, 5500, "+")], GENE_DDL)
    exons = spark.createDataFrame([("g1", "t1", "e1", "I", 500, 1499, "+", 0, 500, 1499), ("g1", "t1", "e2", "I", 2000, 2999, "+", 0, 2000, 2899), ("g2", "t2", "e3", "I", 4000, 5200, "+", 0, 4000, 5200)], EXON_DDL)
    run = Run(spark, str(tmp_path / "out"), Config(min_length=100, combine_threshold=3, segment_piece=1500), annotation="cds:\n  I: 500-1499,1400-1600\nrepeat:\n  I: 5000-5100\n", genes=genes, exons=exons)
    assert run.run(str(tmp_path / "in"), "2,5,10,20,30,33,43") == [2, 5, 10, 20, 30, 33, 43]
    positions = spark.createDataFrame([("hot", "dsb", "I", 2600, 2650), ("hot", "ori", "I", 1000, 1000), ("cold", "ori", "I", 5900, 5990)], "tag string, type string, chr_name string, start int, end int")
    run.place_positions(positions)
    t = run.tables
    assert t["ofg"].count() == 3 and t["ofgsw"].where("ofgsw_distance = 0").count() == 3 and t["ofgsw"].where("ofgsw_cv IS NOT NULL").count() > 50
    held = {x.window_id for x in t["window"].select("window_id").collect()}
    assert held >= {x.window_id for name in ("segment", "gene", "exon", "ofg", "ofgsw") for x in t[name].select("window_id").collect()} and t["window"].count() == len(held)
    assert t["align"].first().align_coding == pytest.approx(1101 / 6000)  # features that overlap count once
    gene = {x.gene_stable_id: x for x in t["gene"].collect()}
    assert gene["g1"].gene_tl_size == 1900 and gene["g1"].gene_syn is not None and gene["g1"].gene_nsy > 0
    names = set(run.report("ofg")) | set(run.report(43)) | set(run.report(42))
    assert {"summary_ofg", "ofg_all", "ofg_tag", "ofg_type", "ofg_tt", "summary_gene", "gene_dnds", "segment_gc_indel", "segment_cv_lm"} <= names
    made = sheets(t, names=["summary_gene", "ofg_tag", "segment_gc_indel"], config=run.config)
    summary = {x["name"]: x for x in made["summary_gene"].collect()}
    assert summary["gene"]["count"] == 2 and summary["exon"]["count"] == 3 and summary["gene"].sum_length == 2501 + 1501
    assert made["ofg_tag"].where("distance = 0 AND ofg_tag = 'hot'").first()["count"] == 2
    short = t["segment"].where("segment_type = '3'").count()
    assert made["segment_gc_indel"].where("segment_type = '3'").agg(F.sum("count")).first()[0] == short > 5


def test_sheets_of_linkage_waves_and_lists(spark):
    """Sheets on small tables of which every row is known."""
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    t = {
        "isw": make([(1, 7, 1, 0, 3), (2, 7, 1, 1, 3), (3, 8, 1, 0, 5)], "isw_id long, isw_indel_id long, align_id long, isw_distance int, isw_density int"),
        "indel": make([(7, 1, "I", 1, 6, "ACGTAC"), (8, 1, "D", 2, 2, "GG")], "indel_id long, align_id long, indel_type string, indel_freq int, indel_length int, indel_seq string").withColumn("indel_occured", F.lit("0011")),
        "snp": make([(1, 1, 1, 0.5, -0.4, 0.1), (2, 2, 1, 1.0, 0.2, 0.3), (3, 3, 1, -0.5, 0.6, 0.5), (4, 1, 1, None, None, 0.7)], "snp_id long, isw_id long, align_id long, snp_r double, snp_dprime double, snp_r2_s double").selectExpr("*", "'0101' AS snp_occured", *[f"snp_r2_s AS snp_{c}" for c in ("dprime_abs_s", "r2_i", "r2_ni", "dprime_abs_i", "dprime_abs_ni")]),
        "sequence": make([(1, "T", "I", 1, 900)] + [(1, "Q", "I", 1, 900)] * 3, "align_id long, seq_role string, chr_name string, chr_start int, chr_end int"),
        "gsw": make([(1, 1, 1, 1200, 0.15, 0.3, 0.6), (2, 2, 0, 1200, 0.15, 0.3, 0.6), (3, 11, 0, 400, 0.5, 0.2, 0.7)], "gsw_id long, gsw_distance int, gsw_distance_crest int, gsw_wave_length int, gsw_amplitude double, gsw_trough_gc double, gsw_crest_gc double"),
        "window": make([(1, 1, 0.1, 0.4, 2, 100, 5), (2, 1, 0.3, 0.5, 1, 100, 6), (3, 1, 0.2, 0.6, 0, 100, 7), (21, 1, 0.1, 0.4, 1, 50, 3), (22, 1, 0.2, 0.5, 2, 100, 4), (23, 2, 0.4, 0.5, 3, 100, 5)], "window_id long, align_id long, window_pi double, window_gc double, window_indel int, window_length int, window_differences int"),
        "gene": make([(21, 21, 1, "a", "I", 5, 54, "x", 1, 1, 50, 0.1, 0.2), (22, 22, 1, "b", "I", 800, 1000, "y", 0, 1, 100, 0.1, 0.3), (23, 23, 2, "b", "I", 800, 1000, "y", 0, 1, 300, None, None)], "gene_id long, window_id long, align_id long, gene_stable_id string, chr_name string, start int, end int, gene_biotype string, gene_is_full int, rank_start int, rank_end int, gene_syn double, gene_nsy double"),
    }
    t["sequence"] = t["sequence"].unionByName(make([(2, "T", "I", 901, 2000)], "align_id long, seq_role string, chr_name string, chr_start int, chr_end int"))
    names = {"d1_indel_ld", "d1_indel_ld_insdel", "d2_snps_ld_insdel", "d1_indel_ld_freq", "summary_indel", "indel_kmers", "gene_list", "distance_to_trough", "d_wave_length_series", "d_gc_series", "window_gc"}
    made = sheets(t, names=list(names))
    assert set(made) == names and all(df.count() > 0 for df in made.values())
    rows = {r.key: r for r in made["d1_indel_ld"].collect()}
    assert set(rows) == {0, 1} and rows[1].AVG_r2 == pytest.approx(1.0)
    assert {(r.level, r.key) for r in made["d1_indel_ld_insdel"].collect()} == {("ins", 0), ("ins", 1), ("del", 0)}
    summary = {(r.kind, r.level): r["count"] for r in made["summary_indel"].collect()}
    assert summary["all", "all"] == 2 and summary["I", "all"] == summary["D", "all"] == 1
    kmers = {(r.k, r.band, r.kmer): r["count"] for r in made["indel_kmers"].collect()}
    assert kmers[1, 1, "C,G"] == 2 and kmers[6, 2, "ACGTAC,GTACGT"] == 1
    series = {(r.band, r.distance): r.avg_indel for r in made["d_wave_length_series"].collect()}
    assert series == {(2, 1): 2.0, (2, 2): 1.0}
    genes = {r.gene_stable_id: r for r in made["gene_list"].collect()}
    assert (genes["a"].parts, genes["b"].parts, genes["b"].subs, genes["b"].indel, genes["b"].gene_ids) == (1, 2, 9, 5, "22,23")
    assert genes["b"].pi == pytest.approx((0.2 * 100 + 0.4 * 300) / 400) and genes["b"].syn == pytest.approx(0.1)
