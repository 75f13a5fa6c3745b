import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.functions import genetics as g
from genolith.operators import enrich, ingest
from genolith.operators.sequences import Store

DDL = "align_id long, seq_role string, seq_position int, seq_seq string"


def alignment(r, n, rows, gap=0.02):
    """Sequences with runs of gaps, some of them long."""
    base = [r.choice("ACGT") for _ in range(n)]
    out = []
    for _ in range(rows):
        s = [r.choice("ACGTN") if r.random() < 0.05 else b for b in base]
        at = 0
        while at < n:
            if r.random() < gap:
                k = r.choice([1, 1, 2, 5, 40])
                s[at : at + k] = "-" * len(s[at : at + k])
                at += k
            at += r.randrange(1, 60)
        out.append("".join(s))
    return out


def made(spark, aligns):
    rows = [(a, "T" if i == 0 else "Q", i, s) for a, seqs in aligns.items() for i, s in enumerate(seqs)]
    return spark.createDataFrame([*rows, (1, "O", 9, "N" * len(aligns[1][0]))], DDL).repartition(3)


@pytest.fixture(scope="module")
def aligns():
    r = random.Random(6)
    return {1: alignment(r, 1000, 3), 2: alignment(r, 257, 2), 3: alignment(r, 64, 4), 4: ["----", "AC-T"], 5: ["A", "C"]}


@pytest.fixture(scope="module", params=[8, 64, 4096])
def store(spark, aligns, request):
    return Store(made(spark, aligns), size=request.param)


def intervals(spark, aligns, n=300, longest=150):
    r = random.Random(n)
    rows = []
    for i in range(n):
        a = r.choice(list(aligns))
        length = len(aligns[a][0])
        start = r.randrange(1, length + 1)
        rows.append((i, a, start, min(length, start + r.randrange(longest))))
    return rows, spark.createDataFrame(rows, "ident long, align_id long, a int, b int")


def test_sums_and_slices(spark, aligns, store):
    rows, df = intervals(spark, aligns)
    stats = {x.ident: x for x in store.stats(df, "ident", "a", "b").collect()}
    slices = {x.ident: x.slices for x in store.slices(df, ["ident"], "a", "b").collect()}
    assert len(stats) == len(slices) == len(rows)
    for i, a, start, end in rows:
        cut = [s[start - 1 : end] for s in aligns[a]]
        assert slices[i] == cut
        m, x = g.matrix(cut), stats[i]
        want = g.column_stats(m)
        assert (x["columns"], x.comparables, x.identities, x.differences) == (end - start + 1, want["comparables"], want["identities"], want["differences"])
        assert x.pi == pytest.approx(want["pi"]) if want["pi"] is not None else x.pi is None
        gc, gaps = g.gc_ratio(m[0]), (m == g.GAP).any(0)
        assert x.gc == pytest.approx(gc) if gc is not None else x.gc is None
        free = g.gc_ratio(m[0][~gaps])
        assert x.gc_of_free == pytest.approx(free) if free is not None else x.gc_of_free is None
        assert x.gap_runs == len(g.runs(gaps))
    beyond = spark.createDataFrame([(1, 5, 1, 400), (2, 5, 30_000, 30_001), (3, 5, 2, 1), (4, 5, 0, 1), (5, 5, None, 1)], "ident long, align_id long, a int, b int")
    assert [(x.ident, x["columns"]) for x in store.sums(beyond, "ident", "a", "b").collect() if x["columns"]] == [(1, 1)]


def test_ranks(spark, aligns, store):
    rows = [(i, a, r, c) for i, (a, r, c) in enumerate((a, k, k) for a in aligns for k in range(1, len(aligns[a][0]) + 3))]
    df = spark.createDataFrame(rows, "ident long, align_id long, r int, c int")
    for kind in ("free", "target"):
        members = {a: [c + 1 for c in range(len(s[0])) if all(x[c] != "-" for x in (s if kind == "free" else s[:1]))] for a, s in aligns.items()}
        assert {x.align_id: x["size"] for x in store.sizes(kind).collect()} == {a: len(m) for a, m in members.items()}
        for x in store.column_of(df, kind, at="r").collect():
            own = members[x.align_id]
            assert x["at"] == (own[x.r - 1] if x.r <= len(own) else None)
        within = df.where(" OR ".join(f"align_id = {a} AND c <= {len(s[0])}" for a, s in aligns.items()))
        for x in within.join(store.rank_of(within, kind, "ident", "c"), "ident", "left").collect():
            assert x["rank"] == sum(c <= x.c for c in members[x.align_id])


def test_waves_at_any_size_of_block(spark):
    r = random.Random(1)
    block = lambda gc, n: "".join(r.choice("GC" if r.random() < gc else "AT") for _ in range(n))
    target = "".join(block(0.7 if i % 2 else 0.3, 700) for i in range(12))
    other = "".join("-" if r.random() < 0.03 else c for c in target)
    sequences = spark.createDataFrame([(1, "T", 0, target), (1, "Q", 1, other), (2, "T", 0, "ACGT"), (2, "Q", 1, "ACGT")], DDL)
    aligns = spark.createDataFrame([(1,), (2,)], "align_id long")
    joined = np.frombuffer("".join(a for a, b in zip(target, other) if b != "-").encode(), np.uint8)
    for config in (Config(), Config(wave_window_step=30, wave_window_size=60, vicinal_size=240, fall_range=0.05)):
        want = [(w["start"], w["gc"], w["flag"]) for w in g.gc_wave(joined, config.wave_window_size, config.wave_window_step, config.vicinal_size, config.fall_range) if w["flag"]]
        assert len(want) > 5
        for size in (100, 4096):
            x = enrich.extreme_table(aligns, Store(sequences, size=size), config).orderBy("rank_start").collect()
            assert [(y.rank_start, y.extreme_gc, y.extreme_type) for y in x] == want
        waves = enrich.wave_windows(Store(sequences), config)
        for chunk in (1, 7, 40):
            around = max(1, config.vicinal_size // config.wave_window_step)
            assert sorted((y.rank_start, y.flag) for y in enrich.wave_flags(waves, around, config.fall_range, chunk).collect()) == [(a, f) for a, _, f in want]


def test_segments_and_cv_against_whole_sequences(spark, aligns):
    config = Config(segment_styles={1: 200, 3: 50}, stat_window_size=20, stat_window_step=10, stat_segment_size=60)
    store = Store(made(spark, aligns), size=32)
    table = spark.createDataFrame([(a,) for a in aligns], "align_id long")
    got = {(x.align_id, x.segment_type, x.window_start): x for x in enrich.segment_table(table, store, config).collect()}
    seen = 0
    for a, seqs in aligns.items():
        columns = [c for c in range(len(seqs[0])) if all(s[c] != "-" for s in seqs)]
        for kind, size in config.segment_styles.items():
            for i in range(len(columns) // size):
                own = columns[i * size : (i + 1) * size]
                x = got[a, str(kind), own[0] + 1]
                want = g.segment_stats(np.frombuffer("".join(seqs[0][c] for c in own).encode(), np.uint8), 20, 10)
                assert x.window_end == own[-1] + 1 and (x.segment_gc_mean, x.segment_gc_std, x.segment_gc_cv, x.segment_gc_mdcw) == tuple(pytest.approx(v) for v in want)
                seen += 1
    assert seen == len(got) > 20
    rows, df = intervals(spark, aligns, 60, 40)
    cv = {x.ident: x for x in enrich.intra_cv(enrich.window_cv(df, "ident", store, "a", "b", config), "ident", store, "a", "b", size=5, step=5).collect()}
    for i, a, start, end in rows:
        s = np.frombuffer(aligns[a][0].encode(), np.uint8)
        first = max(min((start + end) // 2 - 30 + 1, len(s) - 60 + 1), 1)
        for value, want in ((cv[i].cv, g.segment_stats(s[first - 1 : first + 59], 20, 10)[2]), (cv[i].intra_cv, g.segment_stats(s[start - 1 : end], 5, 5)[2])):
            assert value == pytest.approx(want) if want is not None else value is None


def test_windows_between_indels_and_window_table(spark, aligns):
    rows = [(a, [{"position": i, "name": "x", "chr": "I", "strand": "+", "start": 1, "end": len(s), "seq": s} for i, s in enumerate(seqs)]) for a, seqs in aligns.items()]
    blocks = ingest.analyzed(spark.createDataFrame(rows, "align_id long, rows array<struct<position:int,name:string,chr:string,strand:string,start:int,end:int,seq:string>>").withColumn("file", F.lit("f")))
    indels, store = ingest.indel_table(blocks), Store(made(spark, aligns), size=100)
    got = {(x.align_id, x.isw_start, x.isw_end): x for x in enrich.isw_table(indels, store).collect()}
    want = {}
    for a, seqs in aligns.items():
        spans = g.runs((g.matrix(seqs) == g.GAP).any(0))
        for (_, e), (s, _) in zip(spans, spans[1:]):
            want |= {(a, w["start"], w["end"]): w for w in g.interval_windows(e + 1, s - 1)}
    assert set(got) == set(want) and {w["type"] for w in want.values()} >= {"S"}
    for key, w in want.items():
        m = g.matrix([s[key[1] - 1 : key[2]] for s in aligns[key[0]]])
        assert (got[key].isw_type, got[key].isw_distance, got[key].isw_density, got[key].isw_differences) == (w["type"], w["distance"], w["density"], g.column_stats(m)["differences"])
    spans = spark.createDataFrame([(1, 1, 1, 900), (2, 2, 3, 9), (3, 4, 1, 4)], "window_id long, align_id long, window_start int, window_end int")
    for of_set in (True, False):
        for x in enrich.window_table(spans, "window_id", store, of_set=of_set).collect():
            gaps = (g.matrix([s[x.window_start - 1 : x.window_end] for s in aligns[x.align_id]]) == g.GAP).any(0)
            assert x.window_indel == (len(g.runs(gaps)) if of_set else max(len(g.runs(gaps)) - 1, 0))


def test_interval_windows_against_python(spark):
    rows = [(i, 5, 5 + n) for i, n in enumerate([-1, 0, 5, 99, 150, 199, 200, 299, 300, 349, 998, 1049, 2500])]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i int, a int, b int").select("i", enrich.interval_windows("a", "b").alias("w")).collect()}
    for i, a, b in rows:
        assert [x.asDict() for x in got[i]] == g.interval_windows(a, b)


def test_time_is_linear_in_a_long_alignment(spark):
    """A block of 2,000,000 columns and 20,000 windows: each block is read once."""
    n = 2_000_000
    seq = ("ACGTTGCA" * (n // 8))[:n]
    sequences = spark.createDataFrame([(1, "T", 0, seq), (1, "Q", 1, seq[:-1] + "C")], DDL)
    store = Store(sequences)
    windows = spark.range(20_000).selectExpr("id AS ident", "1L AS align_id", "CAST(id * 100 + 1 AS int) AS a", "CAST(id * 100 + 100 AS int) AS b")
    x = store.stats(windows, "ident", "a", "b").agg(F.sum("comparables").alias("n"), F.sum("differences").alias("d"), F.count("*").alias("rows")).first()
    assert (x.n, x.d, x.rows) == (n, 1, 20_000)
    plan = store.sums(windows, "ident", "a", "b")._jdf.queryExecution().toString()
    assert "substring(seq_seq" not in plan
    assert store.slices(windows, ["ident"], "a", "b").where("slices[0] <> slices[1]").count() == 1
