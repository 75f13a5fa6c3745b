import random

from genolith.config import Config
from genolith.operators.sequences import Store
from genolith.plans.steps import Run
from genolith.plans.tracks import COLUMNS, tracks
from genolith.scratch import Scratch

SETTINGS = Config(min_length=100)


def test_tracks_of_a_run(spark, tmp_path):
    r = random.Random(4)
    (tmp_path / "in").mkdir()
    texts = []
    for n, gaps in ((2600, (300, 900, 1700)), (1500, (600,))):
        seq = "".join(r.choice("GC" if 100 * (i // 100 % 6 > 2) > r.randrange(100) else "ACGT") for i in range(n))
        other = "".join("-" if any(g <= i < g + 3 for g in gaps) else c for i, c in enumerate(seq))
        texts.append(f">T.I(+):1-{n}\n{seq}\n>Q.I(+):1-{n - 3 * len(gaps)}\n{other}\n")
    (tmp_path / "in" / "b.fas").write_text("\n".join(texts))
    run = Run(spark, str(tmp_path / "out"), SETTINGS, annotation="cds:\n  I: 1-700\nrepeat:\n  I: 801-900\n")
    run.run(str(tmp_path / "in"), "2 5 30")
    aligns = sorted(run.tables["align"].collect(), key=lambda a: -a.align_length)
    made = run.graph()
    assert tuple(made.columns) == COLUMNS
    of = {}
    for x in made.where(made.align_id == aligns[0].align_id).collect():
        of.setdefault(x.track, []).append((x.start, x.end, x.name, x.score))
    assert sorted(of["indel"]) == [(301, 303, None, None), (901, 903, None, None), (1701, 1703, None, None)]
    assert of["target"] == [(1, 2600, "T", None)]
    assert sorted(x[:2] for x in of["query"]) == sorted(x[:2] for x in of["comparable"]) == [(1, 300), (304, 900), (904, 1700), (1704, 2600)]
    assert {x[3] for x in of["pi"]} == {0.0} and min(of["pi"])[0] == 304 and max(x[1] for x in of["pi"]) == 1700
    wave = sorted(of["gc"])
    assert wave[0][:2] == (1, 100) and all(a[0] < b[0] for a, b in zip(wave, wave[1:])) and all(0 <= x[3] <= 1 for x in wave)
    assert {x[2] for x in wave} <= {None, "T", "C"} and wave[-1][1] <= 2600
    csv = spark.read.option("header", "true").csv(str(tmp_path / "out" / "graph" / "gc"))
    assert csv.columns == ["align_id", "start", "gc", "flag"] and csv.count() == made.where("track = 'gc'").count() > len(wave)
    one = run.graph([aligns[1].align_id])
    assert one.select("align_id").distinct().count() == 1 and one.count() == made.where(made.align_id == aligns[1].align_id).count()


def test_tracks_of_runlists_and_of_nothing(spark):
    align = spark.createDataFrame([(1, "1-4,9", "5-8", "2-3", None), (2, "-", None, "", "7")], "align_id long, align_comparable_runlist string, align_indel_runlist string, align_coding_runlist string, align_repeats_runlist string")
    empty = spark.createDataFrame([], "seq_id long, align_id long, seq_role string, seq_position int, common_name string, seq_runlist string, seq_seq string")
    got = tracks({"align": align}, Store(empty, Scratch(spark, "tracks")), SETTINGS).collect()
    assert sorted((x.align_id, x.track, x.start, x.end) for x in got) == [(1, "coding", 2, 3), (1, "comparable", 1, 4), (1, "comparable", 9, 9), (1, "indel", 5, 8), (2, "repeats", 7, 7)]
    assert tracks({"align": align.limit(0), "sequence": empty}, Store(empty, Scratch(spark, "none")), SETTINGS).count() == 0
