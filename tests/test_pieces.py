import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolith.operators import buckets as bk
from genolith.plans import reports as rp


def one_by_one(weights, piece, carried=0):
    """Rows after which a piece ends, and the weight that is left."""
    run, out = carried, []
    for i, w in enumerate(weights):
        run += w
        if run >= piece and w:
            out.append(i)
            run = 0
    return out, run


def test_range_functions_against_a_loop():
    r = random.Random(1)
    for _ in range(1500):
        weights = np.array([r.choice([0, 1, 2, 3, 50]) for _ in range(r.randrange(1, 40))])
        piece = r.randrange(1, 60)
        at, rest, cuts, total = bk.range_function(weights, piece)
        for carried in range(piece):
            want, left = one_by_one(weights, piece, carried)
            k = int(np.searchsorted(at, piece - carried, side="left"))
            assert ((int(rest[k]), int(cuts[k])) if k < len(at) else (carried + total, 0)) == (left, len(want))
            assert bk.cuts_from(weights, piece, carried) == want


def test_chains_that_meet_are_one_entry():
    r = np.random.default_rng(2)
    at, *_ = bk.range_function(r.integers(1, 1000, 100_000), 50_000)
    assert len(at) < 60  # of a hundred rows in the first piece


def numbers(rows, key, piece):
    """piece by row id, going through sorted rows."""
    out, state = {}, {}
    for row in rows:
        number, run = state.get(row[key], (1, 0))
        out[row["id"]] = number
        run += row["w"] or 0
        state[row[key]] = (number + 1, 0) if run >= piece else (number, run)
    return out


def test_150000_rows(spark):
    df = spark.range(150_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE pmod(xxhash64(id), 5000) END AS k", "CASE WHEN id % 50 = 7 THEN NULL ELSE pmod(hash(id), 90) + 1 END AS w", "0 AS one", "'x' AS piece_of")
    rows = df.orderBy("k", "id").collect()
    for piece, blocks in ((1000, 16), (250_000, 9), (10**9, 4), (1, 5)):
        got = {r.id: r.piece for r in bk.greedy_pieces(df, [F.col("k"), F.col("id")], F.col("w"), piece, blocks=blocks).collect()}
        assert got == numbers(rows, "one", piece)


def test_groups_and_odd_weights(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.randrange(9), r.choice([0.25, 0.5, 1.75, None, 0.0])) for i in range(5000)] + [(9000, "only", 1, 0.1)]
    df = spark.createDataFrame(rows, "id int, g string, k int, w double")
    got = {x.id: x.piece for x in bk.greedy_pieces(df, [F.desc("k"), F.col("id")], F.col("w"), 12.5, by=[F.col("g")], blocks=7).collect()}
    ordered = [{"id": i, "g": g, "w": w} for i, g, k, w in sorted(rows, key=lambda x: (-x[2], x[0]))]
    assert got == numbers(ordered, "g", 12.5)
    assert bk.greedy_pieces(df.limit(0), [F.col("k")], F.col("w"), 3).columns == [*df.columns, "piece"] and bk.greedy_pieces(df.limit(0), [F.col("k")], F.col("w"), 3).count() == 0
    with pytest.raises(ValueError):
        bk.greedy_pieces(df.withColumn("w", -F.col("w")), [F.col("k")], F.col("w"), 3)
    with pytest.raises(ValueError):
        bk.greedy_pieces(df, [F.col("k")], F.col("w"), 0)


def test_lines_by_level(spark):
    r = random.Random(8)
    rows = [(i, f"t{i % 13}", r.random(), r.randrange(400, 600)) for i in range(4000)]
    df = spark.createDataFrame([(*x, 2 * x[2] + r.random() / 10) for x in rows], "id int, segment_type string, gc double, length int, pi double")
    pieces = rp.level_pieces(df, ["segment_type"], [F.desc("gc"), F.col("id")], "length", 10_000, {"gc": F.col("gc"), "pi": F.col("pi")})
    fits = rp.level_fits(pieces, ["segment_type"], "avg_gc", ["avg_pi"]).collect()
    assert len(fits) == 13 and all(f.n == 15 or f.n == 16 or f.n == 17 for f in fits)
    held = pieces.where("segment_type = 't3'").orderBy("piece").toPandas()
    slope, intercept = np.polyfit(held.avg_gc, held.avg_pi, 1)
    fit = next(f for f in fits if f.segment_type == "t3")
    assert (fit.slope, fit.intercept) == (pytest.approx(slope), pytest.approx(intercept)) and fit.r2 > 0.9 and fit.p < 1e-6
