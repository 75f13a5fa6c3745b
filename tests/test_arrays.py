import random
import time

from pyspark.sql import functions as F

from genolith.functions import intervals as iv
from genolith.functions.arrays import running
from genolith.operators import enrich


def test_running_values(spark):
    r = random.Random(1)
    rows = [(i, [r.randrange(-50, 50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 255, 256, 257, 512, 1000])]
    df = spark.createDataFrame(rows, "i int, v array<bigint>")
    for x in df.select("i", running(F.col("v"), lambda a, b: a + b, 0).alias("s"), running(F.col("v"), F.greatest, -99).alias("m")).collect():
        v = rows[x.i][1]
        assert x.s == [sum(v[:k]) for k in range(len(v))] and x.m == [max([-99, *v[:k]]) for k in range(len(v))]


def test_merged_spans(spark):
    r = random.Random(2)
    rows = [(i, [(a, a + r.choice([0, 1, 5, 300])) for a in (r.randrange(1, 3000) for _ in range(n))]) for i, n in enumerate([0, 1, 2, 40, 700])] + [(5, None)]
    df = spark.createDataFrame(rows, "i int, s array<struct<start:int,end:int>>")
    for x in df.select("i", iv.merge(F.col("s")).alias("m")).collect():
        if rows[x.i][1] is None:
            assert x.m is None
            continue
        want = []
        for a, b in sorted(rows[x.i][1]):
            if want and a <= want[-1][1] + 1:
                want[-1][1] = max(want[-1][1], b)
            else:
                want.append([a, b])
        assert [[y.start, y.end] for y in x.m] == want


def test_time_follows_the_spans(spark):
    def took(n):
        text = "ACGT-" * n
        df = spark.createDataFrame([(text,)], "s string").select(iv.runs_of(F.col("s"), "-").alias("a"), iv.runs_of(F.col("s"), "G-").alias("b"))
        began = time.time()
        assert df.select(F.size(iv.merge(F.concat("a", "b"))).alias("n")).first().n == 2 * n
        return time.time() - began

    took(100)
    assert took(40_000) < 4 * took(10_000) + 4


def test_equal_rows_draw_by_themselves(spark):
    """Rows of which many are equal: the spread is that of as many different ones, not of one draw for all."""
    many = spark.range(2000).selectExpr("CAST(id % 2 AS double) AS t", "1.0D AS u")
    b = enrich.bootstrap_ratio(many, "t", "u", 60).first()
    assert abs(b.mean - 0.5) < 0.01 and 0.005 < b.stderr < 0.02
