"""Joins on intervals, pairs and neighbours, as equi-joins that Spark can distribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genolith.scratch import Scratch


def binned_interval_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, start: str, end: str, width: int, how: str = "inner", first_by: str | None = None) -> DataFrame:
    """Points with the intervals of the same keys that hold them, both ends inclusive.

    Intervals are repeated for each bin of ``width`` that they touch and meet points in an equi-join on
    (keys, bin): hot keys spread over their bins. A point has one bin, so no pair comes twice.
    ``first_by`` keeps the interval with the smallest value of that column only. ``how`` may be left.
    """
    keys = list(on)
    binned = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_bin", F.floor(F.col(point) / width))
    if first_by:
        placed = placed.withColumn("_row", F.monotonically_increasing_id())
    p, i = placed.alias("p"), binned.alias("i")
    condition = F.col("p._bin") == F.col("i._bin")
    for k in keys:
        condition &= F.col(f"p.{k}") == F.col(f"i.{k}")
    condition &= F.col(f"p.{point}").between(F.col(f"i.{start}"), F.col(f"i.{end}"))
    rest = [c for c in intervals.columns if c not in keys and c not in points.columns]
    joined = p.join(i, condition, how).select(*[F.col(f"p.{c}") for c in placed.columns if c != "_bin"], *[F.col(f"i.{c}") for c in rest])
    if not first_by:
        return joined
    best = Window.partitionBy("_row").orderBy(F.asc_nulls_last(first_by))
    return joined.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_row")


def containment_join(inner: DataFrame, outer: DataFrame, on: Sequence[str], inner_span: tuple[str, str], outer_span: tuple[str, str], width: int, inner_id: str, outer_id: str) -> DataFrame:
    """Each inner span with the outer span of the smallest id that holds all of it, and ``hits``, how many do.

    An outer span that holds it also touches the bin of its start, where they meet.
    """
    a, b = inner_span
    c, d = outer_span
    binned = outer.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(c) / width), F.floor(F.col(d) / width))))
    joined = inner.withColumn("_bin", F.floor(F.col(a) / width)).join(binned, [*on, "_bin"]).where((F.col(c) <= F.col(a)) & (F.col(d) >= F.col(b)))
    columns = [x for x in inner.columns if x not in (inner_id, *on)]
    grouped = joined.groupBy(inner_id, *on, *columns).agg(F.min(outer_id).alias(outer_id), F.count("*").alias("hits"))
    return grouped.select(*inner.columns, outer_id, "hits")


def pairs_within(df: DataFrame, on: Sequence[str], position: str, ident: str, near: int) -> DataFrame:
    """Unordered pairs of rows of the same keys at most ``near`` apart: columns of both with _a and _b; a is the smaller in (position, id).

    Rows meet in their own bin and the next, so a pair meets once and work is bounded by the density.
    """
    keys = list(on)
    binned = df.withColumn("_bin", F.floor(F.col(position) / near))
    rest = [c for c in df.columns if c not in keys]
    a = binned.select(*keys, F.explode(F.array("_bin", F.col("_bin") + 1)).alias("_meet"), *[F.col(c).alias(f"{c}_a") for c in rest])
    b = binned.select(*keys, F.col("_bin").alias("_meet"), *[F.col(c).alias(f"{c}_b") for c in rest])
    before = F.struct(f"{position}_a", f"{ident}_a") < F.struct(f"{position}_b", f"{ident}_b")
    return a.join(b, [*keys, "_meet"]).where(before & (F.col(f"{position}_b") - F.col(f"{position}_a") <= near)).drop("_meet")


def span_union(df: DataFrame, on: Sequence[str], start: str, end: str, scratch: Scratch) -> DataFrame:
    """keys, start, end: the spans of each key with overlapping and adjacent ones joined; null or reversed spans are left out.

    Rows are dealt into ranges of (keys, start), which are written, so that a key with most of the rows is in many of them. How far
    the spans before a range reach is a running maximum over ranges, one row for each key and range; a joined span's start is carried
    on in the same way.
    """
    keys = list(on)
    rows = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_a"), F.col(end).alias("_b")).distinct()
    ranged = scratch.keep(rows.repartitionByRange(*keys, "_a", "_b").withColumn("_p", F.spark_partition_id()), "union_ranged")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_p", *keys).orderBy("_a", "_b")
    before = ranged.groupBy(*keys, "_p").agg(F.max("_b").alias("_most")).select(*named, F.col("_p").alias("_q"), F.max("_most").over(earlier).alias("_reach"))
    reach = F.greatest("_reach", F.max("_b").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    opened = ranged.join(before, same).withColumn("_open", F.when(reach.isNull() | (F.col("_a") > reach + 1), F.col("_a"))).select(*keys, "_a", "_b", "_p", "_open")
    opened = scratch.keep(opened, "union_opened")
    carried = opened.groupBy(*keys, "_p").agg(F.max("_open").alias("_last")).select(*named, F.col("_p").alias("_q"), F.last("_last", True).over(earlier).alias("_from"))
    held = F.coalesce(F.last("_open", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_from"))
    return opened.join(carried, same).withColumn("_start", held).groupBy(*keys, F.col("_start").alias(start)).agg(F.max("_b").alias(end))


def means_around(pairs: DataFrame, points: DataFrame, asking: DataFrame, on: Sequence[str], ident: str, position: str, near: int, measures: Sequence[str]) -> DataFrame:
    """ident, n (points within ``near``), and the mean of each measure over pairs that have both ends within ``near`` of an asking row.

    ``pairs`` has the keys, ``low`` and ``high`` positions and the measures, null where a pair has none; ``points`` and ``asking`` the keys and
    a position. A pair counts from near below its higher end to near above its lower one: it is added at the one point and
    taken off at the other, and a running sum along the positions gives every asking row its sums. Rows are
    in proportion to pairs, however many rows ask. Keys are cut into bins of twice ``near``, each with its own sum.
    """
    keys, width = list(on), 2 * near
    zero = F.lit(0.0)
    values = [(f"_v_{m}", f"_c_{m}") for m in measures]
    spans = pairs.select(*keys, (F.col("high") - near).alias("_from"), (F.col("low") + near).alias("_to"), *[x for m, (v, c) in zip(measures, values) for x in (F.coalesce(F.col(m).cast("double"), zero).alias(v), F.col(m).isNotNull().cast("long").alias(c))], F.lit(0).cast("long").alias("_n"))
    none = [x for v, c in values for x in (zero.alias(v), F.lit(0).cast("long").alias(c))]
    spans = spans.where("_from <= _to").unionByName(points.select(*keys, (F.col(position) - near).alias("_from"), (F.col(position) + near).alias("_to"), *none, F.lit(1).cast("long").alias("_n")))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    sums = [x for pair in values for x in pair] + ["_n"]
    begin = spans.select(*keys, "_bin", F.greatest("_from", F.col("_bin") * width).cast("long").alias("_at"), F.lit(0).alias("_kind"), *sums)
    end = spans.where(F.floor(F.col("_to") / width) == F.col("_bin")).select(*keys, "_bin", F.col("_to").cast("long").alias("_at"), F.lit(2).alias("_kind"), *[(-F.col(c)).alias(c) for c in sums])
    ask = asking.select(*keys, F.floor(F.col(position) / width).alias("_bin"), F.col(position).cast("long").alias("_at"), F.lit(1).alias("_kind"), *none, F.lit(0).cast("long").alias("_n"), ident)
    along = Window.partitionBy(*keys, "_bin").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = begin.unionByName(end).unionByName(ask, allowMissingColumns=True).select("_kind", ident, *[F.sum(c).over(along).alias(c) for c in sums]).where("_kind = 1")
    return swept.select(ident, F.col("_n").alias("n"), *[F.when(F.col(c) > 0, F.col(v) / F.col(c)).alias(m) for m, (v, c) in zip(measures, values)])


def nearest(points: DataFrame, others: DataFrame, on: Sequence[str], point: str, other: str, other_id: str) -> DataFrame:
    """points with the id and distance of the nearest other row of the same keys, ties to the smaller id; null if there is none.

    Both are dealt together into ranges of (keys, position), so that a hot key is in many of them, and looked up before and
    after within a range; what a range lacks comes from the last and the first other row of the ranges around it, one each.
    No pairs are made. Null keys are one key. Rows without a position are near to nothing.
    """
    keys = list(on)
    p = points.select("*", F.col(point).alias("_at"), F.lit(None).cast(others.schema[other_id].dataType).alias("_id"), F.lit(1).alias("_is"))
    o = others.where(F.col(other).isNotNull()).groupBy(*keys, F.col(other).alias("_at")).agg(F.min(other_id).alias("_id")).withColumn("_is", F.lit(0))
    both = p.unionByName(o, allowMissingColumns=True).repartitionByRange(*keys, "_at", "_is").withColumn("_p", F.spark_partition_id())
    both = Scratch(points.sparkSession, "nearest").keep(both, "ranged")  # the limits of ranges are sampled anew for each shuffle
    hit = F.when(F.col("_is") == 0, F.struct("_at", "_id"))
    ends = both.groupBy(*keys, "_p").agg(F.max(hit).alias("_last"), F.min(hit).alias("_first"))
    along = Window.partitionBy(*keys).orderBy("_p")  # a row for each range
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    inside = Window.partitionBy("_p", *keys)
    to_here = lambda *order: inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_b", F.last(hit, True).over(to_here("_at", "_is"))).withColumn("_a", F.last(hit, True).over(to_here(F.desc("_at"), "_is"))).where("_is = 1")
    same = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    found = found.join(ends, same)
    around = [F.coalesce("_b", "_before"), F.coalesce("_a", "_after")]
    away = [F.when(x.isNotNull() & F.col("_at").isNotNull(), F.struct(F.abs(x["_at"] - F.col("_at")).alias("d"), x["_id"].alias("i"))) for x in around]
    best = F.coalesce(F.least(*away), *away)
    return found.select(*points.columns, best["i"].alias("nearest_id"), best["d"].alias("nearest_distance"))
