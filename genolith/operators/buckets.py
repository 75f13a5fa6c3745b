"""Bucketing of report keys: greedy folds, pieces, portions, quantile levels, bands.

Each operator gives a bucket map, a small table that one join and one grouped aggregate then use
for all buckets at once. Bucket maps are as long as there are distinct keys (binned integers), never as
there are rows; ``fold`` checks that before it brings a histogram into one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.scratch import Scratch

#: Distinct keys that a histogram may have to be folded in one row.
MOST_KEYS = 1_000_000


def histogram(df: DataFrame, key: Column) -> DataFrame:
    """key, n over rows whose key is not null."""
    return df.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))


def fold(counts: DataFrame, threshold: int, standalone: Sequence[int] = (), merge_last: bool = False) -> DataFrame:
    """bucket, key: consecutive keys joined until they hold ``threshold`` rows.

    Keys in ``standalone`` stay alone. An undersized tail is a bucket, or with ``merge_last`` part of the one
    before it. Buckets count from 1 in the order of keys.
    """
    if counts.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError("too many keys to fold: bin them first")
    alone = ", ".join(str(k) for k in standalone) or "null"
    step = (
        f"(acc, x) -> CASE WHEN x.key IN ({alone}) THEN named_struct('bucket', acc.bucket + CASE WHEN acc.sum > 0 THEN 2 ELSE 1 END, 'sum', 0L, 'out', concat(acc.out, array(named_struct('bucket', acc.bucket + CASE WHEN acc.sum > 0 THEN 1 ELSE 0 END, 'key', x.key, 'alone', true)))) "
        f"ELSE named_struct('bucket', acc.bucket + CASE WHEN acc.sum + x.n >= {threshold} THEN 1 ELSE 0 END, 'sum', CASE WHEN acc.sum + x.n >= {threshold} THEN 0L ELSE acc.sum + x.n END, "
        "'out', concat(acc.out, array(named_struct('bucket', acc.bucket, 'key', x.key, 'alone', false)))) END"
    )
    kind = counts.schema["key"].dataType.simpleString()
    start = f"named_struct('bucket', 1, 'sum', 0L, 'out', CAST(array() AS array<struct<bucket:int,key:{kind},alone:boolean>>))"
    folded = counts.agg(F.expr("array_sort(collect_list(struct(key, n)))").alias("h")).select(F.expr(f"aggregate(h, {start}, {step})").alias("f"))
    rows = folded.select("f.bucket", "f.sum", F.explode("f.out").alias("x"))
    bucket = F.col("x.bucket")
    if merge_last:  # the tail is what lies in the bucket that is still open
        last_full = "array_max(transform(filter(f.out, y -> y.bucket < f.bucket AND NOT y.alone), y -> y.bucket))"
        rows = folded.select("f.bucket", "f.sum", F.expr(last_full).alias("last"), F.explode("f.out").alias("x"))
        bucket = F.when((F.col("sum") > 0) & (F.col("x.bucket") == F.col("bucket")) & ~F.col("x.alone"), F.coalesce("last", F.col("bucket"))).otherwise(F.col("x.bucket"))
    return rows.select(bucket.cast("int").alias("bucket"), F.col("x.key").alias("key"))


def by_buckets(df: DataFrame, key: Column, buckets: DataFrame) -> DataFrame:
    """df with ``bucket``; a row comes once for each bucket that its key is in. The map is small and broadcast."""
    return df.withColumn("_key", key).join(F.broadcast(buckets.withColumnRenamed("key", "_key")), "_key").drop("_key")


def bands(spark, edges: Sequence[tuple[float, float]], kind: str = "double") -> DataFrame:
    """band, lo, hi from literal pairs, both ends inclusive; pairs may overlap or repeat."""
    return spark.createDataFrame([(i + 1, float(lo), float(hi)) for i, (lo, hi) in enumerate(edges)], "band int, lo double, hi double").select("band", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"))


def by_bands(df: DataFrame, value: Column, edges: DataFrame) -> DataFrame:
    """df with band, lo, hi for each band that holds the value."""
    return df.withColumn("_v", value).join(F.broadcast(edges), F.col("_v").between(F.col("lo"), F.col("hi"))).drop("_v")


def running_before(df: DataFrame, order: Sequence[Column], weight: Column, name: str, descending: bool = False, blocks: int | None = None) -> DataFrame:
    """df with ``name``: the sum of ``weight`` over all rows that come before in the order, 0 for the first.

    No task sees all rows: they are dealt into ranges of the order, sums of ranges are added up, and each range adds its own.
    The ranges are written first, as Spark samples their limits anew for each shuffle, and two readings would not agree.
    There are ``blocks`` of them, or as many as the session has shuffle partitions.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    sort = [F.desc(k) if descending else F.asc(k) for k in keys]
    keyed = df.select("*", weight.alias("_w"), *[c.alias(k) for c, k in zip(order, keys)])
    ranged = keyed.repartitionByRange(*([blocks] if blocks else []), *sort).withColumn("_p", F.spark_partition_id())
    ranged = Scratch(df.sparkSession, "running").keep(ranged, "ranged")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_p").agg(F.sum("_w").alias("_s"))  # as many rows as there are ranges
    before = sums.select("_p", F.sum("_s").over(earlier(Window.orderBy("_p"))).alias("_before"))
    within = F.sum("_w").over(earlier(Window.partitionBy("_p").orderBy(*sort)))
    placed = ranged.withColumn("_run", within).join(F.broadcast(before), "_p")
    zero = F.lit(0)
    return placed.withColumn(name, F.coalesce("_before", zero) + F.coalesce("_run", zero)).drop("_w", "_p", "_run", "_before", *keys)


def top_portion(df: DataFrame, key: Column, weight: Column, portion: float) -> DataFrame:
    """key: the smallest set of largest keys that holds ``portion`` of all weight. Sums run from the top, over distinct keys."""
    sums = df.select(key.alias("key"), weight.alias("w")).where("key IS NOT NULL").groupBy("key").agg(F.sum("w").alias("w"))
    down = running_before(sums, [F.col("key")], F.col("w"), "before", descending=True)
    total = down.agg(F.sum("w").alias("total"))
    return down.crossJoin(F.broadcast(total)).where(F.col("before") < F.col("total") * portion).select("key")  # one row


def pieces(df: DataFrame, order: Sequence[Column], weight: Column, piece: float, blocks: int | None = None) -> DataFrame:
    """df with ``piece``: rows in order, cut each time their running weight passes a multiple of ``piece``."""
    running = running_before(df, order, weight, "_sum", blocks=blocks)
    return running.withColumn("piece", F.floor(F.col("_sum") / piece).cast("long") + 1).drop("_sum")


def _next_cuts(weights: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, and for each row the first row whose piece is full if a new one begins after this row (the number of rows: none)."""
    sums = np.cumsum(weights)
    return sums, np.searchsorted(sums, sums + piece, side="left")


def range_function(weights: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a range of rows makes of the weight that its first piece already has, as (at, rest, cuts, total).

    Entry k, the first with carried + at[k] >= piece, gives the weight that is left after the range's last cut and
    the number of cuts; without such an entry there is no cut, and ``total`` is added to what was carried. Chains of cuts that meet
    are one entry, so that tables are short where weights vary.
    """
    sums, after = _next_cuts(weights, piece)
    n = len(weights)
    last = np.where(after < n, after, np.arange(n))
    cuts = np.where(after < n, 1, 0)
    while True:  # pointers are doubled until each is at the end of its chain
        further = last[last]
        if (further == last).all():
            break
        cuts, last = cuts + cuts[last], further
    first = np.flatnonzero(np.diff(sums, prepend=0) > 0)  # a row of weight 0 fills no piece
    first = first[: np.searchsorted(sums[first], piece, side="left") + 1]
    rest, cuts = sums[-1] - sums[last[first]], cuts[first] + 1
    # of neighbours with the same outcome the last one stands for all
    keep = np.append((rest[1:] != rest[:-1]) | (cuts[1:] != cuts[:-1]), True) if len(first) else np.zeros(0, bool)
    return sums[first][keep], rest[keep], cuts[keep], int(sums[-1])


def cuts_from(weights: np.ndarray, piece: int, carried: int) -> list[int]:
    """The rows of a range after which a piece ends, if the first already has ``carried``."""
    sums, after = _next_cuts(weights, piece)
    out, at = [], int(np.searchsorted(sums, piece - carried, side="left"))
    while at < len(weights):
        out.append(at)
        at = int(after[at])
    return out


def greedy_pieces(df: DataFrame, order: Sequence[Column], weight: Column, piece: float, by: Sequence[Column] = (), blocks: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """df with ``piece``: rows in order gather weight until they have ``piece`` or more, then a new one begins; from 1, in each group of ``by``.

    The cut depends on all cuts before it, and yet no task sees all rows: they are dealt into ranges of the order, which are
    written. Each range gives its function from the weight carried in to the weight carried out (``range_function``); these are
    chained, a row for each range and group in order, and then each range cuts its own rows. A function has entries for the rows
    within one piece of weight from the range's start at most; where a piece is larger than a range these are all of its rows, 24 bytes
    each, and pass the chaining task one range at a time.

    Weights may not be negative; null ones count as 0. Those that are not integers are taken in millionths, so that sums do
    not depend on their order. ``order`` may have descending columns (``F.desc``). Rows that are equal in it are in that of a hash of
    all columns.
    """
    scratch = scratch or Scratch(df.sparkSession, "pieces")
    kind = df.select(weight.alias("w")).schema["w"].dataType.typeName()
    unit = 1 if kind in ("byte", "short", "integer", "long") else 1_000_000
    size = round(piece * unit)
    if size < 1:
        raise ValueError("pieces must have a weight")
    groups = [f"_g{i}" for i in range(len(by))]
    keyed = df.select("*", F.coalesce(F.round(weight * unit).cast("long"), F.lit(0).cast("long")).alias("_w"), F.xxhash64(*df.columns).alias("_h"), *[c.alias(k) for c, k in zip(by, groups)])
    sort = [*groups, *order, "_h"]
    ranged = keyed.repartitionByRange(*([blocks] if blocks else []), *sort).sortWithinPartitions(*sort)
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranged = ranged.withColumns({"_p": F.spark_partition_id(), "_i": row, "_g": F.xxhash64(F.lit(0), *groups)}).drop("_h", *groups)
    ranged = scratch.keep(ranged, "ranged")
    thin = ranged.select("_p", "_i", "_w", "_g")
    if thin.where("_w < 0").limit(1).count():
        raise ValueError("weights may not be negative")

    def parts(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        pdf = pdf.sort_values("_i")
        group = pdf["_g"].to_numpy()
        limits = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        for a, b in zip(limits, [*limits[1:], len(pdf)]):
            yield int(pdf["_g"].iloc[a]), pdf.iloc[a:b]

    def functions(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(pdf["_p"].iloc[0]), group, *range_function(part["_w"].to_numpy(), size)) for group, part in parts(pdf)]
        return pd.DataFrame(rows, columns=["_p", "_g", "at", "rest", "cuts", "total"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried, before = None, 0, 0
        for batch in batches:
            out = []
            for i, (p, g, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_p", "_g", "total")))):
                if g != group:
                    group, carried, before = g, 0, 0
                out.append((p, g, carried, before))
                at, rest, cuts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("at", "rest", "cuts"))
                k = int(np.searchsorted(at, size - carried, side="left"))
                if k < len(at):
                    carried, before = int(rest[k]), before + int(cuts[k])
                else:
                    carried += total
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 4, names=["_p", "_g", "carried", "before"])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(pdf["_p"].iloc[0]), int(part["_i"].iloc[c])) for _, part in parts(pdf) for c in cuts_from(part["_w"].to_numpy(), size, int(part["carried"].iloc[0]))]
        return pd.DataFrame(rows, columns=["_p", "_i"])

    tables = thin.groupBy("_p").applyInPandas(functions, "_p long, _g long, at array<long>, rest array<long>, cuts array<long>, total long")
    state = scratch.keep(tables.repartition("_g").sortWithinPartitions("_g", "_p").mapInArrow(chain, "_p long, _g long, carried long, before long"), "state")
    cuts = thin.join(state, ["_p", "_g"]).groupBy("_p").applyInPandas(cut, "_p long, _i long").withColumn("_cut", F.lit(1))
    earlier = Window.partitionBy("_p", "_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(scratch.keep(cuts, "cuts"), ["_p", "_i"], "left").join(state, ["_p", "_g"])
    number = F.col("before") + F.coalesce(F.sum("_cut").over(earlier), F.lit(0)) + 1
    return placed.withColumn("piece", number.cast("long")).select(*df.columns, "piece")


def quantile_levels(df: DataFrame, value: Column, parts: int = 4, digits: int | None = None) -> DataFrame:
    """band, lo, hi: levels between exact quantiles (interpolated), both ends inclusive: rows on a cut are in two levels.

    Ranks come from running counts of distinct values, so that no task holds all of them. No values, no levels.
    """
    counts = df.select(value.cast("double").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    placed = running_before(counts, [F.col("v")], F.col("n"), "first").withColumn("last", F.col("first") + F.col("n") - 1)
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(i / parts).alias("q")) for i in range(parts + 1)]))
    at = placed.agg(F.sum("n").alias("total")).where("total > 0").select("total", cut.alias("c")).select("c.i", ((F.col("total") - 1) * F.col("c.q")).alias("at"))
    at = at.select("i", "at", F.floor("at").alias("below"), F.ceil("at").alias("above"))
    holds = lambda rank: F.col(rank).between(F.col("first"), F.col("last"))
    found = placed.join(F.broadcast(at), holds("below") | holds("above")).groupBy("i", "at", "below", "above").agg(F.max(F.when(holds("below"), F.col("v"))).alias("low"), F.max(F.when(holds("above"), F.col("v"))).alias("high"))
    cuts = found.select("i", F.when(F.col("below") == F.col("above"), F.col("low")).otherwise((F.col("above") - F.col("at")) * F.col("low") + (F.col("at") - F.col("below")) * F.col("high")).alias("lo"))
    cuts = cuts.withColumn("lo", F.round("lo", digits)) if digits is not None else cuts
    return cuts.select((F.col("i") + 1).alias("band"), "lo", F.lead("lo").over(Window.orderBy("i")).alias("hi")).where(F.col("band") <= parts)  # a row for each cut


def frequency_levels(n: int, highest: int | None = None, singly: int | None = None) -> list[tuple[str, int, int]]:
    """(name, lo, hi) of allele frequencies among n strains: 1 to ``highest`` (n - 1 if not given; the highest that was found, where
    frequencies are folded), one by one up to three, else three chunks of nearly equal size, the larger ones first.
    With ``singly`` those under it, each alone.
    """
    if singly is not None:
        return [(f"{v}of{n}", v, v) for v in range(1, singly)]
    values = list(range(1, (n - 1 if highest is None else highest) + 1))
    if len(values) <= 3:
        return [(f"{v}of{n}", v, v) for v in values]
    small, extra = divmod(len(values), 3)
    out, at = [], 0
    for i in range(3):
        some = values[at : at + small + (i < extra)]
        at += len(some)
        out.append((f"{some[0]}_{some[-1]}of{n}" if len(some) > 1 else f"{some[0]}of{n}", some[0], some[-1]))
    return out


def floor_bin(value: Column, step: float) -> Column:
    """floor(value / step), in doubles."""
    return F.floor(value.cast("double") / F.lit(float(step)))


def ceil_bin(value: Column, step: int) -> Column:
    return F.ceil(value / step) * step


def share(value: Column, *partition: str) -> Column:
    """A value's share of its partition's sum; null where that is 0."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*partition)))


def rises(value: Column, order: Column, *partition: str) -> Column:
    """Whether a row's value is above the one before it; false for the first."""
    return F.coalesce(value > F.lag(value).over(Window.partitionBy(*partition).orderBy(order)), F.lit(False))
