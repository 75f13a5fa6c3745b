"""Report families over tables of windows, variants and features.

Each is one grouped plan for all the groups of a family. Column names are parameters, so the same
plan serves windows by distance or density, segments, or any table of the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.operators import aggregates as agg
from genolith.operators import buckets as bk


def metrics(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and spread of columns, and the number of rows, by group."""
    return df.groupBy(*by).agg(*agg.mean_and_spread(columns), F.count("*").alias("count"))


def combined_metrics(df: DataFrame, key: str, columns: Sequence[str], threshold: int, standalone: Sequence[int] = (-1, 0), merge_last: bool = False) -> DataFrame:
    """The same by buckets of consecutive keys that hold ``threshold`` rows; avg_key is the mean key of a bucket."""
    buckets = bk.fold(bk.histogram(df, F.col(key)), threshold, standalone, merge_last)
    placed = bk.by_buckets(df, F.col(key), buckets)
    return placed.groupBy("bucket").agg(F.avg(key).alias("avg_key"), *agg.mean_and_spread(columns), F.count("*").alias("count"))


def banded_metrics(df: DataFrame, value: Column, edges: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same by overlapping or separate bands of a value, and further columns."""
    return metrics(bk.by_bands(df, value, edges), ["band", *by], columns)


def length_share(df: DataFrame, key: str, length: str, edges: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bands of a key with the share of all length, in percent, that lies in each."""
    total = df.agg(F.sum(length).alias("_total"))
    placed = bk.by_bands(df, F.col(key), edges).crossJoin(F.broadcast(total))  # one row
    return placed.groupBy("band").agg(*agg.mean_and_spread(columns), F.count("*").alias("count"), F.try_divide(F.sum(length) * 100, F.first("_total")).alias("length_share"))


def density_distance(df: DataFrame, edges: DataFrame, columns: Sequence[str], distance: str = "distance", density: str = "density") -> DataFrame:
    """Density bands by distance, out to half of a band's lower density."""
    placed = bk.by_bands(df, F.col(density), edges).where(F.col(distance) <= (F.col("lo") + 1) / 2)
    return metrics(placed, ["band", distance], columns)


def length_histogram(df: DataFrame, length: str, columns: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Counts by length; ``special`` marks a length that is more frequent than the one before it."""
    counted = df.groupBy(*by, length).agg(F.count("*").alias("count"), *[F.avg(c).alias(f"avg_{c}") for c in columns], F.sum(length).alias("sum_length"))
    return counted.withColumn("special", bk.rises(F.col("count"), F.col(length), *by))


def pair_shares(df: DataFrame, first: str, second: str, by: str) -> DataFrame:
    """Counts of unordered pairs of values by a key, and each pair's share of its key."""
    pair = F.array_join(F.array_sort(F.array(first, second)), "")
    counted = df.groupBy(by, pair.alias("pair")).agg(F.count("*").alias("count"))
    return counted.withColumn("share", bk.share(F.col("count"), by))


def sorted_pieces(df: DataFrame, order: Sequence[Column], weight: Column, piece: float, columns: Sequence[str]) -> DataFrame:
    """Rows in order, cut by running weight, with each piece's metrics."""
    placed = bk.pieces(df, order, weight, piece)
    return placed.groupBy("piece").agg(*agg.mean_and_spread(columns), F.count("*").alias("count"))


def level_pieces(df: DataFrame, levels: Sequence[str], order: Sequence[Column], length: str, piece: float, measures: dict[str, Column]) -> DataFrame:
    """Rows of each level in order, cut greedily into pieces of ``piece`` length: levels, piece, the means of ``measures``, count, sum_length."""
    placed = bk.greedy_pieces(df, order, F.col(length), piece, [F.col(c) for c in levels])
    return placed.groupBy(*levels, "piece").agg(*[F.avg(v).alias(f"avg_{k}") for k, v in measures.items()], F.count("*").alias("count"), F.sum(length).alias("sum_length"))


def level_fits(pieces: DataFrame, levels: Sequence[str], x: str, ys: Sequence[str]) -> DataFrame:
    """levels, y, n, r2, intercept, slope, p: the line of each measure on x over a level's pieces, all in one pass; p of its F test."""
    each = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.col(y).cast("double").alias("v")) for y in ys])).alias("e")
    stacked = pieces.select(*levels, F.col(x).alias("x"), each).select(*levels, "x", "e.*").where("x IS NOT NULL AND v IS NOT NULL")
    fits = stacked.groupBy(*levels, "y").agg(F.count("*").alias("n"), *agg.line_fit(F.col("v"), F.col("x")))

    @F.pandas_udf("double")
    def p_value(r2: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([agg.line_p_value(None if pd.isna(a) else a, int(b)) for a, b in zip(r2, n)], dtype="float64")

    return fits.withColumn("p", p_value("r2", "n"))


def quantile_metrics(df: DataFrame, value: str, by: Sequence[str], columns: Sequence[str], parts: int = 4, digits: int | None = None) -> DataFrame:
    """Metrics by quantile level (a row on a cut counts in both) and further columns."""
    return banded_metrics(df, F.col(value), bk.quantile_levels(df, F.col(value), parts, digits), by, columns)


def first_groups(df: DataFrame, by: str, n: int, aggregates: Sequence[Column], within: Sequence[str] = ()) -> DataFrame:
    """The first n groups in the order of the key, of each outer group."""
    grouped = df.groupBy(*within, by).agg(*aggregates)
    if not within:
        return grouped.orderBy(by).limit(n)
    return grouped.withColumn("_n", F.row_number().over(Window.partitionBy(*within).orderBy(by))).where(F.col("_n") <= n).drop("_n")


def labelled_counts(df: DataFrame, labels: dict[str, Column], columns: Sequence[str] = ()) -> DataFrame:
    """Groupings by several labellings of the same rows, one under the other: name, label, count, averages.

    Rows are stacked with their labels, so the table is read and shuffled once.
    """
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("label")) for k, v in labels.items()])).alias("x"), *columns).select("x.*", *columns)
    return stacked.groupBy("name", "label").agg(F.count("*").alias("count"), *[F.avg(c).alias(f"avg_{c}") for c in columns])


def bit_counts(df: DataFrame, bits: str, by: Sequence[str] = ()) -> DataFrame:
    """Number of '1' at each position (from 1) of bit strings; strings with other characters (such as ``unknown``) are left out."""
    known = df.where(F.col(bits).rlike("^[01]+$"))
    at = known.select(*by, F.posexplode(F.split(F.regexp_replace(bits, "(?<=.)(?=.)", ","), ",")).alias("position", "bit"))
    return at.groupBy(*by, (F.col("position") + 1).alias("position")).agg(F.sum((F.col("bit") == "1").cast("long")).alias("count"))


def _linkage(n: Column, a: Column, b: Column, ab: Column) -> tuple[Column, Column]:
    """(r, D') from counts: of strains, of those with the first, the second, and both; null where either is monomorphic."""
    pa, pb = F.try_divide(a, n), F.try_divide(b, n)
    d = F.try_divide(ab, n) - pa * pb
    top = F.when(d >= 0, F.least(pa * (1 - pb), (1 - pa) * pb)).otherwise(F.least(pa * pb, (1 - pa) * (1 - pb)))
    poly = (pa > 0) & (pa < 1) & (pb > 0) & (pb < 1)
    return F.when(poly, d / F.sqrt(pa * (1 - pa) * pb * (1 - pb))), F.when(poly, F.try_divide(d, top))


def linkage(x: Column, y: Column) -> tuple[Column, Column]:
    """(r, D') of two bit strings of the same length; null where either is monomorphic or unknown."""
    ok = x.rlike("^[01]+$") & y.rlike("^[01]+$") & (F.length(x) == F.length(y))
    n = F.length(x).cast("double")
    ones = lambda c: F.length(F.regexp_replace(c, "0", ""))
    both = F.length(F.regexp_replace(F.array_join(F.zip_with(F.split(x, "(?<=.)(?=.)"), F.split(y, "(?<=.)(?=.)"), lambda a, b: F.when((a == "1") & (b == "1"), "1").otherwise("0")), ""), "0", ""))
    return tuple(F.when(ok, v) for v in _linkage(n, ones(x), ones(y), both))


#: Bits of a packed word.
WORD = 62


def pack_bits(bits: Column) -> Column:
    """A string of 0 and 1 as (n, words), words being longs of WORD bits; null for other strings."""
    words = F.transform(F.sequence(F.lit(0), F.ceil(F.length(bits) / WORD).cast("int") - 1), lambda i: F.conv(F.substring(bits, i * WORD + 1, F.lit(WORD)), 2, 10).cast("long"))
    return F.when(bits.rlike("^[01]+$"), F.struct(F.length(bits).alias("n"), words.alias("words")))


def complement_bits(packed: Column) -> Column:
    """The packed bits of the strains that are not in the first."""
    width = lambda i: F.least(packed["n"] - i * WORD, F.lit(WORD)).cast("int")
    words = F.transform(packed["words"], lambda w, i: F.call_function("shiftleft", F.lit(1).cast("long"), width(i)) - 1 - w)
    return F.when(packed.isNotNull(), F.struct(packed["n"].alias("n"), words.alias("words")))


def linkage_packed(x: Column, y: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """``linkage`` of packed bits, among the strains of a mask (packed bits too) if there is one: ANDs and bit counts of words."""
    both = lambda a, b: F.zip_with(a, b, lambda u, v: u.bitwiseAND(v))
    ones = lambda w: F.aggregate(w, F.lit(0), lambda t, v: t + F.bit_count(v))
    ok = x["n"] == y["n"]
    a, b, n = x["words"], y["words"], x["n"]
    if mask is not None:
        ok &= x["n"] == mask["n"]
        a, b, n = both(a, mask["words"]), both(b, mask["words"]), ones(mask["words"])
    return tuple(F.when(ok, v) for v in _linkage(n.cast("double"), ones(a), ones(b), ones(both(a, b))))


def letter_runs(sequence: Column, k: int) -> Column:
    """All runs of k letters ACGT, in one pass of a regular expression: substring counts from the start each time, the square of a sequence's length."""
    return F.regexp_extract_all(sequence, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def canonical_kmers(df: DataFrame, sequence: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """k-mers with their reverse complements as one: kmer, gc, count, freq; those with other letters than ACGT are left out."""
    grams = df.select(*by, F.explode(letter_runs(F.col(sequence), k)).alias("s"))
    # counted before they are merged: at most 4 ** k groups meet
    counted = grams.groupBy(*by, "s").agg(F.count("*").alias("n"))
    other = F.reverse(F.translate("s", "ACGT", "TGCA"))
    merged = counted.groupBy(*by, F.concat_ws(",", F.least("s", other), F.greatest("s", other)).alias("kmer")).agg(F.sum("n").alias("count"))
    gc = F.length(F.regexp_replace(F.substring("kmer", 1, k), "[AT]", "")) / F.lit(float(k))
    return merged.withColumn("gc", gc).withColumn("freq", F.col("count") / F.sum("count").over(Window.partitionBy(*by)))


def slippage(inserted: Column, left: Column, right: Column, least: int = 4) -> Column:
    """1 where an indel extends a run (one base, at least ``least`` times with its flanks) or repeats the flank of its own length, else 0; null for an empty one."""
    n = F.length(inserted)
    run = F.concat(F.substring(left, -least, least), inserted, F.substring(right, 1, least))
    single = F.contains(run, F.repeat(inserted, F.lit(least)))
    longer = (F.when(F.length(left) >= n, F.expr("1")).isNotNull() & (F.right(left, n) == inserted)) | (F.left(right, n) == inserted)
    return F.when(n > 0, F.when(n == 1, single).otherwise(longer).cast("int"))


def cpg(mutant_to: Column, left: Column, right: Column) -> Column:
    """1 for C->T before G and G->A after C, else 0."""
    return F.coalesce(((mutant_to == "C->T") & (right == "G")) | ((mutant_to == "G->A") & (left == "C")), F.lit(False)).cast("int")
