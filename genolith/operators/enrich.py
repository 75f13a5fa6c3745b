"""What is derived from the tables of an alignment: windows, waves, segments, annotation, linkage, codons.

Windows are made and placed with DataFrame functions. Bases are counted in blocks of columns (``sequences.Store``), never in a
whole sequence for each window. Functions that take ``sequences`` take the table or a store of it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.functions import genetics as g
from genolith.functions import intervals as iv
from genolith.operators import joins
from genolith.operators.sequences import Store
from genolith.plans import reports as rp

def interval_windows(a: str, b: str, size: int = 100) -> Column:
    """Windows of an interval between indels (start, end, type, distance, density): one S at -1 if under two windows long, else L and R
    from both ends inward; the rest goes to the innermost L."""
    n, m = f"({b} - {a} + 1)", f"CAST(({b} - {a} + 1) div {size} AS int)"
    window = lambda start, end, kind, distance: f"named_struct('start', CAST({start} AS int), 'end', CAST({end} AS int), 'type', '{kind}', 'distance', {distance}, 'density', {m} - 1)"
    left = window(f"{a} + {size} * k", f"{a} + {size} * k + {size - 1} + CASE WHEN k = ({m} + 1) div 2 - 1 THEN {n} - {size} * {m} ELSE 0 END", "L", "k")
    right = window(f"{b} - {size} * k - {size - 1}", f"{b} - {size} * k", "R", "k")
    counted = lambda many: f"sequence(0, CAST({many} AS int) - 1)"
    return F.expr(f"CASE WHEN {n} <= 0 THEN array() WHEN {m} < 2 THEN array({window(a, b, 'S', -1)}) ELSE concat(transform({counted(f'({m} + 1) div 2')}, k -> {left}), transform({counted(f'{m} div 2')}, k -> {right})) END")


def _feature_windows(*args) -> Column:
    kind = "array<struct<start:int,end:int,type:string,distance:int>>"
    return F.udf(lambda a, b, low, high, style: g.feature_windows(a, b, low, high, style), kind, useArrow=True)(*args)


def gc_spread(windows: DataFrame, order: str = "k", *keys: str) -> DataFrame:
    """keys, mean, std, cv, mdcw of the gc of sub-windows: mean, spread of the sample, that by the mean's distance from 0 or 1, and the mean step
    from one to the next. Sub-windows without bases are left out; with one only, all but the mean are null."""
    known = windows.where("gc IS NOT NULL").withColumn("_step", F.abs(F.col("gc") - F.lag("gc").over(Window.partitionBy(*keys).orderBy(order))))
    x = known.groupBy(*keys).agg(F.avg("gc").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("gc")).alias("std"), F.avg("_step").alias("mdcw"))
    return x.select(*keys, "mean", "std", F.try_divide("std", F.when(F.col("mean") <= 0.5, F.col("mean")).otherwise(1 - F.col("mean"))).alias("cv"), "mdcw")


def sub_window_spread(spans: DataFrame, ident: str, first: str, length: str, store: Store, size: int, step: int, ranks: bool) -> DataFrame:
    """ident and ``gc_spread`` of the sub-windows of spans (align_id, ident, first, length), in columns or in ranks of the comparable set."""
    subs = spans.where(F.col(length) >= size).select("align_id", ident, F.col(first).alias("_first"), F.posexplode(F.sequence(F.lit(0), F.col(length) - size, F.lit(step))).alias("k", "_at"))
    subs = subs.select("align_id", ident, "k", (F.col("_first") + F.col("_at")).alias("_start")).withColumns({"_end": F.col("_start") + size - 1, "_sub": F.xxhash64(ident, "k")})
    if ranks:
        subs = store.column_of(subs, "free", _a="_start", _b="_end")
    a, b = ("_a", "_b") if ranks else ("_start", "_end")
    gc = F.try_divide("gc_of_free", "bases_of_free") if ranks else F.try_divide("gc", "bases")
    counted = store.sums(subs, "_sub", a, b).select("_sub", gc.alias("gc"))
    return gc_spread(subs.select("_sub", ident, "k").join(counted, "_sub"), "k", ident)


def isw_table(indels: DataFrame, sequences: DataFrame | Store) -> DataFrame:
    """Windows between neighbouring indels: L, R or S; the nearest indel is the left one for L and S, the right one for R."""
    w = Window.partitionBy("align_id").orderBy("indel_start")
    between = indels.select("align_id", "indel_id", F.lag("indel_id").over(w).alias("prev_indel_id"), (F.lag("indel_end").over(w) + 1).alias("a"), (F.col("indel_start") - 1).alias("b")).where("a <= b")
    x = between.select("align_id", "indel_id", "prev_indel_id", F.explode(interval_windows("a", "b")).alias("w")).withColumn("isw_id", F.xxhash64("align_id", "w.start", "w.end"))
    stats = Store.of(sequences).stats(x.select("align_id", "isw_id", "w.start", "w.end"), "isw_id", "start", "end")
    return x.join(stats, "isw_id").select(
        "isw_id", "indel_id", "prev_indel_id", "align_id", F.when(F.col("w.type") == "R", F.col("indel_id")).otherwise(F.col("prev_indel_id")).alias("isw_indel_id"),
        F.col("w.start").alias("isw_start"), F.col("w.end").alias("isw_end"), (F.col("w.end") - F.col("w.start") + 1).alias("isw_length"), F.col("w.type").alias("isw_type"), F.col("w.distance").alias("isw_distance"), F.col("w.density").alias("isw_density"),
        F.col("differences").cast("int").alias("isw_differences"), F.col("pi").alias("isw_pi"), F.col("gc").alias("isw_gc"),
    )


def snp_windows(snps: DataFrame, isw: DataFrame, width: int = 1000) -> DataFrame:
    """snps with the isw_id that holds them, the smallest if several, null for none."""
    spans = isw.select("align_id", "isw_id", "isw_start", "isw_end")
    return joins.binned_interval_join(snps.drop("isw_id"), spans, ["align_id"], "snp_pos", "isw_start", "isw_end", width, "left", "isw_id").drop("isw_start", "isw_end")


def d_terms(group: Column, bases: Column, outgroup: Column) -> Column:
    """What one SNP adds to the D values of a window, as a struct (indel, noindel, bii, bnn, complex, second, third).

    ``group`` and ``bases`` have a character for each sequence: 1 or 0, whether it has the indel, and its base. The five
    are means over pairs: one of each group with only the first, or only the second derived (other than the outgroup's base); two of one group
    with one derived; any two with different derived bases. ``second`` is whether no group is fixed for one derived base;
    ``third`` is that, or a fixed base that the other group has too.
    """
    each = F.arrays_zip(F.split(group, "").alias("g"), F.split(bases, "").alias("b"))
    of = lambda bit: F.transform(F.filter(each, lambda x: x["g"] == bit), lambda x: x["b"])
    both = F.struct(of("1").alias("one"), of("0").alias("two"), F.array_distinct(F.filter(F.split(bases, ""), lambda x: x != outgroup)).alias("derived"))
    times = lambda xs, b: F.size(F.filter(xs, lambda x: x == b)).cast("double")
    pairs = lambda n: n * (n - 1) / 2
    over = lambda x, n: F.when(n > 0, x / n).otherwise(0.0)

    def terms(x: Column) -> Column:
        one, two, derived = x["one"], x["two"], x["derived"]
        n, m = F.size(one).cast("double"), F.size(two).cast("double")
        i, j = n - times(one, outgroup), m - times(two, outgroup)
        alike = lambda f: F.aggregate(derived, F.lit(0.0), f)
        differ = i * j - alike(lambda t, b: t + times(one, b) * times(two, b))
        differ = differ + pairs(i) - alike(lambda t, b: t + pairs(times(one, b))) + pairs(j) - alike(lambda t, b: t + pairs(times(two, b)))
        fixed = lambda xs: (F.size(F.array_distinct(xs)) == 1) & (F.get(xs, F.lit(0)) != outgroup)
        free = ~fixed(one) & ~fixed(two)
        shared = F.when(fixed(one), F.array_contains(two, F.get(one, F.lit(0)))).when(fixed(two), F.array_contains(one, F.get(two, F.lit(0)))).otherwise(True)
        return F.struct(
            over(i * (m - j), n * m).alias("indel"), over((n - i) * j, n * m).alias("noindel"), over(i * (n - i), pairs(n)).alias("bii"), over(j * (m - j), pairs(m)).alias("bnn"),
            over(differ, pairs(n + m)).alias("complex"), free.alias("second"), shared.alias("third"),
        )

    return F.get(F.transform(F.array(both), terms), F.lit(0))


def d_values(isw: DataFrame, indels: DataFrame, snps: DataFrame) -> DataFrame:
    """isw_id and 15 D columns: sums of ``d_terms`` over a window's SNPs by its length, of all, of the second and of the third kind.

    A window without SNPs has zeros. Null where the indel is ``unknown`` or all sequences are on one side of it. SNPs without an
    outgroup base count nowhere. SNPs of three bases, whose own state is unknown, count like others.
    """
    rows = isw.select("isw_id", "isw_indel_id", "isw_length").join(indels.selectExpr("indel_id AS isw_indel_id", "indel_occured"), "isw_indel_id")
    known = F.col("indel_occured").rlike("^[01]+$") & F.contains("indel_occured", F.lit("0")) & F.contains("indel_occured", F.lit("1"))
    some = snps.where("isw_id IS NOT NULL AND snp_outgroup_base <> ''").select("isw_id", "snp_outgroup_base", "snp_all_bases").join(rows.where(known), "isw_id")
    x = some.select("isw_id", d_terms(F.col("indel_occured"), F.col("snp_all_bases"), F.col("snp_outgroup_base")).alias("x")).select("isw_id", "x.*")
    kinds = {"": F.lit(True), "2": F.col("second"), "3": F.col("third")}
    sums = x.groupBy("isw_id").agg(*[F.sum(F.when(when, F.col(c))).alias(f"_{c}{k}") for k, when in kinds.items() for c in ("indel", "noindel", "bii", "bnn", "complex")])
    value = lambda n: F.when(known, F.coalesce(F.col(f"_{n}"), F.lit(0.0)) / F.col("isw_length")).alias(f"isw_d_{n}")
    return rows.join(sums, "isw_id", "left").select("isw_id", *[value(c + k) for k in kinds for c in ("indel", "noindel", "bii", "bnn", "complex")])


def window_table(windows: DataFrame, ident: str, sequences: DataFrame | Store, start: str = "window_start", end: str = "window_end", of_set: bool = True) -> DataFrame:
    """window_id (``ident``), align_id, window_start, window_end (alignment columns), window_length, window_comparables, window_identities,
    window_differences, window_indel, window_pi, window_gc.

    With ``of_set`` a window is the comparable columns between its ends: its indels are the breaks of that set. Else it is all
    columns, and its indels are the runs of gaps in it less one, as gaps at its edge belong to its neighbours.
    """
    s = Store.of(sequences).stats(windows.select("align_id", ident, start, end), ident, start, end)
    x = windows.select("align_id", F.col(ident).alias("window_id"), F.col(start).alias("window_start"), F.col(end).alias("window_end")).join(s.withColumnRenamed(ident, "window_id"), "window_id")
    indels = F.col("gap_runs") if of_set else F.greatest(F.col("gap_runs") - 1, F.lit(0))
    counts = [F.col(c).cast("int").alias(f"window_{c}") for c in ("comparables", "identities", "differences")]
    return x.select("window_id", "align_id", "window_start", "window_end", (F.col("window_end") - F.col("window_start") + 1).alias("window_length"), *counts, indels.cast("int").alias("window_indel"), F.col("pi").alias("window_pi"), F.col("gc_of_free" if of_set else "gc").alias("window_gc"))


def segment_table(aligns: DataFrame, sequences: DataFrame | Store, config: Config = Config()) -> DataFrame:
    """Consecutive slices of the comparable set, a short tail left out, with the gc of their sub-windows; positions are alignment columns."""
    store = Store.of(sequences)
    styles = F.explode(F.array(*[F.struct(F.lit(str(t)).alias("type"), F.lit(n).alias("size")) for t, n in config.segment_styles.items()]))
    sized = store.sizes("free").join(aligns.select("align_id"), "align_id", "left_semi").select("align_id", F.col("size").alias("n"), styles.alias("x"))
    cut = sized.select("align_id", "x.type", "x.size", F.floor(F.col("n") / F.col("x.size")).cast("int").alias("n")).where("n > 0")
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("first", F.col("i") * F.col("size") + 1).withColumns({"last": F.col("first") + F.col("size") - 1, "segment_id": F.xxhash64("align_id", "type", "first")})
    spread = sub_window_spread(cut, "segment_id", "first", "size", store, config.stat_window_size, config.stat_window_step, ranks=True)
    placed = store.column_of(cut, "free", window_start="first", window_end="last").select("segment_id", F.col("segment_id").alias("window_id"), "align_id", F.col("type").alias("segment_type"), "window_start", "window_end")
    return placed.join(spread, "segment_id", "left").select(*placed.columns, *[F.col(c).alias(f"segment_gc_{c}") for c in ("mean", "std", "cv", "mdcw")])


def wave_windows(store: Store, config: Config = Config()) -> DataFrame:
    """align_id, k, rank_start, gc, last: sliding windows over the comparable set, k from 0 to ``last``."""
    size, step = config.wave_window_size, config.wave_window_step
    many = store.sizes("free").where(F.col("size") >= size).select("align_id", "size", F.floor((F.col("size") - size) / step).cast("int").alias("last"))
    x = many.select("align_id", "size", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("k"))
    x = x.withColumns({"rank_start": F.col("k") * step + 1, "rank_end": F.col("k") * step + size, "wave_id": F.xxhash64("align_id", "k")})
    placed = store.column_of(x, "free", a="rank_start", b="rank_end")
    counted = store.sums(placed, "wave_id", "a", "b").select("wave_id", F.try_divide("gc_of_free", "bases_of_free").alias("gc"))
    return x.join(counted, "wave_id").select("align_id", "k", "rank_start", "rank_end", "gc", "last", "size")


def wave_flags(waves: DataFrame, around: int, fall: float, chunk: int = 10_000) -> DataFrame:
    """Windows that are a trough (T) or crest (C), with ``flag``; flags take turns in each alignment.

    A window is a trough (crest) if its gc is the least (most) within ``around`` windows on both sides, with a rise (fall) of ``fall`` or
    more on both; of several in a row of one kind the most extreme stays, of equal ones the first. Windows of an alignment are
    dealt into chunks, each with its neighbours' windows as far as it looks, so that no task sees a whole alignment; only
    flagged windows are put in a row.
    """
    of = lambda k: F.floor(k / max(chunk, around)).cast("int")
    dealt = waves.withColumn("_chunk", F.explode(F.array_distinct(F.array(of(F.col("k") - around), of(F.col("k")), of(F.col("k") + around)))))
    w = Window.partitionBy("align_id", "_chunk").orderBy("k")
    sides = {"b": w.rowsBetween(-around, -1), "a": w.rowsBetween(1, around)}
    seen = dealt.withColumns({f"_{name}{s}": f("gc").over(side) for s, side in sides.items() for name, f in (("lo", F.min), ("hi", F.max))}).where(F.col("_chunk") == of(F.col("k")))
    gc = F.col("gc")
    inside = gc.isNotNull() & F.col("_lob").isNotNull() & F.col("_loa").isNotNull()
    trough = inside & (gc <= F.least("_lob", "_loa")) & (F.col("_hib") - gc >= fall) & (F.col("_hia") - gc >= fall)
    crest = inside & (gc >= F.greatest("_hib", "_hia")) & (gc - F.col("_lob") >= fall) & (gc - F.col("_loa") >= fall)
    found = seen.withColumn("flag", F.when(trough, "T").when(crest, "C")).where("flag IS NOT NULL").select(*waves.columns, "flag")
    along = Window.partitionBy("align_id").orderBy("k")
    turn = found.withColumn("_turn", F.coalesce(F.col("flag") != F.lag("flag").over(along), F.lit(True)).cast("int")).withColumn("_turn", F.sum("_turn").over(along))
    best = Window.partitionBy("align_id", "_turn").orderBy(F.when(F.col("flag") == "T", gc).otherwise(-gc), "k")
    return turn.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_turn")


def extreme_table(aligns: DataFrame, sequences: DataFrame | Store, config: Config = Config()) -> DataFrame:
    """Troughs and crests of the gc wave with wave lengths and amplitudes to the neighbours; positions are ranks in the comparable set.

    The first and last extreme of an alignment measure their outer amplitude to its first and last window, and
    their outer wave length from their middle to the ends of the comparable set.
    """
    store = Store.of(sequences)
    half = config.wave_window_size // 2
    waves = store.scratch.keep(wave_windows(store, config).join(aligns.select("align_id"), "align_id", "left_semi"), f"waves_{config.wave_window_size}_{config.wave_window_step}")
    ends = waves.where("k = 0 OR k = last").groupBy("align_id").agg(F.max(F.when(F.col("k") == 0, F.col("gc"))).alias("first_gc"), F.max(F.when(F.col("k") == F.col("last"), F.col("gc"))).alias("last_gc"))
    flagged = wave_flags(waves, max(1, config.vicinal_size // config.wave_window_step), config.fall_range)
    x = flagged.join(ends, "align_id").withColumnRenamed("flag", "extreme_type")
    w = Window.partitionBy("align_id").orderBy("rank_start")
    x = x.withColumn("extreme_id", F.xxhash64("align_id", "rank_start"))
    middle = F.col("rank_start") + half - 1
    amplitude = lambda f, end: F.abs(F.col("gc") - F.coalesce(f("gc").over(w), F.col(end)))
    left = F.coalesce(F.col("rank_start") - F.lag("rank_start").over(w), middle)
    right = F.coalesce(F.lead("rank_start").over(w) - F.col("rank_start"), F.col("size") - middle)
    return x.select(
        "extreme_id", F.coalesce(F.lag("extreme_id").over(w), F.lit(0).cast("long")).alias("prev_extreme_id"), "align_id", "extreme_type", "rank_start", "rank_end", F.col("gc").alias("extreme_gc"),
        amplitude(F.lag, "first_gc").alias("extreme_left_amplitude"), amplitude(F.lead, "last_gc").alias("extreme_right_amplitude"), left.alias("extreme_left_wave_length"), right.alias("extreme_right_wave_length"),
    )


def gsw_table(extremes: DataFrame, config: Config = Config()) -> DataFrame:
    """Windows between neighbouring extremes, ascending (A) after a trough, descending (D) before one, and the extremes themselves."""
    size = config.gsw_size
    w = Window.partitionBy("align_id").orderBy("rank_start")
    x = extremes.select("*", F.lag("rank_start").over(w).alias("p_start"), F.lag("extreme_gc").over(w).alias("p_gc"), F.lag("extreme_type").over(w).alias("p_type")).where("p_start IS NOT NULL AND p_type <> extreme_type")
    density = ((F.col("extreme_left_wave_length") - size // 2) / size).cast("int")
    rises = F.col("p_type") == "T"
    x = x.withColumn("density", density).where("density >= 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("density") + 1)))
    # k counts from the extreme before; distance counts from the trough
    distance = F.when(rises, F.col("k")).otherwise(F.col("density") + 1 - F.col("k"))
    kind = F.when(distance == 0, "T").when(distance == F.col("density") + 1, "C").when(rises, "A").otherwise("D")
    trough, crest = F.when(rises, F.col("p_gc")).otherwise(F.col("extreme_gc")), F.when(rises, F.col("extreme_gc")).otherwise(F.col("p_gc"))
    start = F.when(F.col("k") == F.col("density") + 1, F.col("rank_start")).otherwise(F.col("p_start") + F.col("k") * size)
    return x.select(F.xxhash64("extreme_id", "k").alias("gsw_id"), "extreme_id", "prev_extreme_id", "align_id", kind.alias("gsw_type"), distance.alias("gsw_distance"), (F.col("density") - distance + 1).alias("gsw_distance_crest"), F.col("extreme_left_wave_length").alias("gsw_wave_length"), F.col("extreme_left_amplitude").alias("gsw_amplitude"), trough.alias("gsw_trough_gc"), crest.alias("gsw_crest_gc"), F.try_divide(F.col("extreme_left_amplitude"), F.col("extreme_left_wave_length") * F.lit(1e-5)).cast("int").alias("gsw_gradient"), start.alias("rank_start"), (start + size - 1).alias("rank_end"))


def window_cv(windows: DataFrame, ident: str, sequences: DataFrame | Store, start: str, end: str, config: Config = Config(), name: str = "cv", ranks: bool = False) -> DataFrame:
    """windows with the gc cv of a segment around their middle, moved inside the ends; start and end are columns, or ranks in the comparable set."""
    store, n = Store.of(sequences), config.stat_segment_size
    ends = store.sizes("free") if ranks else store.blocks.groupBy("align_id").agg(F.max(F.col("block") * store.size + F.length(F.get("rows", 0)) - 1).cast("int").alias("size"))
    first = F.greatest(F.least(F.floor((F.col(start) + F.col(end)) / 2 - n / 2 + 1).cast("int"), F.col("size") - n + 1), F.lit(1))
    spans = windows.join(ends, "align_id").select("align_id", ident, first.alias("first"), F.least(F.lit(n), "size").alias("length"))
    spread = sub_window_spread(spans, ident, "first", "length", store, config.stat_window_size, config.stat_window_step, ranks)
    return windows.join(spread.select(ident, F.col("cv").alias(name)), ident, "left")


def intra_cv(windows: DataFrame, ident: str, sequences: DataFrame | Store, start: str, end: str, name: str = "intra_cv", size: int = 20, step: int = 20, ranks: bool = False) -> DataFrame:
    """windows with the gc cv of the small sub-windows that they consist of."""
    spans = windows.select("align_id", ident, F.col(start).alias("first"), (F.col(end) - F.col(start) + 1).alias("length"))
    spread = sub_window_spread(spans, ident, "first", "length", Store.of(sequences), size, step, ranks)
    return windows.join(spread.select(ident, F.col("cv").alias(name)), ident, "left")


def chr_positions(sequences: DataFrame) -> DataFrame:
    """align_id, spans, chr_start, chr_end, chr_strand, chr_name of targets: what maps alignment columns to chromosomes."""
    return sequences.where("seq_role = 'T'").select("align_id", iv.parse(F.col("seq_runlist")).alias("spans"), "chr_name", "chr_start", "chr_end", "chr_strand")


def align_to_chr(spans: Column, at: Column, start: Column, end: Column, strand: Column) -> Column:
    """Chromosome position of an alignment column; one in a gap takes that of the base before it (``end`` side on strand -)."""
    seen = F.aggregate(spans, F.lit(0), lambda a, s: a + F.greatest(F.least(s["end"], at) - s["start"] + 1, F.lit(0)))
    return F.when(strand == "-", end - seen + 1).otherwise(start + seen - 1)


def chr_to_align(spans: Column, position: Column, start: Column, end: Column, strand: Column) -> Column:
    """Alignment column of a chromosome position, null outside."""
    return iv.at(spans, F.when(strand == "-", end - position + 1).otherwise(position - start + 1))


def feature_portions(windows: DataFrame, features: DataFrame, ident: str, start: str, end: str, kinds: tuple[str, ...] = ("cds", "repeat"), width: int = 10_000) -> DataFrame:
    """ident and for each kind the share of the window's positions in features; windows and features have chr_name.

    Windows and features meet by bins that both touch, once for the first bin they have in common. Features of a kind
    may not overlap each other.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    w = windows.select(ident, "chr_name", F.col(start).alias("ws"), F.col(end).alias("we")).withColumn("bin", bins("ws", "we"))
    f = features.select("chr_name", "kind", F.col("start").alias("fs"), F.col("end").alias("fe")).withColumn("bin", bins("fs", "fe"))
    meet = w.join(f, ["chr_name", "bin"]).where((F.col("fs") <= F.col("we")) & (F.col("ws") <= F.col("fe")) & (F.col("bin") == F.greatest(F.floor(F.col("ws") / width), F.floor(F.col("fs") / width))))
    shared = F.least("we", "fe") - F.greatest("ws", "fs") + 1
    sums = meet.groupBy(ident).agg(*[F.sum(F.when(F.col("kind") == k, shared)).alias(k) for k in kinds])
    size = F.col(end) - F.col(start) + 1
    return windows.select(ident, size.alias("_n")).join(sums, ident, "left").select(ident, *[F.when(F.col("_n") > 0, F.coalesce(F.col(k), F.lit(0)) / F.col("_n")).alias(k) for k in kinds])


def portions_on_chr(table: DataFrame, ident: str, start: str, end: str, targets: DataFrame, features: DataFrame, prefix: str) -> DataFrame:
    """ident, ``prefix``_coding and ``prefix``_repeats: ``feature_portions`` of what the target has at alignment columns start..end.

    ``targets`` is what ``chr_positions`` gives. A column in a gap stands for the base before it.
    """
    x = table.select(ident, "align_id", F.col(start).alias("_a"), F.col(end).alias("_b")).join(targets, "align_id")
    at = lambda c: align_to_chr(F.col("spans"), F.col(c), F.col("chr_start"), F.col("chr_end"), F.col("chr_strand"))
    x = x.select(ident, "chr_name", at("_a").alias("_x"), at("_b").alias("_y")).select(ident, "chr_name", F.least("_x", "_y").alias("_start"), F.greatest("_x", "_y").alias("_end"))
    return feature_portions(x, features, ident, "_start", "_end").select(ident, F.col("cds").alias(f"{prefix}_coding"), F.col("repeat").alias(f"{prefix}_repeats"))


def indel_slippage(indels: DataFrame, sequences: DataFrame | Store) -> DataFrame:
    """indel_id, indel_slippage; flanks are the target's, as far as no other indel is nearer."""
    n = F.when(F.length("indel_seq") == 1, F.lit(4)).otherwise(F.length("indel_seq"))
    x = indels.where("indel_seq <> ''")
    side = lambda name, there, a, b: F.when(there, F.struct(F.lit(name).alias("side"), a.alias("a"), b.alias("b")))
    both = F.array(side("l", F.col("left_extand") >= n, F.col("indel_start") - n, F.col("indel_start") - 1), side("r", F.col("right_extand") >= n, F.col("indel_end") + 1, F.col("indel_end") + n))
    flanks = x.select("align_id", "indel_id", F.explode(F.filter(both, lambda s: s.isNotNull())).alias("s")).select("align_id", "indel_id", "s.*")
    found = Store.of(sequences).slices(flanks, ["indel_id", "side"], "a", "b", first_only=True).groupBy("indel_id").agg(*[F.max(F.when(F.col("side") == s, F.get("slices", 0))).alias(s) for s in "lr"])
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return x.select("indel_id", "indel_seq").join(found, "indel_id", "left").select("indel_id", rp.slippage(F.col("indel_seq"), blank("l"), blank("r")).alias("indel_slippage"))


def snp_cpg(snps: DataFrame, sequences: DataFrame | Store) -> DataFrame:
    """snp_id, snp_cpg by the target's neighbours."""
    x = snps.select("align_id", "snp_id", F.greatest(F.col("snp_pos") - 1, F.lit(1)).alias("a"), (F.col("snp_pos") + 1).alias("b"))
    found = Store.of(sequences).slices(x, ["snp_id"], "a", "b", first_only=True).select("snp_id", F.get("slices", 0).alias("s"))
    y = snps.select("snp_id", "snp_pos", "snp_mutant_to").join(found, "snp_id")
    at = F.when(F.col("snp_pos") > 1, 2).otherwise(1)
    return y.select("snp_id", rp.cpg(F.col("snp_mutant_to"), F.when(F.col("snp_pos") > 1, F.left("s", F.lit(1))), F.substring("s", at + 1, F.lit(1))).alias("snp_cpg"))


def isw_cpg(isw: DataFrame, snps: DataFrame) -> DataFrame:
    """isw_id, isw_cpg_pi: CpG substitutions by length, 0 without any."""
    n = snps.where("snp_cpg = 1").groupBy("isw_id").agg(F.count("*").alias("n"))
    return isw.select("isw_id", "isw_length").join(n, "isw_id", "left").select("isw_id", (F.coalesce("n", F.lit(0)) / F.col("isw_length")).alias("isw_cpg_pi"))


def _pair_ld(x: DataFrame, keys: list[str], near: int, masks: dict[str, str]) -> DataFrame:
    """keys, low, high, and r2_m, dprime_abs_m for each mask m (a column of the keys, or none) of pairs of SNPs at most ``near`` apart."""
    pairs = joins.pairs_within(x, keys, "snp_pos", "snp_id", near)
    out = [*keys, F.col("snp_pos_a").alias("low"), F.col("snp_pos_b").alias("high")]
    for name, mask in masks.items():
        r, dprime = rp.linkage_packed(F.col("bits_a"), F.col("bits_b"), F.col(f"{mask}_a") if mask else None)
        out += [(r * r).alias(f"r2_{name}"), F.when(r.isNotNull(), F.abs(dprime)).alias(f"dprime_abs_{name}")]
    return pairs.select(*out)


def neighbour_ld(snps: DataFrame, near: int = 100) -> DataFrame:
    """snp_id, near_snp_number, r2_s, dprime_abs_s: over all pairs of SNPs within ``near`` of a SNP (itself included), for those with a neighbour.

    Each pair is compared once, as packed bits; ``joins.means_around`` gives every SNP its mean.
    """
    x = snps.select("align_id", "snp_id", "snp_pos", rp.pack_bits(F.col("snp_occured")).alias("bits"))
    pairs = _pair_ld(x.where("bits IS NOT NULL"), ["align_id"], 2 * near, {"s": ""})
    at = snps.select("align_id", "snp_id", "snp_pos")
    means = joins.means_around(pairs, at, at, ["align_id"], "snp_id", "snp_pos", near, ["r2_s", "dprime_abs_s"])
    return means.where("n > 1").withColumnRenamed("n", "near_snp_number")


def group_ld(snps: DataFrame, isw: DataFrame, indels: DataFrame, near: int = 100) -> DataFrame:
    """snp_id, r2_i, dprime_abs_i, r2_ni, dprime_abs_ni: the same means among the strains that have the indel nearest to the SNP's window, and
    among the others, for SNPs with a neighbour and such an indel.

    Pairs are compared once for each indel that SNPs near them have.
    """
    bits = snps.select("align_id", "snp_id", "snp_pos", rp.pack_bits(F.col("snp_occured")).alias("bits"))
    own = snps.select("snp_id", "snp_pos", "align_id", "isw_id").join(isw.select("isw_id", F.col("isw_indel_id").alias("indel_id")), "isw_id").select("align_id", "snp_id", "snp_pos", "indel_id")
    close = joins.pairs_within(snps.select("align_id", "snp_id", "snp_pos"), ["align_id"], "snp_pos", "snp_id", near)
    met = own.select("snp_id", "indel_id").unionByName(own.select(F.col("snp_id").alias("snp_id_a"), "indel_id").join(close, "snp_id_a").select(F.col("snp_id_b").alias("snp_id"), "indel_id"))
    met = met.unionByName(own.select(F.col("snp_id").alias("snp_id_b"), "indel_id").join(close, "snp_id_b").select(F.col("snp_id_a").alias("snp_id"), "indel_id")).distinct()
    mask = rp.pack_bits(F.col("indel_occured"))
    masks = indels.select("indel_id", mask.alias("one")).where("one IS NOT NULL").select("indel_id", "one", rp.complement_bits(F.col("one")).alias("zero"))
    x = met.join(bits, "snp_id").join(masks, "indel_id")
    pairs = _pair_ld(x.where("bits IS NOT NULL"), ["align_id", "indel_id"], 2 * near, {"i": "one", "ni": "zero"})
    asking = own.join(masks.select("indel_id"), "indel_id", "left_semi")
    means = joins.means_around(pairs, x.select("align_id", "indel_id", "snp_pos"), asking, ["align_id", "indel_id"], "snp_id", "snp_pos", near, ["r2_i", "dprime_abs_i", "r2_ni", "dprime_abs_ni"])
    return means.where("n > 1").drop("n")


def window_ld(windows: DataFrame, snps: DataFrame, ident: str, start: str, end: str, width: int = 1000) -> DataFrame:
    """ident, r2_s, dprime_abs_s: means over the pairs of SNPs within each window (of bounded length, such as segments of 500)."""
    x = snps.select("align_id", "snp_id", "snp_pos", rp.pack_bits(F.col("snp_occured")).alias("bits")).where("bits IS NOT NULL")
    inside = joins.binned_interval_join(x, windows.select("align_id", ident, start, end), ["align_id"], "snp_pos", start, end, width)
    a, b = (inside.select(ident, F.col("snp_pos").alias(f"p{i}"), F.col("bits").alias(f"o{i}")) for i in "ab")
    r, dprime = rp.linkage_packed(F.col("oa"), F.col("ob"))
    return a.join(b, ident).where("pa < pb").select(ident, r.alias("r"), F.abs(dprime).alias("d")).where("r IS NOT NULL").groupBy(ident).agg(F.avg(F.col("r") * F.col("r")).alias("r2_s"), F.avg("d").alias("dprime_abs_s"))


def indel_snp_ld(snps: DataFrame, isw: DataFrame, indels: DataFrame) -> DataFrame:
    """snp_id, snp_r, snp_dprime between a SNP and the indel nearest to its window."""
    x = snps.join(isw.select("isw_id", "isw_indel_id"), "isw_id").join(indels.selectExpr("indel_id AS isw_indel_id", "indel_occured"), "isw_indel_id")
    r, dprime = rp.linkage(F.col("indel_occured"), F.col("snp_occured"))
    return x.select("snp_id", r.alias("snp_r"), dprime.alias("snp_dprime"))


def group_bits(snp: Column, indel: Column, bit: str) -> Column:
    """The SNP's bits of strains whose indel bit is ``bit``: what the linkage within groups is computed from."""
    cut = "(?<=.)(?=.)"
    return F.array_join(F.zip_with(F.split(snp, cut), F.split(indel, cut), lambda s, i: F.when(i == bit, s).otherwise("")), "")


def snp_codons(snps: DataFrame, exons: DataFrame, sequences: DataFrame | Store, width: int = 10_000) -> DataFrame:
    """snp_id, exon_id, snp_codon_pos, snp_codons, snp_syn, snp_nsy, snp_stop.

    ``exons`` has align_id, exon_id, exon_start, exon_end (alignment columns), exon_strand and exon_frame (bases before the first
    whole codon). A SNP is in the exon of the smallest id; codons with a gap in any row give nothing.
    """
    placed = joins.binned_interval_join(snps.select("align_id", "snp_id", "snp_pos"), exons, ["align_id"], "snp_pos", "exon_start", "exon_end", width, first_by="exon_id")
    minus = F.col("exon_strand") == "-"
    offset = F.when(minus, F.col("exon_end") - F.col("snp_pos")).otherwise(F.col("snp_pos") - F.col("exon_start")) - F.col("exon_frame")
    x = placed.withColumn("o", offset).where("o >= 0").withColumn("at", (F.col("o") % 3).cast("int"))
    first = F.when(minus, F.col("snp_pos") + F.col("at") - 2).otherwise(F.col("snp_pos") - F.col("at"))
    inside = (first >= F.col("exon_start")) & (first + 2 <= F.col("exon_end"))
    x = x.withColumn("first", first).where(inside).withColumn("last", F.col("first") + 2)
    slices = Store.of(sequences).slices(x, ["snp_id"], "first", "last")
    codon = lambda s: F.when(minus, F.reverse(F.translate(s, "ACGT", "TGCA"))).otherwise(s)
    x = x.join(slices, "snp_id").select("snp_id", "exon_id", "at", F.transform("slices", codon).alias("codons"))

    @F.pandas_udf("syn double, nsy double, stop double")
    def rates(codons: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([g.codon_rates(list(c), a) or (None, None, None) for c, a in zip(codons, at)], columns=["syn", "nsy", "stop"])

    y = x.withColumn("r", rates("codons", "at"))
    return y.select("snp_id", "exon_id", F.col("at").alias("snp_codon_pos"), F.array_join("codons", "|").alias("snp_codons"), *[F.col(f"r.{c}").alias(f"snp_{c}") for c in ("syn", "nsy", "stop")]).where("snp_syn IS NOT NULL")


def summed_rates(coded: DataFrame, key: str, length: DataFrame, size: str) -> DataFrame:
    """key, syn, nsy, stop: sums of a window's or gene's SNP rates by its length; ``length`` has key and ``size``."""
    sums = coded.where("exon_id IS NOT NULL").groupBy(key).agg(*[F.sum(f"snp_{c}").alias(c) for c in ("syn", "nsy", "stop")])
    return length.select(key, size).join(sums, key).select(key, *[F.try_divide(F.col(c), F.col(size)).alias(c) for c in ("syn", "nsy", "stop")])


def clipped(features: DataFrame, targets: DataFrame, start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Features (chr_name, start, end, …) cut to the blocks (chr_positions) they overlap: align_id, align_start, align_end, is_full."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    f, t = features.withColumn("_bin", bins(start, end)), targets.withColumn("_bin", bins("chr_start", "chr_end"))
    x = f.join(t, ["chr_name", "_bin"]).where((F.col(start) <= F.col("chr_end")) & (F.col("chr_start") <= F.col(end)) & (F.col("_bin") == F.greatest(F.floor(F.col(start) / width), F.floor(F.col("chr_start") / width))))
    a, b = F.greatest(start, "chr_start"), F.least(end, "chr_end")
    at = lambda p: chr_to_align(F.col("spans"), p, F.col("chr_start"), F.col("chr_end"), F.col("chr_strand"))
    x = x.withColumn("_a", at(a)).withColumn("_b", at(b)).withColumn("is_full", ((a == F.col(start)) & (b == F.col(end))).cast("int"))
    return x.select("align_id", *features.columns, F.least("_a", "_b").alias("align_start"), F.greatest("_a", "_b").alias("align_end"), "is_full").where("align_start < align_end")


def longest_transcripts(transcripts: DataFrame, gene: str = "gene_id", length: str = "length", ident: str = "transcript_id") -> DataFrame:
    """One transcript of each gene: the longest, of equals the smallest id."""
    return transcripts.groupBy(gene).agg(F.max_by(F.struct(*transcripts.columns), F.struct(F.col(length), -F.col(ident))).alias("t")).select("t.*")


def ofg_windows(ofgs: DataFrame, style: str = "center_intact") -> DataFrame:
    """Windows of features (ofg_id, align_id, rank_start, rank_end, low, high in target ranks)."""
    w = ofgs.select("ofg_id", "align_id", F.explode(_feature_windows("rank_start", "rank_end", "low", "high", F.lit(style))).alias("w"))
    return w.select(F.xxhash64("ofg_id", "w.start", "w.end", "w.type").alias("ofgsw_id"), "ofg_id", "align_id", F.col("w.type").alias("ofgsw_type"), F.col("w.distance").alias("ofgsw_distance"), F.col("w.start").alias("rank_start"), F.col("w.end").alias("rank_end"))


def slice_indels(window: Column, gap_sets: Column) -> Column:
    """Indels of a window: breaks of its own set, and spans of gaps of its slices less one, neither under 0."""
    gaps = iv.merge(F.flatten(F.transform(gap_sets, lambda s: iv.intersect(s, window))))
    return F.greatest(F.size(window) - 1, F.lit(0)) + F.greatest(F.size(gaps) - 1, F.lit(0))


def bootstrap_ratio(df: DataFrame, top: str, bottom: str, replicates: int = 100, seed: int = 1) -> DataFrame:
    """mean, stderr, median, p5, p95 of sum(top) / sum(bottom) over resamples with replacement.

    A row's weight in a replicate is a Poisson(1) draw from its hash and its number among equal rows: the same on every run, and
    equal rows draw by themselves. Replicates without a ratio are left out.
    """
    draw = F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("b")
    counted = df.groupBy(*df.columns).agg(F.count("*").cast("int").alias("_copies"))
    each = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    x = each.select(F.xxhash64(*df.columns, "_copy").alias("h"), F.col(top).cast("double").alias("t"), F.col(bottom).cast("double").alias("u")).select("h", "t", "u", draw)
    p = F.pmod(F.xxhash64("h", "b", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    cumulative = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(8)])
    weight = sum(F.when(p >= float(c), 1).otherwise(0) for c in cumulative)
    ratios = x.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("t") * F.col("w")), F.sum(F.col("u") * F.col("w"))).alias("r")).where("r IS NOT NULL")
    return ratios.agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("stderr"), *[F.percentile("r", q).alias(n) for n, q in (("median", 0.5), ("p5", 0.05), ("p95", 0.95))])


def branch_snps(isw: DataFrame, indels: DataFrame, snps: DataFrame) -> DataFrame:
    """indel_id, with_indel, without_indel: mean number of derived SNP alleles of strains on the two branches of an indel."""
    near = isw.select("isw_id", F.col("isw_indel_id").alias("indel_id")).join(snps.select("isw_id", "snp_occured"), "isw_id").join(indels.select("indel_id", "indel_occured"), "indel_id")
    known = near.where("snp_occured RLIKE '^[01]+$' AND indel_occured RLIKE '^[01]+$' AND length(snp_occured) = length(indel_occured)")
    share = lambda bit: F.avg(F.try_divide(F.length(F.regexp_replace(group_bits(F.col("snp_occured"), F.col("indel_occured"), bit), "0", "")), F.length(group_bits(F.col("snp_occured"), F.col("indel_occured"), bit))))
    return known.groupBy("indel_id").agg(share("1").alias("with_indel"), share("0").alias("without_indel"))
