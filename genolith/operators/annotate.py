"""Positions, genes and exons on alignments: from chromosomes to columns, windows around features, sets of transcripts.

The target's bases are counted along its chromosome, so that a position is a rank in the set of columns where the target has a
base (``Store`` kind ``target``): maps are look-ups in its directory, and do not walk the target's spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.functions import intervals as iv
from genolith.operators import joins
from genolith.operators.sequences import Store
from genolith.scratch import Scratch


def targets(sequences: DataFrame) -> DataFrame:
    """align_id, chr_name, chr_start, chr_end, chr_strand of the targets."""
    return sequences.where("seq_role = 'T'").select("align_id", "chr_name", "chr_start", "chr_end", "chr_strand")


def rank_on(position: Column) -> Column:
    """Rank of a chromosome position among the target's bases."""
    return F.when(F.col("chr_strand") == "-", F.col("chr_end") - position + 1).otherwise(position - F.col("chr_start") + 1)


def position_of(rank: Column) -> Column:
    """Chromosome position of a rank among the target's bases."""
    return F.when(F.col("chr_strand") == "-", F.col("chr_end") - rank + 1).otherwise(F.col("chr_start") + rank - 1)


def to_chromosome(rows: DataFrame, ident: str, column: str, store: Store, target: DataFrame, name: str = "chr_position") -> DataFrame:
    """ident, chr_name, name: the chromosome position of an alignment column; one in a gap stands for the base before it."""
    ranks = store.rank_of(rows, "target", ident, column, "_rank")
    return rows.select("align_id", ident).join(ranks, ident).join(target, "align_id").select(ident, "chr_name", position_of(F.col("_rank")).alias(name))


def clipped(features: DataFrame, target: DataFrame, start: str = "start", end: str = "end", width: int = 100_000) -> DataFrame:
    """Features (chr_name, start, end, ...) with the alignments whose target they overlap: their columns, align_id, rank_start, rank_end (in order)
    and is_full, 0 where a part lies outside. A feature comes once for each alignment."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    f, t = features.where(F.col(start) <= F.col(end)).withColumn("_bin", bins(start, end)), target.withColumn("_bin", bins("chr_start", "chr_end"))
    x = f.join(t, ["chr_name", "_bin"]).where((F.col(start) <= F.col("chr_end")) & (F.col("chr_start") <= F.col(end)) & (F.col("_bin") == F.greatest(F.floor(F.col(start) / width), F.floor(F.col("chr_start") / width))))
    a, b = F.greatest(start, "chr_start"), F.least(end, "chr_end")
    x = x.withColumns({"_x": rank_on(a), "_y": rank_on(b), "is_full": ((a == F.col(start)) & (b == F.col(end))).cast("int")})
    return x.select("align_id", *features.columns, F.least("_x", "_y").alias("rank_start"), F.greatest("_x", "_y").alias("rank_end"), "is_full")


def target_windows(windows: DataFrame, ident: str, store: Store, kind: str = "target") -> DataFrame:
    """The ``window`` rows (window_id is ``ident``) of ranks rank_start..rank_end of the target's bases.

    A window is the set of those bases' columns: its indels are the breaks of that set, and the runs of gaps of the other sequences in it, less
    one for those at its edge.
    """
    own = store.compressed(kind)
    counted = own.stats(windows.select("align_id", ident, "rank_start", "rank_end"), ident, "rank_start", "rank_end")
    placed = store.column_of(windows.select("align_id", ident, "rank_start", "rank_end"), kind, window_start="rank_start", window_end="rank_end").where("window_start IS NOT NULL AND window_end IS NOT NULL")
    # breaks: columns between the ends that are no bases of the target are in runs
    breaks = store.sums(placed, ident, "window_start", "window_end").select(ident, "target_gap_runs")
    x = placed.join(counted, ident).join(breaks, ident)
    counts = [F.col(c).cast("int").alias(f"window_{c}") for c in ("comparables", "identities", "differences")]
    indels = F.col("target_gap_runs") + F.greatest(F.col("gap_runs") - 1, F.lit(0))
    return x.select(F.col(ident).alias("window_id"), "align_id", "window_start", "window_end", F.col("columns").cast("int").alias("window_length"), *counts, indels.cast("int").alias("window_indel"), F.col("pi").alias("window_pi"), F.col("gc").alias("window_gc"))


def place_positions(positions: DataFrame, target: DataFrame, width: int = 100_000) -> DataFrame:
    """ofg_id, window_id, align_id, ofg_tag, ofg_type, rank_start, rank_end: positions (tag, type, chr_name, start, end) that lie in an alignment's target
    as a whole, in the one of the smallest align_id. Positions that lie in none are left out; equal ones are one."""
    p = positions.where("start <= end").select("tag", "type", "chr_name", "start", "end").distinct().withColumn("ofg_id", F.xxhash64("tag", "type", "chr_name", "start", "end"))
    held = joins.containment_join(p, target.select("chr_name", "chr_start", "chr_end", "align_id"), ["chr_name"], ("start", "end"), ("chr_start", "chr_end"), width, "ofg_id", "align_id")
    x = held.join(target.drop("chr_name"), "align_id")
    a, b = rank_on(F.col("start")), rank_on(F.col("end"))
    return x.select("ofg_id", F.col("ofg_id").alias("window_id"), "align_id", F.col("tag").alias("ofg_tag"), F.col("type").alias("ofg_type"), F.least(a, b).alias("rank_start"), F.greatest(a, b).alias("rank_end"))


def _around(style: str, size: int, most: int) -> str:
    """Windows of a feature rank_start..rank_end as an SQL array of (start, end, type, distance), those beyond the block too."""
    w = lambda start, end, kind, distance: f"named_struct('start', CAST({start} AS int), 'end', CAST({end} AS int), 'type', '{kind}', 'distance', CAST({distance} AS int))"
    each = lambda n, row: f"transform(filter(sequence(1, {most}), k -> k <= {n}), k -> {row})"
    a, b, middle = "rank_start", "rank_end", "(rank_start + rank_end) div 2"
    inner = f"least({most}, ({b} - {a} + 1) div {2 * size})"
    first = f"({middle} - {size // 2} + 1)"
    outside = [each(most, w(f"{a} - {size} * k", f"{a} - {size} * k + {size - 1}", "L", "k")), each(most, w(f"{b} + {size} * k - {size - 1}", f"{b} + {size} * k", "R", "k"))]
    inside = [each(inner, w(f"{a} + {size} * (k - 1)", f"{a} + {size} * k - 1", "L", "-k")), each(inner, w(f"{b} - {size} * k + 1", f"{b} - {size} * (k - 1)", "R", "-k"))]
    second = [each(inner, w(f"{middle} - {size} * k + 1", f"{middle} - {size} * (k - 1)", "l", "k - 91")), each(inner, w(f"{middle} + {size} * (k - 1) + 1", f"{middle} + {size} * k", "r", "k - 91"))]
    centre = [f"array({w(first, f'{first} + {size - 1}', 'M', 0)})", each(most, w(f"{first} - {size} * k", f"{first} - {size} * k + {size - 1}", "L", "k")), each(most, w(f"{first} + {size} * k", f"{first} + {size} * k + {size - 1}", "R", "k"))]
    styles = {"edge": outside + inside + second, "edge_only": outside + inside, "center": centre, "center_intact": [f"array({w(a, b, 'M', 0)})", *outside]}
    if style not in styles:
        raise ValueError(f"no window style {style}")
    return f"concat({', '.join(styles[style])})"


def feature_windows(features: DataFrame, store: Store, style: str = "center_intact", size: int = 100, most: int = 20) -> DataFrame:
    """ofgsw_id, window_id, ofg_id, align_id, ofgsw_type, ofgsw_distance, rank_start, rank_end: windows of features in ranks of the target's bases.

    Outside: L before and R after a feature, distances 1, 2, ... Inside, from both edges: -1, -2, ...; with ``edge`` also from the middle, from -90
    on. center: 0 in the middle and outward; center_intact: the whole feature is 0. Windows that leave the alignment are left out.
    """
    x = features.join(store.sizes("target"), "align_id").select("ofg_id", "align_id", "size", F.explode(F.expr(_around(style, size, most))).alias("w")).where("w.start >= 1 AND w.end <= size")
    ident = F.xxhash64("ofg_id", "w.type", "w.distance", "w.start")
    return x.select(ident.alias("ofgsw_id"), ident.alias("window_id"), "ofg_id", "align_id", F.col("w.type").alias("ofgsw_type"), F.col("w.distance").alias("ofgsw_distance"), F.col("w.start").alias("rank_start"), F.col("w.end").alias("rank_end"))


def _runlist(spans: DataFrame, keys: list[str], store: Store, scratch: Scratch, name: str) -> DataFrame:
    """keys, name_runlist, name_size: the union of spans (align_id, keys, rank_start, rank_end) as alignment columns, the target's gaps left out."""
    merged = joins.span_union(spans.select("align_id", *keys, "rank_start", "rank_end"), ["align_id", *keys], "rank_start", "rank_end", scratch)
    placed = store.column_of(merged, "target", a="rank_start", b="rank_end")
    bases = store.slices(placed, [*keys, "rank_start"], "a", "b", first_only=True)
    runs = F.transform(iv.runs_of(F.get("slices", 0), "^-"), lambda x: F.struct((x["start"] + F.col("a") - 1).alias("start"), (x["end"] + F.col("a") - 1).alias("end")))
    x = placed.join(bases, [*keys, "rank_start"]).select(*keys, runs.alias("runs"), (F.col("rank_end") - F.col("rank_start") + 1).alias("n"))
    return x.groupBy(*keys).agg(iv.to_runlist(iv.merge(F.flatten(F.collect_list("runs")))).alias(f"{name}_runlist"), F.sum("n").cast("int").alias(f"{name}_size"))


def gene_tables(genes: DataFrame, exons: DataFrame, target: DataFrame, store: Store, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The gene and exon tables: each gene that overlaps an alignment, and there the exons of its longest transcript.

    ``genes``: gene_stable_id, chr_name, start, end, gene_strand and what else is to be kept; ``exons``: gene_stable_id, transcript_id, exon_stable_id,
    chr_name, start, end, exon_strand, exon_frame, and coding_start and coding_end (null where it codes for nothing). Of transcripts of equal length the
    smallest id counts. What lies outside the alignment is cut off and clears is_full; parts of one base are left out.
    A gene has gene_tc_runlist and gene_tl_runlist, the unions of its exons and of what they code, with gene_tl_size, the bases in the latter;
    an exon its rank in the order of columns, the exon before, and exon_tl_runlist. Both have rank_start and rank_end, and window_id.
    """
    g = clipped(genes, target).where("rank_start < rank_end").withColumn("gene_id", F.xxhash64("align_id", "gene_stable_id"))
    of_transcript = exons.groupBy("gene_stable_id", "transcript_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("length"))
    best = of_transcript.groupBy("gene_stable_id").agg(F.count("*").cast("int").alias("gene_multitrans"), F.min(F.struct((-F.col("length")).alias("n"), F.col("transcript_id").alias("transcript_id"))).alias("t"))
    own = exons.join(best.select("gene_stable_id", F.col("t.transcript_id").alias("transcript_id")), ["gene_stable_id", "transcript_id"])
    many = own.groupBy("gene_stable_id").agg(F.count("*").cast("int").alias("gene_multiexons"))
    placed = clipped(own, target).where("rank_start < rank_end").withColumns({"gene_id": F.xxhash64("align_id", "gene_stable_id"), "exon_id": F.xxhash64("align_id", "gene_stable_id", "exon_stable_id")})
    placed = scratch.keep(placed.join(g.select("gene_id").distinct(), "gene_id", "left_semi").join(target.drop("chr_name"), "align_id"), "exons")
    low, high = F.greatest("coding_start", "chr_start"), F.least("coding_end", "chr_end")
    coding = placed.where(F.col("coding_start").isNotNull() & F.col("coding_end").isNotNull() & (low < high)).select("align_id", "gene_id", "exon_id", rank_on(low).alias("_x"), rank_on(high).alias("_y"))
    coding = coding.select("align_id", "gene_id", "exon_id", F.least("_x", "_y").alias("rank_start"), F.greatest("_x", "_y").alias("rank_end"))
    cut = (F.col("coding_start") < F.col("chr_start")) | (F.col("coding_end") > F.col("chr_end"))
    along = Window.partitionBy("gene_id").orderBy("rank_start", "rank_end", "exon_id")
    exon = placed.withColumns({"exon_is_full": F.when(F.coalesce(cut, F.lit(False)), 0).otherwise(F.col("is_full")), "exon_rank": F.row_number().over(along), "prev_exon_id": F.coalesce(F.lag("exon_id").over(along), F.lit(0).cast("long")), "window_id": F.col("exon_id")})
    exon = exon.join(_runlist(coding, ["exon_id"], store, Scratch(scratch.spark, "exon_tl"), "exon_tl"), "exon_id", "left").drop("is_full", "chr_start", "chr_end", "chr_strand", "transcript_id")
    sets = [_runlist(spans, ["gene_id"], store, Scratch(scratch.spark, name), name) for spans, name in ((placed, "gene_tc"), (coding, "gene_tl"))]
    gene = g.withColumnRenamed("is_full", "gene_is_full").withColumn("window_id", F.col("gene_id")).join(best.drop("t"), "gene_stable_id", "left").join(many, "gene_stable_id", "left")
    for x in sets:
        gene = gene.join(x, "gene_id", "left")
    return gene, exon


def portions(table: DataFrame, ident: str, start: str, end: str, store: Store, target: DataFrame, features: DataFrame, prefix: str) -> DataFrame:
    """ident, ``prefix``_coding and ``prefix``_repeats: the shares of what the target has at alignment columns start..end that lie in features (chr_name,
    kind, start, end; those of a kind may not overlap, see ``joins.span_union``)."""
    from genolith.operators.enrich import feature_portions

    ends = table.select("align_id", ident, F.explode(F.array(F.struct(F.lit("x").alias("side"), F.col(start).alias("at")), F.struct(F.lit("y").alias("side"), F.col(end).alias("at")))).alias("e")).select("align_id", ident, "e.*")
    ends = ends.withColumn("_side", F.xxhash64(ident, "side"))
    placed = ends.select("_side", ident).join(to_chromosome(ends, "_side", "at", store, target), "_side")
    spans = placed.groupBy(ident, "chr_name").agg(F.min("chr_position").alias("_start"), F.max("chr_position").alias("_stop"))
    return feature_portions(spans, features, ident, "_start", "_stop").select(ident, F.col("cds").alias(f"{prefix}_coding"), F.col("repeat").alias(f"{prefix}_repeats"))
