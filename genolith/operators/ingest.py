"""From blocks of aligned sequences to the align, sequence, indel and snp tables.

One pass over each block's rows in an Arrow batch gives its statistics and variants as nested
columns; the tables are projections of it. Keys are hashes of natural keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.functions import genetics as g
from genolith.functions import intervals as iv

_STATS = "length int, comparables int, identities int, differences int, gaps int, ns int, error int, pi double, gc double, average_gc double"
_INDEL = "start int, end int, length int, seq string, all_seqs string, outgroup_seq string, left_extand int, right_extand int, gc double, freq int, occured string, type string"
_SNP = "pos int, target_base string, query_base string, all_bases string, outgroup_base string, mutant_to string, freq int, occured string"


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{n}:{t}" for n, t in (c.split() for c in ddl.split(", "))) + ">"


def analyzed(blocks: DataFrame, outgroup: bool = False) -> DataFrame:
    """Blocks with stats, indels and snps; the last row is the outgroup if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            stats, indels, snps = [], [], []
            for rows in pdf["rows"]:
                m = g.matrix([r["seq"] for r in rows])
                own, other = (m[:-1], m[-1]) if outgroup else (m, None)
                s = g.column_stats(own)
                gcs = [x for x in map(g.gc_ratio, own) if x is not None]
                stats.append(s | {"gc": g.gc_ratio(own[0]), "average_gc": float(np.mean(gcs)) if gcs else None})
                indels.append(g.call_indels(own, other))
                snps.append(g.call_snps(own, other))
            yield pdf.assign(stats=stats, indels=indels, snps=snps)

    row = blocks.schema["rows"].dataType.simpleString()
    return blocks.select("align_id", "file", "rows").mapInPandas(run, f"align_id long, file string, rows {row}, stats {_struct(_STATS)}, indels array<{_struct(_INDEL)}>, snps array<{_struct(_SNP)}>")


def _gaps(outgroup: bool) -> Column:
    own = F.slice("rows", 1, F.size("rows") - (1 if outgroup else 0))
    return iv.merge(F.flatten(F.transform(own, lambda r: iv.runs_of(r["seq"], "-"))))


def align_table(blocks: DataFrame, outgroup: bool = False) -> DataFrame:
    gaps = _gaps(outgroup)
    spans = blocks.select("align_id", *[F.col(f"stats.{c}").alias(f"align_{c}") for c in ("length", "comparables", "identities", "differences", "gaps", "ns", "error", "pi", "gc", "average_gc")], gaps.alias("_gaps"))
    return spans.select(*[c for c in spans.columns if c != "_gaps"], iv.span_size(F.col("_gaps")).alias("align_indels"), iv.to_runlist(iv.complement(F.col("_gaps"), F.lit(1), F.col("align_length"))).alias("align_comparable_runlist"), iv.to_runlist(F.col("_gaps")).alias("align_indel_runlist"))


def sequence_table(blocks: DataFrame, outgroup: bool = False) -> DataFrame:
    """seq_role T for the first row, O for an outgroup, Q else; the runlist is where a row has bases."""
    rows = blocks.select("align_id", F.size("rows").alias("_n"), F.explode("rows").alias("r"))
    role = F.when(F.col("r.position") == 0, "T").when((F.col("r.position") == F.col("_n") - 1) & F.lit(outgroup), "O").otherwise("Q")
    bases = F.regexp_replace("r.seq", "-", "")
    acgt, gc = (F.length(F.regexp_replace(bases, p, "")) for p in ("[^ACGT]", "[^GC]"))
    return rows.select(
        F.xxhash64("align_id", "r.position").alias("seq_id"), "align_id", role.alias("seq_role"), F.col("r.position").alias("seq_position"), F.col("r.name").alias("common_name"), F.col("r.chr").alias("chr_name"), F.col("r.start").alias("chr_start"), F.col("r.end").alias("chr_end"), F.col("r.strand").alias("chr_strand"),
        F.length(bases).alias("seq_length"), F.try_divide(gc, acgt).alias("seq_gc"), iv.to_runlist(iv.complement(iv.runs_of(F.col("r.seq"), "-"), F.lit(1), F.length("r.seq"))).alias("seq_runlist"), F.col("r.seq").alias("seq_seq"),
    )


def indel_table(blocks: DataFrame) -> DataFrame:
    """Indels with the id of the one before (0 for the first)."""
    x = blocks.select("align_id", F.explode("indels").alias("i"))
    ident = F.xxhash64("align_id", "i.start", "i.end")
    named = {"start": "indel_start", "end": "indel_end", "length": "indel_length", "seq": "indel_seq", "all_seqs": "indel_all_seqs", "outgroup_seq": "indel_outgroup_seq", "left_extand": "left_extand", "right_extand": "right_extand", "gc": "indel_gc", "freq": "indel_freq", "occured": "indel_occured", "type": "indel_type"}
    before = F.coalesce(F.lag("indel_id").over(Window.partitionBy("align_id").orderBy("indel_start")), F.lit(0).cast("long"))
    return x.select(ident.alias("indel_id"), "align_id", *[F.col(f"i.{k}").alias(v) for k, v in named.items()]).withColumn("prev_indel_id", before)


def snp_table(blocks: DataFrame) -> DataFrame:
    x = blocks.select("align_id", F.explode("snps").alias("s"))
    return x.select(F.xxhash64("align_id", "s.pos").alias("snp_id"), "align_id", *[F.col(f"s.{c}").alias(f"snp_{c}") for c in ("pos", "target_base", "query_base", "all_bases", "outgroup_base", "mutant_to", "freq", "occured")])
