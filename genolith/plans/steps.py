"""The batch run: initialise, generate, enrich, report; steps by number or name."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.config import Config
from genolith.operators import annotate, enrich, ingest, joins
from genolith.operators.sequences import Store
from genolith.plans.sheets import sheets
from genolith.plans.tracks import tracks
from genolith.scratch import Scratch
from genolith.sources import readers, sinks

#: Numbers that names stand for.
PRESETS = {
    "all": tuple(range(1, 46)),
    "skeleton": (1, 2, 3),
    "basic": (1, 2, 3, 4, 5, 40),
    "common": (1, 2, 3, 4, 5, 21, 30, 31, 40, 41, 44),
    "gc": (1, 2, 3, 4, 5, 10, 21, 30, 31, 40, 41, 42),
    "gene": (1, 2, 3, 4, 5, 10, 20, 21, 30, 31, 32, 33, 40, 41, 42, 43, 44),
    "stat": (40, 41, 42, 43, 44),
}
REPORTS = {40: "common", 41: "multi", 42: "gc", 43: "gene", 44: "mvar"}


def selected(run: str, known: Sequence[int]) -> list[int]:
    """Step numbers of a preset's name, or of a list such as ``1-5,21`` or ``1 2 40``; those that are not known are left out."""
    parts = run.strip("'\" ").replace(",", " ").split()
    wanted = PRESETS[run] if run in PRESETS else [n for part in parts for a, _, b in [part.partition("-")] for n in range(int(a), int(b or a) + 1)]
    return [n for n in known if n in set(wanted)]


class Run:
    """Tables of one study below ``root``; each step writes the tables and columns that it adds (``sinks.TableSet``).

    ``annotation`` is YAML text with cds and repeat; ``genes`` and ``exons`` are tables in chromosome coordinates (chr_name, start,
    end; an exon also exon_id, exon_strand, exon_frame). Steps without their input are left out.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), outgroup: bool = False, annotation: str | None = None, genes: DataFrame | None = None, exons: DataFrame | None = None):
        self.spark, self.root, self.config, self.outgroup = spark, root, config, outgroup
        self.annotation, self.genes, self.exons = annotation, genes, exons
        self.tables = sinks.TableSet(spark, root)
        self.logged = False
        self._store: Store | None = None

    @property
    def store(self) -> Store:
        """Blocks of the sequences, made when they are first asked for."""
        if self._store is None:
            self._store = Store(self.tables["sequence"])
        return self._store

    def put(self, name: str, df: DataFrame, *order: str, part: str = "") -> None:
        self.tables.put(name, df, *order, part=part)

    def change(self, name: str, updates: DataFrame, step: str) -> None:
        self.tables.change(name, updates, f"{name}_id", step)

    def generate(self, folder: str) -> None:
        """Tables of the alignments below a folder; blocks that are none are listed in the table ``rejected``."""
        read = readers.blocked_fasta(self.spark, folder, self.config.min_length)
        self.put("rejected", readers.rejected_alignments(read, self.outgroup))
        self.put("blocks", ingest.analyzed(readers.valid_alignments(read, self.outgroup), self.outgroup))
        b = self.tables["blocks"]
        self.put("align", ingest.align_table(b, self.outgroup), "align_id")
        self.put("sequence", ingest.sequence_table(b, self.outgroup), "align_id", "seq_position")
        self._store = None
        self.put("indel", ingest.indel_table(b), "align_id", "indel_start")
        self.put("snp", ingest.snp_table(b), "align_id", "snp_pos")

    def windows(self) -> None:
        t = self.tables
        self.put("isw", enrich.isw_table(t["indel"], self.store), "align_id", "isw_start")
        self.change("snp", enrich.snp_windows(t["snp"], t["isw"]).select("snp_id", "isw_id"), "windows")
        if self.outgroup:
            self.change("isw", enrich.d_values(t["isw"], t["indel"], t["snp"]).drop("isw_indel_id", "isw_length"), "d_values")

    def gc(self) -> None:
        t = self.tables
        self.put("segment", enrich.segment_table(t["align"], self.store, self.config), "align_id")
        self.put("extreme", enrich.extreme_table(t["align"], self.store, self.config), "align_id")
        self.put("gsw", enrich.gsw_table(t["extreme"], self.config), "align_id")
        # windows of all three, as the comparable columns between their ends
        rows = t["segment"].selectExpr("align_id", "segment_id AS window_id", "window_start", "window_end")
        for name in ("extreme", "gsw"):
            rows = rows.unionByName(self.store.column_of(t[name].selectExpr("align_id", f"{name}_id AS window_id", "rank_start", "rank_end"), "free", window_start="rank_start", window_end="rank_end").select(*rows.columns))
        self.put("window", enrich.window_table(rows, "window_id", self.store), "align_id", "window_start", part="gc")

    def targets(self) -> DataFrame:
        return annotate.targets(self.tables["sequence"])

    def place_genes(self) -> None:
        """Genes and exons cut to the blocks they lie on, in alignment columns; exons of transcripts as the tables of genes have them."""
        t, columns = self.targets(), {"a": "rank_start", "b": "rank_end"}
        if self.genes is not None and self.exons is not None and {"gene_stable_id", "transcript_id"} <= set(self.exons.columns):
            gene, exon = annotate.gene_tables(self.genes, self.exons, t, self.store, Scratch(self.spark, "genes"))
            self.put("gene", gene, "align_id", "rank_start")
            self.put("exon", self.store.column_of(exon, "target", exon_start="rank_start", exon_end="rank_end"), "align_id", "rank_start")
            rows = self.tables["gene"].select("window_id", "align_id", "rank_start", "rank_end").unionByName(self.tables["exon"].select("window_id", "align_id", "rank_start", "rank_end"))
            self.put("window", annotate.target_windows(rows, "window_id", self.store), "align_id", "window_start", part="genes")
            return
        if self.genes is not None:
            placed = self.store.column_of(annotate.clipped(self.genes, t).where("rank_start < rank_end"), "target", **{f"align_{n}": c for n, c in (("start", "rank_start"), ("end", "rank_end"))})
            self.put("gene", placed.drop(*columns.values()), "align_id", "align_start")
        if self.exons is not None:
            placed = self.store.column_of(annotate.clipped(self.exons, t).where("rank_start < rank_end"), "target", exon_start="rank_start", exon_end="rank_end")
            self.put("exon", placed.drop(*columns.values()).withColumnRenamed("is_full", "exon_is_full"), "align_id", "exon_start")

    def place_positions(self, positions: DataFrame, style: str = "center_intact") -> None:
        """Positions (tag, type, chr_name, start, end) as ofg, windows around them as ofgsw with their cv, and the windows of both."""
        self.put("ofg", annotate.place_positions(positions, self.targets()), "align_id", "rank_start")
        ofgsw = annotate.feature_windows(self.tables["ofg"], self.store, style)
        self.put("ofgsw", enrich.window_cv(ofgsw, "ofgsw_id", self.store.compressed("target"), "rank_start", "rank_end", self.config, "ofgsw_cv"), "align_id", "rank_start")
        columns = ["window_id", "align_id", "rank_start", "rank_end"]
        rows = self.tables["ofg"].select(*columns).unionByName(self.tables["ofgsw"].select(*columns))
        self.put("window", annotate.target_windows(rows, "window_id", self.store), "align_id", "window_start", part="positions")

    def cv(self) -> None:
        """cv around windows, in columns; around waves, and within them, in ranks of the comparable set."""
        t = self.tables
        self.change("isw", enrich.window_cv(t["isw"].select("align_id", "isw_id", "isw_start", "isw_end"), "isw_id", self.store, "isw_start", "isw_end", self.config, "isw_cv").select("isw_id", "isw_cv"), "cv")
        if "gsw" in t:
            around = enrich.window_cv(t["gsw"].select("align_id", "gsw_id", "rank_start", "rank_end"), "gsw_id", self.store, "rank_start", "rank_end", self.config, "gsw_cv", ranks=True)
            self.change("gsw", enrich.intra_cv(around, "gsw_id", self.store, "rank_start", "rank_end", "gsw_intra_cv", ranks=True).select("gsw_id", "gsw_cv", "gsw_intra_cv"), "cv")

    def annotate(self) -> None:
        """Portions in coding regions and repeats of alignments, indels, SNPs and windows."""
        found, targets = readers.annotation(self.spark, self.annotation), self.targets()
        features = joins.span_union(found, ["chr_name", "kind"], "start", "end", Scratch(self.spark, "features"))
        for name, start, end in (("align", "_first", "align_length"), ("indel", "indel_start", "indel_end"), ("snp", "snp_pos", "snp_pos"), ("isw", "isw_start", "isw_end"), ("window", "window_start", "window_end")):
            if name not in self.tables:
                continue
            table = self.tables[name]
            portions = annotate.portions(table.withColumn("_first", F.lit(1)), f"{name}_id", start, end, self.store, targets, features, name)
            self.change(name, portions, "annotation")

    def substitutions(self) -> None:
        """CpG sites, and linkage: of SNPs near each other, also among strains with or without the indel nearest to their window, with that indel, and in segments."""
        t = self.tables
        self.change("snp", enrich.snp_cpg(t["snp"], self.store), "cpg")
        for step, means in (("ld", enrich.neighbour_ld(t["snp"], self.config.near)), ("group_ld", enrich.group_ld(t["snp"], t["isw"], t["indel"], self.config.near))):
            self.change("snp", means.withColumnsRenamed({c: f"snp_{c}" for c in means.columns if c[:2] in ("r2", "dp")}), step)
        if self.outgroup:
            self.change("snp", enrich.indel_snp_ld(t["snp"], t["isw"], t["indel"]), "indel_ld")
        if "segment" in t:
            linked = enrich.window_ld(t["segment"].where("window_end - window_start < 1000"), t["snp"], "segment_id", "window_start", "window_end")
            self.change("segment", linked.withColumnsRenamed({c: f"segment_{c}" for c in ("r2_s", "dprime_abs_s")}), "ld")
        self.change("isw", enrich.isw_cpg(t["isw"], t["snp"]), "cpg")

    def codons(self) -> None:
        """Synonymous and other changes of SNPs in exons, and their rates by window."""
        t = self.tables
        exons = t["exon"].select("align_id", "exon_id", "exon_start", "exon_end", "exon_strand", "exon_frame")
        self.change("snp", enrich.snp_codons(t["snp"], exons, self.store), "codons")
        rates = enrich.summed_rates(t["snp"], "isw_id", t["isw"], "isw_length").withColumnsRenamed({c: f"isw_{c}" for c in ("syn", "nsy", "stop")})
        self.change("isw", rates, "codons")
        if "gene_tl_size" in (t["gene"].columns if "gene" in t else ()):
            self.gene_rates()

    def gene_rates(self) -> None:
        """dN/dS of genes, by the bases that their transcripts code."""
        t = self.tables
        coded = t["snp"].select("snp_id", "exon_id", "snp_syn", "snp_nsy", "snp_stop").where("exon_id IS NOT NULL").join(t["exon"].select("exon_id", "gene_id"), "exon_id")
        rates = enrich.summed_rates(coded, "gene_id", t["gene"], "gene_tl_size").withColumnsRenamed({c: f"gene_{c}" for c in ("syn", "nsy", "stop")})
        self.change("gene", rates, "codons")

    def slippage(self) -> None:
        t = self.tables
        self.change("indel", enrich.indel_slippage(t["indel"], self.store), "slippage")

    def report(self, number: int | str) -> dict[str, DataFrame]:
        """The sheets of one report (its number; or its name, as ``ofg`` and ``ld`` have no number) that the tables allow, below ``report/`` and its name."""
        name = REPORTS.get(number, number)
        self.tables.compact()
        meta = {"meta": self.spark.read.parquet(f"{self.root}/meta")} if self.logged else {}
        made = sheets({**self.tables, **meta}, name, self.config)
        if made:
            sinks.write_sheets(made, f"{self.root}/report/{name}")
        return made

    def graph(self, align_ids: Sequence[int] | None = None) -> DataFrame:
        """The tracks of alignments (all, or those with these ids), also written as CSV to ``graph/tracks``, and of the gc wave only to ``graph/gc``
        (align_id, start, gc, flag)."""
        wanted = self.tables["align"] if align_ids is None else self.tables["align"].where(F.col("align_id").isin(list(align_ids)))
        some = {"align": wanted, **{n: self.tables[n].join(wanted.select("align_id"), "align_id", "left_semi") for n in ("sequence", "isw") if n in self.tables}}
        made = Scratch(self.spark, "graph").keep(tracks(some, self.store if align_ids is None else Store(some["sequence"]), self.config), "tracks")
        sinks.write_query(made.orderBy("align_id", "track", "start", "end"), f"{self.root}/graph/tracks")
        gc = made.where("track = 'gc'").orderBy("align_id", "start")
        sinks.write_query(gc.select("align_id", "start", F.col("score").alias("gc"), F.col("name").alias("flag")), f"{self.root}/graph/gc")
        return made

    def run(self, folder: str, run: str = "common") -> list[int]:
        """Runs the selected steps in the order of their numbers; returns those that ran.

        2 tables of alignments, 5 windows of indels, 10 gc waves and segments, 20 genes and exons, 21 cv, 30 annotation,
        31 slippage, 32 CpG and linkage, 33 codons, 40 to 44 reports. Tables are made anew by 2, so 1, 3 and 4 have nothing left to do.
        """
        steps: dict[int, tuple[str, Callable[[], object]]] = {2: ("generate", lambda: self.generate(folder)), 5: ("windows", self.windows), 10: ("gc", self.gc), 20: ("genes", self.place_genes), 21: ("cv", self.cv), 30: ("annotation", self.annotate), 31: ("slippage", self.slippage), 32: ("substitutions", self.substitutions), 33: ("codons", self.codons)}
        steps |= {n: (f"report {name}", lambda n=n: self.report(n)) for n, name in REPORTS.items()}
        absent = {43: self.genes is None, 20: self.genes is None and self.exons is None, 30: self.annotation is None, 33: self.exons is None}
        done = [n for n in selected(run, sorted(steps)) if not absent.get(n)]
        for n in done:
            name, step = steps[n]
            began = time.time()
            step()
            sinks.log_step(self.spark, self.root, name, time.time() - began, f"run {n}")
            self.logged = True
        return done
