"""Sources: alignments, genomes, annotation, positions, genes and SQL text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.functions import intervals as iv
from genolith.operators import joins
from genolith.operators.sequences import SIZE, Store
from genolith.schema import TABLES
from genolith.scratch import Scratch

HEADER = r"^([^.\s(:]+)(?:\.([^\s(:]+))?(?:\(([+-])\))?(?::(\d+)(?:-(\d+))?)?"


def header(text) -> F.Column:
    """name, chr, strand, start, end of ``name.chr(+):start-end``; parts may be missing."""
    part = lambda i: F.nullif(F.regexp_extract(text, HEADER, i), F.lit(""))
    return F.struct(part(1).alias("name"), part(2).alias("chr"), F.coalesce(part(3), F.lit("+")).alias("strand"), part(4).cast("int").alias("start"), F.coalesce(part(5), part(4)).cast("int").alias("end"))


def _files(spark: SparkSession, folder: str, patterns: Sequence[str]) -> tuple[str, DataFrame] | None:
    """The first pattern of which the folder has files, and their listing."""
    for pattern in patterns:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
        if found.limit(1).count():
            return pattern, found
    return None


def blocked_fasta(spark: SparkSession, folder: str, min_length: int = 0, streaming: bool = False) -> DataFrame:
    """align_id, file, rows: blocks of aligned sequences from ``*.fas``, or if there are none ``*.fas.gz``.

    Blocks end with an empty line, which is the reader's record separator: a file is read in
    splits (unless gzipped), never as one value. Blocks whose first sequence, gaps
    included, is under ``min_length`` are left out. align_id is a hash of the file and first header,
    so it does not depend on scheduling.
    """
    reader = spark.readStream if streaming else spark.read
    pattern = "*.fas"
    if not streaming and not _files(spark, folder, [pattern]):
        pattern = "*.fas.gz"
    text = reader.format("text").option("lineSep", "\n\n").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = text.select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("file")).where("value LIKE '%>%'")
    entries = F.filter(F.split("value", r"(?m)^\s*>"), lambda e: F.trim(e) != "")

    def row(e, i):
        head = header(F.substring_index(e, "\n", 1))
        seq = F.upper(F.regexp_replace(F.substring(e, F.length(F.substring_index(e, "\n", 1)) + 1, F.length(e)), r"\s", ""))
        return F.struct(i.cast("int").alias("position"), *[head[c].alias(c) for c in ("name", "chr", "strand", "start", "end")], seq.alias("seq"))

    blocks = text.select("file", F.xxhash64("file", F.get(entries, 0)).alias("align_id"), F.transform(entries, row).alias("rows"))
    return blocks.where(F.length(F.get("rows", 0)["seq"]) >= min_length).select("align_id", "file", "rows")


def _valid(outgroup: bool) -> F.Column:
    length = F.length(F.get("rows", 0)["seq"])
    return F.coalesce((F.size("rows") >= (3 if outgroup else 2)) & F.forall("rows", lambda r: F.length(r["seq"]) == length), F.lit(False))


def valid_alignments(blocks: DataFrame, outgroup: bool = False) -> DataFrame:
    """Blocks of at least two rows (three with an outgroup) of equal length; ``rejected_alignments`` has the others."""
    return blocks.where(_valid(outgroup))


def rejected_alignments(blocks: DataFrame, outgroup: bool = False) -> DataFrame:
    """align_id, file, names and lengths of the rows of blocks that are not valid alignments."""
    return blocks.where(~_valid(outgroup)).select("align_id", "file", F.transform("rows", lambda r: r["name"]).alias("names"), F.transform("rows", lambda r: F.length(r["seq"])).alias("lengths"))


class Genome:
    """Chromosomes in blocks: ``names`` has align_id and chr_name, ``store`` the blocks of each, as of an alignment of one sequence."""

    def __init__(self, names: DataFrame, store: Store):
        self.names, self.store = names, store


def genome_fasta(spark: SparkSession, folder: str, scratch: Scratch | None = None, size: int = SIZE) -> Genome:
    """The first record of each ``.fa``, ``.fas`` or ``.fasta`` file, named after the file. Letters are made upper case.

    Files are read line by line in splits of any size, never as one value: each split counts its headers and bases, running sums over the
    splits of a file say which of its lines are in the first record and how many bases come before, and lines are dealt into
    blocks. What stands before a file's first header belongs to no record; a record without bases gives nothing.
    """
    scratch = scratch or Scratch(spark, "genome")
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{fa,fas,fasta}").text(folder)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("i"), "value")
    head = F.col("value").startswith(">")
    lines = lines.withColumns({"head": head.cast("int"), "bases": F.when(head, "").otherwise(F.upper(F.regexp_replace("value", r"\s", "")))})
    lines = scratch.keep(lines.drop("value"), "lines")
    within = Window.partitionBy("file", "split").orderBy("i")
    seen = lines.withColumn("own_heads", F.sum("head").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    heads = lines.groupBy("file", "split").agg(F.sum("head").alias("n")).select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("heads"))
    first = seen.join(heads, ["file", "split"]).where("heads + own_heads = 1 AND head = 0 AND bases <> ''").select("file", "split", "i", "bases")
    counts = first.groupBy("file", "split").agg(F.sum(F.octet_length("bases")).alias("n")).select("file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    running = F.coalesce(F.sum(F.octet_length("bases")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = first.join(counts, ["file", "split"]).withColumn("at", F.col("before") + running)
    align = F.xxhash64("file").alias("align_id")

    def cut(b: F.Column) -> F.Column:
        low, high = F.floor(F.col("at") / size), F.floor((F.col("at") + F.octet_length(b) - 1) / size)
        return F.transform(F.sequence(low, high), lambda k: F.struct(k.cast("int").alias("block"), F.greatest(F.col("at"), k * size).alias("from"), F.substring(b, (F.greatest(k * size - F.col("at"), F.lit(0)) + 1).cast("int"), F.least((k + 1) * size - F.greatest(F.col("at"), k * size), F.lit(size)).cast("int")).cast("string").alias("bases")))

    parts = F.get(F.transform(F.array(F.col("bases").cast("binary")), cut), F.lit(0))
    held = placed.select(align, F.explode(parts).alias("p")).select("align_id", "p.*").groupBy("align_id", "block").agg(F.array_sort(F.collect_list(F.struct("from", "bases"))).alias("p"))
    blocks = held.select("align_id", "block", F.array(F.concat(F.lit("."), F.array_join(F.transform("p", lambda x: x["bases"]), ""))).alias("rows"))
    names = lines.select("file").distinct().select(align, F.regexp_extract("file", r"([^/]+)\.(?:fa|fas|fasta)$", 1).alias("chr_name"))
    return Genome(scratch.keep(names, "names"), Store(blocks, scratch, size, "genome_"))


def valid_regions(genome: Genome, bridge: int = 50, min_length: int = 5000, truncate: int = 100_000) -> DataFrame:
    """chr_name, start, end, seq: stretches without other letters than ACGT-, gaps under ``bridge`` bridged, cut into pieces, the last with the rest."""
    store = genome.store
    bases = F.substring(F.get("rows", 0), F.lit(2), F.lit(store.size))
    runs = store.blocks.select("align_id", (F.col("block") * store.size).alias("at"), F.explode(iv.runs_of(bases, "ACGT-")).alias("s"))
    runs = runs.select("align_id", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end") + bridge - 1).alias("end"))  # spans reach as far as they bridge
    spans = joins.span_union(runs, ["align_id"], "start", "end", Scratch(store.scratch.spark, "regions")).withColumn("end", F.col("end") - (bridge - 1)).where(F.col("end") - F.col("start") + 1 >= min_length)
    n = F.greatest(F.floor((F.col("end") - F.col("start") + 1) / truncate), F.lit(1))
    cut = spans.select("align_id", "start", "end", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    first = F.col("start") + F.col("i") * truncate
    pieces = cut.select("align_id", first.cast("int").alias("start"), F.when(F.col("i") == F.col("n") - 1, F.col("end")).otherwise(first + truncate - 1).cast("int").alias("end"))
    found = store.slices(pieces.withColumn("chr", F.col("align_id")), ["chr", "start", "end"], "start", "end").withColumnRenamed("chr", "align_id")
    return found.join(genome.names, "align_id").select("chr_name", "start", "end", F.get("slices", 0).alias("seq"))


def self_alignment(regions: DataFrame, target: str, query: str) -> DataFrame:
    """Each region aligned with itself, for studies of one genome."""
    row = lambda i, name: F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), F.col("chr_name").alias("chr"), F.lit("+").alias("strand"), F.col("start").alias("start"), F.col("end").alias("end"), F.col("seq").alias("seq"))
    return regions.select(F.xxhash64("chr_name", "start").alias("align_id"), F.col("chr_name").alias("file"), F.array(row(0, target), row(1, query)).alias("rows"))


def chromosomes(spark: SparkSession, path: str) -> DataFrame:
    """The first four columns of a CSV file with a header; ids by hash."""
    raw = spark.read.csv(path, header=True, schema="common_name string, taxon_id int, chr_name string, chr_length int, assembly string", enforceSchema=True)
    return raw.select(F.xxhash64("common_name", "chr_name").alias("chr_id"), "common_name", "taxon_id", "chr_name", "chr_length", "assembly")


def annotation(spark: SparkSession, text: str) -> DataFrame:
    """chr_name, kind, start, end from YAML with ``cds`` and ``repeat``: chromosome to runlist.

    Two levels of plain keys are read; other kinds are skipped, and whatever else YAML allows (flow maps, lists, deeper levels, text
    over several lines) raises ValueError.
    """
    found, kind, depth = {}, None, None
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.strip() in ("---", "...") or line.lstrip().startswith("#"):
            continue
        m = re.match(r"^( *)([^:#\s\[{&*!|>-][^:]*?|'[^']*'|\"[^\"]*\") *:(?: +(.*?))? *(?: #.*)?$", line)
        value = (m[3] or "").strip("'\"") if m else ""
        if not m or not re.fullmatch(r"[-\d, ]*", value) or bool(m[1]) != bool(value) or (m[1] and (kind is None or depth not in (None, m[1]))):
            raise ValueError(f"annotation, line {number}: expected 'kind:' or '  chromosome: runlist'")
        key = m[2].strip("'\"")
        if m[1]:
            found[kind][key], depth = value, m[1]
        else:
            kind, depth = key, None
            found.setdefault(kind, {})
    if missing := {"cds", "repeat"} - set(found):
        raise ValueError(f"annotation lacks {sorted(missing)}")
    rows = [(c, k, r) for k in ("cds", "repeat") for c, r in found[k].items()]
    df = spark.createDataFrame(rows, "chr_name string, kind string, runlist string")
    return df.select("chr_name", "kind", F.explode(iv.parse(F.col("runlist"))).alias("s")).select("chr_name", "kind", "s.start", "s.end")


def positions(spark: SparkSession, sources: Sequence[tuple[str, str, str]]) -> DataFrame:
    """tag, type, chr_name, start, end from (file, tag, type) lists of ``chr:start-end`` lines; lines without a chromosome are left out.

    A line may have several spans, ``chr:1-5,9-12``: each gives a row.
    """
    out = None
    for path, tag, kind in sources:
        at = lambda i: F.regexp_extract("value", r"^\s*(?:[^.\s]+\.)?([^\s:(]+)(?:\([+-]\))?:(\d+(?:-\d+)?(?:,\d+(?:-\d+)?)*)", i)
        df = spark.read.text(path).select(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), at(1).alias("chr_name"), at(2).alias("spans")).where("chr_name <> ''")
        df = df.select("tag", "type", "chr_name", F.explode(F.split("spans", ",")).alias("s"))
        df = df.select("tag", "type", "chr_name", F.substring_index("s", "-", 1).cast("int").alias("start"), F.substring_index("s", "-", -1).cast("int").alias("end"))
        out = df if out is None else out.unionByName(df)
    return out


def genes(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Genes or exons from Parquet with the columns of the table that it has."""
    df = spark.read.parquet(path)
    known = {c.split()[0] for c in TABLES[table].split(", ")} | {"chr_name", "start", "end"}
    return df.select(*[c for c in df.columns if c in known])


def select_statements(text: str) -> list[str]:
    """Statements of a SQL text that select."""
    return [s.strip() for s in text.split(";") if re.search("select", s, re.I)]


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> list[DataFrame]:
    """Each selecting statement over the named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return [spark.sql(s) for s in select_statements(text)]
