"""Aligned sequences in blocks of columns, with look-ups by column and by rank.

A chromosome's alignment is one row of a table no more: its columns are dealt into blocks of a fixed size, and each block has that part
of all its sequences. What is asked of an interval is answered by the blocks that it touches and put together: sums over columns (a
block's running sums, two entries an interval), the bases themselves, and positions. A directory of ranks does the
same for the columns of a set, such as those without a gap: it finds the column of a rank, and the rank of a column. Nothing here
walks a whole sequence for an interval, so that time is linear in columns and intervals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genolith.functions import genetics as g
from genolith.scratch import Scratch

#: Columns of a block.
SIZE = 4096
#: Sums over the columns of an interval; ``of_free`` are over columns without a gap in any sequence.
SUMS = ("columns", "comparables", "differences", "pair_differences", "gc", "bases", "gc_of_free", "bases_of_free", "free", "target", "target_gap_runs", "gap_runs")


def column_blocks(sequences: DataFrame, size: int = SIZE) -> DataFrame:
    """align_id, block, rows: for each block from 0 the parts of all sequences but the outgroup, by position. Each part begins with the column
    before the block, a dot for the first block."""

    def cut(b: Column) -> Column:
        blocks = F.ceil(F.octet_length(b) / size).cast("int")
        part = lambda k: F.when(k == 0, F.concat(F.lit("."), F.substring(b, F.lit(1), F.lit(size)).cast("string"))).otherwise(F.substring(b, k * size, F.lit(size + 1)).cast("string"))
        return F.when(blocks > 0, F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(k.alias("block"), F.upper(part(k)).alias("bases"))))

    # the bytes are taken once for each sequence: slices of them cost what they hold
    parts = F.get(F.transform(F.array(F.col("seq_seq").cast("binary")), cut), F.lit(0))
    rows = sequences.where("seq_role <> 'O'").select("align_id", "seq_position", F.explode(parts).alias("x")).select("align_id", "x.block", "seq_position", "x.bases")
    held = rows.groupBy("align_id", "block").agg(F.array_sort(F.collect_list(F.struct("seq_position", "bases"))).alias("r"))
    return held.select("align_id", "block", F.transform("r", lambda x: x["bases"]).alias("rows"))


def _matrix(rows: list[str]) -> np.ndarray:
    if len({len(r) for r in rows}) > 1:
        raise ValueError("sequences of an alignment differ in length")
    return np.frombuffer("".join(rows).encode(), np.uint8).reshape(len(rows), -1)


def _running(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SUMS up to each column of a block, from 0; gaps, and where runs of gaps begin. The first column of m is the one before."""
    body, n = m[:, 1:], len(m)
    gaps = (m == g.GAP).any(0)
    gap, begins = gaps[1:], gaps[1:] & ~gaps[:-1]
    comparable = g.BASES[body].all(0)
    alike = sum((body == ord(b)).sum(0).astype(np.int64) ** 2 for b in "ACGT")
    free, first = ~gap, body[0]
    gc, bases = g.GC[first], g.BASES[first]
    each = [np.ones(len(gap), np.int64), comparable, comparable & (alike < n * n), np.where(comparable, (n * n - alike) // 2, 0), gc, bases, gc & free, bases & free, free, first != g.GAP, (m[0, 1:] == g.GAP) & (m[0, :-1] != g.GAP), begins]
    out = np.zeros((len(SUMS), len(gap) + 1), np.int64)
    np.cumsum(np.array([x.astype(np.int64) for x in each]), axis=1, out=out[:, 1:])
    return out, gap, begins


class Store:
    """Blocks of the sequences of some alignments, written below the shared folder, with their rank directories."""

    def __init__(self, sequences: DataFrame, scratch: Scratch | None = None, size: int = SIZE, name: str = ""):
        """Of a sequence table, or of blocks as ``column_blocks`` gives them."""
        self.size, self.scratch, self.name = size, scratch or Scratch(sequences.sparkSession, "sequences"), name
        blocks = sequences if "rows" in sequences.columns else column_blocks(sequences, size)
        self.blocks = self.scratch.keep(blocks, f"{name}column_blocks")
        self._members: dict[str, DataFrame] = {}
        self._compressed: dict[str, Store] = {}
        self._places: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, sequences: DataFrame | Store) -> Store:
        return sequences if isinstance(sequences, Store) else cls(sequences)

    def _touched(self, intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
        """A row for each block that an interval touches: keys, align_id, block, a, b (columns within the block), head (the interval's first block)."""
        low, high = ((F.floor((F.col(c) - 1) / self.size)).cast("int") for c in (start, end))
        rows = intervals.where(F.col(start).isNotNull() & (F.col(start) <= F.col(end)) & (F.col(start) >= 1))
        rows = rows.select("align_id", *keys, F.col(start).alias("_sq_start"), F.col(end).alias("_sq_end"), low.alias("_sq_low"), F.explode(F.sequence(low, high)).alias("block"))
        a, b = F.greatest(F.col("_sq_start") - F.col("block") * self.size, F.lit(1)), F.least(F.col("_sq_end") - F.col("block") * self.size, F.lit(self.size))
        return rows.select("align_id", *keys, "block", a.cast("int").alias("a"), b.cast("int").alias("b"), (F.col("block") == F.col("_sq_low")).alias("head"))

    def sums(self, intervals: DataFrame, ident: str, start: str, end: str) -> DataFrame:
        """ident (a long that is unique), rows (sequences) and SUMS of each interval of columns, what lies beyond the alignment left out.

        ``gap_runs`` counts runs of columns with a gap in any sequence, those that begin before the interval too. Intervals
        that touch no block are absent. All intervals that touch a block are with it in one row.
        """
        touched = self._touched(intervals, [ident], start, end)
        packed = touched.groupBy("align_id", "block").agg(F.collect_list(F.struct(F.col(ident).cast("long").alias("ident"), "a", "b", "head")).alias("w"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column("rows").to_pylist()
                for i, w in enumerate(batch.column("w")):
                    sums, gap, begins = _running(_matrix(rows[i]))
                    ident, a, b, head = (w.values.field(c).to_numpy(zero_copy_only=False) for c in ("ident", "a", "b", "head"))
                    there = a <= len(gap)
                    ident, a, b, head = ident[there], a[there], np.minimum(b[there], len(gap)), head[there]
                    found = sums[:, b] - sums[:, a - 1]
                    found[-1] += head & gap[a - 1] & ~begins[a - 1]  # a run that began before the interval
                    yield pa.RecordBatch.from_arrays([pa.array(ident, pa.int64()), pa.array(np.full(len(a), len(rows[i]))), *[pa.array(x) for x in found]], names=[ident_, "rows", *SUMS])

        ident_ = ident
        out = packed.join(self.blocks, ["align_id", "block"]).select("rows", "w").mapInArrow(run, f"{ident} long, rows long, " + ", ".join(f"{c} long" for c in SUMS))
        return out.groupBy(ident).agg(F.max("rows").alias("rows"), *[F.sum(c).alias(c) for c in SUMS])

    def stats(self, intervals: DataFrame, ident: str, start: str, end: str) -> DataFrame:
        """ident, comparables, identities, differences, pi (mean over pairs of sequences), gc of the first sequence, gc_of_free, gap_runs."""
        x = self.sums(intervals, ident, start, end)
        pairs = F.col("rows") * (F.col("rows") - 1) / 2
        return x.select(ident, "columns", "comparables", (F.col("comparables") - F.col("differences")).alias("identities"), "differences", F.try_divide(F.col("pair_differences"), pairs * F.col("comparables")).alias("pi"), F.try_divide("gc", "bases").alias("gc"), F.try_divide("gc_of_free", "bases_of_free").alias("gc_of_free"), "gap_runs")

    def slices(self, intervals: DataFrame, keys: Sequence[str], start: str, end: str, first_only: bool = False) -> DataFrame:
        """keys, slices: the bases of each interval, for all sequences by position or the first only; keys tell intervals apart."""
        rows = F.slice("rows", 1, 1) if first_only else F.col("rows")
        part = F.transform(rows, lambda r: F.substring(r, F.col("a") + 1, F.col("b") - F.col("a") + 1))
        met = self._touched(intervals, keys, start, end).join(self.blocks, ["align_id", "block"]).select(*keys, "block", part.alias("part"))
        held = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("p"))
        return held.select(*keys, F.transform(F.sequence(F.lit(0), F.size(F.get("p", 0)["part"]) - 1), lambda i: F.array_join(F.transform("p", lambda x: F.get(x["part"], i)), "")).alias("slices"))

    def members(self, kind: str) -> DataFrame:
        """align_id, block, n, columns, base: the columns of a set in each block, and how many lie in the blocks before.

        ``free``: columns without a gap in any sequence; ``target``: those where the first sequence has none.
        """
        if kind not in self._members:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = []
                    for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                        m = _matrix(rows)[: 1 if kind == "target" else None, 1:]
                        found.append((np.flatnonzero((m != g.GAP).all(0)) + 1 + block * size).astype(np.int32))
                    columns = [batch.column("align_id"), batch.column("block"), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["align_id", "block", "n", "columns"])

            size = self.size
            held = self.scratch.keep(self.blocks.mapInArrow(run, "align_id long, block int, n int, columns array<int>"), f"{self.name}{kind}")
            before = Window.partitionBy("align_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            base = held.select("align_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))  # a narrow row for each block
            self._members[kind] = self.scratch.keep(held.join(base, ["align_id", "block"]), f"{self.name}{kind}_members")
        return self._members[kind]

    def sizes(self, kind: str) -> DataFrame:
        """align_id, size: members of the set."""
        return self.members(kind).groupBy("align_id").agg(F.sum("n").cast("int").alias("size"))

    def places(self, kind: str) -> DataFrame:
        """align_id, block, columns: the set's columns in blocks of ranks."""
        if kind not in self._places:
            x = self.members(kind).where("n > 0")
            x = x.withColumn("to", F.explode(F.sequence(F.floor(F.col("base") / self.size), F.floor((F.col("base") + F.col("n") - 1) / self.size))))
            skip = F.greatest(F.col("to") * self.size - F.col("base"), F.lit(0)).cast("int")
            part = F.slice("columns", skip + 1, F.least((F.col("to") + 1) * self.size - F.col("base"), F.col("n")).cast("int") - skip)
            held = x.select("align_id", F.col("to").cast("int").alias("block"), "base", part.alias("part")).groupBy("align_id", "block").agg(F.array_sort(F.collect_list(F.struct("base", "part"))).alias("p"))
            self._places[kind] = self.scratch.keep(held.select("align_id", "block", F.flatten(F.transform("p", lambda p: p["part"])).alias("columns")), f"{self.name}{kind}_places")
        return self._places[kind]

    def compressed(self, kind: str) -> Store:
        """A store of the columns of a set only: its columns are this one's ranks."""
        if kind not in self._compressed:
            size = self.size

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out: dict[str, list] = {c: [] for c in ("align_id", "block", "offset", "rows")}
                    for align, block, rows, columns, base in zip(*(batch.column(c).to_pylist() for c in ("align_id", "block", "rows", "columns", "base"))):
                        kept = _matrix(rows)[:, np.array(columns) - block * size]
                        for to in range(base // size, (base + kept.shape[1] - 1) // size + 1):
                            a, b = max(to * size - base, 0), min((to + 1) * size - base, kept.shape[1])
                            parts = [(to, base + a - to * size, kept[:, a:b])]
                            if base + b == (to + 1) * size:  # a block's last column comes before the next one
                                parts.append((to + 1, -1, kept[:, b - 1 : b]))
                            for target, offset, part in parts:
                                for c, v in (("align_id", align), ("block", target), ("offset", offset), ("rows", [r.tobytes().decode() for r in part])):
                                    out[c].append(v)
                    kinds = (("align_id", pa.int64()), ("block", pa.int32()), ("offset", pa.int32()), ("rows", pa.list_(pa.string())))
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds], names=list(out))

            parts = self.blocks.join(self.members(kind).where("n > 0"), ["align_id", "block"]).select("align_id", "block", "rows", "columns", "base").mapInArrow(run, "align_id long, block int, offset int, rows array<string>")
            held = parts.groupBy("align_id", "block").agg(F.array_sort(F.collect_list(F.struct("offset", "rows"))).alias("p")).where("p[size(p) - 1].offset >= 0")
            start = F.when(F.get("p", 0)["offset"] < 0, "").otherwise(".")
            rows = F.transform(F.sequence(F.lit(0), F.size(F.get("p", 0)["rows"]) - 1), lambda i: F.concat(start, F.array_join(F.transform("p", lambda x: F.get(x["rows"], i)), "")))
            self._compressed[kind] = Store(held.select("align_id", "block", rows.alias("rows")), self.scratch, size, f"{kind}_only_")
        return self._compressed[kind]

    def column_of(self, rows: DataFrame, kind: str, **ranks: str) -> DataFrame:
        """rows (with align_id) with a column for each name=rank column: the alignment column of that rank, from 1, in the set; null beyond it."""
        out = rows
        for name, rank in ranks.items():
            place = self.places(kind).select("align_id", F.col("block").alias("_block"), F.col("columns").alias("_columns"))
            keyed = out.withColumn("_block", F.floor((F.col(rank) - 1) / self.size).cast("int"))
            within = (F.col(rank) - 1 - F.col("_block") * self.size).cast("int")
            out = keyed.join(place, ["align_id", "_block"], "left").select(*out.columns, F.get("_columns", within).alias(name))
        return out

    def rank_of(self, rows: DataFrame, kind: str, ident: str, column: str, name: str = "rank") -> DataFrame:
        """ident, name: how many columns of the set there are up to an alignment column; ident is a unique long."""
        block = F.floor((F.col(column) - 1) / self.size).cast("int")
        x = rows.where(F.col(column) >= 1).select("align_id", ident, F.col(column).alias("_column"), block.alias("block"), (block * self.size + 1).alias("_first"))
        base = x.join(self.members(kind).select("align_id", "block", "base"), ["align_id", "block"]).select(ident, "base")
        return self.sums(x, ident, "_first", "_column").join(base, ident).select(ident, (F.col(kind) + F.col("base")).cast("int").alias(name))
