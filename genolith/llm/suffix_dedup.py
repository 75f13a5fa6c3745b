"""Repeated byte strings across documents, by a logarithmic family of sparse suffix arrays.

The question: which bytes lie in a string of SPAN bytes that also starts earlier. Suffixes are
sampled by content: in each window of SPAN bytes the position whose 16-byte string hashes lowest
is an anchor, so equal windows have equal anchors at equal places. The windows of one anchor follow each
other; all their bytes are the anchor's context (under 2 * SPAN bytes). A suffix array's
entry is an anchor: its first 16 bytes, then a fingerprint of the context, by which it is sorted.

A new batch of documents gets a suffix array and is merge-scanned against the levels that exist:
an anchor whose context is found, there or earlier in the batch, is repeated as a whole. New
entries become a level, and levels of equal rank merge, as in a logarithmic method. The first
occurrences of contexts that begin with the same 16 bytes but differ are then compared window by
window in their suffix order, which finds matches that begin or end inside a context.

All keys are reduced to one entry before they are joined, joins are of plain exchanges, and groups
of more than ``group`` differing contexts leave the in-memory comparison for a distributed one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read
from genolith.llm.shingles import chunks, mix, text_bytes

SPAN, GRAM = 100, 16
BATCHES = 2
#: Ranges of the gram, each with a family of its own, one after the other: a context is compared within its gram only, and the disk that
#: one range works on is free again before the next.
SLICES = 2
GROUP = 50_000
_SEED = np.random.default_rng(99)
_BYTE = _SEED.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_SEED.integers(1, 1 << 62)) * 2 + 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash of each run of ``length`` values, by doubling; one for each start."""
    out, have = None, 0
    part, size = values, 1
    while length:
        if length & 1:
            out = part if out is None else out[: len(out) - size] * _power(size) + part[have:]
            have += size
        length >>= 1
        if length:
            part, size = part[: len(part) - size] * _power(size) + part[size:], 2 * size
    return out


def window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive keys, by prefix and suffix minima of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors_of(data: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, first window, windows less one, place of the anchor from there, hash of its gram, fingerprint of its context) of all anchors."""
    width = span - GRAM + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < span:
        return none
    gram = mix(rolling(_BYTE[data], GRAM))
    key = (gram >> np.uint64(32) << np.uint64(32)) | np.arange(len(gram), dtype=np.uint64)
    lowest = (window_minimum(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), np.maximum(size - span + 1, 0))
    if not len(text):
        return none
    count = np.maximum(size - span + 1, 0)
    window = np.arange(len(text)) + np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    anchor = lowest[window]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(text)] - 1
    start, more, place = window[first], window[last] - window[first], anchor[first]
    owner = text[first]
    # fingerprint of data[start : start + more + span]: a difference of prefix sums, moved to power 0
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(data), np.uint64(_BASE)))))
    inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(start[-1]), np.uint64(pow(_BASE, -1, 1 << 64))))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[:-1])))
    raw = (sums[start + more + span] - sums[start]) * inverse[start]
    shape = ((place - start).astype(np.uint64) << np.uint64(16)) + more.astype(np.uint64)
    return owner, start - at[owner], more, place - start, gram[place].view(np.int64), mix(raw + mix(shape)).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """d, t, text: a key for each document. A null doc_id sorts first; t tells rows apart that share a doc_id."""
    ids = docs.select("doc_id")
    repeated = ids.groupBy("doc_id").count().where("count > 1").limit(1).count()
    t = F.xxhash64(F.coalesce("text", F.lit(""))) if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), t.alias("t"), "text")


def anchor_table(keyed: DataFrame, span: int) -> DataFrame:
    """d, t, a (first window), w (windows less one), o (place of the anchor), gram, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                owner, a, w, o, gram, fp = anchors_of(*text_bytes(part.column("text")), span)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([part.column("d").take(take), part.column("t").take(take), pa.array(a.astype(np.int32)), pa.array(w.astype(np.int16)), pa.array(o.astype(np.int16)), pa.array(gram), pa.array(fp)], names=["d", "t", "a", "w", "o", "gram", "fp"])

    return keyed.select("d", "t", "text").mapInArrow(run, "d long, t long, a int, w smallint, o smallint, gram long, fp long")


class SuffixFamily:
    """Levels of suffix arrays, each a sorted table of first occurrences (gram, fp, d, t, a, w, o); keys are unique across levels."""

    def __init__(self, scratch: Scratch, tag: str = "family"):
        self.scratch, self.tag, self.levels, self.made = scratch, tag, [], 0

    def _write(self, entries: DataFrame) -> DataFrame:
        self.made += 1
        return self.scratch.keep(entries.repartitionByRange("gram", "fp").sortWithinPartitions("gram", "fp"), f"{self.tag}_level_{self.made}")

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Adds anchors of documents that come after all before; returns (d, t, a, w) of those whose context occurs earlier.

        ``last``: nothing follows, so levels are left unmerged.
        """
        n = self.made
        first = F.min(F.struct("d", "t", "a", "w", "o")).alias("f")
        own = self.scratch.keep(batch.groupBy("gram", "fp").agg(first, F.count("*").alias("n")).select("gram", "fp", "n", "f.*"), f"{self.tag}_own_{n}")
        known = None
        for _, level in self.levels:
            hit = own.select("gram", "fp").join(level.select("gram", "fp"), ["gram", "fp"], "left_semi")
            known = hit if known is None else known.unionByName(hit)
        if known is not None:
            known = self.scratch.keep(known, f"{self.tag}_known_{n}")
            fresh = own.join(known, ["gram", "fp"], "left_anti")
            repeated = known.selectExpr("gram", "fp", "CAST(null AS bigint) AS fd", "CAST(null AS bigint) AS ft", "CAST(null AS int) AS fa")
            repeated = repeated.unionByName(fresh.where("n > 1").selectExpr("gram", "fp", "d AS fd", "t AS ft", "a AS fa"))
        else:
            fresh = own
            repeated = own.where("n > 1").selectExpr("gram", "fp", "d AS fd", "t AS ft", "a AS fa")
        repeated = self.scratch.keep(repeated, f"{self.tag}_repeated_{n}")
        found = batch.join(repeated, ["gram", "fp"]).where("fd IS NULL OR d <> fd OR t <> ft OR a <> fa").select("d", "t", "a", "w")
        found = self.scratch.keep(found, f"{self.tag}_found_{n}")
        rank, entries = 0, fresh.select("gram", "fp", "d", "t", "a", "w", "o")
        while not last and self.levels and self.levels[-1][0] == rank:
            entries = entries.unionByName(self.levels.pop()[1])
            rank += 1
        self.levels.append((rank, self._write(entries)))
        self.scratch.drop(f"{self.tag}_own_{n}", f"{self.tag}_known_{n}", f"{self.tag}_repeated_{n}")
        self.scratch.spark._jvm.System.gc()  # Spark then removes shuffle files that nothing refers to
        return found

    def entries(self) -> DataFrame:
        out = self.levels[0][1]
        for _, level in self.levels[1:]:
            out = out.unionByName(level)
        return out


def _windows(table: pa.Table, span: int) -> pa.RecordBatch:
    """Spans (d, t, s, e) of windows that an earlier row of the same gram has at the same place. Rows are sorted by gram, then document and place."""
    table = table.combine_chunks()
    column = lambda c: np.asarray(table.column(c).combine_chunks())
    gram, a, w, o = column("gram"), column("a").astype(np.int64), column("w").astype(np.int64), column("o").astype(np.int64)
    data, at = text_bytes(table.column("context").combine_chunks())
    group = np.cumsum(np.r_[0, gram[1:] != gram[:-1]])
    hashes = mix(rolling(_BYTE[data], span)) if len(data) >= span else np.zeros(0, np.uint64)
    width = span - GRAM + 1
    repeated = np.zeros((len(gram), width), bool)  # by place of the anchor in the window
    for place in range(width):
        rows = np.flatnonzero((o - place >= 0) & (o - place <= w))
        if len(rows) < 2:
            continue
        h = hashes[at[rows] + o[rows] - place]
        order = np.lexsort((rows, h, group[rows]))
        same = (h[order][1:] == h[order][:-1]) & (group[rows][order][1:] == group[rows][order][:-1])
        repeated[rows[order[1:][same]], place] = True
    mark = np.pad(repeated[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)  # windows in the order of the text
    change = np.diff(mark, axis=1)
    r, s = np.nonzero(change == 1)
    r2, e = np.nonzero(change == -1)
    base = a[r] + o[r] - (width - 1)
    return pa.RecordBatch.from_arrays([table.column("d").take(pa.array(r)).combine_chunks(), table.column("t").take(pa.array(r)).combine_chunks(), pa.array((base + s).astype(np.int32)), pa.array((base + e - 1 + span).astype(np.int32))], names=["d", "t", "s", "e"])


def differing(entries: DataFrame, keyed: DataFrame, scratch: Scratch, span: int, group: int) -> DataFrame:
    """Spans (d, t, s, e) found by comparing, window by window, first occurrences of contexts that share a gram."""
    shared = entries.groupBy("gram").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.count("*").alias("n")).where("low <> high").select("gram", "n")
    shared = scratch.keep(shared, "shared")
    some = scratch.keep(entries.join(shared, "gram").select("d", "t", "a", "w", "o", "gram", (F.col("n") > group).alias("large")), "some")
    per_document = some.groupBy("d", "t").agg(F.collect_list(F.struct("a", "w", "o", "gram", "large")).alias("x"))  # bounded by the document

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, text, rows in zip(*(batch.column(c) for c in ("d", "t", "text", "x"))):
                raw = memoryview(text.as_buffer()) if text.is_valid else b""
                x = pa.RecordBatch.from_struct_array(rows.values)
                a, w = np.asarray(x.column("a")), np.asarray(x.column("w"))
                cut = pa.array([bytes(raw[i : i + j + span]) for i, j in zip(a.tolist(), w.tolist())], pa.binary())
                n = len(a)
                yield pa.RecordBatch.from_arrays([pa.array([d.as_py()] * n, pa.int64()), pa.array([t.as_py()] * n, pa.int64()), *x.columns, cut], names=["d", "t", *x.schema.names, "context"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in contexts(batches):
            held.append(b)
            if sum(x.num_rows for x in held) > 5_000:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    texts = keyed.select("d", "t", "text").join(per_document, ["d", "t"])
    cut = scratch.keep(texts.mapInArrow(gathered, "d long, t long, a int, w smallint, o smallint, gram long, large boolean, context binary"), "contexts")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            if not table.num_rows:
                continue
            gram = np.asarray(table.column("gram").combine_chunks())
            edge = int(np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])[-1])
            held = table.slice(edge)
            if edge:
                yield _windows(table.slice(0, edge), span)
        if held is not None and held.num_rows:
            yield _windows(held, span)

    ordered = cut.where("NOT large").distinct().repartition("gram").sortWithinPartitions("gram", "d", "t", "a").select("d", "t", "a", "w", "o", "gram", "context")
    spans = ordered.mapInArrow(small, "d long, t long, s int, e int")
    large = cut.where("large").distinct()
    if not large.limit(1).count():
        return spans

    # beyond ``group`` contexts: a row for each window, its first occurrence by an aggregate
    windows = large.select("d", "t", F.explode(F.expr("transform(sequence(0, CAST(w AS int)), i -> struct(a + i AS s, o - i AS place, substring(context, i + 1, {}) AS string))".format(span))).alias("x"), "gram")
    windows = scratch.keep(windows.select("d", "t", "x.s", "gram", "x.place", F.xxhash64("x.string").alias("h1"), F.hash("x.string").alias("h2")), "windows")
    key = ["gram", "place", "h1", "h2"]
    low = scratch.keep(windows.groupBy(*key).agg(F.min(F.struct("d", "t", "s")).alias("f"), F.count("*").alias("n")).where("n > 1").select(*key, "f"), "low")
    later = windows.join(low, key).where("struct(d, t, s) <> f").select("d", "t", "s", (F.col("s") + span).alias("e"))
    return spans.unionByName(later)


def repeated_spans(docs: DataFrame, scratch: Scratch, span: int = SPAN, batches: int = BATCHES, group: int = GROUP, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans (d, t, s, e) of bytes whose union is what is repeated)."""
    keyed = _keyed(docs)
    anchors = scratch.keep(anchor_table(keyed, span), "anchors")
    cuts = []
    if batches > 1:
        cuts = sorted(set(keyed.stat.approxQuantile("d", [i / batches for i in range(1, batches)], 0.01)))
    bounds = [None, *[int(c) for c in cuts], None]
    edges = [-(1 << 63) + (k << 64) // slices for k in range(1, slices)]
    whole = entries = None
    for k, (least, beyond) in enumerate(zip([None, *edges], [*edges, None])):
        family = SuffixFamily(scratch, f"family_{k}")
        own = anchors if least is None else anchors.where(F.col("gram") >= least)
        own = own if beyond is None else own.where(F.col("gram") < beyond)
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            batch = own if low is None else own.where(F.col("d") > low)
            batch = batch if high is None else batch.where(F.col("d") <= high)
            found = family.add(batch, last=i == len(bounds) - 2)
            whole = found if whole is None else whole.unionByName(found)
        entries = family.entries() if entries is None else entries.unionByName(family.entries())
    scratch.drop("anchors")
    inner = scratch.keep(differing(entries, keyed, scratch, span, group), "inner")
    scratch.drop("contexts", "some")
    scratch.spark._jvm.System.gc()
    return keyed, whole.select("d", "t", F.col("a").alias("s"), (F.col("a") + F.col("w") + span).alias("e")).unionByName(inner)


def remove_repeats(docs: DataFrame, scratch: Scratch, span: int = SPAN, batches: int = BATCHES, group: int = GROUP, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) of each row of docs (doc_id, text).

    Removed is each byte covered by a string of ``span`` bytes that starts earlier too: in a smaller doc_id, or
    in the same document at a smaller start. Null texts are empty; texts under ``span`` bytes are
    kept whole. Rows that share a doc_id are different documents in the order of a hash of their
    text, and if their texts are equal too, one document that is there twice. Null doc_ids come
    first. Extra columns are ignored. What is kept may be cut inside a character.
    """
    keyed, spans = repeated_spans(docs, scratch, span, batches, group)
    per_document = spans.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("x"))  # bounded by the document
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, x in zip(batch.column("text"), batch.column("x")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                kept, at, spans_ = [], 0, 0
                if x.is_valid:
                    rows = pa.RecordBatch.from_struct_array(x.values)
                    s, e = np.asarray(rows.column("s")), np.asarray(rows.column("e"))
                    order = np.argsort(s, kind="stable")
                    s, reach = s[order], np.maximum.accumulate(e[order])
                    new = np.r_[True, s[1:] > reach[:-1]]
                    starts, ends = s[new], reach[np.r_[new[1:], True]]
                    for a, b in zip(starts.tolist(), ends.tolist()):
                        kept.append(raw[at:a])
                        at, spans_ = b, spans_ + 1
                kept.append(raw[at:])
                rest = b"".join(kept)
                for c, v in zip(out, (len(raw), len(raw) - len(rest), spans_, hashlib.sha256(rest).hexdigest(), rest if with_bytes else None)):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds)][: 5 if with_bytes else 4]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *out][: len(columns) + 1])

    joined = keyed.join(per_document, ["d", "t"], "left").select("doc_id", "text", "x")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strings of 100 bytes."""
    return remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark, "op6"))
