"""Best-fit packing by patterns: non-negative least squares over few-document patterns.

Only the histogram of lengths (one count for each length up to the capacity) reaches the driver.
There, patterns of one to three lengths that fill a sequence exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded to the nearest,
and what is left is packed best-fit-decreasing, again on the histogram. Each slot of a
pattern then owns a range of ranks within its length, so that the documents find their places by
their rank: a distributed, salted row number.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read
from genolith.llm.fast_tokens import CHUNK_BYTES, encoder, vocabulary_path

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Pieces that a worker remembers where it returns the ids too.
FEWER_PIECES = 300_000
#: Rows of one length that get their ranks in one task, about.
ROWS_A_SALT = 200_000


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and END_ID, cut only where longer than the capacity.

    A null or empty text is END_ID alone. Repeated rows give their pieces again.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = encoder(path, "word"), CHUNK_BYTES
        if with_ids:  # the ids that go out take memory too
            encode.most, size = FEWER_PIECES, 1 << 20
        for batch in batches:
            for part, ids, offsets in encode.encode_chunks(batch, size=size):
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = np.append(ids[a:b], END_ID).astype("<u4")
                    for i, start in enumerate(range(0, len(own), capacity)):
                        some = own[start : start + capacity]
                        for name, value in zip(out, (doc, i, start, len(some), zlib.crc32(some.tobytes()), some.astype(np.int32) if with_ids else None)):
                            out[name].append(value)
                arrays = [pa.array(out["doc_id"], part.schema.field("doc_id").type), pa.array(out["piece"], pa.int32()), *[pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")]]
                names = list(out)[:5]
                if with_ids:
                    arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fit_patterns(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that together use every count of the histogram exactly.

    All patterns of up to three lengths that fill the capacity are there: some 350,000 at most for a capacity of 2048. Their
    repeats are rounded to the nearest, as far as the counts last; what no pattern takes is packed best-fit-decreasing.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    there = np.flatnonzero(left)
    some = [(n,) for n in there if n == capacity] + [(a, capacity - a) for a in there if 2 * a <= capacity and a < capacity and left[capacity - a]]
    a, b = np.meshgrid(there, there, indexing="ij")
    c = capacity - a - b
    ok = (a <= b) & (b <= c) & (left[np.clip(c, 0, capacity)] > 0)
    triples = np.stack([a[ok], b[ok], c[ok]], 1)
    width = [np.pad(np.array(p, np.int64), (0, 3 - len(p))) for p in some]
    table = np.concatenate([np.array(width, np.int64).reshape(-1, 3), triples])
    out: list[tuple[tuple[int, ...], int]] = []
    if len(table):
        # min |A x - h| over x >= 0: A has up to three ones a column; projected gradient with momentum
        h = left.astype(float)
        use = np.bincount(table.ravel(), minlength=capacity + 1).astype(float)
        step = 1 / np.maximum(3 * use[table].max(1), 1)
        x = y = np.zeros(len(table))
        t = 1.0
        for _ in range(rounds):
            gap = h - np.bincount(table.ravel(), np.repeat(y, 3), capacity + 1)
            gap[0] = 0
            z = np.maximum(y + step * gap[table].sum(1), 0)
            s = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y, x, t = z + (t - 1) / s * (z - x), z, s
        for i in np.argsort(-x, kind="stable"):
            if x[i] < 0.5:
                break
            lengths = table[i][table[i] > 0]
            each, times = np.unique(lengths, return_counts=True)
            n = int(min(round(x[i]), (left[each] // times).min()))
            if n > 0:
                left[each] -= n * times
                out.append((tuple(int(v) for v in lengths[::-1]), n))
    return out + best_fit_decreasing(left, capacity)


def best_fit_decreasing(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing on counts: equal sequences are handled together."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for n in range(capacity, 0, -1):
        c = int(left[n])
        spaces = [s for s in free if s >= n]
        heapq.heapify(spaces)
        while c and spaces:
            s = spaces[0]
            if not free.get(s):
                heapq.heappop(spaces)
                continue
            lengths, k = free[s].pop()
            fit = min(s // n, -(-c // k))  # as many of this length as go in, while they last
            take = min(k, c // fit) if c >= fit else 0
            if not take:
                fit, take = c, 1
            if k > take:
                free[s].append((lengths, k - take))
            free.setdefault(s - fit * n, []).append((lengths + (n,) * fit, take))
            if s - fit * n >= n:
                heapq.heappush(spaces, s - fit * n)
            c -= fit * take
        if c:
            fit = capacity // n
            whole, rest = divmod(c, fit)
            if whole:
                free.setdefault(capacity - fit * n, []).append(((n,) * fit, whole))
            if rest:
                free.setdefault(capacity - rest * n, []).append(((n,) * rest, 1))
    return [x for xs in free.values() for x in xs]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: the rank range from each first rank to the next belongs to that slot."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """The input with sequence_id and offset. ``items`` has ``length`` (1 to the capacity) and is read three times, so it should be a written table.

    Sequences are filled without gaps from 0. An empty input gives an empty result. Columns named
    sequence_id, offset or starting with _pk_ are replaced.
    """
    items = items.drop("sequence_id", "offset")
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if bad := [n for n in histogram if n is None or not 0 < n <= capacity]:
        raise ValueError(f"lengths beyond 1 to {capacity}: {bad[:5]}")
    table = slots(fit_patterns(histogram, capacity))
    salts = max(16, -(-max(histogram.values(), default=0) // ROWS_A_SALT))
    salted = items.withColumn("_pk_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_pk_salt").agg(F.count("*").alias("_pk_n"))
    before = Window.partitionBy("length").orderBy("_pk_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.keep(counts.select("length", "_pk_salt", F.coalesce(F.sum("_pk_n").over(before), F.lit(0)).alias("_pk_before")), "ranks")
    within = Window.partitionBy("length", "_pk_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_pk_row", F.row_number().over(within)).join(counts, ["length", "_pk_salt"]).withColumn("_pk_rank", F.expr("_pk_before + _pk_row - 1")).drop("_pk_salt", "_pk_row", "_pk_before")
    shared = scratch.spark.sparkContext.broadcast(table)  # up to 3 slots of 32 bytes for each of some capacity ** 2 / 12 patterns, and the residuals' groups: bounded by the capacity (about 35 MB for 2048), not by the rows
    names = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        key = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("_pk_rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(t[i, 2] + rank - t[i, 1]), pa.array(t[i, 3])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.select(*names, "_pk_rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; ``with_ids`` adds each piece's token ids."""
    cut = scratch.keep(pieces(docs, path or vocabulary_path(VOCABULARY), capacity, with_ids), "pieces")
    return pack(cut, scratch, capacity)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), Scratch(spark, "op3"))
