"""Token ids of a corpus in binary blocks whose document boundaries are Elias-Fano coded.

A store is a folder of Parquet files, so that any file system Spark can write to will do and a
task that is run again replaces its output. Each row holds one block:

    bytes 0-3 'EFT1'; then little-endian u64: documents n, ids m, width of an id in bytes,
    null doc_ids (they come first), smallest doc_id (two's complement), bits of the two codes;
    code of the n + 1 boundaries; code of the doc_ids less the smallest; m ids.

An Elias-Fano code of n values up to u keeps the low floor(log2(u / n)) bits of each value
packed, and the rest in unary: 2 + log2(u / n) bits a value. One position in SAMPLE of the unary part is stored
as a sample (32 bits); ``select`` finds values from these, and reading takes all its offsets from there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import Scratch, read
from genolith.llm.fast_tokens import encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
MAGIC = b"EFT1"
HEAD = struct.Struct("<4sQQQQqQQ")
SAMPLE = 64


#: Place of each set bit of a byte, lowest first.
_PLACES = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
_ONES = np.array([b.bit_count() for b in range(256)], np.int64)


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(values[-1] // max(n, 1)).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.n, self.low_bits, len(self.high)) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, size = struct.unpack_from("<QQQ", data)
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), 24)
        low = np.frombuffer(data, np.uint8, -(-n * bits // 8), 24 + samples.nbytes)
        return cls(n, bits, low, np.frombuffer(data, np.uint8, size, 24 + samples.nbytes + len(low)), samples)

    def select(self, i: np.ndarray | int) -> np.ndarray:
        """Values i: from the sample before each, byte by byte through the unary part, then the low bits."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such value")
        at = self.samples[i // SAMPLE].astype(np.int64)
        byte, todo = at >> 3, i % SAMPLE
        word = self.high[byte] >> (at & 7) << (at & 7) if len(i) else np.zeros(0, np.uint8)
        going = np.flatnonzero(_ONES[word] <= todo)
        while len(going):
            todo[going] -= _ONES[word[going]]
            byte[going] += 1
            word[going] = self.high[byte[going]]
            going = going[_ONES[word[going]] <= todo[going]]
        out = (8 * byte + _PLACES[word, todo] - i).astype(np.uint64) << np.uint64(self.low_bits)
        for bit in range(self.low_bits):
            place = i * self.low_bits + bit
            out |= (self.low[place >> 3] >> (place & 7) & 1).astype(np.uint64) << np.uint64(bit)
        return out


def encode_block(doc_ids: list[int | None], boundaries: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids ascending, nulls first; boundaries n + 1 values from 0."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    nulls = sum(d is None for d in doc_ids)
    keys = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(keys[0]) if len(keys) else 0
    a = EliasFano.of(boundaries).to_bytes()
    b = EliasFano.of((keys.astype(np.uint64) - np.uint64(least % (1 << 64)))).to_bytes()
    return HEAD.pack(MAGIC, len(doc_ids), len(ids), width, nulls, least, len(a), len(b)) + a + b + ids.astype(f"<u{width}").tobytes()


def decode_block(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    magic, _, m, width, nulls, least, a, b = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = HEAD.size
    code = EliasFano.from_bytes(data[at + a : at + a + b])
    keys = (code.select(np.arange(code.n)) + np.uint64(least % (1 << 64))).astype(np.int64)
    return [None] * nulls + keys.tolist(), EliasFano.from_bytes(data[at : at + a]), np.frombuffer(data, f"<u{width}", m, at + a + b)


def write_store(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encodes all documents, ids in ascending doc_id order (null first; rows that share an id by text), into ``folder``.

    The text is dealt by ranges of doc_id and sorted before it is encoded, so that ids are
    written once and never shuffled. A null text is an empty one.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, block, done = encoder(path, "byte"), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for rows, ids, offsets in encode.encode_chunks(batch):
                n = rows.num_rows
                boundaries = offsets + np.arange(n + 1)
                out = np.full(boundaries[-1], end_id, np.uint32)
                inside = np.ones(len(out), bool)
                inside[boundaries[1:] - 1] = False
                out[inside] = ids
                data = encode_block(rows.column("doc_id").to_pylist(), boundaries, out)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "before": pa.array([done]), "n_ids": pa.array([len(out)]), "data": pa.array([data], pa.binary())})
                block, done = block + 1, done + len(out)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, "part int, block int, before long, n_ids long, data binary").write.mode("overwrite").option("compression", "uncompressed").parquet(folder)


def read_store(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the store, all taken from its files.

    Only one total for each written partition comes to the driver.
    """
    store = spark.read.schema("part int, block int, before long, n_ids long, data binary").parquet(folder)
    totals = {r["part"]: r["n"] for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    first, total = {}, 0
    for p in sorted(totals):
        first[p], total = total, total + totals[p]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "data"))):
                doc_ids, boundaries, ids = decode_block(data)
                bounds = boundaries.select(np.arange(boundaries.n)).astype(np.int64)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                columns = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(bounds[:-1] + before + first[part]), "n_tokens": pa.array(np.diff(bounds)), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return store.select("part", "before", "data").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files."""
    scratch = Scratch(spark, "op10")
    folder = f"{scratch.root}/store"
    write_store(read(spark, sf_dir, "documents", "doc_id", "text"), folder, vocabulary_path(VOCABULARY))
    return read_store(spark, folder)
