"""Word shingles as 64-bit hashes, by numpy over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_SEED = np.random.default_rng(20_240)
_BYTE = _SEED.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _SEED.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, texts being whole."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the end): words are runs without ASCII white space, A-Z lower-cased."""
    data, at = text_bytes(texts)
    data = LOWER[data]
    inside = ~_SEPARATOR[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = at[:-1][np.diff(at) > 0]
    start[edges] = inside[edges]
    first = np.flatnonzero(start)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    ordinal = np.cumsum(start) - 1
    place = np.arange(len(data)) - first[np.maximum(ordinal, 0)]
    longest = int(place.max()) + 1
    powers = np.cumprod(np.full(longest + 1, _BASE)) if longest > 0 else np.ones(1, np.uint64)
    value = np.where(inside, _BYTE[data] * powers[np.maximum(place, 0)], np.uint64(0))
    return mix(np.add.reduceat(value, first)), np.searchsorted(first, at)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of k words; with fewer words the sequence of them all; none without words."""
    words, bounds = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * _PLACE[j]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            short = np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)], np.uint64)
            yield mix(short + np.array([b - a], np.uint64) * _BASE)
        else:
            yield np.zeros(0, np.uint64)
