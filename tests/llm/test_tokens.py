import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from genolith.llm import packing, token_store
from genolith.llm.common import Scratch
from genolith.llm.fast_tokens import PieceEncoder, vocabulary_path

ODD = ["", None, " ", "\n", "a  b", "a\n\nb", "it's don't I'LL x'", " lead", "tail ", "tab\there", "日本語 text", "é é É", "<|endoftext|> x", "12345 6,7.8", "!!! ... ?!", "ñandú²³ ªº", "x\x1fy", "a \nb", "😀 ok", "word " * 3000, " nb", "'sss 's"]


def texts():
    r = random.Random(5)
    made = ["".join(r.choice("abzZéÉ×÷ñß '.,\n-19AĐ!<|¿ª²stmdrevl\t") for _ in range(r.randrange(60))) for _ in range(1500)]
    return ODD + made


def test_ids_are_the_library_s():
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        own, library = PieceEncoder(vocabulary_path(name), kind), Tokenizer.from_file(vocabulary_path(name))
        for first in (0, 0, 7):
            some = texts()[first:]
            ids, offsets = own.encode(pa.array(texts(), pa.string()).slice(first))
            for i, t in enumerate(some):
                assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, (name, t)


def test_elias_fano():
    r = np.random.default_rng(3)
    for n, top in ((1, 0), (1, 10**12), (5, 3), (1000, 10**6), (3000, 50)):
        v = np.sort(r.integers(0, top + 1, n)).astype(np.uint64)
        code = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v).to_bytes())
        assert code.select(np.arange(n)).tolist() == v.tolist() == [int(code.select(i)[0]) for i in range(n)]
        assert len(code.to_bytes()) <= 26 + n * (2 + max(0, np.log2((int(v[-1]) + 1) / n)) + 1) / 8 + 8
    assert token_store.EliasFano.of(np.array([], np.uint64)).select(np.arange(0)).tolist() == []


def test_store_round_trip(spark):
    rows = [(i * 7 - 30, t, "x") for i, t in enumerate(ODD)] + [(None, "no id", "x"), (5, "twice", "x"), (5, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    scratch = Scratch(spark, "t")
    path = vocabulary_path(token_store.VOCABULARY)
    token_store.write_store(df, scratch.root + "/s", path)
    got = sorted(token_store.read_store(spark, scratch.root + "/s", with_ids=True).collect(), key=lambda r: r.start)
    library, at = Tokenizer.from_file(path), 0
    for (doc, text), r in zip(sorted(((d, t or "") for d, t, _ in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    token_store.write_store(df.limit(0), scratch.root + "/e", path)
    assert token_store.read_store(spark, scratch.root + "/e").count() == 0


def test_packing(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, "twice", "x"), (3, "twice", "x"), (None, "none", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    capacity = 128
    got = packing.pack_documents(df, Scratch(spark, "t"), capacity=capacity, with_ids=True).collect()
    library = Tokenizer.from_file(vocabulary_path(packing.VOCABULARY))
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.piece, r.start), []).append(r.ids)
        assert r.length == len(r.ids) <= capacity and r.start == r.piece * capacity and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for d, t, _ in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(-(-len(want) // capacity)):
            assert want[p * capacity : (p + 1) * capacity] in docs[d, p, p * capacity]
    assert sum(r.length for r in got) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-sum(r.length for r in got) // capacity) + 1
    assert packing.pack_documents(df.limit(0), Scratch(spark, "t")).count() == 0


def test_patterns_use_every_count_once():
    r = np.random.default_rng(1)
    for _ in range(20):
        h = {int(n): int(c) for n, c in zip(r.integers(1, 65, 20), r.integers(1, 50, 20))}
        used = {}
        for lengths, n in packing.fit_patterns(h, 64):
            assert sum(lengths) <= 64 and n > 0
            for x in lengths:
                used[x] = used.get(x, 0) + n
        assert used == h
