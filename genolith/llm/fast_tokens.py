"""Token ids by the tokenizers library, with a bounded memory of pieces already encoded.

A BPE tokenizer first cuts a text into pieces and encodes each by itself. For the two
vocabularies used here the cut is made by numpy, each distinct piece goes to the library
once per worker, and ids are gathered by numpy. A text that the quick cut might treat
differently (other scripts, control characters, runs of white space, special tokens) is
handed to the library whole, so ids are always those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from genolith.llm.shingles import LOWER, text_bytes

BLANK, LINE, LETTER, DIGIT, OTHER, ODD = range(6)


def _classes() -> np.ndarray:
    """Class of each byte of a text; a two-byte letter (U+00C0 to U+024F) begins with 0xC3 to 0xC9. ODD: texts for the library."""
    table = np.full(256, ODD, np.uint8)
    table[33:127] = OTHER
    table[ord(" ")], table[ord("\n")] = BLANK, LINE
    for first, last in ("az", "AZ"):
        table[ord(first) : ord(last) + 1] = LETTER
    table[48:58] = DIGIT
    table[0xC3:0xCA] = LETTER
    table[0xC2] = OTHER
    return table


_CLASS = _classes()
#: Second bytes of letters and numbers among U+00A0 to U+00BF, and the blank there.
_ODD_LATIN = np.isin(np.arange(256), [0xA0, 0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]) | (np.arange(256) < 0xA0)
MAX_PIECES = 1_000_000
CHUNK_BYTES = 8 << 20


class PieceEncoder:
    """Encodes Arrow string arrays; ``kind`` says how the vocabulary marks words: 'word' (word ends) or 'byte' (leading blanks)."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if kind == "word":
            self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        else:
            self.ends[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        self.most = MAX_PIECES
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.at, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 0

    def _store(self, pieces: list[str], ids: np.ndarray, stops: np.ndarray, skip: int) -> None:
        """ids up to each stop (and ``skip`` more that separate) are one piece's."""
        starts = np.concatenate(([0], stops[:-1] + skip))
        n, first = len(pieces), len(self.known)
        while first + n > len(self.at):
            self.at, self.length = np.resize(self.at, 2 * len(self.at)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[first : first + n], self.length[first : first + n] = self.used + starts, stops - starts
        self.used += len(ids)
        self.known.update(zip(pieces, range(first, first + n)))

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p.strip(" \n")]
        for p in pieces:
            if not p.strip(" \n"):
                ids = np.asarray(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32)
                self._store([p], ids, np.array([len(ids)]), 0)
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode(("\n" if self.kind == "byte" else " ").join(some), add_special_tokens=False).ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids])
            stops, skip = (np.append(stops, len(ids)), 1) if self.kind == "byte" else (stops + 1, 0)
            if len(stops) == len(some):
                self._store(some, ids, stops, skip)
            else:  # a piece that the library cuts further
                for p in some:
                    ids = np.asarray(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32)
                    self._store([p], ids, np.array([len(ids)]), 0)

    def _cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without what is dropped, piece starts there, first piece of each text and the end, whether each text is odd)."""
        n, word = len(data), self.kind == "word"
        if word:
            data = LOWER[data]
        kind = _CLASS[data]
        later = (data & 0xC0) == 0x80  # second byte of a character
        second = np.flatnonzero(later)
        second = second[second > 0]
        lead, second_byte = data[second - 1], data[second]
        kind[second] = np.where((lead == 0xC3) & ((second_byte == 0x97) | (second_byte == 0xB7)), OTHER, kind[second - 1])
        kind[second[(lead == 0xC2) & _ODD_LATIN[second_byte]]] = ODD
        kind[second - 1] = np.where((lead >= 0xC2) & (lead <= 0xC9), kind[second], kind[second - 1])
        head = np.zeros(n + 1, bool)
        head[at[:-1]] = True
        head = head[:n]
        space = kind <= LINE
        odd = kind == ODD
        if n > 1:
            inside = ~head[1:]
            odd[1:] |= inside & (data[1:] == ord("|")) & (data[:-1] == ord("<"))
            if not word:
                odd[1:] |= inside & space[1:] & space[:-1]
        whole = np.zeros(len(at) - 1, bool)
        whole[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        if word:
            start |= kind == DIGIT
        else:
            start |= space
            start[1:] &= ~((kind[:-1] == BLANK) & ~space[1:] & ~head[1:])
        start[second] = False
        start |= head
        # contractions: an apostrophe that begins a piece, and one or two letters
        mark = np.flatnonzero(data == ord("'"))
        mark = mark[start[mark]]
        if len(mark):
            ends = at[np.searchsorted(at, mark, "right")]
            one, two = (np.where(mark + i < ends, data[np.minimum(mark + i, n - 1)], 0) for i in (1, 2))
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(long, 3, 0))
            mark, size = mark[size > 0], size[size > 0]
            start[mark + 1] = False
            start[(mark + size)[mark + size < n]] = True
        if not word:
            first = np.flatnonzero(start)
            return data, first, np.searchsorted(first, at), whole
        start &= ~space
        moved = np.concatenate(([0], np.cumsum(~space)))
        first = np.flatnonzero(start)
        return data[~space], moved[first], np.searchsorted(first, at), whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        data, first, bounds, whole = self._cut(*text_bytes(texts))
        odd = np.flatnonzero(whole)
        if len(odd):
            data, first, bounds, _ = self._cut(*text_bytes(pc.if_else(pa.array(whole), "", texts)))
        offsets = np.append(first, len(data)).astype(np.int64)
        cut = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = cut.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        if len(self.known) + len(pieces) > self.most:
            self._forget()
        new = [p for p in pieces if p not in self.known]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[np.asarray(coded.indices)]
        lengths = self.length[codes].astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.pool[np.repeat(self.at[codes] - sums[:-1], lengths) + np.arange(sums[-1])]
        offsets = sums[bounds]
        if not len(odd):
            return ids, offsets
        own = {int(i): np.asarray(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32) for i in odd}
        parts = [own[i] if i in own else ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def encode_chunks(self, batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES):
        """(slice of the batch, ids, offsets), at most about ``size`` bytes of text at once, a text being whole."""
        texts = batch.column(column)
        sizes = np.cumsum(np.nan_to_num(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
            part = batch.slice(at, to - at)
            yield part, *self.encode(part.column(column))
            at = to


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """The worker's encoder for this vocabulary file, made once."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = PieceEncoder(path, kind)
    return _ENCODERS[path, kind]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
