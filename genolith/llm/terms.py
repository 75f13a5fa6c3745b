"""Terms of texts: maximal runs of the characters that a table keeps, A-Z lower-cased, as UTF-8 bytes.

All bytes of a character beyond ASCII are from 0x80, so that a table over bytes decides for characters.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are cut at once; texts that are longer are cut in pieces between two terms.
PIECE = 4 << 20


def byte_table(digits: bool) -> bytes:
    """For bytes.translate: letters, digits if asked for, and all beyond ASCII stay; A-Z are lower-cased; the rest are blanks."""
    kept = lambda b: b >= 0x80 or chr(b).isalpha() or digits and chr(b).isdigit()
    return bytes(ord(chr(b).lower()) if b < 0x80 and kept(b) else b if kept(b) else 0x20 for b in range(256))


LETTERS = byte_table(digits=False)
LETTERS_AND_DIGITS = byte_table(digits=True)


def terms(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``piece`` bytes. A term that is longer is in one list, whole."""
    if len(text) <= piece:
        yield text.translate(table).split()
        return
    start, size = 0, piece
    while start < len(text):
        part = text[start : start + size].translate(table)
        cut = len(part) if start + size >= len(text) else part.rfind(b" ")
        if cut < 0:
            size *= 2
            continue
        yield part[:cut].split()
        start, size = start + cut + 1, piece
