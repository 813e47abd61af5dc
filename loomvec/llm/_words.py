"""Words of whole texts, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: The separators of words ``[^\x20\x09-\x0D]+``: exactly what ``bytes.split`` splits at.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of a text that are split at once.
PIECE_BYTES = 1 << 20


def word_lists(text: bytes, table: bytes | None = None) -> Iterator[list[bytes]]:
    """The words of ``text`` in order, as lists of those in some PIECE_BYTES of it; ``table`` translates bytes before."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        # a piece ends where a word does, however long the word
        while end < len(text) and (text[end] if table is None else table[text[end]]) not in SPACES:
            end += 1
        piece = text[start:end]
        yield (piece if table is None else piece.translate(table)).split()
        start = end


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text of an Arrow column of strings or binaries, nulls as empty, one at a time."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""
